"""Grammar of JSON; the flag loose allows the trailing commas of configuration files."""

TEXT = """
start = value
value = STR / NUM / 'true' / 'false' / 'null'
    / '{' (pairs trailing?)? '}' / '[' (values trailing?)? ']'
pairs = pair / pairs ',' pair
values = value / values ',' value
pair = STR ':' value
trailing = [loose] ','
"""
