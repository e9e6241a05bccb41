"""Grammar of Python 3 over tokens with NEWLINE, INDENT and DEDENT."""

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = frozenset(("match", "case", "type", "_"))
CLASSES = {
    "NAME": SOFT | {"NAME"},
    "AUG": frozenset(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")),
    "COMPARE": frozenset(("==", "!=", "<", "<=", ">", ">=", "in", "is")),
    "ARITH": frozenset(("+", "-", "*", "/", "//", "%", "@", "&", "|", "^", "<<", ">>")),
    "SIGN": frozenset(("+", "-", "~")),
    "CONST": frozenset(("NUM", "None", "True", "False", "...")),
    "DOTS": frozenset((".", "...")),
}

#: The order of parameters is a chain of states: p and c before "/", without and with defaults.
_PARAMS = """
{p}params = {p}n {p}cn? / {p}d {p}cd? / {p}star
{p}cn = ',' {p}params? / ',' '/' {p}sn?
{p}sn = ',' {p}after?
{p}after = {p}n {p}sn? / {p}d {p}sd? / {p}star
{p}cd = ',' ({p}d {p}cd? / {p}star)? / ',' '/' {p}sd?
{p}sd = ',' ({p}d {p}sd? / {p}star)?
{p}star = '*' NAME {star} {p}ck? / '*' ',' {p}kw {p}ck? / '**' {p}n ','?
{p}ck = ',' ({p}kw {p}ck? / '**' {p}n ','?)?
{p}kw = {p}n / {p}d
{p}n = NAME {note}
{p}d = NAME {note} '=' expr
"""

TEXT = (
    """
start = line*
line = simple_line / compound / NEWLINE
simple_line = simples ';'? NEWLINE
simples = simple / simples ';' simple
block = NEWLINE INDENT line+ DEDENT / simple_line

simple = 'pass' / 'break' / 'continue'
    / 'return' star_exprs?
    / 'import' dotted_as (',' dotted_as)*
    / 'from' DOTS* dotted 'import' names / 'from' DOTS+ 'import' names
    / 'global' NAME (',' NAME)* / 'nonlocal' NAME (',' NAME)*
    / 'del' dels ','?
    / 'assert' expr (',' expr)?
    / 'raise' (expr ('from' expr)?)?
    / 'type' NAME type_params? '=' expr
    / star_exprs / yield_expr
    / (targets '=')+ value
    / single ':' expr ('=' value)?
    / single AUG value
names = '*' / as_names / '(' as_names ','? ')'
as_names = as_name / as_names ',' as_name
as_name = NAME ('as' NAME)?
dotted = NAME / dotted '.' NAME
dotted_as = dotted ('as' NAME)?
value = yield_expr / star_exprs
place = NAME / primary '.' NAME / primary '[' slices ','? ']'
single = place / '(' single ')'
target = single / '(' target2 ')' / '(' ')' / '[' targets? ']'
target1 = target / '*' target
target2 = target1 ',' / target1 (',' target1)+ ','?
targets = target1 / target2
dels = del / dels ',' del
del = place / '(' (dels ','?)? ')' / '[' (dels ','?)? ']'

compound = decorator* 'async'? 'def' NAME type_params? '(' params? ')' ('->' expr)? ':' block
    / decorator* 'class' NAME type_params? ('(' args? ')')? ':' block
    / 'if' named ':' block elifs? else?
    / 'while' named ':' block else?
    / 'async'? 'for' targets 'in' star_exprs ':' block else?
    / 'async'? 'with' withs ':' block / 'async'? 'with' '(' with_as ','? ')' ':' block
    / 'try' ':' block 'finally' ':' block
    / 'try' ':' block excepts else? finally?
    / 'match' subject ':' NEWLINE INDENT case_block+ DEDENT
decorator = '@' named NEWLINE
elifs = elif / elifs elif
elif = 'elif' named ':' block
else = 'else' ':' block
finally = 'finally' ':' block
excepts = typed+ / typed+ bare / bare / grouped+
typed = 'except' expr ('as' NAME)? ':' block
bare = 'except' ':' block
grouped = 'except' '*' expr ('as' NAME)? ':' block
withs = with / withs ',' with
with = expr / with1
with1 = expr 'as' target
with_plain = expr / with_plain ',' expr
with_as = with1 / with_plain ',' with1 / with_as ',' with
subject = named / star_named2
type_params = '[' type_param (',' type_param)* ','? ']'
type_param = NAME (':' expr)? ('=' expr)? / '*' NAME ('=' star_expr)? / '**' NAME ('=' expr)?
"""
    + _PARAMS.format(p="", note="(':' expr)?", star="(':' star_expr)?")
    + _PARAMS.format(p="l", note="", star="")
    + """
case_block = 'case' patterns ('if' named)? ':' block
patterns = pattern / pattern2 / '*' NAME ','? / '*' NAME (',' star_pattern)+ ','?
pattern2 = pattern ',' / pattern (',' star_pattern)+ ','?
star_pattern = '*' NAME / pattern
pattern = closed ('|' closed)* ('as' NAME)?
closed = literal / dotted
    / '(' patterns? ')' / '[' patterns? ']'
    / '{' (map_items ','?)? '}'
    / dotted '(' pattern_args? ')'
literal = '-'? NUM (('+' / '-') NUM)? / strings / 'None' / 'True' / 'False'
map_items = map_item / map_items ',' map_item
map_item = '**' NAME / literal ':' pattern / dotted ':' pattern
pattern_args = pattern (',' pattern_args?)? / pattern_kws
pattern_kws = NAME '=' pattern (',' pattern_kws?)?

star_exprs = star_expr / star_expr ',' / star_expr (',' star_expr)+ ','?
star_expr = '*' bit / expr
star_named = '*' bit / named
star_named2 = star_named ',' / star_named (',' star_named)+ ','?
named = NAME ':=' expr / expr
yield_expr = 'yield' / 'yield' star_exprs / 'yield' 'from' expr
expr = either / either 'if' either 'else' expr / 'lambda' lparams? ':' expr
either = inversion / either ('and' / 'or') inversion
inversion = 'not' inversion / comparison
comparison = bit / comparison COMPARE bit / comparison 'not' 'in' bit / comparison 'is' 'not' bit
bit = factor / bit ARITH factor
factor = SIGN factor / power
power = awaited / awaited '**' factor
awaited = 'await' primary / primary
primary = atom / primary '.' NAME / primary '(' args? ')' / primary '(' named comp_for ')' / primary '[' slices ','? ']'
args = arg_pos (',' args?)? / arg_key (',' keys?)? / arg_all (',' alls?)?
keys = arg_key (',' keys?)? / '*' expr (',' keys?)? / arg_all (',' alls?)?
alls = arg_key (',' alls?)? / arg_all (',' alls?)?
arg_pos = '*' expr / named
arg_key = NAME '=' expr
arg_all = '**' expr
slices = slice / slices ',' slice
slice = expr? ':' expr? / expr? ':' expr? ':' expr? / '*' bit / named
atom = NAME / CONST / strings
    / '(' ')' / '(' yield_expr ')' / '(' named ')' / '(' named comp_for ')' / '(' star_named2 ')'
    / '[' ']' / '[' star_named ']' / '[' named comp_for ']' / '[' star_named2 ']'
    / '{' '}' / '{' pairs ','? '}' / '{' expr ':' expr comp_for '}'
    / '{' star_named '}' / '{' named comp_for '}' / '{' star_named2 '}'
pairs = pair / pairs ',' pair
pair = '**' bit / expr ':' expr
comp_for = comp / comp_for comp
comp = 'async'? 'for' targets 'in' either ('if' either)*
strings = string / strings string
string = STR / FS field* FE
field = 'F{' value '='? ('F!' NAME)? ('F:' field*)? 'F}'
"""
)
