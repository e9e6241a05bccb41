"""Column expressions and the lexer shared by the scanners."""
