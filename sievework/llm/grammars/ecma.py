"""Grammar of JavaScript, TypeScript and TypeScript with JSX. Flags: ts, jsx."""

#: Reserved words can't be identifiers.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Words with a meaning in some places that are identifiers elsewhere.
CONTEXTUAL = frozenset(
    "abstract accessor any as assert asserts async bigint boolean constructor declare from get global implements infer interface is keyof module namespace never number object of out override package private protected public readonly require satisfies set static string symbol target type undefined unique unknown using meta await let yield".split()
)
ID = CONTEXTUAL - {"await", "let", "yield"} | {"ID"}
#: Kinds that a line break after a word gives it; see the lexer.
BROKEN = frozenset(("return0", "break0", "continue0", "throw0", "yield0", "async_fn"))
NAME = CONTEXTUAL | RESERVED | BROKEN | {"ID"}
CLASSES = {
    "ID": ID,
    "NAME": NAME,
    "LP": frozenset(("(", "(A", "(C")),
    "LPA": frozenset(("(A", "(C")),
    "LPE": frozenset(("(", "(C")),
    "LB": frozenset(("[", "nl[")),
    "LT": frozenset(("<", "<G")),
    "GT": frozenset((">", ">+")),
    "SEMI": frozenset((";", "ASI")),
    "ASSIGN": frozenset(("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??=")),
    "BINARY": frozenset(("+", "-", "*", "/", "%", "<<", "&", "|", "^", "==", "!=", "===", "!==", "<", ">", "<=", "instanceof", "in")),
    "MODIFIER": frozenset("public private protected static abstract override readonly declare async accessor get set".split()),
    "PLAIN_MODIFIER": frozenset(("static", "async", "accessor", "get", "set")),
    "PARAM_MODIFIER": frozenset(("public", "private", "protected", "readonly", "override")),
    "LITERAL": frozenset(("NUM", "STR", "REGEX", "null", "true", "false", "TPL")),
    "PREFIX": frozenset(("!", "nl!", "~", "+", "-", "typeof", "void", "delete", "await")),
    "STEP": frozenset(("++", "--", "nl++", "nl--")),
    "LOOSE": frozenset(("NUM", "STR", "TPL", "null", "true", "false", "this", "void")),
}

TEXT = """
%shift 'else' 'catch' 'finally' ';'
# an expression that starts a statement, an exported default or an arrow's body
%empty nb ! '{' 'function' 'async_fn' 'class' 'let' '@'
%empty nf ! 'function' 'async_fn' 'class' '@'
%empty no ! '{'

start = stmt*
stmt = block
    / ('var' / 'let' / 'const') declarators SEMI
    / [ts] ts_decl
    / 'using' ID init SEMI
    / func_decl
    / class_decl
    / 'if' LPE expr ')' stmt ('else' stmt)?
    / 'for' 'await'? LPE for_head ')' stmt
    / 'while' LPE expr ')' stmt
    / 'do' stmt 'while' LPE expr ')' SEMI?
    / 'return' expr? SEMI / 'return0' SEMI
    / ('break' / 'continue') ID? SEMI / ('break0' / 'continue0') SEMI
    / 'throw' expr SEMI
    / 'try' block catch finally? / 'try' block finally
    / 'switch' LPE expr ')' '{' case* '}'
    / 'debugger' SEMI
    / 'with' LPE expr ')' stmt
    / 'import' import_rest
    / decorators? 'export' export_rest
    / ';'
    / nb ID ':' stmt
    / nb expr SEMI
block = '{' stmt* '}'
catch = 'catch' (LP binding type_note? ')')? block
finally = 'finally' block
case = 'case' expr ':' stmt* / 'default' ':' stmt*
for_head = for_var binding ('of' assign / 'in' expr) / place 'of' assign / place 'in' expr
    / (for_var declarators / expr)? ';' expr? ';' expr?
for_var = 'var' / 'let' / 'const' / 'using'
declarators = declarator / declarators ',' declarator
declarator = binding type_note? init? / binding [ts] '!' type_note
init = '=' assign
binding = ID / LB bind_items? ']' / '{' bind_props? '}'
bind_items = bind_item / ',' / ',' bind_item / bind_items ',' / bind_items ',' bind_item
bind_item = '...' binding / binding init?
bind_props = bind_list ','? / bind_list ',' '...' ID / '...' ID
bind_list = bind_prop / bind_list ',' bind_prop
bind_prop = prop_name ':' binding init? / ID init?
type_note = [ts] ':' type

func_decl = ('async_fn' 'function' / 'function') '*'? ID signature body
signature = type_params? params return_note?
body = block / [ts] SEMI
params = LP param_list? ')'
arrow_params = LPA param_list? ')'
param_list = some_params ','? / some_params ',' rest_param / rest_param
some_params = param / some_params ',' param
param = decorators? binding init? / [ts] decorators? PARAM_MODIFIER* binding '?'? type_note? init? / [ts] 'this' type_note?
rest_param = decorators? '...' binding type_note?
return_note = [ts] ':' return_type
return_type = type / (ID / 'this') 'is' type / 'asserts' (ID / 'this') ('is' type)?

class_decl = decorators? 'class' ID? type_params? heritage? '{' member* '}' / [ts] decorators? 'abstract' 'class' ID? type_params? heritage? '{' member* '}'
heritage = 'extends' callee / [ts] 'extends' callee '<' types GT / [ts] ('extends' callee ('<' types GT)?)? 'implements' types
callee = inst / call / call_place / lit
decorators = decorator+
decorator = '@' LPE expr ')' / '@' dotted type_args? arguments?
dotted = ID / dotted '.' NAME
member = ';' / 'static' block
    / pre? '*'? member_name signature body
    / pre? member_name type_note? init? SEMI
    / [ts] pre? index_sig SEMI
    / [ts] pre? member_name ('?' / '!') type_note? init? SEMI
    / [ts] pre? member_name '?' signature body
pre = pre_item / pre pre_item
pre_item = decorator / [ts] MODIFIER / [!ts] PLAIN_MODIFIER
index_sig = LB ID ':' type ']' type_note
member_name = '#' NAME / prop_name
prop_name = NAME / STR / NUM / LB assign ']'

import_rest = STR import_attr? SEMI
    / import_clause 'from' STR import_attr? SEMI
    / [ts] 'type' import_clause 'from' STR import_attr? SEMI
    / [ts] 'type'? ID '=' import_equals SEMI
import_equals = 'require' LPE STR ')' / dotted
import_clause = import_ns / named / ID / ID ',' import_ns / ID ',' named
import_ns = '*' 'as' ID
import_attr = ('with' / 'assert') object
named = '{' (specs ','?)? '}'
specs = spec / specs ',' spec
spec = mod_name ('as' mod_name)? / [ts] 'type' mod_name ('as' mod_name)?
mod_name = NAME / STR
export_rest = 'default' (('async_fn' 'function' / 'function') '*'? ID? signature body / class_decl / nf assign SEMI)
    / [ts] 'default' 'interface' interface_rest
    / '*' ('as' mod_name)? 'from' STR import_attr? SEMI
    / named ('from' STR import_attr?)? SEMI
    / [ts] 'type' '*' ('as' mod_name)? 'from' STR SEMI
    / [ts] 'type' named ('from' STR)? SEMI
    / [ts] '=' expr SEMI
    / [ts] 'as' 'namespace' ID SEMI
    / [ts] 'import' import_rest
    / [ts] ts_decl
    / ('var' / 'let' / 'const') declarators SEMI
    / func_decl / class_decl

ts_decl = 'interface' interface_rest
    / 'type' ID type_params? '=' type SEMI
    / 'const'? 'enum' ID '{' (enum_members ','?)? '}'
    / ('namespace' / 'module') dotted block
    / 'module' STR (block / SEMI)
    / 'global' block
    / 'declare' (ts_decl / ('var' / 'let' / 'const') declarators SEMI / func_decl / class_decl)
interface_rest = ID type_params? ('extends' types)? object_type
enum_members = enum_member / enum_members ',' enum_member
enum_member = prop_name init?

expr = assign / expr ',' assign
assign = cond / arrow
    / 'yield' / 'yield' assign / 'yield' '*' assign / 'yield0'
    / place ASSIGN assign / place '>+' '>+' '=' assign / place '>+' '>+' '>+' '=' assign
arrow = 'async'? ID '=>' arrow_body
    / 'async'? arrow_params return_note? '=>' arrow_body
    / [ts] 'async'? type_params params return_note? '=>' arrow_body
arrow_body = block / no assign
cond = logic / coalesce / (logic / coalesce) '?' assign ':' assign
logic = binary / logic ('&&' / '||') binary
coalesce = binary '??' binary / coalesce '??' binary
binary = unary / binary BINARY unary / binary '>+' '=' unary / binary '>+' GT unary / binary '>+' '>+' '>' unary
    / '#' NAME 'in' unary
    / [ts] binary 'as' ('const' / type) / [ts] binary 'satisfies' type
unary = postfix / postfix '**' unary / PREFIX unary / STEP place / [ts] [!jsx] '<' type GT unary
postfix = inst / call / call_place / lit / bare_new / place ('++' / '--')
place = inst / call_place
# inst: members of primaries and of new with arguments; call: calls; call_place: members of calls
inst = ID / 'this' / 'super' / object / LB elements? ']' / LPE expr ')' / 'new' '.' 'target' / 'import' '.' 'meta'
    / (inst / lit) '.' member_ref / (inst / lit) LB expr ']' / (inst / lit) template
    / 'new' (inst / lit) arguments
    / [ts] (inst / lit) '!' / [ts] inst type_args
call = (inst / lit / call / call_place) arguments / (inst / lit / call / call_place) '?.' optional
    / (call / call_place) template / 'import' arguments
    / [ts] call type_args / [ts] call_place type_args
call_place = (call / call_place) '.' member_ref / (call / call_place) LB expr ']' / [ts] (call / call_place) '!'
bare_new = 'new' (inst / lit / bare_new)
member_ref = NAME / '#' NAME
optional = arguments / LB expr ']' / member_ref / template / [ts] type_args arguments
lit = LITERAL / template_parts / ('async_fn' 'function' / 'function') '*'? ID? type_params? params return_note? block
    / class_decl / [jsx] jsx
template = TPL / template_parts
template_parts = TPL_HEAD expr (TPL_MID expr)* TPL_TAIL
arguments = LPE (args ','?)? ')'
args = arg / args ',' arg
arg = '...' assign / assign
elements = arg / ',' / ',' arg / elements ',' / elements ',' arg
object = '{' (props ','?)? '}'
props = prop / props ',' prop
prop = '...' assign / ('get' / 'set' / 'async')? '*'? prop_name type_params? params return_note? block / prop_name ':' assign / ID init? / ('await' / 'yield')
type_args = '<G' types GT

jsx = 'J<' 'J>' child* 'J</' 'J>' / 'J<' jsx_name attr* ('J/>' / 'J>' child* 'J</' jsx_name 'J>')
jsx_name = J_ID / jsx_name ('.' / ':') J_ID
attr = 'J{' '...' assign 'J}' / J_ID (':' J_ID)? ('J=' (J_STR / 'J{' assign 'J}' / jsx))?
child = J_TEXT / jsx / 'J{' '...' expr 'J}' / 'J{' expr? 'J}'

type_params = [ts] LT type_param_list ','? GT
type_param_list = type_param / type_param_list ',' type_param
type_param = ('const' / 'in' / 'out')* ID ('extends' type)? ('=' type)?
types = type / types ',' type
type = simple_type / simple_type 'extends' simple_type '?' type ':' type
simple_type = fn_type / union
fn_type = type_params params '=>' return_type / arrow_params '=>' return_type / 'abstract'? 'new' type_params? params '=>' type
union = '|'? inter / union '|' inter
inter = '&'? prefix_type / inter '&' prefix_type
prefix_type = ('keyof' / 'unique' / 'readonly') prefix_type / 'infer' ID ('extends' simple_type)? / array_type
array_type = base_type / array_type '[' type? ']'
base_type = LP type ')' / LOOSE / '-' NUM / type_template / mapped / object_type
    / LB (tuple ','?)? ']'
    / type_name (LT types GT)?
    / 'typeof' (type_name / 'this' ('.' member_ref)* / type_name '.' '#' NAME) (LT types GT)?
    / 'typeof'? 'import' LPE type (',' object)? ')' ('.' NAME)* (LT types GT)?
type_name = ID / type_name '.' NAME
type_template = TPL_HEAD type (TPL_MID type)* TPL_TAIL
tuple = tuple_item / tuple ',' tuple_item
tuple_item = '...'? NAME '?'? ':' type / '...' type / type '?'?
mapped = '{' (('+' / '-')? 'readonly')? LB ID 'in' type ('as' type)? ']' (('+' / '-')? '?')? type_note? (SEMI / ',')? '}'
object_type = '{' type_member* '}'
type_member = type_sig (',' / SEMI)
type_sig = signature / 'new' signature
    / 'readonly'? index_sig
    / ('get' / 'set') prop_name params return_note?
    / 'readonly'? prop_name '?'? (signature / type_note)?
"""
