"""Tokens and grammars of JavaScript modules and TypeScript, each with or without JSX."""

from __future__ import annotations

import re

from .early import MARKS, first_early_error
from .tables import EOF, Grammar

CORE = r"""
program = item* EOFT
item = import_decl | export_decl | stmt
import_decl = 'import' !IMPORTCALL (STRING | import_clause 'from' STRING) attributes? @semi
attributes = ('with' | 'assert') object
import_clause = '*' 'as' ID | named_imports | ID (',' ('*' 'as' ID | named_imports))?
named_imports = '{' (import_spec (',' import_spec)* ','?)? '}'
import_spec = (NAMES | STRING) ('as' ID)?
export_decl = decorators? 'export' export_rest
export_rest = '*' ('as' (NAMES | STRING))? 'from' STRING attributes? @semi | '{' (export_spec (',' export_spec)* ','?)? '}' ('from' STRING attributes?)? @semi | 'default' export_default | declaration
export_spec = (NAMES | STRING) ('as' (NAMES | STRING))?
export_default = function | class | assign @semi
declaration = var_decl | named_function | named_class
named_function = &(('async')? 'function' '*'? ID) function
named_class = &class_name class
class_name = decorators? 'class' ID
stmt = block | var_decl | if_stmt | for_stmt | while_stmt | do_stmt | return_stmt | break_stmt | switch_stmt | throw_stmt | try_stmt | ';' | debugger_stmt | named_function | named_class | labelled | expr_stmt
block = '{' item_in* '}'
item_in = stmt
var_decl = 'const' bind_init (',' bind_init)* @semi | ('var' | 'let') bind (',' bind)* @semi
bind = binding_pattern '=' assign | binding_id ('=' assign)?
bind_init = (binding_pattern | binding_id) '=' assign
binding_id = ID
binding = binding_pattern | ID
binding_pattern = '[' ','* (binding_elem (','+ binding_elem)*)? ','* ']' | '{' (binding_prop (',' binding_prop)* ','?)? '}'
binding_elem = '...' binding | binding ('=' assign)?
binding_prop = '...' ID | prop_name ':' binding ('=' assign)? | ID ('=' assign)?
if_stmt = 'if' '(' expr ')' branch ('else' branch)?
branch = !BINDS stmt
sub_stmt = !DECLARES stmt
while_stmt = 'while' '(' expr ')' sub_stmt
do_stmt = 'do' sub_stmt 'while' '(' expr ')' ';'?
for_stmt = 'for' 'await'? '(' for_head ')' sub_stmt
for_head = ('var' | 'let' | 'const') binding type_note? ('of' assign | 'in' expr) | lhs ('of' assign | 'in' expr) | (('var' | 'let' | 'const') bind_any (',' bind_any)* | expr)? ';' expr? ';' expr?
bind_any = binding type_note? ('=' assign)?
type_note = NEVER
return_stmt = 'return' (@same_line expr)? @semi
break_stmt = ('break' | 'continue') (@same_line ID)? @semi
switch_stmt = 'switch' '(' expr ')' '{' case_clause* '}'
case_clause = ('case' expr | 'default') ':' stmt*
throw_stmt = 'throw' @same_line expr @semi
try_stmt = 'try' block (catch_part finally_part? | finally_part)
catch_part = 'catch' ('(' binding type_note? ')')? block
finally_part = 'finally' block
debugger_stmt = 'debugger' @semi
labelled = ID ':' sub_stmt
expr_stmt = !EXPRSTOP expr @semi
function = ('async' @same_line)? 'function' '*'? ID? '(' params ')' block
params = (param (',' param)*)? ','?
param = '...' binding &CLOSING | binding ('=' assign)?
class = decorators? 'class' (!HERITAGE ID)? class_heads '{' member* '}'
class_heads = ('extends' unary)?
decorators = ('@' decorator)+
decorator = ('(' expr ')' | ID ('.' NAMES)*) ('(' args ')')?
member = ';' | static_block | decorators? member_head
static_block = 'static' block
member_head = ('static' !MEMBEREND)? (accessor | method | field)
accessor = 'get' member_name '(' ')' block | 'set' member_name '(' param ','? ')' block
method = ('async' @same_line !MEMBEREND)? '*'? member_name '(' params ')' block
field = ('accessor' @same_line !MEMBEREND)? member_name ('=' assign)? @semi
member_name = NAMES | PRIVATE | STRING | NUMBER | '[' assign ']'
prop_name = NAMES | STRING | NUMBER | '[' assign ']'
expr = assign (',' assign)*
assign~ = arrow | yield_expr | assignment | cond
yield_expr = 'yield' (@same_line ('*' assign | assign))?
assignment = lhs ASSIGNOP assign
lhs~ = pattern &PATTERNEND | reach
pattern = '[' ','* (pattern_elem (','+ pattern_elem)*)? ','* ']' | '{' (pattern_prop (',' pattern_prop)* ','?)? '}'
pattern_elem = '...' lhs | lhs ('=' assign)?
pattern_prop = '...' lhs | prop_name ':' lhs ('=' assign)? | ID ('=' assign)?
reach = primary (call* access)+ &REACHEND | ID &REACHEND | '(' inner_reach ')' &REACHEND
inner_reach~ = reach
cond = binary ('?' (assign ':' assign | binary ':' assign))?
binary = chain ('??' chain ('??' chain)* !LOGIC | LOGIC chain (LOGIC chain)* !COALESCE)?
chain = unary (binop unary)*
binop = BINARY | '>' ('>' '>'?)?
unary = UNARY* postfix
postfix = member_expr (@same_line ('++' | '--'))?
member_expr = new_expr trailer*
new_expr = 'new'+ ('.' ID trailer_none? | primary) | primary
trailer_none = NEVER
trailer = access | call
access = '.' (NAMES | PRIVATE) | '[' expr ']' | '?.' (NAMES | PRIVATE | '[' expr ']')
call = '(' args ')' | '?.' '(' args ')' | template
args = (arg (',' arg)*)? ','?
arg = '...' assign | assign
primary = function | class | ID | LITERAL | 'this' | 'super' | NUMBER | STRING | REGEX | template | array | object | '(' expr ')' | import_call | PRIVATE &INTOKEN
import_call = 'import' ('(' assign (',' assign)? ','? ')' | '.' ID)
array = '[' ','* (arg (','+ arg)*)? ','* ']'
object = '{' (prop (',' prop)* ','?)? '}'
prop = '...' assign | prop_accessor | prop_method | prop_name ':' assign | ID !NOTSHORT
prop_accessor = 'get' prop_name '(' ')' block | 'set' prop_name '(' param ','? ')' block
prop_method = ('async' @same_line)? '*'? prop_name '(' params ')' block
template = TPLAIN | THEAD expr (TMID expr)* TTAIL
arrow = arrow_head '=>' (block !AFTERBLOCK | !BRACE assign)
arrow_head~ = ('async' @same_line)? ID @same_line &ARROW | ('async' @same_line)? '(' params ')' @same_line &ARROW
"""

#: Rules of JSX, beside the core.
JSX = r"""
primary = function | class | ID | LITERAL | 'this' | 'super' | NUMBER | STRING | REGEX | template | array | object | '(' expr ')' | import_call | PRIVATE &INTOKEN | jsx
jsx = JOPEN jsx_attr* (JVOID | JEND jsx_child* JCLOSE)
jsx_attr = JNAME ('=' (JSTRING | JBRACE jsx_expr JBRACEEND | jsx))? | JBRACE '...' assign JBRACEEND
jsx_child = JTEXT | JBRACE ('...' assign | jsx_expr)? JBRACEEND | jsx
jsx_expr = expr
"""

#: Rules that TypeScript adds or puts in the place of the core's.
TYPES = r"""
item = import_decl | export_decl | stmt
import_decl = 'import' !IMPORTCALL (STRING | 'type'? ID '=' ('require' '(' STRING ')' | ID ('.' NAMES)*) | 'type' import_clause 'from' STRING | import_clause 'from' STRING) attributes? @semi
import_spec = 'type' (NAMES | STRING) 'as' ID | 'type' NAMES !ASWORD | (NAMES | STRING) ('as' ID)?
export_rest = '*' ('as' (NAMES | STRING))? 'from' STRING attributes? @semi | 'type' '*' ('as' (NAMES | STRING))? 'from' STRING attributes? @semi | 'type'? '{' (export_spec (',' export_spec)* ','?)? '}' ('from' STRING attributes?)? @semi | 'default' export_default | '=' expr @semi | 'as' 'namespace' ID @semi | 'import' ID '=' ID ('.' NAMES)* @semi | declaration
export_spec = 'type' (NAMES | STRING) 'as' (NAMES | STRING) | 'type' NAMES !ASWORD | (NAMES | STRING) ('as' (NAMES | STRING))?
export_default = function | class | interface | assign @semi
class_name = decorators? 'abstract'? 'class' ID
declaration = var_decl | named_function | named_class | interface | type_alias | enum | namespace | declare
stmt = block | var_decl | if_stmt | for_stmt | while_stmt | do_stmt | return_stmt | break_stmt | switch_stmt | throw_stmt | try_stmt | ';' | debugger_stmt | named_function | named_class | interface | type_alias | enum | namespace | declare | labelled | expr_stmt
interface = 'interface' @same_line ID type_params? ('extends' type_ref (',' type_ref)*)? type_body
type_alias = 'type' @same_line ID type_params? '=' type @semi
enum = 'const'? 'enum' ID '{' (enum_item (',' enum_item)* ','?)? '}'
enum_item = prop_name ('=' assign)?
namespace = ('namespace' | 'module') @same_line (ID ('.' NAMES)* | STRING) ns_block | 'global' ns_block
ns_block = '{' (item | ambient)* '}'
ambient = 'export'? ('const' | 'let' | 'var') declared (',' declared)* @semi
declare = 'declare' @same_line (('const' | 'let' | 'var') declared (',' declared)* @semi | declaration | 'module' STRING @semi)
declared = ID (':' type)? ('=' assign)?
block = '{' stmt* '}'
var_decl = enum | 'const' bind_init (',' bind_init)* @semi | ('var' | 'let') bind (',' bind)* @semi
bind = binding_pattern type_note? '=' assign | ID '!'? type_note? ('=' assign)?
bind_init = binding type_note? '=' assign
type_note = ':' type
function = ('async' @same_line)? 'function' '*'? ID? type_params? '(' params ')' return_note? (block | @semi)
return_note = ':' ('asserts' @same_line (ID | 'this') ('is' type)? | (ID | 'this') @same_line 'is' type | type)
params = (param (',' param)*)? ','?
param = decorators? (PARAMMOD !PARAMNAMEEND)* ('...' binding type_note? | (binding | 'this') '?'? type_note? ('=' assign)?)
class = decorators? 'abstract'? 'class' (!HERITAGE ID)? type_params? class_heads '{' member* '}'
class_heads = ('extends' unary type_args?)? ('implements' type_ref (',' type_ref)*)?
decorator = ('(' expr ')' | ID ('.' NAMES)*) type_args? ('(' args ')')?
member = ';' | static_block | decorators? member_head
member_head = (MEMBERMOD !MEMBEREND)* (index_member | accessor | method | field)
index_member = '[' ID ':' type ']' type_note @semi
accessor = ('get' | 'set') member_name '(' params ')' return_note? (block | @semi)
method = ('async' @same_line !MEMBEREND)? '*'? member_name '?'? type_params? '(' params ')' return_note? (block | @semi)
field = ('accessor' @same_line !MEMBEREND)? member_name ('?' | '!')? type_note? ('=' assign)? @semi
chain = unary (binop unary | @same_line ('as' | 'satisfies') ('const' | type))*
reach = primary (tcall* taccess)+ &REACHEND | ID '!'? &REACHEND | '(' inner_reach ')' &REACHEND
inner_reach~ = reach
taccess = access | @same_line '!'
tcall = call | type_args call
trailer = access | call | @same_line '!' | type_args &AFTERTYPEARGS
prop = '...' assign | ('get' | 'set') prop_name '(' params ')' return_note? block | ('async' @same_line)? '*'? prop_name type_params? '(' params ')' return_note? block | prop_name ':' assign | ID !NOTSHORT
arrow = arrow_head '=>' (block !AFTERBLOCK | !BRACE assign)
arrow_head~ = ('async' @same_line)? ID @same_line &ARROW | ('async' @same_line)? type_params? '(' params ')' return_note? @same_line &ARROW
type_params = '<' type_param (',' type_param)* ','? '>'
type_param = TYPEMOD* ID ('extends' type)? ('=' type)?
type_args~ = '<' type (',' type)* ','? '>'
type_ref = ID ('.' NAMES)* type_args?
type~ = fn_type | union ('extends' union '?' type ':' type)?
fn_type = 'abstract'? 'new' type_params? '(' params ')' '=>' type | type_params? '(' params ')' '=>' fn_result
fn_result = 'asserts' @same_line (ID | 'this') ('is' type)? | (ID | 'this') @same_line 'is' type | type
union = '|'? inter ('|' inter)*
inter = '&'? type_op ('&' type_op)*
type_op = TYPEOP type_op | 'infer' ID ('extends' union !QUESTION)? | type_post
type_post = type_prim (@same_line '[' type? ']')*
type_prim = '(' type ')' | 'typeof' (import_type | (ID | 'this') ('.' (NAMES | PRIVATE))*) type_args? | import_type | 'this' | 'void' | LITERAL | STRING | '-'? NUMBER | type_template | tuple | mapped | type_body | ID ('.' NAMES)* (@same_line type_args)?
import_type = 'import' '(' type (',' object)? ')' ('.' NAMES)* type_args?
type_template = TPLAIN | THEAD type (TMID type)* TTAIL
tuple = '[' (tuple_item (',' tuple_item)* ','?)? ']'
tuple_item = '...'? (NAMES '?'? ':' type | type '?'?)
mapped = '{' (('+' | '-')? 'readonly')? '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? type_note? ';'? '}'
type_body = '{' (type_member (@member_end type_member)* @member_end?)? '}'
type_member = ('get' | 'set') member_name '(' params ')' return_note? | 'new'? type_params? '(' params ')' return_note? | (('readonly' | 'static') !MEMBEREND)? ('[' ID ':' type ']' type_note | member_name '?'? (type_params? '(' params ')' return_note? | type_note?))
"""

#: Type assertions in angle brackets, which JSX rules out.
CAST = "unary = UNARY* (cast | postfix)\ncast = '<' ('const' | type) '>' unary\n"

RESERVED = (
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof",
    "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield", "await",
)
CONTEXTUAL = (
    "let", "static", "async", "of", "get", "set", "as", "from", "type", "interface", "namespace", "module", "declare", "abstract", "readonly", "public", "private", "protected", "override", "implements", "is", "asserts", "keyof",
    "unique", "infer", "satisfies", "accessor", "require", "global", "out", "assert",
)
#: Contextual words that a module may not use as identifiers.
STRICT = ("let", "static", "implements", "interface", "public", "private", "protected")
SIGNS = (
    "{", "}", "(", ")", "[", "]", ";", ",", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "+", "-", "*", "/", "%", "**", "++", "--", "<<", "&", "|", "^", "!", "~", "&&", "||", "??", "?", "?.", ":", "=", "+=", "-=", "*=",
    "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=", "=>", ".", "...", "@",
)
NAMED = ("NAME", "PRIVATE", "NUMBER", "STRING", "REGEX", "TPLAIN", "THEAD", "TMID", "TTAIL", "JOPEN", "JEND", "JVOID", "JCLOSE", "JNAME", "JSTRING", "JTEXT", "JBRACE", "JBRACEEND", "BAD")
CODE = {w: chr(0x100 + i) for i, w in enumerate((*NAMED, *RESERVED, *CONTEXTUAL, *SIGNS))}
_c = lambda *ws: {CODE[w] for w in ws}
_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")
CLASSES = {
    **{w: _c(w) for w in NAMED}, "EOFT": {EOF}, "NEVER": {"\x01"},
    "ID": _c("NAME", *(w for w in CONTEXTUAL if w not in STRICT)), "NAMES": _c("NAME", *RESERVED, *CONTEXTUAL), "LITERAL": _c("true", "false", "null"), "ASSIGNOP": _c(*_ASSIGN), "IMPORTCALL": _c("(", "."), "HERITAGE": _c("extends", "implements"),
    "BINARY": _c("<", "<=", ">=", "==", "!=", "===", "!==", "+", "-", "*", "/", "%", "**", "<<", "&", "|", "^", "in", "instanceof"), "LOGIC": _c("&&", "||"), "COALESCE": _c("??"), "BINDS": _c("const", "let", "class"), "DECLARES": _c("const", "let", "class", "function"), "CLOSING": _c(")"), "UNARY": _c("!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"),
    "EXPRSTOP": _c("{", "function", "class"), "MEMBEREND": _c("(", "=", ";", "}", ":", "?", "!", ",", "<"), "PARAMNAMEEND": _c(",", ")", ":", "=", "?"), "PATTERNEND": _c(*_ASSIGN, "of", "in", ",", "]", "}", ")"), "REACHEND": _c(*_ASSIGN, "of", "in", ",", "]", "}", ")"),
    "INTOKEN": _c("in"), "NOTSHORT": _c("(", ":", "."), "ARROW": _c("=>"), "AFTERBLOCK": _c("(", "[", ".", "?."), "BRACE": _c("{"), "ASWORD": _c("as"), "QUESTION": _c("?"),
    "AFTERTYPEARGS": _c("(", "TPLAIN", "THEAD", ")", "]", ",", ";", ":", "}", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??") | {EOF}, "PARAMMOD": _c("public", "private", "protected", "readonly", "override"),
    "MEMBERMOD": _c("public", "private", "protected", "readonly", "override", "static", "abstract", "declare"), "TYPEMOD": _c("const", "in", "out"), "TYPEOP": _c("keyof", "unique", "readonly"),
}

_ID = r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_NAME = re.compile(_ID)
TOKEN = re.compile(
    r"(?:[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]++|//[^\n\r\u2028\u2029]*+)*+(?:"
    r"(" + _ID + r")"
    r"|([\n\r\u2028\u2029]+)"
    r"|('(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    r"|(/\*[\s\S]*?\*/)"
    r"|((?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|[0-9](?:_?[0-9])*)n(?![\w$])|0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*"
    r"|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)"
    r"|(`)|(\#" + _ID + r")"
    r"|(\.\.\.|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|/=|[-+*%&|^!~?:=.,;<>()\[\]{}@/]))"
)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)")
CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
JSXTAG = re.compile(r"<\s*(?:([A-Za-z_$][\w$-]*(?:\s*[.:]\s*[A-Za-z_$][\w$-]*)*)|(?=>))")
GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s+[^=>/]*[,>]|=[^>]*,)")
JSXATTR = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*\n)*(?:([A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?)|(=)|(\"[^\"]*\"|'[^']*')|(\{)|(/\s*>)|(>)|(<))")
#: Tokens after which a slash divides and a less-than sign compares.
_OPERAND = _c("NAME", "PRIVATE", "NUMBER", "STRING", "REGEX", "TPLAIN", "TTAIL", ")", "]", "}", "this", "super", "true", "false", "null", "JCLOSE", "JVOID", *CONTEXTUAL)


class _Bad(Exception):
    pass


class Tokens:
    """One file's tokens: a character each, their places, and whether a line end comes before each."""

    def __init__(self, text: str, jsx: bool, types: bool):
        self.text, self.jsx, self.types = text, jsx, types
        self.kinds: list[str] = []
        self.places: list[int] = []
        self.breaks: list[bool] = []
        self.docs: list[tuple[int, int]] = []
        self.error: int | None = None
        self.nl = False
        try:
            pos = text.find("\n") if text.startswith("#!") else 0
            self._code(len(text) if pos < 0 else pos, None)
            self._put(EOF, len(text))
        except _Bad as e:
            self.error = e.args[0]
            self._put(CODE["BAD"], self.error)

    def _put(self, kind: str, at: int) -> None:
        self.kinds.append(kind)
        self.places.append(at)
        self.breaks.append(self.nl)
        self.nl = False

    def _code(self, pos: int, until: str | None) -> int:
        """Tokens up to the end of the text, or up to the brace that closes what ``until`` names."""
        text, n, code, match = self.text, len(self.text), CODE, TOKEN.match
        kinds, places, breaks, name = self.kinds, self.places, self.breaks, CODE["NAME"]
        kind, place, brk, word = kinds.append, places.append, breaks.append, WORDS.get
        depth = 0
        nl = self.nl
        while True:
            m = match(text, pos)
            if m is None:
                rest = text[pos:]
                tail = re.match(r"(?:\s+|//[^\n]*\n?|﻿)*", rest).end()
                if pos + tail >= n:
                    if until:
                        raise _Bad(n)
                    self.nl = nl
                    return n
                raise _Bad(pos + tail)
            g = m.lastindex
            at, pos = m.start(g), m.end()
            if g == 2:
                nl = True
                continue
            if g == 1:
                kind(word(m[1], name))
            elif g == 8:
                op = m[8]
                if op == "/" or op == "/=":
                    if not kinds or kinds[-1] not in _OPERAND:
                        r = REGEX.match(text, at)
                        if not r or len(set(r.group(1))) != len(r.group(1)) or not set(r.group(1)) <= set("dgimsuvy"):
                            raise _Bad(at)
                        pos, op = r.end(), "REGEX"
                elif op == "<" and self.jsx and (not kinds or kinds[-1] not in _OPERAND) and not (self.types and GENERIC.match(text, at)):
                    self.nl = nl
                    pos = self._element(at)
                    nl = False
                    continue
                elif op == "{":
                    depth += 1
                elif op == "}":
                    if depth == 0 and until:
                        self.nl = nl
                        return at
                    depth -= 1
                kind(code[op])
            elif g == 3:
                kind(code["STRING"])
            elif g == 4:
                if text.startswith("/**", at) and not text.startswith("/**/", at):
                    self.docs.append((len(kinds), at))
                if "\n" in m.group(4) or "\r" in m.group(4):
                    nl = True
                continue
            elif g == 5:
                if pos < n and (text[pos].isalnum() or text[pos] in "_$"):
                    raise _Bad(at)
                kind(code["NUMBER"])
            elif g == 6:
                self.nl = nl
                pos = self._template(at)
                nl = False
                continue
            else:
                kind(code["PRIVATE"])
            place(at)
            brk(nl)
            nl = False

    def _template(self, at: int) -> int:
        text = self.text
        m = CHUNK.match(text, at + 1)
        if not m:
            raise _Bad(at)
        if m.group(1) == "`":
            self._put(CODE["TPLAIN"], at)
            return m.end()
        self._put(CODE["THEAD"], at)
        while True:
            end = self._code(m.end(), "template")
            m = CHUNK.match(text, end + 1)
            if not m:
                raise _Bad(at)
            self._put(CODE["TTAIL" if m.group(1) == "`" else "TMID"], end)
            if m.group(1) == "`":
                return m.end()

    def _element(self, at: int) -> int:
        """Tokens of a JSX element that begins at ``at``; gives the place behind it."""
        text, n = self.text, len(self.text)
        m = JSXTAG.match(text, at)
        if not m:
            raise _Bad(at)
        tag = re.sub(r"\s", "", m.group(1) or "")
        self._put(CODE["JOPEN"], at)
        pos = m.end()
        if self.types and text.startswith("<", pos):  # type arguments of a component
            close = text.find(">", pos)
            pos = close + 1 if close > 0 else n
        while True:
            m = JSXATTR.match(text, pos)
            if not m:
                raise _Bad(pos)
            g, where, pos = m.lastindex, m.start(m.lastindex), m.end()
            if g == 1:
                self._put(CODE["JNAME"], where)
            elif g == 2:
                self._put(CODE["="], where)
            elif g == 3:
                self._put(CODE["JSTRING"], where)
            elif g == 4:
                pos = self._braced(where)
            elif g == 5:
                self._put(CODE["JVOID"], where)
                return pos
            elif g == 6:
                self._put(CODE["JEND"], where)
                break
            else:
                pos = self._element(where)
        while True:
            stop = pos
            while stop < n and text[stop] not in "{}<>":
                stop += 1
            if stop >= n:
                raise _Bad(n)
            if stop > pos:
                self._put(CODE["JTEXT"], pos)
            if text[stop] in "}>":
                raise _Bad(stop)
            if text[stop] == "{":
                pos = self._braced(stop)
                continue
            m = re.compile(r"<\s*/\s*([A-Za-z_$][\w$-]*(?:\s*[.:]\s*[A-Za-z_$][\w$-]*)*)?\s*>").match(text, stop)
            if m:
                if re.sub(r"\s", "", m.group(1) or "") != tag:
                    raise _Bad(stop)
                self._put(CODE["JCLOSE"], stop)
                return m.end()
            pos = self._element(stop)

    def _braced(self, at: int) -> int:
        self._put(CODE["JBRACE"], at)
        end = self._code(at + 1, "braces")
        self._put(CODE["JBRACEEND"], end)
        return end + 1


WORDS = {w: CODE[w] for w in (*RESERVED, *CONTEXTUAL)}
_SEMI, _CLOSE = CODE[";"], {CODE["}"], EOF, CODE["JBRACEEND"]}


def _steps(name: str, K: str, NL: list[bool]):
    """The grammar's ``@`` steps over one file's tokens."""
    if name == "semi":

        def semi(p: int) -> int:
            c = K[p]
            return p + 1 if c == _SEMI else p if c in _CLOSE or NL[p] else -1

        return semi
    if name == "same_line":
        return lambda p: -1 if NL[p] else p
    comma = CODE[","]

    def member_end(p: int) -> int:
        c = K[p]
        return p + 1 if c == _SEMI or c == comma else p if NL[p] or c in _CLOSE else -1

    return member_end


STEPS = {"semi": None, "same_line": None, "member_end": None}
VARIANTS = {".js": (False, False), ".jsx": (True, False), ".ts": (False, True), ".tsx": (True, True)}
_MADE: dict[str, object] = {}
KNOWN: dict[str, dict[str, tuple]] = {}


def tables(ext: str):
    if ext not in _MADE:
        jsx, types = VARIANTS[ext]
        text = CORE + (TYPES if types else "") + (JSX if jsx else "") + (CAST if types and not jsx else "")
        _MADE[ext] = Grammar(text, CLASSES, CODE, STEPS).compile("program", skip={"stmt": _c("else", "while")}, marks=() if types else MARKS)
        KNOWN[ext] = {}
    return _MADE[ext]


def first_error(text: str, ext: str) -> int | None:
    """Place of the first error from which no reading of ``text`` as the language of ``ext`` recovers; None if valid."""
    jsx, types = VARIANTS[ext]
    toks = Tokens(text, jsx, types)
    if toks.error is not None:
        return toks.error
    kinds = "".join(toks.kinds)
    parser = tables(ext)
    known = KNOWN[ext]
    if len(known) > 200_000:
        known.clear()
    got, far, note = parser.run(kinds, line_ends(toks.breaks, kinds), known, toks.breaks, _steps)
    if got == len(kinds):
        bad = None if types else first_early_error(toks, kinds, note, CODE, CLASSES["ID"], _NAME)
        return None if bad is None else toks.places[bad]
    return toks.places[min(far, len(toks.places) - 1)]


def line_ends(breaks: list[bool], kinds: str) -> list[int]:
    """For each token that begins a line the index behind the line's last token if that is a semicolon, else 0."""
    ends = [0] * (len(kinds) + 1)
    begin = 0
    for i, b in enumerate(breaks):
        if b:
            if kinds[i - 1] == _SEMI:
                ends[begin] = i
            begin = i
    return ends
