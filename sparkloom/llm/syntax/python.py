"""Tokens and grammar of Python 3.13."""

from __future__ import annotations

import keyword
import re
import unicodedata

from .tables import EOF, Grammar

GRAMMAR = r"""
file = stmt* EOFT
stmt = if_stmt | while_stmt | for_stmt | try_stmt | with_stmt | def_stmt | class_stmt | async_stmt | decorated | match_stmt | simple
simple = small (';' small)* ';'? NEWLINE
small = type_alias | assignment | exprs_stmt | return_stmt | raise_stmt | 'pass' | 'break' | 'continue' | del_stmt | import_stmt | from_stmt | global_stmt | assert_stmt
exprs_stmt = star_exprs | yield_expr
return_stmt = 'return' star_exprs?
raise_stmt = 'raise' (expr ('from' expr)?)?
del_stmt = 'del' targets_del &DELEND
targets_del = del_target (',' del_target)* ','?
del_target = '(' targets_del? ')' !ACCESS | '[' targets_del? ']' !ACCESS | access | NAME
global_stmt = ('global' | 'nonlocal') NAME (',' NAME)*
assert_stmt = 'assert' expr (',' expr)?
import_stmt = 'import' dotted_as (',' dotted_as)*
dotted_as = NAME ('.' NAME)* ('as' NAME)?
from_stmt = 'from' (('.' | '...')* NAME ('.' NAME)* | ('.' | '...')+) 'import' ('*' | '(' import_as (',' import_as)* ','? ')' | import_as (',' import_as)*)
import_as = NAME ('as' NAME)?
type_alias = 'type' NAME type_params? '=' expr
assignment = NAME ':' expr ('=' rhs)? | ('(' single ')' | access) ':' expr ('=' rhs)? | (star_targets '=')+ rhs !'=' | single AUG rhs
rhs = yield_expr | star_exprs
single = access | NAME | '(' single ')'
star_targets = star_target (',' star_target)* ','?
star_target = '*' star_target | access | target_atom
target_atom = NAME | '(' star_targets? ')' | '[' star_targets? ']'
access~ = atom (call* (attr | index))+ !'('
attr = '.' NAME
call = '(' args? ')'
index = '[' slices ']'
block = NEWLINE INDENT stmt+ DEDENT | simple
if_stmt = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while_stmt = 'while' named ':' block ('else' ':' block)?
for_stmt = 'for' star_targets 'in' star_exprs ':' block ('else' ':' block)?
try_stmt = 'try' ':' block (except_star+ else_part? finally_part? | except+ else_part? finally_part? | finally_part)
except = 'except' (expr ('as' NAME)?)? ':' block
except_star = 'except' '*' expr ('as' NAME)? ':' block
else_part = 'else' ':' block
finally_part = 'finally' ':' block
with_stmt = 'with' ('(' with_item (',' with_item)* ','? ')' ':' | with_item (',' with_item)* ':') block
with_item = expr ('as' star_target &WITHEND)?
def_stmt = 'def' NAME type_params? '(' params? ')' ('->' expr)? ':' block
class_stmt = 'class' NAME type_params? ('(' args? ')')? ':' block
async_stmt = 'async' (def_stmt | for_stmt | with_stmt)
decorated = ('@' named NEWLINE)+ (def_stmt | class_stmt | async_stmt)
type_params = '[' type_param (',' type_param)* ','? ']'
type_param = NAME (':' expr)? ('=' expr)? | '*' NAME ('=' star_expr)? | '**' NAME ('=' expr)?
params = nds (',' ds)? (',' star_params)? ','? | ds (',' star_params)? ','? | star_params ','?
nds = param_bare (',' (param_bare | '/'))*
ds = param_set (',' (param_set | '/'))*
param_bare = NAME (':' expr)? !'='
param_set = NAME (':' expr)? '=' expr
star_params = '*' star_param (',' param)* (',' '**' param_nd)? | '*' (',' param)+ (',' '**' param_nd)? | '**' param_nd
star_param = NAME (':' star_expr)?
param_nd = NAME (':' expr)?
param = NAME (':' expr)? ('=' expr)?
match_stmt = 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject = star_named (',' star_named)* ','?
case = 'case' patterns ('if' named)? ':' block
patterns = star_pattern (',' star_pattern)* ','?
star_pattern = '*' NAME | pattern
pattern = or_pattern ('as' NAME)?
or_pattern = closed ('|' closed)*
closed = '-'? NUMBER (('+' | '-') NUMBER)? | strings | 'None' | 'True' | 'False' | NAME ('.' NAME)* ('(' pattern_args? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (map_item (',' map_item)* ','?)? '}'
pattern_args = pattern_arg (',' pattern_arg)* ','?
pattern_arg = NAME '=' pattern | pattern
map_item = '**' NAME | map_key ':' pattern
map_key = '-'? NUMBER (('+' | '-') NUMBER)? | strings | 'None' | 'True' | 'False' | NAME ('.' NAME)+
star_exprs = star_expr (',' star_expr)* ','?
star_expr = '*' bits | expr
star_named = '*' bits | named
named = NAME ':=' expr | expr !':='
yield_expr = 'yield' ('from' expr | star_exprs)?
expr = lambda | either ('if' either 'else' expr)?
lambda = 'lambda' lam_params? ':' expr
lam_params = lam_nds (',' lam_ds)? (',' lam_star)? ','? | lam_ds (',' lam_star)? ','? | lam_star ','?
lam_nds = NAME !'=' (',' (NAME !'=' | '/'))*
lam_ds = NAME '=' expr (',' (NAME '=' expr | '/'))*
lam_star = '*' NAME (',' lam_param)* (',' '**' NAME)? | '*' (',' lam_param)+ (',' '**' NAME)? | '**' NAME
lam_param = NAME ('=' expr)?
either = negated (('and' | 'or') negated)*
negated = 'not'* compared
compared = bits (comp_op bits)*
comp_op = COMPARE | 'not' 'in' | 'is' 'not'?
bits = signed (BINARY signed)*
signed = SIGN* 'await'? primary
primary = atom (attr | call | index)*
atom = NAME | NUMBER | 'None' | 'True' | 'False' | '...' | strings | '(' group? ')' | '[' listed? ']' | '{' braces? '}'
group = yield_expr | '*' bits ',' (star_named (',' star_named)* ','?)? | named (comp_for | (',' star_named)+ ','? | ',')?
listed = '*' bits more | named (comp_for | more)
more = (',' star_named)* ','?
braces = '**' bits (',' dict_item)* ','? | expr ':' expr (comp_for | (',' dict_item)* ','?) | listed
dict_item = '**' bits | expr ':' expr
comp_for = ('async'? 'for' star_targets 'in' either comp_if*)+
comp_if = 'if' either_or_lambda
either_or_lambda = NAME ':=' expr | either
slices = slice (',' slice)* ','?
slice = '*' bits | named? ':' expr? (':' expr?)? | named
args = genexp_arg !',' | pos_args (',' kw_args)? ','? | kw_args ','?
genexp_arg = named comp_for
pos_args = pos_arg (',' pos_arg)*
pos_arg = '*' expr | named !'=' !FORTOK
kw_args = kw_arg (',' kw_arg)* (',' star_kw)* | star_kw (',' star_kw)*
kw_arg = NAME '=' expr | '*' expr
star_kw = '**' expr | NAME '=' expr
strings = (STRING | fstring)+ | BYTES+
fstring = FSTART (FMID | field)* FEND
field = 'f{' (yield_expr | star_exprs) '='? ('!' NAME)? (':' (FMID | field)*)? 'f}'
"""

KEYWORDS = tuple(keyword.kwlist)
SOFT = ("match", "case", "type")
OPERATORS = (
    "**=", "//=", ">>=", "<<=", "...", "!=", "->", ":=", "**", "//", ">>", "<<", "<=", ">=", "==", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=",
    "+", "-", "*", "/", "%", "@", "&", "|", "^", "~", "<", ">", "(", ")", "[", "]", "{", "}", ",", ":", ".", ";", "=", "!", "f{", "f}",
)
NAMED = ("NAME", "NUMBER", "STRING", "BYTES", "NEWLINE", "INDENT", "DEDENT", "FSTART", "FMID", "FEND", "BAD")
CODE = {w: chr(0x100 + i) for i, w in enumerate((*NAMED, *KEYWORDS, *SOFT, *OPERATORS))}
WORDS = {w: CODE[w] for w in (*KEYWORDS, *SOFT)}
CLOSER = {"(": ")", "[": "]", "{": "}"}
_c = lambda *ws: {CODE[w] for w in ws}
CLASSES = {
    "NAME": _c("NAME", *SOFT), "NUMBER": _c("NUMBER"), "STRING": _c("STRING"), "BYTES": _c("BYTES"), "NEWLINE": _c("NEWLINE"), "INDENT": _c("INDENT"), "DEDENT": _c("DEDENT"), "FSTART": _c("FSTART"), "FMID": _c("FMID"), "FEND": _c("FEND"), "EOFT": {EOF},
    "AUG": _c("+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "**=", "//=", ">>=", "<<="), "COMPARE": _c("<", ">", "<=", ">=", "==", "!=", "in"), "BINARY": _c("|", "^", "&", "<<", ">>", "+", "-", "*", "/", "//", "%", "@", "**"), "SIGN": _c("+", "-", "~"),
    "ACCESS": _c(".", "[", "("), "WITHEND": _c(",", ":", ")"), "DELEND": _c(";", "NEWLINE"), "FORTOK": _c("for"),
}

_BODY = {q: rf"(?:[^{q}\\\n]|\\(?:\r\n|.|\n))*{q}" for q in "'\""}
_LONG = {q: rf"(?:[^{q}\\]|\\.|{q}(?!{q}{q}))*{q * 3}" for q in "'\""}
_FSIMPLE = r"(?:[^{q}\\\n{{}}]|\\[^\nN]|{{{{|}}}}|\{{[A-Za-z_][\w.]*(?:![rsa])?(?::[^{{}}'\"\n]*)?\}})*{q}"
TOKEN = re.compile(
    r"[ \t\f]*(?:"
    r"((?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''" + _LONG["'"] + r'|"""' + _LONG['"'] + r"|'(?!'')" + _BODY["'"] + r'|"(?!"")' + _BODY['"'] + r"|''(?!')|\"\"(?!\")))"
    r"|((?:[fF][rR]?|[rR][fF])(?:'(?!'')" + _FSIMPLE.format(q="'") + r'|"(?!"")' + _FSIMPLE.format(q='"') + r"))"
    r"|((?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))"
    r"|([^\W\d]\w*)"
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?))"
    r"|(\r?\n|\r)|(#[^\n\r]*)|(\\\r?\n)"
    r"|(\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:.;=!]))",
    re.S,
)
INDENT = re.compile(r"([ \t\f]*)(#[^\n\r]*)?(\r?\n|\r)?")
CONVERSION = re.compile(r"[sra]\b[ \t]*[:}]")
PREFIX = re.compile(r"[A-Za-z]*")
BAD_BYTE_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{))")
CHARACTER_NAME = re.compile(r"(?<!\\)(?:\\\\)*\\N\{([^}]*)(\}?)")
_OLD_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*$")


def is_character(name: str) -> bool:
    try:
        return len(unicodedata.lookup(name)) == 1
    except KeyError:
        return False


class Tokens:
    """One file's tokens: ``kinds`` (a character each), places in the text, and for each the end of its logical line."""

    def __init__(self, text: str):
        self.text = text[1:] if text.startswith("\ufeff") else text
        self.kinds: list[str] = []
        self.places: list[int] = []
        self.error: int | None = None
        try:
            self._run()
        except _Bad as e:
            self.error = e.args[0]
            self.kinds.append(CODE["BAD"])
            self.places.append(self.error)

    def _put(self, kind: str, at: int) -> None:
        self.kinds.append(kind)
        self.places.append(at)

    def _run(self) -> None:
        text, n, pos = self.text, len(self.text), 0
        depth: list[str] = []
        levels = [(0, 0)]
        put, code, match = self._put, CODE, TOKEN.match
        name, newline = CODE["NAME"], CODE["NEWLINE"]
        kind, place, word = self.kinds.append, self.places.append, WORDS.get
        fresh = True
        while True:
            if fresh and not depth:
                m = INDENT.match(text, pos)
                if m.group(3) or m.end() == n and (m.group(2) or not m.group(3)) and m.end(1) + len(m.group(2) or "") == n:
                    pos = m.end()
                    if pos >= n:
                        break
                    continue
                if not m.group(2):
                    col = alt = 0
                    for ch in m.group(1):
                        if ch == " ":
                            col, alt = col + 1, alt + 1
                        elif ch == "\t":
                            col, alt = (col // 8 + 1) * 8, alt + 1
                        else:
                            col = alt = 0
                    top = levels[-1]
                    if col == top[0]:
                        if alt != top[1]:
                            raise _Bad(pos)
                    elif col > top[0]:
                        if alt <= top[1]:
                            raise _Bad(pos)
                        levels.append((col, alt))
                        put(code["INDENT"], pos)
                    else:
                        while levels and col < levels[-1][0]:
                            levels.pop()
                            put(code["DEDENT"], pos)
                        if levels[-1] != (col, alt):
                            raise _Bad(pos)
                    pos = m.end(1)
                fresh = False
            if pos >= n:
                break
            m = match(text, pos)
            if m is None:
                rest = text[pos:].lstrip(" \t\f")
                if not rest:
                    pos = n
                    continue
                raise _Bad(n - len(rest))
            g = m.lastindex
            at, pos = m.start(g), m.end()
            if g == 4:
                w = m[4]
                if not w.isascii() and not unicodedata.normalize("NFKC", w).isidentifier():
                    raise _Bad(at)
                kind(word(w, name))
                place(at)
            elif g == 9:
                op = m[9]
                if op in CLOSER:
                    depth.append(CLOSER[op])
                elif op in ")]}":
                    if not depth or depth.pop() != op:
                        raise _Bad(at)
                kind(code[op])
                place(at)
            elif g == 1 or g == 2:
                w = m[g]
                if "\\" in w:
                    head = PREFIX.match(w)[0].lower()
                    if "r" not in head and (BAD_BYTE_ESCAPE if "b" in head else BAD_ESCAPE).search(w):
                        raise _Bad(at)
                    if "\\N" in w and not set("rb") & set(head) and not all(closed and is_character(x) for x, closed in CHARACTER_NAME.findall(w)):
                        raise _Bad(at)
                if w[0] in "bB" or w[1:2] in ("b", "B") and w[0] in "rR":
                    if not w.isascii():
                        raise _Bad(at)
                    put(code["BYTES"], at)
                else:
                    put(code["STRING"], at)
            elif g == 5:
                w = m.group(5)
                if pos < n and (text[pos].isalnum() or text[pos] == "_") and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", text[pos:]):
                    raise _Bad(at)
                if w[0] == "0" and _OLD_OCTAL.match(w):
                    raise _Bad(at)
                put(code["NUMBER"], at)
            elif g == 6:
                if not depth:
                    put(newline, at)
                    fresh = True
            elif g == 3:
                pos = self._fstring(m.group(3), at, pos, 0)
            elif g == 8 and pos >= n:
                raise _Bad(at)
        if depth:
            raise _Bad(n)
        if self.kinds and self.kinds[-1] not in (newline, code["DEDENT"]):
            put(newline, n)
        for _ in levels[1:]:
            put(code["DEDENT"], n)
        put(EOF, n)

    def _fstring(self, opening: str, at: int, pos: int, nest: int) -> int:
        """Tokens of an f-string whose opening ends at ``pos``; gives the place behind its end."""
        quote = opening.lstrip("fFrR")
        raw = "r" in opening.lower()
        self._put(CODE["FSTART"], at)
        pos = self._fparts(quote, raw, pos, nest, False)
        self._put(CODE["FEND"], pos)
        return pos + len(quote)

    def _fparts(self, quote: str, raw: bool, pos: int, nest: int, spec: bool) -> int:
        text, n = self.text, len(self.text)
        if nest > 150:
            raise _Bad(pos)
        begun = pos
        while True:
            if pos >= n:
                raise _Bad(begun)
            ch = text[pos]
            if text.startswith(quote, pos):
                if spec:
                    raise _Bad(pos)
                break
            if ch == "\n" and len(quote) == 1:
                raise _Bad(begun)
            if ch == "\\":
                if text.startswith("\\N{", pos) and not raw:
                    end = text.find("}", pos)
                    if end < 0 or not is_character(text[pos + 3 : end]):
                        raise _Bad(pos)
                    pos = end + 1
                else:
                    pos += 1 if text[pos + 1 : pos + 2] in ("{", "}") else 2
            elif ch == "{" and not spec and text.startswith("{{", pos):
                pos += 2
            elif ch == "}":
                if spec:
                    break
                if not text.startswith("}}", pos):
                    raise _Bad(pos)
                pos += 2
            elif ch == "{":
                if pos > begun:
                    self._put(CODE["FMID"], begun)
                self._put(CODE["f{"], pos)
                pos = begun = self._ffield(quote, raw, pos + 1, nest + 1)
            else:
                pos += 1
        if pos > begun:
            self._put(CODE["FMID"], begun)
        return pos

    def _ffield(self, quote: str, raw: bool, pos: int, nest: int) -> int:
        text, n = self.text, len(self.text)
        depth: list[str] = []
        while True:
            m = TOKEN.match(text, pos) if pos < n else None
            if m is None:
                raise _Bad(pos)
            g, at, pos = m.lastindex, m.start(m.lastindex), m.end()
            if g == 9:
                op = m.group(9)
                if not depth and op == "!":
                    conversion = CONVERSION.match(text, pos)
                    if not conversion:
                        raise _Bad(at)
                if not depth and op == ":=":
                    pos, op = at + 1, ":"
                if op in "([{":
                    depth.append(")]}"["([{".index(op)])
                elif depth and op in ")]}":
                    if depth.pop() != op:
                        raise _Bad(at)
                elif op == "}":
                    self._put(CODE["f}"], at)
                    return pos
                elif op in ")]":
                    raise _Bad(at)
                elif not depth and op == ":":
                    self._put(CODE[":"], at)
                    pos = self._fparts(quote, raw, pos, nest, True)
                    self._put(CODE["f}"], pos)
                    return pos + 1
                self._put(CODE[op], at)
            elif g == 4:
                self._put(WORDS.get(m.group(4), CODE["NAME"]), at)
            elif g in (1, 2):
                self._put(CODE["STRING"], at)
            elif g == 5:
                self._put(CODE["NUMBER"], at)
            elif g == 3:
                pos = self._fstring(m.group(3), at, pos, nest)


class _Bad(Exception):
    pass


_TABLES = None


def tables():
    global _TABLES
    if _TABLES is None:
        _TABLES = Grammar(GRAMMAR, CLASSES, CODE, {}).compile("file", skip={"simple": set()})
    return _TABLES


KNOWN: dict[str, tuple] = {}


def first_error(text: str) -> int | None:
    """Place of the first error of ``text`` from which no reading of it as Python 3.13 recovers; None if valid."""
    if "\x00" in text:
        return text.index("\x00")
    toks = Tokens(text)
    if not toks.kinds:
        return None
    if toks.error is not None:
        return toks.error
    kinds = "".join(toks.kinds)
    ends = line_ends(kinds)
    if len(KNOWN) > 200_000:
        KNOWN.clear()
    got, far, _ = tables().run(kinds, ends, KNOWN)
    return None if got == len(kinds) else toks.places[min(far, len(toks.places) - 1)]


def line_ends(kinds: str) -> list[int]:
    """For each token that begins a logical line the index behind the line's NEWLINE, else 0."""
    newline, inner = CODE["NEWLINE"], (CODE["INDENT"], CODE["DEDENT"])
    ends = [0] * (len(kinds) + 1)
    at = 0
    while True:
        while kinds[at : at + 1] in inner and at < len(kinds):
            at += 1
        end = kinds.find(newline, at)
        if end < 0:
            return ends
        ends[at] = end + 1
        at = end + 1
