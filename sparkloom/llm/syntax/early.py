"""What a JavaScript module forbids beyond its grammar, judged over the tokens and the noted rules of a parse.

These are the places of ``return``, ``break``, ``continue``, ``await`` and ``yield``, names declared twice in one scope,
and names exported twice.  Whether a name that is used exists does not matter.
"""

from __future__ import annotations

import re

#: Rules whose places are needed.
MARKS = (
    "function", "method", "prop_method", "accessor", "prop_accessor", "arrow", "class", "static_block", "block", "switch_stmt", "for_stmt", "while_stmt", "do_stmt", "labelled", "catch_part", "var_decl", "named_function",
    "named_class", "import_decl", "export_decl", "return_stmt", "break_stmt", "yield_expr",
)
_FUNCTIONS = {"function", "method", "prop_method", "accessor", "prop_accessor", "arrow", "static_block"}
_SCOPES = {*_FUNCTIONS, "block", "switch_stmt", "for_stmt", "catch_part"}
_LOOPS = {"for_stmt", "while_stmt", "do_stmt"}
#: The order in which rules that begin at one token enclose one another.
_ORDER = {r: i for i, r in enumerate(("export_decl", "labelled", "named_function", "named_class", *_LOOPS, "switch_stmt", "static_block", "catch_part", "prop_method", "method", "prop_accessor", "accessor", "function", "class", "arrow", "block"))}


class Scope:
    """One function, block, loop, switch or class while the scan is inside it."""

    __slots__ = ("rule", "end", "lexical", "var", "is_async", "generator", "label", "body", "twice")

    def __init__(self, rule: str, end: int):
        self.rule, self.end = rule, end
        self.lexical: set[str] = set()
        self.var: set[str] = set()
        self.is_async = self.generator = self.body = self.twice = False
        self.label = ""


class Early:
    def __init__(self, toks, kinds: str, code: dict[str, str], ids: set[str], identifier: re.Pattern):
        self.toks, self.K, self.c, self.ids, self.identifier = toks, kinds, code, ids, identifier
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        c, open_, got = self.c, [], {}
        opens = {c[x] for x in ("(", "[", "{", "THEAD", "JBRACE")}
        closes = {c[x] for x in (")", "]", "}", "TTAIL", "JBRACEEND")}
        for i, k in enumerate(self.K):
            if k in opens:
                open_.append(i)
            elif k in closes:
                got[open_.pop()] = i
        return got

    def word(self, p: int) -> str:
        return self.identifier.match(self.toks.text, self.toks.places[p])[0]

    def targets(self, p: int, end: int, out: list[tuple[str, int]]) -> None:
        """Names that the comma-separated binding targets in tokens p..end declare; initialisers are passed over."""
        K, c = self.K, self.c
        comma, dots = c[","], c["..."]
        while p < end:
            k = K[p]
            if k == dots:
                p += 1
                continue
            if k == c["{"] and p in self.match:
                self.properties(p + 1, self.match[p], out)
            elif k == c["["] and p in self.match:
                self.targets(p + 1, self.match[p], out)
            elif k in self.ids:
                out.append((self.word(p), p))
            while p < end and K[p] != comma:
                p = self.match.get(p, p) + 1
            p += 1

    def properties(self, p: int, end: int, out: list[tuple[str, int]]) -> None:
        K, c = self.K, self.c
        comma, colon = c[","], c[":"]
        while p < end:
            if K[p] == c["..."]:
                p += 1
            after = self.match.get(p, p) + 1
            stop = after
            while stop < end and K[stop] != comma:
                stop = self.match.get(stop, stop) + 1
            if after < end and K[after] == colon:
                self.targets(after + 1, stop, out)
            elif K[p] in self.ids:
                out.append((self.word(p), p))
            p = stop + 1

    def imported(self, p: int, end: int) -> list[tuple[str, int]]:
        K, c, out = self.K, self.c, []
        depth = 0
        for i in range(p + 1, end):
            k = K[i]
            if k == c["from"] and depth == 0 and i > p + 1 and K[i + 1] == c["STRING"]:
                break
            depth += (k == c["{"]) - (k == c["}"])
            if k in self.ids and K[i + 1] in (c[","], c["}"], c["from"]) and (K[i - 1] in (c["as"], c[","], c["{"]) or i == p + 1):
                out.append((self.word(i), i))
        return out

    def exported(self, p: int, end: int, note: dict[int, dict[str, int]]) -> list[tuple[str, int]]:
        """Names that the export declaration at p gives out, with the tokens that say so."""
        K, c, out = self.K, self.c, []
        while K[p] != c["export"]:
            p = self.match.get(p, p) + 1
        q = p + 1
        if K[q] == c["default"]:
            return [("default", q)]
        if K[q] == c["*"]:
            return [(self.spelt(q + 2), q + 2)] if K[q + 1] == c["as"] else []
        if K[q] == c["{"]:
            for i in range(q + 1, self.match[q]):
                if K[i + 1] in (c[","], c["}"]) and K[i] != c[","]:
                    out.append((self.spelt(i), i))
            return out
        if "var_decl" in note.get(q, ()):
            self.targets(q + 1, note[q]["var_decl"], out)
            return out
        name = self.name_of(q)
        return [name] if name else []

    def spelt(self, p: int) -> str:
        """A name or the text of a string, as an export has it."""
        if self.K[p] == self.c["STRING"]:
            at = self.toks.places[p]
            return self.toks.text[at + 1 : self.toks.text.index(self.toks.text[at], at + 1)]
        return self.word(p)

    def name_of(self, p: int) -> tuple[str, int] | None:
        """The name of the function or class declared at p."""
        K, c = self.K, self.c
        while K[p] == c["@"] or K[p] not in (c["function"], c["class"]):
            p = self.match.get(p, p) + 1
            if p >= len(K):
                return None
        p += 1
        if K[p] == c["*"]:
            p += 1
        return (self.word(p), p) if K[p] in self.ids else None

    def open(self, rule: str, p: int, end: int) -> Scope:
        K, c = self.K, self.c
        s = Scope(rule, end)
        if rule in _FUNCTIONS and rule != "static_block":
            s.is_async = K[p] == c["async"] and K[p + 1] not in (c["=>"], c["("]) or K[p] == c["async"] and rule == "arrow" and K[p + 1] == c["("]
            q = p + s.is_async
            s.generator = rule != "arrow" and c["*"] in (K[q], K[q + 1] if rule == "function" else "")
            names: list[tuple[str, int]] = []
            if rule == "arrow" and K[q] in self.ids and K[q + 1] == c["=>"]:
                names.append((self.word(q), q))
            else:
                while K[q] != c["("]:
                    q = self.match.get(q, q) + 1
                self.targets(q + 1, self.match[q], names)
            s.var = {n for n, _ in names}
            s.twice = len(s.var) < len(names)
        elif rule == "catch_part" and K[p + 1] == c["("]:
            names = []
            self.targets(p + 2, self.match[p + 1], names)
            s.lexical = {n for n, _ in names}
        elif rule == "labelled":
            s.label = self.word(p)
        return s

    def first(self, note: dict[int, dict[str, int]]) -> int | None:
        """The first token that the module may not have there; None if there is none."""
        K, c = self.K, self.c
        stack = [Scope("module", len(K))]
        exports: set[str] = set()
        await_, ends = c["await"], {c[x] for x in (":", ",", "}", "=", ")", ";", "as", "from", "]")}
        dots = {c["."], c["?."]}
        places = sorted({*note, *[i for i, k in enumerate(K) if k == await_]})
        for p in places:
            while stack[-1].end <= p:
                stack.pop()
            rules = note.get(p, {})
            if K[p] == await_ and K[p + 1] not in ends and K[p - 1] not in dots and not self._is_name(p, note):
                f = self._function(stack)
                if f.rule == "static_block" or f.rule != "module" and not f.is_async:
                    return p
            if "export_decl" in rules:
                for name, at in self.exported(p, rules["export_decl"], note):
                    if name in exports:
                        return at
                    exports.add(name)
            if "import_decl" in rules:
                for name, at in self.imported(p, rules["import_decl"]):
                    if not self._declare(stack, name, True):
                        return at
            if "return_stmt" in rules and self._function(stack).rule in ("module", "static_block"):
                return p
            if "yield_expr" in rules and not self._function(stack).generator:
                return p
            if "break_stmt" in rules and not self._target(stack, p, rules["break_stmt"]):
                return p
            if "var_decl" in rules:
                names: list[tuple[str, int]] = []
                self.targets(p + 1, rules["var_decl"], names)
                for name, at in names:
                    if not self._declare(stack, name, K[p] != c["var"]):
                        return at
            for rule in ("named_function", "named_class"):
                if rule in rules:
                    got = self.name_of(p)
                    top = rule == "named_function" and stack[-1].body
                    if got and not self._declare(stack, got[0], not top, function=top):
                        return got[1]
            for rule in sorted((r for r in rules if r in _ORDER and (r in _SCOPES or r in _LOOPS or r in ("class", "labelled"))), key=_ORDER.get):
                s = self.open(rule, p, rules[rule])
                if s.twice:
                    return p
                if rule == "block":
                    # a function's body shares the scope of its parameters' names
                    s.body = stack[-1].rule in _FUNCTIONS
                stack.append(s)
        return None

    def _is_name(self, p: int, note: dict[int, dict[str, int]]) -> bool:
        named = ("method", "prop_method", "accessor", "prop_accessor")
        return self.K[p + 1] == self.c["("] and any(r in note.get(q, ()) for q in (p, p - 1, p - 2) for r in named)

    @staticmethod
    def _function(stack: list[Scope]) -> Scope:
        return next((s for s in reversed(stack) if s.rule in _FUNCTIONS), stack[0])

    def _target(self, stack: list[Scope], p: int, end: int) -> bool:
        """Whether the break or continue at p has something to leave."""
        K, c = self.K, self.c
        label = self.word(p + 1) if end > p + 1 and K[p + 1] in self.ids and not self.toks.breaks[p + 1] else ""
        for s in reversed(stack):
            if s.rule in _FUNCTIONS:
                return False
            if label:
                if s.rule == "labelled" and s.label == label:
                    return True
            elif s.rule in _LOOPS or s.rule == "switch_stmt" and K[p] == c["break"]:
                return True
        return False

    @staticmethod
    def _declare(stack: list[Scope], name: str, lexical: bool, function: bool = False) -> bool:
        """Declare a name where the scan stands; False if the scope has it in a way that excludes this one."""
        i = len(stack) - 1
        while stack[i].rule not in _SCOPES and stack[i].rule != "module":
            i -= 1
        s = stack[i]
        if lexical:
            above = stack[i - 1] if i else s
            if name in s.lexical or name in s.var or s.body and name in above.var or above.rule == "catch_part" and name in above.lexical:
                return False
            s.lexical.add(name)
            return True
        if function:
            if name in s.lexical:
                return False
            s.var.add(name)
            return True
        while True:
            s = stack[i]
            if s.rule == "module" or s.rule in _SCOPES:
                if name in s.lexical and s.rule != "catch_part":
                    return False
                s.var.add(name)
                if s.rule == "module" or s.body or s.rule in _FUNCTIONS:
                    return True
            i -= 1


def first_early_error(toks, kinds: str, note: dict[int, dict[str, int]], code: dict[str, str], ids: set[str], identifier: re.Pattern) -> int | None:
    """Token of the first thing a module forbids there, or None."""
    return Early(toks, kinds, code, ids, identifier).first(note)

