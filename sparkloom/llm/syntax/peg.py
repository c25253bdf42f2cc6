"""Packrat parsing-expression grammars over text, with offsets and semantic actions.

Grammar text: ``rule <- expression``; ``/`` ordered choice, sequences, ``? * +``, ``& !``, ``( )``, ``~"regex"`` a terminal,
``name:rule`` a capture (its start and end), ``{action}`` at the end of an alternative.  An action gets the captures of
its alternative by name and emits whatever it returns.  Each rule keeps its outcome by place, so parsing is linear in
the text; what was kept is dropped behind each item of the start rule's repetition.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_LEX = re.compile(r"""\s*(?:(~"(?:[^"\\]|\\.)*")|(\{\w+\})|(\w+)\s*(<-)|(\w+):(?=[\w(~])|(\w+)|([/?*+()&!]))""")


class Peg:
    def __init__(self, text: str, actions: dict[str, Callable]):
        self.actions = actions
        self.rules: dict[str, Callable] = {}
        self._toks = []
        pos, text = 0, text.strip()
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m:
                raise ValueError(f"grammar at {text[pos:pos + 40]!r}")
            pos = m.end()
            kind = ("rx", "act", "def", "", "cap", "name", "op")[m.lastindex - 1] if m.group(4) is None else "def"
            self._toks.append((kind, m.group(3) if kind == "def" else m.group(m.lastindex)))
        self._i = 0
        while self._i < len(self._toks):
            name = self._toks[self._i][1]
            self._i += 1
            self.rules[name] = self._memo(name, self._choice())

    def _peek(self) -> tuple[str, str]:
        return self._toks[self._i] if self._i < len(self._toks) else ("end", "")

    def _memo(self, name: str, body: Callable) -> Callable:
        def rule(s, p, caps, memo, out):
            key = (name, p)
            if key not in memo:
                memo[key] = body(s, p, {}, memo, out)
            return memo[key]

        return rule

    def _choice(self) -> Callable:
        alts = [self._sequence()]
        while self._peek() == ("op", "/"):
            self._i += 1
            alts.append(self._sequence())
        if len(alts) == 1:
            return alts[0]

        def choice(s, p, caps, memo, out):
            for a in alts:
                q = a(s, p, caps, memo, out)
                if q is not None:
                    return q
            return None

        return choice

    def _sequence(self) -> Callable:
        parts, act = [], None
        while self._peek()[0] in ("rx", "name", "cap") or self._peek() in (("op", "("), ("op", "&"), ("op", "!")):
            parts.append(self._suffix())
        if self._peek()[0] == "act":
            act = self.actions[self._peek()[1][1:-1]]
            self._i += 1
        if len(parts) == 1 and act is None:
            return parts[0]

        def sequence(s, p, caps, memo, out):
            mine = {} if act else caps
            for x in parts:
                p = x(s, p, mine, memo, out)
                if p is None:
                    return None
            if act:
                out.append(act(s, mine))
            return p

        return sequence

    def _suffix(self) -> Callable:
        kind, v = self._peek()
        self._i += 1
        if kind == "cap":
            inner = self._suffix()

            def capture(s, p, caps, memo, out):
                q = inner(s, p, caps, memo, out)
                if q is not None:
                    caps[v] = (p, q)
                return q

            return capture
        if v in "&!" and kind == "op":
            ahead = self._suffix()
            wanted = v == "&"
            return lambda s, p, caps, memo, out: p if (ahead(s, p, caps, memo, []) is not None) == wanted else None
        if v == "(" and kind == "op":
            x = self._choice()
            self._i += 1
        elif kind == "rx":
            match = re.compile(v[2:-1].replace('\\"', '"')).match

            def x(s, p, caps, memo, out):
                m = match(s, p)
                return m.end() if m else None

        else:
            x = lambda s, p, caps, memo, out: self.rules[v](s, p, caps, memo, out)
        kind, op = self._peek()
        if kind == "op" and op in "?*+":
            self._i += 1
            one = x

            def x(s, p, caps, memo, out):
                q = one(s, p, caps, memo, out)
                if q is None:
                    return None if op == "+" else p
                while op != "?" and q is not None and q > p:
                    p = q
                    q = one(s, p, caps, memo, out)
                return p if q is None else q

        return x

    def items(self, text: str, rule: str) -> list:
        """What the actions emit while ``rule`` is matched again and again from the start of the text to its end."""
        out: list = []
        step, pos, n = self.rules[rule], 0, len(text)
        while pos < n:
            got = step(text, pos, {}, {}, out)
            pos = got if got is not None and got > pos else pos + 1
        return out
