"""Bundled grammars compiled into parse tables and run over whole token streams.

A grammar is text: ``rule = alternatives`` with ``|`` (ordered), sequences, ``?``, ``*``, ``+``, ``( )``, quoted tokens,
upper-case token classes, ``&x`` / ``!x`` (look ahead) and ``@name`` (a test or step of the lexer).  Compilation works out
which tokens may begin each alternative.  The result is a table per choice, from the next token to the alternatives
worth trying, mostly one; where several remain they are tried in order, and rules marked ``~`` keep their outcome by
place, so each is tried once at a place.  A token is one character of a string, which makes a look-up a dictionary
access and any stretch of tokens a string that can itself be looked up.
"""

from __future__ import annotations

import re
import sys

EOF = "\x00"
#: Rules that may be open at once for each token of a text.
FRAMES_A_TOKEN = 64
_LEX = re.compile(r"\s*(?:([A-Za-z_]\w*~?)|('(?:[^'\\]|\\.)+')|(@\w+)|([=|?*+()&!;]))|\s*#[^\n]*")


class Grammar:
    def __init__(self, text: str, classes: dict[str, set[str]], code: dict[str, str], first: dict[str, set[str] | None]):
        """``classes``: token classes by name; ``code``: token spelling to its character; ``first``: tokens on which an
        ``@`` step may succeed (None: any, and it may take no token)."""
        self.classes, self.code, self.at_first = classes, code, first
        self.rules: dict[str, tuple] = {}
        self.memo: set[str] = set()
        self._read(text)
        self._solve()

    # -- grammar text to trees -------------------------------------------------------------------------------------
    def _read(self, text: str) -> None:
        toks: list[tuple[str, str]] = []
        pos = 0
        text = text.rstrip()
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m or m.end() == pos:
                raise ValueError(f"grammar at {text[pos:pos + 40]!r}")
            pos = m.end()
            for kind, v in zip(("name", "lit", "at", "op"), m.groups()):
                if v:
                    toks.append((kind, v))
        i = 0

        def peek(k: int = 0) -> tuple[str, str]:
            return toks[i + k] if i + k < len(toks) else ("", "")

        def alt() -> tuple:
            nonlocal i
            got = [seq()]
            while peek() == ("op", "|"):
                i += 1
                got.append(seq())
            return got[0] if len(got) == 1 else ("alt", got)

        def seq() -> tuple:
            got = []
            while peek()[0] in ("name", "lit", "at") or peek()[1] in ("(", "&", "!"):
                if peek()[0] == "name" and peek(1) == ("op", "="):
                    break
                got.append(post())
            return got[0] if len(got) == 1 else ("seq", got)

        def post() -> tuple:
            nonlocal i
            if peek()[1] in ("&", "!") and peek()[0] == "op":
                op = peek()[1]
                i += 1
                return ("and" if op == "&" else "not", post())
            kind, v = peek()
            i += 1
            if v == "(":
                x = alt()
                assert peek()[1] == ")", toks[i - 3 : i + 3]
                i += 1
            elif kind == "lit":
                x = ("tok", frozenset(self.code[w] for w in [v[1:-1].replace("\\'", "'")]))
            elif kind == "at":
                x = ("step", v[1:])
            elif v in self.classes:
                x = ("tok", frozenset(self.classes[v]))
            else:
                x = ("rule", v)
            while peek()[0] == "op" and peek()[1] in "?*+":
                x = ({"?": "opt", "*": "star", "+": "plus"}[peek()[1]], x)
                i += 1
            return x

        while i < len(toks):
            name = toks[i][1]
            assert toks[i + 1][1] == "=", toks[i : i + 3]
            i += 2
            if name.endswith("~"):
                name = name[:-1]
                self.memo.add(name)
            self.rules[name] = alt()

    # -- which tokens may begin what -------------------------------------------------------------------------------
    def _solve(self) -> None:
        self.first: dict[str, set[str]] = {r: set() for r in self.rules}
        self.empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        self.open: dict[str, bool] = dict.fromkeys(self.rules, False)  # may begin with a step on any token
        changed = True
        while changed:
            changed = False
            for r, x in self.rules.items():
                f, e, o = self.begin(x)
                if f - self.first[r] or e != self.empty[r] or o != self.open[r]:
                    self.first[r] |= f
                    self.empty[r], self.open[r] = e, o
                    changed = True

    def begin(self, x: tuple) -> tuple[set[str], bool, bool]:
        kind = x[0]
        if kind == "tok":
            return set(x[1]), False, False
        if kind == "rule":
            return self.first[x[1]], self.empty[x[1]], self.open[x[1]]
        if kind == "step":
            f = self.at_first[x[1]]
            return (set(), True, True) if f is None else (set(f), False, False)
        if kind in ("and", "not"):
            return set(), True, False
        if kind in ("opt", "star"):
            f, _, o = self.begin(x[1])
            return f, True, o
        if kind == "plus":
            return self.begin(x[1])
        if kind == "alt":
            parts = [self.begin(y) for y in x[1]]
            return set().union(*[p[0] for p in parts]), any(p[1] for p in parts), any(p[2] for p in parts)
        f, o = set(), False
        for y in x[1]:
            a, e, b = self.begin(y)
            f = f | a
            o = o or b
            if not e:
                return f, False, o
        return f, True, o

    # -- trees to the functions that consult the tables ------------------------------------------------------------
    def compile(self, start: str, skip: dict[str, set[str]] | None = None, marks: tuple[str, ...] = ()):
        """A parser for the rule ``start``.

        ``skip`` names rules which, met at the start of a line whose tokens are among the known lines, take the line,
        unless one of the given tokens comes next, which could belong to it.  Of the rules in ``marks`` it is noted
        where they begin and end; a line taken as known brings the notes it was first read with.
        """
        lines: list[str] = []
        tables: dict[str, object] = {}
        count = 0
        every = frozenset(self.code.values()) | frozenset().union(*self.classes.values())

        def const(v: object) -> str:
            for k, w in tables.items():
                if type(w) is type(v) and w == v:
                    return k
            tables[f"T{len(tables)}"] = v
            return f"T{len(tables) - 1}"

        def test(chars: frozenset) -> str:
            return f"K[p] == {next(iter(chars))!r}" if len(chars) == 1 else f"K[p] in {const(frozenset(chars))}"

        def fn(x: tuple) -> str:
            nonlocal count
            if x[0] == "rule":
                return f"r_{x[1]}"
            if x[0] == "step":
                return f"s_{x[1]}"
            name = f"f_{count}"
            count += 1
            define(name, x)
            return name

        def define(name: str, x: tuple) -> None:
            body: list[str] = []
            emit(x, body, "    ")
            lines.append(f"def {name}(p):")
            lines.extend(body)
            lines.append("    return p")

        def fail(pad: str) -> list[str]:
            return [f"{pad}if p > far[0]: far[0] = p", f"{pad}return -1"]

        def emit(x: tuple, out: list[str], pad: str) -> None:
            kind = x[0]
            if kind == "tok":
                out.append(f"{pad}if {test(x[1])}: p += 1")
                out.append(f"{pad}else:")
                out.extend(fail(pad + "    "))
            elif kind in ("rule", "step"):
                out.append(f"{pad}p = {fn(x)}(p)")
                out.append(f"{pad}if p < 0: return -1")
            elif kind == "seq":
                for y in x[1]:
                    emit(y, out, pad)
            elif kind == "and":
                out.append(f"{pad}if {fn(x[1])}(p) < 0: return -1")
            elif kind == "not":
                if x[1][0] == "tok":
                    out.append(f"{pad}if {test(x[1][1])}:")
                    out.extend(fail(pad + "    "))
                else:
                    out.append(f"{pad}if {fn(x[1])}(p) >= 0: return -1")
            elif kind in ("opt", "star", "plus"):
                if kind == "plus":
                    emit(x[1], out, pad)
                f, e, o = self.begin(x[1])
                if x[1][0] == "tok":
                    out.append(f"{pad}{'if' if kind == 'opt' else 'while'} {test(x[1][1])}: p += 1")
                    return
                guard = "True" if o or e else test(frozenset(f))
                out.append(f"{pad}{'if' if kind == 'opt' else 'while'} {guard}:")
                out.append(f"{pad}    q = {fn(x[1])}(p)")
                if kind == "opt":
                    out.append(f"{pad}    if q >= 0: p = q")
                else:
                    out.append(f"{pad}    if q <= p: break")
                    out.append(f"{pad}    p = q")
            elif kind == "alt":
                begins = [self.begin(y) for y in x[1]]
                fns = [None if y[0] == "tok" else fn(y) for y in x[1]]
                table: dict[str, list[str]] = {}
                default = [n if n else None for n, (f, e, o) in zip(fns, begins) if e or o]
                for c in every | {EOF}:
                    row = [fns[i] or "take" for i, (f, e, o) in enumerate(begins) if c in f or e or o]
                    if row != default:
                        table[c] = row
                t = f"A{len(tables)}"
                tables[t] = table
                d = "(" + "".join(f"{n}," for n in default) + ")"
                out.append(f"{pad}for f in {t}.get(K[p], {d}):")
                out.append(f"{pad}    q = f(p)")
                out.append(f"{pad}    if q >= 0: break")
                out.append(f"{pad}else:")
                out.extend(fail(pad + "    "))
                out.append(f"{pad}p = q")

        for r, x in self.rules.items():
            if r in marks:
                define(f"u_{r}", x)
                inner = [f"q = u_{r}(p)", f"if q >= 0: note.setdefault(p, {{}})[{r!r}] = q"]
            if r in self.memo:
                define(f"m_{r}", x)
                lines += [f"M_{r} = {{}}", f"def r_{r}(p):", f"    q = M_{r}.get(p)", f"    if q is None: q = M_{r}[p] = m_{r}(p)", "    return q"]
            elif skip and r in skip:
                define(f"m_{r}", x)
                lines += [f"def r_{r}(p):", "    e = ends[p]", f"    if e and K[e] not in {const(frozenset(skip[r]))} and K[p:e] in known:"]
                lines += ["        for i, d in known[K[p:e]]: note[p + i] = {r: p + q for r, q in d}", "        return e"] if marks else ["        return e"]
                lines += [f"    q = m_{r}(p)", f"    if q == e and q > p: known[K[p:e]] = {'seen(p, e)' if marks else '()'}", "    return q"]
            elif r in marks:
                lines += [f"def r_{r}(p):", *[f"    {y}" for y in inner], "    return q"]
            else:
                define(f"r_{r}", x)
        src = ["K, NL, ends, known, far, note = '', (), (), {}, [0], {}", "def take(p): return p + 1"]
        src += ["def seen(p, e): return tuple((i - p, tuple((r, q - p) for r, q in note[i].items())) for i in range(p, e) if i in note)", *lines]
        env: dict[str, object] = {t: v for t, v in tables.items() if t[0] != "A"}
        exec(compile("\n".join(src), f"<tables of {start}>", "exec"), env)  # noqa: S102 - code made from the bundled grammar alone
        for t, v in tables.items():
            if t[0] == "A":
                env[t] = {c: tuple(env.get(f) or _late(env, f) for f in row) for c, row in v.items()}
        return Parser(env, start, [f"M_{r}" for r in self.memo], list(self.at_first))


def _late(env: dict, name: str):
    """A step of the lexer, which is bound anew for each text."""
    return lambda p: env[name](p)


class Parser:
    """The compiled tables; runs over one token string at a time."""

    def __init__(self, env: dict, start: str, memos: list[str], steps: list[str]):
        self.env, self.start, self.memos, self.steps = env, env[f"r_{start}"], [env[m] for m in memos], steps

    def run(self, kinds: str, ends: list[int], known: dict[str, tuple], breaks: list[bool] = (), make_step=None) -> tuple[int, int, dict[int, dict[str, int]]]:
        """(place reached or -1, furthest place at which a token did not fit, ends of the noted rules by place).

        The recursion is one of Python functions alone, whose frames lie on the heap, so its depth may grow with the
        text; nesting never decides a verdict.
        """
        far, note = [0], {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), min(FRAMES_A_TOKEN * len(kinds) + 10_000, 2**31 - 1)))
        self.env.update(K=kinds, NL=breaks, ends=ends, known=known, far=far, note=note, **{f"s_{s}": make_step(s, kinds, breaks) for s in self.steps})
        for m in self.memos:
            m.clear()
        return self.start(0), far[0], note
