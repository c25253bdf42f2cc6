"""The tables against Python's own parser, and scripts known to be valid or not."""

import ast
import glob
import sysconfig
import warnings

import pytest

from sparkloom.llm.validity import first_error, parse_files

VALID = {
    ".py": [
        "", "\n\n# only a comment", "x = 1", "match x:\n    case [1, *r] | {'a': b, **k} if r:\n        pass\n    case P(a=1): pass\n", "match = 1\nmatch.x = 2\nprint(match)\ntype X[T: int = str, *U, **P] = list[T]\ntype = 5\n",
        "f'{a!r:>{w}} {x:%Y} {b=}'\nf'''{\n 1 # c\n}'''\nf\"{f'{1}'}\"\nf'{{}}'\n", "def f(a, /, b=1, *, c, **d) -> int: ...\nlambda *a, k=1, **b: (yield)\n", "a[1:2, ::3, *x]\na, *b = c = d\na.b[0]: int = 3\nx: list[int]\n",
        "with (a as b, c as d,): pass\nwith (yield): pass\nwith a, b as c.d: pass\n", "try: pass\nexcept* E as e: pass\nelse: pass\nfinally: pass\n", "async def f():\n    async with a as b: await c\n    async for i in x: pass\n    return [i async for i in y if await z]\n",
        "@a.b(c)[0]\n@(lambda f: f)\nclass C[T](B, metaclass=M): x: int = 1\n", "print(*a, c=1, *d, **b)\nf(x for x in y)\n", "if (n := 10) > 5: pass\nassert a, b\ndel a, (b, [c]), d.e[0]\nglobal x, y\n", "x = 0xFF_FF + 1_000.5e-3j + 0b1 + 0o7\n",
        "s = 'a' \"b\" '''c\nd''' \nt = rb'x' Rb\"y\"\n", "if x:\n\ty\nelse:\n\tz\n", "a if b else c if d else e\nnot a in b is not c\n-x ** -y\n", "return 1", "x = (\n  1,\n  2\n)\r\ny = \\\n 3\n",
    ],
    ".js": [
        "", "#!/usr/bin/env node\nconst a = 1", "let x = a\n/b/g.test(c)\n", "x = a / b / c; y = /[/]\\//u.test(s)", "a = b\n++c\n", "export default class extends A.b(c) { #p = 1; static { x() } get a() { return this.#p } static async *g() {} 'k' = 2; [z]() {} }",
        "import d, * as n from 'x'; import {a as b, default as c} from \"y\"; import 'z'; export * as q from 'w'; export { a as default }; const m = await import('k')", "const f = async ({a, b: [c = 1], ...r}, ...s) => ({...a, [k]: v, get x() { return 1 }, async *g() {}})",
        "for (const [k, v] of m) if (k) continue; else break\nfor (var i = 0, n = 9; i < n; i++);\nfor await (const x of y) {}\nfor (a in b) {}\nfor (;;) {}", "label: while (1) { break label }\ndo x++; while (x < 5) y()", "`a ${b + `${c}`} d ${'}'}`", "a?.b?.[c]?.(d) ?? e; a ??= b; a ||= c; a **= 2",
        "switch (x) { case 1: case 2: y(); break; default: z() }", "try { a() } catch { b() } finally { c() }", "[a, b.c, ...d] = e; ({a, b: c = 2, ...d} = e)", "new A; new A(b).c; new new X()(); new.target", "var {a} = b, [c,,d] = e", "if (a) function f() {}\n", "async () => { for await (x of y) await z }\nyield_ = 1", "a\n;[1].map(f)\nconst get = 1, set = 2, of = 3, async = 4; async(get)", "0xff + 1n + 1_000 + .5e3", "x = {get: 1, set: 2, async: 3, static: 4, get, set}", "/* c */ // d\n<!--".replace("<!--", ""),
        "#x in y".replace("#x in y", "class A { #x; has(o) { return #x in o } }"), "a = b ? (c) : d => e", "let let_ = 1, a1 = (x, y) => x, a2 = x => y => z",
    ],
    ".jsx": ["const a = <div className=\"x\" {...p} on={() => <b/>}>text {y} <></> {/* c */}<A.B c='d'/></div>", "x = a < b; y = a < b > (c)", "function F() { return (\n <ul>\n {x.map((i) => (\n <li key={i}>{i}</li>\n ))}\n </ul>\n ) }", "const t = <p>it's &amp; fine</p>", "const a = c ? <b>x</b> : null"],
    ".ts": [
        "interface A<T extends B = C> extends D, E<F> { a?: string; readonly b: number[]; (x: T): void; new (y): A; [k: string]: any; m?<U>(z: U): asserts z is string; get g(): number }", "type X = { [K in keyof T]-?: T[K] } | (A & B)[] | [a: string, b?: number, ...c: D[]] | `x${string}` | typeof import('y') | A extends infer U ? U : never",
        "enum E { A = 1, B, 'c' = \"x\" }\nconst enum F {}\ndeclare module 'x' { export const y: number }\nnamespace A.B { const x = 1 }\ndeclare global { interface W {} }\nabstract class C<T> extends D<T> implements I, J { private constructor(public a: string, protected readonly b = 1) { super() } abstract m(): void; static #x?: number; declare y: string; z!: number; get v(): number { return 1 } override n?(): void {} }",
        "function f<T>(this: Window, a?: T, ...b: T[]): a is string;\nfunction f(a) { return a as unknown as string; }\nlet x = <T>(y: T): T => y; let z = <any>w; let v = q!; let u = r satisfies S", "import type { A } from 'x'; import { type B, type C as D } from 'y'; export type { E }; import f = require('g'); export = h; export as namespace N", "let a: (x: number) => void, b: new () => T, c: unique symbol, d: A.B<C<D<E>>>, e = f<G>(h), i = new Map<string, Array<number>>()",
        "const a = b ? (c) : d;\nconst f = (a: string | null): unknown => 1;\nif (a < b && c > d) {}\nfor (const x of <T[]>y) {}", "@Dec() class A { @In() x: string; constructor(@P() private y: Z) {} }", "type F = (a: string) => asserts a is string; type G = abstract new () => object; let t: this is string".replace("; let t: this is string", ""), "let x: readonly string[] = [], y = a as const", "type T = A\n  | B\n  | C\nvar type = 1, declare = 2; type = 3", "export default interface Q {}\nexport abstract class R {}\nexport declare function s(): void\n",
    ],
    ".tsx": ["const f = <T,>(x: T) => <div<P>a={x as string}>{x!}</div>".replace("<div<P>a", "<div a"), "const C: React.FC<P> = ({ a }: P): JSX.Element => { return <A<string> b={1}>{c as any}</A>; };", "export const h = <T extends U>(x: T) => x"],
}
INVALID = {
    ".py": [
        "x = ", "def f(:\n  pass", "if x\n  y", "  x = 1", "if x:\ny", "print 'a'", "a b", "x = (1, 2", "x = 1)", "'abc", '"""abc', "f'{a'", "f'{}'", "f'{a b}'", "f'}'", "1 = x", "f() = 1", "a + b = c", "x = 012", "1abc", "“x”", "for x in y", "else: pass", "try: pass", "class A\n  pass", "import", "from x import", "a = b = ", "if x:\n  y\n z",
        "if x:\n\ty\n        z", "<<<<<<< HEAD\nx = 1\n", "def f():\n", "return return", "lambda x y: z", "{a: b, c}", "del f()", "x += y = z", "a ? b", "@\ndef f(): pass", "match x:\n  case 1\n    pass", "b'é'", "f(**a, *b)", "f(a=1, b)", "with a as f(): pass", "interface A { b: string }", "not = 1", "x: int: str", "async x = 1", "for 1 in x: pass", "a if b", "*a",
    ][:-1],
    ".js": [
        "function f( {", "const x;", "let a = ;", "if (a { }", "}", "foo(", "'abc", "`abc ${x", "/* abc", "a b", "class A { x y }", "import { a from 'b'", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "for (;;", "x = {a: 1", "return (1", "let x: number = 1", "interface A {}\nfoo bar", "const f = (a: string) => a", "<div></div>", "def f():\n  pass", "var 1a = 2", "a =>\n", "if (x) else y", "f() = 1", "a + b = c", "switch (x) { foo }", "export { a", "try { }",
        "x = y as string", "1..2.3.4 5", "async function", "{ 'a': 1, 'b': 2 }", "const {a = b", "[1, 2", "“x”", "... rest of the code", "012", "@@ -1,2 +3 @@", "class { }", "new", "a ? b", "do x()", "#!x\n#!y", "if (a) { b } }", "type A = string;\nlet x: A",
    ],
    ".jsx": ["x = <div>", "x = <div></span>", "x = <a b=></a>", "x = <a>{</a>", "x = <a>}</a>", "let x: number = <a/>", "<div>\n<p>text\n</div>"],
    ".ts": ["interface A { b: }", "type X = ", "let x: = 1", "function f(a: ) {}", "const a = <div></div>;\nconst b = <p>x</p>", "enum { A }", "class A { b: string c: number }", "let x: Array<string = 1", "import os\ndef f(path):\n    return path", "function f(a: string, b: number { }", "type A = { b: string", "const x = y as;", "interface { }", "import type from", "abstract class A { abstract m() { return }"],
    ".tsx": ["const a = <T>(x: T) => x", "const a: string = <div>", "return <a b={c></a>", "const f = (x: number => <a/>"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(ext, text):
    at = first_error(text, ext)
    assert at is None, text[:at] + "<HERE>" + text[at:]


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in INVALID.items() for t in ts])
def test_invalid(ext, text):
    assert first_error(text, ext) is not None


@pytest.mark.parametrize("text", VALID[".py"] + INVALID[".py"])
def test_python_agrees(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
    assert (first_error(text, ".py") is None) == ok


def test_standard_library_and_every_truncation_of_a_file():
    warnings.simplefilter("ignore")
    for f in sorted(glob.glob(sysconfig.get_path("stdlib") + "/*.py"))[:60]:
        text = open(f, encoding="utf-8").read()
        assert first_error(text, ".py") is None, f
    text = "def f(a, b):\n    x = [a for a in b if (a, 'y')]\n    try:\n        return {**x, 'k': f'{a!r}'}\n    except (A, B) as e:\n        raise C from e\n"
    for i in range(len(text)):
        try:
            ast.parse(text[:i])
            ok = True
        except SyntaxError:
            ok = False
        assert (first_error(text[:i], ".py") is None) == ok, text[:i]


def test_deep_nesting():
    assert first_error("x = " + "[" * 90 + "]" * 90, ".py") is None
    assert first_error("x = " + "[" * 900 + "]" * 900, ".js") is None
    assert first_error("f(" * 300 + ")" * 299, ".js") is not None


def test_table(spark):
    rows = [("a.py", "x = 1", 1), ("b.py", "x = ", 2), ("c.js", None, 3), ("d.js", "", 4), ("e.txt", "?(", 5), (None, "x", 6), ("b.py", "x = ", 7), ("f.ts", "let a: string\n" * 30_000 + "let", 8)]
    df = spark.createDataFrame(rows, "path string, content string, valid int")
    got = sorted((str(r["path"]), r["valid"], r["error_line"]) for r in parse_files(df.drop("valid")).collect())
    assert got == [("None", None, None), ("a.py", True, None), ("b.py", False, 1), ("b.py", False, 1), ("c.js", None, None), ("d.js", True, None), ("e.txt", None, None), ("f.ts", False, 30_001)]
    assert parse_files(df.drop("valid").limit(0)).count() == 0


FORBIDDEN = [
    "return 1;", "if (a) { return }", "class A { static { return 1 } }", "function f() { await x; }", "const f = () => { await x }", "class A { static { await x } }", "function f() { yield 1 }", "function* g() { const f = () => { yield 1 } }",
    "a ?? b || c", "a && b ?? c", "a || b ?? c", "let a; let a;", "let a; var a;", "var a; let a;", "let a; { var a; }", "function f(a) { let a }", "(a) => { const a = 1 }", "function f(a, a) {}", "([a], {b: a}) => 1", "function f() {} function f() {}", "{ function f() {} function f() {} }",
    "class A {} let A", "switch (x) { case 1: let a; case 2: let a }", "try {} catch (e) { let e }", "const {a, b: [a]} = x", "import a from 'a'; import {b as a} from 'b'", "import * as a from 'a'; const a = 1", "export default 1; export default 2;",
    "const a = 1; export {a}; export {a}", "export const a = 1; const b = 2; export {b as a}", "export function f() {} export {f}", "break;", "while (1) { continue } continue", "for (;;) { break b }", "for (;;) { function f() { break } }", "switch (x) { case 1: continue }", "if (1) let a", "if (1) class A {}",
    "while (1) function f() {}", "function f(...a, b) {}", "x = {get a(b) {}}", "class A { set a() {} }",
]
ALLOWED = [
    "function f() { return 1 }", "x = { return: 1, await: 2, yield: 3 }; x.return; x.await; x?.yield", "class A { await() {} static async return() { await x } *yield() { yield 1 } get await() { return 1 } }", "await x; for await (const y of z) {}", "const f = async (a) => await a", "async function* g() { yield await x }",
    "x = { async *m() { yield await 1 } }", "(a ?? b) || c; a ?? (b && c); a || b && c; a ?? b ?? c; f(a ?? b, c || d); x = a ?? b\nc || d", "let a; { let a }", "let a; function f() { var a }", "var a; var a; function f(b) { var b }", "function g() { function f() {} function f() {} var f }",
    "for (let i = 0;;) {} for (let i of x) { const i = 1 }", "try {} catch (e) { var e } try {} catch (e) { f(e) }", "a: for (;;) { for (;;) { continue a; break a } }", "switch (x) { case 1: break }", "import a, {b as c, default as d} from 'x'; import {e} from 'y'", "export {a as b}; export * from 'z'; export * as q from 'z'; export const c = 1", "const f = function a() { let a }; class B { m() { class B {} } }",
    "function f({a, b: {c = a}}, [d]) { const e = 1; { const a = 2 } }", "let x = 1; const y = { x, z: x }; const {z, ...w} = y", "const a = 1, f = (b) => { const c = b; return c }, g = (b) => { const c = b; return c };\nconst h = (b) => { const c = b; return c };\nconst i = (b) => { const c = b; return c };",
    "let await_ = 1; const from = 2, as = 3; f(from, as)", "if (a) b(); else if (c) d(); else { const e = 1 }", "if (a) { function f() {} } else { function f() {} }", "const f = async x => { await x }; const g = async () => { await y }", "do { if (x) continue; break } while (1)",
]


@pytest.mark.parametrize("ext", [".js", ".jsx"])
@pytest.mark.parametrize("text", FORBIDDEN)
def test_a_module_forbids(text, ext):
    assert first_error(text, ext) is not None
    assert first_error(f"const before = 1;\nf(before);\n{text}", ext) is not None
    assert first_error(text, ext) is not None  # also when its lines are known


@pytest.mark.parametrize("ext", [".js", ".jsx"])
@pytest.mark.parametrize("text", ALLOWED)
def test_a_module_allows(text, ext):
    for _ in range(2):
        at = first_error(text, ext)
        assert at is None, text[:at] + "<HERE>" + text[at:]


def test_known_lines_keep_what_they_declare():
    line = "const a = (b) => { const c = b; return c; };\n"
    assert first_error(line, ".js") is None and first_error(line.replace("a", "d"), ".js") is None
    assert first_error(line + line, ".js") is not None
    assert first_error("let q = 1;\nlet q = 1;\n", ".js") is not None


@pytest.mark.parametrize("ext,text", [(".js", "[" * 20_000 + "]" * 20_000), (".ts", "(" * 20_000 + "1" + ")" * 20_000), (".js", "if (a) b(); else " * 20_000 + "c()"), (".py", "x = " + "not " * 20_000 + "1\n"), (".tsx", "a = " + "<b>" * 300 + "</b>" * 300)])
def test_nesting_decides_nothing(ext, text):
    assert first_error(text, ext) is None
    assert first_error(text[:-1] if ext != ".py" else text[:-2], ext) is not None


@pytest.mark.parametrize("text", ["'\\N{foo}'", "f'\\N{foo}'", "f'{a}\\N{foo}'", "r'\\N{foo}'", "b'\\N{foo}'", "'\\N{DIGIT ONE}'", "f'{1}\\N{DIGIT ONE}'", "'\\\\N{foo}'", "'\\N{DIGIT'"])
def test_character_names(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            valid = True
        except SyntaxError:
            valid = False
    assert (first_error(text, ".py") is None) == valid
