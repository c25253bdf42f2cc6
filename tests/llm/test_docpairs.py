import pytest

from sparkloom.llm.docpairs import bare, comment_pairs, informative, pairs, python_docstring, said

SAYS = [
    ("Return every open batch whose count is below the limit.", "x"), ("Blocks until the queue drains.", "wait_queue"), ("/** Splits the gauge by label. */", "split"), ("@param folder the trusted sensor to start from", "f"), ("TODO: add more\nMoves files.", "f"), ("清空所有过期的记录。", "f"),
    (":param x: the limit in seconds", "f"), ("Liest den Wert neu ein.", "read"), ("r'''Keeps order.'''", "f"), ("Args:\n    x: how many rows to skip", "f"), ("Order is kept.", "sort"),
]
NOTHING = [
    (None, "x"), ("", "x"), ("  \n ", "x"), ("TODO", "x"), ("todo(later): add description", "x"), ("-----", "x"), ("N/A", "x"), ("see code", "x"), ("[description]", "x"), ("_summary_\n\nArgs:\n    a (_type_): _description_", "x"), ("Docstring for load_file", "load_file"), ("Load file.", "loadFile"),
    ("This function loads the file", "load_file"), ("Helper for load file", "load_file"), ("LOAD_FILE", "load_file"), ("load_file - load file", "load_file"), ("/** loadFile */", "loadFile"), ("/**\n * @param {string} a\n * @returns {void}\n */", "x"), ("Args:\n    batch:\n\nReturns:\n", "x"), ("<p></p>", "x"), ("???", "x"),
    ("Implements loadFile()", "loadFile"), ("lorem ipsum", "x"), ("FIXME write docs", "x"), ("'''Function x'''", "x"), (":param a:\n:type a: int\n:returns:", "x"), ("@returns {boolean}", "x"),
]


@pytest.mark.parametrize("doc,name", SAYS)
def test_informative(doc, name):
    assert informative(doc, name)


@pytest.mark.parametrize("doc,name", NOTHING)
def test_says_nothing(doc, name):
    assert not informative(doc, name), said(doc)


def test_marks_are_taken_off():
    assert bare('r"""A.\n    B."""') == ["A.", "B."] and [x for x in bare("/**\n * A.\n * B.\n */") if x] == ["A.", "B."]


@pytest.mark.parametrize(
    "code,doc",
    [
        ('def f(a: str = "):", b=(1, [2])) -> dict[str, "x:"]:\n    """D."""\n', '"""D."""'), ("    async def f(self):  # note\n\n        # c\n        r'''D\n        e'''\n        pass", "r'''D\n        e'''"), ("@deco(a, b)\n@x\ndef f(): 'D'", "'D'"), ("class A[T](B):\n    'D'\n", "'D'"), ("def f[T](x: T):\n    'D'", "'D'"),
        ("def f():\n    x = 'no'\n", None), ("def f():\n    f'no'\n", None), ("def f():\n    b'no'\n", None), ("x = 1", None), ("", None), ("def f(", None),
    ],
)
def test_python_docstrings(code, doc):
    got = python_docstring(code)
    assert (got and got[0]) == doc
    assert not got or code[got[1] : got[2]] == doc


def test_comment_pairs():
    text = "/** A. */\nfunction a() {}\nconst s = '/** no */';\n/** gap */\n\nfunction b() {}\n  /**\n   * C.\n   */\r\n  c() { return `/** ${x} */` }\n// /** no */\nlet r = /[/*]/ /** tail */\n/* plain */\nfunction d() {}\n/** unclosed"
    assert [(n, c) for n, c, *_ in comment_pairs(text)] == [(2, "/** A. */"), (5, "/** gap */"), (10, "/**\n   * C.\n   */"), (13, "/** tail */")]
    for _, c, a, b, _ in comment_pairs(text):
        assert text[a:b] == c


def test_tables(spark):
    ents = "qualified_name string, name string, type string, file_path string, signature string, docstring string, code string, start_line int, indexed_at timestamp_ntz, comment string"
    rows = [
        ("m.a", "a", "function", "/a.py", "def a()", "Moves the files over.", "def a(): pass", 1, None, "x"), ("m.b", "b", "method", "/a.py", None, None, "def b(self):\n    'Keeps the order.'", 3, None, "x"), ("m.c", "c", "class", "/a.py", None, "Says a lot of things.", "class C: pass", 5, None, "x"),
        ("m.d", "d", "function", "/b.ts", None, "", "function d() {}", 2, None, "x"), ("m.e", "e", "function", "/b.ts", None, None, "function e() {}", 3, None, "x"), ("m.f", "f", "function", "/b.ts", None, "   ", "function f() {}", 2, None, "x"), ("m.a", "a", "function", "/a.py", "def a()", "Moves the files over.", "def a(): pass", 1, None, "x"),
        ("m.g", None, "function", None, None, None, None, None, None, "x"), (None, "h", "function", "/a.py", None, "Lost without a key.", "", 1, None, "x"),
    ]
    files = spark.createDataFrame([("/b.ts", "/** Opens the gate. */\nfunction d() {}\nfunction e() {}\n", None), ("/b.ts", "/** Opens the gate. */\nfunction d() {}\nfunction e() {}\n", None), ("/c.ts", None, None)], "path string, content string, indexed_at timestamp_ntz")
    got = {r["qualified_name"]: (r["doc"], r["doc_source"]) for r in pairs(spark.createDataFrame(rows, ents).drop("comment"), files).collect()}
    assert got == {"m.a": ("Moves the files over.", "docstring"), "m.b": ("Keeps the order.", "code"), "m.d": ("Opens the gate.", "comment")}
    assert pairs(spark.createDataFrame([], ents).drop("comment"), files.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line,name",
    [
        ("export default async function* go<T>(a) {", "go"), ("function a() {}", "a"), ("  static async put(z: string): Promise<void> {", "put"), ("const f = (a, b = (1)) => a;", "f"), ("export const g = async x => x", "g"), ("let h = function () {}", "h"), ("const k: (a: string) => void = <T,>(a: T): void => {};", "k"),
        ("  get size() { return 1; }", "size"), ("  #own() {}", "#own"), ("  private readonly list?<A extends B<C>>(a: A): void;", "list"), ("class A {", None), ("interface B {", None), ("const n = 5;", None), ("if (a) {", None), ("return go(1);", None), ("@Input()", None), ("  name: string;", None),
    ],
)
def test_functions_under_comments(line, name):
    text = f"const s = 1;\n/** Doc. */\n{line}\nrest()"
    assert comment_pairs(text) == [(3, "/** Doc. */", 13, 24, name)]


def test_pairs_keep_the_places(spark):
    ents = "qualified_name string, name string, type string, file_path string, signature string, docstring string, code string, start_line int, indexed_at timestamp_ntz"
    script = "let a = 1;\n/** Opens the gate. */\nexport function other() {}\n"
    rows = [("m.a", "a", "function", "/a.py", "", "Moves the files over.", "def a():\n    'Moves the files over.'", 1, None), ("m.b", "b", "function", "/a.py", "", "Keeps order of rows.", "def b(): pass", 1, None), ("m.c", "c", "function", "/c.ts", "", None, "function c() {}", 3, None)]
    got = {r["name"]: r for r in pairs(spark.createDataFrame(rows, ents), spark.createDataFrame([("/c.ts", script, None)], "path string, content string, indexed_at timestamp_ntz")).collect()}
    assert rows[0][6][got["a"]["doc_start"] : got["a"]["doc_end"]] == "'Moves the files over.'" and got["a"]["declared"] == "a"
    assert got["b"]["doc_start"] is None and got["b"]["declared"] is None
    assert script[got["c"]["doc_start"] : got["c"]["doc_end"]] == "/** Opens the gate. */" and got["c"]["declared"] == "other"
