"""Attribute files, patterns, heads, shapes and copies."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.origin import MINED_FILES, attribute_rules, declared, glob_regex, measures, origin, parsed_rules, path_keys, rule_key

SCHEMA = "path string, project_name string, relative_path string, content string, indexed_at timestamp_ntz, origin string"
BODY = "import os\n\ndef work(items):\n    total = 0\n    for item in items:\n        if item.size > 10:\n            total += item.size\n    return total\n\ndef other(a, b):\n    return os.path.join(a, b) or work([a])\n"


def files(spark, rows):
    return spark.createDataFrame([(f"/r/{p}/{r}", p, r, c, None, "clash") for p, r, c in rows], SCHEMA)


def found(spark, rows):
    return {r["relative_path"]: r["origin"] for r in origin(files(spark, rows)).collect()}


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("*.js", "a/b/c.js", True), ("*.js", "c.jsx", False), ("/gen/*.py", "gen/a.py", True), ("/gen/*.py", "x/gen/a.py", False), ("gen/**", "gen/a/b.py", True), ("**/gen/*.py", "x/y/gen/a.py", True), ("a?.py", "ab.py", True), ("a?.py", "a/.py", False), ("[a-c].py", "b.py", True), ("[!a-c].py", "b.py", False), ("a/**/z.py", "a/z.py", True), ("a/**/z.py", "a/b/c/z.py", True), (r"\#x.py", "#x.py", True)],
)
def test_globs(pattern, path, hit):
    assert bool(re.search(glob_regex(pattern), path)) == hit


def test_attribute_lines():
    got = attribute_rules("# c\n*.py text linguist-generated\n\"a b.py\" -linguist-vendored linguist-generated=false\nx !linguist-generated\ny other\n")
    assert [(n, a, v) for n, _, _, a, v in got] == [(1, "linguist-generated", True), (2, "linguist-vendored", False), (2, "linguist-generated", False), (3, "linguist-generated", None)]


def test_attribute_files_decide_and_deeper_ones_win(spark):
    got = found(spark, [
        ("a", ".gitattributes", "gen/*.py linguist-generated\nown/** linguist-vendored\n*.min.js -linguist-generated\n"), ("a", "gen/sub.py", BODY), ("a", "gen/x.py", BODY + "#1"), ("a", "own/k/y.py", BODY + "#2"), ("a", "own/k/z.py", BODY + "#3"),
        ("a", "own/k/.gitattributes", "z.py -linguist-vendored\n"), ("a", "node_modules/m/i.js", "export const a = 1;\n"), ("b", "node_modules/m/i.js", "export const b = 1;\n"), ("b", "gen/sub.py", BODY + "x = 1\n" * 9),
    ])
    assert got == {"gen/sub.py": "generated", "gen/x.py": "generated", "own/k/y.py": "vendored", "node_modules/m/i.js": "vendored"}


def test_kinds_without_attribute_files(spark):
    data = "TABLE = [\n" + "".join(f"    {i}, {i * 7}, {i * 13},\n" for i in range(200)) + "]\n"
    mini = "!function(e,t){" + "".join(f"if(e.a>{i})t.b=e.c+{i};" for i in range(100)) + "}(this,{});"
    got = found(spark, [
        ("p", "a/head.py", "# Code generated by tool v1.2. DO NOT EDIT.\n" + BODY), ("p", "a/doc.py", '"""@generated by x from y"""\n' + BODY + "#d"), ("p", "a/foot.py", BODY + "\n# <auto-generated> changes are lost on the next build"),
        ("p", "a/string.py", BODY + 'HEADER = "Code generated by tool v1.2. DO NOT EDIT."\n'), ("p", "a/talk.py", BODY + "# the files written by x carry a generated header; this module checks for it\n"), ("p", "a/data.py", data), ("p", "a/few.py", "A = [1, 2, 3]\nB = 'x'\n"),
        ("p", "a/mini.js", mini), ("p", "a/long.py", BODY + "X = '" + "word " * 200 + "'\n"), ("p", "vendor/lib/v.py", BODY + "def v(): return 1\n"), ("p", "src/vendors/own.py", BODY + "def mine(): return 2\n"), ("q", "src/copy.py", "# local head\n" + (BODY + "def v(): return 1\n").replace("\n", "\r\n")),
        ("p", "a/none.py", None), ("p", "a/empty.py", ""), ("p", "a/broken.py", "# Code generated by tool v1.2. DO NOT EDIT.\nx = (\n"),
    ])
    assert got == {"a/head.py": "generated", "a/doc.py": "generated", "a/foot.py": "generated", "a/data.py": "data", "a/mini.js": "minified", "vendor/lib/v.py": "vendored", "src/copy.py": "vendored", "a/broken.py": "generated"}


def test_broken_files_are_marked(spark):
    got = origin(files(spark, [("p", "a.py", "# @generated by x from y\nx = (\n"), ("p", "b.py", "# @generated by x from y\nx = 1\n")])).collect()
    assert {r["relative_path"]: r["valid"] for r in got} == {"a.py": False, "b.py": True}


def test_null_project_and_repeated_rows(spark):
    rows = [(None, "a.py", "# @generated by x from y\nx = 1\n")] * 3
    df = spark.createDataFrame([("/r/a.py", p, r, c, None, "k") for p, r, c in rows], SCHEMA)
    assert origin(df).count() == 1
    assert origin(df.limit(0)).count() == 0


def test_a_project_that_declares_only_text_settings_keeps_the_known_patterns(spark):
    rows = [("a", ".gitattributes", "* text=auto\n*.png binary\n"), ("a", "node_modules/m/i.js", "export const a = 1;\n"), ("a", "src/own.py", BODY)]
    assert found(spark, rows) == {"node_modules/m/i.js": "vendored"}


PATTERNS = ("*.js", "/gen/*.py", "gen/**", "**/gen/*.py", "a?.py", "[a-c].py", "a/**/z.py", "Makefile", "/top.ts", "x/Makefile", "*", "data*")
PATHS = ("a/b/c.js", "c.jsx", "gen/a.py", "x/gen/a.py", "gen/a/b.py", "ab.py", "b.py", "a/z.py", "a/b/c/z.py", "Makefile", "x/Makefile", "top.ts", "x/top.ts", "datafile", "k/data.bin")


def test_every_path_a_pattern_matches_has_its_key(spark):
    keys = {r[0]: set(r[1]) for r in spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", path_keys(F.col("p"))).collect()}
    for pattern in PATTERNS:
        for path in PATHS:
            if re.search(glob_regex(pattern), path):
                assert rule_key(pattern) in keys[path], (pattern, path)


def test_declared_equals_a_walk_over_all_rules(spark):
    import itertools

    texts = {".gitattributes": "*.py linguist-generated\ngen/** linguist-vendored\nk/*.py -linguist-generated\n", "k/.gitattributes": "z.py linguist-generated\n*.js linguist-generated\n/in/** linguist-vendored\n", "k/in/.gitattributes": "*.js !linguist-generated\nq.js linguist-vendored=false\n"}
    paths = [d + n for d, n in itertools.product(("", "gen/", "k/", "k/in/", "k/in/deep/", "x/k/"), ("z.py", "q.js", "a.py", "t.ts"))]
    files = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project_name string, relative_path string, content string")
    got = {r["relative_path"]: (r["generated"], r["vendored"]) for r in declared(parsed_rules(files), spark.createDataFrame([("p", q) for q in paths] + [("other", "z.py")], "project_name string, relative_path string")).collect()}
    want = {}
    for q in paths:
        best = {}
        for name, text in texts.items():
            d = name[: -len(".gitattributes")]
            if q.startswith(d):
                for n, rx, _, a, v in attribute_rules(text):
                    if re.search(rx, q[len(d) :]):
                        best[a] = max(best.get(a, ((-1, -1), None)), ((len(d), n), v), key=lambda t: t[0])
        if best:
            want[q] = tuple(best.get(f"linguist-{a}", (None, None))[1] for a in ("generated", "vendored"))
    assert {k: v for k, v in got.items() if v != (None, None)} == {k: v for k, v in want.items() if v != (None, None)}


def test_patterns_are_mined_from_declared_and_shown_files_and_applied_elsewhere(spark):
    rows = [("a", ".gitattributes", "out/** linguist-generated\n")]
    rows += [("a", f"out/f{i}.py", BODY + f"# {i}\n") for i in range(MINED_FILES)]
    rows += [(p, f"src/out/g{p}{i}.py", "# Code generated by x v1.2. DO NOT EDIT.\n" + BODY + f"# {p}{i}\n") for p in "bc" for i in range(20)]
    rows += [("d", "out/plain.py", BODY + "# nobody says so\n"), ("d", "outer/own.py", BODY + "# o\n"), ("e", ".gitattributes", "*.x linguist-generated\n"), ("e", "out/own.py", BODY + "# e\n")]
    rows += [(p, f"mixed/m{p}{i}.py", BODY + f"# {p}{i}m\n") for p in "bcd" for i in range(4)] + [("b", "mixed/gen.py", "# @generated by x\n" + BODY)]
    got = {(r["project_name"], r["relative_path"]): r["rule"] for r in origin(files(spark, rows)).collect()}
    assert got[("d", "out/plain.py")] == "mined pattern" and ("e", "out/own.py") not in got and ("d", "outer/own.py") not in got
    assert {k for k in got if k[1].startswith("mixed/")} == {("b", "mixed/gen.py")}
    assert got[("a", "out/f0.py")] == "declared" and got[("b", "src/out/gb0.py")] == "mined pattern"


@pytest.mark.parametrize(
    "head,hit",
    [("# Automatisch erzeugt aus x.yaml - nicht bearbeiten", True), ("// ARCHIVO GENERADO desde x.idl, no editar", True), ("/* Fichier généré par outil, ne pas modifier */", True), ("# 自动生成,请勿修改", True), ("# Gerado automaticamente por x", True), ("# Liest den Plan neu ein und erzeugt einen Bericht", False), ("# Genera el informe cuando falta", False)],
)
def test_notes_in_other_languages(spark, head, hit):
    assert bool(found(spark, [("p", "a.py", head.replace("//", "#").replace("/*", "#").replace("*/", "") + "\n" + BODY)])) == hit


def test_very_long_heads_do_not_grow_the_stack(spark):
    heads = ["#\n" * 100_000, "# line of a licence\n" * 100_000, "// foo 1.2\n" * 100_000, "/*" + " a b\n" * 100_000 + "*/", '"""' + "q\n" * 100_000 + '"""', "\n" * 200_000, "/* open" + "b\n" * 100_000]
    df = files(spark, [("p", f"{i}.py", h + "\nx = 1\n") for i, h in enumerate(heads)])
    assert [r["machine_head"] for r in measures(df).collect()] == [False] * len(heads)
    last = files(spark, [("p", "g.js", "// line\n" * 100_000 + "// @generated by x\nlet a = 1;\n")])
    assert measures(last).collect()[0]["machine_head"]
