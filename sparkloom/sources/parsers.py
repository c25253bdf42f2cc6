"""Entities and imports of source files: Python by its syntax tree, scripts by a scan over braces.

One row per file goes in, flat rows come out, so nothing nested or recursive reaches Spark.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from ..operators.graph import files

ENTITY = ["type", "name", "qualified_name", "parent", "signature", "docstring", "start_line", "end_line", "is_async", "is_static", "is_classmethod", "decorators", "base_classes", "calls"]
ENTITY_SCHEMA = "type string, name string, qualified_name string, parent string, signature string, docstring string, start_line int, end_line int, is_async boolean, is_static boolean, is_classmethod boolean, decorators array<string>, base_classes array<string>, calls array<string>"
IMPORT = ["name", "alias", "source", "is_external", "line_number"]
IMPORT_SCHEMA = "name string, alias string, source string, is_external boolean, line_number int"


# -- Python ----------------------------------------------------------------------------------------------------------
def python_entities(source: str) -> list[tuple]:
    """Classes, functions and methods in order of appearance; functions inside functions belong to the outer one."""
    tree = ast.parse(source)
    out: list[tuple] = []

    def called(node: ast.AST) -> list[str]:
        return list(dict.fromkeys(ast.unparse(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)))

    def visit(body: list[ast.stmt], parents: list[str], in_class: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases]
                head = f"class {node.name}" + (f"({', '.join(bases)})" if bases else "")
                deco = [ast.unparse(d) for d in node.decorator_list]
                out.append(("class", node.name, ".".join([*parents, node.name]), ".".join(parents) or None, head, ast.get_docstring(node), node.lineno, node.end_lineno, False, False, False, deco, bases, []))
                visit(node.body, [*parents, node.name], True)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                deco = [ast.unparse(d) for d in node.decorator_list]
                is_async = isinstance(node, ast.AsyncFunctionDef)
                head = f"{'async ' * is_async}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                out.append(("method" if in_class else "function", node.name, ".".join([*parents, node.name]), ".".join(parents) or None, head, ast.get_docstring(node), node.lineno, node.end_lineno, is_async, "staticmethod" in deco, "classmethod" in deco, deco, [], called(node)))
            elif isinstance(node, (ast.If, ast.Try, ast.With)):
                visit([x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt)], parents, in_class)

    visit(tree.body, [], False)
    return out


def python_imports(source: str) -> list[tuple]:
    out = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            out += [(a.name, a.asname, None, True, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(a.name, a.asname, "." * node.level + (node.module or ""), not node.level, node.lineno) for a in node.names]
    return sorted(out, key=lambda r: (r[4], r[0], r[2] or ""))


# -- scripts ---------------------------------------------------------------------------------------------------------
_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:!&|?{}\[;]) ?/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")
_ID = r"[A-Za-z_$][\w$]*"
_DECL = re.compile(
    rf"(?P<class>\b(?:abstract\s+)?class\s+(?P<cn>{_ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+(?:<[^{{]*?>)?))?(?:\s+implements\s+(?P<impl>[^{{]+))?\s*\{{)"
    rf"|(?P<iface>\binterface\s+(?P<in>{_ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<ibase>[^{{]+))?\s*\{{)"
    rf"|(?P<func>\b(?P<fa>async\s+)?function\s*\*?\s*(?P<fn>{_ID})\s*(?:<[^(]*?>)?\()"
    rf"|(?P<arrow>\b(?:const|let|var)\s+(?P<an>{_ID})(?:\s*:[^=\n]+)?\s*=\s*(?P<aa>async\s+)?(?:{_ID}|\([^()]*(?:\([^()]*\)[^()]*)*\))(?:\s*:[^=\n]+)?\s*=>)"
    rf"|(?P<alias>\btype\s+(?P<tn>{_ID})(?:<[^=]*?>)?\s*=)"
    rf"|(?P<method>(?:(?<=\n)|(?<=[{{;}}]))[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*)\*?(?P<mn>#?{_ID})\s*(?:<[^(\n]*?>)?\((?=[^\n]*))"
)
_CALL = re.compile(r"(?<![\w$.])((?:new\s+)?[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\s*\(")
_WORDS = frozenset("if for while switch catch return function await typeof super constructor import with new do else throw".split())


def _blank(text: str) -> str:
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), text)


def _closing(text: str, at: int, pair: str = "{}") -> int:
    """Place of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.finditer("[" + re.escape(pair) + "]", text[at:]):
        depth += 1 if m.group(0) == pair[0] else -1
        if not depth:
            return at + m.start()
    return len(text) - 1


def script_entities(source: str) -> list[tuple]:
    """Classes, interfaces, type aliases, functions, arrow functions and methods in order of appearance."""
    text = _blank(source)
    line = lambda p: source.count("\n", 0, p) + 1
    docs = {}
    for m in re.finditer(r"/\*\*(?!/)[\s\S]*?\*/", source):
        docs[line(m.end())] = m.group(0)
    out, classes = [], []
    for m in _DECL.finditer(text):
        at = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
        owner = next((c for c in reversed(classes) if c[1] < at < c[2]), None)
        doc = docs.get(line(at) - 1)
        kind = m.lastgroup if m.lastgroup in ("class", "iface", "func", "arrow", "alias", "method") else next(k for k in ("class", "iface", "func", "arrow", "alias", "method") if m.group(k))
        if kind in ("class", "iface"):
            name = m.group("cn") or m.group("in")
            end = _closing(text, m.end() - 1)
            bases = [b.strip() for b in (m.group("base") or m.group("ibase") or "").split(",") if b.strip()]
            out.append(("class" if kind == "class" else "interface", name, name, None, source[at : m.end() - 1].strip(), doc, line(at), line(end), False, False, False, [], bases, []))
            if kind == "class":
                classes.append((name, m.end() - 1, end))
            continue
        if kind == "alias":
            stop = text.find(";", m.end())
            out.append(("type_alias", m.group("tn"), m.group("tn"), None, source[at : m.end()].strip(), doc, line(at), line(stop if stop > 0 else m.end()), False, False, False, [], [], []))
            continue
        name = m.group("fn") or m.group("an") or m.group("mn")
        if name in _WORDS and name != "constructor":
            continue
        mods = m.group("mods") or ""
        if kind == "method":
            if owner is None or text.count("{", owner[1] + 1, at) != text.count("}", owner[1] + 1, at):
                continue
            close = _closing(text, m.end() - 1, "()")
            body = re.compile(r"\s*(?::[^{;=]+)?\{").match(text, close + 1)
            if not body:
                continue
            opening = body.end() - 1
        elif kind == "func":
            close = _closing(text, m.end() - 1, "()")
            opening = text.find("{", close)
        else:
            close = m.end()
            after = re.compile(r"\s*\{").match(text, close)
            opening = after.end() - 1 if after else -1
        end = _closing(text, opening) if opening >= 0 else (text.find(";", close) if text.find(";", close) > 0 else len(text) - 1)
        calls = [c for c in dict.fromkeys(re.sub(r"\s+", " ", x) for x in _CALL.findall(text[opening if opening >= 0 else close : end + 1])) if c.split(".")[0] not in _WORDS]
        qn = f"{owner[0]}.{name}" if kind == "method" else name
        out.append(("method" if kind == "method" else "function", name, qn, owner[0] if kind == "method" else None, source[at : opening if opening > 0 else close].strip(), doc, line(at), line(end), bool(m.group("fa") or m.group("aa")) or "async" in mods, "static" in mods, False, [], [], calls))
    return out


def script_imports(source: str) -> list[tuple]:
    out = []
    line = lambda p: source.count("\n", 0, p) + 1
    for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?(?:([\s\S]*?)\s+from\s+)?['\"]([^'\"]+)['\"]", source, re.M):
        what, src = m.group(1), m.group(2)
        ext, at = not src.startswith("."), line(m.start() + len(m.group(0)) - len(m.group(0).lstrip()))
        if what is None:
            out.append((src, None, src, ext, at))
            continue
        braces = re.search(r"\{([\s\S]*)\}", what)
        for item in (braces.group(1).split(",") if braces else []):
            item = re.sub(r"^\s*type\s+", "", item).strip()
            if item:
                name, _, alias = (x.strip() for x in item.partition(" as "))
                out.append((name, alias or None, src, ext, at))
        rest = re.sub(r"\{[\s\S]*\}", "", what)
        for item in (x.strip() for x in rest.split(",")):
            if item.startswith("*"):
                out.append(("*", item.split()[-1], src, ext, at))
            elif item:
                out.append((item, None, src, ext, at))
    for m in re.finditer(rf"\b(?:const|let|var)\s+({_ID}|\{{[^}}]*\}})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", source):
        names = m.group(1).strip("{} ").split(",") if m.group(1)[0] == "{" else [m.group(1)]
        out += [(n.strip(), None, m.group(2), not m.group(2).startswith("."), line(m.start())) for n in names if n.strip()]
    return sorted(out, key=lambda r: (r[4], r[0], r[2] or ""))


def _extract(df: DataFrame, python, script, names: list[str], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in pdf.itertuples(index=False):
                try:
                    got = python(content) if path.endswith(".py") else script(content)
                except (SyntaxError, ValueError, RecursionError):
                    continue  # such files are reported by their own operator
                rows += [(path, i, *r) for i, r in enumerate(got)]
            yield pd.DataFrame(rows, columns=["file_path", "seq", *names])

    return spread(df.where("content IS NOT NULL").select("path", "content"), "path").mapInPandas(run, f"file_path string, seq int, {schema}")


def parse_entities(df: DataFrame) -> DataFrame:
    """file_path, seq and entity columns of each file (path, content); files that do not parse give no rows."""
    return _extract(df, python_entities, script_entities, ENTITY, ENTITY_SCHEMA)


def parse_imports(df: DataFrame) -> DataFrame:
    return _extract(df, python_imports, script_imports, IMPORT, IMPORT_SCHEMA)


def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_entities(files(spark, sf_dir, "content")).select("file_path", "seq", "type", "name", "qualified_name", "parent", "start_line", "end_line", "is_async")


def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_imports(files(spark, sf_dir, "content"))


QUERIES = {"parse_entities": parsed_entities, "parse_imports": parsed_imports}
SQL: dict[str, str] = {}
