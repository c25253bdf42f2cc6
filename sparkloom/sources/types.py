"""Types of local names in Python functions, from annotations, constructors and names."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import files
from ..session import spread


def name_score(name: str, cls: str) -> int:
    """How well a parameter's name fits a class: 100 equal, 90 one ends with the other, less if merely contained."""
    n, c = name.replace("_", "").lower(), cls.lower()
    if n == c:
        return 100
    if c.endswith(n) or n.endswith(c):
        return 90
    return int(80 * len(c) / len(n)) if c in n else 0


def guess(name: str, classes: list[str]) -> str | None:
    best = max(classes, key=lambda c: name_score(name, c), default=None)
    return best if best and name_score(name, best) > 50 else None


def local_types(source: str) -> list[tuple[str, str, str, str, float]]:
    """(function, name, type, how, confidence) for each function of a file."""
    tree = ast.parse(source)
    classes = sorted(n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef))
    out = []
    for fn in (n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))):
        found: dict[str, tuple[str, str, float]] = {}
        for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs):
            if a.annotation is not None:
                found[a.arg] = (ast.unparse(a.annotation), "annotation", 1.0)
            elif a.arg not in ("self", "cls") and (g := guess(a.arg, classes)):
                found[a.arg] = (g, "name", 0.6)
        for node in ast.walk(fn):
            if isinstance(node, ast.AnnAssign):
                found.setdefault(ast.unparse(node.target), (ast.unparse(node.annotation), "annotation", 1.0))
            elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], (ast.Name, ast.Attribute)):
                target = ast.unparse(node.targets[0])
                if isinstance(node.value, ast.Call) and isinstance(node.value.func, (ast.Name, ast.Attribute)):
                    called = ast.unparse(node.value.func)
                    if called.split(".")[-1][:1].isupper():
                        found.setdefault(target, (called, "constructor", 0.9))
                elif isinstance(node.value, ast.Constant) and node.value.value is not None:
                    found.setdefault(target, (type(node.value.value).__name__, "literal", 0.9))
                elif isinstance(node.value, (ast.List, ast.Dict, ast.Set, ast.Tuple, ast.ListComp, ast.DictComp, ast.SetComp)):
                    found.setdefault(target, (type(node.value).__name__.removesuffix("Comp").lower(), "literal", 0.9))
                elif isinstance(node.value, ast.Name) and node.value.id in found:
                    found.setdefault(target, found[node.value.id])
        out += [(fn.name, k, *v) for k, v in sorted(found.items())]
    return out


def infer(df: DataFrame) -> DataFrame:
    """file_path, function, name, type, how, confidence; files that do not parse and other languages give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in pdf.itertuples(index=False):
                try:
                    rows += [(path, *r) for r in local_types(content)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "function", "name", "type", "how", "confidence"])

    return spread(df.where("content IS NOT NULL AND path LIKE '%.py'").select("path", "content"), "path").mapInPandas(run, "file_path string, function string, name string, type string, how string, confidence double")


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer(files(spark, sf_dir, "content"))


QUERIES = {"local_types": inferred_types}
SQL: dict[str, str] = {}
