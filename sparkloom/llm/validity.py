"""Problem 1: source files that do not parse."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, table

#: Languages by file extension; other files get no verdict.
LANGUAGE = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx"}


def first_error(content: str, ext: str) -> int | None:
    """Place of the first error no reading of ``content`` recovers from; None if valid.  Empty content is valid."""
    from .syntax import python, script

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    return python.first_error(content) if ext == ".py" else script.first_error(content, ext)


def parse_files(files: DataFrame, path: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """``path``, ``keep``, language, valid, error_line, error_text of each row, parsed whole by its extension's tables.

    language is null for other extensions; valid is null for those and for null content.  Repeated rows are judged
    each; very long and deeply nested files are parsed like others.
    """
    schema = T.StructType([*[files.select(c).schema[0] for c in (path, *keep)], *T._parse_datatype_string("language string, valid boolean, error_line int, error_text string").fields])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                out: list[tuple] = []
                for name, text in zip(part.column(0).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    dot = (name or "").rfind(".")
                    ext = name[dot:].lower() if dot >= 0 else ""
                    if ext not in LANGUAGE or text is None:
                        out.append((LANGUAGE.get(ext), None, None, None))
                        continue
                    at = first_error(text, ext)
                    out.append((LANGUAGE[ext], at is None, None if at is None else text.count("\n", 0, at) + 1, None if at is None else text[at : at + 40]))
                cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[f.name for f in schema])

    return spread(files.select(path, *keep, content), path).mapInArrow(run, schema)


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(table(spark, sf_dir, "parsed_files"), keep=("project_name",))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_files(spark, sf_dir).where("NOT valid").select("path").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with content, flagged files and their rate per project and language; a file scanned again counts once."""
    one = p1_files(spark, sf_dir).where("valid IS NOT NULL").groupBy("project_name", "language", "path").agg(F.max(F.when(~F.col("valid"), 1).otherwise(0)).alias("bad"))
    return one.groupBy("project_name", "language").agg(F.count("*").alias("n_files"), F.sum("bad").alias("n_flagged"), F.round(F.avg("bad"), 6).alias("rate"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_files": p1_files}
SQL: dict[str, str] = {}
