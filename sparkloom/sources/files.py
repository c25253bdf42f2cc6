"""Files as tables: a recursive scan with hash, size, lines and language; and the same for documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Languages by extension, and what a scan leaves out.  Fixed values.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx"}
IGNORED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", "*.egg-info")
DOCUMENTS = (".md", ".markdown", ".mdx")
DOCUMENT_IGNORED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist")


def glob_regex(pattern: str) -> str:
    """A shell pattern for one path part as a regular expression."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def ignored(relative: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any part of the path fits any pattern."""
    return relative.rlike(r"(?:^|/)(?:" + "|".join(glob_regex(p) for p in patterns) + r")(?:/|$)") if patterns else F.lit(False)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path, size_bytes of every file under ``root``.

    Spark's own file sources skip names that begin with an underscore or are empty, which package files often are, so
    folders are walked by the executors: one row per entry of the root, each walked where it lands.
    """
    from pyarrow import fs as pafs

    def opened(uri: str) -> tuple:
        return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.rstrip("/"))

    ship(spark)
    fs, base = opened(root)
    first = [(i.path, i.type == pafs.FileType.Directory, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(base))]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, _ = opened(root)
        for pdf in frames:
            rows = []
            for path, folder, size in pdf.itertuples(index=False):
                found = [(i.path, i.size) for i in here.get_file_info(pafs.FileSelector(path, recursive=True)) if i.type == pafs.FileType.File] if folder else [(path, size)]
                rows += [(p, p[len(base) + 1 :], n) for p, n in found]
            yield pd.DataFrame(rows, columns=["path", "relative_path", "size_bytes"])

    entries = spark.createDataFrame(first, "path string, folder boolean, size long")
    cores = spark.sparkContext.defaultParallelism
    return entries.repartition(max(1, min(len(first), 4 * cores))).mapInPandas(walk, "path string, relative_path string, size_bytes long")


def contents(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` with the bytes of each file; files that cannot be read are left out."""
    schema = listed.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        here = pafs.FileSystem.from_uri(root)[0] if "://" in root else pafs.LocalFileSystem()
        for pdf in frames:
            for lo in range(0, len(pdf), 200):
                part = pdf.iloc[lo : lo + 200]
                got = []
                for path in part["path"]:
                    try:
                        with here.open_input_stream(path) as f:
                            got.append(f.read())
                    except OSError:
                        got.append(None)
                yield part.assign(content=got)

    cores = listed.sparkSession.sparkContext.defaultParallelism
    return listed.repartition(4 * cores, "path").mapInPandas(read, f"{schema}, content binary").where("content IS NOT NULL")


def scan(spark: SparkSession, root: str, languages: dict[str, str] | None = None, patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    """path, relative_path, language, content_hash, size_bytes, line_count, content of the files under ``root``.

    The hash is of the bytes, line_count is line ends plus one.  Undecodable bytes become U+FFFD; unreadable files are
    left out.  Only files that are kept are opened.
    """
    langs = languages or LANGUAGES
    ext = F.lower(F.regexp_extract("path", r"(\.\w+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in langs.items() for x in kv])
    kept = contents(listing(spark, root).where(ext.isin(*langs) & ~ignored(F.col("relative_path"), patterns)), root)
    text = F.decode("content", "UTF-8")
    return kept.select("path", "relative_path", kind[ext].alias("language"), F.sha2("content", 256).alias("content_hash"), "size_bytes", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("int").alias("line_count"), text.alias("content"))


def scan_documents(spark: SparkSession, root: str, patterns: tuple[str, ...] = DOCUMENT_IGNORED) -> DataFrame:
    return scan(spark, root, dict.fromkeys(DOCUMENTS, "markdown"), patterns)


def statistics(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def module_name(relative: Column, project: Column) -> Column:
    """The dotted module of a file: project, folders and stem; a package's ``__init__`` is the package."""
    stem = F.regexp_replace(F.regexp_replace(relative, r"\.\w+$", ""), r"(?:^|/)__init__$", "")
    return F.concat_ws(".", project, F.when(stem != "", F.translate(stem, "/", ".")))
