"""Chunks of code by lines and of documents by headings.

Cutting by a running token budget is sequential within one item, so it runs as a Python table function over whole
items; counting, filtering and hashing stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..session import spread, table
from .graph import NODES, nodes

WORDS = re.compile(r"\w+|[^\w\s]")
HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def token_count(text: Column) -> Column:
    """Words and signs: the offline stand-in for a model's tokens."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"), F.lit(0))), F.lit(0))


def tokens(text: str) -> int:
    return len(WORDS.findall(text))


def line_windows(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first line, behind last line) of windows of at most ``limit`` tokens; each takes over the last lines of the one
    before that fit into ``overlap``.  A line over the limit is a window of its own."""
    lines = text.split("\n")
    cost = [tokens(x) for x in lines]
    out, first, used = [], 0, 0
    for i, c in enumerate(cost):
        if used + c > limit and i > first:
            out.append((first, i))
            back, room = i, overlap
            while back > first and cost[back - 1] <= room:
                back -= 1
                room -= cost[back]
            first, used = back, sum(cost[back:i])
        used += c
    out.append((first, len(lines)))
    return out


def entity_text(n: DataFrame) -> Column:
    """Signature, documentation in quotes and code, those that are there, one under the other."""
    return F.concat_ws("\n", F.when(F.length("signature") > 0, F.col("signature")), F.when(F.length("docstring") > 0, F.concat(F.lit('"""'), "docstring", F.lit('"""'))), F.coalesce("code", F.lit("")))


def chunk_code(items: DataFrame, limit: int = SETTINGS.chunk_tokens, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """Pieces of (name, start_line, content): name_partN, start_line, end_line, content, content_hash.

    Items within the limit stay whole and never leave the JVM; only the rest is cut in Python.
    """
    sized = items.where("content IS NOT NULL").withColumn("_n", token_count(F.col("content")))
    whole = sized.where(F.col("_n") <= limit).select("name", "name", F.lit(1).alias("part"), "start_line", (F.col("start_line") + F.size(F.split("content", "\n")) - 1).alias("end_line"), "content").toDF("name", "chunk_name", "part", "start_line", "end_line", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, start, content in pdf.itertuples(index=False):
                lines = content.split("\n")
                cuts = line_windows(content, limit, overlap)
                for k, (a, b) in enumerate(cuts, 1):
                    rows.append((name, f"{name}_part{k}" if len(cuts) > 1 else name, k, int(start) + a, int(start) + b - 1, "\n".join(lines[a:b])))
            yield pd.DataFrame(rows, columns=["name", "chunk_name", "part", "start_line", "end_line", "content"])

    cut = spread(sized.where(F.col("_n") > limit).select("name", "start_line", "content"), "name").mapInPandas(run, "name string, chunk_name string, part int, start_line int, end_line int, content string")
    return whole.unionByName(cut).withColumn("content_hash", F.sha2("content", 256))


def markdown_sections(text: str, limit: int, overlap: int) -> list[tuple[list[str], int, int, int, str]]:
    """(heading path, level, first line, last line, content) of the sections of a text, long ones cut in windows.

    Lines that look like headings inside fenced blocks are text.
    """
    lines = text.split("\n")
    marks: list[tuple[int, int, str]] = []
    fenced = False
    for i, line in enumerate(lines):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := HEADING.match(line)):
            marks.append((i, len(m.group(1)), m.group(2)))
    begins = [(0, 0, "")] if not marks or marks[0][0] else []
    out, path = [], {}
    for (at, level, title), nxt in zip([*begins, *marks], [*[m[0] for m in [*begins, *marks][1:]], len(lines)]):
        if level:
            path = {k: v for k, v in path.items() if k < level} | {level: title}
        body = "\n".join(lines[at:nxt])
        if not body.strip():
            continue
        for a, b in line_windows(body, limit, overlap):
            out.append(([path[k] for k in sorted(path)], max(path, default=0), at + a + 1, at + b, "\n".join(lines[at + a : at + b])))
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, limit: int = SETTINGS.chunk_tokens, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """Sections of each document with heading path, level, lines and hash; null and blank texts give none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, *s) for k, t in pdf.itertuples(index=False) for i, s in enumerate(markdown_sections(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["key", "seq", "heading_path", "heading_level", "start_line", "end_line", "content"])

    got = spread(docs.where(F.trim(text) != "").select(key, text), key).mapInPandas(run, f"key {kind}, seq int, heading_path array<string>, heading_level int, start_line int, end_line int, content string")
    return got.withColumnRenamed("key", key).withColumn("content_hash", F.sha2("content", 256))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, "signature", "docstring", "code", "start_line")
    return chunk_code(n.select(F.col("qualified_name").alias("name"), "start_line", entity_text(n).alias("content"))).select("name", "chunk_name", "part", "start_line", "end_line", "content_hash")


def code_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity type how many entities there are, how many tokens they have and how many are over the limit."""
    n = nodes(spark, sf_dir, "signature", "docstring", "code", "type")
    t = n.select("type", token_count(entity_text(n)).alias("n"))
    return t.groupBy("type").agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_tokens"), F.count_if(F.col("n") > SETTINGS.chunk_tokens).alias("n_over"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("document_type = 'markdown'")
    return chunk_documents(d, "doc_id", "text").select("doc_id", "seq", F.array_join("heading_path", " > ").alias("heading_path"), "heading_level", "start_line", "end_line", "content_hash")


def code_chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity what its chunks hold: first and last line, lines that some chunk holds, and the hash of an entity that
    is one chunk."""
    c = code_chunks(spark, sf_dir)
    lines = c.select("name", F.explode(F.sequence("start_line", "end_line")).alias("line")).groupBy("name").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count_distinct("line").alias("n_lines"))
    one = c.groupBy("name").agg(F.when(F.count("*") == 1, F.max("content_hash")).alias("whole_hash"), F.max("part").alias("n_parts"), F.count("*").alias("n_chunks"))
    return lines.join(one, "name").select("name", "first_line", "last_line", "n_lines", (F.col("n_parts") == F.col("n_chunks")).alias("parts_in_turn"))


def section_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per markdown document how many of its lines that are not blank lie in some section, and in how many sections
    headings of each level begin."""
    s = document_sections(spark, sf_dir)
    d = table(spark, sf_dir, "documents").where("document_type = 'markdown'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(~F.col("line").rlike(r"^\s*$"))
    held = s.select("doc_id", F.explode(F.sequence("start_line", "end_line")).alias("n")).distinct()
    got = d.select("doc_id", (F.col("at") + 1).alias("n")).join(held, ["doc_id", "n"], "left_semi")
    return got.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("n").cast("int").alias("first_line"), F.max("n").cast("int").alias("last_line"))


def tokens_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))


_T = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r]'))"
QUERIES = {"chunk_code": code_chunks, "code_chunk_totals": code_chunk_totals, "chunk_markdown": document_sections, "code_chunk_cover": code_chunk_cover, "section_cover": section_cover, "tokens_count": tokens_count}
SQL = {
    "code_chunk_totals": f"""WITH {NODES}, t AS (SELECT node_type, {_T.format("concat_ws(chr(10), CASE WHEN signature <> '' THEN signature END, CASE WHEN docstring <> '' THEN concat(repeat(chr(34), 3), docstring, repeat(chr(34), 3)) END, coalesce(code, ''))")} AS n FROM nodes)
      SELECT lower(node_type) AS type, count(*) AS n_entities, sum(n)::BIGINT AS n_tokens, count(*) FILTER (WHERE n > 1000) AS n_over FROM t GROUP BY 1""",
    "code_chunk_cover": f"""WITH {NODES}, t AS (SELECT qualified_name AS name, start_line, concat_ws(chr(10), CASE WHEN signature <> '' THEN signature END, CASE WHEN docstring <> '' THEN concat(repeat(chr(34), 3), docstring, repeat(chr(34), 3)) END, coalesce(code, '')) AS content FROM nodes)
      SELECT name, start_line AS first_line, start_line + length(content) - length(replace(content, chr(10), '')) AS last_line, length(content) - length(replace(content, chr(10), '')) + 1 AS n_lines, true AS parts_in_turn FROM t""",
    "section_cover": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE document_type = 'markdown')
      SELECT doc_id, count(*) AS n_lines, min(n)::INTEGER AS first_line, max(n)::INTEGER AS last_line FROM l WHERE NOT regexp_matches(line, '^\s*$') GROUP BY 1""",
    "tokens_count": f"SELECT doc_id, coalesce({_T.format('text')}, 0)::INTEGER AS n_tokens FROM documents",
}
