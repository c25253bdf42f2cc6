"""The property graph as tables: nodes, edges, files, imports; and the SQL text of the same views for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .hierarchy import _LINKS, entity_links
from .orphans import clean_target

NODE_TYPES = {"class": "Class", "function": "Function", "method": "Method", "interface": "Interface"}
COLUMNS = ("name", "type", "file_path", "project_name", "signature", "docstring", "start_line", "end_line", "is_async", "is_static", "is_classmethod", "parent_class", "base_classes", "calls")


def latest(df: DataFrame, key: str, cols: list[str], by: str) -> DataFrame:
    """The last version of each key by ``by``; an aggregation with partial results, not a sort of all versions."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.coalesce(F.col(by).cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz")), F.xxhash64(*cols))).alias("_v")).select(key, "_v.*")


def nodes(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """One row per entity with the asked columns (all but code by default) and node_type."""
    wanted = [c for c in (cols or COLUMNS) if c != "node_type"]
    if "type" not in wanted:
        wanted.append("type")
    got = latest(table(spark, sf_dir, "code_entities"), "qualified_name", wanted, "indexed_at")
    kind = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])
    got = got.withColumn("node_type", kind[F.col("type")])
    return got if not cols or "type" in cols else got.drop("type")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of resolved calls, each once; calls of unknown names are dropped."""
    e = nodes(spark, sf_dir, "calls").select(F.col("qualified_name").alias("src"), F.explode("calls").alias("dst")).withColumn("dst", clean_target(F.col("dst"))).distinct()
    known = table(spark, sf_dir, "code_entities").select(F.col("qualified_name").alias("dst")).distinct()
    return e.join(known, "dst", "left_semi").select("src", "dst")


def extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_links(spark, sf_dir).where("kind = 'base_classes'").select(F.col("child").alias("src"), F.col("parent").alias("dst"), "pos")


def files(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return latest(table(spark, sf_dir, "parsed_files"), "path", list(cols), "indexed_at")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, "imports").select(F.col("path").alias("file_path"), F.explode("imports").alias("i")).select("file_path", "i.*")


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_type, src, dst of every kind of edge between nodes and files."""
    n = nodes(spark, sf_dir, "file_path", "parent_class")
    known = n.select(F.col("qualified_name").alias("src"))
    defines = n.where(F.col("node_type").isin("Class", "Function")).select(F.lit("DEFINES").alias("edge_type"), F.col("file_path").alias("src"), F.col("qualified_name").alias("dst"))
    methods = n.where("node_type = 'Method'").select(F.lit("DEFINES_METHOD").alias("edge_type"), F.col("parent_class").alias("src"), F.col("qualified_name").alias("dst")).join(known, "src", "left_semi").select("edge_type", "src", "dst")
    called = calls(spark, sf_dir).select(F.lit("CALLS").alias("edge_type"), "src", "dst")
    parents = extends(spark, sf_dir).select(F.lit("EXTENDS").alias("edge_type"), "src", "dst").distinct()
    imported = imports(spark, sf_dir).select(F.lit("IMPORTS").alias("edge_type"), F.col("file_path").alias("src"), F.concat_ws(":", "name", "file_path").alias("dst")).distinct()
    return defines.unionByName(methods).unionByName(called).unionByName(parents).unionByName(imported)


#: The views in SQL.
NODES = """nodes AS (SELECT * EXCLUDE (rn) FROM (SELECT qualified_name, name, CASE type WHEN 'class' THEN 'Class' WHEN 'function' THEN 'Function' WHEN 'method' THEN 'Method' WHEN 'interface' THEN 'Interface' END AS node_type,
  file_path, project_name, signature, docstring, code, start_line, end_line, is_async, is_static, is_classmethod, parent_class, base_classes, calls, row_number() OVER (PARTITION BY qualified_name ORDER BY indexed_at DESC) AS rn
  FROM code_entities WHERE qualified_name IS NOT NULL) WHERE rn = 1)"""
CALLS = rf"""{NODES},
e_calls AS (SELECT DISTINCT src, dst FROM (SELECT qualified_name AS src, regexp_replace(regexp_replace(regexp_replace(unnest(calls), '^\s+|\s+$', '', 'g'), '\(\)$', ''), '\s+$', '') AS dst FROM nodes) WHERE dst IN (SELECT qualified_name FROM nodes))"""
FILES = "files AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM parsed_files WHERE path IS NOT NULL) WHERE rn = 1)"
IMPORTS = f"{FILES}, e_imports AS (SELECT path AS file_path, i.name AS name, i.alias AS alias, i.source AS source, i.is_external AS is_external, i.line_number AS line_number FROM (SELECT path, unnest(imports) AS i FROM files))"
EXTENDS = f"{_LINKS.strip().rpartition(chr(10) + 'reach AS')[0].rstrip().rstrip(',')}, e_extends AS (SELECT DISTINCT child AS src, parent AS dst, pos FROM links WHERE kind = 'base_classes')"
EDGES = f"""{CALLS}, {IMPORTS}, {EXTENDS},
edges AS (SELECT 'DEFINES' AS edge_type, file_path AS src, qualified_name AS dst FROM nodes WHERE node_type IN ('Class', 'Function')
  UNION ALL SELECT 'DEFINES_METHOD', parent_class, qualified_name FROM nodes WHERE node_type = 'Method' AND parent_class IN (SELECT qualified_name FROM nodes)
  UNION ALL SELECT 'CALLS', src, dst FROM e_calls UNION ALL SELECT DISTINCT 'EXTENDS', src, dst FROM e_extends UNION ALL SELECT DISTINCT 'IMPORTS', file_path, concat_ws(':', name, file_path) FROM e_imports)"""
