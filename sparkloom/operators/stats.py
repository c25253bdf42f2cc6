"""Counts, rollups and latest-of-each over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DRIFTED, STATUSES
from ..session import table
from .graph import CALLS, EDGES, FILES, NODES, all_edges, calls, files, latest, nodes
from .lookup import _C, chunks


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, classes, functions, methods, interfaces and vectors; an empty kind counts zero."""
    kinds = {"class_count": "Class", "function_count": "Function", "method_count": "Method", "interface_count": "Interface"}
    names = [*kinds, "file_count", "vector_count"]
    n = nodes(spark, sf_dir, "name").agg(*[F.count_if(F.col("node_type") == t).alias(a) for a, t in kinds.items()])
    f = table(spark, sf_dir, "parsed_files").agg(F.count_distinct("path").alias("file_count"))
    v = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vector_count"))
    filled = [df.select(*[F.col(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in names]) for df in (n, f, v)]
    return filled[0].unionByName(filled[1]).unionByName(filled[2]).agg(*[F.sum(c).alias(c) for c in names])


def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: files, lines, entities of each type, chunks and documents, each counted apart and then joined."""
    p = table(spark, sf_dir, "projects").select("project_name")
    f = files(spark, sf_dir, "project_name", "line_count").groupBy("project_name").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("n_lines"))
    e = nodes(spark, sf_dir, "project_name").groupBy("project_name").agg(F.count("*").alias("n_entities"), F.count_if(F.col("node_type") == "Class").alias("n_classes"), F.count_if(F.col("node_type") == "Method").alias("n_methods"))
    c = table(spark, sf_dir, "document_chunks").groupBy("project_name").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    d = table(spark, sf_dir, "documents").groupBy("project_name").agg(F.count("*").alias("n_documents"))
    got = p
    for part in (f, e, c, d):
        got = got.join(part, "project_name", "left")
    return got.fillna(0)


def schema_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label and edges by type."""
    n = nodes(spark, sf_dir, "name").groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("label")).agg(F.count("*").alias("n"))
    e = all_edges(spark, sf_dir).groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("label")).agg(F.count("*").alias("n"))
    return n.unionByName(e)


def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and bytes per language of the extension."""
    f = files(spark, sf_dir, "line_count", "size_bytes")
    return f.groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("extension")).agg(F.count("*").alias("n_files"), F.sum("line_count").alias("n_lines"), F.sum("size_bytes").alias("n_bytes"))


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("document_type").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.sum("chunk_count").alias("n_chunks"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["document_chunk_id", "linked_entity_qualified_name", "analysis_trigger", "drift_detected", "drift_severity", "drift_score", "analyzed_at"]
    return latest(table(spark, sf_dir, "drift_analyses"), "analysis_id", cols, "created_at")


def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses(spark, sf_dir).groupBy("drift_severity").agg(F.count("*").alias("n"))


def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last analysis of each chunk; of equal times the one with the larger id."""
    a = analyses(spark, sf_dir).where("document_chunk_id IS NOT NULL")
    return a.groupBy("document_chunk_id").agg(F.max_by(F.struct("analysis_id", "drift_severity", "drift_score"), F.struct("analyzed_at", "analysis_id")).alias("v")).select("document_chunk_id", "v.*")


def analysis_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three analyses of each entity."""
    w = Window.partitionBy("linked_entity_qualified_name").orderBy(F.desc("analyzed_at"), F.desc("analysis_id"))
    a = analyses(spark, sf_dir).where("linked_entity_qualified_name IS NOT NULL")
    return a.withColumn("n", F.row_number().over(w)).where("n <= 3").select("linked_entity_qualified_name", "n", "analysis_id", "drift_severity")


def worst_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis with the highest score of each entity, the earliest of equal ones; scores that are null lose."""
    a = analyses(spark, sf_dir).where("linked_entity_qualified_name IS NOT NULL")
    return a.groupBy("linked_entity_qualified_name").agg(F.min_by(F.struct("analysis_id", "drift_score"), F.struct(-F.coalesce("drift_score", F.lit(-1.0)), "analyzed_at", "analysis_id")).alias("v")).select("linked_entity_qualified_name", "v.*")


def chunk_drift_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each document as the worst of its chunks' analyses."""
    a = analyses(spark, sf_dir).groupBy("document_chunk_id").agg(F.max("drift_score").alias("score"), F.count_if("drift_detected").alias("n_detected"))
    c = chunks(spark, sf_dir, "doc_id")
    return c.join(a, c["chunk_id"] == a["document_chunk_id"]).groupBy("doc_id").agg(F.max("score").alias("drift_score"), F.sum("n_detected").alias("n_detected"), F.count("*").alias("n_chunks"))


def issues_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues column, JSON, opened with a fixed schema and counted by kind; what is not JSON counts nothing."""
    parsed = F.from_json("issues", "array<struct<kind string, text string>>", {"mode": "PERMISSIVE"})
    rows = table(spark, sf_dir, "drift_analyses").select("analysis_id", "issues").distinct().select("analysis_id", F.explode(parsed).alias("i"))
    return rows.groupBy(F.col("i.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("analysis_id").alias("n_analyses"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the declared constraints: status sets, unique and foreign keys, per table and rule."""
    d, c, l = (table(spark, sf_dir, t) for t in ("documents", "document_chunks", "document_links"))
    out = lambda df, name, rule: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n")
    status = list(STATUSES["drift_status"])
    parts = [
        out(d.where(~F.col("drift_status").isin(status)), "documents", "drift_status"),
        out(c.where(~F.col("drift_status").isin(status)), "document_chunks", "drift_status"),
        out(l.where(~F.col("link_type").isin(list(STATUSES["link_type"]))), "document_links", "link_type"),
        out(l.where((F.col("confidence_score") < 0) | (F.col("confidence_score") > 1)), "document_links", "confidence_range"),
        out(c.groupBy("chunk_id").count().where("count > 1"), "document_chunks", "unique_chunk_id"),
        out(l.groupBy("link_id").count().where("count > 1"), "document_links", "unique_link_id"),
        out(c.join(d.select("doc_id"), "doc_id", "left_anti"), "document_chunks", "foreign_doc_id"),
        out(l.join(c.select(F.col("chunk_id").alias("document_chunk_id")).distinct(), "document_chunk_id", "left_anti"), "document_links", "foreign_chunk_id"),
    ]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got


_A = "analyses AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC) AS rn FROM drift_analyses WHERE analysis_id IS NOT NULL) WHERE rn = 1)"
_ST = "('unknown', 'aligned', 'minor_drift', 'major_drift')"

QUERIES = {
    "graph_stats": graph_stats, "project_stats": project_stats, "schema_info": schema_info, "scan_statistics": scan_statistics, "document_statistics": document_statistics, "severity_histogram": severity_histogram, "latest_analysis": latest_analysis,
    "analysis_history": analysis_history, "worst_per_entity": worst_per_entity, "document_drift": chunk_drift_rollup, "issues_by_kind": issues_by_kind, "constraint_violations": violations,
}
SQL = {
    "graph_stats": f"""WITH {NODES} SELECT count(*) FILTER (WHERE node_type = 'Class') AS class_count, count(*) FILTER (WHERE node_type = 'Function') AS function_count, count(*) FILTER (WHERE node_type = 'Method') AS method_count,
      count(*) FILTER (WHERE node_type = 'Interface') AS interface_count, (SELECT count(DISTINCT path) FROM parsed_files) AS file_count, (SELECT count(*) FROM embeddings) AS vector_count FROM nodes""",
    "project_stats": f"""WITH {NODES}, {FILES}, f AS (SELECT project_name, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines FROM files GROUP BY 1),
      e AS (SELECT project_name, count(*) AS n_entities, count(*) FILTER (WHERE node_type = 'Class') AS n_classes, count(*) FILTER (WHERE node_type = 'Method') AS n_methods FROM nodes GROUP BY 1),
      c AS (SELECT project_name, count(DISTINCT chunk_id) AS n_chunks FROM document_chunks GROUP BY 1), d AS (SELECT project_name, count(*) AS n_documents FROM documents GROUP BY 1)
      SELECT p.project_name, coalesce(n_files, 0) AS n_files, coalesce(n_lines, 0) AS n_lines, coalesce(n_entities, 0) AS n_entities, coalesce(n_classes, 0) AS n_classes, coalesce(n_methods, 0) AS n_methods, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_documents, 0) AS n_documents
      FROM projects p LEFT JOIN f USING (project_name) LEFT JOIN e USING (project_name) LEFT JOIN c USING (project_name) LEFT JOIN d USING (project_name)""",
    "schema_info": f"WITH {EDGES} SELECT 'node' AS kind, node_type AS label, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type",
    "scan_statistics": rf"WITH {FILES} SELECT regexp_extract(path, '\.(\w+)$', 1) AS extension, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines, sum(size_bytes)::BIGINT AS n_bytes FROM files GROUP BY 1",
    "document_statistics": "SELECT document_type, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, sum(chunk_count)::BIGINT AS n_chunks FROM documents GROUP BY 1",
    "severity_histogram": f"WITH {_A} SELECT drift_severity, count(*) AS n FROM analyses GROUP BY 1",
    "latest_analysis": f"WITH {_A} SELECT document_chunk_id, analysis_id, drift_severity, drift_score FROM (SELECT *, row_number() OVER (PARTITION BY document_chunk_id ORDER BY analyzed_at DESC NULLS LAST, analysis_id DESC) AS n FROM analyses WHERE document_chunk_id IS NOT NULL) WHERE n = 1",
    "analysis_history": f"WITH {_A} SELECT linked_entity_qualified_name, n, analysis_id, drift_severity FROM (SELECT *, row_number() OVER (PARTITION BY linked_entity_qualified_name ORDER BY analyzed_at DESC NULLS LAST, analysis_id DESC) AS n FROM analyses WHERE linked_entity_qualified_name IS NOT NULL) WHERE n <= 3",
    "worst_per_entity": f"WITH {_A} SELECT linked_entity_qualified_name, analysis_id, drift_score FROM (SELECT *, row_number() OVER (PARTITION BY linked_entity_qualified_name ORDER BY drift_score DESC NULLS LAST, analyzed_at NULLS FIRST, analysis_id) AS n FROM analyses WHERE linked_entity_qualified_name IS NOT NULL) WHERE n = 1",
    "document_drift": f"WITH {_A}, {_C}, a AS (SELECT document_chunk_id, max(drift_score) AS score, count(*) FILTER (WHERE drift_detected) AS n_detected FROM analyses GROUP BY 1) SELECT doc_id, max(score) AS drift_score, sum(n_detected)::BIGINT AS n_detected, count(*) AS n_chunks FROM chunks JOIN a ON document_chunk_id = chunk_id GROUP BY doc_id",
    "issues_by_kind": """SELECT i->>'kind' AS kind, count(*) AS n, count(DISTINCT analysis_id) AS n_analyses FROM (SELECT analysis_id, unnest(CAST(CASE WHEN json_valid(issues) THEN issues END AS JSON[])) AS i FROM (SELECT DISTINCT analysis_id, issues FROM drift_analyses)) GROUP BY 1""",
    "constraint_violations": f"""SELECT 'documents' AS table_name, 'drift_status' AS rule, count(*) AS n FROM documents WHERE drift_status NOT IN {_ST} UNION ALL SELECT 'document_chunks', 'drift_status', count(*) FROM document_chunks WHERE drift_status NOT IN {_ST}
      UNION ALL SELECT 'document_links', 'link_type', count(*) FROM document_links WHERE link_type NOT IN ('explicit', 'implicit') UNION ALL SELECT 'document_links', 'confidence_range', count(*) FROM document_links WHERE confidence_score < 0 OR confidence_score > 1
      UNION ALL SELECT 'document_chunks', 'unique_chunk_id', count(*) FROM (SELECT chunk_id FROM document_chunks GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'document_links', 'unique_link_id', count(*) FROM (SELECT link_id FROM document_links GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'document_chunks', 'foreign_doc_id', count(*) FROM document_chunks c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id)
      UNION ALL SELECT 'document_links', 'foreign_chunk_id', count(*) FROM document_links l WHERE NOT EXISTS (SELECT 1 FROM document_chunks c WHERE c.chunk_id = l.document_chunk_id)""",
}
