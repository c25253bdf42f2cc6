"""Keyed upserts, cascading deletes, updates and the differences that drive incremental indexing.

Parquet has no MERGE: a change reads the old table, makes the new one and writes it beside the old before the names
are swapped; nothing is written over what is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DRIFTED
from ..session import table
from .graph import FILES, NODES, files, nodes
from .lookup import _C, _L, chunks, links
from .stats import _A, analyses


# -- operators -------------------------------------------------------------------------------------------------------
def last_of_batch(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of a batch with the same keys the last by ``order``."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_v")).select(*keys, "_v.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``keys``; columns ``keep`` of rows already there stay as they were."""
    if keep:
        kept = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(kept, keys, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else c for c in new.columns])
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def versioned(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """An upsert that counts: the new row's version is one more than the old one's, 1 if there was none."""
    prior = old.select(*keys, F.col(version).alias("_old"))
    return upsert(old, new.drop(version).join(prior, keys, "left").withColumn(version, F.coalesce("_old", F.lit(0)) + 1).drop("_old"), keys)


def delete_where(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose keys are in ``gone``; a null key is never deleted."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def difference(scan: DataFrame, index: DataFrame, key: str, content: str) -> DataFrame:
    """``key`` and state: new, changed, same or gone, from the contents' hashes of a scan and of the index."""
    s = scan.select(key, F.col(content).alias("_s"))
    i = index.select(key, F.col(content).alias("_i"))
    state = F.when(F.col("_i").isNull(), "new").when(F.col("_s").isNull(), "gone").when(F.col("_s") == F.col("_i"), "same").otherwise("changed")
    return s.join(i, key, "full").select(key, state.alias("state"))


def swap(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and put it in its place; readers of the old files are not disturbed meanwhile."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm, hconf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = p(path).getFileSystem(hconf)
    fs.delete(p(f"{path}.old"), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(f"{path}.old"))
    fs.rename(p(f"{path}.new"), p(path))
    fs.delete(p(f"{path}.old"), True)


# -- over the stored tables ------------------------------------------------------------------------------------------
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the index as the documents' stored hashes give it: every 7th was never indexed, every 5th is stale."""
    d = table(spark, sf_dir, "documents").select("doc_id", "content_hash")
    stale = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content_hash", F.lit("old")), 256)).otherwise(F.col("content_hash"))
    gone = d.where("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "content_hash")
    return d.where("doc_id % 7 <> 0").select("doc_id", stale.alias("content_hash")).unionByName(gone)


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference(table(spark, sf_dir, "documents").select("doc_id", "content_hash"), _index(spark, sf_dir), "doc_id", "content_hash")


def files_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned again whose stored hash is not that of their content, or that have no entity: work for the indexer."""
    f = files(spark, sf_dir, "content_hash", "content").select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("now"), "content_hash")
    known = nodes(spark, sf_dir, "file_path").select(F.col("file_path").alias("path")).distinct().withColumn("has_entities", F.lit(True))
    return f.join(known, "path", "left").select("path", (F.col("now") == F.col("content_hash")).alias("same_hash"), F.coalesce("has_entities", F.lit(False)).alias("has_entities"))


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents upserted by project and path: of a batch the last of each key counts."""
    d = table(spark, sf_dir, "documents").where("project_name IS NOT NULL AND relative_path IS NOT NULL").select("project_name", "relative_path", "doc_id", "content_hash", "indexed_at")
    old, new = d.where("doc_id % 3 <> 0"), d.where("doc_id % 2 = 0 OR doc_id % 3 = 0")
    keys = ["project_name", "relative_path"]
    return upsert(last_of_batch(old, keys, "doc_id"), last_of_batch(new, keys, "doc_id"), keys, keep=("indexed_at",)).select(*keys, "doc_id", "content_hash", "indexed_at")


def metadata_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version counters of projects: those indexed before get one more."""
    p = table(spark, sf_dir, "projects").select("project_name", "package", F.col("last_indexed_at").isNotNull().alias("seen"))
    old = p.where("seen").select("project_name", "package", F.lit(1).alias("version"))
    return versioned(old, p.select("project_name", "package", F.lit(0).alias("version")), ["project_name"]).select("project_name", "package", "version")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents, chunks, links and analyses when drifted documents are deleted with all below them."""
    gone = table(spark, sf_dir, "documents").where(F.col("drift_status").isin(*DRIFTED)).select("doc_id")
    d = delete_where(table(spark, sf_dir, "documents"), gone, ["doc_id"])
    c = delete_where(chunks(spark, sf_dir, "doc_id"), gone, ["doc_id"])
    dead = chunks(spark, sf_dir, "doc_id").join(gone, "doc_id", "left_semi").select(F.col("chunk_id").alias("document_chunk_id"))
    l = delete_where(links(spark, sf_dir), dead, ["document_chunk_id"])
    a = delete_where(analyses(spark, sf_dir), dead, ["document_chunk_id"])
    n = lambda df, t: df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
    return n(d, "documents").unionByName(n(c, "document_chunks")).unionByName(n(l, "document_links")).unionByName(n(a, "drift_analyses"))


def live_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left after the tombstones: those deleted after they were last indexed are gone, with their methods."""
    seen = table(spark, sf_dir, "code_entities").where("qualified_name IS NOT NULL").groupBy("qualified_name").agg(F.max("indexed_at").alias("last_at"))
    gone = table(spark, sf_dir, "entity_tombstones").groupBy("qualified_name").agg(F.max("deleted_at").alias("deleted_at"))
    dead = seen.join(gone, "qualified_name").where("deleted_at > last_at").select("qualified_name")
    n = nodes(spark, sf_dir, "parent_class")
    left = delete_where(n, dead, ["qualified_name"])
    return delete_where(left, dead.withColumnRenamed("qualified_name", "parent_class"), ["parent_class"]).select("qualified_name", "node_type")


def update_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their drift status set from the worst analysis, where there is one."""
    worst = analyses(spark, sf_dir).where("document_chunk_id IS NOT NULL").groupBy(F.col("document_chunk_id").alias("chunk_id")).agg(F.max("drift_score").alias("score"), F.max(F.when(F.col("drift_detected"), 1).otherwise(0)).alias("hit"))
    status = F.when(F.col("hit") == 0, "aligned").when(F.col("score") >= 0.5, "major_drift").when(F.col("hit") == 1, "minor_drift")
    return chunks(spark, sf_dir, "drift_status").join(worst, "chunk_id", "left").select("chunk_id", F.coalesce(status, F.col("drift_status")).alias("drift_status"), "score")


def calibrated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of links moved to where the entity now stands; a link whose length changed needs a review."""
    n = nodes(spark, sf_dir, "start_line", "end_line")
    got = links(spark, sf_dir).join(n, F.col("code_entity_qualified_name") == n["qualified_name"])
    had = F.col("line_range_start").isNotNull() & F.col("line_range_end").isNotNull()
    review = had & ((F.col("line_range_end") - F.col("line_range_start")) != (F.col("end_line") - F.col("start_line")))
    return got.select("link_id", F.col("start_line").alias("line_range_start"), F.col("end_line").alias("line_range_end"), F.coalesce(review, F.lit(False)).alias("needs_review"))


def drift_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk and link pairs to analyse, with what is known of the code's version."""
    c = chunks(spark, sf_dir, "doc_id", "content_hash")
    l = links(spark, sf_dir)
    n = nodes(spark, sf_dir, "file_path")
    f = files(spark, sf_dir, "content_hash").select(F.col("path").alias("file_path"), F.col("content_hash").alias("code_hash"))
    got = l.join(c, l["document_chunk_id"] == c["chunk_id"]).join(n, l["code_entity_qualified_name"] == n["qualified_name"], "left").join(f, "file_path", "left")
    state = F.when(F.col("qualified_name").isNull(), "no_entity").when(F.col("code_hash").isNull(), "no_code").when(F.col("code_version_hash").isNull(), "never_checked").when(F.col("code_version_hash") == F.col("code_hash"), "fresh").otherwise("stale")
    return got.select("link_id", "chunk_id", "doc_id", "code_entity_qualified_name", state.alias("state"))


def drift_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic part of drift analysis over stored judgements: severity and score made consistent.

    Not detected: aligned and 0.  A severity outside the known words counts as aligned; a missing score as the default.
    """
    a = analyses(spark, sf_dir)
    known = {"none": "aligned", "minor": "minor_drift", "major": "major_drift", "aligned": "aligned", "minor_drift": "minor_drift", "major_drift": "major_drift"}
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("drift_severity")], F.lit("aligned"))
    hit = F.coalesce("drift_detected", F.lit(False))
    return a.select("analysis_id", F.when(hit, severity).otherwise("aligned").alias("severity"), F.when(hit, F.coalesce("drift_score", F.lit(0.5))).otherwise(0.0).alias("score"))


_IDX = """idx AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(content_hash || 'old') ELSE content_hash END AS h FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -doc_id - 1, content_hash FROM documents WHERE doc_id % 11 = 0)"""

QUERIES = {
    "incremental_diff": incremental_diff, "files_to_index": files_to_index, "upsert_documents": upsert_documents, "metadata_versions": metadata_versions, "delete_cascade": delete_cascade, "live_entities": live_entities, "update_drift": update_drift,
    "calibrate_links": calibrated_links, "drift_worklist": drift_worklist, "drift_rules": drift_rules,
}
SQL = {
    "incremental_diff": f"WITH {_IDX} SELECT doc_id, CASE WHEN i.h IS NULL THEN 'new' WHEN d.content_hash IS NULL THEN 'gone' WHEN d.content_hash = i.h THEN 'same' ELSE 'changed' END AS state FROM documents d FULL JOIN idx i USING (doc_id)",
    "files_to_index": f"WITH {NODES}, {FILES} SELECT path, sha256(coalesce(content, '')) = content_hash AS same_hash, path IN (SELECT file_path FROM nodes) AS has_entities FROM files",
    "upsert_documents": """WITH d AS (SELECT project_name, relative_path, doc_id, content_hash, indexed_at FROM documents WHERE project_name IS NOT NULL AND relative_path IS NOT NULL),
      o AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY project_name, relative_path ORDER BY doc_id DESC) AS n FROM d WHERE doc_id % 3 <> 0) WHERE n = 1),
      w AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY project_name, relative_path ORDER BY doc_id DESC) AS n FROM d WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) WHERE n = 1)
      SELECT coalesce(w.project_name, o.project_name) AS project_name, coalesce(w.relative_path, o.relative_path) AS relative_path, coalesce(w.doc_id, o.doc_id) AS doc_id, CASE WHEN w.doc_id IS NOT NULL THEN w.content_hash ELSE o.content_hash END AS content_hash, coalesce(o.indexed_at, w.indexed_at) AS indexed_at
      FROM o FULL JOIN w ON w.project_name = o.project_name AND w.relative_path = o.relative_path""",
    "metadata_versions": "SELECT project_name, package, CASE WHEN last_indexed_at IS NOT NULL THEN 2 ELSE 1 END AS version FROM projects",
    "delete_cascade": f"""WITH {_C}, {_L}, {_A}, g AS (SELECT doc_id FROM documents WHERE drift_status IN ('minor_drift', 'major_drift')), dc AS (SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM g))
      SELECT 'documents' AS table_name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'document_chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM g)
      UNION ALL SELECT 'document_links', count(*) FROM links WHERE document_chunk_id NOT IN (SELECT chunk_id FROM dc) UNION ALL SELECT 'drift_analyses', count(*) FROM analyses WHERE document_chunk_id IS NULL OR document_chunk_id NOT IN (SELECT chunk_id FROM dc)""",
    "live_entities": f"""WITH {NODES}, s AS (SELECT qualified_name, max(indexed_at) AS last_at FROM code_entities GROUP BY 1), g AS (SELECT qualified_name, max(deleted_at) AS deleted_at FROM entity_tombstones GROUP BY 1),
      dead AS (SELECT qualified_name FROM s JOIN g USING (qualified_name) WHERE deleted_at > last_at) SELECT qualified_name, node_type FROM nodes WHERE qualified_name NOT IN (SELECT qualified_name FROM dead) AND (parent_class IS NULL OR parent_class NOT IN (SELECT qualified_name FROM dead))""",
    "update_drift": f"""WITH {_C}, {_A}, w AS (SELECT document_chunk_id AS chunk_id, max(drift_score) AS score, max(CASE WHEN drift_detected THEN 1 ELSE 0 END) AS hit FROM analyses WHERE document_chunk_id IS NOT NULL GROUP BY 1)
      SELECT c.chunk_id, coalesce(CASE WHEN hit = 0 THEN 'aligned' WHEN score >= 0.5 THEN 'major_drift' WHEN hit = 1 THEN 'minor_drift' END, c.drift_status) AS drift_status, score FROM chunks c LEFT JOIN w USING (chunk_id)""",
    "calibrate_links": f"WITH {NODES}, {_L} SELECT link_id, start_line AS line_range_start, end_line AS line_range_end, coalesce(l.line_range_start IS NOT NULL AND l.line_range_end IS NOT NULL AND l.line_range_end - l.line_range_start <> end_line - start_line, false) AS needs_review FROM links l JOIN nodes ON qualified_name = code_entity_qualified_name",
    "drift_worklist": f"""WITH {NODES}, {FILES}, {_L}, {_C} SELECT link_id, chunk_id, doc_id, code_entity_qualified_name, CASE WHEN n.qualified_name IS NULL THEN 'no_entity' WHEN f.content_hash IS NULL THEN 'no_code' WHEN code_version_hash IS NULL THEN 'never_checked' WHEN code_version_hash = f.content_hash THEN 'fresh' ELSE 'stale' END AS state
      FROM links JOIN chunks ON chunk_id = document_chunk_id LEFT JOIN nodes n ON n.qualified_name = code_entity_qualified_name LEFT JOIN files f ON f.path = n.file_path""",
    "drift_rules": f"WITH {_A} SELECT analysis_id, CASE WHEN coalesce(drift_detected, false) THEN CASE drift_severity WHEN 'minor' THEN 'minor_drift' WHEN 'major' THEN 'major_drift' WHEN 'minor_drift' THEN 'minor_drift' WHEN 'major_drift' THEN 'major_drift' ELSE 'aligned' END ELSE 'aligned' END AS severity, CASE WHEN coalesce(drift_detected, false) THEN coalesce(drift_score, 0.5) ELSE 0 END AS score FROM analyses",
}
