"""Implicit links from documents to code by similarity, and what a model's judgement of drift means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.ports import Embed, embed_column
from ..plans.planner import salvage
from ..session import cut_lineage
from .chunking import entity_text
from .graph import nodes
from .lookup import chunks
from .vector import knn

#: Confidence by relevance, and the similarity from which each is taken where no model judges.  Fixed values.
RELEVANCE = (("high", 0.9, 0.8), ("medium", 0.7, 0.65), ("low", 0.5, 0.5))


def implicit_links(docs: DataFrame, entities: DataFrame, port: Embed | None = None, candidates: int = SETTINGS.link_candidates, shown: int = SETTINGS.links_per_chunk) -> DataFrame:
    """chunk_id, qualified_name, relevance, confidence: the entities of a chunk's own project that are most like it.

    ``docs`` has chunk_id, project_name, content; ``entities`` qualified_name, project_name, content.  Both sides get
    vectors from the port, once, and written with their keys alone: what follows neither embeds nor carries a text
    again.  The search is exact and in blocks per project, for the similarities that some relevance takes.
    """
    from pyspark.sql import Window

    q = cut_lineage(embed_column(docs.where("content IS NOT NULL").withColumn("query_id", F.xxhash64("chunk_id")), "content", port=port).select("query_id", "chunk_id", "project_name", "embedding"))
    r = cut_lineage(embed_column(entities.withColumn("vec_id", F.xxhash64("qualified_name")), "content", port=port).select("vec_id", "qualified_name", "project_name", "embedding"))
    near = knn(q, r, candidates, same="project_name", least=min(x[2] for x in RELEVANCE))
    # names first, chunks last: all that follows is of one query_id, so names are dealt out once
    named = near.select("query_id", "vec_id", "score").join(r.select("vec_id", "qualified_name"), "vec_id").drop("vec_id")
    best = named.join(q.select("query_id", "chunk_id"), "query_id").groupBy("query_id", "chunk_id", "qualified_name").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "qualified_name")
    few = best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= shown)
    name, confidence = None, None
    for label, value, least in RELEVANCE:
        hit = F.col("score") >= least
        name = F.when(hit, label) if name is None else name.when(hit, label)
        confidence = F.when(hit, value) if confidence is None else confidence.when(hit, value)
    return few.withColumns({"relevance": name, "confidence": confidence}).where("relevance IS NOT NULL").select("chunk_id", "qualified_name", "relevance", "confidence", F.round("score", 6).alias("score"))


def judgement(text: str | None) -> dict:
    """A model's answer about drift as drift_detected, severity, score, issues, summary, relevant.

    An answer that is no JSON counts as drift of the default score if it speaks of drift_detected and true.
    """
    got = salvage(text)
    if got is None:
        low = (text or "").lower()
        hit = "drift_detected" in low and "true" in low
        return {"relevant": True, "drift_detected": hit, "severity": "aligned", "score": SETTINGS.default_drift_score if hit else 0.0, "issues": [], "summary": ""}
    hit = bool(got.get("drift_detected", False))
    severity = {"minor": "minor_drift", "major": "major_drift"}.get(got.get("drift_severity", "none"), "aligned")
    return {"relevant": bool(got.get("relevant", True)), "drift_detected": hit, "severity": severity if hit else "aligned", "score": float(got.get("drift_score") or 0.0) if hit else 0.0, "issues": got.get("issues") or [], "summary": got.get("summary", "")}


def linked_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir, "project_name", "signature", "docstring", "code").where(F.col("node_type").isin("Class", "Function"))
    return implicit_links(chunks(spark, sf_dir, "project_name", "content"), n.select("qualified_name", "project_name", entity_text(n).alias("content")))


QUERIES = {"implicit_links": linked_by_similarity}
SQL: dict[str, str] = {}
