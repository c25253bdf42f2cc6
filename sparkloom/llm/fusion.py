"""Problem 3: one ranking from scores on different scales, by reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, table

#: The constant of reciprocal rank fusion (Cormack, Clarke and Buettcher, 2009).
K = 60
#: The signals a ranked result may carry.  Fixed values of the data model.
SIGNALS = ("graph_match", "vector_similarity", "query_entity_match", "relationship_relevance", "centrality", "context_richness", "code_quality")
#: Distinct scores of one list that one task ranks; longer lists are cut at quantiles and ranked in blocks.
BLOCK = 200_000


def list_ranks(scores: DataFrame, group: list[str], score: str, block: int = BLOCK) -> DataFrame:
    """``group``, ``score``, ``rank`` (1 = highest; equal scores share the rank of the first) of each distinct score.

    Rows are first counted per distinct score, so ties and repeated rows cost one row.  A list with more than
    ``block`` distinct scores is cut at approximate quantiles, twice as many as the longest list has blocks; each part
    is ranked apart and shifted by what lies in the parts above it, so that no task holds more than about a block.
    """
    n = scores.groupBy(*group, score).agg(F.count("*").alias("_n"))
    sizes = n.groupBy(*group).count().where(F.col("count") > block)
    long_lists = sizes.drop("count")
    if scores.count() <= block or long_lists.isEmpty():
        w = Window.partitionBy(*group).orderBy(F.desc(score))
        above = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return n.select(*group, score, (F.coalesce(above, F.lit(0)) + 1).alias("rank"))
    # at most (rows / block) lists are long, so the table of their cuts may be broadcast
    parts = 2 * -(-sizes.agg(F.max("count")).first()[0] // block)
    cuts = n.join(F.broadcast(long_lists), group, "left_semi").groupBy(*group).agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 16 * parts).alias("_cuts"))
    cut = n.join(F.broadcast(cuts), group, "left").withColumn("_block", F.coalesce(F.size(F.filter("_cuts", lambda c: c > F.col(score))), F.lit(0))).drop("_cuts")
    per = cut.groupBy(*group, "_block").agg(F.sum("_n").alias("_in"))
    wb = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "_block", F.coalesce(F.sum("_in").over(wb), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*group, "_block").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_above", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(per, [*group, "_block"]).select(*group, score, (F.col("_above") + F.col("_before") + 1).alias("rank"))


def reciprocal_rank_fusion(items: DataFrame, query: str, item: str, scores: list[str], k: int = K, block: int = BLOCK) -> DataFrame:
    """``query``, ``item``, ``rrf``, ``n_scores``, ``position``: the items of each query by Σ 1 / (k + rank).

    ``scores`` are numeric columns, higher is better.  A null or NaN score gives no rank in that list and no term in
    the sum: it neither helps nor moves others.  Equal scores share a rank; equal sums are ordered by ``item``.
    Repeated (query, item) rows count once, with the largest of each score; rows with a null query or item are left
    out.  An empty table gives an empty table.
    """
    one = cut_lineage(items.where(F.col(query).isNotNull() & F.col(item).isNotNull()).groupBy(query, item).agg(*[F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores]))  # read twice below
    lists = one.select(query, item, F.explode(F.array(*[F.struct(F.lit(i).alias("_list"), F.col(s).alias("_score")) for i, s in enumerate(scores)])).alias("_e")).select(query, item, "_e._list", "_e._score")
    ranks = list_ranks(lists.where(F.col("_score").isNotNull()), [query, "_list"], "_score", block)
    terms = lists.join(ranks, [query, "_list", "_score"], "left")
    return terms.groupBy(query, item).agg(F.round(F.sum(F.coalesce(1 / (F.lit(float(k)) + F.col("rank")), F.lit(0.0))), 12).alias("rrf"), F.count("rank").alias("n_scores"))


def top(fused: DataFrame, query: str, item: str, n: int) -> DataFrame:
    """The ``n`` best of each query; the window's group limit keeps n rows per query before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc("rrf"), F.asc(item))
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "ranked_results").select("query_id", "result_id", *[F.col("signal_scores")[s].alias(s) for s in SIGNALS])
    found = table(spark, sf_dir, "search_results").where(F.col("result_id").isNotNull()).groupBy("result_id").agg(F.max("score").alias("search_score"))
    return ranked.join(found, "result_id", "left")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result of every query with its fused score."""
    return reciprocal_rank_fusion(scored_results(spark, sf_dir), "query_id", "result_id", [*SIGNALS, "search_score"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(p3_ranking(spark, sf_dir), "query_id", "result_id", 3).select("query_id", "result_id")


_RANKING_SQL = f"""
SELECT query_id, result_id, round(coalesce(sum(1.0::DOUBLE / ({K} + rk)), 0), 12) AS rrf, count(rk) AS n_scores FROM (
  SELECT query_id, result_id, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY query_id, list ORDER BY score DESC NULLS LAST) END AS rk FROM (
    SELECT query_id, result_id, list, max(score) AS score FROM (
      {" UNION ALL ".join(f"SELECT query_id, result_id, '{s}' AS list, signal_scores['{s}'] AS score FROM ranked_results" for s in SIGNALS)}
      UNION ALL SELECT r.query_id, r.result_id, 'search_score', s.score FROM ranked_results r LEFT JOIN search_results s USING (result_id)
    ) GROUP BY query_id, result_id, list))
GROUP BY query_id, result_id"""

QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
SQL = {
    "p3_ranking": _RANKING_SQL,
    "p3_found": f"SELECT query_id, result_id FROM (SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, result_id) AS n FROM ({_RANKING_SQL})) WHERE n <= 3",
}
