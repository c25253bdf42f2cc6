"""Scores of graph and vector results, their merge by key, and the caps per file and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import INTENT_WEIGHTS, SETTINGS
from ..plans.planner import entity_names
from ..session import cut_lineage, table
from .graph import EDGES, NODES, calls, latest

S = SETTINGS


def key_of(path: Column, name: Column, line: Column) -> Column:
    """Results are the same if file, name and first line are; a missing line is part of the key."""
    return F.concat_ws(":", path, name, F.coalesce(line.cast("string"), F.lit("None")))


def weights(intent: Column) -> tuple[Column, Column]:
    g = F.create_map(*[F.lit(x) for k, (a, _) in INTENT_WEIGHTS.items() for x in (k, a)])
    v = F.create_map(*[F.lit(x) for k, (_, b) in INTENT_WEIGHTS.items() for x in (k, b)])
    return F.coalesce(g[intent], F.lit(S.graph_weight)), F.coalesce(v[intent], F.lit(S.vector_weight))


def entity_match(name: Column, asked: Column) -> Column:
    low = F.lower(name)
    return F.when(F.array_contains(asked, low), 1.0).when(F.exists(asked, lambda q: low.contains(q)), S.partial_match).otherwise(0.0)


def base_score(role: Column, depth: Column) -> Column:
    far = F.greatest(F.lit(S.min_depth_score), 1.0 - (F.coalesce(depth, F.lit(1)) - 1) * S.depth_decay)
    return F.when(role.isin("caller", "callee"), far).otherwise(F.lit(1.0))


def relationship_score(role: Column) -> Column:
    return F.when(role.isNull(), 1.0).when(role == "caller", 0.8).when(role == "callee", 0.7).otherwise(0.5)


def said(size: str) -> Column:
    return (F.coalesce(F.col(size), F.lit(0)) > 0).cast("double")


def quality(n: Column) -> Column:
    """By the length of the code."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when((n > 100) & (n < 2000), 0.8).when((n > 50) & (n < 3000), 0.5).otherwise(0.3)


def asked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "search_queries")
    g, v = weights(F.col("primary_intent"))
    return q.select("query_id", g.alias("gw"), v.alias("vw"), F.transform(entity_names(F.col("query_text")), lambda x: F.lower(x)).alias("asked"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per result and side: query_id, seq, key, side, file_path, entity_name, score.

    Graph rows come before vector rows; inside each by depth and id.
    """
    q = asked_queries(spark, sf_dir)
    r = table(spark, sf_dir, "ranked_results").select("result_id", "query_id", "file_path", "entity_name", "qualified_name", "start_line", "source", "depth_from_query", "relationship_path", F.col("signal_scores")["vector_similarity"].alias("similarity")).distinct()
    # of the texts only their lengths count, so only those are shuffled; of the graph only what touches a result
    sizes = [F.coalesce(F.length(c), F.lit(0)).alias(f"n_{c}") for c in ("signature", "docstring", "code")]
    ents = table(spark, sf_dir, "code_entities").select("qualified_name", "indexed_at", *sizes)
    n = latest(ents, "qualified_name", ["n_signature", "n_docstring", "n_code"], "indexed_at")
    wanted = r.select("qualified_name").where("qualified_name IS NOT NULL").distinct()
    ends = calls(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("qualified_name"))
    d = ends.join(wanted, "qualified_name", "left_semi").groupBy("qualified_name").agg(F.least(F.lit(1.0), F.count("*") / S.centrality_norm).alias("central"))
    # read for both sides below
    rows = cut_lineage(r.join(q, "query_id").join(n, "qualified_name", "left").join(d, "qualified_name", "left").withColumn("central", F.coalesce("central", F.lit(0.0))))
    em = entity_match(F.col("entity_name"), F.col("asked"))
    context = said("n_docstring") * 0.2 + said("n_signature") * 0.2 + said("n_code") * 0.3
    graph = base_score(F.col("relationship_path"), F.col("depth_from_query")) * F.col("gw") + em * S.entity_bonus + relationship_score(F.col("relationship_path")) * S.relationship_bonus + F.col("central") * S.centrality_weight + context * S.context_weight
    vector = F.coalesce("similarity", F.lit(0.0)) * F.col("vw") + em * S.entity_bonus + F.col("central") * S.centrality_weight + quality(F.col("n_code")) * S.quality_weight
    common = ["query_id", "result_id", key_of(F.col("file_path"), F.col("entity_name"), F.col("start_line")).alias("key"), "file_path", "entity_name", F.coalesce("depth_from_query", F.lit(1)).alias("depth")]
    a = rows.where(F.col("source").isin("graph", "hybrid")).select(*common, F.lit(0).alias("side"), graph.alias("score"))
    b = rows.where(F.col("source").isin("vector", "hybrid")).select(*common, F.lit(1).alias("side"), vector.alias("score"))
    return a.unionByName(b)


def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("side = 0").select("query_id", "result_id", F.round("score", 6).alias("score"))


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("side = 1").select("query_id", "result_id", F.round("score", 6).alias("score"))


def merged(rows: DataFrame) -> DataFrame:
    """Rows of one key folded in order, s = (s + x) / 2 * 1.1: not associative, so the few rows of a key are sorted."""
    folded = rows.groupBy("query_id", "key").agg(F.array_sort(F.collect_list(F.struct("side", "depth", "result_id", "score"))).alias("a"), F.min("file_path").alias("file_path"), F.min("entity_name").alias("entity_name"), F.count_distinct("side").alias("sides"))
    score = F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), F.col("a")[0]["score"], lambda s, x: (s + x["score"]) / 2 * S.merge_bonus)
    source = F.when(F.size("a") > 1, "hybrid").when(F.col("a")[0]["side"] == 0, "graph").otherwise("vector")
    return folded.select("query_id", "key", "file_path", "entity_name", F.round(score, 9).alias("score"), source.alias("source"))


def capped(rows: DataFrame, per_file: int = S.per_file, total: int = S.total) -> DataFrame:
    """The best of each query, at most ``per_file`` of a file and ``total`` in all."""
    by_file = Window.partitionBy("query_id", "file_path").orderBy(F.desc("score"), "key")
    in_all = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    few = rows.withColumn("_f", F.row_number().over(by_file)).where(F.col("_f") <= per_file).drop("_f")
    return few.withColumn("rank", F.row_number().over(in_all)).where(F.col("rank") <= total)


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(merged(scored(spark, sf_dir))).select("query_id", "rank", "key", "source", "score")


def fuse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple fusion: a constant for graph results plus the weighted similarity of vector results, capped per file."""
    r = table(spark, sf_dir, "ranked_results").select("result_id", "query_id", "file_path", "entity_name", "start_line", "source", F.col("signal_scores")["vector_similarity"].alias("similarity")).distinct()
    key = key_of(F.col("file_path"), F.col("entity_name"), F.col("start_line"))
    g = F.when(F.col("source").isin("graph", "hybrid"), S.rerank_graph).otherwise(0.0)
    v = F.when(F.col("source").isin("vector", "hybrid"), F.coalesce("similarity", F.lit(0.0)) * S.rerank_vector).otherwise(0.0)
    per = r.groupBy("query_id", key.alias("key"), "file_path").agg(F.round(F.max(g) + F.max(v), 9).alias("score"))
    return capped(per, S.rerank_per_file, 10**9).select("query_id", "rank", "key", F.round("score", 6).alias("score"))


def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each query on the range 0 to 1; one value alone is 1."""
    s = table(spark, sf_dir, "search_results").select("query_id", "result_id", "score").distinct()
    ends = s.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.join(ends, "query_id").select("query_id", "result_id", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0), 6).alias("score"))


def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each signal over the results of a key."""
    r = table(spark, sf_dir, "ranked_results")
    flat = r.select("query_id", key_of(F.col("file_path"), F.col("entity_name"), F.col("start_line")).alias("key"), F.explode("signal_scores").alias("signal", "value"))
    return flat.groupBy("query_id", "key", "signal").agg(F.max("value").alias("value"))


def centrality_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose degree a query needs: its first five graph and first five vector results, each entity once."""
    r = table(spark, sf_dir, "ranked_results").where("qualified_name IS NOT NULL").select("query_id", "qualified_name", "result_id", "source", F.coalesce("depth_from_query", F.lit(1)).alias("depth"), F.coalesce(F.col("signal_scores")["vector_similarity"], F.lit(0.0)).alias("similarity")).distinct()
    parts = []
    for sources, order in ((("graph", "hybrid"), [F.asc("depth"), F.asc("result_id")]), (("vector", "hybrid"), [F.desc("similarity"), F.asc("result_id")])):
        w = Window.partitionBy("query_id").orderBy(*order)
        parts.append(r.where(F.col("source").isin(*sources)).withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "qualified_name"))
    return parts[0].unionByName(parts[1]).distinct()


_W = lambda i: " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in INTENT_WEIGHTS.items())
SCORED = rf"""{EDGES}, dg AS (SELECT q, least(1.0::DOUBLE, count(*) / 50.0::DOUBLE) AS central FROM (SELECT src AS q FROM e_calls UNION ALL SELECT dst FROM e_calls) GROUP BY 1),
  asks AS (SELECT query_id, CASE primary_intent {_W(0)} ELSE 0.5 END::DOUBLE AS gw, CASE primary_intent {_W(1)} ELSE 0.5 END::DOUBLE AS vw,
    list_transform(list_concat(regexp_extract_all(query_text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1), regexp_extract_all(query_text, '\b([a-z]+(?:_[a-z]+)+)\b', 1), regexp_extract_all(query_text, '`([^`]+)`', 1)), lambda x: lower(x)) AS asked FROM search_queries),
  res AS (SELECT DISTINCT result_id, query_id, file_path, entity_name, qualified_name, start_line, source, depth_from_query, relationship_path AS role, signal_scores['vector_similarity'] AS sim FROM ranked_results),
  rows0 AS (SELECT r.*, a.gw, a.vw, coalesce(dg.central, 0) AS central, concat_ws(':', r.file_path, r.entity_name, coalesce(CAST(r.start_line AS VARCHAR), 'None')) AS key,
      CASE WHEN list_contains(a.asked, lower(r.entity_name)) THEN 1.0 WHEN len(list_filter(a.asked, lambda x: contains(lower(r.entity_name), x))) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS em,
      (CASE WHEN coalesce(n.docstring, '') <> '' THEN 0.2 ELSE 0 END + CASE WHEN coalesce(n.signature, '') <> '' THEN 0.2 ELSE 0 END + CASE WHEN coalesce(n.code, '') <> '' THEN 0.3 ELSE 0 END)::DOUBLE AS ctx,
      CASE WHEN coalesce(length(n.code), 0) = 0 THEN 0.0 WHEN length(n.code) > 100 AND length(n.code) < 2000 THEN 0.8 WHEN length(n.code) > 50 AND length(n.code) < 3000 THEN 0.5 ELSE 0.3 END::DOUBLE AS quality
    FROM res r JOIN asks a USING (query_id) LEFT JOIN nodes n ON n.qualified_name = r.qualified_name LEFT JOIN dg ON dg.q = r.qualified_name AND n.qualified_name IS NOT NULL),
  sc AS (SELECT query_id, result_id, key, file_path, coalesce(depth_from_query, 1) AS depth, 0 AS side,
      CASE WHEN role IN ('caller', 'callee') THEN greatest(0.3::DOUBLE, 1.0::DOUBLE - (coalesce(depth_from_query, 1) - 1) * 0.2::DOUBLE) ELSE 1.0::DOUBLE END * gw + em * 0.3::DOUBLE
      + CASE WHEN role IS NULL THEN 1.0 WHEN role = 'caller' THEN 0.8 WHEN role = 'callee' THEN 0.7 ELSE 0.5 END::DOUBLE * 0.15::DOUBLE + central * 0.2::DOUBLE + ctx * 0.1::DOUBLE AS score FROM rows0 WHERE source IN ('graph', 'hybrid')
    UNION ALL SELECT query_id, result_id, key, file_path, coalesce(depth_from_query, 1), 1, coalesce(sim, 0)::DOUBLE * vw + em * 0.3::DOUBLE + central * 0.2::DOUBLE + quality * 0.1::DOUBLE FROM rows0 WHERE source IN ('vector', 'hybrid'))"""

QUERIES = {"graph_score": graph_scores, "vector_score": vector_scores, "hybrid_rank": hybrid_rank, "fuse_results": fuse_results, "normalize_scores": normalised_scores, "merged_signals": merged_signals, "centrality_candidates": centrality_candidates}
SQL = {
    "graph_score": f"WITH {SCORED} SELECT query_id, result_id, round(score, 6) AS score FROM sc WHERE side = 0",
    "vector_score": f"WITH {SCORED} SELECT query_id, result_id, round(score, 6) AS score FROM sc WHERE side = 1",
    "hybrid_rank": f"""WITH {SCORED}, l AS (SELECT query_id, key, min(file_path) AS file_path, list(score ORDER BY side, depth, result_id) AS a, min(side) AS side FROM sc GROUP BY 1, 2),
      m AS (SELECT query_id, key, file_path, round(list_reduce(a, lambda s, x: (s + x) / 2 * 1.1::DOUBLE), 9) AS score, CASE WHEN len(a) > 1 THEN 'hybrid' WHEN side = 0 THEN 'graph' ELSE 'vector' END AS source FROM l),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, key) AS n FROM m) WHERE n <= 5)
      SELECT query_id, rank, key, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM f) WHERE rank <= 50""",
    "fuse_results": """WITH r AS (SELECT DISTINCT result_id, query_id, file_path, source, signal_scores['vector_similarity'] AS sim, concat_ws(':', file_path, entity_name, coalesce(CAST(start_line AS VARCHAR), 'None')) AS key FROM ranked_results),
      p AS (SELECT query_id, key, file_path, round(max(CASE WHEN source IN ('graph', 'hybrid') THEN 0.4 ELSE 0 END::DOUBLE) + max(CASE WHEN source IN ('vector', 'hybrid') THEN coalesce(sim, 0)::DOUBLE * 0.6::DOUBLE ELSE 0 END), 9) AS score FROM r GROUP BY 1, 2, 3),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, key) AS n FROM p) WHERE n <= 3)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, key, round(score, 6) AS score FROM f""",
    "normalize_scores": "SELECT query_id, result_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM (SELECT DISTINCT query_id, result_id, score FROM search_results) JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM search_results GROUP BY 1) USING (query_id)",
    "merged_signals": "SELECT query_id, key, signal, max(value) AS value FROM (SELECT query_id, concat_ws(':', file_path, entity_name, coalesce(CAST(start_line AS VARCHAR), 'None')) AS key, unnest(map_keys(signal_scores)) AS signal, unnest(map_values(signal_scores)) AS value FROM ranked_results) GROUP BY 1, 2, 3",
    "centrality_candidates": """WITH r AS (SELECT DISTINCT query_id, qualified_name, result_id, source, coalesce(depth_from_query, 1) AS depth, coalesce(signal_scores['vector_similarity'], 0) AS sim FROM ranked_results WHERE qualified_name IS NOT NULL)
      SELECT query_id, qualified_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, result_id) AS n FROM r WHERE source IN ('graph', 'hybrid')) WHERE n <= 5
      UNION SELECT query_id, qualified_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, result_id) AS n FROM r WHERE source IN ('vector', 'hybrid')) WHERE n <= 5""",
}
