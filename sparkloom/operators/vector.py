"""Cosine search: payload filters first, then block products, then the best k of each query; exact, or by lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..session import cut_lineage, ship, table

#: Rows and queries of a block, and numbers in the vectors of one at most: a task holds a block of each.
ROW_BLOCK, QUERY_BLOCK, BLOCK_NUMBERS = 32_768, 32_768, 8_388_608
#: Queries and rows of a step within two blocks: its scores, in single precision, stay near a core.
QUERY_STEP, ROW_STEP = 1_024, 2_048


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in the JVM, for few pairs; null if a length is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def _matrix(t: pa.Table) -> np.ndarray:
    parts = [c for c in t["embedding"].chunks if len(c)]
    sizes = {n for c in parts for n in pc.unique(pc.list_value_length(c)).to_pylist()}
    if len(sizes) != 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in parts]).reshape(t.num_rows, sizes.pop())


def _usable(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their lengths, unit vectors in single precision and ids of those that have a direction."""
    n = np.linalg.norm(x.astype(np.float64), axis=1)
    ok = np.isfinite(n) & (n > 0)
    x, n = x[ok], n[ok]
    return x, n, (x / n[:, None]).astype(np.float32), ids[ok]


def _first_of_each(i: np.ndarray, j: np.ndarray, s: np.ndarray, want: int) -> tuple[np.ndarray, ...]:
    """The ``want`` of highest ``s`` for each ``i``, ties to the smaller ``j``; and their places, from 0."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    few = place < want
    return i[few], j[few], s[few], place[few]


def _block_best(k: int, more: int, least: float | None = None):
    """For applyInArrow over a block of queries and one of rows: each query's best rows, ties to the smaller vec_id.

    Products in single precision, with a bound on their error, only say which rows cannot be among the best or reach
    ``least``; what is given is the cosine in double precision, rounded to nine places.
    """
    floor = -np.inf if least is None else least

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, rows, scores = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.float64)]
        if a.num_rows and b.num_rows:
            order = np.argsort(b["vec_id"].to_numpy(), kind="stable")
            x, nx, ux, qid = _usable(_matrix(a), a["query_id"].to_numpy())
            y, ny, uy, vec = _usable(_matrix(b)[order], b["vec_id"].to_numpy()[order])
            want, piece = k + more, max(1, 4_194_304 // max(1, x.shape[1]))
            slack = (x.shape[1] + 8) * 2.0**-23 + 1e-9

            def dense(i: np.ndarray, at: slice) -> tuple[np.ndarray, ...]:
                s = np.round((x[i].astype(np.float64) @ y[at].astype(np.float64).T) / nx[i][:, None] / ny[at][None, :], 9)
                n = min(want, s.shape[1])
                last = -np.partition(-s, n - 1, axis=1)[:, [n - 1]]
                above, tie = s > last, s == last
                g, j = np.nonzero(above | tie & (np.cumsum(tie, axis=1) <= n - above.sum(axis=1, keepdims=True)))
                return i[g], j + at.start, s[g, j]

            def single(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                cut = [slice(c, c + piece) for c in range(0, len(i), piece)]
                return np.round(np.concatenate([np.einsum("ij,ij->i", x[i[c]].astype(np.float64), y[j[c]].astype(np.float64)) / nx[i[c]] / ny[j[c]] for c in cut]), 9)

            for p in range(0, len(x), QUERY_STEP):
                n = len(ux[p : p + QUERY_STEP])
                bar, got, fresh = np.full(n, floor), (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)), 0
                for r in range(0, len(y), ROW_STEP):
                    fast, reach = ux[p : p + n] @ uy[r : r + ROW_STEP].T, (bar - slack).astype(np.float32)
                    hit = np.flatnonzero(fast.max(axis=1) >= reach)
                    near = fast[hit] >= reach[hit][:, None]
                    if np.count_nonzero(near) * 16 > near.size:
                        i, j, s = dense(hit + p, slice(r, r + ROW_STEP))
                    elif len(hit):
                        i, j = np.nonzero(near)
                        i, j = hit[i] + p, j + r
                        s = single(i, j)
                    else:
                        continue
                    ok = s >= floor
                    got, fresh = tuple(np.concatenate(c) for c in zip(got, (i[ok] - p, j[ok], s[ok]))), fresh + int(ok.sum())
                    if 2 * fresh >= want * n:
                        *got, place = _first_of_each(*got, want)
                        full = place == want - 1
                        bar[got[0][full]], fresh = got[2][full], 0
                i, j, s, _ = _first_of_each(*got, want)
                ids.append(qid[i + p])
                rows.append(vec[j])
                scores.append(s)
        return pa.table({"query_id": pa.array(np.concatenate(ids), pa.int64()), "vec_id": pa.array(np.concatenate(rows), pa.int64()), "score": pa.array(np.concatenate(scores), pa.float64())})

    return best


def _ranked(got: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(queries: DataFrame, rows: DataFrame, k: int, same: str | None = None, exclude_self: bool = False, least: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: for each of ``queries`` (query_id, embedding) the k rows (vec_id, embedding) of highest cosine.

    Both sides are cut into blocks and every block of queries meets every block of rows, so neither side is collected
    or broadcast whatever its size; each pair of blocks gives only its own best k.  With ``same`` only rows that agree
    with the query in that column count: each of its values has as many blocks as its own queries and rows fill, since
    a query is sent once per block of rows and a row once per block of queries.  Equal scores go to the smaller
    vec_id; null and zero vectors are left out, and so are scores under ``least``.
    """
    ship(rows.sparkSession)
    q, r = (df.where("embedding IS NOT NULL").select(*[F.col(x).alias(x) for x in (c, "embedding")], (F.col(same) if same else F.lit(0)).alias("_same")) for df, c in ((queries, "query_id"), (rows, "vec_id")))
    longest = F.floor(F.lit(BLOCK_NUMBERS) / F.greatest(F.max(F.size("embedding")), F.lit(1)))
    count = lambda block: F.ceil(F.count("*") / F.greatest(F.least(longest, F.lit(block)), F.lit(1)))
    nq = q.groupBy("_same").agg(count(QUERY_BLOCK).alias("_nq"))
    nr = r.groupBy(F.col("_same").alias("_of")).agg(count(ROW_BLOCK).alias("_nr"))
    # values of more than one block: no more of them than all queries and rows fill blocks
    large = F.broadcast(nq.join(nr, F.col("_same").eqNullSafe(F.col("_of"))).where("_nq > 1 OR _nr > 1").select("_of", "_nq", "_nr"))
    blocks = lambda n: F.coalesce(n, F.lit(1)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col(n)) - 1))
    q = q.join(large, F.col("_same").eqNullSafe(F.col("_of")), "left").withColumn("_qb", F.pmod(F.xxhash64("query_id"), blocks(F.col("_nq")))).withColumn("_rb", every("_nr")).drop("_of", "_nq", "_nr")
    r = r.join(large, F.col("_same").eqNullSafe(F.col("_of")), "left").withColumn("_rb", F.pmod(F.xxhash64("vec_id"), blocks(F.col("_nr")))).withColumn("_qb", every("_nq")).drop("_of", "_nq", "_nr")
    keys = ["_same", "_qb", "_rb"]
    got = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_block_best(k, int(exclude_self), least), "query_id long, vec_id long, score double")
    return _ranked(got.where("query_id <> vec_id") if exclude_self else got, k)


# -- an index of lists ------------------------------------------------------------------------------------------------
#: Rows the centres are fitted on at most, centres at most, and turns of the fit.  The sample fits the centres alone;
#: every row is indexed.
FIT_ROWS, FIT_LISTS, FIT_TURNS = 20_000, 1_024, 10
#: Recall aimed at, and rows of the sample the number of lists to look into is fitted on.
FIT_RECALL, FIT_QUERIES = 0.96, 500


def fit_index(rows: DataFrame, k: int = SETTINGS.search_limit, lists: int | None = None) -> tuple[np.ndarray, int]:
    """(centres, number of lists to look into) from the ``FIT_ROWS`` rows of smallest hash.

    The centres are those of spherical k-means, about one per 64 rows.  The number is the least with which the ``k``
    nearest rows of ``FIT_QUERIES`` rows within the sample are found at a rate of ``FIT_RECALL``: few where vectors
    lie in clusters, most of the lists where they have no structure.
    """
    got = rows.where("embedding IS NOT NULL").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).toPandas()
    if not len(got):
        return np.zeros((1, 1)), 1
    x = np.stack(got["embedding"].to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.zeros((1, len(got["embedding"].iloc[0]))), 1
    n = min(lists or max(1, len(x) // 64), FIT_LISTS, len(x))
    centres = x[np.random.default_rng(0).choice(len(x), n, replace=False)]
    for _ in range(FIT_TURNS):
        mine = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, mine, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centres)
    q = x[:FIT_QUERIES]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    mine = np.argmax(x @ centres.T, axis=1)
    turn = np.take_along_axis(place, mine[near], axis=1)
    return centres, int(np.ceil(np.quantile(turn, FIT_RECALL))) + 1


def nearest_lists(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``df`` with ``lists``: the numbers of the ``n`` centres nearest to its embedding; none for null and zero vectors."""
    ship(df.sparkSession)

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        def one(e):
            if e is None or not np.any(e):
                return []
            s = centres @ np.asarray(e, np.float64)
            return np.argsort(-s, kind="stable")[:n].astype(np.int32)

        return v.map(one)

    return df.withColumn("lists", near("embedding"))


def ivf_search(queries: DataFrame, rows: DataFrame, k: int, index: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """Like ``knn``, but each query looks only into the lists of the centres nearest to it.

    Every row lies in the list of its nearest centre.  A list of more than ``ROW_BLOCK`` rows is cut into blocks that
    the queries for it all meet, so one list may hold any share of the rows.  ``knn`` is the exact way beside it.
    """
    centres, probes = index or fit_index(rows, k)
    r = cut_lineage(nearest_lists(rows, centres, 1).select("vec_id", "embedding", F.get("lists", F.lit(0)).alias("list")).where("list IS NOT NULL"))
    blocks = r.groupBy("list").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("blocks"))  # a row per centre
    r = r.join(F.broadcast(blocks), "list").withColumn("_rb", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("list", "_rb", "vec_id", "embedding")
    q = nearest_lists(queries, centres, probes).select("query_id", "embedding", F.explode("lists").alias("list")).join(F.broadcast(blocks), "list")
    q = q.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_rb"), "query_id", "embedding")
    got = q.groupBy("list", "_rb").cogroup(r.groupBy("list", "_rb")).applyInArrow(_block_best(k, 0), "query_id long, vec_id long, score double")
    return _ranked(got, k)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(asked(spark, sf_dir), _rows(spark, sf_dir), SETTINGS.search_limit).select("query_id", "vec_id", "score", "rank")


def vector_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the index of lists: fewer rows are met, and its recall is that of ``ivf_recall``."""
    return ivf_search(asked(spark, sf_dir), _rows(spark, sf_dir), SETTINGS.search_limit).select("query_id", "vec_id", "score", "rank")


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact best rows that the index of lists finds, over the stated query set."""
    exact = vector_topk(spark, sf_dir).select("query_id", "vec_id")
    found = vector_topk_ivf(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of the query's own label: the payload filter."""
    return knn(asked(spark, sf_dir), _rows(spark, sf_dir), SETTINGS.search_limit, same="label").select("query_id", "vec_id", "score", "rank")


def similar_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar rows without the row itself, which is left out before the best are cut."""
    return knn(asked(spark, sf_dir), _rows(spark, sf_dir), 10, exclude_self=True).select("query_id", "vec_id", "score", "rank")


def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n_points"), F.max(F.size("embedding")).alias("dimensions"))


def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the label of a query is that of its nearest neighbours."""
    near = knn(asked(spark, sf_dir), _rows(spark, sf_dir), 5, exclude_self=True)
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    got = near.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return got.groupBy("own").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("own")).alias("n_same")).withColumnRenamed("own", "label")


def changed_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection after an upsert that moves every tenth vector to the next label and a delete of label 3."""
    from .changes import upsert

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    moved = e.where("vec_id % 10 = 0").select("vec_id", ((F.col("label") + 1) % 10).cast("int").alias("label"))
    return upsert(e, moved, ["vec_id"]).where("label <> 3").groupBy("label").agg(F.count("*").alias("n_points"), F.sum("vec_id").alias("id_sum"))


def _knn_sql(k: int, extra: str = "") -> str:
    return f"""SELECT query_id, vec_id, round(s, 9) AS score, rank FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 {extra})) WHERE rank <= {k}"""


QUERIES = {"vector_topk": vector_topk, "vector_topk_ivf": vector_topk_ivf, "ivf_recall": ivf_recall, "vector_topk_filtered": vector_topk_filtered, "similar_exclude": similar_exclude, "collection_info": collection_info, "nearest_label": nearest_label, "vector_changes": changed_collection}
SQL = {
    "vector_topk": _knn_sql(15),
    "vector_topk_filtered": _knn_sql(15, "AND q.label = r.label"),
    "similar_exclude": _knn_sql(10, "AND q.vec_id <> r.vec_id"),
    "collection_info": "SELECT label, count(*) AS n_points, max(len(embedding))::INTEGER AS dimensions FROM embeddings GROUP BY label",
    "nearest_label": f"SELECT q.label, count(*) AS n, count(*) FILTER (WHERE r.label = q.label) AS n_same FROM ({_knn_sql(5, 'AND q.vec_id <> r.vec_id')}) n JOIN embeddings q ON q.vec_id = n.query_id JOIN embeddings r ON r.vec_id = n.vec_id GROUP BY q.label",
    "vector_changes": "SELECT label, count(*) AS n_points, sum(vec_id)::BIGINT AS id_sum FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings) WHERE label <> 3 GROUP BY label",
}
