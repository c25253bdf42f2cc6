"""Problem 9: containers of fixed capacity filled by first-fit decreasing over a tournament tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship, table
from .tokens import count_tokens

CAPACITY = 2048
#: Items a group holds on average; groups are packed apart, each leaving at most a few open containers.
GROUP_ITEMS = 8192


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item.  The tree's inner nodes hold the larger room of their children, so the first
    container with room is found by one walk from the root; the leaves are containers in order of opening."""
    order = np.argsort(-sizes, kind="stable")
    width = 1
    while width < max(len(sizes), 1):
        width *= 2
    room = [capacity] * (2 * width)
    out = np.empty(len(sizes), np.int64)
    for i in order.tolist():
        need, node = int(sizes[i]), 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        out[i] = node - width
        room[node] -= need
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: container_id, ``key``, piece, token_offset, n_tokens.

    Items of size null or under 1 take no room and are left out.  Only an item larger than ``capacity`` is split, into
    full pieces and a rest.  Repeated keys are packed as items of their own.  Items are dealt to groups by a hash of
    key and piece, so no key, however frequent or large, makes a group large.  ``items`` is read twice, once to count it,
    and should be a stored table.
    """
    pieces = (
        items.select(F.col(key), F.col(size).cast("long").alias("_size"))
        .where(F.col("_size") > 0)
        .select(key, "_size", F.explode(F.expr(f"sequence(0L, (_size - 1) div {capacity})")).alias("piece"))
        .select(key, "piece", (F.col("piece") * capacity).alias("token_offset"), F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("piece") * capacity).alias("n_tokens"))
    )
    ship(items.sparkSession)
    groups = max(1, -(-items.count() // group_items))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(key, "piece", F.lit(17)), F.lit(groups)))
    key_type = items.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable")
        bins = first_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        return pdf.assign(container_id=pdf["_group"].to_numpy() * (1 << 32) + bins)[["container_id", key, "piece", "token_offset", "n_tokens"]]

    return dealt.groupBy("_group").applyInPandas(run, f"container_id long, `{key}` {key_type}, piece long, token_offset long, n_tokens long")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") > 0)
    return pack(cut_lineage(count_tokens(docs)), "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens held and share of room used, over the whole corpus."""
    per = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 4).alias("fill"))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
