"""Problem 6: oversized items cut at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table

LIMIT = 4000
OVERLAP = 800
#: Kinds of boundary, best first: what a cut there costs, and the pattern whose end is the place of the cut.
BOUNDARIES = (
    ("heading", 0.0, re.compile(r"\n(?=#{1,6}[ \t])")),
    ("blank line", 0.5, re.compile(r"\n[ \t]*\r?\n(?=[^\n])")),
    ("line", 2.0, re.compile(r"\n(?=[^\n])")),
    ("sentence", 4.0, re.compile(r"[.!?][)\"'’”]*[ \t]+|[。！？]")),
    ("word", 8.0, re.compile(r"[^\S\n]+(?=\S)")),
)
INSIDE_WORD = 64.0
#: Cost of a piece of length x: IMBALANCE * (1 - x / limit)², so that pieces are few and even.
IMBALANCE = 6.0


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where the text may be cut and what each cut costs; the ends of the text cost nothing."""
    n = len(text)
    cost = np.full(n + 1, np.inf)
    for _, c, rx in reversed(BOUNDARIES):
        cost[[m.end() for m in rx.finditer(text)]] = c
    cost[[0, n]] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def places(text: str, limit: int, overlap: int) -> tuple[list[int], list[float], list[int]]:
    """Every place a cut may lie at, its cost, and where a piece that follows a cut there starts.

    These are all boundaries and, where ``limit - overlap`` characters go by without one, places inside words that
    far apart.  A piece starts at the first boundary within the overlap before the cut or, if there is none, at the
    overlap's full length before it, so that two pieces always share something.
    """
    every, cost = boundaries(text)
    at, reach = every, max(1, limit - overlap)
    gaps = np.flatnonzero(np.diff(every) > reach)
    if len(gaps):
        more = np.concatenate([np.arange(every[g] + reach, every[g + 1], reach) for g in gaps])
        at, cost = np.concatenate([every, more]), np.concatenate([cost, np.full(len(more), INSIDE_WORD)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    start = every[np.searchsorted(every, at - overlap)]
    start = np.where(start < at, start, np.maximum(at - overlap, 0))
    return at.tolist(), cost.tolist(), start.tolist()


def cuts(at: list[int], cost: list[float], start: list[int], limit: int) -> list[int]:
    """Indices of the cuts of least total cost, by dynamic programming over all places.

    A piece from cut i to cut j adds a convex function of its length, so of two earlier cuts the later one, once it is
    better (or the earlier one is out of reach), stays so.  A queue keeps those earlier cuts that will be the best at
    some place, in the order of their turns; every place is entered and left once.
    """
    n, scale = len(at), IMBALANCE / (limit * limit)
    back = [0] * n
    best = [0.0] * n
    queue, turn = [0], [0.0]  # turn[k]: the place from which queue[k] is better than queue[k - 1]
    value = [scale * limit**2] * n  # best[i] and the part of the piece's cost that only i decides
    front = 0
    for j in range(1, n):
        x = at[j]
        while front + 1 < len(queue) and turn[front + 1] <= x:
            front += 1
        i = queue[front]
        back[j] = i
        best[j] = best[i] + scale * (limit - x + start[i]) ** 2 + cost[j]
        s = start[j]
        mine = value[j] = best[j] + scale * (s + limit) ** 2
        while len(queue) > front:
            i = queue[-1]
            if s == start[i]:
                if mine >= value[i]:
                    break
            else:
                when = min((mine - value[i]) / (2 * scale * (s - start[i])), start[i] + limit + 1)
                if when > turn[-1] or len(queue) - 1 == front:
                    queue.append(j)
                    turn.append(when)
                    break
            queue.pop()
            turn.pop()
        else:
            queue.append(j)
            turn.append(0.0)
    found = [n - 1]
    while found[-1]:
        found.append(back[found[-1]])
    found.reverse()
    return found


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece: text[start:end] has at most ``limit`` characters and text[start:fresh], at
    most ``overlap`` and none in the first, is repeated from the piece before.  The fresh parts join to the text.

    The cuts minimise the cost of the boundaries used plus the imbalance of the pieces, over all boundaries.  A text
    within the limit is one piece; an empty text is one empty piece.  The overlap is less than the limit.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))]
    at, cost, start = places(text, limit, min(overlap, limit - 1))
    found = cuts(at, cost, start, limit)
    return [(start[i] if i else 0, at[i], at[j]) for i, j in zip(found, found[1:])]


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items (item_kind, item_key, context, content) longer than ``limit`` characters (code points).

    Gives item_kind, item_key, piece, n_pieces, start, fresh, end, context, content.  Null contents and contents
    within the limit give no row; of repeated (item_kind, item_key) rows the one with the smallest content hash
    counts.  Contents are read whole, however long.
    """
    long = items.where(F.length("content") > limit).groupBy("item_kind", "item_key").agg(F.min_by(F.struct("context", "content"), F.xxhash64("content")).alias("_v")).select("item_kind", "item_key", "_v.context", "_v.content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["item_kind", "item_key", "piece", "n_pieces", "start", "fresh", "end", "context", "content"]
        for pdf in frames:
            rows = []
            for kind, key, context, content in pdf.itertuples(index=False):
                got = split(content, limit, overlap)
                rows += [(kind, key, i, len(got), s, f, e, context, content[s:e]) for i, (s, f, e) in enumerate(got)]
            yield pd.DataFrame(rows, columns=names)

    # few bytes but much work each: dealt out anew, or the shuffle's small partitions would be joined into a few tasks
    dealt = long.repartition(4 * long.sparkSession.sparkContext.defaultParallelism, "item_kind", "item_key")
    ship(long.sparkSession)
    return dealt.mapInPandas(run, "item_kind string, item_key string, piece int, n_pieces int, start int, fresh int, `end` int, context string, content string")


def oversized_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "document_chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), F.to_json("heading_path").alias("context"), "content")
    code = table(spark, sf_dir, "code_entities").select(F.lit("entity").alias("item_kind"), F.col("qualified_name").alias("item_key"), F.col("qualified_name").alias("context"), F.col("code").alias("content"))
    return chunks.unionByName(code)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(oversized_candidates(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("piece = 0").select("item_kind", "item_key")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
SQL = {
    "p6_found": f"SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_key FROM document_chunks WHERE length(content) > {LIMIT} UNION SELECT DISTINCT 'entity', qualified_name FROM code_entities WHERE length(code) > {LIMIT}",
}
