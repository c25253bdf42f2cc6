"""Problem 7: references to records that do not exist, by bitmaps over dictionary-encoded keys.

Keys are numbered inside hash ranges; references and parents become one compressed bitmap per key range and month: a
list of the bits that are set while they are few, else the bits themselves.  Reference AND-NOT parent leaves the
orphans, whose bits are decoded again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship, table
from .skew import salted_join

#: Keys of a hash range on average, and numbers set aside for each; a bitmap holds 32,768 of them.
RANGE_KEYS, RANGE_WIDTH = 16_384, 1 << 20
#: Period of references without a time: after all others.
NO_TIME = 1 << 20


def month(ts: Column) -> Column:
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(NO_TIME))


def clean_target(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\(\)$", ""), r"\s+$", "")


def dictionary(keys: DataFrame, key: str) -> DataFrame:
    """``key`` and ``_id`` of each distinct key: its range's number times the width plus its place in the range."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    ranges = max(1, -(-distinct.count() // RANGE_KEYS))
    ranged = distinct.withColumn("_range", F.pmod(F.xxhash64(key), F.lit(ranges)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.select(key, (F.col("_range") * RANGE_WIDTH + place).alias("_id"))


#: Bits of a container, and how many of them, at two bytes each, are still kept as a list.
CONTAINER, LISTED = 32_768, 2_048


def bitmaps(encoded: DataFrame, period: str) -> DataFrame:
    """_bucket, _period and the container: _list of the set bits if they are few, else _bits.

    ``encoded`` has a row per bit.  A sparse container is never larger than its bits' two bytes each, neither here nor
    in the shuffle that makes it.
    """
    at = ["_bucket", "_period"]
    bit = F.expr("cast(bitmap_bit_position(_id) AS short)").alias("_bit")
    lists = encoded.select(F.expr("bitmap_bucket_number(_id)").alias("_bucket"), F.col(period).alias("_period"), bit).groupBy(*at).agg(F.collect_list("_bit").alias("_list"))
    few = F.size("_list") <= LISTED
    dense = lists.where(~few).select(*at, F.explode("_list").alias("_bit")).groupBy(*at).agg(F.expr("bitmap_construct_agg(cast(_bit AS bigint))").alias("_bits"))
    sparse = lists.where(few).select(*at, "_list", F.lit(None).cast("binary").alias("_bits"))
    return sparse.unionByName(dense.select(*at, F.lit(None).cast("array<short>").alias("_list"), "_bits"))


def _and_not(key: tuple, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: bits of each month's references that no parent of an earlier month has; those that a parent of
    the very month has are marked to be compared by their time."""

    def places(few, raw) -> np.ndarray:
        if raw is None:
            return np.sort(np.asarray(few, np.int64))
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))

    born = {int(p): places(few, raw) for p, few, raw in zip(parents["_period"], parents["_list"], parents["_bits"])}
    months, at = sorted(born), 0
    seen = np.zeros(CONTAINER, bool)
    out = []
    for period, few, raw in sorted(zip(refs["_period"].tolist(), refs["_list"], refs["_bits"]), key=lambda r: r[0]):
        while at < len(months) and months[at] < period:
            seen[born[months[at]]] = True
            at += 1
        where = places(few, raw)
        where = where[~seen[where]]
        if len(where):
            same = np.zeros(CONTAINER, bool)
            same[born.get(period, where[:0])] = True
            out.append(pd.DataFrame({"_bucket": refs["_bucket"].iloc[0], "_bit": where, "_period": period, "_compare": same[where]}))
    return pd.concat(out) if out else pd.DataFrame({"_bucket": [], "_bit": [], "_period": [], "_compare": []})


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` (ref_table, ref_key, target, at) that refer to nothing.

    ``parents`` has one row per target, with first_at (null: always there); what is gone must have been left out.  A reference is an orphan if no parent has its target or if its time lies before first_at.  References
    without a time are only asked for existence.  A null target is no reference; repeated references give one row.
    Frequent targets are reduced to one bit per month before anything is shuffled by target, and the way back to the
    rows is salted.
    """
    ship(refs.sparkSession)
    # each of these is read several times below, so each is written once
    refs = cut_lineage(refs.select("ref_table", "ref_key", "target", "at").where(F.col("target").isNotNull()).withColumn("_period", month(F.col("at"))))
    asked = cut_lineage(refs.select("target", "_period").distinct())
    words = cut_lineage(dictionary(asked, "target"))
    present = words.join(parents.select("target", "first_at"), "target").withColumn("_first", F.coalesce(F.year("first_at") * 12 + F.month("first_at") - 1, F.lit(-1)))
    ref_bits = bitmaps(asked.join(words, "target"), "_period")
    parent_bits = bitmaps(present, "_first")
    left = ref_bits.groupBy("_bucket").cogroup(parent_bits.groupBy("_bucket")).applyInPandas(_and_not, "_bucket long, _bit long, _period int, _compare boolean")
    # the inverse of bitmap_bucket_number and bitmap_bit_position, which count buckets and values from 1
    ids = left.select(((F.col("_bucket") - 1) * 32768 + F.col("_bit") + 1).alias("_id"), "_period", "_compare")
    named = ids.join(words, "_id").drop("_id")
    timed = named.where("_compare").join(present.select("target", "first_at"), "target")
    sure = named.where("NOT _compare").withColumn("first_at", F.lit(None).cast("timestamp_ntz"))
    hits = salted_join(refs, sure.unionByName(timed.withColumn("first_at", F.col("first_at").cast("timestamp_ntz"))), ["target", "_period"], ["ref_key"])
    return hits.where(~F.col("_compare") | (F.col("first_at") > F.col("at").cast("timestamp_ntz"))).select("ref_table", "ref_key", "target", "at").distinct()


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references of the data: links and analyses with their time, calls into a project's package without."""
    nt = "timestamp_ntz"
    links = table(spark, sf_dir, "document_links").select(F.lit("document_links").alias("ref_table"), F.col("link_id").alias("ref_key"), F.col("code_entity_qualified_name").alias("target"), F.col("created_at").cast(nt).alias("at"))
    drift = table(spark, sf_dir, "drift_analyses").select(F.lit("drift_analyses").alias("ref_table"), F.col("analysis_id").alias("ref_key"), F.col("linked_entity_qualified_name").alias("target"), F.col("analyzed_at").cast(nt).alias("at"))
    packages = table(spark, sf_dir, "projects").where(F.length("package") > 0).select("package").distinct()
    depths = [r[0] for r in packages.select(F.size(F.split("package", r"\.")).alias("n")).distinct().collect()]  # distinct small numbers
    calls = table(spark, sf_dir, "code_entities").select(F.lit("code_entities").alias("ref_table"), F.col("qualified_name").alias("ref_key"), F.explode("calls").alias("target"), F.lit(None).cast(nt).alias("at"))
    every = links.unionByName(drift).unionByName(calls).withColumn("target", clean_target(F.col("target"))).where(F.col("target").isNotNull()).distinct()
    called = every.where("ref_table = 'code_entities'")
    inside = [called.withColumn("package", F.substring_index("target", ".", n)).where(F.length("target") > F.length("package")).join(packages, "package", "left_semi").drop("package") for n in depths]
    timed = every.where("ref_table <> 'code_entities'")
    for part in inside:
        timed = timed.unionByName(part)
    return timed.distinct() if len(inside) > 1 else timed


def living_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target and first_at of entities that were not deleted after they were last indexed."""
    nt = "timestamp_ntz"
    seen = table(spark, sf_dir, "code_entities").where(F.col("qualified_name").isNotNull()).groupBy(F.col("qualified_name").alias("target")).agg(F.min(F.col("indexed_at").cast(nt)).alias("first_at"), F.max(F.col("indexed_at").cast(nt)).alias("last_at"))
    gone = table(spark, sf_dir, "entity_tombstones").groupBy(F.col("qualified_name").alias("target")).agg(F.max(F.col("deleted_at").cast(nt)).alias("deleted_at"))
    dead = F.col("deleted_at").isNotNull() & (F.col("last_at").isNull() | (F.col("deleted_at") > F.col("last_at")))
    return seen.join(gone, "target", "left").where(~dead).select("target", "first_at")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(references(spark, sf_dir), living_entities(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("ref_table", "ref_key", "target").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table and month; calls have no month."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    refs = cut_lineage(references(spark, sf_dir))
    n = refs.groupBy("ref_table", period).agg(F.count("*").alias("n_references"))
    k = find_orphans(refs, living_entities(spark, sf_dir)).groupBy("ref_table", period).agg(F.count("*").alias("n_orphans"))
    both = n.join(k, (n["ref_table"] == k["ref_table"]) & n["period"].eqNullSafe(k["period"]), "left")
    return both.select(n["ref_table"], n["period"], "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


_REFS = r"""
refs AS (
  SELECT DISTINCT ref_table, ref_key, regexp_replace(regexp_replace(regexp_replace(target, '^\s+|\s+$', '', 'g'), '\(\)$', ''), '\s+$', '') AS target, ref_at FROM (
    SELECT 'document_links' AS ref_table, link_id AS ref_key, code_entity_qualified_name AS target, created_at AS ref_at FROM document_links
    UNION ALL SELECT 'drift_analyses', analysis_id, linked_entity_qualified_name, analyzed_at FROM drift_analyses
    UNION ALL SELECT 'code_entities', qualified_name, unnest(calls), NULL FROM code_entities) WHERE target IS NOT NULL),
wanted AS (SELECT * FROM refs WHERE ref_table <> 'code_entities' OR EXISTS (SELECT 1 FROM projects p WHERE starts_with(refs.target, p.package || '.'))),
ents AS (SELECT qualified_name AS target, min(indexed_at) AS first_at, max(indexed_at) AS last_at FROM code_entities GROUP BY 1),
gone AS (SELECT qualified_name AS target, max(deleted_at) AS deleted_at FROM entity_tombstones GROUP BY 1),
judged AS (SELECT w.*, e.target IS NULL OR coalesce(g.deleted_at > e.last_at, false) OR coalesce(e.first_at > w.ref_at, false) AS orphan
  FROM wanted w LEFT JOIN ents e USING (target) LEFT JOIN gone g USING (target))
"""

QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_key, target FROM judged WHERE orphan",
    "p7_report": f"WITH {_REFS} SELECT ref_table, strftime(ref_at, '%Y-%m') AS period, count(*) AS n_references, count(*) FILTER (WHERE orphan) AS n_orphans FROM judged GROUP BY 1, 2",
}
