"""Watching a stream of changes: the latest event per path, idempotent upserts by batch, windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import delete_where, last_of_batch, swap, upsert
from ..session import shared_folder, ship
from ..sources.files import IGNORED, LANGUAGES, glob_regex


def relevant(path: Column) -> Column:
    """Whether a change concerns a source file outside the folders a scan leaves out."""
    ext = F.lower(F.regexp_extract(path, r"(\.\w+)$", 1))
    return ext.isin(*LANGUAGES) & ~path.rlike(r"(?:^|/)(?:" + "|".join(glob_regex(p) for p in IGNORED) + r")(?:/|$)")


def stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that come into ``folder``, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(folder)


def maintain(events: DataFrame, target: str, key: str, order: str, checkpoint: str, deleted: str | None = None) -> StreamingQuery:
    """Keep the table at ``target`` up to date with ``events``: per batch the last event of a key is put in, or taken
    out where the column ``deleted`` is true.

    A batch that comes again after a failure changes nothing: it holds the same last events of the same keys, and an
    event older than what is stored is ignored.
    """

    ship(events.sparkSession)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = last_of_batch(batch, [key], order)
        try:
            old = spark.read.schema(batch.schema).parquet(target)
        except Exception:  # noqa: BLE001 - the table does not exist yet
            old = spark.createDataFrame([], batch.schema)
        kept = last.join(old.select(key, F.col(order).alias("_stored")), key, "left").where(F.col("_stored").isNull() | (F.col(order) >= F.col("_stored"))).drop("_stored")
        new = upsert(old, kept.select(*batch.columns), [key])
        if deleted:
            new = delete_where(new, kept.where(F.col(deleted)), [key])
        swap(new, target)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vanished(index: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Keys of the index that a new snapshot does not have: a file source never reports deletions itself."""
    return index.select(key).join(snapshot.select(key), key, "left_anti")


def drained(events: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there and give the result as a table."""
    folder = f"{shared_folder(events.sparkSession)}/sparkloom/stream-{name}"
    import uuid

    at = f"{folder}-{uuid.uuid4().hex}"
    if mode == "append":
        q = events.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        schema = events.schema
        q = events.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/{i:09d}")).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = events.sparkSession
    if mode == "append":
        return spark.read.schema(events.schema).parquet(f"{at}/out")
    names = sorted(f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{at}/out").select("path").distinct().collect())
    last = names[-1].rsplit("/", 1)[0] if names else None
    return spark.read.schema(schema).parquet(last) if last else spark.createDataFrame([], schema)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, counted by a stream with a watermark; a final event would close the last hour."""
    e = events_of(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    n = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drained(n.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), "counts", "complete")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table a stream of events maintains: the last event of each user."""
    import uuid

    at = f"{shared_folder(spark)}/sparkloom/latest-{uuid.uuid4().hex}"
    q = maintain(events_of(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value"), f"{at}/table", "user_id", "event_id", f"{at}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/table").select("user_id", "event_id", "event_type", "value")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event type, each pair once, found by a stream that drops what it has seen."""
    e = events_of(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return drained(e, "dedup", "append")


QUERIES = {"stream_counts": stream_counts, "stream_latest": stream_latest, "stream_dedup": stream_dedup}
SQL = {
    "stream_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
}
