"""Problem 8: the whole corpus as token ids of a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ship, spread, table

_ENCODERS: dict[int, object] = {}


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """Bytes of a rank file and its pre-token pattern; by default byte_bpe_50k of the installed public_tokenizers."""
    import public_tokenizers

    return Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), pattern or public_tokenizers.PATTERN


def encoder_of(vocab: tuple[bytes, str]):
    """The encoder of this Python worker, built once and kept with the transducer states it has met."""
    from .bpe import Encoder, parse_ranks

    key = hash(vocab)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(vocab[0]), vocab[1])
    return _ENCODERS[key]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row.

    Null and empty texts give an empty list; texts are encoded whole; repeated rows are encoded each; other columns
    are not read.  The vocabulary (under 1 MB, fixed) is the only thing sent to executors.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(vocab or vocabulary())
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lists = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    schema = T.StructType([T.StructField("key", key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(key, text), key).mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of each row, by the same transducer, without sending the ids back."""
    sent = df.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        enc = encoder_of(sent.value)
        for b in batches:
            n = [len(enc.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return spread(df.select(key, text), key).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str = "doc_id", vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """The inverse: ``key`` and ``text``; an empty or null list gives an empty text."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        from .bpe import Decoder, parse_ranks

        dec = Decoder(parse_ranks(sent.value[0]))
        for b in batches:
            texts = [dec.feed(x or ()) + dec.finish() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(key, "ids").mapInArrow(run, schema).withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, the number of ids and whether decoding them gives the text again (null and empty: true)."""
    from pyspark.sql import functions as F

    # the text goes through encoder and decoder as part of the key, so nothing is joined back
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", "text").alias("item"), "text")
    back = decode_ids(encode_texts(docs, key="item"), key="item")
    n = back.select((F.coalesce("item.text", F.lit("")) == F.col("text")).alias("same"))
    return n.groupBy("same").agg(F.count("*").alias("n_docs"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
SQL: dict[str, str] = {"p8_roundtrip": "SELECT true AS same, count(*) AS n_docs FROM documents"}
