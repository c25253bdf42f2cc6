"""Ports for models, with offline stand-ins that always give the same result."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PortError
from ..session import ship

Embed = Callable[[list[str]], list[list[float]]]
Complete = Callable[[str], str]


@lru_cache(maxsize=65_536)
def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")


def hashing_embedder(dimensions: int = 64) -> Embed:
    """Bags of words hashed into ``dimensions`` signed counts, of unit length; a text without words is all zero."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in re.findall(r"\w+", (t or "").lower()):
                h = _word_hash(w)
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def extractive_summary(limit: int = 300) -> Complete:
    """The first sentences of a text up to ``limit`` characters."""

    def complete(prompt: str) -> str:
        got = ""
        for s in re.split(r"(?<=[.!?])\s+", prompt.strip()):
            if got and len(got) + len(s) + 1 > limit:
                break
            got = f"{got} {s}".strip()
        return got[:limit]

    return complete


def with_retry(call: Callable, tries: int = 5, wait: float = 1.0) -> Callable:
    """``call``, tried again with growing pauses; the last failure is a PortError."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as e:  # noqa: BLE001 - whatever the port raises
                if k + 1 == tries:
                    raise PortError(str(e)) from e
                time.sleep(min(60.0, wait * 2**k))

    return run


def embed_column(df: DataFrame, text: str, out: str = "embedding", port: Embed | None = None, batch: int = 100) -> DataFrame:
    """``df`` with a vector per text, in Arrow batches; the port is made once per task."""
    ship(df.sparkSession)
    call = with_retry(port or hashing_embedder())

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in call(texts[i : i + batch])])

    return df.withColumn(out, run(F.col(text)))


def complete_column(df: DataFrame, prompt: str, out: str, port: Complete | None = None) -> DataFrame:
    """``df`` with the port's answer to each prompt; a null prompt or a failing port gives null."""
    ship(df.sparkSession)
    call = port or extractive_summary()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(p):
            try:
                return None if p is None else call(p)
            except Exception:  # noqa: BLE001 - one bad answer must not end the job
                return None

        return s.map(one)

    return df.withColumn(out, run(F.col(prompt)))
