"""Joins that stay whole and even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(many: DataFrame, unique: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined to ``unique`` (one row per key): rows of one key go to ``salts`` tasks instead of one.

    ``unique`` is repeated ``salts`` times, so it should be the narrow side.  The rows of the result are those of the
    plain join; ``how`` is inner, left or left_semi.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
