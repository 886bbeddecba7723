"""Join with a table of unique keys when one key may hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    left: DataFrame, lookup: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join `left` with `lookup` (unique on `key`), the rows of a key spread over tasks.

    `spread_by` is a column of `left` that varies within a key. The lookup side is repeated
    `salts` times, so it should be the small side.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
