"""Hot keys: which keys hold a large share of the rows, and salts that split them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows, so there are never more than 1 / share of them.
HOT_SHARE = 1 / 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, floor: int = 100_000) -> list:
    """Keys that hold at least `share` of the rows and at least `floor` rows.

    Counted with partial aggregation; at most 1/`share` values reach the driver. Null keys are never hot,
    as they join nothing. An empty table has none.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= floor).orderBy(F.desc("n")).limit(int(1 / share)).collect()
    if not top:
        return []
    total = df.count()
    return [row[key] for row in top if row["n"] >= share * total]


def salt(key: str, hot: list, by: Column, ways: int) -> Column:
    """0, or for hot keys one of `ways` salts taken from `by`."""
    if not hot:
        return F.lit(0)
    return F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).otherwise(F.lit(0))


def spread(df: DataFrame, key: str, hot: list, ways: int, name: str = "_salt") -> DataFrame:
    """The other side of a salted join: rows of hot keys once for each salt."""
    if not hot:
        return df.withColumn(name, F.lit(0))
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn(name, F.explode(salts))
