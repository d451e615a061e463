"""Exact percentiles per group without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimem.session import written

#: Ranges of values that a group's different values are cut into; a window runs over one of them only.
RANGES = 64


def exact_quantiles(rows: DataFrame, by: str, value: str, levels: tuple[float, ...], between: bool = True) -> DataFrame:
    """`by, n, least, most, q`: exact percentiles of each group, between neighbours (linear) or the first value that reaches the level.

    Equal values are counted first. Each group's different values are cut into ranges by an approximate sketch; sums by range tell which ranges
    hold the wanted ranks, and only those are ordered. Null and NaN values do not count; a null group is a group; no rows give no groups.
    """
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    counts = written(ok.groupBy("g", "v").agg(F.count("*").alias("n")), "values")
    cuts = counts.groupBy("g").agg(F.percentile_approx("v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 1000).alias("cuts"), F.sum("n").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
    if between:
        place = F.transform(F.array(*map(F.lit, levels)), lambda q: q * (F.col("total") - 1))
    else:
        place = F.transform(F.array(*map(F.lit, levels)), lambda q: F.greatest(F.ceil(q * F.col("total") - F.lit(1e-9)) - 1, F.lit(0)).cast("double"))
    groups = written(cuts.withColumn("place", place).withColumn("ranks", F.array_distinct(F.concat(F.transform("place", lambda p: F.floor(p)), F.transform("place", lambda p: F.ceil(p))))), "groups")
    side = groups.select(F.col("g").alias("g2"), "cuts", "ranks")
    ranged = counts.join(side, F.col("g").eqNullSafe(F.col("g2"))).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("here"), F.first("ranks").alias("ranks"))
    bases = sums.withColumn("base", F.sum("here").over(Window.partitionBy("g").orderBy("part")) - F.col("here"))
    wanted = bases.where(F.exists("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("here")))).select(F.col("g").alias("g3"), F.col("part").alias("part3"), "base")
    inside = ranged.join(wanted, F.col("g").eqNullSafe(F.col("g3")) & (F.col("part") == F.col("part3")))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("g", "part").orderBy("v"))
    found = inside.withColumn("upto", upto).select("g", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("r"))
    # at most two ranks for each level
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at")).withColumnRenamed("g", "g4")
    joined = groups.join(values, F.col("g").eqNullSafe(F.col("g4")))
    low, high = lambda p: F.element_at("at", F.floor(p)), lambda p: F.element_at("at", F.ceil(p))
    return joined.select(F.col("g").alias(by), F.col("total").alias("n"), "least", "most", F.transform("place", lambda p: low(p) + (p - F.floor(p)) * (high(p) - low(p))).alias("q"))
