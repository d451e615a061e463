"""Evaluation: ranking metrics, paired comparison, cluster bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimem.functions.hashes import BLOCK, numbered
from evimem.functions.numbers import r6, share
from evimem.session import partitions_for

#: Tasks that share the draws of a cluster.
DRAW_PARTS = 8


def ranking_metrics(rows: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Per group of `place, relevant` rows: hit, recall and precision at k, reciprocal rank, normalised gain (no relevant rows: 0)."""
    top, gain = F.col("place") <= k, 1 / F.log2(F.col("place") + 1.0)
    sums = rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if("relevant").alias("relevant"),
        F.count_if(F.col("relevant") & top).alias("found"),
        F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"),
        F.sum(F.when(F.col("relevant") & top, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int")))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(by, (F.col("found") > 0).alias("hit"), r6(zero(share(F.col("found"), F.col("relevant")))).alias("recall"), r6(F.col("found") / k).alias("precision"), r6(zero(1 / F.col("first"))).alias("reciprocal_rank"), r6(F.when(F.col("relevant") > 0, F.col("dcg") / ideal).otherwise(0.0)).alias("ndcg"))


def paired_deltas(runs: DataFrame, pair: list[str], arm: str, value: str) -> DataFrame:
    """Mean of `value` in the first and in the last arm (by name) for each pair that has both, and the difference."""
    ends = runs.agg(F.min(arm).alias("one"), F.max(arm).alias("two"))
    v = F.col(value).cast("double")
    sums = runs.join(F.broadcast(ends)).groupBy(*pair).agg(F.avg(F.when(F.col(arm) == F.col("one"), v)).alias("a"), F.avg(F.when(F.col(arm) == F.col("two"), v)).alias("b"))
    return sums.where("a is not null and b is not null").select(*pair, r6(F.col("a")).alias("first_mean"), r6(F.col("b")).alias("last_mean"), r6(F.col("a") - F.col("b")).alias("delta"))


def bootstrap(clusters: DataFrame, times: int = 200, seed: str = "7") -> DataFrame:
    """Interval of a ratio from `cluster, total, n` (few clusters, such as days): clusters are drawn with replacement `times` times.

    Draws come from hashes of (seed, draw, position), so every engine and every run draws alike. The clusters are numbered by a
    window; they are aggregates already, not rows of the data.
    """
    numbered = clusters.withColumn("k", F.row_number().over(Window.orderBy("cluster")) - 1).withColumn("m", F.count("*").over(Window.partitionBy()))
    draws = numbered.select("k", "m", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("b"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "k")), 1, 8), 16, 10).cast("bigint") % F.col("m")
    drawn = draws.select("b", pick.alias("k")).join(numbered.select(F.col("k").cast("bigint").alias("k"), "total", "n"), "k")
    means = drawn.groupBy("b").agg((F.sum("total") / F.sum("n")).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return means.agg(F.count("*").alias("draws"), q.alias("q")).select("draws", *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("low", "middle", "high"))])


def nested_bootstrap(cells: DataFrame, inner: str, times: int, seed: str = "7") -> DataFrame:
    """As `bootstrap`, in two levels: clusters are drawn, and for each drawn cluster as many of its cells (`cluster, <inner>, total, n`) as it has.

    Cells are aggregates already (days by labels), so the work is draws x cells, whatever the number of rows behind them. Each is a hash of its
    own, so a task holds the cells of a cluster and sums its draws of them where the hashes are made; a row for each drawn cluster is shuffled.
    """
    pick = lambda of, *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 8), 16, 10).cast("bigint") % F.col(of)
    clusters = cells.select("cluster").distinct().withColumn("k", (F.row_number().over(Window.orderBy(F.asc_nulls_last("cluster"))) - 1).cast("bigint")).withColumn("m", F.count("*").over(Window.partitionBy()))
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.asc_nulls_first(inner)))
    ordered = cells.where("cluster is not null").select("cluster", order.alias("i"), "total", "n").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DRAW_PARTS - 1))))
    draws = clusters.select(F.col("k").alias("place"), "m", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("b"))
    drawn = draws.select("b", "place", pick("m", "b", "place").alias("k")).join(clusters.select("k", "cluster"), "k").select("cluster", "b", "place", (F.col("b") % DRAW_PARTS).alias("part"))

    def sums(draws: pa.Table, cells: pa.Table) -> pa.Table:
        b, place = (draws.column(c).to_numpy() for c in ("b", "place"))
        cells = cells.sort_by("i")
        values = [cells.column(c).fill_null(0).to_numpy() for c in ("total", "n")]
        size, prefixes = cells.num_rows, [f"{seed}:{x}:{y}:" for x, y in zip(b, place, strict=True)]
        out = [np.zeros(len(b), v.dtype) for v in values]
        rows = max(1, BLOCK // max(1, size))
        for at in range(0, len(b), rows):
            for first in range(0, size, BLOCK):
                picked = numbered(prefixes[at : at + rows], first, min(size, first + BLOCK))
                picked -= picked // np.uint32(size) * np.uint32(size)
                for o, v in zip(out, values, strict=True):
                    o[at : at + rows] += v.take(picked).sum(1)
        return pa.table({"b": b, "total": out[0], "n": out[1]}).cast(schema)

    kinds = {c: "double" if kind in ("float", "double") else "bigint" for c, kind in cells.dtypes}
    schema = pa.schema([("b", pa.int32()), *[(c, pa.float64() if kinds[c] == "double" else pa.int64()) for c in ("total", "n")]])
    # as many tasks as are asked for: the rows are few, the work is not
    tasks = partitions_for(cells, 2 * cells.sparkSession.sparkContext.defaultParallelism)
    sides = [x.repartition(tasks, "cluster", "part").groupBy("cluster", "part") for x in (drawn, ordered)]
    summed = sides[0].cogroup(sides[1]).applyInArrow(sums, f"b int, total {kinds['total']}, n {kinds['n']}")
    means = summed.groupBy("b").agg((F.sum("total") / F.sum("n")).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return means.agg(F.count("*").alias("draws"), q.alias("q")).select("draws", *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("low", "middle", "high"))])
