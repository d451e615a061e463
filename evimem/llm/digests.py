"""Percentiles with bounded rank error from merging centroid digests, certified by a second counting pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimem.session import partitions_for, written

#: Clusters of a digest; a cluster around quantile q holds about 2 * pi / DELTA * sqrt(q * (1 - q)) of the values.
DELTA = 1000
#: Stated bound of the rank error, as a share of the values; the second pass holds every result against it.
BOUND = 0.01
LEVELS = (0.5, 0.9, 0.95, 0.99)
#: Most digests that are merged at once.
FAN = 64
#: Most rows that a task holds before it makes digests of them.
CHUNK = 500_000
#: Most groups whose estimates are broadcast to the counting pass; beyond, a salted join.
SMALL_GROUPS = 20_000

_PARTS = ("means", "lows", "highs", "weights")
_BODY = "n double, " + ", ".join(f"{p} array<double>" for p in _PARTS)


def clustered(codes: np.ndarray, means: np.ndarray, lows: np.ndarray, highs: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> list[np.ndarray]:
    """Centroids of many groups at once, after clustering neighbours by the arcsine size function; parts as given."""
    order = np.lexsort((means, codes))
    codes, means, lows, highs, weights = (x[order] for x in (codes, means, lows, highs, weights))

    def gather(begin: np.ndarray) -> None:
        nonlocal codes, means, lows, highs, weights
        at = np.flatnonzero(begin)
        w, lo, hi = np.add.reduceat(weights, at), np.minimum.reduceat(lows, at), np.maximum.reduceat(highs, at)
        codes, means, lows, highs, weights = codes[at], np.clip(np.add.reduceat(weights * means, at) / w, lo, hi), lo, hi, w

    # equal values first: a mass of them is one centroid of its own
    gather(np.r_[True, (codes[1:] != codes[:-1]) | (means[1:] != means[:-1])])
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    sizes = np.diff(np.r_[first, len(codes)])
    total, upto = np.repeat(np.add.reduceat(weights, first), sizes), np.cumsum(weights)
    base = np.repeat(np.r_[0.0, upto[first[1:] - 1]], sizes)
    left, middle, right = (delta / (2 * np.pi) * (np.arcsin(2 * np.clip((upto - base - weights * part) / total, 0, 1) - 1) + np.pi / 2) for part in (1, 0.5, 0))
    # small groups keep every value, and what fills a cluster alone stays alone
    k = np.where(np.repeat(sizes, sizes) <= delta // 4, np.arange(len(codes)), np.floor(middle))
    alone = right - left > 1
    gather(np.r_[True, (codes[1:] != codes[:-1]) | (k[1:] != k[:-1]) | alone[1:] | alone[:-1]])
    return [codes, means, lows, highs, weights]


def _rows(keys: pd.DataFrame, codes: np.ndarray, *parts: np.ndarray) -> pd.DataFrame:
    """A digest a row; keys by code."""
    codes, *parts = clustered(codes, *parts)
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    out = keys.iloc[codes[at]].reset_index(drop=True)
    out["n"] = np.add.reduceat(parts[3], at)
    for name, x in zip(_PARTS, parts, strict=True):
        out[name] = np.split(x, at[1:])
    return out


def _digest(keys: list[str], metrics: list[str]):
    def make(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        group = rows.groupby(keys, dropna=False, sort=False)
        codes, names = group.ngroup().to_numpy(), rows.loc[group.head(1).index, keys].reset_index(drop=True)
        pid = rows["pid"].iloc[0]
        for metric in metrics:
            values = rows[metric].to_numpy(dtype="float64", na_value=np.nan)
            ok = ~np.isnan(values)
            if not ok.any():
                continue
            v = values[ok]
            out = _rows(names, codes[ok], v, v, v, np.ones(len(v)))
            yield out.assign(metric=metric, part=pid)[[*keys, "part", "metric", "n", *_PARTS]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= CHUNK:
                yield from make(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield from make(pd.concat(held, ignore_index=True))

    return run


def _merge(keys: list[str]):
    """Merges digests of equal keys; rows arrive sorted by them, so only the last key of a batch has to wait."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby(keys, dropna=False, sort=False)
        code = group.ngroup().to_numpy()
        names = rows.loc[group.head(1).index, keys].reset_index(drop=True)
        codes = np.repeat(code, rows["means"].map(len).to_numpy())
        return _rows(names, codes, *[np.concatenate(rows[p].to_numpy()) for p in _PARTS])[[*keys, "n", *_PARTS]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            code = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            last = code == code[-1]
            held = b[last]
            if len(held) > FAN:
                held = make(held)
            if not last.all():
                yield make(b[~last].reset_index(drop=True))
        if held is not None:
            yield make(held.reset_index(drop=True))

    return run


def merged(digests: DataFrame, keys: list[str]) -> DataFrame:
    """One digest for each of `keys` and metric. A key's digests stream through a task, `FAN` held at a time."""
    by = [*keys, "metric"]
    kinds = dict(digests.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + _BODY
    rows = digests.select(*by, "n", *_PARTS)
    return rows.repartition(partitions_for(digests), *by).sortWithinPartitions(*by).mapInPandas(_merge(by), schema)


def digests(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A digest for each of `keys` and metric: `keys, metric, n, means, lows, highs, weights`.

    Partial digests of each partition's rows (`CHUNK` at a time) are merged in levels of at most `FAN` partitions, so
    neither the values nor the digests of a hot key meet in one task. Null and NaN values are no measurements; null keys form
    a group of their own; no rows give no digests.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", part int, metric string, " + _BODY
    parts = rows.select(*keys, *metrics, F.spark_partition_id().alias("pid")).mapInPandas(_digest(keys, metrics), schema)
    count = rows.rdd.getNumPartitions()
    while count > FAN:
        parts, count = merged(parts.withColumn("part", (F.col("part") / FAN).cast("int")), [*keys, "part"]), -(-count // FAN)
    return merged(parts, keys)


def _value(levels: np.ndarray, n: float, means: np.ndarray, lows: np.ndarray, highs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Values at the ranks levels * n: between the centres of centroids, but never outside the centroid that holds the rank."""
    upto = np.cumsum(weights)
    i = np.minimum(np.searchsorted(upto, levels * n - 1e-9), len(means) - 1)
    return np.clip(np.interp(levels * n, upto - weights / 2, means), lows[i], highs[i])


def _values(levels: tuple[float, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.asarray(levels)
        for b in batches:
            found = [_value(at, n, *parts) for n, *parts in zip(b["n"], *[b[p] for p in _PARTS], strict=True)]
            yield b.drop(columns=[*_PARTS]).assign(estimates=found)

    return run


def estimates(digested: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Each digest's values at `levels`: its keys, metric, n and `estimates`."""
    keep = [c for c in digested.columns if c not in _PARTS]
    kinds = dict(digested.dtypes)
    return digested.mapInPandas(_values(levels), ", ".join(f"{c} {kinds[c]}" for c in keep) + ", estimates array<double>")


def _counts(metric: str, table: str, k: int, level: int) -> list[Column]:
    """How many values lie below, and not above, an estimate."""
    estimate = F.col(f"{table}_{metric}")[k]
    return [F.count_if(F.col(metric) < estimate).alias(f"{table}_{metric}_{level}_lt"), F.count_if(F.col(metric) <= estimate).alias(f"{table}_{metric}_{level}_le")]


def percentiles(rows: DataFrame, keys: list[str], day: str, metrics: list[str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Percentiles of each group and day, and (day null) of each group over all days, with certified rank errors.

    Columns: `keys, day, metric, level, n, value, rank_low, rank_high, rank_error, error_bound, certified`. The group's
    digests are merged from the daily ones. A second pass over all values counts those below and not above each estimate;
    rank_error is the distance of `level` from that interval of ranks.
    """
    rows = written(rows.select(*keys, F.col(day).alias("day"), *[F.col(m).cast("double") for m in metrics]), "measurements")
    daily = written(digests(rows, [*keys, "day"], metrics), "digests")
    months = merged(daily.withColumn("month", F.trunc("day", "month")), [*keys, "month"])
    overall = merged(months, keys)

    def wide(found: DataFrame, by: list[str], name: str) -> DataFrame:
        return found.groupBy(*by).agg(*[F.first(F.when(F.col("metric") == m, F.col("estimates")), ignorenulls=True).alias(f"{name}_{m}") for m in metrics])

    est_day, est_all = estimates(daily, levels), estimates(overall, levels)
    groups, totals = wide(est_day, [*keys, "day"], "d"), wide(est_all, keys, "a")
    both = written(groups.join(totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"a_{m}" for m in metrics]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys]), "estimates")
    held = rows.withColumn("_salt", F.lit(0))
    if both.count() <= SMALL_GROUPS:
        side = F.broadcast(both.withColumn("_salt", F.lit(0)))
    else:
        held = rows.withColumn("_salt", F.pmod(F.xxhash64(*metrics), F.lit(16)).cast("int"))
        side = both.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    by = [*keys, "day"]
    side = side.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_salt").alias("_s"), *[f"{t}_{m}" for t in "da" for m in metrics])
    met = held.join(side, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_salt") == F.col("_s")])
    counts = met.groupBy(*by).agg(*[F.count_if(~F.isnan(m) & F.col(m).isNotNull()).alias(f"n_{m}") for m in metrics], *[c for t in "da" for m in metrics for k in range(len(levels)) for c in _counts(m, t, k, k)])
    counts = written(counts, "counts")
    sums = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts.columns if c not in by]).withColumn("day", F.lit(None).cast(dict(counts.dtypes)["day"]))

    def long(found: DataFrame, table: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.lit(q).alias("level"), F.col(f"n_{m}").alias("n"), F.col(f"{table}_{m}_{k}_lt").alias("lt"), F.col(f"{table}_{m}_{k}_le").alias("le")) for m in metrics for k, q in enumerate(levels)])
        return found.select(*by, F.inline(cells)).where("n > 0")

    ranks = long(counts, "d").unionByName(long(sums.select(*counts.columns), "a"))
    points = est_day.unionByName(est_all.withColumn("day", F.lit(None).cast(dict(counts.dtypes)["day"])).select(*est_day.columns))
    points = points.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("metric").alias("_metric"), F.posexplode("estimates").alias("_k", "value"))
    out = ranks.join(points, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "metric"]], F.col("k") == F.col("_k")])
    low, high = F.col("lt") / F.col("n"), F.col("le") / F.col("n")
    error = F.greatest(low - F.col("level"), F.col("level") - high, F.lit(0.0))
    # one value more or less is as exact as a sample of n values can be
    bound = F.greatest(F.lit(BOUND), 1 / F.col("n"))
    return out.select(*by, "metric", "level", "n", "value", low.alias("rank_low"), high.alias("rank_high"), error.alias("rank_error"), bound.alias("error_bound"), (error <= bound + 1e-9).alias("certified"))


def observations(raw: DataFrame) -> DataFrame:
    """Each observation once, with the day it ran and its measurements; what is none (null, NaN, below zero, infinite, no prompt) is null.

    Of several deliveries of one observation_id the first received counts (one without a time is the last), of
    deliveries received at once the one with the least values. Rows without an id are left out.
    """
    good = lambda c, least: F.when((F.col(c) >= least) & ~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("double") < float("inf")), F.col(c).cast("double"))
    values = F.struct("model", "condition", F.to_date("run_at").alias("day"), good("agent_ttft_ms", 0).alias("agent_ttft_ms"), good("memory_prepare_ms", 0).alias("memory_prepare_ms"), good("reported_prompt_tokens", 1).alias("reported_prompt_tokens"))
    return raw.where("observation_id is not null").groupBy("observation_id").agg(F.min_by(values, F.struct(F.col("received_at").isNull(), F.col("received_at"), values)).alias("v")).select("v.*")
