"""Histories of changing attributes: the bitemporal ledger, and attributes as known at an event's time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimem.session import cut, partitions_for


def start_of(row: str = "") -> Column:
    """Start of a version's validity: valid_from, or the time it was recorded."""
    dot = f"{row}." if row else ""
    return F.coalesce(F.col(f"{dot}valid_from"), F.col(f"{dot}system_from"))


#: Stands for "no end of its own"; later than every timestamp in microseconds.
_OPEN = 1 << 62

_ROW = ("memory_id", "start", "stop", "version_id", "mark")


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last row of one range partition."""
    first = last = None
    for b in batches:
        if len(b):
            first = b.iloc[:1] if first is None else first
            last = b.iloc[-1:]
    if first is not None:
        yield pd.concat([first, last])


def _after(values: np.ndarray, before) -> np.ndarray:
    """`values` moved down by one row, `before` on top."""
    out = np.empty_like(values)
    out[1:], out[0] = values[:-1], before
    return out


def _period_starts(batches: Iterator[pd.DataFrame], lasts: dict[int, tuple]) -> Iterator[pd.DataFrame]:
    """Rows that begin a period, with `touching`: the row before, of the same memory, ran until this one's start.

    lasts: the last row of each partition; the sweep of a partition begins from that of the one before it.
    """
    prev = None
    for b in batches:
        if not len(b):
            continue
        if prev is None:
            before = [p for p in lasts if p < b["pid"].iloc[0]]
            prev = lasts[max(before)] if before else (None, 0, 0, 0, None)
        ids, start, stop, _, mark = (b[c].to_numpy() for c in _ROW)
        touching = (_after(ids, prev[0]) == ids) & (_after(stop, prev[2]) >= start)
        begins = ~(touching & (_after(mark, prev[4]) == mark))
        prev = tuple(b[c].iloc[-1] for c in _ROW)
        yield pd.DataFrame({"pid": b["pid"], "memory_id": ids, "version_id": b["version_id"], "touching": touching})[begins]


def _first_starts(lasts: dict[int, tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _period_starts(batches, lasts):
            if len(b):
                yield b.iloc[:1]
                return

    return run


def _periods(lasts: dict[int, tuple], heads: dict[int, tuple]):
    """Periods with the one that begins where they end; the last of a partition gets it from the next partition's first."""

    def closed(b: pd.DataFrame, after: tuple) -> pd.DataFrame:
        ids, versions, touching = (np.append(b[c].to_numpy()[1:], x) for c, x in zip(("memory_id", "version_id", "touching"), after, strict=True))
        follows = (ids == b["memory_id"].to_numpy()) & touching.astype(bool)
        return pd.DataFrame({"memory_id": b["memory_id"].to_numpy(), "version_id": b["version_id"].to_numpy(), "ended_by": np.where(follows, versions, 0).astype("int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in _period_starts(batches, lasts):
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b])
            held = b.iloc[-1:]
            if len(b) > 1:
                yield closed(b, (None, 0, False)).iloc[:-1]
        if held is not None:
            ahead = [p for p in heads if p > held["pid"].iloc[0]]
            yield closed(held, heads[min(ahead)] if ahead else (None, 0, False))

    return run


def valid_periods(feed: DataFrame) -> DataFrame:
    """One row per period of constant wording and state: `memory_id, version_id, ended_by`.

    The ledger's open pieces are what is believed now; pieces that follow each other without a gap and have equal wording and state are
    one period. Pieces are range-partitioned on (memory_id, start), so that a memory holding a third of all rows is spread over many
    tasks; each task sweeps its range once, given the rows at the edges of the others (two rows a partition on the driver). Ties of
    one start go to the latest recording, then the largest version_id. Nulls in content or state are values of their own. An empty
    feed gives no rows; extra columns are ignored.
    """
    rows = _ledger(feed).where(F.col("recorded_to") == _OPEN).select("memory_id", F.col("valid_from").alias("start"), F.col("valid_to").alias("stop"), "version_id", "mark")
    rows = rows.repartitionByRange(partitions_for(feed), "memory_id", "start").sortWithinPartitions("memory_id", "start")
    rows = cut(rows.withColumn("pid", F.spark_partition_id()))
    lasts = {}
    for r in rows.mapInPandas(_edges, rows.schema).collect():
        lasts[r["pid"]] = max(lasts.get(r["pid"], ()), (r["memory_id"], r["start"], r["stop"], r["version_id"], bytes(r["mark"])))
    head = "pid int, memory_id string, version_id bigint, touching boolean"
    heads = {r[0]: tuple(r[1:]) for r in rows.mapInPandas(_first_starts(lasts), head).collect()}
    return rows.mapInPandas(_periods(lasts, heads), "memory_id string, version_id bigint, ended_by bigint")


_PIECE = ("memory_id", "version_id", "valid_from", "valid_to", "recorded_from", "recorded_to")


def _later(stairs: list[tuple[int, int]], start: int, first: int) -> list[tuple[int, int]]:
    """The later starts that cut a piece from `start`, first recorded at `first`, over time; they leave `stairs`, and `start` joins them.

    `stairs`: (start, first recorded) of later starts, the nearest last, each recorded after all that lie behind it. Gives (when, cut) of those
    that were recorded after `first`, the farthest and earliest recorded first.
    """
    cuts = []
    while stairs and stairs[-1][1] >= first:
        cuts.append((stairs[-1][1], stairs[-1][0]))
        stairs.pop()
    cuts.reverse()
    return cuts


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(pid, memory, start, recorded, version, stop, mark) of rows sorted by memory and start, the latest first, then by recording."""
    for b in batches:
        yield from b[["pid", "memory_id", "start", "at", "version_id", "stop", "mark"]].itertuples(index=False, name=None)


def _stairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a range partition: the stairs of its last memory, and whether that is its only one."""
    first = memory = pid = last = None
    stairs: list[tuple[int, int]] = []
    for pid, m, start, at, *_ in _rows(batches):
        first = m if first is None else first
        if m != memory:
            memory, stairs, last = m, [], None
        if start != last:
            _later(stairs, start, at)
            stairs.append((start, at))
            last = start
    if first is not None:
        yield pd.DataFrame({"pid": pid, "memory_id": memory, "alone": first == memory, "start": [s for s, _ in stairs], "at": [a for _, a in stairs]})


def _pieces(before: dict[int, tuple[str, list[tuple[int, int]]]]):
    """The pieces of a range partition; `before`: memory and stairs that the partitions with later starts leave to each one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = last = held = None
        stairs, cuts, out = [], [], []  # cuts: those of the start at hand that are still to come, the next one at the end
        ahead = _OPEN

        def close(until: int) -> None:
            nonlocal ahead
            if held is None:
                return
            at, version, stop, mark = held
            while cuts and cuts[-1][0] <= at:
                ahead = cuts.pop()[1]
            end = min(stop, ahead)
            while cuts and cuts[-1][0] < until:
                when, ahead = cuts.pop()
                if min(stop, ahead) != end:
                    if at < when:
                        out.append((memory, version, last, end, at, when, mark))
                    at, end = when, min(stop, ahead)
            if at < until:
                out.append((memory, version, last, end, at, until, mark))

        for pid, m, start, at, version, stop, mark in _rows(batches):
            if m == memory and start == last:
                close(at)
            else:
                close(_OPEN)
                if m != memory:
                    left = before.get(pid, (None, [])) if memory is None else (None, [])
                    memory, stairs = m, list(left[1]) if left[0] == m else []
                cuts = _later(stairs, start, at)[::-1]
                ahead = stairs[-1][0] if stairs else _OPEN
                stairs.append((start, at))
                last = start
            held = (at, version, stop, mark)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=[*_PIECE, "mark"])
                out.clear()
        close(_OPEN)
        if out:
            yield pd.DataFrame(out, columns=[*_PIECE, "mark"])

    return run


def _ledger(feed: DataFrame) -> DataFrame:
    """The ledger in microseconds, _OPEN for an open end, with `mark`, which stands for wording and state (128 bits)."""
    start = start_of()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    # nulls differ from empty strings; the length keeps the two fields apart
    mark = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.length("content"), F.lit(-1)), F.coalesce("content", F.lit("")), F.coalesce(F.length("state"), F.lit(-1)), F.coalesce("state", F.lit("")))))
    rows = (
        feed.select("memory_id", micros(start).alias("start"), F.coalesce(F.when(F.col("valid_to") > start, micros(F.col("valid_to"))), F.lit(_OPEN)).alias("stop"), "version_id", micros(F.col("system_from")).alias("at"), mark.alias("mark"))
        .where("memory_id is not null and version_id is not null and start is not null and at is not null")
    )
    # rows delivered twice follow each other, and all but the last of them are believed for no time
    rows = rows.repartitionByRange(partitions_for(feed), F.desc("memory_id"), F.desc("start")).sortWithinPartitions(F.desc("memory_id"), F.desc("start"), "at", "version_id", "stop")
    rows = cut(rows.withColumn("pid", F.spark_partition_id()))
    found: dict[int, list] = {}
    for r in rows.mapInPandas(_stairs, "pid int, memory_id string, alone boolean, start bigint, at bigint").collect():
        found.setdefault(r["pid"], []).append(r)
    before, memory, stairs = {}, None, []
    for pid in sorted(found):
        before[pid] = (memory, list(stairs))
        own = sorted(((r["start"], r["at"]) for r in found[pid]), reverse=True)
        if not (found[pid][0]["alone"] and found[pid][0]["memory_id"] == memory):
            memory, stairs = found[pid][0]["memory_id"], []
        for start_, at in own:
            _later(stairs, start_, at)
            stairs.append((start_, at))
    schema = "memory_id string, version_id bigint, valid_from bigint, valid_to bigint, recorded_from bigint, recorded_to bigint, mark binary"
    return rows.mapInPandas(_pieces(before), schema)


def ledger(feed: DataFrame) -> DataFrame:
    """What was believed when: `memory_id, version_id, valid_from, valid_to, recorded_from, recorded_to`, null for an open end.

    From `recorded_from` until `recorded_to` the version was believed to hold from `valid_from` until `valid_to`. A recording of the
    same start closes the one before; one of a start in between, recorded late, closes the piece it falls into and opens that piece's
    rest, cut at the new start; the closed pieces stay. So a feed row gives two pieces at most. Recorded times follow from the recordings
    themselves, as the feed's system_to is missing or wrong; nothing is believed for no time. The open pieces (`recorded_to` null) are what
    `valid_periods` merges by wording and state.

    The sweep runs over range partitions of (memory, start), latest start first, so a memory may be spread over many tasks. A partition
    leaves to the next the starts that may still cut earlier pieces: those recorded before all that lie between. They are one for
    a memory recorded in order and about the logarithm of its rows for one recorded at random; they come to the driver, one set a partition.
    """
    time = lambda c: F.timestamp_micros(F.when(F.col(c) < _OPEN, F.col(c))).cast("timestamp_ntz").alias(c)
    return _ledger(feed).select("memory_id", "version_id", *map(time, _PIECE[2:]))


def attribute_history(versions: DataFrame, key: str, value: Column, start: Column, recorded: Column, tie: Column, stop: Column | None = None) -> DataFrame:
    """The versions of one attribute: `key, value, start, recorded, tie, stop`; rows without key, start, recorded time or tie are left out.

    `stop` is the end after which the value holds no more, null for none.
    """
    stop = F.lit(None).cast("timestamp") if stop is None else F.when(stop > start, stop)
    return versions.select(F.col(key), value.alias("value"), start.alias("start"), recorded.alias("recorded"), tie.alias("tie"), stop.alias("stop")).where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("recorded").isNotNull() & F.col("tie").isNotNull())


_LINE = ("attribute", "key", "eff", "kind", "start", "recorded", "tie", "stop", "value", "pid")


def _greatest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The greatest version of the last key of a range partition, and whether that is its only key."""
    key = first = best = pid = None
    for b in batches:
        for row in b[list(_LINE)].itertuples(index=False, name=None):
            pid, first = row[-1], row[:2] if first is None else first
            if row[:2] != key:
                key, best = row[:2], None
            if row[3] == 0 and (best is None or row[4:7] > best[4:7]):
                best = row
    if best is not None:
        yield pd.DataFrame([(*best, first == key)], columns=[*_LINE, "alone"])
    elif key is not None:
        yield pd.DataFrame([(*key, 0, 1, 0, 0, 0, 0, None, pid, first == key)], columns=[*_LINE, "alone"])


def _matched(before: dict[int, tuple]):
    """Events with the greatest version known by then; `before`: the version that earlier partitions leave to the first key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = best = None
        for b in batches:
            out = []
            for row in b[list(_LINE)].itertuples(index=False, name=None):
                if row[:2] != key:
                    left = before.get(row[-1]) if key is None else None
                    key, best = row[:2], left if left and left[:2] == row[:2] else None
                if row[3] == 0:
                    if best is None or row[4:7] > best[4:7]:
                        best = row
                elif best is not None:
                    out.append((*key, row[2], *best[4:9]))
            if out:
                yield pd.DataFrame(out, columns=["attribute", "key", "at", "start", "recorded", "tie", "stop", "value"])

    return run


def last_known(events: DataFrame, histories: dict[str, DataFrame], key: str, at: str = "at") -> DataFrame:
    """For each event (`key, at`) and attribute the last value valid and recorded by then: `attribute, key, at, value, start, recorded, tie, stop`.

    An as-of sweep: a version is known from the later of its start and its recording on; events and all histories are
    range-partitioned on (attribute, key, that time) and swept once, keeping the greatest (start, recorded, tie) so far. So a key with many
    versions and many events costs their sum, not their product, and is spread over many tasks; one row a partition is carried
    over through the driver. Ties are equal to the last bit of `tie`; equal rows count once. Events without key or time, and attributes without
    a match, give no row; repeated events give one. Values are strings.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    name = "string"
    of_events = events.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast(name).alias("key"), micros(at).alias("eff")).distinct()
    rows = of_events.select(F.explode(F.array(*map(F.lit, histories))).alias("attribute"), "key", "eff", F.lit(1).alias("kind"), *[F.lit(0).cast("bigint").alias(c) for c in ("start", "recorded", "tie", "stop")], F.lit(None).cast("string").alias("value"))
    for attribute, history in histories.items():
        times = history.select(F.col(key).cast(name).alias("key"), micros("start").alias("start"), micros("recorded").alias("recorded"), F.col("tie").cast("bigint").alias("tie"), F.coalesce(micros("stop"), F.lit(_OPEN)).alias("stop"), F.col("value").cast("string").alias("value"))
        rows = rows.unionByName(times.select(F.lit(attribute).alias("attribute"), "key", F.greatest("start", "recorded").alias("eff"), F.lit(0).alias("kind"), "start", "recorded", "tie", "stop", "value"))
    rows = rows.repartitionByRange(partitions_for(events), "attribute", "key", "eff").sortWithinPartitions("attribute", "key", "eff", "kind", "start", "recorded", "tie")
    rows = cut(rows.withColumn("pid", F.spark_partition_id()))
    kinds = "attribute string, key string, eff bigint, kind int, start bigint, recorded bigint, tie bigint, stop bigint, value string, pid int"
    before, left = {}, None
    for r in sorted(rows.mapInPandas(_greatest, f"{kinds}, alone boolean").collect(), key=lambda r: r["pid"]):
        if left is not None:
            before[r["pid"]] = left
        own = tuple(r)[:-1]
        same = left is not None and left[:2] == own[:2] and r["alone"]
        left = left if same and (own[3] == 1 or left[4:7] >= own[4:7]) else own if own[3] == 0 else None
    # a partition without rows leaves nothing; the next one gets what the last one with rows left
    found = rows.mapInPandas(_matched(before), "attribute string, key string, at bigint, start bigint, recorded bigint, tie bigint, stop bigint, value string")
    time = lambda c: F.timestamp_micros(F.when(F.col(c) < _OPEN, F.col(c))).cast("timestamp_ntz").alias(at if c == "at" else c)
    return found.select("attribute", F.col("key").cast(dict(events.dtypes)[key]).alias(key), time("at"), "value", time("start"), time("recorded"), "tie", time("stop"))


def changes(history: DataFrame, key: str) -> DataFrame:
    """A history without rows that change nothing: the row before, in the order of start, recording and tie, has the same value and end and was recorded no later.

    Whoever knew such a row knew the one before as well, so no match is lost. Rows next to each other are compared within range partitions of
    (key, start); the first row of a partition always stays, which costs a row and changes nothing.
    """
    rows = history.repartitionByRange(partitions_for(history), key, "start").sortWithinPartitions(key, "start", "recorded", "tie")
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = (None, None, 0, last)
        for b in batches:
            if len(b):
                keys, values = b[key].to_numpy(object), b["value"].to_numpy(object)
                stop, recorded = (b[c].astype("datetime64[us]").astype("int64").to_numpy() for c in ("stop", "recorded"))
                same = (_after(keys, before[0]) == keys) & (_after(values, before[1]) == values) & (_after(stop, before[2]) == stop) & (_after(recorded, before[3]) <= recorded)
                before = keys[-1], values[-1], stop[-1], recorded[-1]
                yield b[~same]

    return rows.mapInPandas(run, history.schema)


def attributes_at(events: DataFrame, versions: DataFrame, key: str, attributes: dict[str, Column] | list[str], ends: Column | None = None) -> DataFrame:
    """Each attribute's last known value at the event, found in its own history, pivoted back: `key, at, <attributes>`.

    One history per attribute, of changes only, so attributes may be updated at different times; all are matched in one sweep and
    pivoted back by event. Histories hold only rows in which the attribute is given; one that was never known by then is null, and
    so is one whose last known value had ended (`ends`) at the event. Events without any known attribute keep their row; values are strings.
    """
    columns = attributes if isinstance(attributes, dict) else {name: F.col(name) for name in attributes}
    histories = {}
    for name, value in columns.items():
        given = versions.withColumn("_value", value.cast("string")).where("_value is not null")
        histories[name] = changes(attribute_history(given, key, F.col("_value"), start_of(), F.col("system_from"), F.col("version_id"), ends), key)
    found = last_known(events, histories, key)
    holds = found.where(F.col("stop").isNull() | (F.col("stop") > F.col("at")))
    wide = holds.groupBy(key, "at").agg(*[F.max(F.when(F.col("attribute") == name, F.col("value"))).alias(name) for name in columns])
    bare = events.where(F.col("at").isNotNull() & F.col(key).isNotNull()).select(key, "at").distinct()
    return bare.join(wide, [key, "at"], "left")


def retrieved_versions(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """The version that each retrieval could know: `memory_id, version_id`.

    The version's id is one attribute and its usable end another, each with a history of its own; both are matched by themselves and
    pivoted back, and a version that had ended by the retrieval is no match. Rows delivered twice tie completely and give one row.
    """
    events = memories.select(F.col("id").alias("memory_id"), F.col("last_retrieved_at").alias("at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    end = F.when(F.col("valid_to") > start_of(), micros("valid_to")).otherwise(F.lit(_OPEN))
    known = attributes_at(events, versions, "memory_id", {"version_id": F.col("version_id"), "ended": end})
    return known.where(F.col("version_id").isNotNull() & (F.col("ended").cast("bigint") > micros("at"))).select("memory_id", F.col("version_id").cast("bigint").alias("version_id"))
