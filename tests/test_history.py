"""The bitemporal ledger and as-known-at matches against plain versions, with nulls, ties, repeats and empty tables."""

import random
from datetime import datetime, timedelta

from evimem.operators import history as H

SCHEMA = "version_id bigint, memory_id string, content string, confidence double, state string, valid_from timestamp_ntz, valid_to timestamp_ntz, system_from timestamp_ntz, system_to timestamp_ntz, reason string"
T0 = datetime(2024, 1, 1)


def feed(seed: int, n: int, memories: int):
    rng = random.Random(seed)
    day = lambda: T0 + timedelta(days=rng.randint(0, 12))
    rows = []
    for k in range(n):
        hot = rng.random() < 0.4
        rows.append((k % (n - 5), "hot" if hot else f"m{rng.randint(0, memories)}", rng.choice(["a", "b", None]), 0.5, rng.choice(["x", "y", None]), rng.choice([None, day()]), rng.choice([None, None, day()]), day(), None, None))
    seen = {}
    for r in rows:  # rows with one version_id are equal, as redelivered ones are
        seen.setdefault(r[0], r)
    return [seen[r[0]] for r in rows]


def plain_periods(rows):
    out = set()
    best = {}
    for r in {r[0]: r for r in rows}.values():
        start = r[5] or r[7]
        key = (r[1], start)
        if key not in best or (r[7], r[0]) > (best[key][7], best[key][0]):
            best[key] = r
    by = {}
    for (m, start), r in best.items():
        by.setdefault(m, []).append((start, r))
    for m, versions in by.items():
        versions.sort(key=lambda x: x[0])
        periods = []
        for k, (start, r) in enumerate(versions):
            nxt = versions[k + 1][0] if k + 1 < len(versions) else None
            end = r[6] if r[6] and r[6] > start else None
            end = min(x for x in (nxt, end) if x) if nxt or end else None
            if periods and periods[-1][2] == start and periods[-1][3] == (r[2], r[4]):
                periods[-1][2] = end
            else:
                periods.append([start, r[0], end, (r[2], r[4])])
        for k, (_, v, end, _) in enumerate(periods):
            ended = periods[k + 1][1] if k + 1 < len(periods) and end == periods[k + 1][0] else 0
            out.add((m, v, ended))
    return out


def test_periods(spark):
    for seed, n, memories in ((1, 40, 3), (2, 300, 10), (3, 120, 1)):
        rows = feed(seed, n, memories)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = [tuple(r) for r in H.valid_periods(df).collect()]
        assert len(got) == len(set(got))
        assert set(got) == plain_periods(rows)


def test_periods_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.valid_periods(empty).collect() == []
    nulls = spark.createDataFrame([(1, None, "a", 0.1, "x", None, None, T0, None, None), (None, "m", "a", 0.1, "x", None, None, T0, None, None), (3, "m", None, None, None, None, None, None, None, None)], SCHEMA)
    assert H.valid_periods(nulls).collect() == []
    extra = spark.createDataFrame([(1, "m", "a", 0.1, "x", None, None, T0, None, None)], SCHEMA).selectExpr("*", "1 as start", "2 as stop", "3 as mark", "4 as pid")
    assert [tuple(r) for r in H.valid_periods(extra).collect()] == [("m", 1, 0)]


def test_retrieved_versions(spark):
    rows = feed(5, 300, 8)
    rng = random.Random(9)
    ids = sorted({r[1] for r in rows}) + ["none"]
    events = [(i, rng.choice([None, T0 + timedelta(days=rng.randint(0, 14))]) if i != "hot" else T0 + timedelta(days=7)) for i in ids]
    want = set()
    for i, t in events:
        known = [r for r in {r[0]: r for r in rows}.values() if r[1] == i and t and r[7] <= t and (r[5] or r[7]) <= t]
        if known:
            r = max(known, key=lambda r: (r[5] or r[7], r[7], r[0]))
            start = r[5] or r[7]
            if not (r[6] and r[6] > start and r[6] <= t):
                want.add((i, r[0]))
    m = spark.createDataFrame(events, "id string, last_retrieved_at timestamp_ntz")
    got = H.retrieved_versions(m, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_many_events_of_a_hot_key(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(k, "hot" if rng.random() < 0.7 else f"m{k % 5}", rng.choice("abc"), 0.5, None, rng.choice([None, T0 + timedelta(hours=rng.randint(0, 400))]), None, T0 + timedelta(hours=rng.randint(0, 400)), None, None) for k in range(600)]
    events = [("hot", T0 + timedelta(hours=h)) for h in range(-3, 410)] + [("m1", T0 + timedelta(hours=90)), ("m1", T0 + timedelta(hours=90)), ("none", T0), (None, T0), ("m2", None)]
    v = spark.createDataFrame(rows, SCHEMA).repartition(5)
    e = spark.createDataFrame(events, "memory_id string, at timestamp_ntz").repartition(3)
    history = H.attribute_history(v, "memory_id", F.col("content"), H.start_of(), F.col("system_from"), F.col("version_id"))
    want = {}
    for m, t in events:
        known = [r for r in rows if r[1] == m and t and r[7] <= t and (r[5] or r[7]) <= t]
        if known:
            best = max(known, key=lambda r: (r[5] or r[7], r[7], r[0]))
            want[m, t] = (best[2], best[0])
    got = H.last_known(e, {"all": history}, "memory_id").collect()
    assert {(r["memory_id"], r["at"]): (r["value"], r["tie"]) for r in got} == want and len(got) == len(want)
    # without the rows that change nothing the values are the same
    short = H.changes(history, "memory_id")
    assert short.count() < history.count()
    assert {(r["memory_id"], r["at"]): r["value"] for r in H.last_known(e, {"all": short}, "memory_id").collect()} == {k: x for k, (x, _) in want.items()}


def test_ended_attributes_are_null(spark):
    rows = [(1, "m", "a", 0.5, "x", T0, T0 + timedelta(days=2), T0, None, None), (2, "m", None, 0.5, "y", T0 + timedelta(days=1), None, T0 + timedelta(days=1), None, None)]
    events = spark.createDataFrame([("m", T0 + timedelta(days=d)) for d in range(4)], "memory_id string, at timestamp_ntz").selectExpr("*", "1 as value", "2 as start")
    from pyspark.sql import functions as F

    got = {r["at"].day: (r["content"], r["state"]) for r in H.attributes_at(events, spark.createDataFrame(rows, SCHEMA), "memory_id", ["content", "state"], F.col("valid_to")).collect()}
    assert got == {1: ("a", "x"), 2: ("a", "y"), 3: (None, "y"), 4: (None, "y")}
    assert H.attributes_at(events.where("false"), spark.createDataFrame(rows, SCHEMA), "memory_id", ["content"]).collect() == []


def test_attributes_keep_their_own_history(spark):
    rows = [
        (1, "m", "first", 0.5, None, None, None, T0, None, None),
        (2, "m", None, 0.5, "active", None, None, T0 + timedelta(days=1), None, None),
        (3, "m", "late", 0.5, None, T0, None, T0 + timedelta(days=9), None, None),
    ]
    events = spark.createDataFrame([("m", T0 + timedelta(days=2)), ("other", T0)], "memory_id string, at timestamp_ntz")
    got = {r["memory_id"]: (r["content"], r["state"]) for r in H.attributes_at(events, spark.createDataFrame(rows, SCHEMA), "memory_id", ["content", "state"]).collect()}
    assert got == {"m": ("first", "active"), "other": (None, None)}
