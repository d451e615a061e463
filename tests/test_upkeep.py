"""Queues, lifecycle, repair proposals, budgets, the role gate and fusion in small known cases."""

import hashlib
import random
import time
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from evimem.functions.hashes import numbered
from evimem.operators import evaluation as E
from evimem.operators import upkeep as U

T0 = datetime(2024, 1, 1)


def test_fresh_rows_do_not_starve_old_ones(spark):
    rows = spark.createDataFrame([(f"{k:02d}", k, k < 4) for k in range(10)], "id string, at int, ok boolean")
    ids = lambda most: [r["id"] for r in U.work_queue(rows, "at", "id", F.col("ok"), most).collect()]
    # the newest three are not due, so the oldest due ones come; with a wider window the due ones in it
    assert ids(3) == ["00", "01", "02"] and ids(8) == ["03", "02"]
    assert U.work_queue(rows.where("false"), "at", "id", F.col("ok"), 3).collect() == []


def test_lifecycle(spark):
    old = lambda days: T0 - timedelta(days=days)
    rows = [
        ("cool", "operational", "active", False, False, 0, 0, None, None, old(120)),
        ("used", "operational", "active", False, False, 0, 0, old(3), None, old(120)),
        ("archive", "semantic", "cold", False, False, 0, 0, None, old(200), old(400)),
        ("not yet", "semantic", "cold", None, None, None, None, None, None, old(100)),
        ("kind", "preference", "active", False, False, 0, 0, None, None, old(999)),
        ("pinned", "semantic", "active", True, False, 0, 0, None, None, old(999)),
        ("helpful", "semantic", "active", False, False, 2, 1, None, None, old(999)),
    ]
    df = spark.createDataFrame(rows, "id string, kind string, state string, pinned boolean, protected boolean, helpful_count bigint, validated_count bigint, last_used_at timestamp_ntz, last_helpful_at timestamp_ntz, updated_at timestamp_ntz")
    assert {(r["id"], r["proposed"]) for r in U.lifecycle(df, F.lit(T0)).collect()} == {("cool", "cold"), ("archive", "archived")}


def test_repairs(spark):
    rows = [
        ("partial", "context_dependent", "use the port", "active", 0.5, {}, [], {}, None),
        ("whole", "context_dependent", "use the port", "active", 0.9, {}, [], {}, None),
        ("pointing", "standalone", "Restart that one first.", "cold", None, {"project": "p"}, [], {}, " "),
        ("plain", "standalone", "Restart the router first.", "active", 0.2, {}, [], {}, None),
        ("archived", "context_dependent", "x", "archived", 0.1, {}, [], {}, None),
    ]
    df = spark.createDataFrame(rows, "id string, context_mode string, content string, state string, metadata_completeness double, scope map<string,string>, entities array<string>, preconditions map<string,string>, source_context string").withColumn("updated_at", F.lit(T0))
    assert {tuple(r) for r in U.repair_proposals(df).collect()} == {("partial", 0.5, "scope, entities, source context, preconditions"), ("pointing", 1.0, "entities, source context, preconditions")}


def test_budgets(spark):
    rows = [("a", "x", "ignored", 100)] * 8 + [("b", "x", "helpful", 590)] * 8 + [("c", "x", "pending", 590)] * 12 + [("d", "x", "ignored", 10)] * 2 + [("e", "y", "ignored", 10)] * 7
    got = {r["t"]: (r["budget"], r["scope"], r["samples"]) for r in U.budgets(spark.createDataFrame(rows, "t string, m string, outcome string, tokens int"), "t", "m", 600).collect()}
    assert got == {"a": (510, "task_mode", 8), "b": (660, "task_mode", 8), "d": (600, "mode", 2), "e": (600, "none", 7)}


def test_role_gate(spark):
    rows = [
        ("reference", 0.3, 0.0, 0.0, 0.0, 0.0, False, True),
        ("reference", 0.05, 0.0, 0.9, 0.0, 0.0, True, False),
        ("reference", 0.05, 0.0, 0.9, 0.0, 1.0, False, True),
        ("reference", 0.1, 0.1, 0.0, 1.0, 0.0, False, False),
        ("event", 0.0, 0.0, 0.0, 0.4, 0.0, False, True),
        ("event", 0.1, 0.0, 0.0, 0.1, 0.0, False, False),
        ("claim", 1.0, 1.0, 0.0, 1.0, 1.0, True, False),
        ("canonical", 0.0, 0.0, 0.0, 0.0, 0.0, False, True),
    ]
    df = spark.createDataFrame(rows, "role string, lexical double, phrase double, graph double, currentness double, support double, technical boolean, want boolean")
    assert all(r["admitted"] == r["want"] for r in U.role_gate(df).collect())


def test_fusion_lifts_and_adds(spark):
    results = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.99), (2, "a", 0.3)], "query_id bigint, id string, score double")
    near = spark.createDataFrame([(1, "b", 0, 0.9), (1, "c", 1, 0.8), (1, "gone", 2, 0.7), (1, "a", 3, 0.0)], "query_id bigint, id string, rank int, similarity double")
    unseen = spark.createDataFrame([(1, "c", 0.2), (1, "d", 0.9)], "query_id bigint, id string, score double")
    got = {(r["query_id"], r["id"]): (r["score"], r["fusion"]) for r in U.fused(results, near, unseen, 10.0).collect()}
    assert got == {(1, "a"): (0.5, 0.0), (1, "b"): (1.0, round(10 / 61, 6)), (2, "a"): (0.3, 0.0), (1, "c"): (round(0.2 + 10 / 62, 6), round(10 / 62, 6))}


def test_nested_bootstrap(spark):
    cells = spark.createDataFrame([(f"d{k}", lab, 5, 10) for k in range(6) for lab in ("x", "y", None)], "cluster string, label string, total int, n int")
    row = E.nested_bootstrap(cells, "label", 50).first()
    assert (row["draws"], row["low"], row["high"]) == (50, 0.5, 0.5)
    mixed = E.nested_bootstrap(cells.withColumn("total", F.when(F.col("cluster") == "d0", 10).otherwise(5)), "label", 200).first()
    assert 0.5 <= mixed["low"] < mixed["middle"] < mixed["high"] < 1


def test_nested_bootstrap_draws_are_those_of_md5(spark):
    """Every draw by plain hashes; a day without a date counts as a place but has no cells, a null label comes first."""
    rng = random.Random(3)
    cells = [(day, lab, rng.randrange(9), 9) for day in ("d0", "d1", "d2", None) for lab in (None, *map(str, range(11 + 100 * (day == "d1"))))]
    pick = lambda n, *parts: int(hashlib.md5(":".join(["7", *map(str, parts)]).encode()).hexdigest()[:8], 16) % n
    days, means = ["d0", "d1", "d2", None], []
    of = {day: [(t, n) for d, _, t, n in sorted(cells, key=lambda c: (c[1] is not None, c[1] or "")) if d == day] for day in days}
    for b in range(1, 41):
        got = [of[day][pick(len(of[day]), b, place, i)] for place in range(4) if (day := days[pick(4, b, place)]) for i in range(len(of[day]))]
        means += [sum(t for t, _ in got) / sum(n for _, n in got)] if got else []
    row = E.nested_bootstrap(spark.createDataFrame(cells, "cluster string, label string, total int, n int"), "label", 40).first()
    want = np.quantile(means, [0.025, 0.5, 0.975]).round(6)
    assert row["draws"] == len(means) and np.allclose([row["low"], row["middle"], row["high"]], want, atol=2e-6)


def test_numbered_hashes():
    prefixes = ["7:1:0:", "7:999:119:", "x" * 40, "y" * 51, "z" * 70]
    want = lambda first, last: [[int(hashlib.md5(f"{p}{k}".encode()).hexdigest()[:8], 16) for k in range(first, last)] for p in prefixes]
    assert numbered(prefixes, 0, 1203).tolist() == want(0, 1203) and numbered(prefixes, 99_990, 100_010).tolist() == want(99_990, 100_010)


def test_nested_bootstrap_of_many_cells(spark):
    """a thousand draws of 60,000 cells were sixty million joined rows; now they are a few thousand sums."""
    cells = spark.range(60_000).select((F.col("id") % 20).cast("string").alias("cluster"), F.col("id").alias("label"), (F.col("id") % 3).alias("total"), F.lit(3).alias("n"))
    began = time.time()
    row = E.nested_bootstrap(cells, "label", 1000).first()
    assert row["draws"] == 1000 and 0.32 < row["low"] < row["middle"] < row["high"] < 0.35 and time.time() - began < 30
