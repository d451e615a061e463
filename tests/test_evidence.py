"""Association evidence counts all memories of a task, and conflicts any number of values."""

from test_core import USAGE, use

from evimem.operators import links as K


def test_evidence_is_not_capped(spark):
    rows = [use(f"{t}{k}", "helpful", True, task=t, memory=f"m{k:03d}", attribution=k / 100) for t in "ab" for k in range(40)]
    usage = spark.createDataFrame(rows, USAGE)
    support = K.association_support(K.used_pairs(usage, None)).collect()
    assert len(support) == 780 and all((r["witnesses"], r["helpful"]) == (2, 2) for r in support)
    kept, K.hot_keys = K.hot_keys, lambda *a, **k: ["a"]
    try:
        assert K.used_pairs(usage, None).count() == K.used_pairs(usage, None).distinct().count() == 1560
    finally:
        K.hot_keys = kept


def test_conflicts_of_many_values(spark):
    df = spark.createDataFrame([("s", str(k)) for k in range(60)] + [("one", "x")], "k string, v string")
    assert [tuple(r) for r in K.conflicting_groups(df, ["k"], "v").collect()] == [("s", 60, 60)]
