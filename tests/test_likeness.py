"""The likeness of two records in the gate and the score of associations."""

from pyspark.sql import functions as F

from evimem.operators import links as K
from evimem.plans.text import feature_lists


def test_likeness_gates_and_scores(spark):
    texts = spark.createDataFrame([("a", "alpha bravo charlie"), ("b", "alpha bravo charlie"), ("c", "xylophone quartz"), ("d", None)], "id string, content string")
    support = spark.createDataFrame([("a", "b", 3, 0), ("a", "c", 3, 0), ("b", "c", 2, 1), ("a", "d", 3, 0)], "src_id string, dst_id string, witnesses bigint, helpful bigint")
    rows = K.similarity(K.gated(support), feature_lists(texts))
    got = {(r["src_id"], r["dst_id"]): r["similarity"] for r in rows.collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0, ("a", "d"): 0.0}
    # three witnesses that did not help are not enough for records that are not alike
    assert {(r["src_id"], r["dst_id"]) for r in K.alike(rows).collect()} == {("a", "b"), ("b", "c")}
    scores = rows.select("src_id", "dst_id", K.replay_score(F.lit(0.8), F.lit(0.4), F.col("similarity")).alias("s")).collect()
    assert {(r["src_id"], r["dst_id"]): r["s"] for r in scores} == {("a", "b"): 0.4, ("a", "c"): 0.3, ("b", "c"): 0.3, ("a", "d"): 0.3}
