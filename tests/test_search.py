"""Search over the candidates of all sources, on small tables with known results."""

import math
import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from evimem.operators import links as K
from evimem.operators import retrieval as R
from evimem.plans.text import feature_lists, feature_rows

T0 = datetime(2024, 1, 1)


def test_features_find_records_without_a_common_word(spark):
    asked = spark.createDataFrame([(1, ["tok:policies", "stem:policy"], [1.0, 0.72]), (2, ["tok:none"], [1.0])], "query_id bigint, features array<string>, weights array<double>")
    rows = [(f"m{k:03d}", ["stem:policy"], [0.72]) for k in range(1200)] + [("m7", ["tok:policies"], [1.0]), ("m8", ["stem:policy"], [0.5]), ("m9", ["tok:other"], [1.0])]
    index = spark.createDataFrame(rows, "id string, features array<string>, weights array<double>").repartition(3)
    got = [tuple(r) for r in R.by_features(asked, index, 4).orderBy(F.desc("feature_score"), "id").collect()]
    assert got == [(1, "m7", 1.0), (1, "m000", 0.72), (1, "m001", 0.72), (1, "m002", 0.72)]
    assert R.by_features(asked.where("false"), index).collect() == []


def test_sources_and_words_of_candidates(spark):
    queries = spark.createDataFrame([(1, "river bank plans", "p"), (2, "Lantern Core notes", None)], "query_id bigint, text string, project string")
    records = spark.createDataFrame([("a", "p", 0.5), ("b", "Lantern Core", 0.9), ("c", None, 0.9)], "id string, project string, importance double")
    assert {tuple(r)[:2] for r in R.by_project(queries, records).collect()} == {(1, "a")}
    groups = spark.createDataFrame([("Lantern Core",), ("p",)], "name string")
    assert {tuple(r) for r in R.by_neighborhood(queries, records, groups).collect()} == {(2, "b", 1.0)}
    late = spark.createDataFrame([("x", "prospective", T0), ("y", "prospective", datetime(2030, 1, 1)), ("z", "semantic", T0)], "id string, kind string, valid_to timestamp_ntz")
    assert {tuple(r) for r in R.due(queries, late, F.lit(datetime(2025, 1, 1))).collect()} == {(1, "x", 1.0), (2, "x", 1.0)}
    one, two = spark.createDataFrame([(1, "a", -2.0)], "query_id bigint, id string, rank double"), spark.createDataFrame([(1, "a", 0.7), (1, "c", 0.2)], "query_id bigint, id string, feature_score double")
    texts = spark.createDataFrame([("a", "the river bank"), ("c", "something else")], "id string, text string")
    got = {r["id"]: (r["rank"], r["feature_score"], r["matched"], r["n_query"], r["n_record"]) for r in R.matched_words(R.united(one, two), queries, texts).collect()}
    assert got["a"] == (-2.0, 0.7, 2, 3, 2) and got["c"][:4] == (None, 0.2, 0, 3)


def test_walk_adds_new_records_and_lifts_known_ones(spark):
    rows = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.4), (2, "b", 0.6)], "query_id bigint, id string, score double")
    edges = spark.createDataFrame([("a", "b", "leads_to", 1.0), ("b", "c", "leads_to", 1.0)], "src_id string, dst_id string, relation string, weight double")
    boosts = K.reached(R.seeds(rows), edges, depth=1).select(F.col("seed").alias("query_id"), "id", F.col("boost").alias("graph"))
    known, new = R.expanded(rows, boosts)
    assert {tuple(r) for r in known.select("query_id", "id", "score").collect()} == {(1, "a", 0.8), (1, "b", 0.44), (2, "b", 0.6)}
    assert {tuple(r) for r in new.select("query_id", "id", "graph").collect()} == {(1, "c", 0.2), (2, "c", 0.3)}


def test_feature_lists_are_the_feature_rows(spark):
    df = spark.createDataFrame([("a", "Running the policies of statements " + " ".join(f"wordnumber{chr(97 + k)}x" for k in range(30))), ("b", "the"), ("c", None)], "id string, content string")
    listed = feature_lists(df).select("id", F.explode(F.arrays_zip("features", "weights")).alias("x")).select("id", "x.features", "x.weights")
    assert sorted(tuple(r) for r in listed.collect()) == sorted(tuple(r) for r in feature_rows(df).collect())


def test_bm25_of_many_queries(spark, monkeypatch):
    """The best of each query as counted plainly, with equal ranks and repeated query ids; no join makes a row of each hit (F2)."""
    rng = random.Random(5)
    words = [f"word{k}" for k in range(12)]
    texts = [(f"r{k:03d}", " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for k in range(300)] + [("same1", "word0 rare"), ("same0", "word0 rare"), ("none", "the of"), ("null", None)]
    asked = [(q, " ".join(rng.sample([*words, "unknown", "the"], 3))) for q in range(150)] + [(0, "rare"), (200, "the"), (201, "unknown"), (202, None)]
    split = lambda t: [w for w in (t or "").split() if w not in ("the", "of")]
    held = {i: Counter(split(t)) for i, t in texts if split(t)}
    df, mean = Counter(w for c in held.values() for w in c), sum(sum(c.values()) for c in held.values()) / len(held)
    want = []
    for q in {q for q, _ in asked}:
        own = {w for k, t in asked if k == q for w in split(t)}
        part = lambda w, c: max(math.log((len(held) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        hits = sorted((-round(sum(part(w, c) for w in own & c.keys()), 9), i, len(own & c.keys()), len(own), len(c)) for i, c in held.items() if own & c.keys())
        want += [(q, i, *rest, place) for place, (_, i, *rest) in enumerate(hits[:7], 1)]
    queries, records = spark.createDataFrame(asked, "query_id bigint, text string"), spark.createDataFrame(texts, "id string, text string").repartition(5)
    for block in (100_000, 40):
        monkeypatch.setattr(R, "WORD_BLOCK", block)
        found = R.bm25(queries, records, 7)
        assert "Join" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.select("query_id", "id", "matched", "n_query", "n_record", "place").collect()) == sorted(want)
    assert R.bm25(queries.where("false"), records).collect() == R.bm25(queries, records.where("false")).collect() == []
