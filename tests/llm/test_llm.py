"""Operators for training data against plain versions, known cases, and odd tables."""

import random
import re
import unicodedata
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evimem.llm import copies, cuts, digests, mixing, neardup, personal, reading, tokens

# ------------------------------------------------------------------------------------------------ digests


def test_digests_merge_within_bounds():
    rng = np.random.default_rng(3)
    for values in (rng.lognormal(3, 2, 40_000), rng.integers(0, 40, 40_000).astype(float), np.r_[np.zeros(30_000), rng.random(10_000)]):
        parts = []
        for chunk in np.array_split(rng.permutation(values), 23):
            z = np.zeros(len(chunk), int)
            parts.append(digests.clustered(z, chunk, chunk, chunk, np.ones(len(chunk))))
        codes, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, means, lows, highs, weights = digests.clustered(codes, *rest)
        assert weights.sum() == len(values) and len(means) < 2 * digests.DELTA
        for q in (0.01, 0.5, 0.9, 0.99):
            x = digests._value(np.array([q]), float(len(values)), means, lows, highs, weights)[0]
            low, high = (values < x).mean(), (values <= x).mean()
            assert max(low - q, q - high, 0) < digests.BOUND


def test_percentiles_of_odd_rows(spark):
    schema = "observation_id bigint, model string, condition string, run_at timestamp_ntz, received_at timestamp_ntz, agent_ttft_ms double, memory_prepare_ms double, reported_prompt_tokens bigint, day string"
    t = datetime(2024, 1, 1)
    rows = [(k, "m", None, t, t, v, -1.0, 0, "x") for k, v in enumerate([1.0, 2.0, 3.0, None, float("nan"), -5.0, float("inf")])] + [(0, "m", None, t, datetime(2024, 1, 2), 99.0, 1.0, 5, "x"), (None, "m", None, t, t, 7.0, 7.0, 7, "x")]
    df = spark.createDataFrame(rows, schema)
    out = digests.percentiles(digests.observations(df), ["model", "condition"], "day", ["agent_ttft_ms", "memory_prepare_ms", "reported_prompt_tokens"]).collect()
    assert {r["metric"] for r in out} == {"agent_ttft_ms"} and {r["n"] for r in out} == {3}
    assert {(r["day"], r["value"]) for r in out if r["level"] == 0.5} == {(None, 2.0), (date(2024, 1, 1), 2.0)}
    assert all(r["certified"] for r in out)
    # deliveries received at once: the least values, in whatever order the rows come
    tied = spark.createDataFrame([(7, "m", "c", t, t, v, 1.0, 5, "x") for v in (3.0, 1.0, 2.0)] + [(7, "m", "c", t, None, 0.5, 1.0, 5, "x")], schema)
    for parts in (1, 4):
        assert [r["agent_ttft_ms"] for r in digests.observations(tied.repartition(parts)).collect()] == [1.0]
    assert digests.percentiles(digests.observations(df.where("false")), ["model", "condition"], "day", ["agent_ttft_ms"]).collect() == []


def test_percentiles_of_a_hot_group_in_levels(spark):
    kept, digests.FAN, small, digests.SMALL_GROUPS = digests.FAN, 2, digests.SMALL_GROUPS, 0
    try:
        df = spark.range(0, 5000, 1, 7).selectExpr("'hot' as g", "date '2024-01-01' as day", "cast(id as double) as x")
        out = {(r["day"], r["level"]): r for r in digests.percentiles(df, ["g"], "day", ["x"]).collect()}
    finally:
        digests.FAN, digests.SMALL_GROUPS = kept, small
    assert out[None, 0.5]["n"] == 5000 and abs(out[None, 0.5]["value"] - 2500) < 50 and all(r["certified"] for r in out.values())


# ------------------------------------------------------------------------------------------------ cuts


def test_limits_are_found(spark):
    rng = random.Random(1)
    # lengths thin out by themselves, as those of texts do; at 150 far too many end
    rows = [("s", "chars", n, int(60 * 0.97 ** (n - 100)) + rng.randint(0, 2)) for n in range(100, 260)] + [("s", "chars", 150, 400), ("free", "chars", 90, 3)]
    df = spark.createDataFrame(rows, "source string, unit string, length int, n bigint").groupBy("source", "unit", "length").sum("n").withColumnRenamed("sum(n)", "n")
    assert [(r["source"], r["length"]) for r in cuts.limits(df).collect()] == [("s", 150)]


def corpus(n=400):
    rng = random.Random(2)
    noun = ["valve", "anchor", "ledger", "tunnel", "bobbin", "harbor", "kitchen", "mirror"]
    place = ["pantry", "annex", "studio", "attic"]

    def sentence():
        return rng.choice([f"The old {rng.choice(noun)} was moved to the {rng.choice(noun)} in {rng.choice(place)}.", f"Ask the crew before the {rng.choice(noun)} is renamed in {rng.choice(place)}.", f"Keep the {rng.choice(noun)} away from the {rng.choice(noun)} near {rng.choice(place)}."])

    return [" ".join(sentence() for _ in range(4)) for _ in range(n)]


def test_cut_texts(spark):
    rows = [(f"w{k}", t, "a") for k, t in enumerate(corpus())]
    odd = {
        "mid word": ("Keep the valve away from the mir", True),
        "mid sentence": ("The old ledger was moved to the", True),
        "marked": ("Keep the valve away from the mir [truncated]", True),
        "record": ('{"owner": "the crew", "place": "att', True),
        "broken byte": ("Keep the valve away from the m�", True),
        "whole": ("Keep the valve away from the mirror near attic.", False),
        "open": ("Keep the valve away from the mirror near attic", False),
        "dots": ("Keep the valve away from the mirror near attic...", False),
        "whole record": ('{"owner": "the crew", "place": "attic"}', False),
        "list": ("owner: crew\nplace: attic", False),
    }
    rows += [(k, t, "a") for k, (t, _) in odd.items()] + [("null", None, "a"), ("empty", "", "a"), ("blank", " … ", None), ("same", odd["whole"][0], None), ("same", odd["whole"][0], None)]
    df = spark.createDataFrame(rows, "id string, content string, source_type string").selectExpr("*", "'x' as key", "'y' as source", "'z' as text")
    got = [(r["key"], r["cut"]) for r in cuts.judged(df, "id", "content", "source_type").collect()]
    assert {k: v for k, v in got if k in odd} == {k: v for k, (_, v) in odd.items()}
    assert sum(k == "same" for k, _ in got) == 2 and not {"null", "empty", "blank"} & {k for k, _ in got}
    assert not any(v for k, v in got if k.startswith("w"))
    assert cuts.judged(df.where("false"), "id", "content", "source_type").collect() == []
    assert {r["source"] for r in cuts.report(df, "id", "content", "source_type").collect()} == {"a", None}


# ------------------------------------------------------------------------------------------------ personal information

PII = [
    ("Call +1 617 555 0104 and ask for Hamza Gravholt about it. Order reference 5579 7063 8166 belongs to it.", ["phone", "name"]),
    ("Write to goran+lantern@example.com once it is done. Pinned oskwon@2.25.3 in the lockfile.", ["email"]),
    ("Write to mira dot haskic at example dot com once it is done.", ["email"]),
    ("New hire Ines Sundescu, DNI 00007680-Y, joins us in July.", ["name", "id_number"]),
    ("Greta Daskholt lives at Flat 12, 22 Copperfield Road, Valdorno and signs for it.", ["name", "address"]),
    ("The chair goes to plaza de la Noria 94, 1º B, Petitmarais.", ["address"]),
    ("As Osteroye, Leila told R. Stelini last Monday, it is merged. Amber Falcon is the release name for it.", ["name", "name"]),
    ("We were given Steuer-ID 00 931 567 842 for the account. Job ran at 2025-05-19 00:15:00 with batch 2025016895.", ["id_number"]),
    ("Main Street is only the nickname of the branch.", []),
]


def pii_rows():
    return [(f"{k}-{n}", text, None) for n in range(12) for k, (text, _) in enumerate(PII)]


def test_mentions(spark):
    df = spark.createDataFrame(pii_rows() + [("null", None, "call +44 20 7946 0185 now"), ("empty", "", None), ("long", "word " * 20_000 + "x" * 50_000, None)], "id string, content string, reason string").selectExpr("*", "'c' as key", "'d' as field")
    got: dict = {}
    # the one turned name is given as gazetteer: nine sentences teach no given names
    for r in personal.mentions(df, "id", ["content", "reason"], personal.Finder(given=["Leila"])).collect():
        got.setdefault(r["id"], []).append((r["start"], r["pii_type"], r["nth"], r["field"]))
    for k, (_, kinds) in enumerate(PII):
        assert [x[1] for x in sorted(got.get(f"{k}-3", []))] == kinds, PII[k]
    assert [x[2] for x in sorted(got["6-0"])] == [1, 2]
    assert [x[1:] for x in got["null"]] == [("phone", 1, "reason")] and "long" not in got
    assert personal.mentions(df.where("false"), "id", ["content", "reason"]).collect() == []


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame(pii_rows(), "id string, content string, reason string")
    got = {r["id"]: r["text"] for r in personal.redacted(df, "id", ["content", "reason"]).collect()}
    assert got["4-0"] == "[NAME] lives at [ADDRESS] and signs for it." and got["8-0"] == PII[8][0]
    assert got["0-0"].startswith("Call [PHONE] and ask for [NAME] about it. Order reference 5579")


# ------------------------------------------------------------------------------------------------ near duplicates and copies


def texts_with_copies(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out)[:]
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(base)
        else:
            out.append([rng.choice(words) for _ in range(rng.randint(1, 40))])
    rows = [(f"d{k:04d}", " ".join(w)) for k, w in enumerate(out)]
    rows += [("null", None), ("empty", ""), ("signs", "…"), ("zz1", rows[0][1].upper() + "!"), ("zz2", rows[0][1])]
    return rows


def word_set(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def sequence(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


@pytest.mark.parametrize("seed, n, vocabulary, aim, share", [(1, 120, 60, 200, 0.7), (2, 150, 400, 3, 0.7), (3, 120, 40, 1, 0.7), (4, 120, 60, 1, 0.5), (5, 120, 30, 4, 0.34), (6, 120, 60, 1, 0.9)])
def test_similar_pairs_are_all_found(spark, seed, n, vocabulary, aim, share):
    rows = texts_with_copies(seed, n, vocabulary)
    rows += [("s1", "one"), ("s2", "one two"), ("s3", "one two three four"), ("s4", "two one"), ("s5", "w1"), ("s6", "w1 w2")]
    kept, neardup.LIST = neardup.LIST, aim
    try:
        df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "1 as words", "2 as key", "3 as record", "4 as set", "5 as canon")
        got = [tuple(r) for r in neardup.similar_pairs(df, "id", "content", share).collect()]
    finally:
        neardup.LIST = kept
    want = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            p, q = word_set(x), word_set(y)
            if p and q and len(p & q) >= share * len(p | q) - 1e-9 and sequence(x) != sequence(y):
                want.add((min(a, b), max(a, b)))
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_pairs_of_odd_tables(spark):
    schema = "id string, content string"
    assert neardup.similar_pairs(spark.createDataFrame([], schema), "id", "content").collect() == []
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "…"), (None, "one two"), ("d", "one two"), ("e", "two one"), ("e", "two one")], schema)
    assert sorted(tuple(r) for r in neardup.similar_pairs(df, "id", "content").collect()) == [("d", "e"), ("d", "e")]


def test_hot_signatures_are_salted(spark):
    rows = texts_with_copies(7, 100, 40)
    df = spark.createDataFrame(rows, "id string, content string")
    plain = {tuple(r) for r in neardup.similar_pairs(df, "id", "content").collect()}
    kept, neardup.hot_keys = neardup.hot_keys, lambda rows, key, *_: [r[0] for r in rows.select(key).distinct().limit(200).collect()]
    try:
        salted = [tuple(r) for r in neardup.similar_pairs(df, "id", "content").collect()]
    finally:
        neardup.hot_keys = kept
    assert set(salted) == plain and len(salted) == len(plain) > 10


def test_groups(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [("a", a), ("b", a + " eleven"), ("c", a + " eleven twelve"), ("d", a + " eleven twelve x y"), ("e", a.upper()), ("f", "nothing like it"), ("g", None)]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "1 as label", "2 as record")
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.groups(df, "id", "content", 0.8).collect()}
    # a-b, a-c, b-c, c-d, b-d (11 of 14 words) is below .8
    assert got == {"a": ("a", 2), "e": ("a", 2), "b": ("a", 2), "c": ("a", 3), "d": ("a", 1), "f": ("f", 0)}


def test_components_of_a_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([(f"{k:03d}",) for k in range(n)], "key string")
    pairs = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(n - 1) if k != 40], "a string, b string")
    got = {r["key"]: r["label"] for r in neardup.components(nodes, pairs).collect()}
    assert {got[f"{k:03d}"] for k in range(41)} == {"000"} and {got[f"{k:03d}"] for k in range(41, n)} == {"041"}


def test_copies(spark):
    rows = [
        ("c", "owner: crew\nplace: the attic"),
        ("a", "Place = The Attic\nowner = CREW"),
        ("b", '{"place": "the attic", "owner": "crew"}'),
        ("d", "owner: crew place: the attic"),
        ("e", "The old valve."),
        ("f", "  the OLD-valve!  "),
        ("g", "the valve old"),
        ("h", "…"),
        ("i", ""),
        ("j", None),
        ("k", '{"place": "the attic"'),
        (None, "The old valve."),
    ]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "1 as sequence", "2 as first", "3 as canon")
    got = {tuple(r) for r in copies.copy_pairs(df, "id", "content").collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("e", "f")}
    counts = {r["id"]: r["copies"] for r in copies.records(df, "id", "content").collect()}
    assert counts == {"a": 4, "e": 2, "g": 1, "k": 1}
    assert copies.copy_pairs(df.where("false"), "id", "content").collect() == []


def test_filter_never_misses_a_repeat(spark):
    rng = random.Random(4)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    rows = [(v,) for v in values + values[:500]]
    df = spark.createDataFrame(rows, "hash bigint").repartition(5)
    bits, slots = copies.repeats_filter(df)
    kept = df.distinct().where(copies.maybe_repeated(bits, slots)("hash")).collect()
    found = {r[0] for r in kept}
    assert set(values[:500]) <= found and len(found) < 600


def test_rounds_give_the_same_copies(spark):
    rng = random.Random(6)
    rows = [(f"d{k:04d}", f"text {rng.randrange(900)}" if k % 3 else f"name: n{rng.randrange(300)}\nplace: p") for k in range(1500)]
    df = spark.createDataFrame(rows, "id string, content string").repartition(5)
    plain = {tuple(r) for r in copies.copy_pairs(df, "id", "content").collect()}, sorted(tuple(r) for r in copies.records(df, "id", "content").collect())
    kept, copies.ROUND_SLOTS = copies.ROUND_SLOTS, 1 << 12
    try:
        rounds = {tuple(r) for r in copies.copy_pairs(df, "id", "content").collect()}, sorted(tuple(r) for r in copies.records(df, "id", "content").collect())
    finally:
        copies.ROUND_SLOTS = kept
    assert rounds == plain and len(plain[0]) > 300 and sum(n for _, n in plain[1]) == 1500


def test_hot_copies_are_salted(spark):
    rows = [(f"k{n}", "the same text") for n in range(60)] + [(f"x{n}", f"other {n}") for n in range(60)]
    df = spark.createDataFrame(rows, "key string, t string").selectExpr("key", "t as canon")
    ones = df.groupBy("canon").count()
    from pyspark.sql import functions as F

    plain = {tuple(r) for r in df.join(ones, "canon").select("key", "count").collect()}
    kept, copies.HOT_SHARE = copies.HOT_SHARE, 1 / 64
    try:
        sized = ones.withColumn("count", F.when(F.col("count") > 50, F.lit(1_000_000)).otherwise(F.col("count")))
        salted = copies.spread_join(df, sized, "canon", "count").select("key")
    finally:
        copies.HOT_SHARE = kept
    assert {r[0] for r in salted.collect()} == {k for k, _ in plain} and salted.count() == 120


# ------------------------------------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def known():
    return tokens._loaded(Path(tokens.vocabulary_file()).read_text())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_file())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


PARTS = st.sampled_from(["a", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "²", "Ⅷ", "½", "é", "ß", "日本", "́", "🙂", "_", "'s", "'LL", "12", "<|endoftext|>", "​", "\x00", "ٱ", "١", "…", "-", "The", " token", "izing"])


@settings(max_examples=300, deadline=None)
@given(text=st.lists(PARTS, max_size=25).map("".join), more=st.lists(PARTS, max_size=6).map("".join))
def test_ids_are_those_of_the_public_tokenizer(known, reference, text, more):
    ids = tokens.encode(text, known)
    assert ids == reference(text)
    longer, _ = tokens.edited(tokens.stored(text, known.bpe), len(text), len(text), more, known.bpe)
    assert longer.ids(known.bpe) == reference(text + more)


@settings(max_examples=300, deadline=None)
@given(text=st.lists(PARTS, max_size=30).map("".join), new=st.lists(PARTS, max_size=4).map("".join), a=st.integers(0, 60), n=st.integers(0, 8))
def test_edits_are_encoded_as_whole_texts(known, reference, text, new, a, n):
    a = min(a, len(text))
    b = min(a + n, len(text))
    changed, _ = tokens.edited(tokens.stored(text, known.bpe), a, b, new, known.bpe)
    assert changed.text == text[:a] + new + text[b:] and changed.ids(known.bpe) == reference(changed.text)


def test_edits_cost_what_they_change(known, reference):
    text = "The quick brown fox jumps over the lazy dog. " * 2000
    old = tokens.stored(text, known.bpe)
    changed, work = tokens.edited(old, 45_004, 45_009, "slow", known.bpe)
    assert changed.ids(known.bpe) == reference(changed.text) and work < 60
    long = tokens.stored("ab" * 50_000, known.bpe)
    longer, work = tokens.edited(long, 100_000, 100_000, "abc", known.bpe)
    assert work <= 3 and longer.ids(known.bpe) == tokens.stored(longer.text, known.bpe).ids(known.bpe)


def test_a_table_goes_on_where_it_ended(known):
    piece = "unbelievablylongwordindeed".encode()
    whole = known.bpe.table(piece)
    assert known.bpe.table(piece, known.bpe.table(piece[:9])) == whole


def test_long_texts_take_linear_time(known):
    ids = tokens.encode("ab" * 100_000, known)
    assert b"".join(known.bpe.bytes_of[i] for i in ids) == b"ab" * 100_000


def test_token_queries(spark, reference):
    rows = [(1, "Hello  wörld\n"), (2, ""), (3, None), (1, "Hello  wörld\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids", "'y' as n_tokens")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.token_ids(df, "doc_id", "text").collect())
    assert got == sorted([(1, reference("Hello  wörld\n"))] * 2 + [(2, []), (3, [])])
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(df, ["doc_id"], "text").collect()}
    assert sizes == {1: len(reference("Hello  wörld\n")), 2: 0, 3: 0}
    assert tokens.token_ids(df.where("false"), "doc_id", "text").collect() == []


# ------------------------------------------------------------------------------------------------ mixing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_schedule_is_fair(shares):
    blocks = mixing.cycle([float(s) for s in shares])
    order = mixing.fair_schedule(blocks)
    n, got = sum(blocks), [0] * len(blocks)
    assert len(order) == n
    for t, s in enumerate(order, 1):
        got[s] += 1
        assert all(abs(got[k] * n - blocks[k] * t) < n for k in range(len(blocks)))
    assert got == blocks


def test_rounded_weights_are_near():
    weights = [0.1234501, 0.4999999, 0.37655]
    blocks = mixing.cycle(weights)
    assert sum(blocks) == mixing.CYCLE and all(abs(n / mixing.CYCLE - w) <= 1 / mixing.CYCLE for n, w in zip(blocks, weights, strict=True))


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(k) for _ in range(30)), "big" if k < 300 else "small") for k in range(340)]
    rows += [(900, None, "big"), (901, "", "big"), (902, "text without source", None), (903, rows[0][1], "big"), (904, "listed nowhere", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as key", "2 as n_tokens")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("missing", 0.1, 2)], "source string, target_share double, max_repeats bigint")
    mix, report = mixing.mixed(docs, targets, "doc_id", "text", "source", block=64)
    used: dict = {}
    for r in mix.collect():
        used.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(len(v) == len(set(v)) <= {"big": 1, "small": 4}[s] for (s, _), v in used.items())
    assert not {900, 901, 902, 904} & {k for _, k in used} and not {0, 903} <= {k for _, k in used}
    shares = {r["source"]: (r["scaled_share"], r["actual_share"]) for r in report.collect()}
    assert shares["missing"] == (0.0, 0.0)
    assert all(abs(a - b) < 0.03 for a, b in shares.values())
    assert {r["source"]: round(r["scheduled_share"], 9) for r in report.collect()} == {"big": round(2 / 3, 9), "small": round(1 / 3, 9), "missing": 0.0}
    empty, none = mixing.mixed(docs.where("false"), targets, "doc_id", "text", "source")
    assert empty.collect() == [] and {r["tokens_used"] for r in none.collect()} == {0}


# ------------------------------------------------------------------------------------------------ reading levels


def graded():
    rng = random.Random(6)
    easy, hard = "cat dog sun hat run see big red box cup".split(), "epistemology heterogeneity calibration provenance methodological irreconcilable counterfactual".split()
    common = "the and of to in is it with for on".split()

    def text(level, n=60):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(hard if rng.random() < (level - 1) / 4 else easy) for _ in range(n)) + "."

    return text


def test_levels_follow_the_text(spark):
    text = graded()
    passages = spark.createDataFrame([("en", text(level), level) for level in range(1, 6) for _ in range(4)], "lang string, text string, reading_level bigint")
    rows = [(k, text(1 + k % 5, 150)) for k in range(100)] + [(500, None), (501, ""), (502, "…"), (503, '{"a": 1}\n' * 30), (504, "cat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as level", "3 as lang")
    got = {r["doc_id"]: (r["level"], r["prose"]) for r in reading.levels(docs, "doc_id", "text", passages).collect()}
    assert len(got) == 105
    right = sum((got[k][0] >= 3.5) == (k % 5 >= 3) for k in range(100))
    assert right >= 95 and all(got[k][1] for k in range(100))
    assert [got[k] for k in (500, 501, 502)] == [(None, False)] * 3 and not got[503][1] and not got[504][1]
    assert reading.levels(docs.where("false"), "doc_id", "text", passages).collect() == []
    assert {r["level"] for r in reading.levels(docs, "doc_id", "text", passages.where("false")).collect()} == {None}


def test_odd_characters_are_known():
    assert all(unicodedata.category(c) in ("Nl", "No") or ord(c) < 0x20 for c in tokens._odd_characters())
