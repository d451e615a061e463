"""Near-duplicate texts: exact set-similarity join over vertical fragments of the global word order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimem.functions.skew import hot_keys, salt, spread
from evimem.llm.copies import WAYS, fields
from evimem.session import discard, spread_out, written

#: Buckets of the frequency sketch that orders words; its size does not depend on the data.
BUCKETS = 1 << 20
#: Texts that a signature is meant to have, on average: it decides how many words a fragment's signatures take, never the result.
LIST = 200
#: Fragments of each kind: those of words that are signatures alone, two at a time, three at a time, and so on.
FRAGMENTS = (1, 6, 3, 2)
#: Parts of the order over which the overlaps of candidates are counted separately.
PARTS = 4


def words(runs: Column) -> Column:
    """The set of words (runs of letters and digits, lower-cased), sorted, between blanks."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.array_join(runs, " ")), " "))), " ")


def hashed(joined: Column) -> Column:
    """The words of a set as 64-bit hashes."""
    return F.transform(F.split(joined, " "), lambda w: F.xxhash64(w))


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How many sets hold a word of each bucket: an upper bound of each word's frequency, of fixed size."""
    buckets = F.transform(F.split("words", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    found = sets.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toPandas()
    sketch = np.zeros(BUCKETS, np.int64)
    sketch[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return sketch


def needed(n, m, share: float):
    """Least number of common words of sets of n and m words whose similarity is `share` or more."""
    return np.ceil(share / (1 + share) * (n + m) - 1e-9).astype(np.int64)


class Order:
    """The global word order, rarest first, cut into fragments.

    The cuts lie where a signature of k words would have more than `LIST` texts if words came independently: a word in c of N texts
    is in a fragment of kind k if c ** k <= LIST * N ** (k - 1). Within a kind words are dealt to several fragments by their hash, so that
    words of one phrase, which are equally frequent, seldom meet in one.
    """

    def __init__(self, sketch: np.ndarray, sets: int):
        self.sketch = sketch
        kinds = range(1, len(FRAGMENTS))
        self.tops = np.array([(LIST * float(max(sets, 1)) ** (k - 1)) ** (1 / k) for k in kinds])
        self.first = np.cumsum((0, *FRAGMENTS))
        counts = np.sort(sketch[sketch > 0])
        upto = np.cumsum(counts)
        self.parts = np.array([counts[np.searchsorted(upto, upto[-1] * k / PARTS)] for k in range(1, PARTS)]) if len(counts) else np.array([1])

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return self.sketch[hashes % BUCKETS]

    def fragment(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fragment and kind (words of a signature) of each word."""
        kind = np.searchsorted(self.tops, counts) + 1
        ways = np.asarray(FRAGMENTS)[kind - 1]
        return self.first[kind - 1] + ((hashes >> 23) % ways), kind


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a hash and another value."""
    h = (h ^ more) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _running(groups: np.ndarray) -> np.ndarray:
    """How many rows before it have the same value, for each row of an array whose equal values follow each other."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def signatures(row: np.ndarray, size: np.ndarray, h: np.ndarray, order: Order, share: float, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of sets: place of the set, signature, gain before its last word.

    row, h: the words of all sets, those of one set together; size: words of each set. A signature takes k words of one fragment of
    kind k. Gain counts the words of a set, in the order, beyond the first k - 1 of each fragment. Of two similar sets take their
    common words in order: when these first have k of one fragment, each set's words before the last of them have at most as much gain as the set
    has words that the other lacks. So signatures with more gain before their last word than may be lacking are not made. Common words may
    have k of no fragment only in sets whose whole gain is no more than that; these have signatures of single words besides (`single`).
    """
    counts = order.counts(h)
    by = np.lexsort((h, counts, row))
    row, h, counts = row[by], h[by], counts[by]
    fragment, kind = order.fragment(h, counts)
    if single:
        fragment, kind = np.zeros_like(fragment), np.ones_like(kind)
    lacking = size - np.ceil(share * size - 1e-9).astype(np.int64)
    groups = np.lexsort((fragment, row))  # stable: within a fragment the order stays
    at = np.empty(len(h), np.int64)
    at[groups] = _running(row[groups] * 64 + fragment[groups])
    counted = (at >= kind - 1).astype(np.int64)
    upto = np.cumsum(counted)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    base = np.repeat(upto[starts] - counted[starts], np.diff(np.r_[starts, len(row)])) if len(row) else upto
    before = upto - counted - base
    whole = np.zeros(len(size), np.int64)
    np.maximum.at(whole, row, upto - base)
    fits = before <= lacking[row]
    if single:
        fits &= True
    # the words of each (set, fragment) follow each other in this view
    g_row, g_h, g_kind, g_at, g_before = row[groups], h[groups].view(np.uint64), kind[groups], at[groups], before[groups]
    ends = np.flatnonzero((fits & counted.astype(bool) & ((counts > 1) | (kind > 1)))[groups])
    sig = _mixed(np.full(len(ends), 0x9E3779B97F4A7C15 + single, np.uint64), g_h[ends])
    last, left, first = ends, g_kind[ends] - 1, ends
    out = []
    while len(last):
        done = left == 0
        out.append((last[done], sig[done]))
        last, left, first, sig = last[~done], left[~done], first[~done], sig[~done]
        # every earlier word of the fragment before the first one taken so far
        n = g_at[first]
        rep = np.repeat(np.arange(len(first)), n)
        earlier = first[rep] - 1 - _running(rep)
        sig, last, left, first = _mixed(sig[rep], g_h[earlier]), last[rep], left[rep] - 1, earlier
        keep = g_at[first] >= left
        sig, last, left, first = sig[keep], last[keep], left[keep], first[keep]
    last, sig = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in out] or [np.zeros(0, np.uint64)])
    result = g_row[last], sig.view(np.int64), g_before[last]
    few = np.flatnonzero(whole <= lacking)
    if single or not len(few):
        return result
    mask = np.isin(row, few)
    extra = signatures(row[mask], size, h[mask], order, share, True)
    return tuple(np.concatenate(x) for x in zip(result, extra, strict=True))


def _signed(order, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["hashes"].str.len().to_numpy(np.int64)
            h = np.concatenate([np.asarray(x, np.int64) for x in b["hashes"]]) if len(b) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(b)), size)
            low, high = _bits(h, of, len(b))
            row, sig, gain = signatures(of, size, h, order.value, share)
            small = size - needed(size, size, share)  # words that a set may lack in common with a larger one
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "low": low[row], "high": high[row], "sig": sig, "facts": size[row] << 32 | gain << 1 | (gain <= small[row])})

    return run


def _bits(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a bit map of 128 bits in which each word sets one, for each of n sets."""
    maps = np.zeros((2, n), np.uint64)
    at = h.view(np.uint64) >> np.uint64(30)
    np.bitwise_or.at(maps, ((at >> np.uint64(6)).astype(np.int64) & 1, row), np.uint64(1) << (at & np.uint64(63)))
    return maps[0].view(np.int64), maps[1].view(np.int64)


def _parted(order):
    """The words of each set in the parts of the order, one row a part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for set_, hashes in zip(b["id"], b["hashes"], strict=True):
                h = np.asarray(hashes, np.int64)
                part = np.searchsorted(order.value.parts, order.value.counts(h), side="right")
                out += [(set_, p, h[part == p]) for p in range(PARTS)]
            yield pd.DataFrame(out, columns=["id", "part", "some"])

    return run


def _need(n: str, m: str, share: float) -> Column:
    return F.ceil(F.lit(share / (1 + share)) * (F.col(n) + F.col(m)) - 1e-9)


def candidates(sets: DataFrame, order, share: float) -> DataFrame:
    """`a, b, n_a, n_b`: pairs of sets that share a signature and that sizes, gains and bit maps do not rule out."""
    made = spread_out(sets.select("id", hashed(F.col("words")).alias("hashes")))
    rows = written(made.mapInPandas(_signed(order, share), "id bigint, low bigint, high bigint, sig bigint, facts bigint"), "signatures")
    hot = hot_keys(rows, "sig", 1 / 4096, 4096)
    parts = lambda df, k: df.select("sig", "_salt", F.col("id").alias(f"id{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("low", "high")], F.shiftright("facts", 32).cast("int").alias(f"n{k}"), F.shiftright(F.col("facts").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int").alias(f"gain{k}"))
    probe = parts(rows.withColumn("_salt", salt("sig", hot, F.col("id"), WAYS)), 1)
    index = parts(spread(rows.where(F.col("facts").bitwiseAND(F.lit(1)) == 1), "sig", hot, WAYS), 2)
    # the larger set of a pair probes; ids decide between equal sizes
    need = _need("n1", "n2", share)
    missing, lacking = (sum(F.bit_count(F.col(f"{c}{x}").bitwiseAND(F.bitwise_not(f"{c}{y}"))) for c in ("low", "high")) for x, y in ((1, 2), (2, 1)))
    ahead = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("id1") > F.col("id2")))
    fits = (F.col("n2") >= need) & (F.col("gain1") <= F.col("n1") - need) & (F.col("gain2") <= F.col("n2") - need) & (missing <= F.col("n1") - need) & (lacking <= F.col("n2") - need)
    pairs = probe.join(index, ["sig", "_salt"]).where(ahead & fits)
    found = written(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("n1").alias("n_a"), F.col("n2").alias("n_b")).distinct(), "candidates")
    discard(rows)
    return found


def fragment_overlaps(pairs: DataFrame, parted: DataFrame) -> DataFrame:
    """`pairs` (a, b, n_a, n_b) with `common`: the words that both have in each part of the order, counted separately and summed."""
    left = parted.select(F.col("id").alias("a"), "part", F.col("some").alias("some_a")).where(F.size("some_a") > 0)
    right = parted.select(F.col("id").alias("b"), "part", F.col("some").alias("some_b")).where(F.size("some_b") > 0)
    counted = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("some_a", "some_b")).alias("partial"))
    return counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("common"))


def similar_sets(sets: DataFrame, share: float) -> DataFrame:
    """Pairs `a, b` of different word sets (`id, words`, one row a set) whose intersection is at least `share` of their union.

    The global word order is cut into fragments (see `Order`); sets meet in a fragment where they have as many words in common as
    a signature of it takes. Sizes, gains and bit maps discard most of these pairs; for the rest the overlaps are counted in each part of the order
    and summed. No pair is dropped without proof, so the result is exact (up to equal 64-bit hashes of different words), for any
    `share` above 0 and sets of any size, single words included. Signatures that many sets have are salted.
    """
    order = sets.sparkSession.sparkContext.broadcast(Order(frequency_sketch(sets), sets.count()))
    pairs = candidates(sets, order, share)
    some = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    parted = written(some.select("id", hashed(F.col("words")).alias("hashes")).mapInPandas(_parted(order), "id bigint, part int, some array<bigint>"), "parts")
    found = written(fragment_overlaps(pairs, parted).where(F.col("common") >= _need("n_a", "n_b", share)).select("a", "b"), "similar")
    discard(pairs, parted)
    return found


def _sets(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The members (`key, set, sequence, record`) of all texts with words, and their different word sets (`id, set, words`)."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    found = spread_out(df.select(F.col(key), F.col(text))).select(F.col(key).alias("key"), F.col(text).alias("text"), runs.alias("runs")).where("key is not null and size(runs) > 0")
    digest = lambda c: F.unhex(F.md5(c))
    rows = found.select("key", words(F.col("runs")).alias("words"), digest(F.lower(F.array_join("runs", ""))).alias("sequence"), digest(F.array_join(fields(F.col("text")), "\n")).alias("record"))
    rows = written(rows.withColumn("set", digest("words")), "rows")
    sets = rows.groupBy("set").agg(F.first("words").alias("words"))
    return rows.drop("words"), written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")


def _canonical(some: DataFrame, all_: DataFrame) -> DataFrame:
    """`some` members with `canon`, the identity of their record as in copies: the fields of a list with the same letters, own fields, or letters."""
    lists = all_.where("record is not null").groupBy("sequence").agg(F.min("record").alias("as_record"))
    return some.join(lists, "sequence", "left").withColumn("canon", F.coalesce(F.concat(F.lit(b"#"), F.coalesce("as_record", "record")), "sequence"))


def similar_pairs(df: DataFrame, key: str, text: str, share: float = 0.7) -> DataFrame:
    """`a, b` (a < b): keys of texts that are different records, with word sets whose similarity is `share` or more.

    Equal word sets are joined as one, so a group of copies costs no pairs of its own; the keys of both sides are put in at the end. Texts
    without words, null texts and rows without key have no pairs; a key that is repeated is one row for each repetition and
    pairs with itself never.
    """
    members, sets = _sets(df, key, text)
    names = sets.select("id", "set")
    found = similar_sets(sets, share)
    across = found.join(names.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(names.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("set_a", "set_b")
    # sets of several texts may hold different records
    several = members.groupBy("set").agg(F.min("sequence").alias("least"), F.max("sequence").alias("most")).where("least <> most").select("set")
    linked = written(across.unionByName(several.select(F.col("set").alias("set_a"), F.col("set").alias("set_b"))), "linked")
    some = members.join(linked.select(F.explode(F.array("set_a", "set_b")).alias("set")).distinct(), "set", "left_semi")
    named = written(_canonical(some, members).select("key", "set", "canon"), "named")
    left, right = (named.select(F.col("set").alias(f"set_{x}"), F.col("key").alias(x), F.col("canon").alias(f"canon_{x}")) for x in "ab")
    pairs = linked.join(left, "set_a").join(right, "set_b").where("canon_a <> canon_b and a <> b and (set_a <> set_b or a < b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`key, label`: the least key that each of `nodes` (`key`) is connected with by `pairs` (`a, b`).

    Each round takes the least label among neighbours, then the label's own label; rounds end when nothing changes. Every round is
    written to the shared folder. Of the labels only roots are joined back, spread over salts, as one component may hold many nodes.
    """
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(nodes.select("key", F.col("key").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "key", "left").select("key", F.col("label").alias("before"), F.least("label", "near").alias("label")), "lower")
        roots = lower.join(lower.select(F.col("label").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("label"), F.col("label").alias("root"))
        salted = roots.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
        jumped = lower.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(WAYS)).cast("int")).join(salted, ["label", "_s"], "left")
        before, labels = labels, written(jumped.select("key", F.coalesce("root", "label").alias("label"), "before"), "labels")
        discard(before, lower)
        if labels.where("label <> before").limit(1).count() == 0:
            discard(edges)
            return labels.select("key", "label")


def groups(df: DataFrame, key: str, text: str, share: float = 0.7) -> DataFrame:
    """`key, class_id, links`: the group of near copies of each text with words, and how many other word sets its own is similar to.

    Texts with equal word sets have one class and the same links, and so has one record in several notations (see copies), whose word sets
    are joined through it without counting as links. A text that resembles no other is its own class with 0 links. No pairs of texts are made:
    sets are linked, and each text takes its set's facts. `class_id` is the least key of the class.
    """
    members, sets = _sets(df, key, text)
    pairs = written(similar_sets(sets, share).join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b")), "pairs")
    units = _canonical(members, members).select("canon", "set").distinct()
    least = units.groupBy("canon").agg(F.min("set").alias("first"), F.max("set").alias("most")).where("first <> most")
    same = units.join(least, "canon").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    found = components(sets.select(F.col("set").alias("key")), pairs.unionByName(same)).select(F.col("key").alias("set"), "label")
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    firsts = members.groupBy("set").agg(F.min("key").alias("first"))
    facts = found.join(firsts, "set").join(degrees, "set", "left")
    classes = facts.groupBy("label").agg(F.min("first").alias("class_id"))
    facts = facts.join(classes, "label").select("set", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(facts, "set").select("key", "class_id", "links").distinct().withColumnRenamed("key", key)
