"""Records that differ only in how they are written down: canonical keys, Bloom filters of repeats, exact groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimem.functions.skew import HOT_SHARE
from evimem.session import discard, partitions_for, spread_out, written

#: Slots of the filters for each key, their least number, and those of one round: more keys are filtered in several rounds, each for
#: a range of hashes, so a filter at the driver and the executors never has more than 2 ** 26 slots (8 MB of bits).
SLOTS_PER_KEY, LEAST_SLOTS, ROUND_SLOTS = 8, 1 << 16, 1 << 26
#: Slots that each key marks.
PROBES = 3
#: Slots of a slice, the unit in which partitions' filters are merged.
SLICE = 1 << 16
#: Tasks over which the rows of a hot key are spread.
WAYS = 32

# what a list begins with, if it begins with a named field or a brace; other texts need no closer look
_FIRST = r"^(?:\s*\{|[^\p{L}\p{N}]*[\p{L}\p{N}_]+[^\p{L}\p{N}:=]*[:=])"
_ITEM = r"(?s)^[^\p{L}\p{N}]*([\p{L}\p{N}_]+)[^\p{L}\p{N}:=]*[:=](.*)$"


def letters(text: Column) -> Column:
    """Letters and digits of a text, lower-cased, as one sequence."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def fields(text: Column) -> Column:
    """Names and values of a list of named fields, each as "name=value" in letters and digits and sorted; null for other texts.

    A list is a JSON object, or at least two parts, on lines or between | or ;, that each begin with a one-word name and
    a colon or equals sign.
    """
    plain = F.regexp_replace(text, r"[\p{Zs}\t]", " ")
    json = F.when(plain.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(plain, "map<string,string>"))
    of_json = F.transform(F.map_entries(json), lambda e: F.concat(letters(e["key"]), F.lit("="), letters(F.coalesce(e["value"], F.lit("")))))
    parts = F.filter(F.split(plain, r"\n|\s\|\s|;\s"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    named = F.forall(parts, lambda p: p.rlike(_ITEM)) & (F.size(parts) >= 2)
    of_parts = F.when(named, F.transform(parts, lambda p: F.concat(letters(F.regexp_extract(p, _ITEM, 1)), F.lit("="), letters(F.regexp_extract(p, _ITEM, 2)))))
    return F.when(text.rlike(_FIRST), F.array_sort(F.coalesce(F.when(F.size(of_json) > 0, of_json), of_parts)))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key, sequence, record`: digests (128 bits) of the letters of each text, and of its named fields if it is a list."""
    found = spread_out(df.select(F.col(key), F.col(text))).select(F.col(key).alias("key"), letters(F.col(text)).alias("all"), fields(F.col(text)).alias("fields")).where("key is not null and all <> ''")
    return found.select("key", F.unhex(F.md5("all")).alias("sequence"), F.unhex(F.md5(F.concat(F.lit("#"), F.array_join("fields", "\n")))).alias("record"))


def _probe(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each hash: parts of the hash, by double hashing."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


def _packed(marked: np.ndarray) -> bytes:
    """The marked slots of a slice: as places of two bytes each where they are few, else as bits."""
    at = np.flatnonzero(marked)
    return at.astype(np.uint16).tobytes() if 2 * len(at) < SLICE // 8 else np.packbits(marked).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """The bits of a slice."""
    if len(data) == SLICE // 8:
        return np.frombuffer(data, np.uint8)
    marked = np.zeros(SLICE, bool)
    marked[np.frombuffer(data, np.uint16)] = True
    return np.packbits(marked)


def _filters(slots: int):
    """Per partition: the slots marked once or more and those marked repeatedly, in slices that cost two bytes a slot where few are marked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(slots, np.uint8)
        for b in batches:
            for at in _probe(b["hash"].to_numpy(), slots):
                marked, n = np.unique(at, return_counts=True)
                seen[marked] = np.minimum(seen[marked] + np.minimum(n, 2).astype(np.uint8), 2)
        for k in range(0, slots, SLICE):
            part = seen[k : k + SLICE]
            if part.any():
                yield pd.DataFrame({"slice": [k // SLICE], "once": [_packed(part > 0)], "again": [_packed(part > 1)]})

    return run


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of many partitions as one: what two of them have marked was marked repeatedly."""
    once: dict[int, np.ndarray] = {}
    again: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x, y in zip(b["slice"], b["once"], b["again"], strict=True):
            x, y = _unpacked(x), _unpacked(y)
            if k in once:
                again[k] = again[k] | y | (once[k] & x)
                once[k] = once[k] | x
            else:
                once[k], again[k] = x, y
    for k, y in again.items():
        if y.any():
            yield pd.DataFrame({"slice": [k], "again": [y.tobytes()]})


def repeats_filter(hashes: DataFrame) -> tuple[object, int]:
    """A filter of the hashes that may occur more than once (never missing one that does): its bits, broadcast, and its slots.

    Partitions' filters are merged slice by slice on the executors; only the bits of the result reach the driver. Meant for
    the hashes of one round; with more of them more singletons pass, and the groups stay exact.
    """
    slots = LEAST_SLOTS
    want = min(ROUND_SLOTS, SLOTS_PER_KEY * hashes.count())
    while slots < want:
        slots *= 2
    slices = hashes.mapInPandas(_filters(slots), "slice int, once binary, again binary")
    merged = slices.repartition(partitions_for(hashes), "slice").mapInPandas(_joined, "slice int, again binary")
    bits = bytearray(slots // 8)
    for row in merged.toLocalIterator():
        bits[row["slice"] * (SLICE // 8) : (row["slice"] + 1) * (SLICE // 8)] = row["again"]
    return hashes.sparkSession.sparkContext.broadcast(bytes(bits)), slots


def maybe_repeated(bits: object, slots: int):
    """A predicate on hashes: whether the filter holds them."""

    @F.pandas_udf("boolean")
    def check(hashes: pd.Series) -> pd.Series:
        have = np.frombuffer(bits.value, np.uint8)
        out = np.ones(len(hashes), bool)
        for at in _probe(hashes.to_numpy(dtype=np.int64), slots):
            out &= (have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return check


def spread_join(rows: DataFrame, ones: DataFrame, on: str, size: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `ones`, which has one row a value of `on` and the number of rows of `rows` in `size`; hot values are salted."""
    total = rows.count()
    hot = [r[0] for r in ones.where(F.col(size) >= max(100_000, total * HOT_SHARE)).select(on).limit(int(1 / HOT_SHARE)).collect()]
    if not hot:
        return rows.join(ones, on, how)
    is_hot = F.col(on).isin([bytes(h) if isinstance(h, bytearray) else h for h in hot])
    left = rows.withColumn("_s", F.when(is_hot, F.pmod(F.xxhash64("key"), F.lit(WAYS)).cast("int")).otherwise(F.lit(0)))
    right = ones.withColumn("_s", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [on, "_s"], how).drop("_s")


def _filtered(rows: DataFrame) -> DataFrame:
    """`rows` (`key, row, sequence, record`) once for each digest, with `maybe`: whether the filters of repeats hold the digest.

    The hashes are cut into ranges of as many as a filter serves well; each range has a round of its own, in which its filter is
    built, merged and asked. So with any number of keys the filters let few singletons through, and none grows beyond its bound.
    """
    digests = F.array_compact(F.array(F.xxhash64("sequence"), F.when(F.col("record").isNotNull(), F.xxhash64("record"))))
    entries = rows.withColumn("hash", F.explode(digests))
    rounds = max(1, -(-SLOTS_PER_KEY * entries.count() // ROUND_SLOTS))
    if rounds > 1:
        # other bits than those of the slots
        entries = written(entries.withColumn("round", F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(rounds)).cast("int")), "entries", "round")
    parts = []
    for k in range(rounds):
        mine = entries.where(F.col("round") == k).drop("round") if rounds > 1 else entries
        bits, slots = repeats_filter(mine.select("hash"))
        parts.append(written(mine.withColumn("maybe", maybe_repeated(bits, slots)("hash")).drop("hash"), "marked"))
        bits.destroy()
    discard(entries)
    return reduce(DataFrame.unionByName, parts)


def classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The records that have copies, and all keys: (`key, first, copies` of every member of a set of two or more; `key` of the others).

    Keys are canonical digests. Only rows that the filters of repeats let through are shuffled and grouped exactly; the
    others are singletons for certain. Lists and other texts with the same letters in the same order are one set too.
    Rows without key, and texts without letters or digits (or null), belong to no set and are left out. Rows repeated under one
    key count as copies of each other.
    """
    rows = written(keyed(df, key, text).withColumn("row", F.monotonically_increasing_id()), "keys")
    marked = _filtered(rows)
    discard(rows)
    # a list has two digests: it is a singleton if neither may be repeated
    some = marked.where("maybe").drop("maybe").dropDuplicates(["row"]).drop("row")
    single = marked.where("record is null and not maybe").select("key")
    single_lists = marked.where("record is not null").groupBy("row").agg(F.first("key").alias("key"), F.max("maybe").alias("maybe")).where("not maybe").select("key")
    # texts that are no list take the fields of a list with the same letters
    lists = some.where("record is not null").groupBy("sequence").agg(F.min("record").alias("as_record"))
    sized = some.groupBy("sequence").agg(F.count("*").alias("rows")).join(lists, "sequence")
    named = spread_join(some, sized, "sequence", "rows", "left")
    sets = written(named.select("key", F.coalesce("as_record", "record", "sequence").alias("canon")), "canon")
    firsts = sets.groupBy("canon").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    grouped = spread_join(sets, firsts, "canon", "copies").select("key", "first", "copies")
    return grouped.where("copies > 1"), single.unionByName(single_lists).unionByName(grouped.where("copies = 1").select("key"))


def copy_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """`first_id, copy_id`: for each set of same records one row per record but the one with the smallest key."""
    copies, _ = classes(df, key, text)
    return copies.where("key <> first").select(F.col("first").alias("first_id"), F.col("key").alias("copy_id"))


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """`id, copies`: one row per record, singletons included, with its number of copies."""
    copies, singles = classes(df, key, text)
    return copies.where("key = first").select(F.col("key").alias("id"), "copies").distinct().unionByName(singles.select(F.col("key").alias("id"), F.lit(1).cast("bigint").alias("copies")))
