"""Texts cut off by field limits or in transfer: length hazards per source, and how endings continue elsewhere in the corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimem.session import spread_out, written

#: A word in at least this share of the texts stands for itself, others stand for their shape; so at most
#: (words of a mean text) / SHARE words are broadcast.
SHARE = 0.04
#: Lengths on either side that a length's hazard is tested against, the false-discovery rate, and the fewest texts of a length.
NEIGHBOURS, FDR, LEAST = 12, 0.01, 5
#: Chance that a complete text ends after a given sentence without closing punctuation, and after a given field of a list.
OPEN_END, FIELD_END = 0.03, 0.12
#: Cuts for each character that are assumed before any is counted, and the odds from which a text counts as cut.
FIRST_RATE, ODDS = 1e-4, 1.5
#: Most counters that a task holds before it hands them on, and words whose shapes and the like a worker remembers.
HELD, REMEMBERED = 300_000, 200_000

# Marks that are put where a text was cut.
_MARK = re.compile(r"(?i)(?:[\[(<](?:\.\.\.|…)?\s*(?:truncated|cut|more|cont(?:inued|'d|\.)?|clipped|abridged|read more|see more)\s*(?:\.\.\.|…)?[\])>]|�)[\s.…]*$")
_DOTS = re.compile(r"(?:\.{2,}|…)\s*$")
_CLOSED = re.compile(r"[.!?][\"'”’)\]*_~\s]*(?:[^\w\s.,;:!?\"'()\[\]{}<>/=|@#&+*-][\"'”’)\]*_~\s]*)*$")
_LOOSE = re.compile(r"[^\w]+$")
_FIELD = re.compile(r"(?:^|[\n|;]\s*)(?:[-*•]\s*)?\w+\s*[:=]\s")
_END = "\n"
_TOKEN = re.compile(r"\S+|\n")


@lru_cache(maxsize=REMEMBERED)
def shape(word: str) -> str:
    """Letters as a, digits as 9, runs as one, the rest as it is."""
    return re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", word)))


def stream(text: str) -> tuple[list[str], bool, bool]:
    """Lower-case words with line ends where sentences or fields end; whether the text is a list; whether it ends closed."""
    low = text.lower().strip()
    fields = len(_FIELD.findall(low)) >= 2
    closed = bool(_CLOSED.search(low)) and not _DOTS.search(low)
    if fields:
        low = re.sub(r"\s*\n\s*|\s+\|\s+|;\s+", f" {_END} ", low)
    else:
        low = re.sub(r"[.!?]+[\"'”’)\]*]*(?:\s+|$)", f" {_END} ", low.replace("\n", " "))
    out = []
    for raw in _TOKEN.findall(low):
        if raw == _END:
            if out and out[-1] != _END:
                out.append(_END)
            continue
        word = _bare(raw)
        if word:
            out.append(word)
    return out, fields, closed


@lru_cache(maxsize=REMEMBERED)
def _bare(raw: str) -> str:
    """A word without the signs around it, but with a colon at its end; nothing if no word is left."""
    word = re.sub(r"^[^\w]+|[^\w:]+$", "", raw)
    return word if word.strip(":") else ""


class _Classes(dict):
    """The class of each word: the word if it is known, else its shape."""

    def __init__(self, known: frozenset[str]):
        super().__init__((w, w) for w in known | {_END})
        self.known = len(self)

    def __missing__(self, word: str) -> str:
        if len(self) < self.known + REMEMBERED:
            self[word] = "\t" + shape(word)
            return self[word]
        return "\t" + shape(word)


@lru_cache(maxsize=REMEMBERED)
def tail(word: str) -> str:
    """The part of a word that must be whole at its end: a word of letters, the last part of a path; nothing for numbers."""
    if re.fullmatch(r"[^\d./]+", word):
        return word
    return word[word.rfind(".") :] if re.search(r"/.*\.[^\W\d]*$", word) else ""


#: What one pass over the texts gives: the end of each text (`key` and more), and counts under a null `key`: of (three classes before, class)
#: with how often a sentence or field ended there, and of words (under a null `c1`), but for open last words.
_FOUND = "source string, chars int, bytes int, cut boolean, whole boolean, fields boolean, closed boolean, c3 string, c2 string, c1 string, c string, last string, size int, n bigint, n_end bigint, text boolean"


def _read(known):
    """Each text's end (lengths, marks, the last word with what comes before it), and counts of the words in their places."""

    def handed(counts: Counter, ends: Counter, words: Counter) -> pd.DataFrame:
        keys = [k for k in counts if k[3] != _END]
        grams = {"c3": [k[0] for k in keys], "c2": [k[1] for k in keys], "c1": [k[2] for k in keys], "c": [k[3] for k in keys], "n": [counts[k] for k in keys], "n_end": [ends[k] for k in keys]}
        single = {"c3": None, "c2": None, "c1": None, "c": list(words), "n": list(words.values()), "n_end": 0}
        return pd.concat([pd.DataFrame(grams), pd.DataFrame(single)]).assign(text=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, ends, seen = Counter(), Counter(), Counter()
        class_of = _Classes(known.value).__getitem__
        for b in batches:
            rows = []
            for key, source, text in zip(b["key"], b["source"], b["text"], strict=True):
                plain = text.strip()
                record = re.match(r"\{\s*\"", plain) is not None
                whole = record and re.search(r"[\"\d\]el]\s*\}[\s.…]*$", plain) is not None
                words, fields, closed = stream(plain)
                while words and words[-1] == _END:
                    words.pop()
                cls = list(map(class_of, words))
                padded = [_END, _END, _END, *cls]
                # the last word counts if its sentence or field is closed
                upto = len(cls) - (not closed)
                seen.update(map(tail, words[: max(upto, 0)]))
                places = list(zip(padded, padded[1:], padded[2:], cls[: max(upto, 0)], strict=False))
                counts.update(places)
                ends.update(places[k - 1] for k, c in enumerate(cls) if c == _END and 0 < k <= upto)
                if places and upto == len(cls):
                    ends[places[-1]] += 1
                before = padded[-4:-1] if cls else [_END] * 3
                end = tail(words[-1]) if words else ""
                size = len(text.encode()) - 2 * text.count("�")
                rows.append((key, source, len(text), size, bool(_MARK.search(plain)) or record and not whole, whole, fields, closed, *before, cls[-1] if cls else "", end, len(end)))
            columns = ["key", "source", "chars", "bytes", "cut", "whole", "fields", "closed", "c3", "c2", "c1", "c", "last", "size"]
            yield _shaped(pd.DataFrame(rows, columns=columns).assign(text=True))
            if len(counts) + len(seen) > HELD:
                yield _shaped(handed(counts, ends, seen))
                counts, ends, seen = Counter(), Counter(), Counter()
        yield _shaped(handed(counts, ends, seen))

    return run


def _shaped(b: pd.DataFrame) -> pd.DataFrame:
    """All columns of `_FOUND`; those that `b` lacks are null, 0 or false and have no meaning."""
    empty = {"string": None, "int": 0, "bigint": 0, "boolean": False}
    columns = {name: empty[kind] for name, kind in (c.split() for c in _FOUND.split(", "))}
    return b.assign(**{c: v for c, v in ({"key": None} | columns).items() if c not in b.columns})[["key", *columns]]


def limits(lengths: DataFrame) -> DataFrame:
    """Lengths at which a source's texts end far too often: `source, unit, length, n, hazard, expected`.

    `lengths` has `source, unit, length, n`. The hazard of a length (texts that end there, of those that get there) is tested
    against the hazards of the lengths around it; a bound on the Poisson tail serves as p-value, and per source
    and unit the false-discovery rate is held at `FDR` (Benjamini and Hochberg). The windows run over distinct lengths, not over texts.
    """
    by = Window.partitionBy("source", "unit")
    rows = lengths.withColumn("at_risk", F.sum("n").over(by.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)))
    near = by.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    n_near, risk_near = F.sum("n").over(near) - F.col("n"), F.sum("at_risk").over(near) - F.col("at_risk")
    rows = rows.withColumn("expected", F.col("at_risk") * (n_near + 0.5) / (risk_near + F.col("at_risk") + 1.0))
    rows = rows.withColumn("log_p", F.when(F.col("n") > F.col("expected"), -(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected"))).otherwise(F.lit(0.0)))
    rank = F.row_number().over(by.orderBy("log_p", "length"))
    fits = F.col("log_p") <= F.log(F.lit(FDR) * rank / F.count("*").over(by))
    kept = rows.withColumn("rank", rank).withColumn("fits", fits).withColumn("last", F.max(F.when(F.col("fits"), F.col("rank"))).over(by))
    return kept.where((F.col("rank") <= F.col("last")) & (F.col("n") >= LEAST)).select("source", "unit", "length", "n", (F.col("n") / F.col("at_risk")).alias("hazard"), (F.col("expected") / F.col("at_risk")).alias("expected"))


def _lengths(ends: DataFrame) -> DataFrame:
    return ends.select("source", F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))).groupBy("source", "unit", "length").agg(F.count("*").alias("n"))


def judged(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """`key, source, chars, limit, cut`: for each text whether it was cut off, and whether its length is one at which its source cuts.

    A mark of a cut and an unfinished JSON record decide alone, and a text whose last sentence is closed where the corpus
    closes such sentences is complete. Otherwise the odds of a cut are weighed: the rate of cuts (at a significant length the
    hazard above its neighbours', elsewhere a rate that is estimated for each source from the odds themselves) times how often the words
    before the end go on with a word that begins like the last one, against how often a sentence or field ends there.
    Null, empty and blank texts are not cut; a null source is a source of its own; repeated rows are judged repeatedly.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    rows = spread_out(rows.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("\t"))))
    spark = df.sparkSession
    total = rows.count()
    parts = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}:/.@_+-]+|[.]+(?=\s|$)"))
    often = rows.select(F.explode(parts).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") >= SHARE * total) & F.col("w").rlike(r"\p{L}") & ~F.col("w").rlike(r"[\d/]"))
    known = spark.sparkContext.broadcast(frozenset(r[0] for r in often.select("w").toLocalIterator()))
    # one pass over the texts gives both the counts and the ends
    found = written(rows.mapInPandas(_read(known), f"key {dict(df.dtypes)[key]}, {_FOUND}"), "read")
    counts = written(found.where("not text").groupBy("c3", "c2", "c1", "c").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), "counts")
    ends = found.where("text").drop("n", "n_end", "text")
    seen = ends
    levels = [["c3", "c2", "c1"], ["c2", "c1"], ["c1"]]
    for k, by in zip((3, 2, 1), levels, strict=True):
        grams = counts.where("c1 is not null").groupBy(*by, "c").agg(F.sum("n").alias(f"n{k}"), F.sum("n_end").alias(f"end{k}"))
        seen = seen.join(grams, [*by, "c"], "left").join(grams.groupBy(*by).agg(F.sum(f"n{k}").alias(f"all{k}")), by, "left")
    words = counts.where("c1 is null and c <> ''").select(F.col("c").alias("word"), "n")
    # every beginning of every word that some text ends with
    lasts = ends.where("last <> ''").select("last").distinct()
    heads = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("last"), "n").where(F.col("last") != "").groupBy("last").agg(F.sum("n").alias("longer")).join(lasts, "last", "left_semi")
    full = words.select(F.col("word").alias("last"), F.col("n").alias("full"))
    # how likely a word that occurs nowhere else ends at its length
    by_size = words.where("n <= 3").groupBy(F.length("word").alias("size")).agg(F.count("*").alias("k"))
    stop = by_size.select("size", (F.col("k") / F.sum("k").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))).alias("stop"))
    seen = seen.join(full, "last", "left").join(heads, "last", "left").join(stop, "size", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # chance that the sentence ends after such a word in such a place, the longer context first
    p = F.lit(0.002)
    for k in (1, 2, 3):
        p = F.when(zero(f"n{k}") > 0, (zero(f"end{k}") + 2 * p) / (zero(f"n{k}") + 2)).when(zero(f"all{k}") > 20, F.least(p, F.lit(0.002))).otherwise(p)
    p = F.greatest(p, F.lit(1e-4))
    whole_word = F.when(F.col("last") == "", F.lit(0.7)).otherwise((zero("full") + F.coalesce("stop", F.lit(0.05))) / (zero("full") + zero("longer") + 1.0))
    whole_word = F.least(F.greatest(whole_word, F.lit(1e-3)), F.lit(0.999))
    ratio = ((1 - p) * whole_word + (1 - whole_word)) / (p * whole_word * F.when(F.col("fields"), F.lit(FIELD_END)).otherwise(F.lit(OPEN_END)))
    ended = F.col("closed") & ((zero("end1") > 0) | (zero("all1") < 20))
    kind = F.when(F.col("cut"), F.lit("cut")).when(F.col("whole") | ended, F.lit("whole")).otherwise(F.lit("open"))
    found = limits(written(_lengths(ends), "lengths")).withColumn("excess", F.col("hazard") - F.col("expected"))
    of = lambda unit: found.where(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.col("excess").alias(f"excess_{unit}"))
    weighed = seen.select("key", "source", "chars", "bytes", kind.alias("kind"), ratio.alias("ratio")).join(of("chars"), ["source", "chars"], "left").join(of("bytes"), ["source", "bytes"], "left")
    weighed = written(weighed.withColumn("excess", F.greatest(zero("excess_chars"), zero("excess_bytes"))).drop("excess_chars", "excess_bytes"), "weighed")
    rates = weighed.select("source").distinct().withColumn("rate", F.lit(FIRST_RATE))
    for _ in range(2):
        odds = F.col("ratio") * F.col("rate")
        share = F.when(F.col("excess") > 0, 0.0).when(F.col("kind") == "cut", 1.0).when(F.col("kind") == "whole", 0.0).otherwise(odds / (1 + odds))
        # a prior of ten texts' lengths keeps small sources near the first rate
        rates = written(weighed.join(rates, "source").groupBy("source").agg(((F.sum(share) + FIRST_RATE * 3000) / (F.sum("chars") + 3000)).alias("rate")), "rates")
    odds = F.col("ratio") * F.greatest("excess", "rate")
    cut = (F.col("kind") == "cut") | ((F.col("kind") == "open") & (odds > ODDS))
    return weighed.join(rates, "source").select("key", F.when(F.col("source") != "\t", F.col("source")).alias("source"), "chars", (F.col("excess") > 0).alias("limit"), cut.alias("cut"), "kind", odds.alias("odds"))


def report(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """`source, texts, cut_texts, at_limit, cut_share`: how often each source's texts with words are cut."""
    return judged(df, key, text, source).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if(F.col("cut") & F.col("limit")).alias("at_limit"), (F.count_if("cut") / F.count("*")).alias("cut_share"))
