"""Reading level of documents: a Rasch-style model of document levels and word difficulties, fitted by alternating steps."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimem.session import spread_out, written

#: A corpus word is an item of its own from this share of the documents on (beside the words of the graded passages), so at most
#: (different words of a mean document) / SHARE words are broadcast. The rarer words share items by their hash, a fixed number of them.
SHARE, SHARED_ITEMS = 0.004, 4096
#: Levels that the document step chooses from, and alternations of the two steps.
GRID, ROUNDS = np.arange(0.0, 6.01, 0.1), 4
#: Precision of the prior of word slopes (about 0) and of document levels (about 3).
SLOPE_PRIOR, LEVEL_PRIOR = 2.0, 0.05
#: Fewest known words (items of their own; fewer make a stray snippet), and their least share of all words, for a text to count as prose.
LEAST_WORDS, LEAST_SHARE = 30, 0.45

_WORD = re.compile(r"[^\W\d_]+")
# lines that are no sentences: log lines, JSON, table rows, code, encoded strings
_NO_PROSE = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:|[\[{]\s*[\"\[{]|\||(?:def|class|import|from|return|for|if|while|const|let|var|function|SELECT|INSERT|public|static)\b.*[;:{(]\s*$|[A-Za-z0-9+/=_-]{40,}\s*$|[\w.]+\s*[=:]\s*[\w\"'\[{(.]+[;,]?\s*$|[})\];]+\s*$)")


def _prose_share(text: str) -> float:
    """Share of the characters that stand in lines which may be sentences."""
    good = bad = 0
    for line in text.splitlines():
        n = len(line.strip())
        if _NO_PROSE.match(line):
            bad += n
        else:
            good += n
    return good / max(1, good + bad)


class Items:
    """The words of the model: an index for each (language, word), and words that tell languages apart."""

    def __init__(self, languages: list[str], words: list[str], telling: dict[str, list[int]]):
        self.languages, self.known, self.size = languages, len(words), len(words) + SHARED_ITEMS
        self.index = {w: k for k, w in enumerate(words)}
        # how much each word speaks for each language: its share of that language in the graded passages
        self.votes = np.zeros((len(words), len(languages)))
        for w, seen in telling.items():
            self.votes[self.index[w]] = np.asarray(seen) / sum(seen)

    def counted(self, text: str) -> tuple[int, np.ndarray, np.ndarray, int, int]:
        """Language of a text, its items with their counts, its number of words, and how many of them are items of their own."""
        found = Counter(_WORD.findall(text.lower()))
        n = np.fromiter(found.values(), np.int64, len(found))
        at = np.fromiter((self.index[w] if w in self.index else self.known + crc32(w.encode()) % SHARED_ITEMS for w in found), np.int64, len(found))
        own = at < self.known
        lang = int((n[own] @ self.votes[at[own]]).argmax())
        return lang, at + lang * self.size, n, int(n.sum()), int(n[own].sum())


def _encoded(items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["text"], strict=True):
                lang, at, n, total, known = items.value.counted(text)
                prose = bool(known >= LEAST_WORDS and known >= LEAST_SHARE * total and _prose_share(text) >= 0.5)
                rows.append((key, lang, at, n, prose))
            yield pd.DataFrame(rows, columns=["key", "lang", "at", "n", "prose"])

    return run


class Model:
    """Word parameters: log P(word | language, level) is alpha + gamma * level less a normaliser that only depends on the level."""

    def __init__(self, languages: int, size: int):
        self.languages, self.size = languages, size
        self.alpha, self.gamma = np.full(languages * size, -np.inf), np.zeros(languages * size)

    def normaliser(self) -> np.ndarray:
        """log of the sum over a language's words, for each level of the grid."""
        with np.errstate(divide="ignore"):
            table = np.exp(self.alpha[:, None] + self.gamma[:, None] * GRID[None, :]).reshape(self.languages, self.size, -1).sum(1)
            return np.log(np.maximum(table, 1e-300))

    def levels(self, lang: np.ndarray, at: list[np.ndarray], n: list[np.ndarray], norm: np.ndarray) -> np.ndarray:
        """The document step: the likeliest level of each document, between grid points by a parabola."""
        if not len(at):
            return np.zeros(0)
        rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
        items, counts = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*n, np.zeros(0)]).astype(float)
        counts = np.where(np.isfinite(self.alpha[items]), counts, 0.0)
        slope, total = np.bincount(rows, counts * self.gamma[items], len(at)), np.bincount(rows, counts, len(at))
        fit = slope[:, None] * GRID - total[:, None] * norm[lang] - LEVEL_PRIOR * (GRID - 3) ** 2
        best = np.clip(fit.argmax(1), 1, len(GRID) - 2)
        who = np.arange(len(at))
        a, b, c = fit[who, best - 1], fit[who, best], fit[who, best + 1]
        bend = a - 2 * b + c
        return GRID[best] + np.where(bend < 0, np.clip(0.5 * (a - c) / np.where(bend < 0, bend, 1), -1, 1), 0) * (GRID[1] - GRID[0])

    def learn(self, x: np.ndarray, y: np.ndarray, exposure: np.ndarray, norm: np.ndarray) -> None:
        """The word step: Newton steps for each word on its count x, its sum of levels y, and words by language and level."""
        weight = np.repeat(exposure * np.exp(-np.where(np.isfinite(norm), norm, 0)), self.size, axis=0)
        on = x > 0
        alpha = np.where(np.isfinite(self.alpha), self.alpha, np.log(np.maximum(x, 0.5) / np.maximum(weight.sum(1), 1e-9)))
        gamma = self.gamma.copy()
        for _ in range(12):
            rate = weight * np.exp(np.clip(alpha[:, None] + gamma[:, None] * GRID[None, :], -40, 20))
            m0, m1, m2 = rate.sum(1), (rate * GRID).sum(1), (rate * GRID**2).sum(1)
            # a word's own prior keeps slopes of rare words small; half an occurrence keeps alpha finite
            g0, g1 = x - m0, y - m1 - SLOPE_PRIOR * gamma
            h00, h01, h11 = m0 + 0.5, m1, m2 + SLOPE_PRIOR
            det = np.maximum(h00 * h11 - h01 * h01, 1e-9)
            alpha = alpha + np.clip((h11 * g0 - h01 * g1) / det, -2, 2)
            gamma = np.clip(gamma + np.clip((h00 * g1 - h01 * g0) / det, -1, 1), -3, 3)
        self.alpha, self.gamma = np.where(on, alpha, -np.inf), np.where(on, gamma, 0.0)


def _place(levels: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(levels / (GRID[1] - GRID[0])).astype(int), 0, len(GRID) - 1)


def _statistics(model, norm):
    """Sums for the word step over a task's documents: item, count and sum of levels; words by language and level under negative items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, z = model.value, norm.value
        x, y, exposure = np.zeros(m.languages * m.size), np.zeros(m.languages * m.size), np.zeros((m.languages, len(GRID)))
        for b in batches:
            lang = b["lang"].to_numpy()
            at, n = [np.asarray(a, np.int64) for a in b["at"]], [np.asarray(c, float) for c in b["n"]]
            levels = m.levels(lang, at, n, z)
            if len(at):
                items, counts = np.concatenate(at), np.concatenate(n)
                x += np.bincount(items, counts, len(x))
                y += np.bincount(items, counts * np.repeat(levels, [len(a) for a in at]), len(x))
                np.add.at(exposure, (lang, _place(levels)), [c.sum() for c in n])
        k = np.flatnonzero(x)
        yield pd.DataFrame({"item": k, "x": x[k], "y": y[k]})
        e = exposure.reshape(-1)
        k = np.flatnonzero(e)
        yield pd.DataFrame({"item": -k - 1, "x": e[k], "y": 0.0})

    return run


def _scored(model, norm, scale):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang = b["lang"].to_numpy()
            raw = model.value.levels(lang, [np.asarray(a, np.int64) for a in b["at"]], [np.asarray(c, float) for c in b["n"]], norm.value)
            levels = np.array([np.interp(v, *scale[k]) for v, k in zip(raw, lang, strict=True)])
            yield pd.DataFrame({"key": b["key"], "level": levels, "prose": b["prose"].to_numpy()})

    return run


def _scale(found: np.ndarray, graded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the map from the model's scale to that of the graded passages: their mean levels by grade, made increasing."""
    grades = np.unique(graded)
    means = np.array([found[graded == g].mean() for g in grades])
    return np.maximum.accumulate(means + np.arange(len(means)) * 1e-6), grades.astype(float)


def levels(df: DataFrame, key: str, text: str, graded: DataFrame) -> DataFrame:
    """`key, level, prose`: the reading level of each text on the scale of the graded passages (`lang, text, reading_level`).

    The passages give the words' first parameters; then levels of all documents and parameters of all words
    are estimated in turn. A round is one pass over compact counts in which each task sums what the word step needs, so that only
    sums by word and by level reach the driver. At the end the mean levels of the passages map the model's scale to theirs.
    `prose` is false for logs, code, tables, encoded strings and texts with few known words, whose levels mean little.
    Null, empty and wordless texts have a null level and are no prose; every row gives one row. Languages are told by their words; passages are few
    (a fixed table) and come to the driver.
    """
    spark = df.sparkSession
    passages = graded.select("lang", "text", "reading_level").where("text is not null and lang is not null and reading_level is not null").toPandas()
    kind = dict(df.dtypes)[key]
    rows = spread_out(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    if not len(passages):
        return rows.select(F.col("key").alias(key), F.lit(None).cast("double").alias("level"), F.lit(False).alias("prose"))
    languages = sorted(passages["lang"].unique())
    telling: dict[str, list[int]] = {}
    for lang, passage in zip(passages["lang"], passages["text"], strict=True):
        for w in _WORD.findall(passage.lower()):
            telling.setdefault(w, [0] * len(languages))[languages.index(lang)] += 1
    total = rows.count()
    often = rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") >= max(3, SHARE * total)) & (F.col("w") != ""))
    words = sorted({r[0] for r in often.select("w").toLocalIterator()} | set(telling))
    items = Items(languages, words, telling)
    shared = spark.sparkContext.broadcast(items)
    docs = written(rows.where(F.col("text").rlike(r"\p{L}")).mapInPandas(_encoded(shared), f"key {kind}, lang int, at array<int>, n array<int>, prose boolean"), "counted")

    model = Model(len(languages), items.size)
    lang, at, n = [], [], []
    for name, passage in zip(passages["lang"], passages["text"], strict=True):
        _, found, times, *_ = items.counted(passage)
        lang.append(languages.index(name))
        at.append(found % items.size + lang[-1] * items.size)
        n.append(times.astype(float))
    lang, grade = np.array(lang), passages["reading_level"].to_numpy(float)
    flat, counts = np.concatenate(at), np.concatenate(n)
    known = np.repeat(grade, [len(a) for a in at])
    x0, y0 = np.bincount(flat, counts, len(model.alpha)), np.bincount(flat, counts * known, len(model.alpha))
    e0 = np.zeros((len(languages), len(GRID)))
    np.add.at(e0, (lang, _place(grade)), [c.sum() for c in n])
    model.learn(x0, y0, e0, np.zeros((len(languages), len(GRID))))
    for _ in range(ROUNDS):
        norm = model.normaliser()
        sums = docs.where("prose").mapInPandas(_statistics(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(norm)), "item long, x double, y double").groupBy("item").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas()
        x, y, e = x0.copy(), y0.copy(), e0.copy().reshape(-1)
        own, other = sums[sums["item"] >= 0], sums[sums["item"] < 0]
        np.add.at(x, own["item"].to_numpy(), own["x"].to_numpy())
        np.add.at(y, own["item"].to_numpy(), own["y"].to_numpy())
        np.add.at(e, -other["item"].to_numpy() - 1, other["x"].to_numpy())
        model.learn(x, y, e.reshape(len(languages), -1), norm)
    norm = model.normaliser()
    found = model.levels(lang, at, n, norm)
    scale = [_scale(found[lang == k], grade[lang == k]) for k in range(len(languages))]
    scored = docs.mapInPandas(_scored(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(norm), scale), f"key {kind}, level double, prose boolean")
    bare = rows.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("key", F.lit(None).cast("double").alias("level"), F.lit(False).alias("prose"))
    return scored.unionByName(bare).withColumnRenamed("key", key)
