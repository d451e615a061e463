"""Personal information in free text: labelers vote on spans, EM weighs the labelers, a span classifier decides."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from copy import copy
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimem.llm.cues import AFTER, BEFORE, GIVEN, NO_PERSON, SURNAMES
from evimem.llm.tokens import vocabulary_file
from evimem.session import discard, spread_out, written

TYPES = ("email", "id_number", "address", "phone", "name")
#: Labelers of each span: form, gazetteer or lexicon, words before, words after, inner consistency.
LABELERS = 5
#: Buckets of the classifier's features, and the different examples up to which it is fitted in the driver; more are fitted by the tasks, with the same result.
FEATURES, LOCAL = 1 << 14, 200_000
#: Different candidates that a task counts before it hands them on.
COUNTED = 100_000
#: Buckets of the sketch of how words are written in the whole corpus; its size does not depend on the data.
CASES = 1 << 20
#: Different surnames from which, and mean probability with which, a word before them is learned as a given name.
LEARNED_TIMES, LEARNED_SHARE = 2, 0.7

_SPACES = {ord(c): " " for c in "\r              　\t"} | {ord(c): "-" for c in "‐‑‒–—−"}
_W = r"[^\W\d_]"
# capital and small letters of the Latin, Greek and Cyrillic scripts
_LETTERS = [chr(c) for c in range(0x41, 0x530)]
_UP, _LOW = ("[" + "".join(c for c in _LETTERS if test(c)) + "]" for test in (str.isupper, str.islower))
_CAP = f"{_UP}{_LOW}+"


def _pattern(text: str, flags: int = re.I) -> re.Pattern:
    """A pattern in which ~ stands for up to three blanks or line ends."""
    return re.compile(text.replace("~", r"[ \n]{1,3}"), flags)


_STREETS = "road rd lane ln street st avenue ave court ct way drive dr close crescent terrace square sq hill row place pl boulevard blvd parkway pkwy mews gardens grove highway hwy trail circle alley quay wharf".split()
_GERMAN = ("gasse", "straße", "strasse", "str", "ufer", "ring", "weg", "platz", "allee", "damm", "straat", "laan", "gracht", "plein")
_STREET = rf"(?:{'|'.join(_STREETS)})"
_NO_TOWN = r"(?!(?:phone|callback|tel|call|mail|e-?mail|fax|and|or|but|who|which|the|then|please|before|after|with|und|et|y)\b)"
_PROPER = rf"(?-i:{_UP}{_W}*(?:[ \n'’-]{_UP}{_W}+){{0,2}})"
_TOWN = rf"(?:,~\d{{4,5}}~(?:{_PROPER}|{_W}+)|(?:~(?:NW|NE|SW|SE|N|S|E|W)(?![^\W_]))?,~{_NO_TOWN}(?:{_PROPER}|{_W}+)(?:,~(?-i:[A-Z]{{2}})(?![^\W_]))?(?:~\d{{4,5}}(?!\d))?(?![^\W_]))"
_WORDS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_ODD = re.compile("[" + re.escape("".join(map(chr, _SPACES))) + "]")
_PARTICLES = frozenset("van von der den del della dos bin ben ter las los".split())
_TITLES, _INITIAL = frozenset("mr ms mrs miss dr prof herr frau mme sr sra don doña".split()), re.compile(r"(?<![\w@.+-])[^\W\d_]\.")
_AT = r"(?:@|[ \n]?[\[({<][ \n]?at[ \n]?[\])}>][ \n]?)"
# what texts without "@" must have for the first form of an email, and what all texts must for the forms of identity numbers that begin without a word
_AT_APART = re.compile(r"(?i)[\[({<][ \n]?at[ \n]?[\])}>]")
_NUMBERS = re.compile(r"\d\d(?:\d(?:\d{4}|-\d\d-\d{4}|\d{3}-\d{3})|[ \n]{1,3}\d\d)")
# patterns; words of which a text must have one for a pattern to match; endings of words that do as well
_FORMS = {
    "email": [
        (_pattern(rf"(?:mailto:)?[\w.+-]+{_AT}[\w-]+(?:\.[\w-]+)+"), frozenset({"@"}), None),
        (_pattern(rf"[\w+-]+(?:~dot~[\w+-]+)*~at~[\w-]+(?:~dot~{_W}{{2,}})+\b(?!~at~)"), frozenset({"dot"}), None),
    ],
    "id_number": [
        (_pattern(r"(?:passport(?:~no\.?|~number)?|dni|nie|nif|ssn|social~security~(?:number|no\.?)|national~insurance~(?:number|no\.?)|nino|steuer-?id(?:nr)?\.?|tax~id|id~card(?:~no\.?|~number)?|personalausweis(?:nr)?\.?|driver'?s~licen[cs]e(?:~no\.?|~number)?|nir|iban)[ :#]{1,3}(?=[\w -]*\d)[a-z0-9](?:[a-z0-9]*[ -]?(?=[a-z]?\d|[a-z]\b))*[a-z0-9]"), frozenset("passport dni nie nif ssn social national nino steuer steuerid steueridnr tax id personalausweis personalausweisnr driver drivers nir iban".split()), None),
        (_pattern(r"\b\d{3}-\d{2}-\d{4}\b"), None, None),
        (_pattern(r"\b[a-z]{2}\d{7,8}\b"), None, None),
        (_pattern(r"\b\d{8}-[a-z]\b"), None, None),
        (_pattern(r"\b[a-z]{2}~\d\d~\d\d~\d\d~[a-d]\b"), None, None),
        (_pattern(r"\b\d{2}~\d{3}~\d{3}~\d{3}\b"), None, None),
        (_pattern(r"\b[a-z]{4}-\d{6}-\d{3}\b"), None, None),
    ],
    "address": [
        (_pattern(rf"\b(?:(?:flat|apt\.?|unit|suite)~\d+,~)?(?:no\.~)?\d{{1,5}}[a-z]?~(?:st\.|{_W}[\w'’-]*)~(?:{_W}+~){{0,2}}{_STREET}(?![^\W_])(?!(?<=dr)\.?~(?-i:{_UP}))(?!(?<=dr)\.?\))(?:(?:(?<=st)|(?<=rd)|(?<=ave)|(?<=blvd)|(?<=dr)|(?<=ln))\.)?(?:,~(?:apt|unit|flat|suite|floor)\.?~#?\d+)?(?:{_TOWN})?"), frozenset(_STREETS), None),
        (_pattern(rf"\b{_W}+(?:{'|'.join(_GERMAN)})\.?~\d{{1,4}}[a-z]?(?:{_TOWN})?"), frozenset(), _GERMAN),
        (_pattern(rf"\b(?:am|an~der|im|auf~dem|zum)~(?-i:{_UP}){_W}+~\d{{1,4}}[a-z]?(?:,~\d{{4,5}}~{_W}+)"), frozenset("am an im auf zum".split()), None),
        (_pattern(rf"\b\d{{1,4}}(?:~bis|~ter)?,?~(?:rue|avenue|impasse|chemin|boulevard|place|quai|allée|cours)~(?:(?:des|du|de~la|de~l'|de|d')~?)?(?:{_W}+[ \n-]){{0,2}}?{_W}+(?:{_TOWN})"), frozenset("rue avenue impasse chemin boulevard place quai allée cours".split()), None),
        (_pattern(rf"\b(?:calle|avenida|plaza|paseo|camino|ronda|travesía|via|viale|piazza|rua)~(?:(?:del|de~la|de~los|de~las|de|da|do)~)?{_W}+(?:~{_W}+)?,?~\d{{1,4}}(?:,~\d+º~(?:izq\.|dcha\.|{_W}\b))?(?:{_TOWN})?"), frozenset("calle avenida plaza paseo camino ronda travesía via viale piazza rua".split()), None),
    ],
    "phone": [(_pattern(r"(?<![\w.@/+-])(?:tel:)?(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,14}(?:[ .-]\d{2,8})*(?:~(?:ext\.?|x)~?\d+)?(?![\w@/]|[.-]\d|:\d)"), None, None)],
}
_PHONE_FORMS = re.compile(r"(?i)(?:tel:)?(?:\+1[ .-]?\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]?\d{4}|1?\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}|1[2-9]\d{9}|\+[2-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,8}){1,4}|(?!\d{4} \d{4} \d{4})\(?0\d{1,5}\)?[ /-]\d{3,8}(?: \d{2,5})*|0\d(?: \d\d){4})(?:[ \n]{1,3}(?:ext\.?|x)[ \n]{0,3}\d+)?$")
_ID_FORMS = re.compile(r"(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Za-z]{1,2}\d{6,8}|\d{8}-?[A-Za-z]|[A-Za-z]{2} ?\d\d ?\d\d ?\d\d ?[A-Da-d]|\d{2} ?\d{3} ?\d{3} ?\d{3}|[A-Za-z]{4}-\d{6}-\d{3}|[A-Za-z]{2}\d\d(?: ?[A-Za-z0-9]{4}){3,7}(?: ?[A-Za-z0-9]{1,3})?)$")
_ID_KEY = re.compile(r"(?i)[a-z' .-]*(?:passport|dni|nie|nif|ssn|security|insurance|nino|steuer|tax id|id card|ausweis|licen[cs]e|nir|iban)(?:-?id|nr\.?)*(?: (?:number|no\.?))?[ :#]+")
_PART = r"(?:(?:van~der|van~den|van|von~der|von|de~la|de|del|della|da|dos|di|du|le|bin|ben|ter)~|al-|el-)"
_TITLE = r"(?:mr|ms|mrs|miss|dr|prof|herr|frau|mme)\.?~"
_SUR = rf"(?:[OD]['’]|Mc|Mac)?{_CAP}(?:-{_CAP})?"
_PAIR = _pattern(rf"(?<![\w@.+'’-])(?:(?i:{_TITLE}))?({_CAP}(?:-{_CAP})?)(?:~{_UP}\.)?~(?:(?i:{_PART}))?({_SUR})(?![\w@+])", 0)
_TITLED = _pattern(rf"(?<![\w@.+-])(?:mr|ms|mrs|dr|prof)\.~(?:{_W}\.~)?{_PART}?{_W}[^\W\d_'’]+(?:['’]{_W}{{3,}})?(?:-{_W}+)?(?![\w@+])|(?<![\w@.+-])(?:mr|ms|mrs|miss|herr|frau|mme)~(?-i:{_UP}\.~)?{_PART}?(?-i:{_SUR})(?![\w@+])")
_INITIALED = _pattern(rf"(?<![\w@.+-]){_W}\.~(?:{_W}\.~)?{_PART}?{_W}['’]?[^\W\d_'’]+(?:-{_W}+)?(?![\w@+])")
_REST = _pattern(rf"(?:~{_W}\.)?~{_PART}?{_W}['’]?[^\W\d_'’]+(?:-{_W}+)?(?![\w@+])")
_MIDDLE = _pattern(rf"~({_W}+)(?=~)")
_TURNED = _pattern(rf"(?<![\w@.+-]){_PART}?{_W}['’]?[^\W\d_'’]+(?:-{_W}+)?,~$")
_TITLE_BEFORE = _pattern(rf"(?<![\w@.+-]){_TITLE}$")
_SHAPES = [(re.compile(a), b) for a, b in ((f"{_LOW}+", "a"), (f"{_UP}+", "A"), (r"\d+", "9"))]


def _hash(text: str) -> int:
    """A hash that is the same in every process."""
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def _bucket(word: str) -> int:
    """Bucket of a word in small letters in the sketch of cases."""
    return crc32(word.encode()) % CASES


def ordinary_words(file: str) -> frozenset[str]:
    """Words that a public vocabulary of ranks knows with a small first letter, and with a capital one later or not at all."""
    ranks = {}
    for line in Path(file).read_bytes().splitlines():
        token, rank = line.split()
        word = base64.b64decode(token)
        if word[:1] == b" " and len(word) > 4 and word[1:].isalpha():
            ranks[word[1:].decode()] = int(rank)
    return frozenset(w for w, rank in ranks.items() if w.islower() and rank < ranks.get(w.title(), 1 << 30))


class Finder:
    """Finds candidate spans of a text with the labelers' votes and features.

    given, surnames: gazetteers; vocabulary: a file of a public tokenizer, whose words tell ordinary words from names; learned: given names learned from the corpus; cases: how words are written in the corpus (one byte a bucket:
    0 never seen, 1 mostly with a small letter, 2 mixed or seldom, 3 as good as always with a capital).
    """

    def __init__(self, given: list[str] | None = None, surnames: list[str] | None = None, vocabulary: str | None = None, learned: frozenset[str] = frozenset(), cases: bytes = b""):
        self.given = frozenset(g.lower() for g in (GIVEN if given is None else given))
        self.surnames = frozenset(s.lower() for s in (SURNAMES if surnames is None else surnames))
        self.ordinary = ordinary_words(vocabulary or vocabulary_file("byte_bpe_50k.tiktoken")) - self.given - self.surnames
        self.learn(learned, cases)

    def learn(self, learned: frozenset[str], cases: bytes) -> Finder:
        self.learned, self.cases = learned, cases
        self.lexicon = self.given | learned
        return self

    def case(self, word: str) -> int:
        """How the corpus, or else the public vocabulary, writes a word."""
        code = self.cases[_bucket(word)] if self.cases else 0
        return 1 if code in (0, 2) and word in self.ordinary else code

    def candidates(self, text: str, only_names: bool = False) -> list[tuple[int, int, int, tuple[int, ...], list[int], str, str]]:
        """(type, start, end, votes, features, given name, surname) of every candidate, by type."""
        plain = text.translate(_SPACES) if _ODD.search(text) else text
        out, taken = [], []
        # what every form of a type has spares most texts the costlier patterns
        words = set(_WORDS.findall(plain.lower()))
        digits = _DIGIT.search(plain) is not None
        numbers = digits and not only_names and _NUMBERS.search(plain) is not None
        if "@" in plain or "at" in words and _AT_APART.search(plain):
            words.add("@")
        for kind, name in enumerate(TYPES[:4]):
            if name != "email" and (only_names or not digits):
                continue
            for form, needed, endings in _FORMS[name]:
                if needed is None and name == "id_number" and not numbers:
                    continue
                if needed is not None and needed.isdisjoint(words) and not (endings and any(w.endswith(endings) for w in words)):
                    continue
                for m in form.finditer(plain):
                    if name == "phone" and not 7 <= sum(map(str.isdigit, m[0])) <= 16:
                        continue
                    if name == "email":
                        taken.append((m.start(), m.end()))
                    if not only_names:
                        out.append((kind, m.start(), m.end(), *self._votes(kind, plain, m.start(), m.end()), "", ""))
        for start, end, how, first, last in self._names(plain, words):
            if not any(a < end and start < b for a, b in taken):
                out.append((4, start, end, *self._votes(4, plain, start, end, how, first, last), first, last))
        return out

    def _names(self, plain: str, words: set[str]) -> Iterator[tuple[int, int, str, str, str]]:
        """Spans that may be names: start, end, how they were found, given name and surname in small letters."""
        if not _TITLES.isdisjoint(words):
            for m in _TITLED.finditer(plain):
                yield m.start(), m.end(), "title", "", _WORDS.findall(m[0])[-1].lower()
        if _INITIAL.search(plain):
            for m in _INITIALED.finditer(plain):
                yield m.start(), m.end(), "initial", "", _WORDS.findall(m[0])[-1].lower()
        at = 0
        while m := _PAIR.search(plain, at):
            at = m.end(1)
            first = m[1].lower()
            last = _WORDS.findall(m[2])[-1].lower()
            if first not in self.lexicon and self.case(first) != 1 and self.case(last) != 1 and NO_PERSON.isdisjoint((first, last)):
                yield m.start(), m.end(), "pair", first, last
        if self.lexicon.isdisjoint(words):
            return
        for w in _WORDS.finditer(plain):
            first = w[0].lower()
            if first not in self.lexicon or w.start() and plain[w.start() - 1] in "@.+-_'’":
                continue
            end = w.end()
            middle = _MIDDLE.match(plain, end)
            if middle and middle[1].lower() in self.lexicon:
                end = middle.end()
            if m := _REST.match(plain, end):
                title = _TITLE_BEFORE.search(plain, max(0, w.start() - 8), w.start())
                yield title.start() if title else w.start(), m.end(), "given", first, _WORDS.findall(m[0])[-1].lower()
            if plain[end : end + 1] not in ("@", "+", "_") and (m := _TURNED.search(plain, max(0, w.start() - 48), w.start())):
                yield m.start(), w.end(), "turned", first, _WORDS.findall(m[0])[-1].lower()

    def _votes(self, kind: int, text: str, start: int, end: int, how: str = "", given: str = "", last: str = "") -> tuple[tuple[int, ...], list[int]]:
        name, span = TYPES[kind], text[start:end]
        before, after = text[max(0, start - 40) : start], text[end : end + 24]
        good, bad = BEFORE[name]
        third = -1 if bad.search(before) else 1 if good.search(before) or not before.strip() else 0
        good, bad = AFTER[name]
        fourth = -1 if bad.search(after) else 1 if good.search(after) else 0
        near = [f"{name} how {how}", f"{name} before {(before.split() or ['^'])[-1].lower()}", f"{name} after {(after.split() or ['$'])[0].lower()}"]
        if name == "email":
            host = re.split(r"(?i)@|[ \n]?[\[({<][ \n]?at[ \n]?[\])}>][ \n]?|[ \n]at[ \n]", span)[-1]
            last = re.split(r"\.|\sdot\s", host)[-1]
            first, second, fifth = (1 if last.isalpha() and len(last) > 1 else -1), (1 if re.search(r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|test|example|invalid)$|mail|dot", host) else 0), (-1 if re.fullmatch(r"[\d.]+", host) else 1)
        elif name == "phone":
            first = 1 if _PHONE_FORMS.match(span) else -1
            second = 1 if span[0] in "+(t0" or span[:4].lower() == "tel:" else 0
            fifth = 1 if 9 <= sum(map(str.isdigit, re.sub(r"(?i)\s(?:ext|x).*", "", span))) <= 15 else -1
        elif name == "id_number":
            flat = re.sub(r"\s+", " ", span)
            key = _ID_KEY.match(flat)
            value = flat[key.end() :] if key else flat
            first, second, fifth = (1 if _ID_FORMS.match(value) else -1), (1 if key else -1), (1 if sum(map(str.isdigit, value)) >= 6 else -1)
        elif name == "address":
            first, second = 1, (1 if "," in span else 0)
            fifth = 1 if _DIGIT.search(span) else -1
        else:
            found = [w.lower() for w in _WORDS.findall(span)]
            inner = [w for w in found if len(w) > 2 and w not in _TITLES and w not in _PARTICLES]
            small = span.islower()
            first = 1 if how in ("title", "initial") or how == "turned" and not small or re.search(r"[ \n][^\W\d_]\.", span) else -1 if small else 0
            second = -1 if last in self.ordinary or not NO_PERSON.isdisjoint(inner) else 1 if given in self.lexicon or last in self.surnames else 0
            seen = [self.case(w) for w in inner]
            fifth = -1 if 1 in seen else 1 if seen and min(seen) >= 3 else 0
            near += [f"last3 {last[-3:]}", f"last4 {last[-4:]}", f"first {given}", f"case {'' if small else 'A' if span.isupper() else 'Aa'}", f"surname {last in self.surnames}"]
        shape = span
        for a, b in _SHAPES:
            shape = a.sub(b, shape)
        near.append(f"{name} shape {shape[:24]}")
        feats = [kind * 3 * LABELERS + v * LABELERS + k for k, v in enumerate((first + 1, second + 1, third + 1, fourth + 1, fifth + 1))]
        return (first, second, third, fourth, fifth), [200 + _hash(x) % (FEATURES - 200) for x in near] + feats


#: Weak prior of the labelers: how often they vote -1, 0, 1 on what is no mention, and on a mention.
_PRIOR = np.array([[2.0, 1.0, 0.3], [0.3, 1.0, 2.0]])


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability that a span with each pattern of votes is a mention, by EM over two classes and independent labelers.

    Starts from the sum of votes; a weak prior keeps each labeler better than chance.
    """
    votes = np.array(list(patterns), np.int64).reshape(-1, LABELERS)
    n = np.array(list(patterns.values()), np.float64)
    p = 1 / (1 + np.exp(0.7 - votes.sum(1)))
    prior = np.stack([_PRIOR[0], _PRIOR[1]]) * max(1.0, n.sum() * 0.01)
    for _ in range(rounds):
        classes = [(n * (1 - p)).sum() + 1, (n * p).sum() + 1]
        like = np.log(np.array(classes) / sum(classes))[None, :].repeat(len(n), 0)
        for k in range(LABELERS):
            for c, weight in ((0, n * (1 - p)), (1, n * p)):
                share = prior[c] + np.array([weight[votes[:, k] == v].sum() for v in (-1, 0, 1)])
                like[:, c] += np.log(share / share.sum())[votes[:, k] + 1]
        p = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return {k: float(x) for k, x in zip(patterns, p, strict=True)}


def prior_weights() -> np.ndarray:
    """The classifier before it has seen a span: each vote speaks as the labelers' prior says; the last weight is the bias."""
    w = np.zeros(FEATURES + 1)
    for kind in range(len(TYPES)):
        for v in range(3):
            w[kind * 3 * LABELERS + v * LABELERS : kind * 3 * LABELERS + v * LABELERS + LABELERS] = np.log(_PRIOR[1][v] / _PRIOR[0][v]) / 2
    w[-1] = -0.7
    return w


def _gradient(lengths: np.ndarray, at: np.ndarray, labels: np.ndarray, share: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the soft labels' likelihood at the weights `w`: `at` holds the examples' features one after another, `lengths` how many each has."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    z = np.bincount(rows, w[at], minlength=len(lengths)) + w[-1]
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share
    return np.r_[np.bincount(at, error[rows], minlength=FEATURES), error.sum()]


def _descent(gradient: Callable[[np.ndarray], np.ndarray], rounds: int = 200, rate: float = 0.2) -> np.ndarray:
    start = prior_weights()
    w, grad2 = start.copy(), np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        g = gradient(w) + 1e-4 * (w - start)
        grad2 += g * g
        w -= rate * g / np.sqrt(grad2)
    return w


def fit(features: list[list[int]], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier on binary features with soft labels, drawn to the prior weights; the last weight is the bias."""
    lengths, at, share = np.array([len(f) for f in features]), np.concatenate([np.asarray(f, np.int64) for f in features]), weights / weights.sum()
    return _descent(lambda w: _gradient(lengths, at, labels, share, w))


def fit_by_tasks(examples: DataFrame) -> np.ndarray:
    """As `fit`, from a table `feats, label, weight` of any size: each task sums its part of the gradient, so the driver holds one row a task."""
    total = examples.agg(F.sum("weight")).first()[0]
    sc = examples.sparkSession.sparkContext

    def gradient(w: np.ndarray) -> np.ndarray:
        held = sc.broadcast(w)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(FEATURES + 1)
            for b in batches:
                feats = b.column("feats")
                g += _gradient(np.diff(feats.offsets.to_numpy()), feats.flatten().to_numpy(), b.column("label").to_numpy(), b.column("weight").to_numpy() / total, held.value)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

        g = sum(np.frombuffer(r["g"]) for r in examples.mapInArrow(part, "g binary").collect())
        held.destroy()
        return g

    return _descent(gradient)


def spans(text: str, finder: Finder, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(type, start, end) of the mentions in `text`: candidates above one half, the likelier and then the longer first, without overlap.

    A number that an identity number's or address's pattern explains is no phone number, and no name lies inside another mention.
    """
    return _chosen(finder.candidates(text), weights)


def _chosen(candidates: list, weights: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for kind, start, end, _, feat, *_ in candidates:
        z = weights[feat].sum() + weights[-1]
        if z > 0:
            found.append((kind == 4, kind == 3, start - end, -z, kind, start, end))
    taken: list[tuple[int, int, int]] = []
    for _, _, _, _, kind, start, end in sorted(found):
        if all(end <= a or b <= start for _, a, b in taken):
            taken.append((kind, start, end))
    return sorted(taken, key=lambda x: x[1])


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often the words of each bucket begin with a small and with a capital letter, single letters and words wholly in capitals left out."""
    small, capital = np.zeros(CASES, np.int32), np.zeros(CASES, np.int32)
    known: dict[str, int] = {}
    for b in batches:
        for text in b["text"]:
            if text.isupper():
                continue
            for w in set(_WORDS.findall(text)):
                at = known.get(w)
                if at is None:
                    if len(known) > 200_000:
                        known.clear()
                    at = -1 if len(w) < 2 or w.isupper() else _bucket(w.lower()) * 2 + w[0].isupper()
                    known[w] = at
                if at >= 0:
                    (capital if at & 1 else small)[at >> 1] += 1
    at = np.flatnonzero(small | capital)
    yield pd.DataFrame({"bucket": at, "small": small[at], "capital": capital[at]})


def case_sketch(texts: DataFrame) -> bytes:
    """How words are written in all of `texts` (`text`): one byte for each of `CASES` buckets, as `Finder` takes it.

    Counted by task and summed by bucket: at most `CASES` rows reach the driver, as one byte each.
    """
    found = texts.select("text").mapInPandas(_written, "bucket int, small int, capital int").groupBy("bucket").agg(F.sum("small").alias("small"), F.sum("capital").alias("capital"))
    share = F.col("small") / (F.col("small") + F.col("capital"))
    code = F.when(share >= 0.5, 1).when((share <= 0.3) & (F.col("capital") >= 2), 3).otherwise(2).cast("byte")
    rows = found.select("bucket", code.alias("code")).toPandas()
    sketch = np.zeros(CASES, np.uint8)
    sketch[rows["bucket"].to_numpy()] = rows["code"].to_numpy()
    return sketch.tobytes()


def _found(finder):
    """Each row with the candidates of its `text` as JSON, null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json.dumps(c) if (c := finder.value.candidates(text)) else None for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "found"])

    return run


def _renamed(finder, new: frozenset[str]):
    """As `_found`, from the candidates before the words `new` were learned: only names can differ, and only in texts that have such a word."""
    parts = frozenset(w for g in new for w in _WORDS.findall(g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("found").to_pylist()
            for k, text in enumerate(b.column("text").to_pylist()):
                if not parts.isdisjoint(_WORDS.findall(text.lower())):
                    c = [x for x in json.loads(found[k] or "[]") if x[0] != 4] + finder.value.candidates(text, only_names=True)
                    found[k] = json.dumps(c) if c else None
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], b.schema.names)

    return run


def _counted(found: DataFrame, names: bool) -> DataFrame:
    """How often each candidate occurs: of names `votes, given, last, n`, of all `kind, votes, feats, n`; the tasks count first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}
        out = lambda: pd.DataFrame([(*x, n) for x, n in seen.items()], columns=columns)
        for b in batches:
            for c in b["found"]:
                for kind, _, _, votes, feats, given, last in json.loads(c):
                    vote = ",".join(map(str, votes))
                    if not names:
                        x = (kind, vote, ",".join(map(str, feats)))
                    elif kind == 4:
                        x = (vote, given, last)
                    else:
                        continue
                    seen[x] = seen.get(x, 0) + 1
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    columns = ["votes", "given", "last", "n"] if names else ["kind", "votes", "feats", "n"]
    schema = ", ".join(f"{c} {'int' if c == 'kind' else 'bigint' if c == 'n' else 'string'}" for c in columns)
    return found.where("found is not null").select("found").mapInPandas(run, schema).groupBy(*columns[:-1]).agg(F.sum("n").alias("n"))


def _posteriors(rows: list) -> dict[tuple[int, str], float]:
    """Probability of a mention by type and votes, from rows with `kind, votes, n`."""
    patterns: dict[int, dict] = {}
    for kind, votes, n in sorted((r["kind"], r["votes"], r["n"]) for r in rows):
        patterns.setdefault(kind, {})[tuple(map(int, votes.split(",")))] = n
    return {(kind, ",".join(map(str, votes))): p for kind, seen in patterns.items() for votes, p in reliabilities(seen).items()}


def _with_posterior(rows: DataFrame, kind: str) -> tuple[DataFrame, bool]:
    """`rows` (`votes, n`) with the probability `p` that EM gives them, and whether there are any. Types and votes have a few hundred patterns at most."""
    posterior = _posteriors(rows.groupBy(F.expr(kind).alias("kind"), "votes").agg(F.sum("n").alias("n")).collect())
    few = rows.sparkSession.createDataFrame([(k, v, p) for (k, v), p in posterior.items()], "_kind int, votes string, p double")
    return rows.withColumn("_kind", F.expr(kind)).join(F.broadcast(few), ["_kind", "votes"]).drop("_kind"), bool(posterior)


def _learned(names: DataFrame) -> frozenset[str]:
    """Words that go as given names with several surnames, most of them likely; each surname counts once however often it recurs.

    A word with a hyphen is left as it is: it is found as a pair, and no word of a text would be looked up by it.
    """
    rows, _ = _with_posterior(names, "4")
    pairs = rows.where("given <> '' and not contains(given, '-')").groupBy("given", "last").agg(F.max("p").alias("p"))
    found = pairs.groupBy("given").agg(F.count("*").alias("n"), F.sum("p").alias("p")).where((F.col("n") >= LEARNED_TIMES) & (F.col("p") >= LEARNED_SHARE * F.col("n")))
    return frozenset(r["given"] for r in found.select("given").collect()) - NO_PERSON


def _fitted(candidates: DataFrame) -> np.ndarray:
    """The span classifier, fitted to what EM says of one example of each set of features."""
    counts = written(_counted(candidates, names=False), "examples")
    rows, some = _with_posterior(counts, "kind")
    if not some:
        return prior_weights()
    examples = rows.select(F.split("feats", ",").cast("array<int>").alias("feats"), F.col("p").alias("label"), F.sqrt("n").alias("weight"))
    if counts.count() <= LOCAL:
        local = examples.collect()
        weights = fit([r["feats"] for r in local], np.array([r["label"] for r in local]), np.array([r["weight"] for r in local]))
    else:
        weights = fit_by_tasks(kept := written(examples, "labelled"))
        discard(kept)
    discard(counts)
    return weights


def _modelled(texts: DataFrame, finder: Finder, bare: bool) -> tuple[Finder, np.ndarray, DataFrame]:
    """The finder with what it learned from the corpus, the span classifier's weights, and the rows of `texts` with their candidates (`found`; without `bare` only rows that have any).

    All of it comes from all texts: names of plain form are weighed by EM first, and given names that recur in them are learned; then all
    candidates, those of learned names in any notation among them, are weighed, and the classifier is fitted. Texts are searched once, those
    that have a learned word once more for names. The driver holds the patterns of votes, the learned names and `LOCAL` examples at most.
    """
    sc = texts.sparkSession.sparkContext
    finder.learn(finder.learned, case_sketch(texts))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in texts.dtypes) + ", found string"
    plain = written(texts.mapInArrow(_found(sc.broadcast(finder)), schema), "plain")
    before = finder.lexicon
    # a new finder, as the first is still being sent
    finder = copy(finder).learn(_learned(_counted(plain, names=True)), finder.cases)
    found = plain.mapInArrow(_renamed(sc.broadcast(finder), finder.lexicon ^ before), schema)
    found = written(found if bare else found.where("found is not null"), "candidates")
    discard(plain)
    return finder, _fitted(found), found


def model(texts: DataFrame, finder: Finder) -> tuple[Finder, np.ndarray]:
    """The finder with what it learned from all of `texts` (`text`), and the span classifier's weights."""
    finder, weights, found = _modelled(texts.select("text"), finder, bare=False)
    discard(found)
    return finder, weights


def _keyed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    some = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]), lambda x: x["text"].isNotNull())
    return spread_out(df.select(F.col(key).alias("key"), *fields)).select("key", F.explode(some).alias("x")).select("key", "x.field", "x.text")


def _mentions(weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, field, text, found in zip(b["key"], b["field"], b["text"], b["found"], strict=True):
                seen = dict.fromkeys(range(len(TYPES)), 0)
                for kind, start, end in _chosen(json.loads(found), weights.value):
                    seen[kind] += 1
                    out.append((key, field, TYPES[kind], seen[kind], start, end, text[start:end]))
            yield pd.DataFrame(out, columns=["key", "field", "pii_type", "nth", "start", "stop", "mention"])

    return run


def mentions(df: DataFrame, key: str, fields: list[str], finder: Finder | None = None) -> DataFrame:
    """`key, field, pii_type, nth, start, stop, mention`: every mention in reading order; offsets in code points.

    No shuffle of the texts: one cheap pass counts how words are written, one finds candidates and stores them, from which the model is fitted
    and then decides. Null and empty texts have no mentions; repeated rows have theirs repeatedly; other columns are ignored.
    """
    _, weights, found = _modelled(_keyed(df, key, fields), finder or Finder(), bare=False)
    weights = df.sparkSession.sparkContext.broadcast(weights)
    return found.mapInPandas(_mentions(weights), f"key {dict(df.dtypes)[key]}, field string, pii_type string, nth bigint, start int, stop int, mention string").withColumnRenamed("key", key)


def _redacted(weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, found in zip(b["text"], b["found"], strict=True):
                for kind, start, end in reversed(_chosen(json.loads(found or "[]"), weights.value)):
                    text = f"{text[:start]}[{TYPES[kind].upper()}]{text[end:]}"
                out.append(text)
            yield b[["key", "field"]].assign(text=out)

    return run


def redacted(df: DataFrame, key: str, fields: list[str], finder: Finder | None = None) -> DataFrame:
    """`key, field, text`: each text that is not null with every mention replaced by its type in brackets, the rest unchanged."""
    _, weights, found = _modelled(_keyed(df, key, fields), finder or Finder(), bare=True)
    weights = df.sparkSession.sparkContext.broadcast(weights)
    return found.mapInPandas(_redacted(weights), f"key {dict(df.dtypes)[key]}, field string, text string").withColumnRenamed("key", key)
