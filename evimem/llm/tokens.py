"""Token ids of a public byte-level BPE, by dynamic programming over prefixes."""

from __future__ import annotations

import itertools
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimem.session import spread_out

#: Most pieces, and pairs of tokens, that a worker remembers; past that it forgets all of them and goes on.
MEMORY = 400_000


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file of the public tokenizers (their path is a parameter everywhere)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Bpe:
    """A byte-level BPE from the text of its tokenizer file (vocabulary and merges).

    The encoding of a byte string ends in exactly one token t for which the encoding of the string without t, followed by t,
    is itself an encoding; the last token of every prefix therefore gives the whole encoding, and a longer string
    only continues the table. Two tokens may follow each other if merging them, or the parts at their border, never
    comes before the merges that made them.
    """

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        chars = _byte_of_char()
        ids = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if all(c in chars for c in token)}
        self.bytes_of = {i: token for token, i in ids.items()}
        self.rank: dict[int, int] = {}  # of a token: when it is merged, single bytes first
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, i in ids.items():
            if len(token) == 1:
                self.rank[i], self.parts[i] = -1, (i, i)
        for n, merge in enumerate(model["merges"]):
            left, right = (ids[bytes(chars[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            i = ids[self.bytes_of[left] + self.bytes_of[right]]
            self.joined[left, right] = i
            if i not in self.rank:
                self.rank[i], self.parts[i] = n, (left, right)
        self.order = {i: n for n, i in enumerate(sorted(self.rank, key=lambda i: (self.rank[i], i)))}
        self.ends = ahocorasick.Automaton()  # gives the tokens that end at each byte
        for token, i in ids.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.size = {i: len(token) for token, i in ids.items()}
        self.longest = max(self.size.values())
        self.pairs: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined bytes is a, b."""
        key, order, parts, before = a << 32 | b, self.order, self.parts, sys.maxsize
        while True:
            made = self.joined.get((a, b))
            if made is not None and order[made] < before:
                result = False
                break
            # undo the later of the two merges at the border
            if order[a] > order[b]:
                before, a = order[a], parts[a][1]
                if order[a] == before:
                    before, b = order[b] + 1, parts[b][0]
                    if order[b] + 1 == before:
                        result = True
                        break
            else:
                before, b = order[b] + 1, parts[b][0]
                if order[b] + 1 == before:
                    before, a = order[a], parts[a][1]
                    if order[a] == before:
                        result = True
                        break
        if len(self.pairs) > MEMORY:
            self.pairs.clear()
        self.pairs[key] = result
        return result

    def table(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of `piece`; `last` may hold those of its first bytes."""
        begin = len(last) if last else 1
        last = [*(last or [-1]), *[-1] * (len(piece) + 1 - begin)]
        skipped = max(0, begin - self.longest)
        pairs = self.pairs
        for at, (token, size) in self.ends.iter(piece[skipped:].decode("latin-1")):
            end = skipped + at + 1
            if last[end] >= 0:
                continue
            if end == size:
                last[end] = token
                continue
            before = last[end - size]
            fits = pairs.get(before << 32 | token)
            if fits if fits is not None else self.may_follow(before, token):
                last[end] = token
        return last

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        return self.tokens(self.table(piece))

    def tokens(self, last: list[int]) -> tuple[int, ...]:
        """The encoding that a table of last tokens stands for."""
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return tuple(reversed(out))


def _byte_of_char() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pieces(dict):
    """Ids of the pieces of texts, remembered."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.bpe.encode_piece(piece.encode())
        return ids


@lru_cache(maxsize=1)
def _odd_characters() -> frozenset[str]:
    """Characters that the standard library's classes treat unlike the tokenizer's: numbers that are no decimal digits, odd white space."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")) | frozenset(map(chr, range(0x1C, 0x20)))


#: Contractions, letters, digits, other signs, white space up to a word, other white space: the pieces that are never joined.
_QUICK = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def pieces(text: str) -> list[str]:
    """The pieces of `text`; joined they are the text."""
    if _odd_characters().isdisjoint(text):
        return _QUICK.findall(text)
    import public_tokenizers
    import regex

    # white space as Unicode defines it, without the four separators that the library's \s adds
    return regex.findall(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), text)


@lru_cache(maxsize=4)
def _loaded(text: str) -> Pieces:
    return Pieces(Bpe(text))


def encode(text: str | None, known: Pieces) -> list[int]:
    """Token ids of `text`; none for null and empty texts."""
    return list(itertools.chain.from_iterable(map(known.__getitem__, pieces(text)))) if text else []


class Encoded:
    """A text with its pieces and, for each, the table of the last token of every prefix: what appends and edits go on from."""

    __slots__ = ("starts", "tables", "text")

    def __init__(self, text: str, starts: list[int], tables: list[list[int]]):
        self.text, self.starts, self.tables = text, starts, tables

    def ids(self, bpe: Bpe) -> list[int]:
        """Token ids of the whole text."""
        return [t for table in self.tables for t in bpe.tokens(table)]


def _scanner(text: str):
    """The pattern of pieces for `text`: a piece that begins at a border depends on what follows only."""
    if _odd_characters().isdisjoint(text):
        return _QUICK
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def stored(text: str, bpe: Bpe) -> Encoded:
    """`text` with the tables of its pieces."""
    return edited(Encoded("", [], []), 0, 0, text, bpe)[0]


def edited(old: Encoded, start: int, stop: int, new: str, bpe: Bpe) -> tuple[Encoded, int]:
    """`old` with text[start:stop] replaced by `new`, and how many bytes were encoded for it; an append is an edit at the end.

    Pieces that end before the edit stay, as none looks further than two characters ahead. From there pieces are cut anew until one begins, behind the
    edit, where an old one began: all that follow stay too. A piece that begins as an old one did goes on from that one's table, so
    of one very long piece only the bytes from the edit on are encoded.
    """
    text, moved = old.text[:start] + new + old.text[stop:], len(new) - (stop - start)
    ends = [*old.starts[1:], len(old.text)][: len(old.starts)]
    keep = bisect_left(ends, start - 1)
    at = old.starts[keep] if keep < len(old.starts) else len(old.text)
    if keep == len(old.starts) and keep:
        keep, at = keep - 1, old.starts[-1]
    scan = _scanner(text).match
    starts, tables, work = old.starts[:keep], old.tables[:keep], 0
    first = keep
    while at < len(text):
        if at >= start + len(new):
            again = bisect_left(old.starts, at - moved)
            if again < len(old.starts) and old.starts[again] == at - moved and at - moved >= stop:
                starts += [x + moved for x in old.starts[again:]]
                tables += old.tables[again:]
                break
        end = scan(text, at).end()
        piece, before = text[at:end].encode(), None
        if first < len(old.starts) and old.starts[first] == at:
            was = old.text[at : ends[first]].encode()
            same = next((k for k, (a, b) in enumerate(zip(was, piece, strict=False)) if a != b), min(len(was), len(piece)))
            before = old.tables[first][: same + 1]
        first += 1
        work += len(piece) - (len(before) - 1 if before else 0)
        starts.append(at)
        tables.append(bpe.table(piece, before) if before is None or len(before) <= len(piece) else before)
        at = end
    return Encoded(text, starts, tables), work


def _encoder(vocabulary, keep: list[str], sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(vocabulary.value)
        get = known.__getitem__
        for batch in batches:
            if len(known) > MEMORY:
                known.clear()
            flat, ends = array("i"), array("i", [0])
            for text in batch.column("text").to_pylist():
                if sizes:
                    ends.append(sum(map(len, map(get, pieces(text)))) if text else 0)
                elif text:
                    flat.extend(itertools.chain.from_iterable(map(get, pieces(text))))
                    ends.append(len(flat))
                else:
                    ends.append(len(flat))
            if sizes:
                yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(memoryview(ends)[1:], pa.int64())], names=[*keep, "n_tokens"])
            else:
                ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*map(batch.column, keep), ids], names=[*keep, "ids"])

    return run


def _run(df: DataFrame, keep: list[str], text: str, file: str | None, sizes: bool) -> DataFrame:
    # at most a few MB: one vocabulary, whatever the number of texts
    vocabulary = df.sparkSession.sparkContext.broadcast(Path(file or vocabulary_file()).read_text())
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", n_tokens bigint" if sizes else ", ids array<int>")
    return spread_out(df.select(*keep, F.col(text).alias("text"))).mapInArrow(_encoder(vocabulary, keep, sizes), schema)


def token_ids(df: DataFrame, key: str, text: str, file: str | None = None) -> DataFrame:
    """`key, ids`: the token ids of each whole text, without special tokens; null and empty texts have an empty list.

    No shuffle: each task encodes its rows. Very long unbroken texts take time in proportion to their length. Every
    row of `df` gives one row, repeated rows too.
    """
    return _run(df, [key], text, file, sizes=False)


def token_sizes(df: DataFrame, keep: list[str], text: str, file: str | None = None) -> DataFrame:
    """The columns `keep` and `n_tokens`, the number of tokens of each whole text, 0 for null and empty ones."""
    return _run(df, keep, text, file, sizes=True)
