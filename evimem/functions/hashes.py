"""MD5 of many short texts at once, where an engine's own function would spend most of its time on each text's overhead."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Hashes that are computed together; six arrays of this length stay near the processor.
BLOCK = 1 << 16
# MD5's constants; the digest's first word takes no part in the last three of the 64 steps
_STEPS = 61
_ADD = [int(abs(math.sin(k + 1)) * 2**32) for k in range(_STEPS)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = [(k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16 for k in range(_STEPS)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def numbered(prefixes: list[str], first: int, last: int) -> np.ndarray:
    """The first eight hex digits, as a number, of the MD5 of each prefix followed by each number from `first` to `last` - 1: a row a prefix."""
    heads = [p.encode() for p in prefixes]
    out = np.empty((len(heads), last - first), np.uint32)
    numbers = np.arange(first, last).astype("S")
    sizes = np.array([len(h) for h in heads])
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        if size + numbers.itemsize > 55:  # more than a block of MD5
            out[which] = [[int(hashlib.md5(heads[k] + x).hexdigest()[:8], 16) for x in numbers] for k in which]
            continue
        tails = _tails(numbers, size)
        step = max(1, BLOCK // max(1, len(numbers)))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            words = np.frombuffer(b"".join(heads[k].ljust(64, b"\0") for k in part), "<u4").reshape(-1, 16)
            out[part] = _first_words(words, tails, len(numbers))
    return out


def _tails(numbers: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """What texts that end with `numbers` after `size` bytes add to the words of their block: digits, end mark and length."""
    digits = numbers.view(np.uint8).reshape(len(numbers), -1)
    lengths = (digits > 0).sum(1)
    block = np.zeros((len(numbers), 64), np.uint8)
    block[:, size : size + digits.shape[1]] = digits
    block[np.arange(len(numbers)), size + lengths] = 0x80
    words = block.view("<u4")
    words[:, 14] = 8 * (size + lengths)
    return {w: np.ascontiguousarray(words[:, w]) for w in range(16) if words[:, w].any()}


def _first_words(heads: np.ndarray, tails: dict[int, np.ndarray], n: int) -> np.ndarray:
    a, b, c, d = (np.full((len(heads), n), x, np.uint32) for x in _BEGIN)
    f, turned = np.empty_like(a), np.empty_like(a)
    for k, (add, word) in enumerate(zip(_ADD, _WORD, strict=True)):
        left = _TURN[k // 16][k % 4]
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        a += f
        a += (heads[:, word] + np.uint32(add))[:, None]
        if word in tails:
            a += tails[word]
        np.left_shift(a, np.uint32(left), out=turned)
        np.right_shift(a, np.uint32(32 - left), out=a)
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_BEGIN[0])
    return b.byteswap(inplace=True)
