"""The md5 draws of ``extra_trees.draw`` for many numbers at once: the rounds run over arrays, not over texts."""

from __future__ import annotations

import hashlib
import math

import numpy as np

BLOCK = 16_384  # messages at a time, so that a round stays in the processor's cache
FEW = 400  # draws that texts give sooner than arrays
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _digest(words: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of messages of one block, given as 16 rows of words; from ``used`` to 13 all are zero."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        place = _PLACES[i]
        if place < used or place == 14:
            f += words[place]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + _START[0], b + _START[1]


def plain_draws(seed: int, purpose: str, tree: int, names: np.ndarray, features: np.ndarray) -> np.ndarray:
    """``plain_draw(seed, purpose, tree, name, feature)``: for every name those of its row of ``features``."""
    names, features = np.asarray(names, np.int64), np.asarray(features, np.int64)
    start, wide = f"{seed}:{purpose}:{tree}:".encode(), features.shape[1]
    out = np.empty(features.shape)
    if not out.size:
        return out
    ends = np.array([b":%d\x80" % f for f in range(int(features.max()) + 1)])
    ends = ends.view(np.uint8).reshape(len(ends), -1)
    if len(start) + 19 + ends.shape[1] > 56 or out.size < FEW:  # no room in one block, or few
        pairs = ((n, f) for n, row in zip(names.tolist(), features.tolist()) for f in row)
        found = [int(hashlib.md5(b"%s%d:%d" % (start, n, f)).hexdigest()[:13], 16) for n, f in pairs]
        return (np.array(found) / float(16**13)).reshape(out.shape)
    step = max(1, BLOCK // wide)
    for at in range(0, len(names), step):
        digits = names[at : at + step].astype("S19").view(np.uint8).reshape(-1, 19)
        column = features[at : at + step].ravel()
        message = np.zeros((len(digits), 64), np.uint8)
        message[:, : len(start)] = np.frombuffer(start, np.uint8)
        message[:, len(start) : len(start) + 19] = digits
        message = np.repeat(message, wide, axis=0)
        row, end = np.arange(len(message)), np.repeat(len(start) + np.count_nonzero(digits, axis=1), wide)
        for place in range(ends.shape[1]):
            message[row, end + place] = ends[column, place]
        length = end + np.count_nonzero(ends, axis=1)[column] - 1
        words = np.ascontiguousarray(message.view("<u4").T)
        words[14] = length * 8
        first, second = _digest(words, int(length.max()) // 4 + 1)
        # Thirteen hex digits: the bytes of the first word, then five digits of the second.
        value = (first.byteswap().astype(np.uint64) << np.uint64(20)) | (second.byteswap() >> np.uint32(12))
        out[at : at + step] = value.reshape(-1, wide)
    return out / float(16**13)
