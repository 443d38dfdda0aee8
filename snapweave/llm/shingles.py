"""Sets of word shingles of whole texts as 64-bit hashes, and their parity sketches. Plain numpy on one batch."""

from __future__ import annotations

import numpy as np

WORDS = 5
_DRAW = np.random.default_rng(20_240_229)
_BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _DRAW.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts ``data[cuts[i]:cuts[i + 1]]`` one after the other, and their cuts.

    Words are runs without white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle.
    """
    docs = len(cuts) - 1
    origin = cuts[0]
    text, cuts = _LOWER[data[origin : cuts[-1]]], cuts - origin
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    inside = ~_SPACE[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = cuts[(cuts > 0) & (cuts < len(text))]
    begins[borders] = inside[borders]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[borders - 1] = inside[borders - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * _powers(_BASE, len(text)), dtype=np.uint64)])
    words = mix((sums[last] - sums[first]) * _powers(_INVERSE, len(text))[first] + (last - first).astype(np.uint64))
    word_cuts = np.searchsorted(first, cuts)
    counts = np.diff(word_cuts)
    total = np.zeros(len(words), np.uint64)
    doc = np.repeat(np.arange(docs), counts)
    for k in range(WORDS):
        total[: max(0, len(words) - k)] += words[k:] * _PLACE[k]
    whole = np.zeros(len(words), bool)
    if len(words) >= WORDS:
        whole[: len(words) - WORDS + 1] = doc[: len(words) - WORDS + 1] == doc[WORDS - 1 :]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    for d in short:
        own = words[word_cuts[d] : word_cuts[d + 1]]
        total[word_cuts[d]] = (own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        whole[word_cuts[d]] = True
    found, doc = mix(total[whole]), doc[whole]
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[fresh], np.searchsorted(doc[fresh], np.arange(docs + 1))


def reduce_by(function: np.ufunc, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """``function`` over ``values[cuts[i]:cuts[i + 1]]``, 0 where that is empty."""
    out = np.zeros(len(cuts) - 1, values.dtype)
    filled = np.flatnonzero(np.diff(cuts))
    if len(filled):
        out[filled] = function.reduceat(values, cuts[:-1][filled])
    return out


def parity_sketches(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit sketches as 64-bit words one after the other, and their cuts.

    An element flips one bit, so the Hamming distance of two sketches never exceeds the symmetric difference of
    their sets. A sketch has 2 to 4 bits per element, a power of two; XOR of its halves is the sketch half as long.
    """
    n = np.diff(cuts)
    bits = np.full(len(n), 64, np.int64)
    large = n > 32
    bits[large] = 1 << np.ceil(np.log2(2 * n[large])).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(bits)])
    own = np.repeat(bits - 1, n)
    place = np.repeat(borders[:-1], n) + (sets & own.astype(np.uint64)).astype(np.int64)
    parity = np.bincount(place, minlength=int(borders[-1])).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64), borders // 64


def level_of(n: int) -> int:
    """Parts (as a power of two) into which sets of ``n`` elements are cut: 0.75 n to 1.5 n, many for small sets,
    so that every element has a part of its own."""
    return 24 if n <= 64 else (3 * n // 2).bit_length() - 1


def most_different(a: int, b: int) -> int:
    """Largest symmetric difference of sets of ``a`` and ``b`` elements with a similarity of at least 3/4."""
    return (a + b) // 7


def part_keys(own: np.ndarray, level: int, count: int) -> np.ndarray:
    """Keys of the first ``count`` parts that hold elements: the parity (XOR) of their elements' words, with the part's number."""
    part = own >> np.uint64(64 - level)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    stop = first[count] if len(first) > count else len(own)
    first = first[:count]
    words = np.bitwise_xor.reduceat(mix(own[:stop] + np.uint64(0x632BE59BD9B4E019)), first)
    return mix(words ^ mix(part[first] * np.uint64(64) + np.uint64(level)))


def signature(own: np.ndarray) -> np.ndarray:
    """Keys of one set: at its own level, and at that of the smallest partners where it differs.

    Sets that differ in at most d elements differ in at most d parts. Of the first K non-empty parts of
    each, in the order of the parts, at least K - d of one set are then equal non-empty parts among those of the
    other. K is 1.25 d + 2, so more than d / 4 keys are shared.
    """
    n = len(own)
    level, low = level_of(n), -(-3 * n // 4)
    differ = most_different(n, 4 * n // 3)
    keys = [part_keys(own, level, differ + differ // 4 + 2)]
    if level_of(low) != level:
        # The largest set of the lower level bounds the difference.
        most = low
        while level_of(most + 1) == level_of(low) and most + 1 < n:
            most += 1
        differ = most_different(n, most)
        keys.append(part_keys(own, level_of(low), differ + differ // 4 + 2))
    return np.concatenate(keys)
