"""Word shingles and MinHash signatures of texts, in numpy.

Texts are lower-cased (A-Z), words are runs without white space. The set of a text holds 64-bit hashes of its five-word
shingles; with fewer words the whole sequence is the only one.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Orders of the forest and values that a region shares at least.
TREES, LEAST_DEPTH = 24, 3
HASHES = TREES * LEAST_DEPTH
#: Ranges of hash values in a sketch, one byte each; a power of two.
BINS = 256

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: shifts and odd multipliers, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_rng = np.random.default_rng(75)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of the first word of each text (one more at the end)."""
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[whole]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    power = np.cumprod(np.full(len(whole), _BASE), dtype=np.uint64)
    back = np.cumprod(np.full(len(whole), _INVERSE), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
    hashes = _mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; empty for texts without words."""
    words, first = word_hashes([(t or "").encode().lower() for t in texts])
    joined = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        joined = joined * _STEP + words[k : k + len(joined)]
    joined = _mixed(joined)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(joined[a : b - WIDTH + 1]))
        elif b > a:
            one = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = one * _STEP + w
                one = one + np.uint64(b - a)
            out.append(_mixed(np.array([one], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        some = shingles[start : start + 2048]
        np.minimum(least, (some[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = np.bitwise_xor.reduce(_mixed(shingles * _STEP)) if len(shingles) else np.uint64(0)
    b = np.add.reduce(_mixed(shingles + _BASE)) if len(shingles) else np.uint64(0)
    return tuple(int(x) for x in np.array([a, b], np.uint64).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """The least hash of each of `BINS` ranges, one byte each from 1 on; 0 for a range without one. Shingles are sorted."""
    held, first = np.unique((shingles >> np.uint64(65 - BINS.bit_length())).astype(np.int64), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[held] = shingles[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def may_be_similar(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets with these rows of sketches may be as similar as that; sizes: sum of the sizes of both sets.

    The ranges with a value are a sample, without repetition, of the union of both sets; equal values are its part of the
    intersection. At that similarity fewer of them than five standard deviations below it are not to be expected.
    """
    sample = ((x | y) != 0).sum(axis=1)
    union = np.maximum(sizes / (1 + similar), sample)
    deviation = np.sqrt(similar * (1 - similar) / sample * (union - sample) / np.maximum(union - 1, 1))
    # one value more or less, for very small sets
    return ((x == y) & (x != 0)).sum(axis=1) >= sample * (similar - 5 * deviation) - 1
