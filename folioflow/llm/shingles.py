"""Word shingles of texts, as sorted sets of 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than ASCII white space in the lower-cased text; their hashes are differences of prefix
polynomials, so no word becomes a Python object. A text of fewer words than a shingle has one shingle of all its words; a
null text or one without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, INVERSE if inverse else BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and how many each text has."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = edge[~blank[edge]]
    if len(data) and not blank[0]:
        starts = np.concatenate([[0], starts])
    ends = edge[blank[edge]]
    size = 1 << int(len(data) + 1).bit_length()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(size, False)[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(size, True)[starts])
    texts_end = np.cumsum([len(x) + 1 for x in raw])
    upto = np.searchsorted(starts, texts_end)
    return hashes, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * np.uint64(2 * (k + 1) * 0x632BE59BD9B4E019 + 1 & (1 << 64) - 1)
    rolled = mixed(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            out.append(mixed(np.bitwise_xor.reduce(hashes[end - n : end] * (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(3)), keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
