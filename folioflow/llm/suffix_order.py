"""Suffix sort of chosen positions by comparing prefix hashes, and the hashes it uses.

Two suffixes are compared by the length of their common extension, which a binary search over prefix polynomial hashes
finds in a number of steps that is logarithmic in the limit; the next byte decides. Positions are sorted by a bottom-up
mergesort whose merges place all elements of all runs at once; runs that follow each other already are left as they are,
and the sort begins with positions in the order of their first eight bytes. Strings that stand together and have equal
hashes are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from folioflow.llm.shingles import powers

#: A random value for each byte, so that the polynomial does not see the bytes' own arithmetic.
BYTES = np.random.default_rng(2718).integers(1, 1 << 63, 256).astype(np.uint64)


class PrefixHash:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        size = 1 << int(len(data) + 1).bit_length()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * powers(size, False)[: len(data)], out=self.sums[1:])
        self.down = powers(size, True)

    def words(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each position on as a number, zeros beyond the end."""
        places = at[:, None] + np.arange(8)
        found = np.where(places < len(self.data), self.data[np.minimum(places, len(self.data) - 1)], 0).astype(np.uint8)
        return np.ascontiguousarray(found).view(">u8").reshape(-1).astype(np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], the same wherever the string stands."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to limit."""
        n = len(self.data)
        low, high = np.zeros(len(a), np.int64), np.minimum(limit, n - np.maximum(a, b))
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.of(a, a + middle) == self.of(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def before(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether the suffix at a, cut at limit bytes, sorts before that at b; ties go to the smaller position."""
    n, data = len(hashes.data), hashes.data
    length = np.minimum(limit, n - np.maximum(a, b))
    part = np.flatnonzero(hashes.of(a, a + length) != hashes.of(b, b + length))
    length[part] = hashes.common(a[part], b[part], limit)
    end_a, end_b = a + length, b + length
    left = np.where(end_a < n, data[np.minimum(end_a, n - 1)].astype(np.int16), -1)
    right = np.where(end_b < n, data[np.minimum(end_b, n - 1)].astype(np.int16), -1)
    # equal next bytes would mean that two hashes collide
    tie = (length == limit) | (a == b) | (left == right)
    return np.where(tie, a < b, left < right)


def suffix_order(hashes: PrefixHash, starts: np.ndarray, limit: int) -> np.ndarray:
    """starts in the order of their suffixes cut at limit bytes."""
    places = np.sort(starts)
    words = hashes.words(places) if limit >= 8 and len(places) else np.zeros(len(places), np.uint64)

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """before, of the a-th and b-th place: most differ in their first bytes."""
        out, close = words[a] < words[b], np.flatnonzero(words[a] == words[b])
        if len(close):
            out[close] = before(hashes, places[a[close]], places[b[close]], limit)
        return out

    order = np.argsort(words, kind="stable")
    n, size = len(order), 1
    while size < n:
        seams = np.arange(size, n, 2 * size)
        loose = np.zeros(-(-n // (2 * size)), bool)
        loose[: len(seams)] = ~less(order[seams - 1], order[seams])
        if loose.any():
            at = np.flatnonzero(loose[np.arange(n) // (2 * size)])
            run = at // size
            partner = run ^ 1
            low, high = np.minimum(partner * size, n), np.minimum((partner + 1) * size, n)
            first, mine = low.copy(), order[at]
            # the place of each element among its partner run, by a binary search of all at once
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                below = less(order[middle], mine[open_])
                low[open_], high[open_] = np.where(below, middle + 1, low[open_]), np.where(below, high[open_], middle)
            order[(run & ~1) * size + (at - run * size) + (low - first)] = mine
        size *= 2
    return places[order]


def equal_groups(hashes: PrefixHash, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each string data[start:start + length] the index of an equal one that stands for all of them.

    Equal strings of one length stand together in the suffix order of the strings of that length, so each is compared with
    its neighbour there: first by the length of their common extension, then byte by byte. Where bytes differ although
    hashes say that they don't, the order can't be trusted, and all strings are told apart by their bytes.
    """
    out = np.arange(len(starts))
    if len(starts) < 2:
        return out
    order = suffix_order(hashes, np.unique(starts), int(lengths.max()))
    rank = np.empty(len(hashes.data) + 1, np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((out, rank[starts], lengths))
    a, b = by[:-1], by[1:]
    joined = (lengths[a] == lengths[b]) & (hashes.of(starts[a], starts[a] + lengths[a]) == hashes.of(starts[b], starts[b] + lengths[b]))
    raw = hashes.data.tobytes()
    leader = int(by[0])
    for i, same in zip(b.tolist(), joined.tolist(), strict=True):
        if not same:
            leader = i
            continue
        s, t, n = int(starts[leader]), int(starts[i]), int(lengths[i])
        if raw[s : s + n] != raw[t : t + n]:
            return equal_bytes(raw, starts, lengths)
        out[i] = leader
    return out


def equal_bytes(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What equal_groups says, from the strings themselves."""
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(raw[s : s + n], i) for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True))], np.int64)
