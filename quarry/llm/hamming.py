"""SimHash votes and a Gray-order hierarchical index over fingerprints, in numpy.

A fingerprint is a row of W unsigned 64-bit words. Sorted by Gray rank, neighbours share long runs of leading
bits. The index is a forest over that order: a node stands for up to FAN consecutive children of one
key and keeps a mask of the bits on which all codes below agree, with their values. Two nodes differ at least in
the bits that both masks hold and whose values differ, so a self-join walks pairs of nodes from the roots
down and drops a pair, with all codes below, as soon as that sum passes the radius. A pair is dropped likewise if all codes
below both are known to belong together.
"""

from __future__ import annotations

import numpy as np

FAN = 4
#: Node pairs that are expanded at once: bounds memory, not results.
CHUNK = 1 << 15


def vote(digests: bytes, bits: int, weights: np.ndarray | None = None) -> np.ndarray:
    """One fingerprint (bits / 64 words) of terms with `bits` / 8 digest bytes each.

    A bit is 1 if the terms that have it set weigh over half of all. No terms: zero.
    """
    width = bits // 8
    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)
    if not len(rows):
        return np.zeros(bits // 64, ">u8")
    if weights is None:
        total, count = np.zeros(bits, np.int64), len(rows)
        for at in range(0, count, 255 * 64):
            part = np.unpackbits(rows[at : at + 255 * 64], axis=1)
            if len(part) % 255:
                part = np.concatenate([part, np.zeros((-len(part) % 255, bits), np.uint8)])
            # eight counters a word: 255 ones don't overflow a byte
            lanes = part.view(np.uint64).reshape(-1, 255, width).sum(axis=1, dtype=np.uint64)
            total += lanes.view(np.uint8).sum(axis=0, dtype=np.int64)
        chosen = total * 2 > count
    else:
        total = np.zeros(bits)
        for at in range(0, len(rows), 1 << 14):
            total += weights[at : at + (1 << 14)] @ np.unpackbits(rows[at : at + (1 << 14)], axis=1)
        chosen = total * 2 > weights.sum()
    return np.packbits(chosen).view(">u8")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: words of a binary number whose Gray code is the fingerprint."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    for w in range(1, rank.shape[1]):
        odd = (rank[:, w - 1] & np.uint64(1)).astype(bool)
        rank[odd, w] = ~rank[odd, w]
    return rank


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """The forest over codes (n, W), one tree for each value of keys."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        codes = codes.astype(np.uint64)
        rank = gray_rank(codes)
        self.order = np.lexsort([*rank.T[::-1], keys])
        self.keys, codes = keys[self.order], codes[self.order]
        self.label: list[tuple[np.ndarray, np.ndarray]] = []
        full = np.full_like(codes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(codes, full, None, None)]  # pattern, mask, first child, number of children
        key = self.keys
        while True:
            pattern, mask, *_ = self.levels[-1]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            if len(starts) == len(key):
                break
            place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
            first = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(low ^ high)
            self.levels.append((low & shared, shared, first, np.diff(np.r_[first, len(key)])))
            key = key[first]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the input of codes of one key that follow one another in Gray order."""
        same = self.keys[1:] == self.keys[:-1]
        return self.order[1:][same], self.order[:-1][same]

    def known(self, label: np.ndarray) -> None:
        """Codes of equal label (one for each place in the input) belong together: pairs leaves them out."""
        low = high = label[self.order]
        self.label = [(low, high)]
        for _, _, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.label.append((low, high))

    def pairs(self, radius: int):
        """Blocks (a, b, distance) of pairs of one key within the radius that aren't known to belong together, as places in the input; each
        pair once."""
        top = len(self.levels) - 1
        if top <= 0:
            return
        n = len(self.levels[top][0])
        todo = [(top, at, at) for at in np.array_split(np.arange(n), max(1, n // CHUNK + 1))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > CHUNK:
                half = len(a) // 2
                todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            _, _, first, count = self.levels[level]
            fan = count[a] * count[b]
            ends = np.cumsum(fan)
            within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - fan, fan)
            wide = np.repeat(count[b], fan)
            left = np.repeat(first[a], fan) + within // np.maximum(wide, 1)
            right = np.repeat(first[b], fan) + within % np.maximum(wide, 1)
            level -= 1
            keep = left < right if level == 0 else left <= right
            if self.label:
                low, high = self.label[level]
                keep &= np.minimum(low[left], low[right]) != np.maximum(high[left], high[right])
            left, right = left[keep], right[keep]
            pattern, mask, *_ = self.levels[level]
            apart = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right]).sum(axis=1, dtype=np.int64)
            near = apart <= radius
            left, right, apart = left[near], right[near], apart[near]
            if level == 0:
                yield self.order[left], self.order[right], apart
            elif len(left):
                todo.append((level, left, right))
