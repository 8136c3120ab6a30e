"""Bit-sliced Hamming comparison: fingerprints stored as vertical bit planes, distances in carry-save bit counters."""

from __future__ import annotations

import numpy as np


def planes_of(words: np.ndarray) -> np.ndarray:
    """[n, W] uint64 fingerprints -> [64 W, ceil(n / 64) + 2] uint64: bit i of plane p is bit p of fingerprint i."""
    n, width = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    blocks = (n + 63) // 64
    out = np.zeros((64 * width, (blocks + 2) * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _pack(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    out = np.zeros(-(-len(packed) // 8) * 8, dtype=np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter exceeds radius."""
    more = np.zeros_like(counter[0])
    same = np.full_like(counter[0], ~np.uint64(0))
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def near_pairs(group: np.ndarray, words: np.ndarray, radius: int, roots=None):
    """Yield (i, j) index arrays, i < j, of rows of one group at Hamming distance radius or less.

    roots: a function that gives each row's class so far; pairs inside a class are then left out.

    group: codes, equal codes adjacent. words: [n, W] uint64. For each offset d all pairs (i, i + d) are compared at
    once, 64 to a word: planes are XORed with themselves shifted by d, three at a time go through a carry-save adder,
    and words in which every lane has exceeded the radius are abandoned.
    """
    n = len(group)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    last = np.repeat(starts + sizes, sizes)  # end of each row's group
    planes = planes_of(words)
    depth = (radius + 8).bit_length() + 1
    place, label, reach = np.arange(n), None, int(sizes.max())
    for d in range(1, n):
        if d >= reach:
            break
        lanes = place + d < last
        if roots is not None:
            if (new := roots()) is not label:
                # Groups that are one class already need no further offsets.
                label = new
                apart = np.add.reduceat(label != np.repeat(label[starts], sizes), starts) > 0
                reach = int(sizes[apart].max(initial=0))
            lanes[: n - d] &= label[: n - d] != label[d:]
        valid = _pack(lanes)
        act = np.flatnonzero(valid)
        if not len(act):
            continue
        step, bit = divmod(d, 64)
        lanes = valid[act]
        counter = [np.zeros(len(act), dtype=np.uint64) for _ in range(depth)]

        def diff(p, act=None, step=step, bit=bit):
            row = planes[p]
            far = row[act + step]
            if bit:
                far = (far >> np.uint64(bit)) | (row[act + step + 1] << np.uint64(64 - bit))
            return row[act] ^ far

        for p in range(0, len(planes), 2):
            x, y = diff(p, act), diff(p + 1, act)
            carry = (counter[0] & x) | (y & (counter[0] ^ x))
            counter[0] = counter[0] ^ x ^ y
            for k in range(1, depth):
                if k == depth - 1:
                    counter[k] |= carry  # saturates above every radius that fits below it
                else:
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if p % 16 == 14 and p + 2 > radius:
                lanes &= ~(_above(counter, radius) | counter[-1])
                keep = lanes != 0
                if not keep.all():
                    act, lanes = act[keep], lanes[keep]
                    counter = [c[keep] for c in counter]
                    if not len(act):
                        break
        if len(act):
            lanes &= ~(_above(counter, radius) | counter[-1])
            at, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            if len(at):
                i = act[at] * 64 + lane
                yield i, i + d


class Forest:
    """Classes of rows under pairs; the root of a class is its smallest index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.root[i] != self.root[j]
        if not new.any():
            return
        root = self.root.copy()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i[new].tolist(), j[new].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
        while not ((up := root[root]) == root).all():
            root = up
        self.root = root


def near_classes(group: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """Root of every row's class under all links of the radius inside its group."""
    classes = Forest(len(group))
    for i, j in near_pairs(group, words, radius, lambda: classes.root):
        classes.join(i, j)
    return classes.root
