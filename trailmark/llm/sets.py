"""Comparison of sorted arrays of hashes: bitmaps that bound the overlap from above, exact Jaccard similarity, linked groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa


def differing(threshold: Fraction, a: int, b: int) -> int:
    """The most elements in which similar sets of sizes a and b differ."""
    return math.floor((1 - threshold) / (1 + threshold) * (a + b))


def bit_width(size: int) -> int:
    return max(8, (2 * size - 1).bit_length())


def bitmap(elements: np.ndarray, width: int | None = None) -> np.ndarray:
    """A bit for each element, by its highest bits, in a field at least twice as large as the set; as bytes."""
    width = width or bit_width(len(elements))
    field = np.zeros(1 << width, bool)
    field[(elements >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(field)


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits that differ, never more than elements do; the longer field is folded to the shorter one's width first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = np.packbits(np.unpackbits(x).reshape(len(y) * 8, -1).any(1))
    return int(np.bitwise_count(x ^ y).sum())


def alike(e: np.ndarray, f: np.ndarray, threshold: Fraction) -> bool:
    """Whether the Jaccard similarity of two sorted arrays is at least the threshold, in whole numbers."""
    both = np.concatenate([e, f])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return threshold.denominator * shared >= threshold.numerator * (len(both) - shared)


def bounded(threshold: Fraction):
    """Pairs (a, b, na, nb, bits of both) that the bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            ok = [i for i in range(len(a)) if bits_apart(x[i], y[i]) <= differing(threshold, na[i], nb[i])]
            yield batch.select([0, 1]).take(pa.array(ok, pa.int64()))

    return run


def similar(threshold: Fraction):
    """Pairs (a, b, sorted elements of both) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3), strict=True)
            ok = [i for i, (x, y) in enumerate(sides) if alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold)]
            yield batch.select([0, 1]).take(pa.array(ok, pa.int64()))

    return run


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows that follow one another with the same whole numbers in the first ``width`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(width)])
        start = 0
        for end in [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]:
            now = tuple(keys[:, start])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last, start = now, end
    if held:
        yield pa.Table.from_batches(held)


class Possible:
    """Pairs of one block, or of two, that sizes and bitmaps do not rule out."""

    def __init__(self, threshold: Fraction):
        self.p = (1 - threshold).numerator * (1 + threshold).denominator
        self.q = (1 + threshold).numerator * (1 - threshold).denominator

    def pairs(self, sizes: np.ndarray, bits: np.ndarray, block: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places (i, j) of different groups; ``group`` may change meanwhile."""
        across = (block != block[0]).any()
        for i in range(len(sizes)):
            rest = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & ((block[i + 1 :] != block[i]) if across else True))
            rest = rest[np.abs(sizes[rest] - sizes[i]) <= self.p * (sizes[rest] + sizes[i]) // self.q]
            for part in np.array_split(rest, max(1, len(rest) * bits.shape[1] // 2_000_000)):
                apart = np.bitwise_count(bits[part] ^ bits[i]).sum(1, dtype=np.int64)
                for j in part[apart <= self.p * (sizes[part] + sizes[i]) // self.q].tolist():
                    if group[j] != group[i]:
                        yield i, j


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of several widths as rows of the smallest width."""
    width = min(map(len, maps))
    rows = [np.frombuffer(x, np.uint8) if len(x) == width else np.packbits(np.unpackbits(np.frombuffer(x, np.uint8)).reshape(width * 8, -1).any(1)) for x in maps]
    return np.stack(rows).view(np.uint64)


def near_in_tiles(threshold: Fraction):
    """From sorted (key, i, j, block, c, g, n, bits): c, g and h of the items that may be linked with another group of
    their tile, h being the smallest of the groups that hang together so."""
    possible = Possible(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for tile in runs(batches, 3):
            block, c, g, n = (tile.column(k).to_numpy() for k in (3, 4, 5, 6))
            once = np.unique(c, return_index=True)[1]
            block, c, g, n = block[once], c[once], g[once], n[once]
            if (g == g[0]).all():
                continue
            maps = tile.column(7).to_pylist()
            own, group = np.unique(g, return_inverse=True)
            united, hit = np.arange(len(own)), np.zeros(len(c), bool)
            for i, j in possible.pairs(n, folded([maps[k] for k in once]), block, group):
                hit[i] = hit[j] = True
                a, b = sorted((united[group[i]], united[group[j]]))
                if a != b:
                    united[united == b] = a
            if hit.any():
                out.append(np.stack([c[hit], g[hit], own[united[group[hit]]]]))
            if sum(x.shape[1] for x in out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], ["c", "g", "h"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], ["c", "g", "h"])

    return run


def linking(threshold: Fraction):
    """From sorted (cluster, i, j, block, c, g, e): pairs (a, b) of groups that are linked.

    Every pair of items of different groups is compared, by bitmaps first; as soon as two groups are linked they are
    one, so the pairs returned are fewer than the groups.
    """
    possible = Possible(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cluster in runs(batches, 3):
            block, c, g = (cluster.column(k).to_numpy() for k in (3, 4, 5))
            once = np.unique(c, return_index=True)[1]
            block, g, column = block[once], g[once], cluster.column(6)
            sets = [np.frombuffer(column[int(k)].as_py(), np.uint64) for k in once]
            sizes = np.array([len(e) for e in sets])
            width = bit_width(4 * int(sizes.max()))
            group = np.unique(g, return_inverse=True)[1]
            out: list[tuple[int, int]] = []
            for i, j in possible.pairs(sizes, np.stack([bitmap(e, width) for e in sets]).view(np.uint64), block, group):
                if alike(sets[i], sets[j], threshold):
                    out.append((g[i], g[j]))
                    group[group == group[j]] = group[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(out, np.int64).T], ["a", "b"])

    return run
