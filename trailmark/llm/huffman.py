"""Canonical Huffman codes of limited length, packing of ids into bits and table-driven unpacking, in numpy.

A text's bits begin at a byte.  Where every ``LANE``-th id begins is written down (a checkpoint), so the lanes between
checkpoints are unpacked side by side: each step looks up the next code of every lane in one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of the longest code, unless there are more ids than these can tell apart; a window of 32 bits holds at most 25.
LONGEST, WINDOW = 18, 25
#: Ids between checkpoints, and lanes that are unpacked at once.
LANE = 256
LANES = 8_192


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length of each id's code, 0 for ids that do not occur: the best with no code longer than the limit.

    Package-merge: in ``longest`` rounds the pairs of the round before compete with the single ids; each id's length is
    how many of the cheapest 2 n - 2 of the last round hold it.
    """
    ids = np.flatnonzero(counts)
    n = len(ids)
    lengths = np.zeros(len(counts), np.int64)
    if n < 2:
        lengths[ids] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    if longest > WINDOW:
        raise ValueError("more ids than a table can hold")
    order = np.argsort(counts[ids], kind="stable")
    weights = counts[ids][order].astype(np.int64)
    rounds, here = [np.arange(n)], weights
    for _ in range(longest - 1):
        pairs = here[: len(here) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        rounds.append(at)  # under n: that single id; else a pair of the round before
        here = both[at]
    held, take = np.zeros(n, np.int64), 2 * n - 2
    for at in reversed(rounds):
        chosen = at[:take]
        # The chosen single ids and the chosen pairs are each the cheapest of their kind.
        singles = int((chosen < n).sum())
        held[:singles] += 1
        take = 2 * (len(chosen) - singles)
    lengths[ids[order]] = held
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then by id, counted up."""
    out = np.zeros(len(lengths), np.int64)
    code = last = 0
    for length in np.unique(lengths[lengths > 0]):
        ids = np.flatnonzero(lengths == length)
        code <<= int(length) - last
        out[ids] = code + np.arange(len(ids))
        code, last = code + len(ids), int(length)
    return out


class Codec:
    """Packs and unpacks ids by the lengths of their codes."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = codes(self.lengths).astype(np.uint64)
        self.width = int(lengths.max(initial=1))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        # Codes in order fill the table from its beginning; what is left belongs to no code.
        entries = np.repeat(ids << 5 | self.lengths[ids], 1 << (self.width - self.lengths[ids]))
        self.table = np.zeros(1 << self.width, np.int32)
        self.table[: len(entries)] = entries

    def pack(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of the texts whose ids follow one another: the bits, the bits between checkpoints, and how many of these each has."""
        ids = ids.astype(np.int64)
        length = self.lengths[ids]
        if len(ids) and not length.all():
            raise ValueError("an id without a code")
        ends = length.cumsum()
        last = np.r_[0, ends][np.r_[0, sizes.cumsum()]]
        bits = np.diff(last)
        n_bytes = (bits + 7) >> 3
        begin = (n_bytes.cumsum() - n_bytes) << 3
        at = ends - length + np.repeat(begin - last[:-1], sizes)
        words = np.zeros((int(n_bytes.sum()) >> 3) + 2, np.uint64)
        if len(ids):
            word, room = at >> 6, 64 - (at & 63) - length
            code = self.codes[ids]
            over = np.flatnonzero(room < 0)
            here = code << np.maximum(room, 0).astype(np.uint64)
            here[over] = code[over] >> (-room[over]).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[first]] = np.bitwise_or.reduceat(here, first)
            # At most one code goes over into each word.
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        raw, edge = words.astype(">u8").tobytes(), begin >> 3
        payload = [raw[a : a + n] for a, n in zip(edge.tolist(), n_bytes.tolist(), strict=True)]
        n_marks = np.maximum(sizes - 1, 0) // LANE
        marks = np.repeat(sizes.cumsum() - sizes - n_marks.cumsum() * LANE + n_marks * LANE, n_marks) + (np.arange(int(n_marks.sum())) + 1) * LANE
        return payload, at[marks] - at[marks - LANE], n_marks

    def unpack(self, raw: bytes, begin: np.ndarray, sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """The ids of texts whose bits begin at the bytes ``begin`` of ``raw``."""
        marks = np.maximum(sizes - 1, 0) // LANE
        n_lanes = marks + (sizes > 0)
        text = np.repeat(np.arange(len(sizes)), n_lanes)
        lane = np.arange(len(text)) - np.repeat(n_lanes.cumsum() - n_lanes, n_lanes)
        step = np.zeros(len(text), np.int64)
        step[lane > 0] = gaps
        run = step.cumsum()
        first = np.flatnonzero(lane == 0)
        at = run - np.repeat(run[first], n_lanes[sizes > 0]) + (begin[text] << 3)
        length = np.minimum(LANE, sizes[text] - lane * LANE)
        to = (sizes.cumsum() - sizes)[text] + lane * LANE
        out = np.zeros(int(sizes.sum()), np.uint32)
        data = np.frombuffer(raw + b"\0\0\0\0", np.uint8)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), LANES):
            self._lanes(data, at[order[i : i + LANES]], length[order[i : i + LANES]], to[order[i : i + LANES]], out)
        return out

    def _lanes(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Unpacks lanes, the longest first, side by side."""
        low, high = int(at.min()) >> 3, (int(at.max()) >> 3) + LANE * self.width // 8 + 8
        part = data[low:high].astype(np.uint32)
        part = np.concatenate([part, np.zeros(4, np.uint32)])
        window = part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]
        at = at - (low << 3)
        mask, shift = (1 << self.width) - 1, 32 - self.width
        alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
        for k, n in enumerate(alive.tolist()):
            here = at[:n]
            found = self.table[(window[here >> 3] >> (shift - (here & 7))) & mask]
            out[to[:n] + k] = found >> 5
            here += found & 31


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` ids together, unless one has more."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
