"""A vocabulary of word pieces with unigram scores, and the trie over whose prefixes best segmentations are shared."""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: A public vocabulary; any SentencePiece model with byte pieces will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Nodes that a trie holds before it starts afresh.
NODES = 250_000
#: Segments, and their ids, that an encoder keeps at hand before it starts afresh.
SEGMENTS = 400_000
KEPT_IDS = 4_000_000
#: Longer words get a trie of their own, which is dropped with the word.
LONG = 400
#: Segments of more characters than this are not segmented together with others.
TOGETHER = 40
#: Scores are multiples of this, so sums are exact in whatever order they are taken, and ties are ties.
GRAIN = 2.0**-20


class Steps:
    """The trie of the pieces as arrays: a table of steps (node, character) -> node, and each node's piece."""

    def __init__(self, scores: dict[str, tuple[float, int]]):
        child: dict[int, int] = {}
        found: list[tuple[float, int]] = [(0.0, -1)]
        for piece, hit in scores.items():
            node = 0
            for c in piece:
                step = node << 21 | ord(c)
                if (at := child.get(step)) is None:
                    at = child[step] = len(found)
                    found.append((0.0, -1))
                node = at
            found[node] = hit
        self.score = np.array([x for x, _ in found])
        self.piece = np.array([i for _, i in found], np.int32)
        self.shift = np.uint64(64 - max(4, (4 * len(child)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.key, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        steps, nodes = np.array(list(child), np.int64), np.array(list(child.values()), np.int64)
        at = self._place(steps)
        while len(steps):
            free = self.key[at] < 0
            first = np.zeros(len(steps), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.key[at[put]], self.to[at[put]] = steps[put], nodes[put]
            steps, nodes, at = steps[~put], nodes[~put], (at[~put] + 1) % size

    def _place(self, steps: np.ndarray) -> np.ndarray:
        return ((steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def go(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        steps = node << 21 | char
        at = self._place(steps)
        key = self.key[at]
        out = np.where(key == steps, self.to[at], -1)
        open_ = np.flatnonzero((key != steps) & (key >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.key)
            key = self.key[at[open_]]
            same = key == steps[open_]
            out[open_[same]] = self.to[at[open_[same]]]
            open_ = open_[~same & (key >= 0)]
        return out


@dataclass
class Vocabulary:
    """Pieces with a space where the file has its space mark, their ids and log-probabilities.

    Files of merges hold ranks, not probabilities: then the r-th piece has the share of rank r in Zipf's law,
    1 / (r + 2.7).  A character that is no piece costs ``fallback`` and is spelled with the pieces of its bytes.
    """

    scores: dict[str, tuple[float, int]]
    bytes_: list[int]
    fallback: float
    longest: int = 0
    tails: frozenset[str] = frozenset()
    alone: frozenset[str] = frozenset()
    splits: bool = True
    texts: dict[int, bytes] = field(default_factory=dict)
    steps: Steps | None = None

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores), default=1)
        self.tails = frozenset(p[i:] for p in self.scores for i in range(len(p)))
        used = frozenset("".join(self.scores))
        self.alone = frozenset(c for c in "\n\r\t" if c not in used)
        self.splits = not any(re.search("[^ ] ", p) for p in self.scores)
        self.texts = {i: p.encode() for p, (_, i) in self.scores.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes_)}
        self.steps = Steps(self.scores)

    def segments(self, text: str) -> list[str]:
        """Parts between which no piece lies: a piece has spaces at its start only."""
        if not self.splits:
            return [text]
        alone = re.escape("".join(sorted(self.alone)))
        return re.findall(rf" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +", text)


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    whole = sum(1 / (r + 2.7) for r in range(len(plain)))
    scores = {sp.id_to_piece(i).replace("▁", " "): (round(-math.log((r + 2.7) * whole) / GRAIN) * GRAIN, i) for r, i in enumerate(plain)}
    spelled = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
    return Vocabulary(scores, [spelled[f"<0x{b:02X}>"] for b in range(256)], min(s for s, _ in scores.values()) - 10)


class Trie:
    """Forward scores of a unigram model, once for every prefix that strings share.

    A node is a prefix: its best score and the number of tokens of its best segmentation.
    """

    def __init__(self, vocabulary: Vocabulary, nodes: int = NODES):
        self.v, self.most = vocabulary, nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node and character as one number
        self.best, self.count = array("d", [0.0]), array("i", [0])

    def full(self) -> bool:
        return len(self.best) > self.most

    def insert(self, s: str) -> list[int]:
        """The nodes on the way to ``s``, the root first."""
        child, best, scores, tails = self.child, self.best, self.v.scores, self.v.tails
        path, node = [0], 0
        for end in range(1, len(s) + 1):
            c = s[end - 1]
            step = node * 0x110000 + ord(c)
            at = child.get(step)
            if at is None:
                top, length, piece = best[node] + self.v.fallback, 1, -1
                if c in scores:
                    score, piece = scores[c]
                    top = best[node] + score
                for k in range(1 if c in tails else end, end):
                    part = s[end - k - 1 : end]
                    if part not in tails:
                        break
                    hit = scores.get(part)
                    if hit is not None and best[path[-k - 1]] + hit[0] >= top:
                        top, length, piece = best[path[-k - 1]] + hit[0], k + 1, hit[1]
                at = len(best)
                child[step] = at
                best.append(top)
                self.count.append(self.count[path[-length]] + (1 if piece >= 0 else len(c.encode("utf-8", "replace"))))
            path.append(at)
            node = at
        return path


class Encoder:
    """Best segmentations of segments, those that are met again kept at hand.

    Of equal segmentations it is the one whose last piece is longest, then the one before it, and so on.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # Ends of pieces; those that are pieces with score and id.
        self.ends: dict[str, tuple[float, int] | tuple[()]] = dict.fromkeys(vocabulary.tails, ()) | vocabulary.scores
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.score = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)
        self.wrong: set[int] = set()  # segments that their ids do not spell

    def places(self, segments: list[str]) -> np.ndarray:
        """Where each segment is in ``start`` and ``score``; what was found before may not be looked up any more."""
        coded = pa.array(segments, pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [s for s in words if s not in self.index]
        if len(self.index) + len(new) > SEGMENTS or len(self.ids) > KEPT_IDS:
            self.clear()
            new = words
        if new:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments one after another, and the number of each."""
        begin, sizes = self.start[places], self.start[places + 1] - self.start[places]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _add(self, new: list[str]) -> None:
        order = [s for s in new if len(s) <= TOGETHER]
        alone = [s for s in new if len(s) > TOGETHER] if len(order) < len(new) else []
        ids, sizes, scores, odd = self._together(order)
        if odd:
            alone += [order[k] for k in odd]
            for k in reversed(odd):
                del order[k]
        found = [self.best(s) for s in alone]
        base = len(self.score)
        self.index.update(zip(order + alone, range(base, base + len(order) + len(alone)), strict=True))
        self.ids = np.concatenate([self.ids, ids, *[np.array(x, np.int32) for x, _ in found]])
        ends = self.start[-1] + np.cumsum(np.r_[sizes, np.array([len(x) for x, _ in found], np.int64)])
        self.start = np.concatenate([self.start, ends])
        self.score = np.concatenate([self.score, scores, np.array([x for _, x in found])])
        texts, spans, order = self.v.texts, self.start[base:].tolist(), order + alone
        flat = [texts[i] for i in self.ids[spans[0] : spans[-1]].tolist()]
        if b"".join(flat) != "".join(order).encode("utf-8", "replace"):
            spelled = (b"".join(flat[i - spans[0] : j - spans[0]]) for i, j in zip(spans, spans[1:], strict=False))
            self.wrong |= {base + k for k, (s, t) in enumerate(zip(order, spelled, strict=True)) if t != s.encode("utf-8", "replace")}

    def _together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """ids, their numbers and scores of many segments at once; and the places of those with characters that are no
        piece, which are left out."""
        if not segments:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), []
        steps = self.v.steps
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        first = steps.go(np.zeros(len(chars), np.int64), chars)
        plain = np.ones(len(sizes), bool)
        plain[of[(first < 0) | (steps.piece[first] < 0)]] = False
        # A place for each character and one for the end, segment by segment.
        begin = ends - sizes + np.arange(len(sizes))
        within = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
        # All pieces that begin at each character: the steps through the trie, for all characters at once.
        at, node, length = np.flatnonzero(plain[of]), first[plain[of]], 1
        left = np.repeat(ends, sizes)
        hits: list[tuple[np.ndarray, int, np.ndarray]] = []
        while len(at):
            piece = steps.piece[node] >= 0
            hits.append((at[piece], length, node[piece]))
            more = at + length < left[at]
            at, node = at[more], node[more]
            node = steps.go(node, chars[at + length])
            at, node, length = at[node >= 0], node[node >= 0], length + 1
        best = np.full(len(chars) + len(sizes), -np.inf)
        best[begin] = 0.0
        back, by = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        starts = [np.concatenate([h[0] for h in hits])] if hits else [np.zeros(0, np.int64)]
        reach = np.concatenate([np.full(len(h[0]), h[1]) for h in hits]) if hits else np.zeros(0, np.int64)
        nodes = np.concatenate([h[2] for h in hits]) if hits else np.zeros(0, np.int64)
        rank = within[starts[0]] * 64 + np.minimum(reach, 63)
        order = np.argsort(rank.astype(np.int16), kind="stable")
        source = (starts[0] + of[starts[0]])[order]
        target, nodes, rank = source + reach[order], nodes[order], rank[order]
        gain = steps.score[nodes]
        # Pieces of one length that begin equally far from their segments' starts; a place is never met twice in one step.
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=True):
            now = best[source[i:j]] + gain[i:j]
            better = now > best[target[i:j]]
            to = target[i:j][better]
            best[to], back[to], by[to] = now[better], source[i:j][better], nodes[i:j][better]
        kept = np.flatnonzero(plain)
        place, own = begin[kept] + sizes[kept], np.arange(len(kept))
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        root = begin[kept]
        while len(place):
            found.append(steps.piece[by[place]])
            owners.append(own)
            place = back[place]
            open_ = place > root[own]
            place, own = place[open_], own[open_]
        owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, np.int64)
        ids = np.concatenate(found[::-1]) if found else np.zeros(0, np.int32)
        ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=len(kept)), best[begin[kept] + sizes[kept]], np.flatnonzero(~plain).tolist()

    def best(self, s: str) -> tuple[list[int], float]:
        look, fallback = self.ends.get, self.v.fallback
        scores, starts, pieces = [0.0], [0], [-1]
        for last, c in enumerate(s):
            hit = look(c)
            top, piece, start = scores[last] + (hit[0] if hit else fallback), hit[1] if hit else -1, last
            if hit is not None:
                for p in range(last - 1, -1, -1):
                    hit = look(s[p : last + 1])
                    if hit is None:
                        break
                    if hit and scores[p] + hit[0] >= top:
                        top, piece, start = scores[p] + hit[0], hit[1], p
            scores.append(top)
            starts.append(start)
            pieces.append(piece)
        out: list[int] = []
        end = len(s)
        while end:
            piece, start = pieces[end], starts[end]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.v.bytes_[b] for b in reversed(s[start].encode("utf-8", "replace")))
            end = start
        out.reverse()
        return out, scores[-1]


class Counts(dict):
    """pre-token (bytes, without its leading space) -> number of tokens, the terminal counts of a trie."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.trie = Trie(vocabulary)

    def __missing__(self, word: bytes) -> int:
        s = " " + word.decode("utf-8", "replace")
        if len(s) > LONG:
            own = Trie(self.trie.v)
            return own.count[own.insert(s)[-1]]
        if self.trie.full():
            self.trie.clear()
            self.clear()
        self[word] = n = self.trie.count[self.trie.insert(s)[-1]]
        return n
