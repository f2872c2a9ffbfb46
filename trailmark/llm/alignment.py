"""Alignment of the tokens of two tokenizers over the same text.

A dangling-suffix transducer reads both token sequences.  Its state is which side leads and the bytes by which it leads;
the side that lags gives the next token.  Either the token ends within the dangling bytes, and they get shorter, or it
reaches beyond them, and now it leads by the rest.  Each step links the token with the leading one, which it overlaps; with
nothing dangling, a group of tokens that spell the same bytes is closed.  Steps are memoised by state and token, and what
comes out for a word by the word.

Corpus-wide, each pair of linked ids is counted.  The counts of at most ``PAIRS`` distinct pairs are sent to the tasks as
sorted arrays; more meet the documents' pairs in a join in which frequent pairs are salted.

Defined results: texts that are null or empty, or whose tokens do not spell the text (as when a tokenizer replaces
characters), have no tokens: all figures are 0 and the groups empty; repeated rows are counted each; of equal counts all
are the highest; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import segments
from trailmark.llm.links import spread_join
from trailmark.llm.store import Scratch

#: Distinct pairs of ids whose counts are sent to every task (16 bytes each); pairs and steps that a task gathers.
PAIRS = 4_000_000
GATHERED = 2_000_000
STEPS = 1_000_000
#: A pair is the first id times this, and the second.
SECOND = 1 << 32


class Transducer:
    """States are numbered; state 0 has nothing dangling."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = a, b
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # in state 0 the first side gives the next token
        self.number = {(1, b""): 0}
        self.steps: dict[tuple[int, int], int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side's ``token``; -1 if its bytes are not those that dangle."""
        if (to := self.steps.get((state, token))) is not None:
            return to
        lead, dangling = self.states[state]
        new = self.bytes[1 - lead][token]
        if dangling.startswith(new):
            after = (lead, dangling[len(new) :])
        else:
            after = (1 - lead, new[len(dangling) :]) if new.startswith(dangling) else None
        if after is None or not new:
            to = -1
        else:
            after = after if after[1] else self.states[0]
            to = self.number.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
        self.steps[state, token] = to
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]] | None:
        """Groups of ids of both sides, and a pair for each link; None if the two spell different bytes."""
        if len(self.steps) > STEPS:
            self.forget()
        groups, links, state = [], [], 0
        left, right = iter(a), iter(b)
        here: tuple[list[int], list[int]] = [], []
        lead, leader = 1, -1
        while True:
            token = next(right if lead == 0 else left, -1)
            if token < 0:
                return (groups, links) if state == 0 and next(right, -1) < 0 else None
            here[1 - lead].append(token)
            if state:
                links.append(leader * SECOND + token if lead == 0 else token * SECOND + leader)
            state = self.step(state, token)
            if state < 0:
                return None
            if not state:
                groups.append(here)
                here = [], []
                lead = 1
            elif self.states[state][0] != lead:
                lead, leader = self.states[state][0], token


class Aligner:
    """Words and what their alignment gives: groups as text, links as pairs, numbers of tokens."""

    def __init__(self, a: segments.Bytes, b: segments.Pieces):
        self.a, self.b = a, b
        self.transducer = Transducer(a.bytes, b.bytes)
        self.links, self.figures = segments.Ragged(np.int64), segments.Ragged(np.int64)
        self.groups: list[bytes | None] = []
        self.words = segments.Words(lambda words, bare: self.learn(words, _each(self.a.spaced(words)), _each(self.b.spaced(words))), self.keep, bare=False)

    def learn(self, words: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        links, figures = [], []
        for word, x, y in zip(words, a, b, strict=True):
            found = self.transducer.align(x, y) if b"".join(map(self.a.bytes.__getitem__, x)) == b" " + word.encode() else None
            self.groups.append(None if found is None else b";".join([(",".join(map(str, p)) + "|" + ",".join(map(str, q))).encode() for p, q in found[0]]))
            links.append(np.array(found[1] if found else [], np.int64).tobytes())
            figures.append(np.array([len(x), len(y), len(found[0])] if found else [0, 0, 0], np.int64).tobytes())
        self.links.add(links)
        self.figures.add(figures)

    def keep(self, rows: np.ndarray) -> None:
        self.links.keep(rows)
        self.figures.keep(rows)
        self.groups = [self.groups[i] for i in rows.tolist()]

    def texts(self, texts: list[str]) -> Iterator[tuple[list[int], bytes | str, np.ndarray, np.ndarray]]:
        """Of each text of a group: numbers of tokens, groups and links; digest of the groups; its pairs and how often it has each.

        A text of several blocks gives the digest of all of them."""
        if len(texts) == 1 and len(texts[0]) > segments.BLOCK and self.a.cuts and self.b.cuts:
            yield self._long(texts[0])
            return
        if self.a.cuts and self.b.cuts:
            rows, sizes = self.words.of(texts)
        else:
            rows, sizes = np.arange(len(self.groups), len(self.groups) + len(texts)), np.ones(len(texts), np.int64)
            self.learn(texts, [x.tolist() for x in self.a.whole([f" {t}" for t in texts])], [x.tolist() for x in self.b.whole(texts)])
        figures, links = self.figures.take(rows)[0].reshape(-1, 3), self.links.take(rows)
        ends, link_ends = sizes.cumsum(), links[1].cumsum()
        for text, begin, end in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
            names = list(map(self.groups.__getitem__, rows[begin:end].tolist()))
            if not text or None in names:
                yield [0, 0, 0, 0], "", *_NONE
                continue
            found = links[0][link_ends[begin] - links[1][begin] : link_ends[end - 1]]
            yield [*figures[begin:end].sum(0).tolist(), len(found)], hashlib.sha256(b";".join(names)).hexdigest(), *np.unique(found, return_counts=True)
        if not (self.a.cuts and self.b.cuts):
            self.keep(np.arange(0))

    def _long(self, text: str) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        digest, total, pairs, times = hashlib.sha256(), np.zeros(4, np.int64), *_NONE
        for k, block in enumerate(segments.blocks(text)):
            rows, _ = self.words.of([block], k == 0)
            names = list(map(self.groups.__getitem__, rows.tolist()))
            if None in names:
                return [0, 0, 0, 0], "", *_NONE
            links = self.links.take(rows)[0]
            digest.update((b";" if k else b"") + b";".join(names))
            total += [*self.figures.take(rows)[0].reshape(-1, 3).sum(0), len(links)]
            pairs, times = summed(np.concatenate([pairs, links]), np.concatenate([times, np.ones(len(links), np.int64)]))
        return total.tolist(), digest.hexdigest(), pairs, times


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _each(found: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    ids, ends = found[0].tolist(), found[1].cumsum().tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of ``n`` for each."""
    if not len(keys):
        return _NONE
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


@lru_cache(1)
def _aligner(a: str, b: bytes) -> Aligner:
    """That of this worker, whose tasks follow one another: the words it has met stay at hand."""
    return Aligner(segments.byte_tokenizer(a, False), segments.piece_tokenizer(b))


def _summaries(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*models.value)
        for batch in batches:
            for at, texts in segments.groups(batch.column(1)):
                figures, digests, pairs, times = zip(*aligner.texts(texts), strict=True)
                numbers = zip(*figures, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), _lists(pairs), _lists(times)],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return run


def _lists(rows) -> pa.Array:
    """Arrays of numbers as bytes: small differences take little room in a file."""
    return pa.array([np.diff(x, prepend=0).astype("<i8").tobytes() for x in rows], pa.binary())


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    raw = [x or b"" for x in column.to_pylist()]
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), "<i8").cumsum()
    before = np.r_[0, flat][sizes.cumsum() - sizes]
    return flat - np.repeat(before, sizes), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, n = _NONE
    for batch in batches:
        found = _numbers(batch.column(0))[0], _numbers(batch.column(1))[0]
        pairs, n = summed(np.concatenate([pairs, found[0]]), np.concatenate([n, found[1]]))
        if len(pairs) > GATHERED:
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
            pairs, n = _NONE
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


def _rated(table):
    """n_best and count_sum of documents, from the counts of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = table.value
        for batch in batches:
            pairs, sizes = _numbers(batch.column(6))
            times = _numbers(batch.column(7))[0]
            at = known.searchsorted(pairs)
            ends = sizes.cumsum()
            sums = [np.diff(np.r_[0, x.cumsum()][np.r_[0, ends]]) for x in (times * best[at], times * counts[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *map(pa.array, sums)], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct pair of a document."""
    for batch in batches:
        pairs, sizes = _numbers(batch.column(1))
        uid = np.repeat(batch.column(0).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(pairs), pa.array(_numbers(batch.column(2))[0])], ["uid", "pair", "times"])


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _models(df: DataFrame, a: str, b: str):
    return df.sparkSession.sparkContext.broadcast((segments.read(a).decode(), segments.read(b)))


def pair_counts(summaries: DataFrame) -> DataFrame:
    """pair, n, best: links of each pair of ids in all texts, and whether no pair with its second id has more."""
    counts = summaries.select("pairs", "times").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair") % SECOND
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counts.withColumn("second", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(df: DataFrame, a: str = segments.BYTE_MODEL, b: str = segments.PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", at_once: int = PAIRS) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is its second id's most frequent one; count_sum: the links' corpus-wide counts together.
    """
    scratch = Scratch(df.sparkSession, "alignment")
    rows = _texts(df, id_col, text_col)
    figures = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    told = [rows.schema["id"], *figures, T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType([*told, T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])
    path = f"{scratch.path}/texts"
    rows.mapInArrow(_summaries(_models(df, a, b)), schema).write.option("compression", "zstd").parquet(path)
    texts = df.sparkSession.read.schema(schema).parquet(path)
    counts = scratch.save(pair_counts(texts), "counts")
    out = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= at_once:
        found = counts.select("pair", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("pair")
        table = df.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "n", "best")))
        sums = [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]
        return texts.mapInArrow(_rated(table), T.StructType([*told, *sums])).withColumnRenamed("id", id_col).select(out)
    texts = scratch.save(texts.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    spread = scratch.save(texts.select("uid", "pairs", "times").mapInArrow(_spread, "uid long, pair long, times long"), "spread")
    rated = spread_join(spread, counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return texts.join(rated, "uid", "left").fillna(0, ["n_best", "count_sum"]).withColumnRenamed("id", id_col).select(out)


def _groups(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = segments.byte_tokenizer(models.value[0], False), segments.piece_tokenizer(models.value[1])
        transducer = Transducer(a.bytes, b.bytes)
        for batch in batches:
            ids, rows = [], {"a_ids": [], "b_ids": [], "begin": [], "end": []}
            for i, text in ((at + i, t) for at, texts in segments.groups(batch.column(1)) for i, t in enumerate(texts)):
                x = a.whole([f" {text}"])[0].tolist() if text else []
                same = b"".join(map(a.bytes.__getitem__, x)) == b" " + text.encode()
                found = transducer.align(x, b.whole([text])[0].tolist()) if text and same else None
                begin = 0
                for p, q in found[0] if found else []:
                    end = begin + sum(len(a.bytes[t]) for t in p)
                    ids.append(i)
                    for name, value in zip(rows, (p, q, begin, end), strict=True):
                        rows[name].append(value)
                    begin = end
            lists = [pa.array(rows[c], pa.list_(pa.int32())) for c in ("a_ids", "b_ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *lists, *(pa.array(rows[c], pa.int64()) for c in ("begin", "end"))], ["id", *rows])

    return run


def groups(df: DataFrame, a: str = segments.BYTE_MODEL, b: str = segments.PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each group: id, a_ids, b_ids, and the bytes begin to end of a space and the text that both spell."""
    rows = _texts(df, id_col, text_col)
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "b_ids")]
    schema = T.StructType([rows.schema["id"], *lists, T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return rows.mapInArrow(_groups(_models(df, a, b)), schema).withColumnRenamed("id", id_col)
