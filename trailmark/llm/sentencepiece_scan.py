"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus parallel scan.

A text is encoded as its best segmentation under a unigram vocabulary, with a space put in front; characters that are no
piece are spelled in bytes, so decoding gives back the text exactly.  Of equal segmentations it is the one whose last
piece is longest, then the one before it, and so on; scores are rounded so that sums are exact.

A text of more than ``GIANT`` characters is cut into chunks of ``CHUNK``.  The state at a cut is how far the piece that
lies across it reaches into the next chunk.  Each chunk yields a matrix of best scores from every state at its start
to every state at its end; matrices are combined in the (max, +) algebra, up to ``FAN`` at a time and level by level.
Going down again gives every chunk the best scores of the states at its start, with which it tells, for each state at its end,
from which one the best segmentation comes; following these from the text's end settles all states, and then every
chunk is traced back on its own.  The ids are those of a text that is not cut.  No task sees more than ``FAN`` matrices
of a text at once, or of any text more than a few whole numbers a chunk.

Defined results: a null text has null ids; an empty text has no ids; repeated rows get equal ids, each its own row; an
empty table gives an empty result; of input columns named n_pieces, score or ids (decoding: decoded) the result has the
new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.pieces import MODEL, Encoder, Vocabulary, load
from trailmark.llm.store import Scratch

GIANT = 32_768
CHUNK = 8_192
FAN = 32
#: Chunks whose vectors (a number for each character of the longest piece) are sent to every task, at most.
BROADCAST = 100_000
NEW = [T.StructField("n_pieces", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]


def encode_text(text: str, encoder: Encoder) -> tuple[list[int], float]:
    if not text:
        return [], 0.0
    places = encoder.places(encoder.v.segments(" " + text))
    return encoder.gathered(places)[0].tolist(), float(encoder.score[places].sum())


def _lists(ids: np.ndarray, sizes: np.ndarray, null: list[bool] | None = None) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array(null) if null else None)


def spelled(ids: list[int], texts: dict[int, bytes]) -> bytes:
    """The bytes of the ids, without the space that encoding puts in front."""
    return b"".join([texts.get(i, b"") for i in ids]).removeprefix(b" ")


def _encode(vocabulary, at: int, keep: list[int], check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = batch.column(at).to_pylist()
                parts = [encoder.v.segments(" " + x) if x else [] for x in texts]
                places = encoder.places(list(chain.from_iterable(parts)))
                ids, sizes = encoder.gathered(places)
                ends = np.r_[0, np.cumsum([len(x) for x in parts])]
                many, total = np.r_[0, np.cumsum(sizes)][ends], np.r_[0.0, np.cumsum(encoder.score[places])][ends]
                null = [x is None for x in texts]
                columns = [pa.array(np.diff(many), pa.int64(), mask=np.array(null)), pa.array(np.diff(total), pa.float64(), mask=np.array(null)), _lists(ids, np.diff(many), null)]
                names = [*(batch.schema.names[k] for k in keep), "n_pieces", "score", "ids"]
                if check:
                    # Each segment's ids were spelled when it was first met; the segments must make up the text.
                    bad = np.isin(places, list(encoder.wrong)) if encoder.wrong else np.zeros(len(places), bool)
                    same = [not x or ("".join(p) == " " + x and not bad[i:j].any()) for x, p, i, j in zip(texts, parts, ends, ends[1:], strict=False)]
                    columns.append(pa.array(same, pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names)

    return run


class Chunk:
    """A chunk of a text and what follows it as far as a piece may reach: ``text`` has ``own`` characters of its own."""

    def __init__(self, text: str, own: int, encoder: Encoder):
        self.text, self.own, self.encoder, self.v = text, own, encoder, encoder.v
        n = self.v.longest
        # No piece lies across a mark, so all segmentations meet there.
        marks = [p for p in range(n, own) if self.v.splits and text[p] == " " and text[p - 1] != " "]
        self.first, self.last = (marks[0], marks[-1]) if marks else (None, None)

    def _walk(self, start: int, stop: int, begin: dict[int, float]) -> tuple[list[float], list[tuple[int, int]]]:
        """Best scores of the places from ``start`` to stop + longest - 1, reached by pieces that begin before ``stop``,
        with the length and id of the last piece: the longest of equal ones, 0 for a score in ``begin``."""
        text, scores, n = self.text, self.v.scores, self.v.longest
        best = [-np.inf] * (max(stop, start) - start + n)
        back = [(0, 0)] * len(best)
        for p, score in begin.items():
            best[p - start] = score
        for p in range(start, stop):
            now = best[p - start]
            if now == -np.inf:
                continue
            for k in range(1, min(n, len(text) - p) + 1):
                hit = scores.get(text[p : p + k]) or ((self.v.fallback, -1) if k == 1 else None)
                if hit and now + hit[0] > best[p - start + k]:
                    best[p - start + k] = now + hit[0]
                    back[p - start + k] = (k, hit[1])
        return best, back

    def _middle(self) -> np.ndarray:
        return self.encoder.places(self.v.segments(self.text[self.first : self.last]))

    def matrix(self) -> np.ndarray:
        n = self.v.longest
        m = np.full((n, n), -np.inf)
        if self.first is None:
            for i in range(min(n, self.own + 1)):
                m[i] = self._walk(i, self.own, {i: 0.0})[0][max(0, self.own - i) :][:n]
            return m
        head = np.array([self._walk(i, self.first, {i: 0.0})[0][self.first - i] for i in range(n)])
        tail = np.array(self._walk(self.last, self.own, {self.last: 0.0})[0][self.own - self.last :][:n])
        places = self._middle()
        return head[:, None] + self.encoder.score[places].sum() + tail[None, :]

    def _trace(self, back: list[tuple[int, int]], start: int, end: int) -> tuple[list[int], int]:
        """The pieces up to ``end``, and the place where they begin."""
        ids: list[int] = []
        p = end
        while back[p - start][0]:
            k, piece = back[p - start]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.v.bytes_[b] for b in reversed(self.text[p - 1].encode("utf-8", "replace")))
            p -= k
        return ids[::-1], p

    def _head(self, f: np.ndarray) -> list[tuple[int, int]]:
        """From the best scores f of the states at its start, the last pieces up to the first mark or the end."""
        return self._walk(0, self.own if self.first is None else self.first, {i: x for i, x in enumerate(f.tolist()) if x > -np.inf})[1]

    def origins(self, f: np.ndarray) -> list[int]:
        """For every state at its end, the state at its start that the best segmentation comes from."""
        back, n = self._head(f), self.v.longest
        if self.first is None:
            return [self._trace(back, 0, self.own + j)[1] for j in range(n)]
        return [self._trace(back, 0, self.first)[1]] * n

    def ids(self, f: np.ndarray, j: int) -> np.ndarray:
        """The pieces that begin in this chunk on the best segmentation to state j."""
        back = self._head(f)
        if self.first is None:
            return np.array(self._trace(back, 0, self.own + j)[0], np.int32)
        tail = self._trace(self._walk(self.last, self.own, {self.last: 0.0})[1], self.last, self.own + j)[0]
        return np.concatenate([np.array(self._trace(back, 0, self.first)[0], np.int32), self.encoder.gathered(self._middle())[0], np.array(tail, np.int32)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def _matrices(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            own, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [Chunk(t, k, encoder).matrix().tobytes() for k, t in zip(own, text, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["rid", "k", "m"])

    return run


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    out = None
    for m in pdf.sort_values("k")["m"]:
        out = _square(m) if out is None else times(out, _square(m))
    return pd.DataFrame({"rid": [pdf["rid"].iloc[0]], "k": [pdf["k"].iloc[0] // FAN], "m": [out.tobytes()]})


def _square(m: bytes) -> np.ndarray:
    n = int((len(m) // 8) ** 0.5)
    return np.frombuffer(m).reshape(n, n)


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the best scores of the states at the start of a block to those at the start of each of its parts."""
    pdf = pdf.sort_values("k")
    forward = [np.frombuffer(pdf["f"].iloc[0])]
    for m in pdf["m"].iloc[:-1]:
        forward.append((forward[-1][:, None] + _square(m)).max(0))
    return pd.DataFrame({"rid": pdf["rid"], "k": pdf["k"], "f": [f.tobytes() for f in forward]})


def _cut(chunk: int, longest: int):
    """From (rid, text): rid, k, own, text of the chunks, each with what a piece may reach beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = " " + text.as_py()
                for first in range(0, len(text), 64 * chunk):  # so many chunks at a time
                    at = range(first, min(first + 64 * chunk, len(text)), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rid] * len(at), pa.int64()), pa.array([p // chunk for p in at], pa.int64()), pa.array([min(chunk, len(text) - p) for p in at], pa.int32()), pa.array([text[p : p + chunk + longest] for p in at], pa.string())],
                        ["rid", "k", "own", "text"],
                    )

    return run


def _origins(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            own, text, f = (batch.column(c).to_pylist() for c in range(2, 5))
            found = [Chunk(t, k, encoder).origins(np.frombuffer(x)) for k, t, x in zip(own, text, f, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(x) for x in found], pa.binary())], ["rid", "k", "t"])

    return run


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state at the end of each chunk of a text."""
    pdf = pdf.sort_values("k", ascending=False)
    j, out = 0, []
    for t in pdf["t"]:
        out.append(j)
        j = t[j]
    return pd.DataFrame({"rid": pdf["rid"], "k": pdf["k"], "j": out})


def _traced(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            own, text, f, j = (batch.column(c).to_pylist() for c in range(2, 6))
            ids = []
            for o, t, x, b in zip(own, text, f, j, strict=True):
                ids.append(Chunk(t, o, encoder).ids(np.frombuffer(x), b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], np.int64))], ["rid", "k", "ids"])

    return run


def _few(chunks: DataFrame, n: int) -> DataFrame:
    """A row of a vector or less for each of ``n`` chunks, sent to every task if these are few; else it meets the texts in a shuffle."""
    return F.broadcast(chunks) if n <= BROADCAST else chunks


def scan(giants: DataFrame, vocabulary, longest: int, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """From (rid, text) of non-empty texts: rid, n_pieces, score, ids."""
    cut = giants.select("rid", "text").mapInArrow(_cut(chunk, longest), "rid long, k long, own int, text string")
    # A last chunk shorter than a piece could be jumped over by a state; it is part of the look-ahead of the one before, and its matrix allows that.
    parts = scratch.save(cut.repartition("rid", "k"), "chunks")
    levels = [scratch.save(parts.mapInArrow(_matrices(vocabulary), "rid long, k long, m binary"), "matrices")]
    while not levels[-1].filter("k > 0").isEmpty():
        up = levels[-1].groupBy("rid", F.floor(F.col("k") / FAN).alias("block")).applyInPandas(_combine, "rid long, k long, m binary")
        levels.append(scratch.save(up, "matrices"))
    start = np.full(longest, -np.inf)
    start[0] = 0.0
    forward = levels[-1].select("rid", "k", F.lit(bytearray(start.tobytes())).alias("f"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("block", F.floor(F.col("k") / FAN)).join(forward.withColumnRenamed("k", "block"), ["rid", "block"])
        forward = scratch.save(below.groupBy("rid", "block").applyInPandas(_spread, "rid long, k long, f binary"), "forward")
    total = levels[-1].select("rid", "m").mapInArrow(_totals, "rid long, score double")
    n = forward.count()
    ready = scratch.save(parts.join(_few(forward, n), ["rid", "k"]).select("rid", "k", "own", "text", "f"), "ready")
    scratch.drop(parts)
    states = ready.mapInArrow(_origins(vocabulary), "rid long, k long, t binary").groupBy("rid").applyInPandas(_states, "rid long, k long, j int")
    traced = ready.join(_few(states, n), ["rid", "k"]).select("rid", "k", "own", "text", "f", "j").mapInArrow(_traced(vocabulary), "rid long, k long, ids array<int>")
    joined = traced.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x"))  # one text's ids: one value of the result
    ids = F.flatten(F.col("x.ids"))
    return joined.join(total, "rid").select("rid", F.size(ids).cast("long").alias("n_pieces"), "score", ids.alias("ids"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(_square(m)[0, 0]) for m in batch.column(1).to_pylist()], pa.float64())], ["rid", "score"])


def encode(
    df: DataFrame, text_col: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, keep: list[str] | None = None, check: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """The columns of ``df``, or those in ``keep``, with n_pieces, score (natural log-probability) and ids.

    With ``check`` also round_trip: whether decoding the ids gives back the text.
    """
    found: Vocabulary = load(model)
    vocabulary = df.sparkSession.sparkContext.broadcast(found)
    new = [*NEW, T.StructField("round_trip", T.BooleanType())] if check else NEW
    keep = [c for c in keep or df.columns if c in df.columns and c not in [f.name for f in new]]
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col], F.lit(None).alias("none")).alias("row"))
    large = F.coalesce(F.length("text") > giant, F.lit(False))
    out = rows.filter(~large).mapInArrow(_encode(vocabulary, 0, [0, 1], check), T.StructType([*rows.schema.fields, *new]))
    giants = rows.filter(large)
    if not giants.isEmpty():
        scratch = scratch or Scratch(df.sparkSession, "pieces")
        giants = scratch.save(giants.withColumn("rid", F.monotonically_increasing_id()), "giants")
        done = giants.join(scan(giants, vocabulary, found.longest, scratch, chunk), "rid")
        if check:
            done = decode(done.select("text", "row", *[f.name for f in NEW]), model=model).withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text")))
        out = out.unionByName(done.select("text", "row", *[f.name for f in new]))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in keep], *[f.name for f in new])


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns of ``df`` with ``decoded``, the text that the ids spell; unknown ids spell nothing."""
    vocabulary = df.sparkSession.sparkContext.broadcast(load(model))
    df = df.drop("decoded")
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = vocabulary.value.texts
        for whole in batches:
            for start in range(0, whole.num_rows, 250):
                batch = whole.slice(start, 250)
                out = []
                for x in batch.column(at):
                    if not x.is_valid:
                        out.append(None)
                        continue
                    out.append(spelled(x.as_py(), texts).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))
