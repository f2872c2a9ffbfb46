"""Token ids of documents as compact binary blocks: canonical, length-limited Huffman codes of the ids' global counts.

``write`` encodes whole texts, counts ids over all of them, sorts documents by id across the cluster and packs each sorted
partition into a file of independent blocks.  A folder holds

* ``codes``: the code length of each id that occurs; the canonical codes follow from the lengths;
* ``files``: each file's number and how many ids stand before it;
* ``blocks``: per block its file, ids before it in that file, its documents (id, ids, bytes), the checkpoints as bits from
  one to the next, the packed bits, and their crc32.

Everything is Parquet, so it lives wherever Spark writes.  A block of ``BLOCK`` ids or a little more holds whole documents,
and is unpacked without any other.  What goes through the driver is a number for each id of the vocabulary and for each
file.

Defined results: a null or empty text has the end id only; documents without id come first; repeated rows are written
each; a text of any length is one document; an empty table gives empty files; other columns are not looked at.  Strings of
special tokens inside texts become these tokens, as the library does by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import segments
from trailmark.llm.huffman import Codec, code_lengths, parts
from trailmark.llm.store import Scratch

END = 2
#: Ids of a block, at least; ids that are packed at once, and unpacked at once.
BLOCK, PACKED, UNPACKED = 65_536, 65_536, 2_000_000


class Encoder:
    """Ids of texts, as bytes."""

    def __init__(self, tokenizer: segments.Bytes, end: int | None):
        self.tokenizer, self.ids = tokenizer, segments.Ragged(tokenizer.kind)
        self.end = b"" if end is None else np.array([end], tokenizer.kind).tobytes()
        self.words = segments.Words(lambda words, bare: self.ids.extend(*(tokenizer.bare if bare else tokenizer.spaced)(words)), self.ids.keep, bare=True)

    def of(self, texts: list[str]) -> list[bytes]:
        """``texts``: a group of :func:`segments.groups`."""
        whole = [i for i, t in enumerate(texts) if not self.tokenizer.cuts or any(x in t for x in self.tokenizer.special)]
        out = [b""] * len(texts)
        for i, ids in zip(whole, self.tokenizer.whole([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids.tobytes() + self.end
        cut = sorted(set(range(len(texts))).difference(whole))
        if len(cut) == 1:
            found = (self.ids.take(self.words.of([block], k == 0)[0])[0].tobytes() for k, block in enumerate(segments.blocks(texts[cut[0]])))
            out[cut[0]] = b"".join(found) + self.end
        elif cut:
            rows, n_words = self.words.of([texts[i] for i in cut])
            ids, sizes = self.ids.take(rows)
            raw, last = ids.tobytes(), 0
            ends = np.r_[0, sizes.cumsum()][n_words.cumsum()] * ids.itemsize
            for i, end in zip(cut, ends.tolist(), strict=True):
                out[i] = raw[last:end] + self.end
                last = end
        return out


@lru_cache(1)
def _encoder(model: str, end: int | None) -> Encoder:
    """That of this worker, whose tasks follow one another: the words it has met stay at hand."""
    return Encoder(segments.byte_tokenizer(model, True), end)


def _encode(model, end: int | None, n: int):
    """Documents with their ids, and after a task's documents a row with the counts of all their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = _encoder(model.value, end), np.zeros(n, np.int64)
        names, kind = ["id", "crc", "ids", "counts"], None
        for batch in batches:
            kind = batch.column(0).type
            for at, texts in segments.groups(batch.column(1)):
                ids = encoder.of(texts)
                counts += np.bincount(np.frombuffer(b"".join(ids), encoder.tokenizer.kind), minlength=n)
                rows = [batch.column(0).slice(at, len(ids)), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ids over the rows of a task."""
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts = np.frombuffer(raw, np.int64)
            total = counts if total is None else total + counts
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def _blocks(lengths, kind: str):
    """Sorted documents of a partition to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file, before = Codec(lengths.value), TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        bits: list[bytes] = []
        gaps: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal before, ids, sizes, bits, gaps
            documents = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(list(map(len, bits)), pa.int64())], ["id", "n", "bytes"])
            marks, payload = np.concatenate(gaps), b"".join(bits)
            row = [pa.array([x]) for x in (file, before)] + [
                pa.LargeListArray.from_arrays([0, len(documents)], documents).cast(pa.list_(documents.type)),
                pa.LargeListArray.from_arrays([0, len(marks)], pa.array(marks, pa.int32())).cast(pa.list_(pa.int32())),
                pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)]),
            ]
            before += sum(sizes)
            ids, sizes, bits, gaps = [], [], [], []
            return pa.RecordBatch.from_arrays(row, ["file", "begin", "documents", "marks", "bits", "crc"])

        for batch in batches:
            raw = batch.column(1)
            n = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in raw], np.int64) // np.dtype(kind).itemsize
            for a, b in parts(n, PACKED):
                packed, marks, _ = codec.pack(np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), kind), n[a:b])
                ids.append(batch.column(0).slice(a, b - a))
                sizes += n[a:b].tolist()
                bits += packed
                gaps.append(marks)
                if sum(sizes) >= BLOCK:
                    yield block()
        if sizes:
            yield block()

    return run


def write(df: DataFrame, path: str, tokenizer: str = segments.BYTE_MODEL, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``df`` and write its ids, in ascending order of ``id_col``, to the folder ``path``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "ids")
    text = segments.read(tokenizer).decode()
    model = spark.sparkContext.broadcast(text)
    known = segments.byte_tokenizer(text, True)
    kind, n = known.kind.str, max(len(known.bytes), (end or 0) + 1)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("crc", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    encoded = f"{scratch.path}/ids"
    rows.mapInArrow(_encode(model, end, n), schema).write.option("compression", "zstd").parquet(encoded)
    encoded = spark.read.schema(schema).parquet(encoded)

    counts = np.zeros(n, np.int64)
    for r in encoded.select("counts").filter("counts IS NOT NULL").mapInArrow(_summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")

    block = T.StructType([
        T.StructField("file", T.LongType()), T.StructField("begin", T.LongType()),
        T.StructField("documents", T.ArrayType(T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("bytes", T.LongType())]))),
        T.StructField("marks", T.ArrayType(T.IntegerType())), T.StructField("bits", T.BinaryType()), T.StructField("crc", T.LongType()),
    ])
    # Rows without id, or of one id, are dealt by what they hold.
    order = ["id", "crc", F.length("ids")]
    dealt = encoded.filter("counts IS NULL").drop("counts").repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")
    lengths = spark.sparkContext.broadcast(lengths)
    dealt.mapInArrow(_blocks(lengths, kind), block).write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.clear()

    totals = spark.read.schema(block).parquet(f"{path}/blocks").select("file", F.expr("aggregate(documents.n, 0L, (x, y) -> x + y)").alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    files, total = [], 0
    for r in sorted(totals.collect()):
        files.append((r["file"], total))
        total += r["n"]
    spark.createDataFrame(files, "file long, before long").coalesce(1).write.parquet(f"{path}/files")


def _decode(lengths):
    def told(codec: Codec, held: list[tuple[int, pa.StructScalar]], names: list[str]) -> Iterator[pa.RecordBatch]:
        for begin, documents, marks, bits, crc in held:
            if zlib.crc32(bits) != crc:
                raise ValueError("a block is damaged")
        documents = pa.concat_arrays([x[1] for x in held])
        n, n_bytes = documents.field(1).to_numpy(), documents.field(2).to_numpy()
        start = np.concatenate([x[0] + d.cumsum() - d for x in held for d in [x[1].field(1).to_numpy()]])
        ids = codec.unpack(b"".join(x[3] for x in held), n_bytes.cumsum() - n_bytes, n, np.concatenate([x[2] for x in held]))
        ends = np.r_[0, n.cumsum()] * 4
        if ends[-1] < 1 << 31:
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
        else:
            raw = ids.tobytes()
            binary = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([documents.field(0), pa.array(start), binary], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, size = Codec(lengths.value), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                begin, documents, marks, bits, crc = (batch.column(k)[i] for k in range(5))
                held.append((begin.as_py(), documents.values, marks.values.to_numpy(), bits.as_py(), crc.as_py()))
                size += int(documents.values.field(1).to_numpy().sum())
                if size >= UNPACKED:
                    yield from told(codec, held, ["id", "start", "ids"])
                    held, size = [], 0
        if held:
            yield from told(codec, held, ["id", "start", "ids"])

    return run


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a folder that ``write`` made: id, start (ids of all documents before it), and ids as little-endian unsigned 32-bit integers."""
    known = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in known), default=0) + 1, np.int64)
    for r in known:
        lengths[r["id"]] = r["bits"]
    lengths = spark.sparkContext.broadcast(lengths)
    blocks, files = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/files")
    id_type = blocks.schema["documents"].dataType.elementType["id"].dataType
    rows = blocks.join(F.broadcast(files), "file").select((F.col("before") + F.col("begin")).alias("begin"), "documents", "marks", "bits", "crc")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(_decode(lengths), schema).withColumnRenamed("id", id_col)
