"""How filters of texts interact: what each removes, in every order in which they can be applied.

Each document has a mask, one bit for each filter that it fails.  A table, computed once, holds for every mask and every
order the step that removes the document: with five filters 32 by 120 entries.  A task looks its masks up in that table
and accumulates removals by part, order and step, once for all documents and once for each label; the partial arrays of
the tasks are summed.

A document fails the last filter if its text is identical to that of any smaller id, wherever that is.  No row meets the
other rows of its text: documents are counted by (digest, part, mask, labels, id) and then by (digest, part, mask,
labels), with the smallest id and how many rows have it, so a text with a third of all rows is a few rows when the
smallest ids of one digest are compared.

Defined results: a null text is empty; a null language is the part ``''``; a row without id has no label, fails the last
filter never and is nobody's original; repeated rows count each, and rows of one id and one text are all originals; of
repeated labels of one id any 1 counts; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters on a text alone, by their letters; the last letter is that of copies.
ON_TEXT = "ABCD"
COPIES = "E"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_SYMBOL = re.compile(rb"[#$%&*|]")
_NO_CAPITALS = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_CONTINUED = bytes(range(0x80, 0xC0))
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes whose words are listed at once, and parts that a task holds at once.
BLOCK = 1_000_000
PARTS = 2_000


def orders(n: int) -> list[tuple[int, ...]]:
    return list(permutations(range(n)))


def first_failure(n: int) -> np.ndarray:
    """For each mask and order of ``n`` filters the step, from 0, that removes; ``n`` if none does."""
    masks, order = np.arange(1 << n)[:, None, None], np.array(orders(n))[None]
    fails = (masks >> order) & 1
    return np.where(fails.any(2), fails.argmax(2), n)


def blocks(raw: bytes) -> Iterator[bytes]:
    """``raw`` in pieces that end between words."""
    begin = 0
    while begin < len(raw):
        found = _WHITE.search(raw, begin + BLOCK)
        end = found.start() if found else len(raw)
        yield raw[begin:end]
        begin = end


def text_mask(raw: bytes) -> int:
    """Bits 0 to 3: under 200 words, under 50 of 100 words distinct, over 3 of 100 characters capitals, a symbol."""
    n, distinct = 0, set()
    for block in blocks(raw):
        words = block.split()
        n += len(words)
        distinct.update(words)
    points = len(raw.translate(None, _CONTINUED))
    capitals = len(raw.translate(None, _NO_CAPITALS))
    fails = (n < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, bool(_SYMBOL.search(raw)))
    return sum(1 << i for i, bad in enumerate(fails) if bad)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for x in batch.column(2).cast(pa.large_binary()):
            raw = x.as_py() or b""
            masks.append(text_mask(raw))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "sha"])


def masked(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask over all filters, good, toxic, n: counts of documents, a few rows for each distinct text."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_features, "id long, part string, mask int, sha binary")
    # Rows without id meet no label; they are dealt by their texts.
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("sha")))
    given = labels.select(F.col("doc_id").cast("string").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    given = given.filter("key IS NOT NULL").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    told = rows.withColumn("key", key).join(given, "key", "left").drop("key")
    told = told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    same = ["sha", "part", "mask", "good", "toxic"]
    ids = told.groupBy(*same, "id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    original = F.min("least.id").over(Window.partitionBy("sha"))
    texts = texts.withColumn("originals", F.col("nameless") + F.when(F.col("least.id") == original, F.col("least.n")).otherwise(0))
    bit = 1 << len(ON_TEXT)
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return texts.select("part", "good", "toxic", F.inline(split)).filter("n > 0")


def _accumulate(n: int):
    """Partial arrays over (order, step) for each part that a task meets."""
    table = first_failure(n)
    order = np.array(orders(n))
    k, masks = len(order), 1 << n
    cell = np.arange(k) * (n + 1) + table  # of each mask and order; the last step of an order: never removed
    fails = (np.arange(masks)[:, None, None] >> order[None]) & 1
    late = (fails & (np.arange(n) > table[..., None])).reshape(masks, k * n)
    names = ["part", "removed", "good_lost", "toxic_lost", "kept", "redundant", "unique_fails"]

    def arrays(count: np.ndarray) -> list[np.ndarray]:
        """count: documents by (label, mask), where label is all, good or toxic."""
        lost = [np.bincount(cell.ravel(), np.repeat(x, k), k * (n + 1)).reshape(k, n + 1).astype(np.int64) for x in count]
        kept = count[0].sum() - lost[0][:, :n].cumsum(1)
        alone = count[0][1 << order]
        return [*(x[:, :n].ravel() for x in lost), kept.ravel(), count[0] @ late, alone.ravel()]

    def told(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = zip(*(arrays(x) for x in counts.values()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(list(x), pa.list_(pa.int64())) for x in columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            good, toxic, mask, weight = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(1, 5))
            at = part.indices.to_numpy() * masks + mask
            found = [np.bincount(at, weight * w, len(part.dictionary) * masks).reshape(-1, masks) for w in (1, good, toxic)]
            for i, name in enumerate(part.dictionary.to_pylist()):
                counts[name] = counts.get(name, 0) + np.array([x[i] for x in found]).astype(np.int64)
            if len(counts) > PARTS:
                yield told(counts)
                counts = {}
        if counts:
            yield told(counts)

    return run


def letters(n: int) -> Column:
    """The orders by number, as strings of letters."""
    names = ON_TEXT + COPIES
    return F.array(*(F.lit("".join(names[i] for i in order)) for order in orders(n)))


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step.

    ``kept`` after the step, ``removed`` by it, ``redundant``: fail its filter but went before, ``unique_fails``: fail its
    filter only, ``good_lost`` and ``toxic_lost``: removed by it with that label, ``shapley``: removed by its filter over
    all orders together.
    """
    n = len(ON_TEXT + COPIES)
    sums = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    schema = "part string, " + ", ".join(f"{c} array<long>" for c in ("removed", "good_lost", "toxic_lost", "kept", "redundant", "unique_fails"))
    partial = masked(df, labels, id_col, text_col, part_col).mapInArrow(_accumulate(n), schema)
    cells = partial.select("part", F.posexplode(F.arrays_zip(*sums)).alias("cell", "x"))
    total = cells.groupBy("part", "cell").agg(*(F.sum(f"x.{c}").alias(c) for c in sums))
    order, step = F.floor(F.col("cell") / n).cast("int"), (F.col("cell") % n + 1).cast("int")
    named = total.select("part", F.element_at(letters(n), order + 1).alias("filter_order"), step.alias("step"), *sums)
    letter = F.expr("substring(filter_order, step, 1)")
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
