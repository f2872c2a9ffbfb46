"""Similarity join on the Jaccard similarity of word n-gram sets: size-banded tiles with bitmap signatures.

Documents with one set form one class.  Sizes are cut into bands (a band ends at 1.5 times its start).  If two sets have
a Jaccard similarity of at least t, they differ in at most k = (1 - t) / (1 + t) * (a + b) elements, so of k + 2 blocks
into which hashing deals the elements, two blocks at least are alike in both.  A tile holds the classes that have one
block alike under the scheme of a band; a set belongs to its own band's scheme, and to the next one's if a similar set
may lie there.  An eighth more blocks than needed make it rare that a set fills no more blocks than a similar one may
change: only for such sets are empty blocks keys, since otherwise a full block is alike in both.

In the tiles, ``links.groups`` finds what is linked.  A pair is compared first by bitmaps of hashed elements, whose
differing bits bound the overlap from above, and then, if the bound allows a link, by intersecting the sorted arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer words than n has its whole sequence as one
element.  Elements, and sets as wholes, are told apart by 64-bit hashes.

Defined results: a null text or one without words has no elements and stays alone; repeated rows are copies of each
other; a null id gets the smallest id of its group, null if it has none; an empty table gives an empty result; extra
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import links
from trailmark.llm.sets import bitmap, differing
from trailmark.llm.shingles import HELD, as_long, mixed, windows, word_hashes
from trailmark.llm.store import Scratch

FIRST, STEP = 10, 1.5
ITEM = "c long, n long, bits binary, e binary"


def bands(most: int) -> list[int]:
    """The least sizes of the bands, up to one beyond ``most``."""
    starts = [1, FIRST]
    while starts[-1] <= most:
        starts.append(math.ceil(starts[-1] * STEP))
    return starts


def element_set(text: bytes | None, n: int) -> np.ndarray:
    return np.unique(windows(word_hashes((text or b"").lower())[1], n))


def class_of(elements: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(elements.tobytes(), seed=len(elements))
    return h - 2**64 if h >= 2**63 else h


def tile_keys(elements: np.ndarray, threshold: Fraction, starts: list[int]) -> np.ndarray:
    size = len(elements)
    while starts[-1] <= math.floor(size / threshold):
        starts.append(math.ceil(starts[-1] * STEP))
    out = []
    own = next(i for i, s in enumerate(starts) if s > size) - 1
    last = next(i for i, s in enumerate(starts) if s > math.floor(size / threshold)) - 1
    content = mixed(elements ^ np.uint64(0x9E3779B97F4A7C15))
    for band in range(own, last + 1):
        top = starts[band + 1] - 1
        k = differing(threshold, top, top)
        if k < 1:
            continue  # sets of this size are similar only if equal
        blocks = k + k // 8 + 2
        at = ((elements >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # elements are sorted, so blocks are runs
        starts_at = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        which = at[starts_at]
        sums = np.add.reduceat(content, starts_at)
        salt = np.uint64((band * 0x9E3779B9 + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
        out.append(mixed(mixed(sums + which * np.uint64(0x165667B19E3779F9)) ^ salt))
        if len(which) <= differing(threshold, size, min(top, math.floor(size / threshold))):
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), which)
            out.append(mixed(mixed(empty + np.uint64(1)) ^ salt ^ np.uint64(0xA0761D6478BD642F)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    return (element_set(x.as_py(), n) for x in column.cast(pa.large_binary()))


def sets(n: int):
    """From (id, fp, text): id, fp, n (the size of the set) and c (its class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(e), class_of(e) if len(e) else None) for e in _sets(batch.column(2), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["id", "fp", "n", "c"])

    return run


def keys(n: int, threshold: Fraction):
    """From (text): (key, c) of every set, once for the copies that a task has met lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, met = bands(1000), set()
        for batch in batches:
            held: list[np.ndarray] = []
            classes: list[int] = []
            size = 0

            def settle() -> pa.RecordBatch:
                of = np.repeat(np.array(classes, np.int64), [len(k) for k in held])
                return pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(held))), pa.array(of)], ["key", "c"])

            for e in _sets(batch.column(0), n):
                if not len(e) or (c := class_of(e)) in met:
                    continue
                if len(met) >= HELD:
                    met.clear()
                met.add(c)
                held.append(tile_keys(e, threshold, starts))
                classes.append(c)
                size += len(held[-1])
                if size > 200_000:
                    yield settle()
                    held, classes, size = [], [], 0
            if held:
                yield settle()

    return run


def arrays(n: int):
    """From (c, text) the rows whose text is of class c, once for each: c, n, bits, e (the sorted elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                found = []
                for c, e in zip(batch.column(0).to_pylist(), _sets(batch.column(1), n), strict=True):
                    if c not in met and len(e) and class_of(e) == c:
                        met.add(c)
                        found.append((c, len(e), bitmap(e).tobytes(), e.tobytes()))
                c, sizes, maps, elements = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(elements, pa.binary())], ["c", "n", "bits", "e"])

    return run


def classes(df: DataFrame, id_col: str, text_col: str, n: int, threshold: Fraction, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, fp, n, c) of every row, and (node, label) of every class that is linked with another class; both saved.

    fp is a hash of the text.  The texts are read once for the classes and once for the keys, which go straight into the
    shuffle that brings equal ones together; only those of two classes or more are written.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    members = scratch.save(rows.mapInArrow(sets(n), f"id {dict(rows.dtypes)['id']}, fp long, n long, c long"), "members")
    tiles = scratch.save(links.shared_keys(rows.select("text").mapInArrow(keys(n, threshold), "key long, c long")), "tiles")
    wanted = tiles.select("c").distinct().join(members.filter("c is not null").groupBy("c").agg(F.min("id").alias("first")), "c")
    wanted = scratch.save(wanted, "wanted")
    texts = rows.join(wanted.filter("first is not null").hint("shuffle_hash"), F.col("id") == F.col("first")).select("c", "text")
    items = texts.mapInArrow(arrays(n), ITEM)
    # Classes that no row with an id has are found among the rows without one.
    nameless = wanted.filter("first is null").select("c")
    if not nameless.isEmpty():
        own = rows.filter("id is null").select("fp", "text").join(members.filter("id is null").groupBy("c").agg(F.min("fp").alias("fp")).join(nameless, "c"), "fp")
        items = items.unionByName(own.select("c", "text").mapInArrow(arrays(n), ITEM).dropDuplicates(["c"]))
    return members, links.groups(tiles, scratch.save(items, "items"), threshold, scratch)


def named(df: DataFrame, id_col: str, text_col: str, n: int, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """id, fp, n, component of every row."""
    members, labels = classes(df, id_col, text_col, n, threshold, scratch)
    first = members.filter("c is not null").groupBy("c").agg(F.min("id").alias("first"))
    by = scratch.save(first.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").select("c", "first", F.coalesce("label", "c").alias("label")), "firsts")
    least = by.groupBy("label").agg(F.min("first").alias("component"))
    by = scratch.save(links.spread_join(by, least, "label").select("c", "component"), "components")
    found = links.spread_join(members, by, "c", "left")
    return found.select("id", "fp", "n", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: Fraction = Fraction(9, 10), scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id."""
    found = named(df, id_col, text_col, n, threshold, scratch or Scratch(df.sparkSession, "ngram"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction = Fraction(8, 10), scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``df``, of each linked group only those with its smallest id; a group without ids stays as it is."""
    found = named(df, id_col, text_col, n, threshold, scratch or Scratch(df.sparkSession, "ngram"))
    gone = found.filter(~F.col("id").eqNullSafe(F.col("component"))).select("id", "fp").distinct()
    text = F.col(f"d.`{text_col}`").cast("string")
    return df.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (F.xxhash64(text) == F.col("g.fp")), "left_anti")
