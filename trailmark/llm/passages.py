"""Passages that several documents share, by MinHash banding of paragraphs.

Paragraphs are the lines of a text.  For those of ``LEAST_BANDED`` words or more (of fewer, no two different ones reach
0.8), MinHash values of their five-word shingles are banded; those that collide in a band meet in a tile, are verified by
exact Jaccard similarity of at least 0.8, and linked ones form one component.  So that passages are found wherever lines
end, each text is also cut at words that its own words choose: where the hash of three words is the smallest of
``REACH`` on either side.  So in a passage that two texts share the cuts are the same in both, but for ``REACH`` words at
its ends, whatever is around it; the pieces are some nine words long, and equal ones form one component.

A component that occurs in two or more documents is repeated.  Repeated units of a document that touch form a span.  The
first and the last unit of a span are extended word by word as far as another document goes on alike.  Spans with
no more than ``GAP`` words between them form a chain; the spans of a chain that has ``LEAST_SPAN`` words or more in its spans are
reported, without the words between them.  Of each component the document with the smallest id keeps its copy, and in all others
it is to be removed.

Defined results: null and empty texts have no units; a null id never counts as a document of its own, so its rows are
not reported; repeated rows are one document and repeat nothing by themselves; an empty table gives an empty result;
extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trailmark.llm import links
from trailmark.llm.ngram_join import ITEM
from trailmark.llm.sets import bitmap
from trailmark.llm.shingles import HELD, as_long, mixed, windows, word_hashes
from trailmark.llm.store import Scratch

WIDTH = 5
THRESHOLD = Fraction(8, 10)
RECALL = 0.99
#: Words of the shortest line that is banded, and from how many on a band has ROWS values in place of one.
LEAST_BANDED = 8
LONG_UNIT = 24
#: Words of the shortest unit.
LEAST_UNIT = 5
LEAST_SPAN = 25
#: Words that may lie between two spans of a chain.
GAP = 8
#: Places on either side of a cut among which it has the smallest hash, and words of the longest piece.
REACH = 4
LONGEST = 40


def tuned(threshold: float = float(THRESHOLD), recall: float = RECALL, rows: int = 2) -> int:
    """The least number of bands of ``rows`` values that finds a pair at the threshold with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


ROWS, BANDS = 2, tuned()
SHORT_BANDS = tuned(rows=1)


def _content(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of words, of their order too."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Runs follow one another without gaps.
    place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    spread = mixed(hashes ^ mixed(place.astype(np.uint64) + np.uint64(1)))
    return mixed(np.add.reduceat(spread, starts) + sizes.astype(np.uint64))


def band_keys(every: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """Keys of each of the units, all of which have at least WIDTH words; ``every``: the hashes of all windows of WIDTH words."""
    counts = sizes - WIDTH + 1
    cut = np.r_[0, np.cumsum(counts)[:-1]]
    own = every[np.repeat(starts - cut, counts) + np.arange(counts.sum())]
    low = [np.minimum.reduceat(mixed(own ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)), cut) for j in range(rows * bands)]
    keys = [mixed(sum(low[b * rows + r] * np.uint64(2 * r + 3) for r in range(rows)) + np.uint64(100 * (rows - 1) + b)) for b in range(bands)]
    return np.stack(keys, 1)


def banded(every: np.ndarray, starts: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the classes they belong to; a unit about as long as LONG_UNIT has keys of both kinds, so that it meets shorter and longer ones."""
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    # Of two sets at the threshold the larger has at most 1 / threshold times the elements of the smaller.
    most = math.floor((LONG_UNIT - WIDTH) / THRESHOLD) + WIDTH - 1
    for picked, rows, bands in ((sizes >= LONG_UNIT, ROWS, BANDS), ((sizes >= LEAST_BANDED) & (sizes <= most), 1, SHORT_BANDS)):
        at = np.flatnonzero(picked)
        if len(at):
            keys.append(band_keys(every, starts[at], sizes[at], rows, bands).ravel())
            of.append(np.repeat(classes[at], bands))
    return np.concatenate(keys), np.concatenate(of)


def paragraphs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, one after another, and the numbers of words of each line that has some and of each text."""
    raw = b"\n".join(x or b"" for x in texts).lower()
    at, hashes = word_hashes(raw)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A)
    ends = np.cumsum([len(x or b"") + 1 for x in texts])
    lines, docs = (np.diff(np.r_[0, np.searchsorted(at, places), *rest]) for places, rest in ((breaks, [len(at)]), (ends, [])))
    return hashes, lines[lines > 0], docs.astype(np.int64)


def cuts(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Ends of the pieces; ``docs``: the number of words of each of the texts that follow one another."""
    n, worded = len(hashes), docs[docs > 0]
    if not n:
        return np.zeros(0, np.int64)
    last = np.cumsum(worded)
    text = np.repeat(np.arange(len(worded)), worded)
    at = np.flatnonzero(np.arange(n) + 3 <= last[text])  # windows within one text
    h = mixed(windows(hashes, 3)[at] ^ np.uint64(0x9E3779B97F4A7C15)) if len(at) else np.zeros(0, np.uint64)
    # Between texts there is room for REACH places that are never the smallest.
    place = at + REACH * (text[at] + 1)
    around = np.full(n + REACH * (len(worded) + 1), 2**64 - 1, np.uint64)
    around[place] = h
    before, after = around[place - 1], around[place + 1]
    for j in range(2, REACH + 1):
        before, after = np.minimum(before, around[place - j]), np.minimum(after, around[place + j])
    chosen = at[(h < before) & (h <= after)]
    ends = np.union1d(chosen[chosen > (last - worded)[text[chosen]]], last)
    begin = np.r_[0, ends[:-1]]
    long = np.flatnonzero(ends - begin > LONGEST)
    return np.union1d(ends, np.concatenate([np.arange(begin[k] + LONGEST, ends[k], LONGEST) for k in long])) if len(long) else ends


def portions(batch: pa.RecordBatch, most: int = 1_000_000, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts, the third column, have about ``most`` bytes, or of one text."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(2)], np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (total + size > most or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


ROW = "key long, c long, id {}, t int, start int, size int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, t, text): a row for each unit, whose key is its class, and one for each band key of a line, with start -1,
    once for the copies of a line that a task has met lately."""
    met: set[int] = set()
    for whole in batches:
        for batch in portions(whole):
            hashes, sizes, docs = paragraphs(_bytes(batch.column(2)))
            if not len(hashes):
                continue
            text, first = np.repeat(np.arange(len(docs)), docs), np.cumsum(docs) - docs
            begin = np.cumsum(sizes) - sizes
            classes = _content(hashes, begin, sizes)
            ends = cuts(hashes, docs)
            from_ = np.r_[0, ends[:-1]]
            line = np.searchsorted(begin, from_, "right") - 1
            extra = (begin[line] != from_) | (sizes[line] != ends - from_)
            own = _content(hashes, from_, ends - from_)
            starts, lengths, all_ = np.r_[begin, from_[extra]], np.r_[sizes, (ends - from_)[extra]], np.r_[classes, own[extra]]
            unit = lengths >= LEAST_UNIT
            starts, lengths, all_ = starts[unit], lengths[unit], as_long(all_[unit])
            rows = [np.stack([all_, all_, text[starts], starts - first[text[starts]], lengths])]
            distinct, at = np.unique(as_long(classes), return_index=True)
            fresh = np.sort(at[[c not in met for c in distinct.tolist()]])
            met.update(distinct.tolist())
            if len(fresh) and len(hashes) >= WIDTH:
                keys, key_c = banded(windows(hashes, WIDTH), begin[fresh], sizes[fresh], classes[fresh])
                of = dict(zip(as_long(classes[fresh]).tolist(), text[begin[fresh]].tolist(), strict=True))
                source = np.array([of[c] for c in as_long(key_c).tolist()], np.int64)
                rows.append(np.stack([as_long(keys), as_long(key_c), source, np.full(len(keys), -1), np.zeros(len(keys), np.int64)]))
            if len(met) > HELD:
                met.clear()
            key, c, at, start, size = np.concatenate(rows, 1)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "c", "id", "t", "start", "size"])


LINES = "c long, id {}, t int, start int, size int, n long, bits binary, e binary"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, t, text, wanted classes): c, id, t, start, size of those lines, and of each the size, bitmap and sorted distinct shingles."""
    for batch in batches:
        at, found = [], []
        for k, (wanted, x) in enumerate(zip(batch.column(3).to_pylist(), _bytes(batch.column(2)), strict=True)):
            hashes, sizes, _ = paragraphs([x])
            begin = np.cumsum(sizes) - sizes
            wanted = set(wanted)
            for c, start, size in zip(as_long(_content(hashes, begin, sizes)).tolist(), begin.tolist(), sizes.tolist(), strict=True):
                if c in wanted:
                    e = np.unique(windows(hashes[start : start + size], WIDTH))
                    at.append(k)
                    found.append((c, start, size, len(e), bitmap(e).tobytes(), e.tobytes()))
        c, start, size, n, bits, e = zip(*found, strict=True) if found else [()] * 6
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(e, pa.binary())],
            ["c", "id", "t", "start", "size", "n", "bits", "e"],
        )


ENDS = "id {}, t int, side int, start int, end int, c long, keys array<long>"


def _room(places: np.ndarray, side: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words by which a unit may be extended: if more of them are shared, the whole piece beside it is.

    ``places``: the cuts, with both ends of every text; ``first``, ``last``: the ends of each unit's own text.  A cut that a
    text chooses depends on ``REACH + 3`` words beside it.  Beside a unit that ends within a piece it is the piece after that one.
    """
    right = np.searchsorted(places, end, "right")
    right = np.minimum(right + (places[right - 1] != end), np.searchsorted(places, last))
    left = np.searchsorted(places, start, "left")
    left = np.maximum(left - 1 - (places[left] != start), np.searchsorted(places, first))
    return np.where(side < 0, start - places[left], places[right] - end) + REACH + 3


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, t, text, wanted units with a side): the hash of each unit with 1, 2, ... more words of that side (-1 before, 1 after)."""
    for whole in batches:
        for batch in portions(whole):
            hashes, _, docs = paragraphs(_bytes(batch.column(2)))
            asked = batch.column(3)
            row = np.repeat(np.arange(len(docs)), np.diff(asked.offsets.to_numpy()))
            side, start, end, c = (asked.flatten().field(f).to_numpy().astype(np.int64) for f in ("side", "start", "end", "c"))
            inside = end <= docs[row]  # another text with the same id and hash
            row, side, start, end, c = row[inside], side[inside], start[inside], end[inside], c[inside]
            if not len(row):
                continue
            first = (np.cumsum(docs) - docs)[row]
            last, begin, stop = first + docs[row], first + start, first + end
            have = np.minimum(np.where(side < 0, start, docs[row] - end), _room(np.r_[0, cuts(hashes, docs)], side, begin, stop, first, last))
            h, unit = c.view(np.uint64) ^ (side + 1).astype(np.uint64), np.arange(len(row))
            of, keys = [unit[:0]], [h[:0]]
            for j in range(int(have.max())):
                more = have[unit] > j
                unit, h = unit[more], h[more]
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[np.where(side[unit] < 0, begin[unit] - 1 - j, stop[unit] + j)])
                of.append(unit)
                keys.append(h)
            order = np.argsort(np.concatenate(of), kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(have)].astype(np.int32)), pa.array(as_long(np.concatenate(keys)[order])))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(side.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(c), lists],
                ["id", "t", "side", "start", "end", "c", "keys"],
            )


SPAN = ["id", "t", "removed", "island"]


def islands(hits: DataFrame, gap: int = 0, name: str = "island") -> DataFrame:
    """``hits`` with ``island``, the same number for those of a row with no more than ``gap`` words between them."""
    w = Window.partitionBy("id", "t", "removed").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = hits.withColumn("new", F.coalesce(F.col("start") > before + gap, F.lit(True)).cast("int"))
    return new.withColumn(name, F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def extended(rows: DataFrame, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """Islands of hits, extended word by word: id, t, removed, start, end, keep_id.

    A removed one goes on as far as a document with a smaller id does, a kept one as far as any other document.
    ``hits`` is a saved table, which is deleted once it is read, as are all tables that the result does not read.
    """
    spans = islands(hits).groupBy(*SPAN).agg(
        F.min(F.struct("start", "end", "c")).alias("first"), F.max(F.struct("end", "start", "c")).alias("last"), F.min("keep_id").alias("keep_id")
    )
    spans = scratch.save(spans, "spans")
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{u}.start").alias("start"), F.col(f"{u}.end").alias("end"), F.col(f"{u}.c").alias("c")) for side, u in ((-1, "first"), (1, "last"))]))
    edges = spans.select(*SPAN, sides.alias("u")).select(*SPAN, "u.*")
    # The same units of other documents count wherever they are in a span.
    asked_of = edges.groupBy("c").agg(F.collect_set("side").alias("sides"))
    wanted = links.spread_join(hits, asked_of, "c").select("id", "t", F.explode("sides").alias("side"), "start", "end", "c")
    wanted = wanted.groupBy("id", "t").agg(F.collect_set(F.struct("side", "start", "end", "c")).alias("wanted"))
    found = rows.join(wanted.hint("shuffle_hash"), ["id", "t"]).select("id", "t", "text", "wanted")
    ends = scratch.save(found.mapInArrow(_ends, ENDS.format(dict(rows.dtypes)["id"])), "ends")
    scratch.drop(hits)
    shared = ends.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    asked = edges.join(ends, ["id", "t", "side", "start", "end", "c"]).select(*SPAN, "side", F.posexplode("keys").alias("j", "key"))
    asked = scratch.save(asked, "asked")
    more = links.spread_join(asked, shared, "key").filter("if(removed, lo < id, lo = id)").groupBy(*SPAN)
    more = scratch.save(more.agg(*[F.max(F.when(F.col("side") == side, F.col("j") + 1)).alias(name) for side, name in ((-1, "left"), (1, "right"))]), "more")
    scratch.drop(ends)
    scratch.drop(asked)
    start, end = F.col("first.start") - F.coalesce("left", F.lit(0)), F.col("last.end") + F.coalesce("right", F.lit(0))
    return spans.join(more, SPAN, "left").select("id", "t", "removed", start.alias("start"), end.alias("end"), "keep_id")


def line_links(rows: DataFrame, banded_: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, label) of the lines that are linked with another one, and the places of all lines that were compared, in the
    documents they were taken from; both saved.  ``banded_``: key, c, low, id, t of the band keys of two lines or more."""
    sources = banded_.groupBy("c").agg(F.min(F.struct("id", "t")).alias("s")).groupBy("s.id", "s.t").agg(F.collect_set("c").alias("wanted"))
    found = rows.join(sources.hint("shuffle_hash"), ["id", "t"]).select("id", "t", "text", "wanted")
    lines = scratch.save(found.mapInArrow(_lines, LINES.format(dict(rows.dtypes)["id"])), "lines")
    items = scratch.save(lines.select(*[f.split()[0] for f in ITEM.split(", ")]).dropDuplicates(["c"]), "items")
    places = scratch.save(lines.select("c", "id", "t", "start", "size"), "places")
    scratch.drop(lines)
    tiles = scratch.save(banded_.select("key", "c", "low").distinct(), "tiles")
    labels = links.groups(tiles, items, THRESHOLD, scratch)
    scratch.drop(items)
    scratch.drop(tiles)
    return labels.select(F.col("node").alias("c"), "label"), places


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_SPAN, scratch: Scratch | None = None) -> DataFrame:
    """One row per span: id, start_word, end_word (exclusive), n_words, removed, keep_id (smallest document that has some of it)."""
    scratch = scratch or Scratch(df.sparkSession, "passages")
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.hash(text).alias("t"), text.alias("text")).filter("id is not null")
    # One shuffle brings together the copies of each unit and the lines that collide in a band.
    w = Window.partitionBy("key")
    met = rows.mapInArrow(_units, ROW.format(dict(rows.dtypes)["id"]))
    met = met.withColumns({"low": F.min("c").over(w), "high": F.max("c").over(w), "lo": F.min("id").over(w), "hi": F.max("id").over(w)})
    met = scratch.save(met.filter("low < high or (start >= 0 and lo < hi)").drop("high", "hi"), "met")
    labels, lines = line_links(rows, met.filter("start < 0"), scratch)
    units = met.filter("start >= 0").select("c", "id", "t", "start", "size", "lo")
    # Linked lines that only one document has.
    alone = lines.join(labels.select("c"), "c", "left_semi").join(units.select("c").distinct(), "c", "left_anti").distinct().withColumn("lo", F.col("id"))
    units = scratch.save(units.unionByName(alone), "units")
    scratch.drop(met)
    scratch.drop(lines)
    classes = units.groupBy("c").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).join(labels, "c", "left").select("c", F.coalesce("label", "c").alias("label"), "lo", "hi")
    classes = scratch.save(classes, "classes")
    whole = classes.groupBy("label").agg(F.min("lo").alias("keep_id"), F.max("hi").alias("hi")).filter("keep_id < hi").select("label", "keep_id")
    again = links.spread_join(classes, whole, "label").select("c", "keep_id")
    hits = links.spread_join(units, again, "c").select("id", "t", "start", (F.col("start") + F.col("size")).alias("end"), "c", (F.col("id") != F.col("keep_id")).alias("removed"), "keep_id")
    hits = scratch.save(hits, "hits")
    scratch.drop(units)
    scratch.drop(classes)
    # Extended spans may reach each other.
    joined = islands(extended(rows, hits, scratch)).groupBy(*SPAN).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep_id").alias("keep_id"))
    chains = islands(joined, GAP, "chain")
    shared = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("id", "t", "removed", "chain"))
    spans = chains.withColumn("shared", shared).filter(F.col("shared") >= least)
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    return spans.select(F.col("id").alias(id_col), start.alias("start_word"), end.alias("end_word"), (end - start).alias("n_words"), "removed", "keep_id").distinct()


def _without(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for x, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if x and spans:
                raw = x.encode()
                places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
                for s in sorted(spans, key=lambda s: -s["start_word"]):
                    raw = raw[: places[s["start_word"]][0]] + raw[places[s["end_word"] - 1][1] :]
                x = raw.decode("utf-8", "replace")
            texts.append(x)
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_SPAN) -> DataFrame:
    """``df`` with the spans that are to be removed cut out of its texts."""
    spans = repeated(df, id_col, text_col, least).filter("removed").groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    joined = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id")).join(spans, "id", "left").select("row.*", F.col("spans").alias(f"spans of {df.columns}"))
    at = df.columns.index(text_col)
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in df.schema.fields]
    return joined.mapInArrow(lambda batches: _without(batches, at), T.StructType(fields))
