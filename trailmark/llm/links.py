"""Connected groups from candidate tiles, without all pairs of a tile.

A tile is a set of items that share a key.  Two items may be linked only if some tile holds both.

1. Every item of a tile is compared with the tile's smallest one, by bitmaps and then exactly.  That is a row for each
   place in a tile, however large it is; the connected components of these links are groups, and settle copies of one
   original.
2. Tiles that still hold several groups, without their smallest items (which have met all others), are looked at by
   bitmaps alone, in blocks of at most ``ITEMS`` items of one tile.  The result is a row for each item that may be
   linked with another group in the tile, with the groups that may hang together; it is linear in the tile.
3. Groups that may hang together form clusters.  Only the items named in step 2 are in them, in blocks of about ``BLOCK``
   elements or ``ITEMS`` items, whichever is less; each pair of blocks is compared exactly, and nothing once two groups
   are linked.

So no link between two groups is lost; within a group not every link is looked at.  Values that hold a large part of a
table are spread over ``SALTS`` in the joins.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.sets import bounded, linking, near_in_tiles, similar
from trailmark.llm.store import Scratch

#: Elements of a block of a cluster, eight bytes each, and items of a block of a tile or cluster.
BLOCK = 500_000
ITEMS = 1_000
#: A value with more rows than one in HEAVY of a table, and than HEAVY, is spread over SALTS; there are less than HEAVY such values.
HEAVY = 1_000
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left`` (saved) joined with ``right``, which has each value of ``on`` once; heavy values of ``left`` and null are salted."""
    n = left.count()
    heavy = [r[0] for r in left.groupBy(on).count().filter((F.col("count") >= HEAVY) & (F.col("count") * HEAVY > n)).select(on).collect()] if n >= HEAVY else []
    if not heavy:
        return left.join(right, on, how)
    hot = F.coalesce(F.col(on).isin([x for x in heavy if x is not None]), F.lit(False))
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c != on]), F.lit(SALTS)).cast("int")
    salted = left.withColumn("__salt", F.when(hot | F.col(on).isNull(), spread).otherwise(0))
    copies = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label of every node of edges (u, v), u > v.

    Alternates two steps that keep connectivity: every node hands its larger neighbours to its smallest one, then its
    smaller ones; each round is written, so lineage stays short.  The rounds grow with the logarithm of a path's length.
    """
    e = scratch.save(edges.distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, scratch.save(small.filter("u > v").distinct(), "edges")
        scratch.drop(before)
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("u")).first()
        # As many edges as nodes with a smaller neighbour, and no such neighbour has one itself: all are stars.
        if now[:2] == mark or (now[0] == now[2] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            break
        mark = now[:2]
    low = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = low.select(F.col("label").alias("node")).distinct()
    return low.unionByName(roots.select("node", F.col("node").alias("label")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges (a, b) but loops; saved.

    Nodes whose neighbours are all smaller hang on the smallest one and take its label at the end; the rounds go over
    the others only, so a node with very many such neighbours is joined with them once.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    parent = scratch.save(e.groupBy("u").agg(F.min("v").alias("p")), "parents")
    tops = e.select(F.col("v").alias("u")).distinct()
    rest = e.join(parent, "u").filter("v > p").select(F.col("v").alias("u"), F.col("p").alias("v"))
    rest = scratch.save(rest.unionByName(parent.join(tops, "u", "left_semi").select("u", F.col("p").alias("v"))).distinct(), "rest")
    roots = tops.join(parent, "u", "left_anti").select(F.col("u").alias("node"))
    if rest.isEmpty():
        out = parent.select(F.col("u").alias("node"), F.col("p").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
    else:
        inner = scratch.save(_stars(rest, scratch), "inner")
        out = spread_join(parent, inner.select(F.col("node").alias("p"), "label"), "p", "left").select(F.col("u").alias("node"), F.coalesce("label", "p").alias("label"))
        roots = roots.join(inner, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        out = out.unionByName(roots)
    return scratch.save(out, "labels")


def shared_keys(keys: DataFrame) -> DataFrame:
    """key, c, low (the key's smallest item) of the keys that two or more different items c have; once for each item."""
    w = Window.partitionBy("key")
    both = keys.withColumn("low", F.min("c").over(w)).withColumn("high", F.max("c").over(w)).filter("low < high")
    return both.select("key", "c", "low").distinct()


def verified(pairs: DataFrame, items: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are linked; both tables are saved.  First the bitmaps, then the elements of what is left."""

    def beside(pairs: DataFrame, *columns: str) -> DataFrame:
        left, right = ([F.col("c").alias(side), *[F.col(c).alias(c + side) for c in columns]] for side in "ab")
        return spread_join(pairs, items.select(*left), "a").join(items.select(*right), "b").select("a", "b", *[c + s for c in columns for s in "ab"])

    near = scratch.save(beside(pairs, "n", "bits").mapInArrow(bounded(threshold), "a long, b long"), "near")
    return scratch.save(beside(near, "e").mapInArrow(similar(threshold), "a long, b long").distinct(), "links")


def _blocks(rows: DataFrame, of: str, size: Column) -> DataFrame:
    """``rows`` once for each pair of blocks (i, j) of their ``of`` that has theirs; ``size``: the number of its blocks."""
    at = rows.withColumn("blocks", F.greatest(size, F.lit(1)).cast("long")).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    other = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return paired.repartition(of, "i", "j").sortWithinPartitions(of, "i", "j")


def groups(tiles: DataFrame, items: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """node, label for all items that are linked with another one.

    tiles: (key, c, low) of ``shared_keys``; items: (c, n, bits, e), size, bitmap and sorted elements of every item; both saved.
    """
    pairs = scratch.save(tiles.filter("c <> low").select(F.col("low").alias("a"), F.col("c").alias("b")).distinct(), "pairs")
    labels = components(verified(pairs, items, threshold, scratch), scratch)
    left = tiles.filter("c <> low").select("key", "c").join(labels.select(F.col("node").alias("c"), "label"), "c", "left")
    left = scratch.save(left.select("key", "c", F.coalesce("label", "c").alias("g")), "left")
    open_ = left.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi").select("key", "m")
    rest = scratch.save(spread_join(left, open_, "key").select("key", "c", "g", "m"), "open")
    scratch.drop(left)
    if rest.isEmpty():
        return labels
    signed = _blocks(rest.join(items.select("c", "n", "bits"), "c"), "key", F.ceil(F.col("m") / ITEMS))
    near = signed.select("key", "i", "j", "block", "c", "g", "n", "bits").mapInArrow(near_in_tiles(threshold), "c long, g long, h long")
    near = scratch.save(near.distinct(), "near")
    if near.isEmpty():
        return labels
    cluster = components(near.select(F.col("g").alias("a"), F.col("h").alias("b")), scratch).select(F.col("node").alias("g"), F.col("label").alias("cluster"))
    members = scratch.save(near.select("c", "g").distinct().join(cluster, "g"), "members")
    sizes = members.join(items.select("c", "n"), "c").groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("c") / ITEMS)).alias("size"))
    ready = spread_join(members, sizes, "cluster").join(items.select("c", "e"), "c")
    ready = _blocks(ready, "cluster", F.col("size")).select("cluster", "i", "j", "block", "c", "g", "e")
    more = components(ready.mapInArrow(linking(threshold), "a long, b long"), scratch)
    out = spread_join(labels, more.select(F.col("node").alias("label"), F.col("label").alias("more")), "label", "left").select("node", F.coalesce("more", "label").alias("label"))
    return scratch.save(out.unionByName(more.join(labels, "node", "left_anti")), "labels")
