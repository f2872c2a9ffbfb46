"""Walks over the edges: each step is one join of the frontier with the edge table, written before the next one."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.text import nocase
from trailmark.tables import settle

DEPTH, DEEPEST, HOPS = 3, 8, 8


def _ends(edges: DataFrame, direction: str) -> DataFrame:
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(a).alias("at"), F.col(b).alias("to"))


def walk(edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int | None = DEPTH) -> DataFrame:
    """(id, hops) of what is reached from ``starts`` (id) in at most ``depth`` steps (None: until nothing is new).

    A start is not taken as visited, so it is reported when a cycle leads back to it.
    """
    most = None if depth is None else max(1, min(DEEPEST, depth))
    step = _ends(edges, direction).distinct()
    front, seen, d = starts.select(F.col("id").alias("at")).distinct(), None, 0
    while most is None or d < most:
        d += 1
        new = front.join(step, "at").select(F.col("to").alias("id")).distinct()
        if seen is not None:
            new = new.join(seen, "id", "left_anti")
        new = settle(new.withColumn("hops", F.lit(d)), "front")
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        front = new.select(F.col("id").alias("at"))
    return seen if seen is not None else starts.select("id", F.lit(0).alias("hops")).limit(0)


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(id, hops, direction) both ways."""
    return walk(edges, starts, "out", depth).withColumn("direction", F.lit("out")).unionByName(walk(edges, starts, "in", depth).withColumn("direction", F.lit("in")))


def paths(edges: DataFrame, start: DataFrame, goal: DataFrame, direction: str = "out", hops: int | None = HOPS, most: int = 1) -> DataFrame:
    """(start, goal, hops, trail) of up to ``most`` shortest paths for each start: trails are arrays of nodes, ties go to the smallest trail.

    Of the trails that reach one node in one step, the ``most`` smallest go on.  Without ``hops`` walks end where nothing is new.
    """
    step = _ends(edges, direction).distinct()
    front = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("trail"))
    found, done = None, None
    for d in count(1) if hops is None else range(1, hops + 1):
        grown = front.join(step, "at").filter(~F.array_contains("trail", F.col("to"))).select("start", F.col("to").alias("at"), F.concat("trail", F.array("to")).alias("trail"))
        if done is not None:
            grown = grown.join(done, ["start", "at"], "left_anti")
        kept = grown.withColumn("k", F.row_number().over(Window.partitionBy("start", "at").orderBy("trail"))).filter(F.col("k") <= most).drop("k")
        front = settle(kept, "front")
        if front.isEmpty():
            break
        here = front.join(goal.select(F.col("id").alias("at")), "at", "left_semi").withColumn("hops", F.lit(d))
        found = here if found is None else found.unionByName(here)
        front = front.join(goal.select(F.col("id").alias("at")), "at", "left_anti")
        now = front.select("start", "at").distinct()
        done = now if done is None else done.unionByName(now)
        enough = found.groupBy("start").count().filter(F.col("count") >= most).select("start")
        front = settle(front.join(enough, "start", "left_anti"), "front")
    if found is None:
        return start.select(F.col("id").alias("start"), F.col("id").alias("goal"), F.lit(0).alias("hops"), F.array("id").alias("trail")).limit(0)
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("hops", "trail"))).filter(F.col("k") <= most)
    return ranked.select("start", F.col("at").alias("goal"), "hops", "trail")


def map_paths(edges: DataFrame, start: DataFrame, goal: DataFrame) -> DataFrame:
    """(start, goal, hops, trail) of a shortest path along edges in either direction, however long."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return paths(both, start, goal, hops=None)


def path_steps(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (start, goal, hop, src, dst, type, state) of paths along out-edges; of parallel edges the first by type."""
    hop = found.select("start", "goal", F.posexplode(F.arrays_zip(F.slice("trail", 1, 1000).alias("a"), F.slice("trail", 2, 1000).alias("b"))).alias("hop", "s"))
    hop = hop.select("start", "goal", (F.col("hop") + 1).alias("hop"), F.col("s.a").alias("src"), F.col("s.b").alias("dst")).filter("dst is not null")
    one = edges.groupBy("src", "dst").agg(F.min(F.struct("type", "state")).alias("e")).select("src", "dst", "e.*")
    return hop.join(one, ["src", "dst"]).select("start", "goal", "hop", "src", "type", "state", "dst")


def resolve(nodes: DataFrame, ref: str) -> str:
    """The id of the node that ``ref`` names: an id, else a label, else a part of one label; anything else is an error."""
    low = nocase(F.lit(ref))
    for rule in (F.col("id") == F.lit(ref), nocase(F.col("label")) == low, F.contains(nocase(F.col("label")), low)):
        hits = nodes.filter(rule).select("id", "label").orderBy("label", "id").limit(6).collect()
        if len(hits) == 1:
            return hits[0]["id"]
        if hits:
            raise ValueError(f"{ref!r} may be any of: {', '.join(h['label'] for h in hits[:5])}")
    raise ValueError(f"no node {ref!r}")


def provenance(node_evidence: DataFrame, exchanges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The requests behind each of ``nodes`` (id)."""
    asked = exchanges.select(F.col("id").alias("ev"), "method", "host", "path_template", "status", "role")
    return nodes.select(F.col("id").alias("node_id")).join(node_evidence.withColumnRenamed("id", "node_id"), "node_id").join(asked, "ev").select("node_id", "ev", "method", "host", "path_template", "status", "role")


def static_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints that only code names, with the labels of what names them."""
    named = edges.filter("type = 'REFERENCES'").join(nodes.select(F.col("id").alias("src"), F.col("label").alias("by")), "src")
    by = named.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("by")).alias("referenced_by"))
    return nodes.filter("api_state = 'STATIC_ONLY'").join(by, "id", "left").select("id", "label", "referenced_by")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of what undirected edges connect, for every node of an edge."""
    e = settle(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = settle(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    low = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return low.unionByName(low.select(F.col("component").alias("id")).distinct().select("id", F.col("id").alias("component")))
