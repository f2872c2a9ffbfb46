"""Walks that the types of nodes and edges bound: how a node is reached, what a page calls, what a node touches.

Many starts walk at once; a front has one row for each start and node, and a step is one join of the front with the edges,
written before the next one.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.operators import rank, traverse
from trailmark.tables import settle

# Edges along which a request flows, and types of nodes at which a walk into the application begins.
FLOW_EDGES = ["SERVES", "INCLUDES", "SPAWNS", "CALLS", "REFERENCES", "EXPOSES", "USES_PARAMETER", "USES_OPERATION", "NAVIGATES_TO", "LOADS"]
ENTRY_TYPES = ["host", "route"]
ENTRIES, DEPTH = 3, 3
# Endpoints of an area that are traced, entries of each that count, and notes that an area gets.
TRACED, TRACES, NOTES = 8, 2, 5


def _steps(nodes: DataFrame, edges: DataFrame, flow: bool = True) -> DataFrame:
    """(src, dst, type, state) between known nodes, one for parallel edges: the first by type and state."""
    rows = edges.filter(F.col("type").isin(FLOW_EDGES)) if flow else edges
    one = rows.groupBy("src", "dst").agg(F.min(F.struct("type", "state")).alias("e")).select("src", "dst", "e.*")
    known = nodes.select("id")
    return one.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type", "state")


def _spread(front: DataFrame, grow, best: Column, goes_on) -> list[DataFrame]:
    """Fronts of a walk: ``grow`` gives the (start, at, ...) one step on, ``best`` the row that stays of each (start, at).

    A node is taken once for a start; ``goes_on`` filters those from which the walk continues.
    """
    fronts, seen = [], settle(front.select("start", "at"), "seen")
    for hop in count(1):
        grown = grow(front).withColumn("hops", F.lit(hop))
        others = [c for c in grown.columns if c not in ("start", "at")]
        new = grown.join(seen, ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min_by(F.struct(*others), best).alias("x")).select("start", "at", "x.*")
        new = settle(new, "front")
        if new.isEmpty():
            return fronts
        fronts.append(new)
        seen = seen.unionByName(new.select("start", "at"))
        front = goes_on(new, hop)
        if front is None:
            return fronts


def _union(fronts: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in fronts:
        out = f if out is None else out.unionByName(f)
    return out


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame, most: int = ENTRIES) -> DataFrame:
    """(start, entry, label, hops, trail): how each of ``starts`` (id) is reached, at most ``most`` entries by their labels.

    The walk goes backwards along flow edges and ends at hosts and pages; an entry's trail is a shortest one, of several
    the smallest, as an array of (src, type, state, dst) from the entry on.  A start that is an entry itself has no rows.
    Fronts hold the next hop only, since a node has one row for a start; trails are put together for the entries that are returned.
    """
    steps = settle(_steps(nodes, edges), "steps")
    entries = settle(nodes.filter(F.col("type").isin(ENTRY_TYPES)).select(F.col("id").alias("at"), "label"), "entries")
    first = starts.select(F.col("id").alias("at")).distinct().join(nodes.select(F.col("id").alias("at")), "at", "left_semi").join(entries, "at", "left_anti")
    front = settle(first.select(F.col("at").alias("start"), "at"), "front")

    def grow(front: DataFrame) -> DataFrame:
        return front.join(steps, front["at"] == steps["dst"]).select("start", F.col("src").alias("at"), "type", "state", F.col("dst").alias("next"))

    def goes_on(new: DataFrame, _: int) -> DataFrame | None:
        more = new.join(entries, "at", "left_anti").select("start", "at")
        return None if more.isEmpty() else more

    # Of one length, trails differ first in the hop they begin with, or not at all.
    fronts = _spread(front, grow, F.struct("type", "state", "next"), goes_on)
    found = _union(fronts)
    if found is None:
        found = grow(front).withColumn("hops", F.lit(0)).limit(0)
    ranked = found.join(entries, "at").withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("label", "at")))
    hop = F.array(F.struct(F.col("at").alias("src"), "type", "state", F.col("next").alias("dst")))
    out = ranked.filter(F.col("k") <= most).select("start", F.col("at").alias("entry"), "label", "hops", F.col("next").alias("at"), hop.alias("trail"))
    for before in fronts[-2::-1]:
        step = before.select("start", "at", "next", hop.alias("hop"))
        out = settle(out, "trails").join(step, ["start", "at"], "left").select(
            "start", "entry", "label", "hops", F.coalesce("next", "at").alias("at"), F.when(F.col("hop").isNull(), F.col("trail")).otherwise(F.concat("trail", "hop")).alias("trail")
        )
    return out.select("start", "entry", "label", "hops", "trail")


def area_reach(nodes: DataFrame, edges: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, entry, via): from where the areas (id, area) of endpoints are reached, at most five entries of each by label.

    Traced are the first eight endpoints of an area by label, two entries each; ``via`` is "code" if a hop is only inferred
    from code, else "traffic".  Of traces from one entry that of the first endpoint counts.
    """
    named = nodes.filter("type = 'endpoint'").select("id", "label").join(areas, "id")
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("area").orderBy("label", "id"))).filter(F.col("place") <= TRACED)
    first = settle(first.select("id", "area", "place"), "traced")
    traced = reach(nodes, edges, first.select("id"), TRACES).filter(F.size("trail") > 0)
    via = F.when(F.exists("trail", lambda h: h["state"] == "INFERRED"), "code").otherwise("traffic")
    told = traced.select(F.col("start").alias("id"), F.col("label").alias("entry"), via.alias("via")).join(first, "id")
    one = told.groupBy("area", "entry").agg(F.min_by("via", F.struct("place", "via")).alias("via"))
    return one.withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy("entry"))).filter(F.col("k") <= NOTES).select("area", "entry", "via")


def page_calls(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, endpoint, label, api_state, via, type, hops): endpoints reached from ``starts`` (id) through scripts and pages.

    ``via`` is the node whose edge, of that type, leads to the endpoint in the fewest steps; of several the smallest.
    """
    api_state = F.col("api_state") if "api_state" in nodes.columns else F.lit(None).cast("string").alias("api_state")
    steps = settle(_steps(nodes, edges, flow=False), "steps")
    kinds = nodes.select(F.col("id").alias("at"), F.col("type").alias("kind"))
    steps = steps.join(kinds.withColumnRenamed("at", "dst"), "dst").filter(F.col("kind").isin("endpoint", "script", "route"))
    front = starts.select(F.col("id").alias("start")).distinct().withColumn("at", F.col("start"))

    def grow(front: DataFrame) -> DataFrame:
        return front.select("start", F.col("at").alias("via")).join(steps, F.col("via") == F.col("src")).select("start", F.col("dst").alias("at"), "via", "type", "kind")

    fronts = _spread(front, grow, F.struct("via", "type"), lambda new, _: new.filter("kind <> 'endpoint'").select("start", "at"))
    found = _union(fronts)
    if found is None:
        found = grow(front).withColumn("hops", F.lit(0)).limit(0)
    labelled = nodes.select(F.col("id").alias("at"), "label", api_state)
    return found.filter("kind = 'endpoint'").join(labelled, "at").select("start", F.col("at").alias("endpoint"), "label", "api_state", "via", "type", "hops")


def blast(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int = DEPTH) -> DataFrame:
    """(start, type, hop, via, id, label): what ``starts`` (id) touch along flow edges within ``depth`` steps, or with "in" what touches them.

    ``via`` is the type of the edge by which a node is met first, of several the smallest.
    """
    steps = settle(_steps(nodes, edges), "steps")
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    steps = steps.select(F.col(a).alias("here"), F.col(b).alias("there"), F.col("type").alias("via"))
    front = starts.select(F.col("id").alias("start")).distinct().withColumn("at", F.col("start"))

    def grow(front: DataFrame) -> DataFrame:
        return front.join(steps, F.col("at") == F.col("here")).select("start", F.col("there").alias("at"), "via")

    fronts = _spread(front, grow, F.col("via"), lambda new, hop: new.select("start", "at") if hop < depth else None)
    found = _union(fronts)
    if found is None:
        found = grow(front).withColumn("hops", F.lit(0)).limit(0)
    return found.join(nodes.select(F.col("id").alias("at"), "type", "label"), "at").select("start", "type", F.col("hops").alias("hop"), "via", F.col("at").alias("id"), "label")


def privileged_paths(nodes: DataFrame, edges: DataFrame, role: str) -> DataFrame:
    """(id, label, statuses, trail): privileged endpoints and pages that a role reached, with the statuses it got and a shortest path from a host.

    The path, of nodes from the host on, takes edges of all types; it is null where there is none.
    """
    found = settle(rank.reaches_privileged(nodes, role), "privileged")
    up = traverse.paths(edges, found.select("id"), nodes.filter("type = 'host'").select("id"), "in")
    return found.join(up.select(F.col("start").alias("id"), F.reverse("trail").alias("trail")), "id", "left")
