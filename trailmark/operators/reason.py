"""Views for reasoning over the graph: trust zones, areas, hubs and coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.classify import PRIVILEGED
from trailmark.functions.template import ROUTE_PARAMS
from trailmark.tables import settle

# Path segments that are structure, and node types that are leaves or connectors.
STOP = ["api", "rest", "gql", "graphql", "www", "app", "public", "v1", "v2", "v3", "v4", "static", "assets", "cdn"]
FRONT = ["", "index", "index.php", "index.html", "index.asp", "index.aspx", "default.aspx", "default.asp", "main.php", "app.php", "app.cgi", "default.php"]
LEAVES = ["parameter", "cookie", "tech", "auth"]
CONNECTORS = ["host", "role"]
WIDE = 4
ROUNDS = 12


def trust_zones(nodes: DataFrame) -> DataFrame:
    """(zone, id, label): how identity reaches each endpoint; zones overlap."""
    creds, anonymous = F.size("credentials") > 0, F.col("anonymous_requests") > 0
    zones = F.array_compact(
        F.array(
            F.when(F.col("path").rlike(PRIVILEGED), "privileged"),
            F.when(creds, "credentialed"),
            F.when(creds & anonymous, "anonymous_seen"),
            F.when(~creds & (F.col("requests") > 0), "no_auth_observed"),
        )
    )
    return nodes.filter("type = 'endpoint'").select(F.explode(zones).alias("zone"), "id", "label")


def _clean(seg: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(seg), r"\.[^.]*$", ""), "[^a-z0-9_]", "")
    return F.when(bare == "", F.lower(seg)).otherwise(bare)


def segments(path: Column) -> Column:
    """Segments that may name an area: no placeholders, no structure."""
    segs = F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda s: (s != "") & ~s.startswith("{"))
    return F.filter(F.transform(segs, F.lower), lambda s: ~s.isin(STOP))


def wide(nodes: DataFrame) -> DataFrame:
    """(first): first segments with four or more different second ones; their areas are one level deeper."""
    segs = nodes.filter(F.col("type").isin("endpoint", "route")).select(segments(F.col("path")).alias("s")).filter("size(s) > 1")
    return segs.groupBy(_clean(F.get("s", F.lit(0))).alias("first")).agg(F.count_distinct(_clean(F.get("s", F.lit(1)))).alias("n")).filter(F.col("n") >= WIDE).select("first")


def with_area(nodes: DataFrame, singular: bool = True) -> DataFrame:
    """nodes with ``area``: `/api/Users/{id}` and `/rest/users` -> `user` (`users` if not ``singular``), a page chosen by a parameter -> its name."""
    last = F.lower(F.element_at(F.split(F.regexp_replace(F.substring_index("path", "?", 1), "/+$", ""), "/"), -1))
    query = F.when(F.col("path").contains("?"), F.regexp_replace("path", r"^[^?]*\?", ""))
    chosen = F.filter(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1).isin(ROUTE_PARAMS) & (F.regexp_replace(kv, "^[^=]*=?", "") != ""))
    page = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.get(chosen, F.lit(0)), "^[^=]*=", "")), r"\.[^.]*$", ""), "[^a-z0-9_-]", "")
    s = segments(F.col("path"))
    first = F.when(F.size(s) > 0, _clean(F.get(s, F.lit(0))))
    second = F.when(F.size(s) > 1, _clean(F.get(s, F.lit(1))))
    rows = nodes.withColumn("__first", first).join(wide(nodes).withColumnRenamed("first", "__wide"), F.col("__first") == F.col("__wide"), "left")
    single = F.col("__first") if not singular else F.when(F.regexp_replace("__first", "s+$", "") == "", F.col("__first")).otherwise(F.regexp_replace("__first", "s+$", ""))
    area = F.when(query.isNotNull() & last.isin(FRONT) & (F.size(chosen) > 0), page).when(F.col("__wide").isNotNull() & second.isNotNull(), F.concat("__first", F.lit("/"), second)).otherwise(F.coalesce(single, F.lit("")))
    return rows.withColumn("area", area).drop("__first", "__wide")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): different neighbours of each node, either way."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    known = nodes.select("id")
    inside = both.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "other"), "other", "left_semi")
    return inside.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """The nodes with the most neighbours, leaves left out."""
    rows = nodes.filter(~F.col("type").isin(LEAVES)).join(degrees(nodes, edges), "id")
    return rows.select("id", "type", "label", "degree").orderBy(F.desc("degree"), "label", "id").limit(most)


def shell_hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages and scripts that touch more than a fifth of all nodes, and more than twelve."""
    total = nodes.agg(F.greatest(F.lit(12.0), F.count(F.lit(1)) * 0.2).alias("cut"))
    return nodes.filter(F.col("type").isin("route", "script")).join(degrees(nodes, edges), "id").crossJoin(F.broadcast(total)).filter(F.col("degree") > F.col("cut")).select("id")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, community) by label propagation in synchronous rounds.

    Every node takes the label most frequent among itself and its neighbours, the smallest one of a tie; leaves,
    connectors and shell hubs hold no label while it runs and take their neighbours' majority at the end.  Endpoints and
    pages of one area count as neighbours of their area's smallest node.
    """
    held = nodes.filter(F.col("type").isin(LEAVES + CONNECTORS)).select("id").unionByName(shell_hubs(nodes, edges)).distinct()
    core = settle(with_area(nodes).join(held, "id", "left_anti").select("id", "type", "area"), "core")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    named = core.filter((F.col("area") != "") & F.col("type").isin("endpoint", "route"))
    star = named.select("id", F.min("id").over(Window.partitionBy("area")).alias("hub")).filter("id <> hub")
    both = both.unionByName(star.select(F.col("id").alias("src"), F.col("hub").alias("dst"))).unionByName(star.select(F.col("hub").alias("src"), F.col("id").alias("dst")))
    ids = core.select("id")
    inner = settle(both.filter("src <> dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "near")
    labels = settle(ids.select("id", F.col("id").alias("community")), "labels")

    def votes(near: DataFrame) -> DataFrame:
        counted = near.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("voted"))

    own = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    for _ in range(rounds):
        new = settle(labels.join(votes(inner.unionByName(own)), "id", "left").select("id", F.coalesce("voted", "community").alias("community"), F.col("community").alias("was")), "labels")
        moved = not new.filter("community <> was").isEmpty()
        labels = new.select("id", "community")
        if not moved:
            break
    late = votes(both.join(held.withColumnRenamed("id", "src"), "src", "left_semi")).select("id", F.col("voted").alias("community"))
    return labels.unionByName(late)


def named_communities(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, name, n_nodes) of ``groups`` (id, community).

    The name is the segment that most paths of the community's endpoints and pages have; areas count in place of segments
    where a page is chosen by a parameter or a first segment is a wide one.  Without any, it is the most frequent type of
    its nodes, leaves and connectors left out, else the type of the node with the most neighbours.  Ties go to the
    shorter, then the smaller segment, the larger type and the smallest id.
    """
    rows = nodes.select("id", "type", "path").join(groups.select("id", "community"), "id")
    pathed = rows.filter(F.col("type").isin("endpoint", "route")).withColumn("path", F.coalesce("path", F.lit("")))
    segs = F.transform(F.split(F.regexp_replace("path", "^/+|/+$", ""), "/"), F.lower)
    spread = wide(nodes).withColumnRenamed("first", "__first")
    marked = pathed.withColumn("__head", F.get(segs, F.lit(0))).join(spread, F.col("__head") == F.col("__first"), "left")
    by_area = marked.filter(F.contains("path", F.lit("?")) | F.col("__first").isNotNull()).select("community").distinct()

    def most(words: DataFrame, name: str) -> DataFrame:
        counted = words.groupBy("community", "word").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("community").agg(F.min_by("word", F.struct(-F.col("n"), F.length("word"), "word")).alias(name))

    named = F.filter(segs, lambda s: (F.length(s) > 1) & ~s.startswith("{") & ~s.isin(STOP))
    areas = most(with_area(pathed.join(by_area, "community", "left_semi"), singular=False).filter("area <> ''").select("community", F.col("area").alias("word")), "by_area")
    words = most(pathed.select("community", F.explode(named).alias("word")), "by_word")
    kinds = rows.filter(~F.col("type").isin(LEAVES + CONNECTORS)).groupBy("community", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("community").agg(F.max_by("type", F.struct("n", "type")).alias("by_type"))
    near = rows.join(degrees(nodes, edges), "id", "left").groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"), F.min_by("type", F.struct(-F.coalesce("degree", F.lit(0)), "id")).alias("by_hub"))
    for t in (areas, words, kinds):
        near = near.join(t, "community", "left")
    return near.select("community", F.coalesce("by_area", "by_word", "by_type", "by_hub").alias("name"), "n_nodes")


def coupling(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, src_label, dst_label, type, state): edges between communities, and edges to third parties once per pair of labels."""
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col("type").alias("st"), F.col("label").alias("src_label")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("dt"), F.col("label").alias("dst_label")), "dst")
    third = ends.filter("st = 'third_party' or dt = 'third_party'")
    other, tp = F.when(F.col("dt") == "third_party", F.col("src_label")).otherwise(F.col("dst_label")), F.when(F.col("dt") == "third_party", F.col("dst_label")).otherwise(F.col("src_label"))
    third = third.groupBy(other.alias("src_label"), tp.alias("dst_label")).agg(F.min(F.struct("type", "state")).alias("e")).select(F.lit("third_party").alias("kind"), "src_label", "dst_label", "e.*")
    shell = shell_hubs(nodes, edges)
    inner = ends.filter("st <> 'third_party' and dt <> 'third_party'").filter(~F.col("st").isin(LEAVES + CONNECTORS) & ~F.col("dt").isin(LEAVES + CONNECTORS))
    inner = inner.join(shell.withColumnRenamed("id", "src"), "src", "left_anti").join(shell.withColumnRenamed("id", "dst"), "dst", "left_anti")
    inner = inner.join(groups.select(F.col("id").alias("src"), F.col("community").alias("sc")), "src").join(groups.select(F.col("id").alias("dst"), F.col("community").alias("dc")), "dst").filter("sc <> dc")
    return inner.select(F.lit("cross").alias("kind"), "src_label", "dst_label", "type", "state").unionByName(third)
