"""From exchanges to the tables of a capture's graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.domains import clean_scope, registrable_domain
from trailmark.operators import contributions as c
from trailmark.operators import references as r
from trailmark.operators.fold import fold_siblings
from trailmark.schema import conform
from trailmark.tables import settle


@dataclass
class CaptureModel:
    """Tables of one build; each is a DataFrame, none is held on the driver."""

    name: str
    scope: list[str]
    primary: str | None
    exchanges: DataFrame
    nodes: DataFrame
    edges: DataFrame
    node_evidence: DataFrame
    edge_evidence: DataFrame
    unknowns: DataFrame
    secrets: DataFrame
    stack: DataFrame
    stats: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        names = ("exchanges", "nodes", "edges", "node_evidence", "edge_evidence", "unknowns", "secrets", "stack", "stats")
        return {n: getattr(self, n) for n in names} | self.extra

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables, for ``spark.sql`` over the graph."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


def build(exchanges: DataFrame, name: str = "app", scope: list[str] | None = None, primary: str | None = None, fold: bool = True, skipped: int = 0) -> CaptureModel:
    """The graph of a capture.

    Node fields come from the first request, sets and counts from all.  Without a scope it is the registrable domain of
    the busiest host.
    """
    exchanges = conform(exchanges)
    spark = exchanges.sparkSession
    scope = clean_scope(scope) if scope else None
    primary = primary or c.seed_host(exchanges, scope)
    if not scope:
        scope = [spark.range(1).select(registrable_domain(F.lit(primary)).alias("d")).first()["d"]] if primary else []
    if fold:
        exchanges = fold_siblings(exchanges)
    x = settle(c.classified(exchanges, scope, primary), "exchanges")
    alike = settle(c.shapes(x, links=True), "shapes")
    contributed, linked = c.node_contributions(alike), c.edge_contributions(alike)
    first_nodes, first_edges = settle(c.nodes_from(contributed), "nodes"), settle(c.edges_from(linked), "edges")
    nodes, edges = (settle(t, "kept") for t in r.prune(first_nodes, first_edges))
    extra, between = _linked(alike, nodes, scope, primary)
    extra, times = settle(extra, "extra"), alike.select(F.col("id").alias("ev"), "times")
    live = contributed.join(nodes.select("id"), "id", "left_semi")
    named_in = alike.join(extra.select(F.col("ev").alias("id")).distinct(), "id", "left_semi")
    marks = extra.select("id", "ev").distinct().join(c.node_contributions(named_in).select("id", "ev").join(nodes.select("id"), "id", "left_semi"), ["id", "ev"], "left_anti").join(times, "ev").withColumn("once", F.lit(True))
    extra = extra.withColumn("pos", F.lit(9_999)).unionByName(marks.withColumn("pos", F.lit(10_000)), allowMissingColumns=True)
    everything = live.unionByName(extra.withColumn("main", F.lit(False)), allowMissingColumns=True)
    live_edges = linked.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_semi").select("src", "dst", "type", "state", "ev", "times")
    between = settle(between.join(times, "ev"), "edges")
    # Evidence names every request, not the first of those alike; it is worked out only where it is asked for.
    each_extra, each_between = _linked(x, nodes, scope, primary)
    node_evidence = c.node_contributions(x).select("id", "ev").join(nodes.select("id"), "id", "left_semi").unionByName(each_extra.select("id", "ev")).distinct()
    edge_evidence = c.edge_contributions(x).select("src", "dst", "type", "ev").join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_semi").unionByName(each_between.select("src", "dst", "type", "ev")).distinct()
    edges = settle(c.edges_from(live_edges.unionByName(between)), "edges")
    nodes = settle(r.reconcile(c.nodes_from(everything), edges), "nodes")
    seen = x.agg(F.coalesce(F.bool_or(F.size("credentials") > 0), F.lit(False)).alias("creds"), F.coalesce(F.bool_or(F.col("role").isNotNull()), F.lit(False)).alias("roles")).first()
    _, maps = r.worker_links(alike, scope)
    cut = x.filter("scan_truncated and kind = 'script'").select(F.col("node_id").alias("id")).distinct()
    return CaptureModel(
        name, scope, primary, x, nodes, edges, node_evidence, edge_evidence,
        r.unknowns(nodes, name, seen["roles"], seen["creds"], skipped, cut, maps), c.secrets(x), stack_table(x), stats(x, nodes),
    )


def _linked(x: DataFrame, nodes: DataFrame, scope: list[str], primary: str | None) -> tuple[DataFrame, DataFrame]:
    """(contributions of nodes that only code names, edge contributions) of references, workers and referers of classified exchanges."""
    ref_edges, named = r.linked_references(r.references(x, nodes, scope, primary), nodes, scope, primary)
    workers, _ = r.worker_links(x, scope)
    worker_nodes = workers.select(F.col("dst").alias("id"), F.lit("script").alias("type"), F.lit(3).alias("layer"), F.element_at(F.split("dst", "/"), -1).alias("label"), "ev")
    worker_edges = workers.select("src", "dst", F.lit("SPAWNS").alias("type"), F.lit("INFERRED").alias("state"), "ev")
    between = r.referer_edges(x, nodes, scope).unionByName(ref_edges.distinct()).unionByName(worker_edges.distinct())
    return named.unionByName(worker_nodes, allowMissingColumns=True), between


def stack_table(x: DataFrame) -> DataFrame:
    """Technologies by category and name, with the first ten requests that showed them."""
    rows = x.filter(~F.col("probe") & F.col("first_party")).select(F.col("id").alias("ev"), F.explode("stack").alias("s")).select("ev", "s.*")
    by = rows.groupBy("category", "name").agg(F.min_by("how", "ev").alias("how"), F.min_by("version", F.when(F.col("version") != "", F.col("ev"))).alias("version"))
    return by.join(c.first_evidence(rows, ["category", "name"], 10), ["category", "name"])


def stats(x: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counters of a build, one row."""
    live = ~F.col("probe")
    return x.agg(
        F.count(F.lit(1)).alias("exchanges"),
        F.count_if(live & (F.col("kind") == "asset")).alias("static_assets"),
        F.count_if(live & (F.col("kind") == "preflight")).alias("preflight"),
        F.count_if(live & ~F.col("first_party")).alias("third_party_requests"),
        F.count_if("probe").alias("probe_requests"),
    )


def counts(model: CaptureModel) -> DataFrame:
    """Nodes by type and api_state."""
    return model.nodes.groupBy("type", "api_state").agg(F.count(F.lit(1)).alias("n"))
