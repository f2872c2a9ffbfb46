"""Ranking of what to look at: signals, plans, gaps, leads, priorities and comparison of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.classify import PRIVILEGED, TELEMETRY

# Weights of signals and of open questions.
SIGNAL_WEIGHT = {"static_only": 3, "privileged": 3, "mixed_auth": 2, "no_auth_state": 2, "role_divergence": 2, "only_errored": 1, "credentialed": 1, "input_page": 2}
GAP_WEIGHT = {"AUTHENTICATED_STATE_NOT_OBSERVED": 5, "API_PURPOSE_UNKNOWN": 4, "ROLE_NOT_TAGGED": 4, "AUTHORIZATION_UNKNOWN": 3, "ENDPOINT_ONLY_ERRORED": 2, "SCRIPT_PARTIALLY_SCANNED": 2, "CAPTURE_ITEMS_SKIPPED": 1}
AREA_ENDPOINTS, AREA_SIGNALS = 20, 12


def privileged(path: Column) -> Column:
    return F.coalesce(path.rlike(PRIVILEGED), F.lit(False))


def only_errors(statuses: Column) -> Column:
    """Answered, and never with less than 400."""
    return (F.size(statuses) > 0) & F.forall(statuses, lambda s: s >= 400)


def statuses_of(role: str) -> Column:
    """Statuses that a role got, from ``status_by_role``."""
    return F.transform(F.filter("status_by_role", lambda x: x["role"] == role), lambda x: x["status"])


def _any(xs: Column, low: int, high: int) -> Column:
    return F.exists(xs, lambda s: (s >= low) & (s < high))


def signals(nodes: DataFrame) -> DataFrame:
    """(id, label, kind, weight): the structural questions that endpoints raise."""
    creds, reached, priv = F.size("credentials") > 0, F.col("requests") > 0, privileged(F.col("path"))
    sbr = F.col("status_by_role")
    allowed = F.exists(sbr, lambda x: (x["status"] >= 200) & (x["status"] < 300))
    denied = F.exists(sbr, lambda x: x["status"].isin(401, 403))

    def one(kind: str, when: Column, weight: int | Column | None = None) -> Column:
        w = F.lit(SIGNAL_WEIGHT[kind]) if weight is None else weight
        return F.when(when, F.struct(F.lit(kind).alias("kind"), w.cast("int").alias("weight")))

    found = F.array_compact(
        F.array(
            one("static_only", F.col("api_state") == "STATIC_ONLY"),
            one("privileged", priv, F.lit(SIGNAL_WEIGHT["privileged"]) - F.when(reached, 0).otherwise(1)),
            one("mixed_auth", creds & (F.col("anonymous_requests") > 0)),
            one("no_auth_state", reached & ~creds & F.col("method").isNotNull() & ~F.col("method").isin("*", "GET", "HEAD")),
            one("role_divergence", allowed & denied),
            one("only_errored", only_errors(F.col("statuses"))),
        )
    )
    return nodes.filter("type = 'endpoint'").select("id", "label", F.explode(found).alias("s")).select("id", "label", "s.kind", "s.weight")


def input_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that take parameters, as signals."""
    takes = edges.filter("type = 'USES_PARAMETER'").select(F.col("src").alias("id")).distinct()
    return nodes.filter("type = 'route'").join(takes, "id", "left_semi").select("id", "label", F.lit("input_page").alias("kind"), F.lit(SIGNAL_WEIGHT["input_page"]).alias("weight"))


def plan(found: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, score, n_signals, endpoints, signals): areas (id, area) by the weight of their signals.

    Lists hold the first 20 labels and the 12 heaviest signals, cut by rank before they are gathered.
    """
    rows = found.join(areas, "id")
    score = rows.groupBy("area").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n_signals"))
    by_weight = Window.partitionBy("area").orderBy(F.desc("weight"), "label", "kind")
    heavy = rows.withColumn("k", F.row_number().over(by_weight)).filter(F.col("k") <= AREA_SIGNALS)
    heavy = heavy.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "kind", "label"))), lambda x: F.concat(x["kind"], F.lit(" "), x["label"])).alias("signals"))
    labels = rows.select("area", "label").distinct().withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy("label"))).filter(F.col("k") <= AREA_ENDPOINTS)
    labels = labels.groupBy("area").agg(F.array_sort(F.collect_list("label")).alias("endpoints"))
    return score.join(labels, "area").join(heavy, "area").orderBy(F.desc("score"), "area")


def gaps(unknowns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open questions by how much an answer adds; one more for privileged paths."""
    weight = F.lit(1)
    for kind, w in GAP_WEIGHT.items():
        weight = F.when(F.col("u.type") == kind, w).otherwise(weight)
    rows = unknowns.alias("u").join(nodes.select("id", "label", F.col("type").alias("node_type"), "path").alias("n"), F.col("u.entity") == F.col("n.id"), "left")
    more = F.when((F.col("node_type") == "endpoint") & privileged(F.col("path")), 1).otherwise(0)
    entity = F.coalesce("label", F.element_at(F.split("entity", ":"), -1))
    return rows.select((weight + more).alias("leverage"), F.col("u.type").alias("type"), entity.alias("entity"), "we_know", "we_dont_know", "next_step")


def priority(nodes: DataFrame) -> DataFrame:
    """Endpoints with rank 0 (first) to 6."""
    path = F.col("path")
    rank = (
        F.when(F.coalesce(path.rlike(TELEMETRY), F.lit(False)) & ~privileged(path), 6)
        .when(F.col("api_state") == "STATIC_ONLY", 0)
        .when(privileged(path), 1)
        .when(F.size("roles") > 0, 2)
        .when((F.size("credentials") > 0) & (F.col("anonymous_requests") > 0), 3)
        .when(F.col("method").isNotNull() & ~F.col("method").isin("GET", "HEAD"), 4)
        .otherwise(5)
    )
    return nodes.filter("type = 'endpoint'").withColumn("rank", rank)


def lens(nodes: DataFrame, name: str = "attention") -> DataFrame:
    """Endpoints with rank and ``place``, what sorts them: "attention" by rank, "auth" too, but only those with roles or
    credentials, "all" in order of their first request."""
    if name not in ("attention", "auth", "all"):
        raise ValueError(f"no lens {name!r}; there are attention, auth and all")
    rows = priority(nodes)
    if name == "auth":
        rows = rows.filter((F.coalesce(F.size("roles"), F.lit(0)) > 0) | (F.coalesce(F.size("credentials"), F.lit(0)) > 0))
    place = F.struct(F.col("first_ev").cast("long").alias("by"), F.lit("").alias("label"), "id") if name == "all" else F.struct(F.col("rank").cast("long").alias("by"), "label", "id")
    return rows.withColumn("place", place)


def leads(nodes: DataFrame, most_static: int = 12) -> DataFrame:
    """(id, label, severity, n_signals, called): endpoints with signals, telemetry left out.

    hot: privileged or different answers for different roles; warn: other signals; info: named in code only, if more
    than ``most_static`` are.
    """
    found = signals(nodes).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n_signals"), F.collect_set("kind").alias("kinds"))
    kept = nodes.filter(~F.coalesce(F.col("path").rlike(TELEMETRY), F.lit(False))).select("id", (F.col("requests") > 0).alias("called"))
    many = nodes.agg((F.count_if(F.col("api_state") == "STATIC_ONLY") > most_static).alias("many"))
    rows = found.join(kept, "id").crossJoin(F.broadcast(many))
    hot = F.array_contains("kinds", "role_divergence") | (F.array_contains("kinds", "privileged") & F.col("called"))
    only = (F.size("kinds") == 1) & F.array_contains("kinds", "static_only") & F.col("many")
    severity = F.when(hot, "hot").when(only, "info").otherwise("warn")
    return rows.select("id", "label", severity.alias("severity"), "n_signals", "called")


def cross_role(nodes: DataFrame, low: str, high: str) -> DataFrame:
    """(kind, id, label): what a high role reached alone, privileged paths that a low one reached, and what both got."""
    has_low, has_high = F.array_contains("roles", low), F.array_contains("roles", high)
    ok = lambda role: _any(statuses_of(role), 200, 300)
    kind = (
        F.when(has_high & ~has_low, "high_only")
        .when(has_low & privileged(F.coalesce("path", "label")), "low_reached_privileged")
        .when(has_low & has_high & ok(low) & ok(high), "shared_same_success")
    )
    return nodes.filter(F.col("type").isin("endpoint", "operation")).select(kind.alias("kind"), "id", "label").filter("kind is not null")


def reaches_privileged(nodes: DataFrame, role: str) -> DataFrame:
    """Privileged endpoints and pages that a role reached, with the statuses it got."""
    rows = nodes.filter(F.col("type").isin("endpoint", "route") & privileged(F.col("path")) & F.array_contains("roles", role))
    return rows.select("id", "label", F.array_sort(statuses_of(role)).alias("statuses"))
