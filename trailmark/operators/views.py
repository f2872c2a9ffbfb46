"""Joins and roll-ups for reports: site tree, dashboards, inventories, map groups, questions and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.classify import PRIVILEGED
from trailmark.operators import rank
from trailmark.operators.contributions import first_evidence

CAP, RELATED, CITED = 40, 5, 3
GROUP_FROM = 150


def site_tree(requests: DataFrame) -> DataFrame:
    """(host, prefix, n_requests, worst): every path prefix with its requests and worst status class.

    A prefix is the first k segments of the path, the path itself included; ``/`` is that of all.
    """
    segs = F.array_remove(F.split("path", "/"), "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda k: F.concat(F.lit("/"), F.concat_ws("/", F.slice(segs, 1, k))))
    rows = requests.select("host", F.explode(prefixes).alias("prefix"), (F.col("status") / 100).cast("int").alias("class"))
    return rows.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("n_requests"), F.max("class").alias("worst"))


def response_mix(requests: DataFrame) -> DataFrame:
    """(class, n): requests by hundred of the status; null without one."""
    return requests.groupBy((F.col("status") / 100).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def roll_up(nodes: DataFrame, edges: DataFrame, edge_type: str, by: str = "dst") -> DataFrame:
    """(id, label, n, labels): for each node at end ``by`` the labels at the other end, sorted."""
    other = "src" if by == "dst" else "dst"
    rows = edges.filter(F.col("type") == edge_type).select(F.col(by).alias("id"), F.col(other).alias("other"))
    rows = rows.join(nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other")
    by_id = rows.groupBy("id").agg(F.count_distinct("other").alias("n"), F.array_sort(F.collect_set("other_label")).alias("labels"))
    return by_id.join(nodes.select("id", "label"), "id").select("id", "label", "n", "labels")


def params_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n_used): parameter names by the nodes that use them."""
    names = nodes.filter("type = 'parameter'").select(F.col("id").alias("dst"), F.col("label").alias("name"))
    return edges.filter("type = 'USES_PARAMETER'").join(names, "dst").groupBy("name").agg(F.count_distinct("src").alias("n_used"))


def inventory(requests: DataFrame, methods: list[str] | None = None, classes: list[int] | None = None, role: str | None = None, prefix: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Requests by facets; all that are given must hold."""
    if methods:
        requests = requests.filter(F.col("method").isin(methods))
    if classes:
        requests = requests.filter((F.col("status") / 100).cast("int").isin(classes))
    if role is not None:
        requests = requests.filter(F.col("role") == role)
    if prefix is not None:
        requests = requests.filter(F.startswith(F.col("path"), F.lit(prefix)))
    return requests if ids is None else requests.join(ids.select("id"), "id", "left_semi")


def hygiene(nodes: DataFrame) -> DataFrame:
    """Cookies whose flags are weak somewhere."""
    return nodes.filter("type = 'cookie'").select("label", "httponly", "secure", "samesite", (~F.col("httponly") | ~F.col("secure") | (F.coalesce(F.lower("samesite"), F.lit("none")) == "none")).alias("weak"))


def map_groups(nodes: DataFrame, edges: DataFrame, cut: int = GROUP_FROM) -> tuple[DataFrame, DataFrame]:
    """(groups with sizes, edges between groups): above ``cut`` nodes, pages, endpoints and parameters fold by host and first segment, scripts by host."""
    total = nodes.agg((F.count(F.lit(1)) > cut).alias("fold"))
    first = F.get(F.array_remove(F.split(F.coalesce("path", F.lit("")), "/"), ""), F.lit(0))
    key = F.when(F.col("type").isin("route", "endpoint", "parameter"), F.concat_ws("/", F.lit("group"), "host", first)).when(F.col("type") == "script", F.concat(F.lit("scripts:"), F.coalesce("host", F.lit(""))))
    named = nodes.crossJoin(F.broadcast(total)).select("id", F.when(F.col("fold"), F.coalesce(key, F.col("id"))).otherwise(F.col("id")).alias("g"))
    groups = named.groupBy(F.col("g").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    linked = edges.join(named.select(F.col("id").alias("src"), F.col("g").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("g").alias("b")), "dst")
    return groups, linked.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def code_named(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of endpoints that were never called and of what names them."""
    lost = nodes.filter("api_state = 'STATIC_ONLY'").select(F.col("id").alias("dst"))
    refs = edges.filter("type = 'REFERENCES'").join(lost, "dst", "left_semi")
    ids = lost.withColumnRenamed("dst", "id").unionByName(refs.select(F.col("src").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi"), refs


# ---- fixed questions


def list_apis(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'endpoint'").select("label", "api_state", "statuses", "requests")


def list_routes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'route'").select("label", "statuses", "requests")


def code_vs_runtime(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'endpoint'").groupBy("api_state").agg(F.count(F.lit(1)).alias("n"))


def route_apis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, endpoint, via): what a page calls itself, or through a script that it includes."""
    pages = nodes.filter("type = 'route'").select(F.col("id").alias("route"))
    ends = nodes.filter("type = 'endpoint'").select(F.col("id").alias("endpoint"))
    calls = edges.filter(F.col("type").isin("CALLS", "REFERENCES")).select(F.col("src").alias("a"), F.col("dst").alias("endpoint"))
    own = pages.join(calls, pages["route"] == calls["a"]).select("route", "endpoint", F.lit("page").alias("via"))
    scripts = edges.filter("type = 'INCLUDES'").select(F.col("src").alias("route"), F.col("dst").alias("a"))
    through = pages.join(scripts, "route").join(calls, "a").select("route", "endpoint", F.lit("script").alias("via"))
    return own.unionByName(through).join(ends, "endpoint", "left_semi").groupBy("route", "endpoint").agg(F.min("via").alias("via"))


def parameters(nodes: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """(id, label, params): the first parameters of each endpoint by name."""
    names = nodes.filter("type = 'parameter'").select(F.col("id").alias("dst"), F.col("label").alias("name"))
    rows = edges.filter("type = 'USES_PARAMETER'").join(names, "dst").select(F.col("src").alias("id"), "name").distinct()
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("name"))).filter(F.col("k") <= most)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("params")).join(nodes.filter("type = 'endpoint'").select("id", "label"), "id")


def auth_surface(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, n_endpoints): credentials by the endpoints that were sent them."""
    auth = nodes.filter("type = 'auth'").select(F.col("id").alias("dst"), "label")
    return edges.filter("type = 'SENT_CREDENTIAL'").join(auth, "dst").groupBy("label").agg(F.count_distinct("src").alias("n_endpoints"))


def privileged_endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("type") == "endpoint") & F.coalesce(F.col("path").rlike(PRIVILEGED), F.lit(False))).select("label", "api_state", "statuses")


def errored_endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("type") == "endpoint") & rank.only_errors(F.col("statuses"))).select("label", "statuses")


def third_parties(nodes: DataFrame, most: int = 30) -> DataFrame:
    return nodes.filter("type = 'third_party'").select("label", F.col("n_evidence").alias("requests")).orderBy(F.desc("requests"), "label").limit(most)


def mentioned(nodes: DataFrame, question: str) -> DataFrame:
    """The endpoints whose path is the longest one in the question."""
    rows = nodes.filter("type = 'endpoint' and path <> '/'").filter(F.instr(F.lit(question.lower()), F.lower("path")) > 0)
    longest = rows.agg(F.max(F.length("path")).alias("n"))
    return rows.crossJoin(F.broadcast(longest)).filter(F.length("path") == F.col("n")).drop("n")


QUESTIONS = {
    "list apis": lambda m: list_apis(m.nodes),
    "list routes": lambda m: list_routes(m.nodes),
    "code vs runtime": lambda m: code_vs_runtime(m.nodes),
    "route apis": lambda m: route_apis(m.nodes, m.edges),
    "unknowns": lambda m: m.unknowns,
    "parameters": lambda m: parameters(m.nodes, m.edges),
    "secrets": lambda m: m.secrets.orderBy(F.desc("count"), "kind", "hmac_12").limit(20),
    "auth surface": lambda m: auth_surface(m.nodes, m.edges),
    "privileged": lambda m: privileged_endpoints(m.nodes),
    "errors": lambda m: errored_endpoints(m.nodes),
    "third parties": lambda m: third_parties(m.nodes),
    "shape": lambda m: m.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")),
}


def ask(model, question: str) -> DataFrame:
    """The answer to one of ``QUESTIONS``; any other question is refused."""
    key = " ".join(question.lower().replace("-", " ").split()).rstrip("?")
    if key not in QUESTIONS:
        raise ValueError(f"not a known question: {question!r}; known: {', '.join(QUESTIONS)}")
    return QUESTIONS[key](model)


# ---- the package for a language model


def context_rows(nodes: DataFrame, edges: DataFrame, node_evidence: DataFrame, cap: int = CAP) -> DataFrame:
    """The first endpoints by priority, each with what names it and three requests to cite."""
    ranked = rank.priority(nodes).orderBy("rank", "label", "id").limit(cap)
    named = roll_up(nodes, edges, "REFERENCES").select("id", F.slice("labels", 1, RELATED).alias("referenced_by"))
    cited = first_evidence(node_evidence.join(ranked.select("id"), "id", "left_semi"), ["id"], CITED)
    return ranked.join(named, "id", "left").join(cited, "id", "left").select("rank", "id", "label", "api_state", "statuses", "referenced_by", "evidence")


def cited_requests(context: DataFrame, exchanges: DataFrame) -> DataFrame:
    """The requests that a context cites, all of them."""
    ids = context.select(F.explode("evidence").alias("id")).distinct()
    return exchanges.join(ids, "id", "left_semi")


def token_estimate(row: Column) -> Column:
    """A quarter of the length of the compact JSON."""
    return (F.length(F.to_json(row)) / 4).cast("long")
