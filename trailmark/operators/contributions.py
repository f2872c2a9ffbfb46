"""What each exchange adds to the graph, as rows; nodes and edges are one aggregation over them.

Evidence (the ids of the requests behind a node or an edge) is a table of its own, since a busy host has a large share
of all requests; nodes and edges hold its size and its smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions import classify
from trailmark.functions.domains import in_scope
from trailmark.tables import settle

NODE = "id string, type string, layer int, label string, host string, path string, method string, location string, httponly boolean, secure boolean, samesite string, status int, cred string, anonymous int, main boolean, once boolean"
EDGE = "src string, dst string, type string, state string"
#: What exchanges that add the same to a graph have in common: all that contributions look at but the id.
SHAPE = ["role", "method", "host", "path_template", "status", "query_params", "body_params", "set_cookies", "credentials", "tech", "gql_ops", "first_party", "kind", "node_id", "prefix"]
#: What else exchanges have in common that add the same references, workers and ways from page to page.
LINKS = ["referer_host", "referer_path", "js_refs", "js_assets"]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _node(kind: str | Column, layer: int | Column, id_: Column, label: Column, **more: Column) -> Column:
    values = {"id": id_, "type": F.lit(kind) if isinstance(kind, str) else kind, "layer": F.lit(layer) if isinstance(layer, int) else layer, "label": label, "once": F.lit(True)} | more
    fields = [f.strip().split(" ") for f in NODE.split(",")]
    return F.struct(*[values.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in fields])


def _edge(src: Column, dst: Column, kind: str | Column, state: str = "OBSERVED") -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.lit(state).alias("state"))


def seed_host(exchanges: DataFrame, scope: list[str] | None = None) -> str | None:
    """The busiest host, of the scope if any host is in it; ties go to the first by name."""
    by = exchanges.filter("host is not null").groupBy("host").count()
    inside = in_scope(F.col("host"), scope) if scope else F.lit(False)
    top = by.orderBy(inside.desc(), F.desc("count"), "host").limit(1).collect()
    return top[0]["host"] if top else None


def classified(exchanges: DataFrame, scope: list[str], primary: str | None) -> DataFrame:
    """Exchanges with first_party, probe, kind and node_id (of the script, route or endpoint it is)."""
    x = exchanges.withColumn("first_party", in_scope(F.col("host"), scope)).withColumn("probe", classify.is_probe(F.col("method"), F.col("path")))
    kind = classify.row_class(F.col("method"), F.col("path_template"), F.col("mime"), F.col("status"), F.size("query_params"), F.col("preflight"))
    script = classify.is_script(F.col("mime"), F.col("path_template"))
    x = x.withColumn("kind", F.when(F.col("first_party"), kind).when(script, "script"))
    at = F.concat("host", "path_template")
    x = x.withColumn(
        "node_id",
        F.when(F.col("kind") == "script", _text("script:", at)).when(F.col("kind") == "route", _text("route:", at)).when(F.col("kind") == "endpoint", _text("endpoint:", F.col("method"), ":", F.col("host"), ":", F.col("path_template"))),
    )
    return x.withColumn("prefix", F.when(F.col("host") == F.lit(primary), "").otherwise(F.col("host")))


def _main() -> Column:
    name = F.element_at(F.split("path_template", "/"), -1)
    label = F.when(F.col("kind") == "script", F.when(name == "", "script.js").otherwise(name)).when(F.col("kind") == "route", F.concat("prefix", "path_template")).otherwise(
        F.concat(F.col("method"), F.lit(" "), F.col("prefix"), F.col("path_template"))
    )
    layer = F.when(F.col("kind") == "script", 3).when(F.col("kind") == "route", 2).otherwise(4)
    return _node(
        F.col("kind"), layer, F.col("node_id"), label, host=F.col("host"), path=F.when(F.col("kind") != "script", F.col("path_template")), method=F.when(F.col("kind") == "endpoint", F.col("method")),
        status=F.when(F.col("kind") != "script", F.col("status")), anonymous=F.when(F.col("kind") == "endpoint", (F.size("credentials") == 0).cast("int")), main=F.lit(True),
    )


def _cred_label(c: Column) -> Column:
    return (
        F.when(c.startswith("cookie:"), _text("session cookie ", F.substr(c, F.lit(8))))
        .when(c.startswith("header:"), _text("credential header ", F.substr(c, F.lit(8))))
        .when(c.startswith("query:"), _text("credential in query ", F.substr(c, F.lit(7))))
        .otherwise(_text("Authorization: ", c))
    )


def _params() -> Column:
    def named(params: str, where: str) -> Column:
        return F.transform(params, lambda p: F.struct(p.alias("name"), F.lit(where).alias("location")))

    return F.concat(named("query_params", "query"), named("body_params", "body"))


def _first(values: Column | str, value: Column, i: Column) -> Column:
    """Whether ``value``, at place i of an array of values, is not there before."""
    return F.array_position(F.col(values) if isinstance(values, str) else values, value) == i + 1


def _nodes() -> Column:
    fp, host = F.col("first_party"), F.col("host")
    mapped = F.col("node_id").isNotNull()
    paged = F.col("kind").isin("route", "endpoint")
    endpoint = F.col("kind") == "endpoint"
    none = F.array().cast(f"array<struct<{', '.join(': '.join(f.strip().split(' ')) for f in NODE.split(','))}>>")
    role = F.when(F.col("role").isNotNull(), F.array(_node("role", 5, _text("role:", F.col("role")), _text("role: ", F.col("role")))))
    place = F.array(F.when(fp, _node("host", 1, _text("host:", host), host)).otherwise(_node("third_party", 5, _text("host:", host), host)))
    tech = F.when(fp, F.transform("tech", lambda t, i: _node("tech", 1, _text("tech:", t["value"]), t["value"], location=t["header"], once=_first("tech.value", t["value"], i))))
    cookies = F.when(fp, F.transform("set_cookies", lambda c, i: _node("cookie", 5, _text("cookie:", c["name"]), c["name"], httponly=c["httponly"], secure=c["secure"], samesite=c["samesite"], once=_first("set_cookies.name", c["name"], i))))
    auth = F.when(endpoint, F.transform("credentials", lambda c, i: _node("auth", 5, _text("auth:", c), _cred_label(c), once=_first("credentials", c, i))))
    with_cred = F.when(endpoint, F.transform("credentials", lambda c: _node("endpoint", 4, F.col("node_id"), F.lit(None), cred=c, main=F.lit(False), once=F.lit(False))))
    ops = F.when(endpoint, F.transform("gql_ops", lambda o, i: _node("operation", 4, _text("op:", F.col("node_id"), ":", o), o, once=_first("gql_ops", o, i))))
    params = F.when(paged, F.transform(_params(), lambda p, i: _node("parameter", 4, _text("param:", F.col("node_id"), ":", p["name"]), p["name"], location=p["location"], once=_first(F.concat("query_params", "body_params"), p["name"], i))))
    parts = [role, place, tech, cookies, F.when(mapped, F.array(_main())), auth, with_cred, ops, params]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _edges() -> Column:
    fp, me, host = F.col("first_party"), F.col("node_id"), _text("host:", F.col("host"))
    paged, endpoint, mapped = F.col("kind").isin("route", "endpoint"), F.col("kind") == "endpoint", F.col("node_id").isNotNull()
    none = F.array().cast("array<struct<src: string, dst: string, type: string, state: string>>")
    held = F.when(F.col("kind") == "script", "LOADS").when(F.col("kind") == "route", "SERVES").otherwise("EXPOSES")
    parts = [
        F.when(mapped, F.array(_edge(host, me, held))),
        F.when(fp, F.transform("tech", lambda t: _edge(host, _text("tech:", t["value"]), "RUNS"))),
        F.when(fp, F.transform("set_cookies", lambda c: _edge(host, _text("cookie:", c["name"]), "SETS_COOKIE"))),
        F.when(endpoint, F.transform("credentials", lambda c: _edge(me, _text("auth:", c), "SENT_CREDENTIAL"))),
        F.when(endpoint, F.transform("gql_ops", lambda o: _edge(me, _text("op:", me, ":", o), "USES_OPERATION"))),
        F.when(fp & mapped & F.col("role").isNotNull(), F.array(_edge(_text("role:", F.col("role")), me, "REACHED"))),
        F.when(paged, F.transform(_params(), lambda p: _edge(me, _text("param:", me, ":", p["name"]), "USES_PARAMETER"))),
    ]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def shapes(x: DataFrame, links: bool = False) -> DataFrame:
    """Classified exchanges that add the same to a graph (with ``links``, by what they refer to as well) as one: ``id`` is the first of them, ``times`` their number.

    Tasks combine them before the shuffle, so a graph costs as much as there are different exchanges.
    """
    return x.filter(~F.col("probe")).groupBy(*SHAPE, *(LINKS if links else [])).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times")).withColumn("probe", F.lit(False))


def graph_of(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of classified exchanges; these are read once, however often the two are used."""
    s = settle(shapes(x), "shapes")
    return nodes_from(node_contributions(s)), edges_from(edge_contributions(s))


def _times(rows: DataFrame) -> Column:
    """How many exchanges a row stands for."""
    return F.coalesce(F.col("times"), F.lit(1)).cast("long") if "times" in rows.columns else F.lit(1).cast("long")


def node_contributions(x: DataFrame) -> DataFrame:
    """The node's fields, ev, pos (order within the exchange), role, and whether it is the exchange's first row of the node.

    An exchange has one ev, so evidence is counted by that mark and its rows need not meet before they are counted.
    """
    times = ["times"] if "times" in x.columns else []
    rows = x.filter(~F.col("probe")).select(F.col("id").alias("ev"), "role", "first_party", *times, F.posexplode(_nodes()).alias("pos", "n"))
    return rows.select("n.*", "ev", "pos", *times, F.when(F.col("first_party") & F.col("n.type").isin("route", "endpoint", "script", "operation"), F.col("role")).alias("role"))


def edge_contributions(x: DataFrame) -> DataFrame:
    """One row per exchange and edge: src, dst, type, state, ev."""
    times = ["times"] if "times" in x.columns else []
    return x.filter(~F.col("probe")).select(F.col("id").alias("ev"), *times, F.explode(F.array_distinct(_edges())).alias("e")).select("e.*", "ev", *times)


def nodes_from(contributions: DataFrame) -> DataFrame:
    """Nodes from their contributions: fields of the first request, sets and counts over all; ``once`` marks one row for each ev."""
    rank = F.when(F.lower("samesite") == "strict", 2).when(F.lower("samesite") == "lax", 1).otherwise(0)
    times = _times(contributions)
    count = lambda which: F.coalesce(F.sum(F.when(F.col(which), times)), F.lit(0))
    first = F.min_by(F.struct("type", "layer", "label", "host", "path", "method", "location"), F.struct(F.coalesce("main", F.lit(True)).cast("int") * -1, "ev", "pos"))
    return (
        contributions.groupBy("id")
        .agg(
            first.alias("first"), F.min("ev").alias("first_ev"), count("once").alias("n_evidence"),
            F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_set("cred")).alias("credentials"),
            count("main").alias("requests"), F.coalesce(F.sum(F.col("anonymous") * times), F.lit(0)).alias("anonymous_requests"),
            F.array_sort(F.collect_set(F.when(F.col("role").isNotNull() & F.col("status").isNotNull(), F.struct("role", "status")))).alias("status_by_role"),
            F.bool_and("httponly").alias("httponly"), F.bool_and("secure").alias("secure"), F.min_by("samesite", F.struct(rank, "ev", "pos")).alias("samesite"),
        )
        .select("id", "first.*", "first_ev", "n_evidence", "roles", "statuses", "credentials", "requests", "anonymous_requests", "status_by_role", "httponly", "secure", "samesite")
    )


def edges_from(contributions: DataFrame) -> DataFrame:
    """Edges from contributions of which each edge has one for an ev."""
    return contributions.groupBy("src", "dst", "type").agg(F.min_by("state", "ev").alias("state"), F.min("ev").alias("first_ev"), F.sum(_times(contributions)).alias("n_evidence"))


def secrets(exchanges: DataFrame) -> DataFrame:
    """Masked values by kind and fingerprint: how often and in which first ten requests."""
    rows = exchanges.select(F.col("id").alias("ev"), F.explode("secrets").alias("s")).select("ev", "s.*")
    counted = rows.groupBy("kind", "hmac_12").agg(F.count(F.lit(1)).alias("count"), F.min_by(F.struct("length", "entropy"), "ev").alias("f"))
    return counted.select("kind", "hmac_12", "f.length", "f.entropy", "count").join(first_evidence(rows, ["kind", "hmac_12"], 10), ["kind", "hmac_12"])


def first_evidence(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` smallest distinct ev of each key as a sorted array; tasks cut their part before the shuffle."""
    ranked = rows.select(*keys, "ev").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("ev"))).filter(F.col("k") <= most)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("ev")).alias("evidence"))
