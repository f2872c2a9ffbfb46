"""Captures and graphs made of star-schema, event, page and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.template import query_pairs, template_path
from trailmark.operators import contributions as c
from trailmark.schema import conform

SCOPE, PRIMARY = ["shop.test"], "h0.shop.test"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Small rows that take long to work on, dealt out to many tasks: a small file would be one.

    The number is given, or partitions would be joined by their bytes, which say little of the work.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def event_exchanges(spark: SparkSession, sf_dir: str, error_status: int = 500) -> DataFrame:
    """Events as requests: the type gives method, status and path, the user gives role, host and credentials."""
    e = table(spark, sf_dir, "events")
    area = F.when(F.col("event_type") == "purchase", "/admin/").otherwise("/api/")
    path = F.concat(area, "event_type", F.lit("/"), (F.col("event_id") % 7).cast("string"))
    creds = F.when(F.col("user_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("user_id") % 3 == 1, F.array(F.lit("cookie:sid"))).otherwise(F.array(F.lit("bearer"), F.lit("cookie:sid")))
    rows = e.select(
        F.col("event_id").alias("id"), F.lit("events").alias("source"), F.when(F.col("event_type").isin("signup", "purchase"), "POST").otherwise("GET").alias("method"), F.lit("https").alias("scheme"),
        F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string"), F.lit(".shop.test")).alias("host"), F.lit(443).alias("port"), path.alias("path"), template_path(path).alias("path_template"),
        F.when(F.col("event_type") == "error", error_status).when(F.col("event_type") == "signup", 201).otherwise(200).alias("status"), F.lit("application/json").alias("mime"),
        F.when(F.col("user_id") % 3 == 1, "user").when(F.col("user_id") % 3 == 2, "admin").alias("role"), creds.alias("credentials"), F.array(F.get_json_object("props", "$.k")).alias("body_params"),
        F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), 1).otherwise(2).alias("build"),
    )
    return rows


#: Kinds of recorded traffic that events stand for, by event_id modulo their number.
TRAFFIC = ("json", "page", "script", "graphql", "form")


def nested_body(event: str = "event_id", user: str = "user_id") -> Column:
    """A JSON text with an object in an object, a list of up to seven objects, a key that is a mail address and a deep chain."""
    items = F.concat(F.lit("["), F.concat_ws(",", F.transform(F.slice(F.sequence(F.lit(0), F.lit(6)), 1, (F.col(event) % 8).cast("int")), lambda i: F.concat(F.lit('{"sku":'), i.cast("string"), F.lit(',"n":[1,2]}')))), F.lit("]"))
    chain = F.concat(F.repeat(F.lit('{"d":'), F.lit(10) + F.col(user) % 4), F.lit("1"), F.repeat(F.lit("}"), F.lit(10) + F.col(user) % 4))
    return F.concat(F.lit('{"user":{"id":'), F.col(user).cast("string"), F.lit(',"seen":{"u'), F.col(user).cast("string"), F.lit('@corp.com":true}},"items":'), items, F.lit(',"none":null,"empty":{},"props":'), F.col("props"), F.lit(',"chain":'), chain, F.lit("}"))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw items of a capture: whole requests and responses of pages, scripts, forms, JSON and GraphQL calls."""
    e = dealt(table(spark, sf_dir, "events"), "event_id").withColumn("traffic", F.element_at(F.array(*map(F.lit, TRAFFIC)), (F.col("event_id") % len(TRAFFIC) + 1).cast("int")))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    kind, eid, uid = F.col("event_type"), F.col("event_id"), F.col("user_id")
    by = lambda **of: F.coalesce(*[F.when(F.col("traffic") == k, v if not isinstance(v, str) else F.lit(v)) for k, v in of.items()])
    host = text("h", uid % 2, ".shop.test")
    path = by(json=text("/api/", kind, "/", eid % 7), page=text("/app/", kind, "?tab=t", uid % 3, "&q=", eid), script=text("/static/", kind, ".js"), graphql="/graphql", form=text("/login/", eid))
    body = by(
        json=nested_body(), page="", script="", graphql=text('{"operationName":"Op', uid % 4, '","query":"query X { a }"}'), form=text("user=u", uid, "&pin=", eid, "&user=again"),
    )
    sent = by(json="application/json; charset=utf-8", page="", script="", graphql="application/json", form="application/x-www-form-urlencoded")
    creds = F.when(uid % 3 == 0, "").when(uid % 3 == 1, text("Cookie: sid=s", uid, "; theme=dark\r\n")).otherwise(text("Cookie: sid=s", uid, "\r\nAuthorization: Bearer b", uid, "\r\nX-API-Key: k", uid, "\r\n"))
    head = text(F.when(body == "", "GET ").otherwise("POST "), path, " HTTP/1.1\r\nHost: ", host, "\r\n", F.when(sent == "", "").otherwise(text("Content-Type: ", sent, "\r\n")), creds, F.when(eid % 3 == 0, text("Referer: https://", host, "/app/", kind, "?tab=t1\r\n")).otherwise(""), "\r\n")
    html = text('<html><meta name="generator" content="WordPress 6.', uid % 5, '"><form method=post action=/account/', kind, '></form><script src=/jquery-3.6.0.min.js></script><script>load("/api/inline")</script></html>')
    code = text('fetch("/api/v1/', kind, '/"+id,{method:"PUT"});axios.get("/api/list");new Worker("./w', uid % 3, '.js");navigator.serviceWorker.register("/sw.js");importScripts("https://cdn.test/x/../lib.js");\n//# sourceMappingURL=../maps/', kind, ".js.map")
    answer = by(json=text('{"mail":"m', uid, '@corp.com"}'), page=html, script=code, graphql="{}", form="5\r\nhello\r\n6\r\n world\r\n0\r\n\r\n")
    mime = by(json="application/json", page="text/html; charset=utf-8", script="application/javascript", graphql="application/json", form="text/plain")
    status = F.when(kind == "error", 500).when(kind == "signup", 201).otherwise(200)
    more = by(json="X-Powered-By: Express\r\n", page=text("Set-Cookie: sid=s", uid, "; Path=/; HttpOnly; SameSite=Lax\r\nSet-Cookie: PHPSESSID=x", uid, "; Secure\r\n"), script="X-SourceMap: /maps/extra.map\r\n", graphql="", form="Transfer-Encoding: chunked\r\n")
    reply = text("HTTP/1.1 ", status, " Some\r\nServer: nginx/1.2", uid % 3, ".0\r\nContent-Type: ", mime, "\r\n", more, "\r\n", answer)
    return e.select(
        text("https://", host, path).alias("url"), host.alias("host"), F.lit(443).alias("port"), F.when(body == "", "GET").otherwise("POST").alias("method"), F.lit("https").alias("scheme"), path.alias("path"),
        F.lit("").alias("mime"), F.lit(None).cast("int").alias("status"), F.encode(text(head, body), "UTF-8").alias("request"), F.encode(reply, "UTF-8").alias("response"), F.lit(False).alias("truncated"),
        F.lit("events").alias("source"), eid.alias("item"),
    )


def event_graph(spark: SparkSession, sf_dir: str, error_status: int = 500, build: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exchanges, nodes, edges) of the events, of one build if it is given."""
    rows = event_exchanges(spark, sf_dir, error_status)
    if build:
        rows = rows.filter(F.col("build") == build)
    x = c.classified(conform(rows), SCOPE, PRIMARY)
    return x, *c.graph_of(x)


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as GET requests."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/?#]*", ""), "#.*$", "")
    return p.select(
        F.col("page_id").alias("id"), F.lit("GET").alias("method"), F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("host"), path.alias("path"), template_path(path).alias("path_template"),
        F.lit(200).alias("status"), F.lit("text/html").alias("mime"), F.transform(query_pairs(path), lambda x: x["name"]).alias("query_params"), "html",
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) region -> nation -> customer -> order, and nation -> supplier."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda df, mark, key, kind, label: df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).cast("string").alias("label"))
    nodes = node(t("region"), "r", "r_regionkey", "host", "r_name")
    for name, mark, key, kind, label in (("nation", "n", "n_nationkey", "route", "n_name"), ("customer", "c", "c_custkey", "script", "c_name"), ("supplier", "s", "s_suppkey", "third_party", "s_name"), ("orders", "o", "o_orderkey", "endpoint", "o_orderkey")):
        nodes = nodes.unionByName(node(t(name), mark, key, kind, label))
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit("OBSERVED").alias("state"))
    edges = edge(t("nation"), "r", "n_regionkey", "n", "n_nationkey", "SERVES")
    edges = edges.unionByName(edge(t("customer"), "n", "c_nationkey", "c", "c_custkey", "INCLUDES")).unionByName(edge(t("supplier"), "n", "s_nationkey", "s", "s_suppkey", "LOADS"))
    return nodes, edges.unionByName(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey", "CALLS"))
