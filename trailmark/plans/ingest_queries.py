"""Registered queries of what happens to a capture between its bytes and its graph, and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import domains, http
from trailmark.operators import content, extract, stack
from trailmark.plans import model
from trailmark.plans.registry import query
from trailmark.sources import captures, osint
from trailmark.sources import tables as t

IT = """it AS (
  SELECT event_id AS id, user_id AS uid, event_type AS kind, props, ['json', 'page', 'script', 'graphql', 'form'][event_id % 5 + 1] AS traffic, 'h' || (user_id % 2) || '.shop.test' AS host,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status FROM events)"""
#: Names of the values in the nested JSON text of an event, item by item.
LEAVES = """leaves AS (
  SELECT id, '$.user.id' AS name, uid::VARCHAR AS value FROM it UNION ALL SELECT id, '$.user.seen.{email}', 'true' FROM it UNION ALL SELECT id, '$.none', NULL FROM it
  UNION ALL SELECT id, '$.props.k', json_extract_string(props, '$.k') FROM it
  UNION ALL SELECT id, '$.items[' || i || '].' || f, CASE f WHEN 'sku' THEN i::VARCHAR WHEN 'n[0]' THEN '1' ELSE '2' END FROM it, (SELECT unnest([0, 1, 2, 3, 4]) AS i), (SELECT unnest(['sku', 'n[0]', 'n[1]']) AS f) WHERE i < id % 8
  UNION ALL SELECT id, '$.chain' || repeat('.d', (10 + uid % 4)::INT), '1' FROM it WHERE 1 + 10 + uid % 4 <= 12)"""


@query(f"WITH {IT}, {LEAVES} SELECT id AS event_id, name, value FROM leaves")
def json_parameters(spark, sf):
    """Parameters of nested JSON bodies: depth 12, five items of a list, keys that are values collapsed."""
    rows = t.dealt(t.table(spark, sf, "events"), "event_id").select("event_id", F.explode(http.body_params(t.nested_body(), F.lit("application/json"))).alias("p"))
    return rows.select("event_id", "p.name", "p.value")


def _exchanges(spark, sf, columns=None):
    return captures.exchanges(t.event_items(spark, sf), role="user", key=b"key", columns=columns)


@query(f"""WITH {IT}, {LEAVES}, named AS (SELECT id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM leaves GROUP BY id)
  SELECT it.id + 1 - (SELECT min(id) FROM it) AS id, CASE WHEN traffic IN ('page', 'script') THEN 'GET' ELSE 'POST' END AS method, host, status,
    CASE traffic WHEN 'json' THEN '/api/' || kind || '/{{id}}' WHEN 'page' THEN '/app/' || kind || '?tab=t' || (uid % 3) WHEN 'script' THEN '/static/' || kind || '.js' WHEN 'graphql' THEN '/graphql' ELSE '/login/{{id}}' END AS path_template,
    CASE traffic WHEN 'json' THEN 'application/json' WHEN 'graphql' THEN 'application/json' WHEN 'page' THEN 'text/html' WHEN 'script' THEN 'application/javascript' ELSE 'text/plain' END AS mime,
    CASE traffic WHEN 'page' THEN 'q,tab' ELSE '' END AS query_params, CASE traffic WHEN 'json' THEN names WHEN 'graphql' THEN '$.operationName,$.query' WHEN 'form' THEN 'pin,user' ELSE '' END AS body_params,
    CASE uid % 3 WHEN 0 THEN '' WHEN 1 THEN 'cookie:sid' ELSE 'bearer,cookie:sid,header:x-api-key' END AS credentials, CASE WHEN it.id % 3 = 0 THEN host END AS referer_host, CASE WHEN it.id % 3 = 0 THEN '/app/' || kind || '?tab=t1' END AS referer_path,
    CASE traffic WHEN 'graphql' THEN 'Op' || (uid % 4) ELSE '' END AS gql_ops
  FROM it JOIN named ON named.id = it.id""".replace("{{", "{").replace("}}", "}"))
def ingested_requests(spark, sf):
    """The request side of exchanges that are decoded from whole messages."""
    joined = lambda c: F.concat_ws(",", F.array_sort(c)).alias(c)
    return _exchanges(spark, sf).select("id", "method", "host", "status", "path_template", "mime", joined("query_params"), joined("body_params"), joined("credentials"), "referer_host", "referer_path", joined("gql_ops"))


@query(f"""WITH {IT} SELECT id + 1 - (SELECT min(id) FROM it) AS id,
    CASE traffic WHEN 'page' THEN 'PHPSESSID false true ,sid true false Lax' ELSE '' END AS cookies,
    array_to_string(list_sort(list_filter(['Web server nginx 1.2' || (uid % 3) || '.0', CASE WHEN traffic = 'json' THEN 'Language & framework Express ' END, CASE WHEN traffic = 'page' THEN 'CMS & platform WordPress 6.' || (uid % 5) END,
      CASE WHEN traffic = 'page' THEN 'Frontend jQuery 3.6.0' END, CASE WHEN traffic = 'page' THEN 'Language & framework PHP ' END, CASE WHEN traffic = 'graphql' THEN 'API GraphQL ' END], lambda x: x IS NOT NULL)), ',') AS stack,
    CASE traffic WHEN 'page' THEN ' /api/inline string,POST /account/' || kind || ' form' WHEN 'script' THEN 'GET /api/list call,PUT /api/v1/' || kind || '/{{param}} call' ELSE '' END AS refs,
    CASE traffic WHEN 'script' THEN array_to_string(list_sort(['import_scripts cdn.test /x/../lib.js', 'service_worker ' || host || ' /sw.js', 'sourcemap ' || host || ' /maps/' || kind || '.js.map', 'sourcemap ' || host || ' /maps/extra.map', 'worker ' || host || ' /static/w' || (uid % 3) || '.js']), ',') ELSE '' END AS assets,
    CASE traffic WHEN 'json' THEN '{{"mail":"[REDACTED:email]"}}' WHEN 'graphql' THEN '{{}}' WHEN 'form' THEN 'hello world' ELSE '' END AS body
  FROM it""".replace("{{", "{").replace("}}", "}"))
def ingested_responses(spark, sf):
    """The response side: cookies with flags, technologies, references, workers and source maps, masked bodies."""
    x = _exchanges(spark, sf, ["id", "mime", "set_cookies", "stack", "js_refs", "js_assets", "resp.body"])
    told = lambda c, *fields: F.concat_ws(",", F.array_sort(F.transform(c, lambda v: F.concat_ws(" ", *[F.coalesce(v[f].cast("string"), F.lit("")) for f in fields])))).alias(c)
    code = F.col("mime").isin("text/html", "application/javascript")
    return x.select("id", told("set_cookies", "name", "httponly", "secure", "samesite").alias("cookies"), told("stack", "category", "name", "version"), told("js_refs", "method", "path", "kind").alias("refs"), told("js_assets", "kind", "host", "path").alias("assets"), F.when(code, "").otherwise(F.col("resp.body")).alias("body"))


@query(f"""WITH {IT}, scripts AS (SELECT DISTINCT 'script:' || host || '/static/' || kind || '.js' AS src, host, kind FROM it WHERE traffic = 'script')
  SELECT 'SPAWNS' AS what, 'script:' || host || '/static/' || kind || '.js' AS entity, 'script:' || host || '/static/w' || (uid % 3) || '.js' AS other, count(*) AS n FROM it WHERE traffic = 'script' GROUP BY ALL
  UNION ALL SELECT 'SPAWNS', 'script:' || host || '/static/' || kind || '.js', 'script:' || host || '/sw.js', count(*) FROM it WHERE traffic = 'script' GROUP BY ALL
  UNION ALL SELECT 'SOURCE_MAP_NOT_CAPTURED', src, 'a source map is named: /maps/' || kind || '.js.map', 1 FROM scripts UNION ALL SELECT 'SOURCE_MAP_NOT_CAPTURED', src, 'a source map is named: /maps/extra.map', 1 FROM scripts""")
def script_assets(spark, sf):
    """A build from whole messages: workers that scripts start, with how many requests showed it, and source maps that were not captured."""
    built = model.build(_exchanges(spark, sf, captures.GRAPH), "events", t.SCOPE, t.PRIMARY)
    spawned = built.edges.filter("type = 'SPAWNS'").select(F.col("type").alias("what"), F.col("src").alias("entity"), F.col("dst").alias("other"), F.col("n_evidence").alias("n"))
    maps = built.unknowns.filter("type = 'SOURCE_MAP_NOT_CAPTURED'").select(F.col("type").alias("what"), "entity", F.element_at("we_know", 1).alias("other"), F.lit(1).cast("long").alias("n"))
    return spawned.unionByName(maps)


@query(f"""WITH {IT} SELECT category, name, version, any_value(how) AS how, count(*) AS n FROM (
    SELECT 'Web server' AS category, 'nginx' AS name, '1.2' || (uid % 3) || '.0' AS version, 'header:server' AS how FROM it UNION ALL SELECT 'Language & framework', 'Express', '', 'header:x-powered-by' FROM it WHERE traffic = 'json'
    UNION ALL SELECT 'CMS & platform', 'WordPress', '6.' || (uid % 5), 'meta generator' FROM it WHERE traffic = 'page' UNION ALL SELECT 'Frontend', 'jQuery', '3.6.0', 'page' FROM it WHERE traffic = 'page'
    UNION ALL SELECT 'Language & framework', 'PHP', '', 'cookie' FROM it WHERE traffic = 'page' UNION ALL SELECT 'API', 'GraphQL', '', 'path' FROM it WHERE traffic = 'graphql') GROUP BY category, name, version""")
def technologies(spark, sf):
    """Technologies of all responses with their versions, by the rule that told."""
    found = captures.technologies(t.event_items(spark, sf))
    return found.groupBy("category", "name", "version").agg(F.min("how").alias("how"), F.sum("times").alias("n"))


@query(r"""WITH r AS (SELECT page_id, html, ['nginx/1.25', 'cloudflare', 'Cowboy', 'x'][page_id % 4 + 1] AS server FROM pages) SELECT name, evidence, count(*) AS n FROM (
    SELECT unnest(list_filter([CASE server WHEN 'nginx/1.25' THEN {'name': 'nginx', 'evidence': 'header:server'} WHEN 'cloudflare' THEN {'name': 'Cloudflare', 'evidence': 'header:server'} WHEN 'Cowboy' THEN {'name': 'Cowboy/Erlang', 'evidence': 'header:server'} END,
      CASE WHEN page_id % 3 = 0 THEN {'name': 'Django', 'evidence': 'header:set-cookie'} END, CASE WHEN regexp_matches(html, '(?i)/_next/static/') THEN {'name': 'Next.js', 'evidence': 'body'} END,
      CASE WHEN regexp_matches(html, '(?i)wp-content/|wp-includes/') THEN {'name': 'WordPress', 'evidence': 'body'} END, CASE WHEN page_id % 5 = 0 THEN {'name': 'Hugo 0.1', 'evidence': 'meta:generator'} END], lambda x: x IS NOT NULL), recursive := true) FROM r) GROUP BY name, evidence""")
def open_technologies(spark, sf):
    """Technologies of pages as a collector from open sources names them."""
    p = t.table(spark, sf, "pages")
    server = F.element_at(F.array(*map(F.lit, ("nginx/1.25", "cloudflare", "Cowboy", "x"))), (F.col("page_id") % 4 + 1).cast("int"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array(pair("Server", server), pair("Set-Cookie", F.when(F.col("page_id") % 3 == 0, "csrftoken=x; Path=/").otherwise("a=b")))
    html = F.concat("html", F.when(F.col("page_id") % 5 == 0, '<META name="generator" content="Hugo 0.1">').otherwise(""))
    found = p.select(F.explode(stack.open_technologies(headers, html)).alias("t")).select("t.*")
    return found.groupBy("name", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {IT} SELECT id AS event_id, CASE traffic WHEN 'script' THEN 'GET /api/list,PUT /api/v1/' || kind || '/{{param}}' WHEN 'page' THEN ' /api/inline' ELSE '' END AS refs, CASE WHEN traffic = 'script' THEN CAST(4 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS n_assets FROM it""".replace("{{", "{").replace("}}", "}"))
def scanned_once(spark, sf):
    """References of all response bodies, from one scan of each distinct body."""
    items = t.event_items(spark, sf)
    rows = items.select(F.col("item").alias("event_id"), F.decode(http.body_bytes(F.col("response")), "UTF-8").alias("body"))
    found = content.scanned_once(rows, "body", content.script_scan)
    refs = F.concat_ws(",", F.array_sort(F.transform("refs", lambda r: F.concat_ws(" ", F.coalesce(r["method"], F.lit("")), r["path"]))))
    return found.select("event_id", refs.alias("refs"), F.size("assets").alias("n_assets"))


@query("""SELECT 'run' || c_custkey AS run, c_name AS host, 'n' || c_nationkey AS ns, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::INT::VARCHAR END AS days, least(25, c_custkey % 30)::INT AS sampled, CASE WHEN c_custkey % 30 <> 0 THEN (c_custkey % 30)::VARCHAR END AS counted,
    c_mktsegment AS registrar, CASE WHEN c_custkey % 2 = 0 THEN '443,80' ELSE '' END AS ports, CASE WHEN c_custkey % 3 = 0 THEN 'nginx' ELSE '' END AS technology, c_custkey % 3 = 0 AS has_technology FROM customer""")
def open_source_summaries(spark, sf):
    """Saved results about hosts, trimmed for a package and read back."""
    cust = t.table(spark, sf, "customer")
    key = F.col("c_custkey")
    names = F.transform(F.slice(F.sequence(F.lit(1), F.lit(30)), 1, (key % 30).cast("int")), lambda i: F.concat(F.lit("s"), i.cast("string")))
    report = F.struct(
        F.col("c_name").alias("host"), F.struct(F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("NS"), F.array().cast("array<string>").alias("MX")).alias("dns"),
        F.struct(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("int")).alias("days_until_expiry")).alias("tls"), F.struct(F.when(key % 30 != 0, (key % 30).cast("int")).alias("count"), names.alias("names")).alias("subdomains"),
        F.struct(F.col("c_mktsegment").alias("registrar")).alias("registration"), F.struct(F.when(key % 2 == 0, F.array(F.struct(F.lit(443).alias("port")), F.struct(F.lit(80).alias("port")))).alias("open")).alias("ports"),
        F.when(key % 3 == 0, F.array(F.struct(F.lit("nginx").alias("name"), F.lit("header:server").alias("evidence")))).alias("technology"),
    )
    raw = cust.select(F.concat(F.lit("run"), key.cast("string")).alias("run"), F.to_json(report).alias("value"))
    view = "host string, dns struct<NS: array<string>, MX: array<string>>, tls struct<days_until_expiry: string>, subdomains_count int, subdomains_sample array<string>, registrar string, open_ports array<int>, technology array<string>"
    s = osint.summary(raw).select("run", F.from_json("summary", view).alias("s")).select("run", "s.*")
    joined = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return s.select("run", "host", F.col("dns.NS")[0].alias("ns"), F.col("tls.days_until_expiry").alias("days"), F.coalesce(F.size("subdomains_sample"), F.lit(0)).alias("sampled"), F.col("subdomains_count").cast("string").alias("counted"), "registrar", joined("open_ports").alias("ports"), joined("technology").alias("technology"), F.col("technology").isNotNull().alias("has_technology"))


@query("""WITH h AS (SELECT s_suppkey, ['xn--bcher-kva', 'xn--mnchen-3ya', 'plain', 'xn--r8jz45g'][s_suppkey % 4 + 1] AS name, ['de', 'xn--p1ai', 'co.uk'][s_suppkey % 3 + 1] AS suffix FROM supplier)
  SELECT s_suppkey, 'www.' || name || '.' || suffix AS host, name || '.' || suffix AS domain, name = 'xn--bcher-kva' AND suffix = 'de' AS in_scope FROM h""")
def international_hosts(spark, sf):
    """Hosts with international labels, in capitals and not, against rules and a scope that are written in letters."""
    key = F.col("s_suppkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    host = F.concat(F.lit("WWW."), pick(("Bücher", "mÜnchen", "plain", "例え")), F.lit("."), pick(("de", "рф", "co.uk")))
    rows = t.table(spark, sf, "supplier").select("s_suppkey", domains.ascii_host(host).alias("host"))
    return rows.select("s_suppkey", "host", domains.registrable_domain(F.col("host"), [*domains.SUFFIXES, "рф"]).alias("domain"), domains.in_scope(F.col("host"), ["https://*.bücher.de/"]).alias("in_scope"))


@query("""SELECT page_id, 'https://shop.test/map' || (page_id % 3) || '.xml' AS sitemap, url AS page, page_id::VARCHAR || '?a=1&b=2' AS last FROM pages""")
def sitemaps(spark, sf):
    """Site maps that a robots.txt names, and the pages that they list."""
    p = t.table(spark, sf, "pages")
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\nSITEMAP:  https://shop.test/map"), (F.col("page_id") % 3).cast("string"), F.lit(".xml\n"))
    xml = F.concat(F.lit("<urlset><url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><LOC>\n"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2 </LOC></url></urlset>"))
    listed = extract.sitemap_pages(xml)
    return p.select("page_id", extract.sitemaps(robots)[0].alias("sitemap"), listed[0].alias("page"), listed[1].alias("last"))
