"""Registered queries of the capture operators over the tables, and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions import redact
from trailmark.functions.domains import in_scope, registrable_domain
from trailmark.functions.template import match_key, route_template
from trailmark.functions.text import entropy
from trailmark.operators import contributions, drift, extract, fold, rank, reason, references, roles, stack, traverse, views
from trailmark.operators.filters import run_filter, term, text, with_ends
from trailmark.plans import model
from trailmark.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from trailmark.schema import conform
from trailmark.sinks import graph as sink
from trailmark.sources import tables as t
from trailmark.streaming import live

EX = """ex AS (
  SELECT event_id AS id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method, 'h' || (user_id % 2) || '.shop.test' AS host,
    CASE WHEN event_type = 'purchase' THEN '/admin/' ELSE '/api/' END || event_type || '/' || (event_id % 7) AS path, CASE WHEN event_type = 'purchase' THEN '/admin/' ELSE '/api/' END || event_type || '/{id}' AS template,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status, CASE user_id % 3 WHEN 1 THEN 'user' WHEN 2 THEN 'admin' END AS role,
    CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_creds, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS build, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
ep AS (SELECT *, 'endpoint:' || method || ':' || host || ':' || template AS nid, method || ' ' || CASE WHEN host = 'h0.shop.test' THEN '' ELSE host END || template AS label FROM ex)"""
PG = r"""pg AS (
  SELECT page_id AS id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '#.*$', '') AS path, html FROM pages),
pt AS (SELECT *, CASE WHEN regexp_replace(path, '\?.*$', '') = '' THEN '/' ELSE array_to_string(list_transform(string_split(regexp_replace(path, '\?.*$', ''), '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{id}' ELSE s END), '/') END AS template FROM pg)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(t.event_exchanges(spark, sf_dir))


# ---- filters


@query(f"WITH {EX} SELECT id, method, status, path FROM ex WHERE method = 'POST' AND status >= 201")
def filter_requests(spark, sf):
    return run_filter(_requests(spark, sf), term("req.method", "eq", "post") & term("resp.code", "gte", 201)).select("id", "method", "status", "path")


@query(f"WITH {EX} SELECT id FROM ex WHERE NOT (role = 'admin')")
def filter_not_of_null(spark, sf):
    return run_filter(_requests(spark, sf), ~term("role", "eq", "ADMIN")).select("id")


@query(f"WITH {EX} SELECT id, role FROM ex WHERE role IS NULL OR role <> 'user'")
def filter_ne_of_null(spark, sf):
    return run_filter(_requests(spark, sf), term("role", "ne", "user")).select("id", "role")


@query(f"WITH {EX} SELECT id, path FROM ex WHERE path LIKE '%/purchase/%'")
def filter_like(spark, sf):
    return run_filter(_requests(spark, sf), term("req.path", "like", "*/PURCHASE/*")).select("id", "path")


@query(f"WITH {EX} SELECT id, path FROM ex WHERE regexp_matches(path, '/(click|view)/[3-5]$')")
def filter_regex(spark, sf):
    return run_filter(_requests(spark, sf), term("req.path", "regex", "/(CLICK|view)/[3-5]$")).select("id", "path")


@query(f"WITH {EX} SELECT id FROM ex WHERE path LIKE '%signup%' OR NOT host LIKE '%h1.%'")
def filter_text_or_ncont(spark, sf):
    return run_filter(_requests(spark, sf), text("SignUp") | term("req.host", "ncont", "H1.")).select("id")


@query(f"WITH {EX}, n AS (SELECT nid, any_value(label) AS label, count(*) AS requests, list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)) AS roles FROM ep GROUP BY nid) SELECT nid AS id, label, requests FROM n WHERE requests > 100 AND list_contains(roles, 'admin')")
def filter_nodes(spark, sf):
    _, nodes, _ = t.event_graph(spark, sf)
    return run_filter(nodes, term("node.requests", "gt", 100) & term("node.role", "eq", "Admin"), "nodes").select("id", "label", "requests")


@query(f"WITH {EX} SELECT 'host:' || host AS src, nid AS dst, 'h' || substr(host, 2) AS src_label, any_value(label) AS dst_label FROM ep WHERE method = 'POST' GROUP BY host, nid")
def filter_edges(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf)
    ends = with_ends(edges.select("src", "dst", "type", "state"), nodes.select("id", "type", "label"))
    return run_filter(ends, term("edge.type", "eq", "exposes") & term("edge.dst_label", "like", "post *")).select("src", "dst", "src_label", "dst_label")


# ---- graph


@query(f"WITH {EX} SELECT nid AS id, any_value(label) AS label, count(*) AS requests, count(*) FILTER (n_creds = 0) AS anonymous_requests, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, coalesce(array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ','), '') AS roles, min(id) AS first_ev, count(DISTINCT id) AS n_evidence FROM ep GROUP BY nid")
def endpoint_metrics(spark, sf):
    _, nodes, _ = t.event_graph(spark, sf)
    e = nodes.filter("type = 'endpoint'")
    return e.select("id", "label", "requests", "anonymous_requests", F.concat_ws(",", F.col("statuses").cast("array<string>")).alias("statuses"), F.concat_ws(",", "roles").alias("roles"), "first_ev", "n_evidence")


@query(f"""WITH {EX}, kinds AS (SELECT 'host' AS type, host AS k FROM ex UNION SELECT 'endpoint', nid FROM ep UNION SELECT 'role', role FROM ex WHERE role IS NOT NULL UNION SELECT 'auth', 'cookie:sid' FROM ex WHERE n_creds >= 1 UNION SELECT 'auth', 'bearer' FROM ex WHERE n_creds = 2
  UNION SELECT 'parameter', nid || ':' || k FROM ep WHERE k IS NOT NULL) SELECT type, count(*) AS n FROM kinds GROUP BY type""")
def graph_shape(spark, sf):
    _, nodes, _ = t.event_graph(spark, sf)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EX} SELECT type, count(DISTINCT src || '>' || dst) AS n_edges, count(*) AS n_evidence FROM (SELECT 'EXPOSES' AS type, host AS src, nid AS dst, id FROM ep UNION SELECT 'REACHED', role, nid, id FROM ep WHERE role IS NOT NULL UNION SELECT 'SENT_CREDENTIAL', nid, 'cookie:sid', id FROM ep WHERE n_creds >= 1 UNION SELECT 'SENT_CREDENTIAL', nid, 'bearer', id FROM ep WHERE n_creds = 2 UNION SELECT 'USES_PARAMETER', nid, k, id FROM ep WHERE k IS NOT NULL) GROUP BY type")
def graph_edges(spark, sf):
    _, _, edges = t.event_graph(spark, sf)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("n_evidence").alias("n_evidence"))


@query(f"WITH {EX} SELECT nid || '|' || role || '|' || status AS key, count(*) AS n FROM ep WHERE role IS NOT NULL GROUP BY ALL")
def status_by_role(spark, sf):
    x, _, _ = t.event_graph(spark, sf)
    rows = x.filter("role is not null and node_id is not null")
    return rows.groupBy(F.concat_ws("|", "node_id", "role", F.col("status").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EX} SELECT nid AS id FROM (SELECT nid, bool_and(CASE WHEN event_type = 'error' THEN true ELSE false END) AS dead FROM ep GROUP BY nid) WHERE NOT dead")
def pruned_endpoints(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf, error_status=404)
    kept, _ = references.prune(nodes, edges)
    return kept.filter("type = 'endpoint'").select("id")


REFS = "refs AS (SELECT DISTINCT '/api/' || event_type || '/{param}' AS path, CASE WHEN event_type = 'signup' THEN 'POST' END AS method FROM events WHERE event_type IN ('click', 'signup') UNION SELECT '/api/' || lower(replace(r_name, ' ', '-')), NULL FROM region)"


@query(f"""WITH {EX}, {REFS}, hits AS (SELECT DISTINCT e.nid FROM refs r JOIN ep e ON replace(r.path, '{{param}}', '{{}}') = replace(e.template, '{{id}}', '{{}}') AND (r.method IS NULL OR r.method = e.method)),
  lost AS (SELECT DISTINCT 'endpoint:*:h0.shop.test:' || r.path AS nid FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ep e WHERE replace(r.path, '{{param}}', '{{}}') = replace(e.template, '{{id}}', '{{}}') AND (r.method IS NULL OR r.method = e.method)))
  SELECT DISTINCT nid AS id, CASE WHEN nid IN (SELECT nid FROM hits) THEN 'BOTH' ELSE 'RUNTIME_ONLY' END AS api_state FROM ep UNION ALL SELECT nid, 'STATIC_ONLY' FROM lost""")
def reconciled_states(spark, sf):
    nodes, _ = _with_references(spark, sf)
    return nodes.filter("type = 'endpoint'").select("id", "api_state")


def _with_references(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf)
    e = t.table(spark, sf, "events").filter(F.col("event_type").isin("click", "signup")).select(F.concat(F.lit("/api/"), "event_type", F.lit("/{param}")).alias("path"), F.when(F.col("event_type") == "signup", "POST").alias("method")).distinct()
    r = t.table(spark, sf, "region").select(F.concat(F.lit("/api/"), F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))).alias("path"), F.lit(None).cast("string").alias("method"))
    refs = e.unionByName(r).select(F.lit("script:h0.shop.test/app.js").alias("src"), F.lit(True).alias("first_party"), F.lit(t.PRIMARY).alias("base_host"), F.lit(0).cast("long").alias("ev"), "method", F.lit(None).cast("string").alias("host"), "path")
    linked, named = references.linked_references(refs, nodes, t.SCOPE, t.PRIMARY)
    new = named.filter("type is not null").dropDuplicates(["id"]).drop("ev")
    all_edges = edges.select("src", "dst", "type", "state").unionByName(linked.select("src", "dst", "type", "state").distinct())
    return references.reconcile(nodes.unionByName(new.withColumn("requests", F.lit(0).cast("long")), allowMissingColumns=True), all_edges), all_edges


@query(f"WITH {EX}, {REFS} SELECT '* ' || r.path AS label, 'script:h0.shop.test/app.js' AS referenced_by FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ep e WHERE replace(r.path, '{{param}}', '{{}}') = replace(e.template, '{{id}}', '{{}}') AND (r.method IS NULL OR r.method = e.method))")
def static_only_endpoints(spark, sf):
    nodes, edges = _with_references(spark, sf)
    script = nodes.limit(0).select("id", "type", "label", "api_state").unionByName(spark.createDataFrame([("script:h0.shop.test/app.js", "script", "script:h0.shop.test/app.js", None)], "id string, type string, label string, api_state string"))
    found = traverse.static_only(nodes.select("id", "type", "label", "api_state").unionByName(script), edges)
    return found.select("label", F.concat_ws(",", "referenced_by").alias("referenced_by"))


@query(f"WITH {EX}, {REFS} SELECT 'API_PURPOSE_UNKNOWN' AS type, 'endpoint:*:h0.shop.test:' || path AS entity FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ep e WHERE replace(r.path, '{{param}}', '{{}}') = replace(e.template, '{{id}}', '{{}}') AND (r.method IS NULL OR r.method = e.method)) UNION ALL SELECT DISTINCT 'ENDPOINT_ONLY_ERRORED', nid FROM ep WHERE event_type = 'error' UNION ALL SELECT DISTINCT 'AUTHORIZATION_UNKNOWN', nid FROM ep WHERE role IS NOT NULL")
def open_questions(spark, sf):
    nodes, _ = _with_references(spark, sf)
    return references.unknowns(nodes.withColumn("roles", F.coalesce("roles", F.array().cast("array<string>"))), "events", True, True).select("type", "entity")


@query(f"WITH {EX} SELECT 'node' AS kind, count(DISTINCT nid) AS n FROM ep")
def full_build(spark, sf):
    built = model.build(t.event_exchanges(spark, sf), "events", t.SCOPE, t.PRIMARY)
    return built.nodes.filter("type = 'endpoint'").agg(F.lit("node").alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n")


# ---- paths, hosts and text


@query(f"WITH {PG} SELECT id, template FROM pt")
def path_templates(spark, sf):
    return t.page_requests(spark, sf).select("id", F.col("path_template").alias("template"))


@query(f"WITH {PG} SELECT id, template FROM pt")
def route_templates(spark, sf):
    return t.page_requests(spark, sf).select("id", route_template(F.col("path"), F.col("path_template")).alias("template"))


@query(rf"WITH {PG} SELECT id, CASE WHEN k = '' THEN '/' ELSE k END AS key FROM (SELECT id, regexp_replace(replace(template, '{{id}}', '{{}}'), '/+$', '') AS k FROM pt)")
def match_keys(spark, sf):
    return t.page_requests(spark, sf).select("id", match_key(F.col("path_template")).alias("key"))


@query(f"WITH {PG} SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS suffix_domain, count(*) AS n FROM pg WHERE host LIKE '%.example.com' OR host LIKE '%.example.net' OR host LIKE '%.example.org' GROUP BY ALL")
def registrable_domains(spark, sf):
    p = t.page_requests(spark, sf).filter(F.col("host").rlike(r"\.example\.(com|net|org)$"))
    return p.groupBy("host", registrable_domain(F.col("host")).alias("suffix_domain")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PG} SELECT host, host = 'example.com' OR host LIKE '%.example.com' AS first_party, count(*) AS requests FROM pg GROUP BY ALL")
def scope_by_host(spark, sf):
    return t.page_requests(spark, sf).groupBy("host", in_scope(F.col("host"), ["*.example.com"]).alias("first_party")).agg(F.count(F.lit(1)).alias("requests"))


@query(f"WITH {PG} SELECT host AS label, count(*) AS requests FROM pg WHERE NOT (host = 'example.com' OR host LIKE '%.example.com') GROUP BY host")
def third_party_requests(spark, sf):
    x = contributions.classified(conform(t.page_requests(spark, sf)), ["example.com"], None)
    nodes, _ = contributions.graph_of(x)
    return nodes.filter("type = 'third_party'").select("label", F.col("n_evidence").alias("requests"))


@query("SELECT page_id AS id, round(-(SELECT sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / length(url) AS p FROM (SELECT unnest(string_split(url, '')) AS ch) GROUP BY ch)), 6) AS entropy FROM pages")
def url_entropy(spark, sf):
    return t.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.round(entropy(F.col("url")), 6).alias("entropy"))


LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 END)) % 10 = 0"


@query(rf"""WITH c AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '\b(?:\d[ -]?){{13,19}}\b'), lambda r: regexp_replace(r, '\D', '', 'g'))) AS d FROM documents),
  ok AS (SELECT doc_id, count(*) AS n FROM c WHERE length(d) BETWEEN 13 AND 19 AND NOT (length(d) = 13 AND d LIKE '1%') AND {LUHN} GROUP BY doc_id)
  SELECT d.doc_id, len(regexp_extract_all(d.text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')) AS n_email, coalesce(ok.n, 0) AS n_card FROM documents d LEFT JOIN ok USING (doc_id)""")
def masked_values(spark, sf):
    found = redact.found_values(F.col("text"))
    n = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    return t.table(spark, sf, "documents").select("doc_id", n("email").alias("n_email"), n("card").alias("n_card"))


@query(r"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS v FROM documents) SELECT sha256(v) AS fingerprint, length(v) AS length, count(*) AS count, min(doc_id) AS first_doc FROM e GROUP BY v")
def secrets_by_value(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", F.explode(F.filter(redact.found_values(F.col("text")), lambda x: x["kind"] == "email")).alias("x"))
    return d.groupBy(F.sha2("x.value", 256).alias("fingerprint"), F.length("x.value").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("first_doc"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(m, '@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 1 ELSE 0 END AS left_over, length(m) - length(replace(m, '[REDACTED:email]', '')) AS masked FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g') AS m FROM documents)")
def masked_texts(spark, sf):
    m = redact.mask_values(F.coalesce("text", F.lit("")))
    d = t.table(spark, sf, "documents").select("doc_id", m.alias("m"))
    return d.select("doc_id", F.when(F.col("m").rlike(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 1).otherwise(0).alias("left_over"), (F.length("m") - F.length(F.replace("m", F.lit("[REDACTED:email]"), F.lit("")))).cast("long").alias("masked"))


# ---- pages


@query("SELECT page_id AS id, len(l) AS n_links, len(list_distinct(l)) AS n_distinct FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), lambda u: regexp_replace(trim(u), '#.*$', '')), lambda u: u <> '') AS l FROM pages)")
def page_links(spark, sf):
    found = extract.links(F.col("html"))
    return t.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.size(found).cast("long").alias("n_links"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@query(rf"""WITH {PG}, a AS (SELECT id AS seq, host, regexp_replace(path, '\?.*$', '') AS path, CASE WHEN path LIKE '%?%' THEN regexp_replace(path, '^[^?]*\?', '') ELSE '' END AS query, template FROM pt),
  b AS (SELECT *, CASE WHEN host <> 'blog.tionsh.example.net' THEN 'out_of_scope' END AS r0, row_number() OVER (PARTITION BY host, path, query ORDER BY seq) AS dup FROM a),
  c AS (SELECT *, CASE WHEN r0 IS NULL AND dup > 1 THEN 'duplicate' ELSE r0 END AS r1 FROM b),
  d AS (SELECT *, CASE WHEN r1 IS NULL AND sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY host, path ORDER BY seq) > 15 THEN 'variant_cap' ELSE r1 END AS r2 FROM c),
  e AS (SELECT *, CASE WHEN r2 IS NULL AND sum(CASE WHEN r2 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY seq) > 5 THEN 'template_cap' ELSE r2 END AS r3 FROM d)
  SELECT seq, host, path, coalesce(r3, 'ok') AS reason FROM e""")
def crawl_admission(spark, sf):
    p = t.page_requests(spark, sf)
    links = p.select(F.col("id").alias("seq"), "host", F.substring_index("path", "?", 1).alias("path"), F.when(F.contains("path", F.lit("?")), F.regexp_replace("path", r"^[^?]*\?", "")).otherwise("").alias("query"))
    return extract.admitted(links, "blog.tionsh.example.net", per_template=5).select("seq", "host", "path", "reason")


@query(rf"""WITH {PG}, s AS (SELECT host, 200 // 100 AS class, list_filter(string_split(regexp_replace(path, '\?.*$', ''), '/'), lambda x: x <> '') AS segs FROM pg),
  p AS (SELECT host, class, unnest(list_transform(range(0, len(segs) + 1), lambda k: '/' || array_to_string(list_slice(segs, 1, k), '/'))) AS prefix FROM s) SELECT host, prefix, count(*) AS n_requests, max(class)::INT AS worst FROM p GROUP BY host, prefix""")
def site_tree(spark, sf):
    return views.site_tree(t.page_requests(spark, sf).withColumn("path", F.substring_index("path", "?", 1)))


@query(f"WITH {EX} SELECT (status // 100)::INT AS class, count(*) AS n FROM ex GROUP BY 1")
def response_mix(spark, sf):
    return views.response_mix(_requests(spark, sf))


@query(f"WITH {EX} SELECT id FROM ex WHERE method = 'GET' AND status // 100 = 2 AND role = 'user' AND path LIKE '/api/v%'")
def inventory(spark, sf):
    return views.inventory(_requests(spark, sf), methods=["GET"], classes=[2], role="user", prefix="/api/v").select("id")


@query("""WITH h AS (SELECT 'cdn' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.stripe.com' WHEN 1 THEN '.google-analytics.com' WHEN 2 THEN '.cloudfront.net' ELSE '.nowhere.test' END AS host FROM customer)
  SELECT host, CASE WHEN host LIKE '%.stripe.com' THEN 'Stripe' WHEN host LIKE '%.cloudfront.net' THEN 'Amazon CloudFront' ELSE 'Google Analytics' END AS vendor FROM h WHERE host NOT LIKE '%.nowhere.test'""")
def vendor_hosts(spark, sf):
    ends = ["stripe.com", "google-analytics.com", "cloudfront.net", "nowhere.test"]
    end = F.lit(ends[3])
    for i in range(3):
        end = F.when(F.col("c_custkey") % 4 == i, ends[i]).otherwise(end)
    hosts = t.table(spark, sf, "customer").select(F.concat(F.lit("cdn"), F.col("c_custkey").cast("string"), F.lit("."), end).alias("host"))
    return stack.vendors(hosts).select("host", "vendor")


@query("""WITH b AS (SELECT p_partkey AS id, '/shop/best-' || lower(replace(p_brand, '#', '-')) || '-in-' || chr((97 + p_partkey % 26)::INT) AS base FROM part), s AS (SELECT DISTINCT base, regexp_replace(base, '[^-]*$', '') AS stem FROM b),
  n AS (SELECT stem, count(*) AS k FROM s GROUP BY stem) SELECT base, CASE WHEN n.k >= 8 THEN n.stem || '{slug}' ELSE base END AS folded FROM s JOIN n USING (stem) WHERE n.k >= 8""")
def folded_siblings(spark, sf):
    p = t.table(spark, sf, "part")
    base = F.concat(F.lit("/shop/best-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-in-"), F.char((97 + F.col("p_partkey") % 26).cast("int")))
    x = conform(p.select(F.col("p_partkey").alias("id"), F.lit("GET").alias("method"), F.lit("shop.test").alias("host"), base.alias("path"), base.alias("path_template")))
    return fold.folded_paths(x).select("base", "folded")


# ---- walks


WALK = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(f"WITH RECURSIVE {WALK}, w AS (SELECT 'r1' AS id, 0 AS hops UNION SELECT e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.id WHERE w.hops < 3) SELECT id, min(hops)::INT AS hops FROM w WHERE hops > 0 GROUP BY id")
def walk_out(spark, sf):
    _, edges = t.trade_graph(spark, sf)
    return traverse.walk(edges, spark.createDataFrame([("r1",)], "id string"), "out", 3)


@query(f"WITH RECURSIVE {WALK}, w AS (SELECT 'o' || max(o_orderkey) AS id, 0 AS hops FROM orders UNION SELECT e.src, w.hops + 1 FROM w JOIN e ON e.dst = w.id WHERE w.hops < 8) SELECT id, min(hops)::INT AS hops FROM w WHERE hops > 0 GROUP BY id")
def walk_in(spark, sf):
    _, edges = t.trade_graph(spark, sf)
    start = t.table(spark, sf, "orders").agg(F.concat(F.lit("o"), F.max("o_orderkey").cast("string")).alias("id"))
    return traverse.walk(edges, start, "in", 8)


@query(f"WITH {WALK} SELECT dst AS id, 1 AS hops, 'out' AS direction FROM e WHERE src = 'n3' UNION ALL SELECT src, 1, 'in' FROM e WHERE dst = 'n3'")
def neighbours(spark, sf):
    _, edges = t.trade_graph(spark, sf)
    return traverse.neighbours(edges, spark.createDataFrame([("n3",)], "id string"))


@query("SELECT 'o' || o_orderkey AS start, 'r' || n_regionkey AS goal, 3 AS hops, 'o' || o_orderkey || '>c' || o_custkey || '>n' || n_nationkey || '>r' || n_regionkey AS trail FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def shortest_paths(spark, sf):
    nodes, edges = t.trade_graph(spark, sf)
    start = t.table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 300000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    found = traverse.paths(edges, start, nodes.filter("type = 'host'").select("id"), "in")
    return found.select("start", "goal", "hops", F.concat_ws(">", "trail").alias("trail"))


@query("WITH m AS (SELECT 'n' || c_nationkey AS n, 'c' || c_custkey AS c FROM customer) SELECT id, min(component) AS component FROM (SELECT c AS id, min(c) OVER (PARTITION BY n) AS component FROM m UNION ALL SELECT n, min(c) OVER (PARTITION BY n) FROM m) GROUP BY id")
def components(spark, sf):
    _, edges = t.trade_graph(spark, sf)
    return traverse.components(edges.filter("type = 'INCLUDES'"))


@query(f"WITH {EX} SELECT nid AS node_id, id AS ev, status, role FROM ep WHERE event_type = 'purchase'")
def provenance(spark, sf):
    x, nodes, _ = t.event_graph(spark, sf)
    evidence = contributions.node_contributions(x).select("id", "ev").distinct()
    wanted = nodes.filter("type = 'endpoint' and path like '/admin/%'").select("id")
    return traverse.provenance(evidence, x.drop("node_id"), wanted).select("node_id", "ev", "status", "role")


# ---- reasoning and ranking


@query(f"WITH {EX}, n AS (SELECT nid, any_value(label) AS label, any_value(template) AS template, max(n_creds) AS creds, count(*) FILTER (n_creds = 0) AS anon FROM ep GROUP BY nid) SELECT 'privileged' AS zone, nid AS id, label FROM n WHERE template LIKE '/admin/%' UNION ALL SELECT 'credentialed', nid, label FROM n WHERE creds > 0 UNION ALL SELECT 'anonymous_seen', nid, label FROM n WHERE creds > 0 AND anon > 0 UNION ALL SELECT 'no_auth_observed', nid, label FROM n WHERE creds = 0")
def trust_zones(spark, sf):
    _, nodes, _ = t.event_graph(spark, sf)
    return reason.trust_zones(nodes)


@query("WITH d AS (SELECT 'n' || n_nationkey AS id, n_name AS label, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS degree FROM nation) SELECT id, 'route' AS type, label, degree FROM d ORDER BY degree DESC, label, id LIMIT 10")
def hubs(spark, sf):
    nodes, edges = t.trade_graph(spark, sf)
    return reason.hubs(nodes, edges)


@query(f"WITH {EX} SELECT DISTINCT nid AS id, CASE WHEN template LIKE '/admin/%' THEN 'admin' ELSE rtrim(event_type, 's') END AS area FROM ep")
def areas(spark, sf):
    _, nodes, _ = t.event_graph(spark, sf)
    return reason.with_area(nodes.filter("type = 'endpoint'")).select("id", "area")


@query()
def communities(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf)
    return reason.communities(nodes.select("id", "type", "path"), edges.select("src", "dst", "type"))


SIGNALS = f"""{EX}, n AS (SELECT nid, any_value(label) AS label, any_value(template) AS template, any_value(method) AS method, min(status) AS least, max(n_creds) AS creds, count(*) FILTER (n_creds = 0) AS anon FROM ep GROUP BY nid),
  s AS (SELECT nid, label, 'privileged' AS kind, 3 AS weight FROM n WHERE template LIKE '/admin/%' UNION ALL SELECT nid, label, 'mixed_auth', 2 FROM n WHERE creds > 0 AND anon > 0 UNION ALL SELECT nid, label, 'no_auth_state', 2 FROM n WHERE creds = 0 AND method = 'POST' UNION ALL SELECT nid, label, 'only_errored', 1 FROM n WHERE least >= 400)"""


def _endpoints(spark, sf):
    _, nodes, _ = t.event_graph(spark, sf)
    return nodes.filter("type = 'endpoint'").withColumn("api_state", F.lit("RUNTIME_ONLY"))


@query(f"WITH {SIGNALS} SELECT nid AS id, label, kind, weight FROM s")
def signals(spark, sf):
    return rank.signals(_endpoints(spark, sf))


@query(f"WITH {SIGNALS}, a AS (SELECT DISTINCT nid, CASE WHEN template LIKE '/admin/%' THEN 'admin' ELSE rtrim(event_type, 's') END AS area FROM ep) SELECT area, sum(weight)::BIGINT AS score, count(*) AS n_signals FROM s JOIN a USING (nid) GROUP BY area")
def plan_by_area(spark, sf):
    nodes = _endpoints(spark, sf)
    return rank.plan(rank.signals(nodes), reason.with_area(nodes).select("id", "area")).select("area", "score", "n_signals")


@query(f"WITH {SIGNALS} SELECT nid AS id, label, CASE WHEN bool_or(kind = 'privileged') THEN 'hot' ELSE 'warn' END AS severity, count(*) AS n_signals FROM s GROUP BY nid, label")
def leads(spark, sf):
    return rank.leads(_endpoints(spark, sf)).select("id", "label", "severity", "n_signals")


@query(f"WITH {EX} SELECT 2 + (template LIKE '/admin/%')::INT AS leverage, 'ENDPOINT_ONLY_ERRORED' AS type, label AS entity FROM (SELECT nid, any_value(label) AS label, any_value(template) AS template, min(status) AS least FROM ep GROUP BY nid) WHERE least >= 400 UNION ALL SELECT 3 + (template LIKE '/admin/%')::INT, 'AUTHORIZATION_UNKNOWN', label FROM (SELECT nid, any_value(label) AS label, any_value(template) AS template, count(role) AS r FROM ep GROUP BY nid) WHERE r > 0")
def ranked_gaps(spark, sf):
    nodes = _endpoints(spark, sf)
    return rank.gaps(references.unknowns(nodes, "events", True, True), nodes).select("leverage", "type", "entity")


@query(f"WITH {EX}, n AS (SELECT nid, any_value(label) AS label, any_value(template) AS template, bool_or(role = 'user') AS lo, bool_or(role = 'admin') AS hi, bool_or(role = 'user' AND status < 300) AS lo_ok, bool_or(role = 'admin' AND status < 300) AS hi_ok FROM ep GROUP BY nid) SELECT CASE WHEN hi AND NOT coalesce(lo, false) THEN 'high_only' WHEN lo AND template LIKE '/admin/%' THEN 'low_reached_privileged' WHEN lo AND hi AND lo_ok AND hi_ok THEN 'shared_same_success' END AS kind, nid AS id, label FROM n WHERE (hi AND NOT coalesce(lo, false)) OR (lo AND template LIKE '/admin/%') OR (lo AND hi AND lo_ok AND hi_ok)")
def cross_role(spark, sf):
    return rank.cross_role(_endpoints(spark, sf), "user", "admin")


@query(f"WITH {EX} SELECT nid AS id, any_value(label) AS label, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM ep WHERE role = 'user' AND template LIKE '/admin/%' GROUP BY nid")
def reaches_privileged(spark, sf):
    return rank.reaches_privileged(_endpoints(spark, sf), "user").select("id", "label", F.concat_ws(",", F.col("statuses").cast("array<string>")).alias("statuses"))


@query(f"WITH {EX}, n AS (SELECT nid, any_value(label) AS label, any_value(template) AS template, count(role) AS r FROM ep GROUP BY nid) SELECT nid AS id, CASE WHEN template LIKE '/admin/%' THEN 1 WHEN r > 0 THEN 2 ELSE 3 END AS rank FROM n ORDER BY rank, label, nid LIMIT 40")
def context_priorities(spark, sf):
    return rank.priority(_endpoints(spark, sf)).orderBy("rank", "label", "id").limit(views.CAP).select("id", "rank")


@query(f"WITH {EX}, f AS (SELECT nid, id, row_number() OVER (PARTITION BY nid ORDER BY id) AS k FROM ep) SELECT id FROM f WHERE k <= 3")
def cited_requests(spark, sf):
    x, nodes, edges = t.event_graph(spark, sf)
    ends = nodes.filter("type = 'endpoint'").withColumn("api_state", F.lit("RUNTIME_ONLY"))
    evidence = contributions.node_contributions(x).select("id", "ev").distinct()
    context = views.context_rows(ends, edges.select("src", "dst", "type"), evidence)
    return views.cited_requests(context, x).select("id")


@query(f"WITH {EX} SELECT k AS name, count(DISTINCT nid) AS n_used FROM ep WHERE k IS NOT NULL GROUP BY k")
def parameter_index(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf)
    return views.params_index(nodes, edges)


@query(f"WITH {EX} SELECT CASE c WHEN 1 THEN 'session cookie sid' ELSE 'Authorization: bearer' END AS label, count(DISTINCT nid) AS n_endpoints FROM (SELECT nid, 1 AS c FROM ep WHERE n_creds >= 1 UNION ALL SELECT nid, 2 FROM ep WHERE n_creds = 2) GROUP BY 1")
def auth_surface(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf)
    return views.auth_surface(nodes, edges)


@query(f"WITH {EX} SELECT 'host:' || host AS id, host AS label, count(DISTINCT nid) AS n FROM ep GROUP BY host")
def endpoints_by_host(spark, sf):
    _, nodes, edges = t.event_graph(spark, sf)
    return views.roll_up(nodes, edges, "EXPOSES", by="src").select("id", "label", "n")


# ---- drift and live captures


@query(f"WITH {EX}, a AS (SELECT DISTINCT nid || coalesce(':' || k, '') AS id FROM ep WHERE build = 1 AND id % 50 = 0), b AS (SELECT DISTINCT nid || coalesce(':' || k, '') AS id FROM ep WHERE build = 2 AND id % 50 = 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'NEW' ELSE 'GONE' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL".replace(" AND id % 50 = 0", ""))
def drift_nodes(spark, sf):
    def ids(build):
        _, nodes, _ = t.event_graph(spark, sf, build=build)
        return nodes.filter("type = 'parameter'").select(F.expr("substr(id, 7)").alias("id"), F.col("type"))

    return drift.node_changes(ids(1), ids(2))


@query(f"WITH {EX}, a AS (SELECT nid, array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ', ') AS v FROM ep WHERE build = 1 GROUP BY nid), b AS (SELECT nid, array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ', ') AS v FROM ep WHERE build = 2 AND status <> 500 GROUP BY nid) SELECT a.nid AS id FROM a LEFT JOIN b USING (nid) WHERE b.nid IS NULL")
def drift_gone(spark, sf):
    _, old, _ = t.event_graph(spark, sf, build=1)
    rows = conform(t.event_exchanges(spark, sf).filter("build = 2 and status <> 500"))
    new, _ = contributions.graph_of(contributions.classified(rows, t.SCOPE, t.PRIMARY))
    return drift.node_changes(old, new).filter("change = 'GONE' and id like 'endpoint:%'").select("id")


@query(f"WITH {EX}, a AS (SELECT nid, list_sort(list(DISTINCT status)) AS v FROM ep WHERE build = 1 GROUP BY nid), b AS (SELECT nid, list_sort(list(DISTINCT CASE WHEN event_type = 'error' THEN 403 ELSE status END)) AS v FROM ep WHERE build = 2 GROUP BY nid) SELECT nid AS id, 'statuses' AS field, array_to_string(a.v, ', ') AS was, array_to_string(b.v, ', ') AS now FROM a JOIN b USING (nid) WHERE a.v <> b.v")
def drift_fields(spark, sf):
    _, old, _ = t.event_graph(spark, sf, build=1)
    _, new, _ = t.event_graph(spark, sf, error_status=403, build=2)
    state = F.lit(None).cast("string")
    return drift.field_changes(old.withColumn("api_state", state), new.withColumn("api_state", state)).filter("field = 'statuses'")


@query(f"""WITH {EX}, e AS (SELECT build, 'EXPOSES' AS type, 'host:' || host AS src, nid AS dst FROM ep UNION ALL SELECT build, 'REACHED', 'role:' || role, nid FROM ep WHERE role IS NOT NULL
    UNION ALL SELECT build, 'SENT_CREDENTIAL', nid, 'auth:cookie:sid' FROM ep WHERE n_creds >= 1 UNION ALL SELECT build, 'SENT_CREDENTIAL', nid, 'auth:bearer' FROM ep WHERE n_creds = 2
    UNION ALL SELECT build, 'USES_PARAMETER', nid, 'param:' || nid || ':' || k FROM ep WHERE k IS NOT NULL),
  s AS (SELECT build, 'node' AS kind, src AS key FROM e UNION ALL SELECT build, 'node', dst FROM e UNION ALL SELECT build, 'edge', src || '|' || type || '|' || dst FROM e)
  SELECT kind, key, min(build)::INT AS first_build, max(build)::INT AS last_build FROM s GROUP BY kind, key""")
def history(spark, sf):
    """The first and the last build of every node and every edge."""
    def seen(build):
        _, nodes, edges = t.event_graph(spark, sf, build=build)
        return drift.entities(nodes, edges, build)

    first = seen(1).select("kind", "key", F.col("build").alias("first_build"), F.col("build").alias("last_build"))
    return drift.history(first, seen(2))


@query(f"WITH {EX}, r AS (SELECT id, row_number() OVER (PARTITION BY method, host, template, status, role ORDER BY id) AS k FROM ep) SELECT id FROM r WHERE k <= 10")
def shape_cap(spark, sf):
    return live.capped(_requests(spark, sf), live.shape(), "id").select("id")


@query(f"WITH {EX} SELECT method, host, path, status, role, min(id) AS first_id, count(*) AS n FROM ex GROUP BY ALL")
def digests(spark, sf):
    rows = _requests(spark, sf).withColumn("digest", live.digest(["method", "host", "path", "status", "role"]))
    return rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("method", "host", "path", "status", "role")]).drop("digest")


@query(f"WITH {EX} SELECT id FROM ex WHERE host = 'h1.shop.test'")
def live_admission(spark, sf):
    return live.admitted(_requests(spark, sf), ["h1.shop.test"]).select("id")


# ---- inputs of several roles


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests before and from the middle of the month on."""
    rows = t.event_exchanges(spark, sf_dir)
    return conform(rows.filter("build = 1")), conform(rows.filter("build = 2"))


NEW = "old AS (SELECT id, role FROM ex WHERE build = 1), new AS (SELECT id FROM ex WHERE build = 2)"


@query(f"WITH {EX}, {NEW} SELECT id, role FROM old WHERE role = 'user' UNION ALL SELECT id, 'admin' FROM new")
def role_replaced(spark, sf):
    return roles.merged(*_inputs(spark, sf), "admin").select("id", "role")


@query(f"WITH {EX}, {NEW} SELECT id, role FROM old WHERE role IS NOT NULL UNION ALL SELECT id, 'guest' FROM new")
def role_added(spark, sf):
    return roles.merged(*_inputs(spark, sf), "guest").select("id", "role")


@query(f"WITH {EX}, {NEW} SELECT id, CAST(NULL AS VARCHAR) AS role FROM new")
def roleless_input(spark, sf):
    return roles.merged(*_inputs(spark, sf), None).select("id", "role")


@query(f"WITH {EX}, {NEW} SELECT id, 'admin' AS role FROM new")
def role_fresh(spark, sf):
    return roles.merged(*_inputs(spark, sf), "admin", fresh=True).select("id", "role")


# ---- exports


@query(f"WITH {WALK} SELECT 'link' AS kind, count(*) AS n FROM e UNION ALL SELECT 'node', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders)")
def node_link_export(spark, sf):
    nodes, edges = t.trade_graph(spark, sf)
    return sink.node_link(nodes.withColumn("layer", F.lit(0)), edges).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'MERGE (n:Host {id: ''r' || r_regionkey || '''}) SET n.label = ''' || r_name || ''';' AS line FROM region")
def cypher_export(spark, sf):
    nodes, edges = t.trade_graph(spark, sf)
    return sink.cypher_lines(nodes.filter("type = 'host'"), edges.limit(0)).select("line")


@query("SELECT '<node id=\"n' || n_nationkey || '\"><data key=\"label\">' || n_name || '</data><data key=\"type\">route</data></node>' AS line FROM nation")
def graphml_export(spark, sf):
    nodes, edges = t.trade_graph(spark, sf)
    return sink.graphml_lines(nodes.filter("type = 'route'"), edges.limit(0)).filter("part = 1").select("line")


TRADE = """nd AS (
  SELECT 'r' || r_regionkey AS id, 'host' AS type, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'route', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'script', c_name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'third_party', s_name FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'endpoint', CAST(o_orderkey AS VARCHAR) FROM orders),
ed AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'SERVES' AS type FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'INCLUDES' FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'LOADS' FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CALLS' FROM orders)"""


@query(f"""WITH {TRADE} SELECT CAST(1 AS INTEGER) AS part, 'MERGE (n:' || upper(type[1]) || type[2:] || ' {{id: ''' || id || '''}}) SET n.label = ''' || label || ''';' AS line FROM nd
  UNION ALL SELECT 2, 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) MERGE (a)-[:' || type || ' {{state: ''OBSERVED''}}]->(b);' FROM ed""")
def cypher_whole_export(spark, sf):
    return sink.cypher_lines(*t.trade_graph(spark, sf))


@query(f"""WITH {TRADE} SELECT CAST(1 AS INTEGER) AS part, '<node id="' || id || '"><data key="label">' || label || '</data><data key="type">' || type || '</data></node>' AS line FROM nd
  UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '"><data key="type">' || type || '</data></edge>' FROM ed""")
def graphml_whole_export(spark, sf):
    return sink.graphml_lines(*t.trade_graph(spark, sf)).filter("part in (1, 2)")


# ---- names, lenses, edges of a drift, paths of the map


@query(f"""WITH {EX}, g AS (SELECT host, unnest(list_filter(string_split(template, '/'), lambda x: length(x) > 1 AND NOT starts_with(x, '{{') AND x <> 'api')) AS seg FROM (SELECT DISTINCT host, nid, template FROM ep)),
  r AS (SELECT host, seg, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, length(seg), seg) AS k FROM g GROUP BY host, seg)
  SELECT host AS community, seg AS name, (SELECT count(DISTINCT nid) FROM ep WHERE ep.host = r.host) AS n_nodes FROM r WHERE k = 1""")
def community_names(spark, sf):
    nodes = _endpoints(spark, sf)
    edges = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return reason.named_communities(nodes, edges, nodes.select("id", F.col("host").alias("community")))


LENS = "n AS (SELECT nid AS id, any_value(label) AS label, any_value(template) AS template, count(role) AS r, max(n_creds) AS c, min(id) AS first FROM ep GROUP BY nid), k AS (SELECT *, CASE WHEN template LIKE '/admin/%' THEN 1 WHEN r > 0 THEN 2 ELSE 5 END AS rank FROM n)"


@query(f"WITH {EX}, {LENS} SELECT id, row_number() OVER (ORDER BY rank, label, id) AS place FROM k WHERE r > 0 OR c > 0 ORDER BY rank, label, id LIMIT 40")
def lens_auth(spark, sf):
    return _placed(rank.lens(_endpoints(spark, sf), "auth"))


@query(f"WITH {EX}, {LENS} SELECT id, row_number() OVER (ORDER BY first, id) AS place FROM k ORDER BY first, id LIMIT 40")
def lens_all(spark, sf):
    return _placed(rank.lens(_endpoints(spark, sf), "all"))


def _placed(rows: DataFrame) -> DataFrame:
    """The first rows of a lens, numbered."""
    top = rows.orderBy("place").limit(views.CAP).select("id", "place")
    return top.select("id", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))


BUILDS = """r AS (SELECT * FROM ep WHERE build = 2 OR NOT (coalesce(role, '') = 'admin' AND event_type = 'view')),
  e AS (SELECT build, 'EXPOSES' AS type, 'h:' || host AS src, nid AS dst FROM r UNION SELECT build, 'REACHED', 'r:' || role, nid FROM r WHERE role IS NOT NULL UNION SELECT build, 'SENT_CREDENTIAL', nid, 'c:sid' FROM r WHERE n_creds >= 1
    UNION SELECT build, 'SENT_CREDENTIAL', nid, 'c:bearer' FROM r WHERE n_creds = 2 UNION SELECT build, 'USES_PARAMETER', nid, 'p:' || nid || ':' || k FROM r WHERE k IS NOT NULL),
  x AS (SELECT type, src, dst, min(build) AS build FROM e GROUP BY ALL HAVING count(DISTINCT build) = 1),
  m AS (SELECT id, min(build) AS build FROM (SELECT build, src AS id FROM e UNION SELECT build, dst FROM e) GROUP BY id HAVING count(DISTINCT build) = 1)"""


def _two_builds(spark, sf):
    """Nodes and edges of two builds; in the first, no administrator looked at anything."""
    rows = t.event_exchanges(spark, sf)
    both = []
    for part in ("build = 1 and not (role <=> 'admin' and path like '/api/view/%')", "build = 2"):
        x = contributions.classified(conform(rows.filter(part)), t.SCOPE, t.PRIMARY)
        both.append(contributions.graph_of(x))
    return both


@query(f"WITH {EX}, {BUILDS} SELECT type, CASE build WHEN 1 THEN 'GONE' ELSE 'NEW' END AS change, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.build = x.build AND m.id = x.src) AND NOT EXISTS (SELECT 1 FROM m WHERE m.build = x.build AND m.id = x.dst) GROUP BY ALL")
def drift_loose_edges(spark, sf):
    (old, old_edges), (new, new_edges) = _two_builds(spark, sf)
    return drift.loose_edges(old, new, old_edges, new_edges).groupBy("type", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EX}, {BUILDS}, j AS (SELECT unnest([x.src, x.dst]) AS id FROM x JOIN m a ON a.id = x.src AND a.build = 2 JOIN m b ON b.id = x.dst AND b.build = 2 WHERE x.build = 2)
  SELECT CASE substr(id, 1, 2) WHEN 'p:' THEN 'parameter' WHEN 'h:' THEN 'host' WHEN 'r:' THEN 'role' WHEN 'c:' THEN 'auth' ELSE 'endpoint' END AS type, CAST(2 AS INTEGER) AS first_build, count(*) AS n FROM m WHERE build = 2 AND id NOT IN (SELECT id FROM j) GROUP BY ALL""")
def drift_singles(spark, sf):
    (old, old_edges), (new, new_edges) = _two_builds(spark, sf)
    first = drift.entities(old, old_edges, 1).select("kind", "key", F.col("build").alias("first_build"), F.col("build").alias("last_build"))
    came = drift.node_changes(old, new).filter("change = 'NEW'")
    found = drift.singles(came, new, drift.edge_changes(old_edges, new_edges).filter("change = 'NEW'"), drift.history(first, drift.entities(new, new_edges, 2)))
    return found.groupBy("type", "first_build").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'n' || a.n_nationkey AS start, min('n' || b.n_nationkey) AS goal, CAST(2 AS INTEGER) AS hops, 'n' || a.n_nationkey || '>r' || a.n_regionkey || '>' || min('n' || b.n_nationkey) AS trail FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey, a.n_regionkey")
def map_paths(spark, sf):
    nodes, edges = t.trade_graph(spark, sf)
    nations = nodes.filter("type = 'route'").select("id")
    return traverse.map_paths(edges, nations, nations).select("start", "goal", "hops", F.concat_ws(">", "trail").alias("trail"))


@query(f"""WITH {EX} SELECT 'node' AS kind, type, count(*) AS n FROM (SELECT 'host' AS type, host AS k FROM ex UNION SELECT 'endpoint', nid FROM ep UNION SELECT 'role', role FROM ex WHERE role IS NOT NULL UNION SELECT 'auth', 'cookie:sid' FROM ex WHERE n_creds >= 1
    UNION SELECT 'auth', 'bearer' FROM ex WHERE n_creds = 2 UNION SELECT 'parameter', nid || ':' || k FROM ep WHERE k IS NOT NULL) GROUP BY type
  UNION ALL SELECT 'edge', type, count(*) FROM (SELECT 'EXPOSES' AS type, host AS a, nid AS b FROM ep UNION SELECT 'REACHED', role, nid FROM ep WHERE role IS NOT NULL UNION SELECT 'SENT_CREDENTIAL', nid, 'cookie:sid' FROM ep WHERE n_creds >= 1
    UNION SELECT 'SENT_CREDENTIAL', nid, 'bearer' FROM ep WHERE n_creds = 2 UNION SELECT 'USES_PARAMETER', nid, k FROM ep WHERE k IS NOT NULL) GROUP BY type""")
def whole_build(spark, sf):
    built = model.build(t.event_exchanges(spark, sf), "events", t.SCOPE, t.PRIMARY)
    sides = [df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n") for kind, df in (("node", built.nodes), ("edge", built.edges))]
    return sides[0].unionByName(sides[1])
