"""Registered queries of typed walks and of the packages for a reader, and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import contributions, drift, package, reach, reason, traverse
from trailmark.plans import model
from trailmark.plans.queries import EX, SIGNALS
from trailmark.plans.registry import query
from trailmark.schema import conform
from trailmark.sources import tables as t

#: Parts as endpoints that suppliers name: half of the suppliers were seen calling, the others only name them in code.
SUPPLY = """supply AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
  hops AS (SELECT 'p' || p AS part, 's' || s AS sup, 'n' || s_nationkey AS nation, n_name AS label, CASE WHEN s % 2 = 0 THEN 'CALLS' ELSE 'REFERENCES' END AS kind, CASE WHEN s % 2 = 0 THEN 'OBSERVED' ELSE 'INFERRED' END AS state
    FROM supply JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = p),
  trails AS (SELECT part, nation, label, min_by(sup, sup) AS sup, min_by(kind, sup) AS kind, min_by(state, sup) AS state FROM hops GROUP BY part, nation, label),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY label, nation) AS k FROM trails)"""


def _supply(spark, sf):
    """The trade graph with parts as endpoints."""
    nodes, edges = t.trade_graph(spark, sf)
    parts = t.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("endpoint").alias("type"), F.col("p_name").alias("label"))
    lines = t.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    seen = F.col("l_suppkey") % 2 == 0
    named = lines.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.when(seen, "CALLS").otherwise("REFERENCES").alias("type"), F.when(seen, "OBSERVED").otherwise("INFERRED").alias("state"),
    )
    return nodes.unionByName(parts), edges.unionByName(named)


@query(f"WITH {SUPPLY} SELECT part AS start, nation AS entry, label, CAST(2 AS INTEGER) AS hops, nation || ' LOADS ' || sup || ' ' || kind || ' ' || part AS trail FROM ranked WHERE k <= 3")
def reached_from(spark, sf):
    """How parts are reached: backwards over suppliers up to nations, which are pages and end the walk."""
    nodes, edges = _supply(spark, sf)
    found = reach.reach(nodes, edges, nodes.filter("id like 'p%'").select("id"))
    trail = F.concat_ws(" ", F.flatten(F.transform("trail", lambda h: F.array(h["src"], h["type"]))), F.element_at("trail", -1)["dst"])
    return found.select("start", "entry", "label", "hops", trail.alias("trail"))


@query(f"""WITH {SUPPLY}, first AS (SELECT 'p' || p_partkey AS part, p_brand AS area, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, 'p' || p_partkey) AS place FROM part),
  told AS (SELECT area, label AS entry, min_by(CASE state WHEN 'INFERRED' THEN 'code' ELSE 'traffic' END, place) AS via FROM ranked JOIN first USING (part) WHERE k <= 2 AND place <= 8 GROUP BY area, label)
  SELECT area, entry, via FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY entry) AS k FROM told) WHERE k <= 5""")
def areas_reached_from(spark, sf):
    """From where the brands, as areas of parts, are reached."""
    nodes, edges = _supply(spark, sf)
    areas = t.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("area"))
    return reach.area_reach(nodes, edges, areas)


@query("""SELECT 'r' || n_regionkey AS start, 'o' || o_orderkey AS endpoint, o_orderkey::VARCHAR AS label, 'c' || o_custkey AS via, 'CALLS' AS type, CAST(3 AS INTEGER) AS hops FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'n' || c_nationkey, 'o' || o_orderkey, o_orderkey::VARCHAR, 'c' || o_custkey, 'CALLS', CAST(2 AS INTEGER) FROM orders JOIN customer ON c_custkey = o_custkey""")
def page_calls(spark, sf):
    """Orders, as endpoints, that regions and nations call through pages and scripts."""
    nodes, edges = t.trade_graph(spark, sf)
    found = reach.page_calls(nodes, edges, nodes.filter(F.col("type").isin("host", "route")).select("id"))
    return found.select("start", "endpoint", "label", "via", "type", "hops")


@query("""WITH r AS (SELECT 'r' || r_regionkey AS start, r_regionkey FROM region)
  SELECT start, 'route' AS type, CAST(1 AS INTEGER) AS hop, 'SERVES' AS via, count(*) AS n FROM r JOIN nation ON n_regionkey = r_regionkey GROUP BY start
  UNION ALL SELECT start, 'script', CAST(2 AS INTEGER), 'INCLUDES', count(*) FROM r JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY start
  UNION ALL SELECT start, 'third_party', CAST(2 AS INTEGER), 'LOADS', count(*) FROM r JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY start
  UNION ALL SELECT start, 'endpoint', CAST(3 AS INTEGER), CASE WHEN NOT part THEN 'CALLS' ELSE kind END, count(*) FROM (
    SELECT start, 'o' || o_orderkey AS id, false AS part, '' AS kind FROM r JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT start, 'p' || l_partkey, true, min(CASE WHEN l_suppkey % 2 = 0 THEN 'CALLS' ELSE 'REFERENCES' END) FROM r JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY start, l_partkey) GROUP BY ALL""")
def blast_by_type(spark, sf):
    """What regions touch within three steps, by type of node, step and edge."""
    nodes, edges = _supply(spark, sf)
    found = reach.blast(nodes, edges, nodes.filter("type = 'host'").select("id"))
    return found.groupBy("start", "type", "hop", "via").agg(F.count(F.lit(1)).alias("n"))


# ---- packages for a reader


def _package(spark, sf, **of):
    return package.document(model.build(t.event_exchanges(spark, sf), "events", t.SCOPE, t.PRIMARY), **of)


#: Endpoints of the events in order of the attention lens, with the first requests behind each.
RANKED = f"""{EX}, ends AS (SELECT nid AS id, any_value(label) AS label, any_value(method) AS method, any_value(event_type) AS kind, list_sort(list(DISTINCT status)) AS statuses, list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)) AS roles,
    count(*) FILTER (n_creds = 0) AS anonymous, max(n_creds) AS creds, list_slice(list(id ORDER BY id), 1, 3) AS cited, min(id) AS first_ev FROM ep GROUP BY nid),
  ranked AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN kind = 'purchase' THEN 1 WHEN len(roles) > 0 THEN 2 WHEN creds > 0 AND anonymous > 0 THEN 3 WHEN method NOT IN ('GET', 'HEAD') THEN 4 ELSE 5 END, label, id) AS k FROM ends)"""


@query(f"""WITH {RANKED} SELECT k, id, label, 'RUNTIME_ONLY' AS api_state, array_to_string(statuses, ',') AS statuses, coalesce(array_to_string(roles, ','), '') AS reached_by, array_to_string(list_transform(cited, lambda i: 'ev_' || i), ',') AS evidence FROM ranked WHERE k <= 40""")
def package_endpoints(spark, sf):
    """The endpoints that a package's JSON lists, read back from its text."""
    row = _package(spark, sf, scope="endpoints")
    view = "array<struct<id: string, label: string, api_state: string, statuses: array<string>, reached_by: array<string>, evidence: array<string>>>"
    items = row.select(F.posexplode(F.from_json("document", f"endpoints {view}")["endpoints"]).alias("at", "e"))
    joined = lambda c: F.coalesce(F.concat_ws(",", f"e.{c}"), F.lit("")).alias(c)
    return items.select((F.col("at") + 1).cast("long").alias("k"), "e.id", "e.label", "e.api_state", joined("statuses"), joined("reached_by"), joined("evidence"))


@query(f"""WITH {RANKED}, ids AS (SELECT DISTINCT unnest(cited) AS id FROM ranked WHERE k <= 40) SELECT 'ev_' || ep.id AS cited, method, host, path, status, role FROM ep JOIN ids ON ids.id = ep.id""")
def package_evidence(spark, sf):
    """Every request that the package cites resolves inside it."""
    row = _package(spark, sf, scope="endpoints")
    view = "map<string, struct<method: string, host: string, path: string, status: int, role: string>>"
    return row.select(F.explode(F.from_json("document", f"evidence {view}")["evidence"]).alias("cited", "e")).select("cited", "e.*")


@query(f"""WITH {EX}, n AS (SELECT count(DISTINCT nid) AS ends, count(DISTINCT host) AS hosts, count(DISTINCT nid) FILTER (role IS NOT NULL) AS reached, count(DISTINCT nid) FILTER (status >= 400) - count(DISTINCT nid) FILTER (status < 400 AND nid IN (SELECT nid FROM ep WHERE status >= 400)) AS errored,
    count(DISTINCT nid) FILTER (n_creds > 0) AS creds, count(DISTINCT nid) FILTER (event_type = 'purchase') AS priv, count(DISTINCT nid) FILTER (n_creds = 0 AND nid NOT IN (SELECT nid FROM ep WHERE n_creds > 0)) AS open FROM ep),
  s AS (SELECT unnest([{{'section': 'endpoints', 'cap': 40, 'total': ends}}, {{'section': 'unknowns', 'cap': 40, 'total': reached + errored}}, {{'section': 'auth', 'cap': 40, 'total': 2}}, {{'section': 'routes', 'cap': 40, 'total': 0}}, {{'section': 'graph.entry_points', 'cap': 60, 'total': hosts}},
    {{'section': 'graph.trust_zones', 'cap': 60, 'total': 2 * creds + priv + open}}], recursive := true) FROM n) SELECT section, least(cap, total)::VARCHAR || '/' || total || CASE WHEN total > cap THEN ' (capped)' ELSE '' END AS told FROM s""")
def package_coverage(spark, sf):
    """What a whole package says about how much of each section it shows."""
    row = _package(spark, sf)
    told = row.select(F.explode(F.from_json("document", "coverage map<string, string>")["coverage"]).alias("section", "told"))
    return told.filter(F.col("section").isin("endpoints", "unknowns", "auth", "routes", "graph.entry_points", "graph.trust_zones"))


#: Areas of the events' endpoints with what a plan says of each.
EPISODES = """area AS (SELECT DISTINCT nid, label, host, CASE WHEN template LIKE '/admin/%' THEN 'admin' ELSE rtrim(event_type, 's') END AS area FROM ep), weights AS (SELECT area, sum(weight) AS leverage, list(DISTINCT kind) AS kinds FROM s JOIN area USING (nid) GROUP BY area),
  lines AS (SELECT area, any_value(leverage) AS leverage, string_agg(DISTINCT area.label, ',' ORDER BY area.label) AS endpoints, (SELECT coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') FROM ep WHERE nid IN (SELECT a.nid FROM area a WHERE a.area = area.area) AND role IS NOT NULL) AS reached_by,
    list_sort(list(DISTINCT host)) AS hosts, coalesce(nullif(array_to_string(list_filter([CASE WHEN list_contains(any_value(kinds), 'privileged') THEN 'contains privileged-looking endpoints' END, CASE WHEN list_contains(any_value(kinds), 'mixed_auth') OR list_contains(any_value(kinds), 'no_auth_state') THEN 'the auth boundary is ambiguous' END], lambda x: x IS NOT NULL), '; '), ''), 'a mapped part of the surface to confirm') || '.' AS why
    FROM area LEFT JOIN weights USING (area) GROUP BY area)"""


@query(f"""WITH {SIGNALS}, {EPISODES} SELECT area, coalesce(leverage, 0)::BIGINT AS leverage, why, endpoints, reached_by, 'from ' || hosts[1] || ' (via traffic)' || CASE WHEN len(hosts) > 1 THEN ',from ' || hosts[2] || ' (via traffic)' ELSE '' END AS reach FROM lines""")
def package_lines_of_inquiry(spark, sf):
    """The lines of inquiry of a plan, read back from its JSON."""
    built = model.build(t.event_exchanges(spark, sf), "events", t.SCOPE, t.PRIMARY)
    areas = reason.with_area(built.nodes).filter("type IN ('endpoint', 'route')").select("id", "area")
    row = package.document(built, "plan", areas=areas)
    view = "array<struct<area: string, leverage: bigint, why_it_matters: string, endpoints: array<string>, reached_by: array<string>, reach: array<string>>>"
    lines = row.select(F.explode(F.from_json("document", f"plan struct<lines_of_inquiry: {view}>")["plan"]["lines_of_inquiry"]).alias("l"))
    joined = lambda c: F.coalesce(F.array_join(f"l.{c}", ","), F.lit("")).alias(c)
    return lines.select("l.area", "l.leverage", F.col("l.why_it_matters").alias("why"), joined("endpoints"), joined("reached_by"), joined("reach"))


@query(f"""WITH {EX}, lately AS (SELECT DISTINCT host, label, event_type FROM ep), shown AS (
    SELECT 'appeared' AS change, label, CASE event_type WHEN 'purchase' THEN 'a new privileged-looking endpoint — confirm who may reach it' END AS why, 'admin' AS area FROM lately WHERE event_type = 'purchase'
    UNION ALL SELECT 'gone', label, 'an endpoint no longer seen — retired, renamed, or just not walked this time', 'endpoint' FROM lately WHERE event_type = 'view')
  SELECT area, change, 'endpoint' AS kind, label, why FROM shown""")
def drift_by_area(spark, sf):
    """Two builds: purchases appear in the second, views are no longer seen."""
    rows = conform(t.event_exchanges(spark, sf))
    builds = [contributions.graph_of(contributions.classified(rows.filter(f"path NOT LIKE '{gone}'"), t.SCOPE, t.PRIMARY))[0] for gone in ("/admin/%", "/api/view/%")]
    areas = reason.with_area(builds[1]).filter("type IN ('endpoint', 'route') AND area <> ''").select("label", "area")
    return drift.by_area(*builds, areas)


@query(f"""WITH {EX} SELECT nid AS id, any_value(label) AS label, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, 'host:' || any_value(host) || '>' || nid AS trail FROM ep WHERE event_type = 'purchase' AND role = 'admin' GROUP BY nid""")
def privileged_paths(spark, sf):
    """Privileged endpoints that administrators reached, and how from a host."""
    _, nodes, edges = t.event_graph(spark, sf)
    found = reach.privileged_paths(nodes, edges, "admin")
    return found.select("id", "label", F.concat_ws(",", F.col("statuses").cast("array<string>")).alias("statuses"), F.concat_ws(">", "trail").alias("trail"))


@query("""WITH hop AS (SELECT 'o' || o_orderkey AS start, 'r' || n_regionkey AS region, 'n' || n_nationkey AS nation, 'c' || c_custkey AS customer FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
  SELECT start, region AS goal, CAST(3 AS INTEGER) AS hops, start || '>' || customer || '>' || nation || '>' || region AS trail FROM hop""")
def paths_to_hosts(spark, sf):
    """Up to three shortest paths of each order backwards to a region, which is a host."""
    nodes, edges = t.trade_graph(spark, sf)
    found = traverse.paths(edges, nodes.filter("type = 'endpoint'").select("id"), nodes.filter("type = 'host'").select("id"), "in", most=3)
    return found.select("start", "goal", "hops", F.concat_ws(">", "trail").alias("trail"))
