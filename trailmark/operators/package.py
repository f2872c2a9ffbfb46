"""Documents that describe a graph to a reader in one JSON text: many sections, each cut by a rank, within a budget.

A section is a table of items with a place.  Each is cut to its cap by a top-k, so at most the sum of the caps is gathered,
however large the graph is; the running sum of the items' sizes, section by section, then decides what still fits.  What an
item cites are the first requests behind its node, and the requests that are cited by what is left close the document:
every id in it resolves.  Coverage says of each section how many of how many items are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.operators import rank, reach, reason
from trailmark.operators.contributions import first_evidence
from trailmark.tables import settle

#: Items of a section, requests that an item cites, and how many related labels, parameters and neighbours it lists.
CAP, CITED, RELATED, PARAMS, NEIGHBOURS = 40, 3, 5, 12, 30
GRAPH_CAP, HUBS, COMMUNITIES, COUPLED, FLOWS, SECRETS = 60, 10, 15, 25, 25, 20
#: Sections of the package by what it is copied for; the others are all of them.
SCOPES = {
    "endpoints": ["app", "scope", "endpoints"],
    "open": ["app", "unknowns", "endpoints"],
    "methodology": ["instructions", "app", "scope", "roles", "shape", "plan", "endpoints", "unknowns", "graph"],
    "falsify": ["instructions", "app", "scope", "roles", "shape", "plan", "endpoints", "unknowns", "graph"],
    "plan": ["app", "scope", "plan"],
    "graph": ["app", "scope", "shape", "graph"],
}
#: What a reader is asked to do with the packages that carry a plan.
INSTRUCTIONS = {
    "methodology": "Order the lines of inquiry below into a way to study this application. Reason from the model only, cite the requests (ev_N) behind each claim, and ask questions, never payloads.",
    "falsify": "Try to rule out each line of inquiry below from the model alone. Say which evidence (ev_N) contradicts it, or which single observation would; rank what is left, and say what was ruled out and why.",
}
# Why an area matters, by the kinds of its signals; the first steps of recon, and what each is for.
WHY = [
    (["static_only"], "holds paths named in code but never walked"), (["privileged"], "contains privileged-looking endpoints"), (["role_divergence"], "roles diverge here"),
    (["mixed_auth", "no_auth_state"], "the auth boundary is ambiguous"),
]
WHY_ELSE = "a mapped part of the surface to confirm"
RECON = {
    "login": ("get an authenticated capture", "no credentialed traffic was seen, so most of the application may be unmapped", "log in, and capture again with a role"),
    "roles": ("capture each role separately", "comparing roles needs traffic that says who made it", "capture each account with its role"),
    "static": ("walk the paths found only in code", "endpoint(s) are referenced in scripts but were never called", "request each in an authorised session and observe"),
    "third": ("account for third-party code", "the application runs code that it does not control", "look at what each third party is sent"),
    "else": ("confirm the map is complete", "the capture looks well covered; verify that no feature area is missing", "compare the endpoints with what the application's navigation shows"),
}
AREA_CAP, QUESTIONS, WATCHED, ROLES = 60, 6, 12, 20
LENSES = {"attention": "endpoints by how much they ask for attention", "auth": "endpoints with roles or credentials", "all": "endpoints in order of their first request"}


@dataclass(frozen=True)
class Part:
    """A section: ``rows`` have place (what sorts them), node (whose requests an item cites, or null), cited (or null) and item (a JSON object)."""

    name: str
    rows: DataFrame
    cap: int = CAP
    total: DataFrame | None = None


def _part(name: str, df: DataFrame, place: list, fields: list, node: str | None = None, cited: Column | None = None, cap: int = CAP, total: DataFrame | None = None) -> Part:
    by = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"by{i}") for i, c in enumerate(place)])
    no_node, no_ids = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>")
    rows = df.select(by.alias("place"), (F.col(node) if node else no_node).alias("node"), (no_ids if cited is None else cited.cast("array<bigint>")).alias("cited"), F.to_json(F.struct(*fields)).alias("item"))
    return Part(name, rows, cap, df if total is None else total)


def _full(c: Column) -> Column:
    """Null for an empty list, which JSON then leaves out."""
    return F.when(F.size(c) > 0, c)


def _labels(edges: DataFrame, nodes: DataFrame, shown: DataFrame, at: str, other: str, name: str, most: int) -> DataFrame:
    """(id, name): the first labels at the other ends of the edges of shown nodes."""
    ends = nodes.select(F.col("id").alias(other), "label")
    rows = edges.join(shown.select(F.col("id").alias(at)), at, "left_semi").join(ends, other).select(F.col(at).alias("id"), "label").distinct()
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("label"))).filter(F.col("k") <= most)
    return first.groupBy("id").agg(F.array_sort(F.collect_list("label")).alias(name))


def context_parts(m, lens: str = "attention", cap: int = CAP) -> list[Part]:
    """The sections of a context: endpoints by a lens, pages, scripts, third parties, technologies, trust, secrets and open questions."""
    nodes, edges = m.nodes, m.edges
    ranked = rank.lens(nodes, lens)
    top = settle(ranked.orderBy("place").limit(cap), "top")
    for kind, at, other, name, most in (("REFERENCES", "dst", "src", "referenced_by", RELATED), ("CALLS", "dst", "src", "called_from", RELATED), ("USES_PARAMETER", "src", "dst", "params", PARAMS)):
        top = top.join(_labels(edges.filter(F.col("type") == kind), nodes, top, at, other, name, most), "id", "left")
    reached = F.size("roles") > 0
    view = [
        "id", "type", "label", "api_state", _full(F.col("statuses")).alias("statuses"), "params", _full(F.col("roles")).alias("reached_by"),
        F.when(reached, F.transform("status_by_role", lambda x: F.concat_ws(" ", x["role"], x["status"].cast("string")))).alias("status_by_role"), _full(F.col("credentials")).alias("credentials"),
        F.when((F.col("anonymous_requests") > 0) & (F.size("credentials") > 0), True).alias("also_seen_without_credentials"), "referenced_by", "called_from", F.when(F.col("method").isNull(), "unknown (static reference)").alias("method"),
    ]
    simple = ["id", "type", "label"]

    def of(kind: str) -> DataFrame:
        return nodes.filter(F.col("type") == kind)

    named = edges.filter("type = 'REFERENCES'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("references"))
    scripts = settle(of("script").orderBy("first_ev", "id").limit(cap), "scripts").join(named, "id", "left").fillna(0, ["references"])
    asked = m.unknowns.join(nodes.select(F.col("id").alias("entity"), "label"), "entity", "left").withColumn("about", F.coalesce("label", F.element_at(F.split("entity", ":"), -1)))
    flags = ["httponly", "secure", "samesite"]
    return [
        _part("endpoints", top, ["place"], view, "id", cap=cap, total=ranked),
        _part("unknowns", asked, [F.col("type") == "AUTHORIZATION_UNKNOWN", "type", "about", "entity"], ["type", F.col("about").alias("entity"), "we_know", "we_dont_know", F.col("next_step").alias("next")], cap=cap),
        _part("routes", of("route"), ["first_ev", "id"], simple, "id", cap=cap),
        _part("scripts", scripts, ["first_ev", "id"], [*simple, "references"], "id", cap=cap, total=of("script")),
        _part("third_parties", of("third_party"), [-F.col("n_evidence"), "id"], simple, "id", cap=cap),
        _part("stack", m.stack, ["category", "name"], ["name", "category", F.nullif(F.col("version"), F.lit("")).alias("version")], cited=F.slice("evidence", 1, 2), cap=cap),
        _part("auth", of("auth"), ["label", "id"], simple, "id", cap=cap),
        _part("cookies", of("cookie"), ["label", "id"], [*simple, *flags], "id", cap=cap),
        _part("secrets", m.secrets, [-F.col("count"), "kind", "hmac_12"], ["kind", "length", "entropy", "count"], cited=F.slice("evidence", 1, CITED), cap=SECRETS),
    ]


def graph_parts(m, cap: int = GRAPH_CAP) -> list[Part]:
    """The graph itself for a reader who walks it: nodes and their neighbours, and derived views; parameters belong to their endpoints."""
    nodes, edges = m.nodes, m.edges
    folded = ["parameter", "operation"]
    kept = nodes.filter(~F.col("type").isin(folded))
    linked = settle(kept.join(reason.degrees(nodes, edges), "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(cap), "nodes")
    out = edges.join(linked.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "state")
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst", "type"))).filter(F.col("k") <= NEIGHBOURS)
    out = out.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", "type", "state"))), lambda x: F.array(x["dst"], x["type"], x["state"])).alias("to"))
    groups = settle(reason.communities(nodes, edges), "groups")
    named = settle(reason.named_communities(nodes, edges, groups), "named")
    coupled = reason.coupling(nodes, edges, groups)
    ends = nodes.filter("type = 'endpoint'")
    first = settle(ends.select("id", "label", (F.col("api_state") != "STATIC_ONLY").alias("walked")).orderBy("walked", "label", "id").limit(FLOWS), "flows")
    flows = reach.reach(nodes, edges, first.select("id"), 1).join(first.withColumnRenamed("id", "start").select("start", F.col("label").alias("of"), "walked"), "start")
    zones = reason.trust_zones(nodes)
    hubs = reason.hubs(nodes, edges, HUBS)
    entries = nodes.filter(F.col("type").isin(reach.ENTRY_TYPES))
    cross, third = (coupled.filter(F.col("kind") == k) for k in ("cross", "third_party"))
    pair = [F.col("src_label").alias("from"), F.col("type").alias("edge"), F.col("dst_label").alias("to"), "state"]
    by_pair = ["src_label", "dst_label", "type"]
    return [
        _part("graph.nodes", linked, [-F.col("degree"), "id"], ["id", "label", "type", "layer", _full(F.col("roles")).alias("roles"), F.col("api_state").alias("state")], "id", cap=cap, total=kept),
        _part("graph.adjacency", linked.join(out, "id"), [-F.col("degree"), "id"], ["id", "to"], cap=cap, total=edges.select(F.col("src").alias("id")).distinct().join(kept.select("id"), "id", "left_semi")),
        _part("graph.entry_points", entries, ["label", "id"], ["label"], cap=cap),
        _part("graph.hubs", hubs, [-F.col("degree"), "label", "id"], ["label", "type", "degree"], "id", cap=HUBS, total=kept.join(reason.degrees(nodes, edges), "id", "left_semi")),
        _part("graph.communities", named, [-F.col("n_nodes"), "name", "community"], ["name", F.col("n_nodes").alias("size")], cap=COMMUNITIES),
        _part("graph.trust_zones", zones, ["zone", "label", "id"], ["zone", F.col("label").alias("endpoint")], "id", cap=cap),
        _part("graph.cross_area", cross, by_pair, pair, cap=COUPLED),
        _part("graph.to_third_party", third, by_pair, pair, cap=COUPLED),
        _part("graph.execution_flows", flows, ["walked", "of", "start"], [F.col("of").alias("endpoint"), F.col("label").alias("entry"), F.col("trail").alias("hops")], "start", cap=FLOWS, total=ends),
    ]


def communities_as_areas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, area): the names of the communities that nodes are in."""
    groups = settle(reason.communities(nodes, edges), "groups")
    return groups.join(reason.named_communities(nodes, edges, groups).select("community", "name"), "community").select("id", F.col("name").alias("area"))


def lines_of_inquiry(m, areas: DataFrame) -> DataFrame:
    """(area, leverage, why, endpoints, reached_by, reach, signals, open_questions): areas (id, area) with endpoints or pages that take input, by the weight of their signals."""
    nodes, edges = m.nodes, m.edges
    found = rank.signals(nodes).unionByName(rank.input_pages(nodes, edges))
    members = nodes.filter("type = 'endpoint'").select("id", "label", "roles").unionByName(nodes.join(rank.input_pages(nodes, edges).select("id"), "id", "left_semi").select("id", "label", "roles")).join(areas, "id")
    members = settle(members, "members")
    told = rank.plan(found, areas).select("area", "score", "signals")
    first = members.select("area", "label").distinct().withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy("label"))).filter(F.col("k") <= rank.AREA_ENDPOINTS)
    rows = first.groupBy("area").agg(F.array_sort(F.collect_list("label")).alias("endpoints"))
    kinds = found.join(areas, "id").groupBy("area").agg(F.collect_set("kind").alias("kinds"))
    reasons = F.array_compact(F.array(*[F.when(F.arrays_overlap("kinds", F.array(*map(F.lit, of))), text) for of, text in WHY]))
    why = F.concat(F.when(F.size(reasons) > 0, F.concat_ws("; ", reasons)).otherwise(WHY_ELSE), F.lit("."))
    by = members.select("area", F.explode("roles").alias("role")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy("role"))).filter(F.col("k") <= ROLES)
    by = by.groupBy("area").agg(F.array_sort(F.collect_list("role")).alias("reached_by"))
    notes = reach.area_reach(nodes, edges, areas).select("area", F.concat(F.lit("from "), "entry", F.lit(" (via "), "via", F.lit(")")).alias("note"))
    notes = notes.groupBy("area").agg(F.array_sort(F.collect_list("note")).alias("reach"))
    asked = m.unknowns.select(F.col("entity").alias("id"), F.col("type").alias("kind"), "we_dont_know", "next_step").join(nodes.select("id", "label"), "id").join(areas, "id")
    asked = asked.groupBy("area", "kind", "label").agg(F.min(F.struct("we_dont_know", "next_step")).alias("q"))
    asked = asked.withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy("kind", "label"))).filter(F.col("k") <= QUESTIONS)
    question = F.struct(F.col("k"), F.col("kind").alias("type"), F.col("label").alias("entity"), F.col("q.we_dont_know").alias("unknown"), F.col("q.next_step").alias("to_find_out"))
    asked = asked.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(question)), lambda x: x.dropFields("k")).alias("open_questions"))
    for t in (told, kinds, by, notes, asked):
        rows = rows.join(t, "area", "left")
    rows = rows.withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    return rows.select("area", F.coalesce("score", F.lit(0)).cast("long").alias("leverage"), why.alias("why"), "endpoints", "reached_by", "reach", "signals", "open_questions")


def recon(m) -> DataFrame:
    """(k, step, why, how): what to establish first, from what the capture does not show."""
    kinds = {r["type"] for r in m.unknowns.select("type").distinct().collect()}
    seen = m.nodes.agg(F.count_if((F.col("type") == "endpoint") & (F.col("api_state") == "STATIC_ONLY")).alias("static"), F.count_if(F.col("type") == "third_party").alias("third"), F.count_if(F.col("type") == "role").alias("roles")).first()
    steps = [name for name, on in (("login", "AUTHENTICATED_STATE_NOT_OBSERVED" in kinds), ("roles", not seen["roles"] or "ROLE_NOT_TAGGED" in kinds), ("static", seen["static"]), ("third", seen["third"])) if on] or ["else"]
    rows = [(k, RECON[s][0], f"{seen['static']} {RECON[s][1]}" if s == "static" else RECON[s][1], RECON[s][2]) for k, s in enumerate(steps)]
    return m.nodes.sparkSession.createDataFrame(rows, "k int, step string, why string, how string")


def posture(m) -> DataFrame:
    """One row of counts: how large the application is, and how much of it is open."""
    end = F.col("type") == "endpoint"
    pages = rank.input_pages(m.nodes, m.edges).agg(F.count(F.lit(1)).alias("input_pages"))
    counts = m.nodes.agg(
        F.count_if(end).alias("endpoints"), F.count_if(end & (F.col("api_state") == "STATIC_ONLY")).alias("static_only"), F.count_if(end & rank.privileged(F.col("path"))).alias("privileged"),
        F.count_if(end & (F.size("credentials") > 0)).alias("credentialed"), F.count_if(F.col("type") == "third_party").alias("third_parties"),
    )
    return counts.crossJoin(F.broadcast(pages)).crossJoin(F.broadcast(m.unknowns.agg(F.count(F.lit(1)).alias("open_questions"))))


def plan_parts(m, areas: DataFrame | None = None) -> list[Part]:
    """An investigation's scaffold: posture, first steps, lines of inquiry by area, and what crosses areas or leaves the application."""
    areas = settle(communities_as_areas(m.nodes, m.edges) if areas is None else areas, "areas")
    lines, steps, counts = settle(lines_of_inquiry(m, areas), "lines"), recon(m), posture(m)
    return [
        _part("plan.posture", counts, ["endpoints"], [*counts.columns], cap=1),
        _part("plan.recon", steps, ["k"], ["step", "why", "how"]),
        _part("plan.lines_of_inquiry", lines, [-F.col("leverage"), "area"], ["area", "leverage", F.col("why").alias("why_it_matters"), *lines.columns[3:]], cap=AREA_CAP),
    ]


def cut(parts: list[Part], node_evidence: DataFrame) -> DataFrame:
    """(seq, section, k, item, cited): the first items of each section, with the ids of the requests that they cite."""
    rows = []
    for seq, p in enumerate(parts):
        first = p.rows.orderBy("place").limit(p.cap).withColumn("k", F.row_number().over(Window.orderBy("place", "item")))
        rows.append(first.select(F.lit(seq).alias("seq"), F.lit(p.name).alias("section"), "k", "node", "cited", "item"))
    shown = settle(reduce(DataFrame.unionByName, rows), "shown")
    wanted = shown.filter("node IS NOT NULL").select(F.col("node").alias("id")).distinct()
    behind = first_evidence(node_evidence.select("id", "ev").join(wanted, "id", "left_semi"), ["id"], CITED).select(F.col("id").alias("node"), "evidence")
    cited = F.coalesce("cited", "evidence", F.array().cast("array<bigint>"))
    known = shown.join(behind, "node", "left").select("seq", "section", "k", "item", cited.alias("cited"))
    proof = F.concat(F.lit('"evidence":['), F.concat_ws(",", F.transform("cited", lambda i: F.concat(F.lit('"ev_'), i.cast("string"), F.lit('"')))), F.lit("]}"))
    joined = F.concat(F.expr("left(item, length(item) - 1)"), F.when(F.col("item") == "{}", "").otherwise(","), proof)
    return known.withColumn("item", F.when(F.size("cited") > 0, joined).otherwise(F.col("item")))


def fitting(items: DataFrame, budget: int | None) -> DataFrame:
    """The items, section by section, whose sizes up to and with their own are within ``budget`` tokens of four characters.

    There are at most as many items as all caps together, so one window over them is bounded.
    """
    if budget is None:
        return items
    so_far = F.sum(F.ceil(F.length("item") / 4)).over(Window.orderBy("seq", "k").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("so_far", so_far).filter(F.col("so_far") <= budget).drop("so_far")


def coverage(parts: list[Part], kept: DataFrame) -> DataFrame:
    """(section, shown, total, told): how many items of each section are there."""
    totals = reduce(DataFrame.unionByName, [p.total.agg(F.count(F.lit(1)).alias("total")).select(F.lit(p.name).alias("section"), "total") for p in parts])
    shown = kept.groupBy("section").agg(F.count(F.lit(1)).alias("shown"))
    rows = totals.join(shown, "section", "left").select("section", F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), "total")
    more = F.when(F.col("total") > F.col("shown"), " (capped)").otherwise("")
    return rows.withColumn("told", F.concat(F.col("shown").cast("string"), F.lit("/"), F.col("total").cast("string"), more))


def evidence(kept: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(id, item): the requests that items cite, all of them."""
    ids = kept.select(F.explode("cited").alias("id")).distinct()
    view = F.to_json(F.struct("method", "host", "path", "status", "role", "source", F.col("item").cast("string").alias("item")))
    return exchanges.join(ids, "id", "left_semi").select("id", view.alias("item"))


def document(m, scope: str = "whole", lens: str = "attention", cap: int = CAP, budget: int | None = None, osint: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """One row (document, token_estimate, n_items, n_cited): the package of a model as JSON, for the whole or one of ``SCOPES``.

    ``budget``: tokens that the items may have together; ``osint``: one row with the trimmed summary (``osint.summary``);
    ``areas``: (id, area) for the plan, communities by default.
    """
    if scope != "whole" and scope not in SCOPES:
        raise ValueError(f"no scope {scope!r}; there are whole, {', '.join(SCOPES)}")
    if lens not in LENSES:
        raise ValueError(f"no lens {lens!r}; there are {', '.join(LENSES)}")
    wanted = SCOPES.get(scope)
    listed = lambda name: wanted is None or name in wanted
    parts = plan_parts(m, areas) if wanted and "plan" in wanted else []
    parts += [p for p in context_parts(m, lens, cap) if listed(p.name)] + (graph_parts(m, max(cap, GRAPH_CAP)) if listed("graph") else [])
    kept = settle(fitting(cut(parts, m.node_evidence), budget), "kept")
    spark, quoted = kept.sparkSession, lambda c: F.to_json(F.array(c))

    sections = kept.groupBy("section").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"])).alias("text"))
    told = sections.agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("sections"))
    covered = coverage(parts, kept).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "told")))).alias("coverage"))
    proof = evidence(kept, m.exchanges).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: F.concat(F.lit('"ev_'), x["id"].cast("string"), F.lit('":'), x["item"]))).alias("evidence"), F.count(F.lit(1)).alias("n_cited"))
    shape = m.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("shape"))
    roles = m.nodes.filter("type = 'role'").select(F.substring("id", 6, 200).alias("role")).orderBy("role").limit(cap).agg(F.array_sort(F.collect_list("role")).alias("roles"))
    size = kept.agg(F.count(F.lit(1)).alias("n_items"))
    row = spark.range(1)
    for one in (told, covered, proof, shape, roles, size):  # each is one row
        row = row.crossJoin(F.broadcast(one))

    def items(name: str) -> Column:
        return F.concat(F.lit(f'"{name.rpartition(".")[2]}":['), F.coalesce(F.element_at("sections", F.lit(name)), F.lit("")), F.lit("]"))

    plain = {
        "app": F.concat(F.lit('"app":'), F.expr("substring(j, 2, length(j) - 2)")), "lens": F.lit(f'"lens":"{lens}"'), "scope": F.concat(F.lit('"scope":'), F.to_json(F.array(*map(F.lit, m.scope)).cast("array<string>"))),
        "roles": F.concat(F.lit('"roles":'), F.to_json("roles")), "shape": F.concat(F.lit('"shape":'), F.to_json("shape")),
    }
    pieces = [F.lit(f'"instructions":"{INSTRUCTIONS[scope]}"')] if scope in INSTRUCTIONS else []
    pieces += [c for name, c in plain.items() if listed(name)] + [items(p.name) for p in parts if "." not in p.name]
    for group in ("plan", "graph"):
        if within := [items(p.name) for p in parts if p.name.startswith(f"{group}.")]:
            pieces.append(F.concat(F.lit(f'"{group}":{{'), F.concat_ws(",", *within), F.lit("}")))
    if osint is not None:
        row = row.crossJoin(F.broadcast(osint.select("summary").limit(1)))
        pieces.append(F.concat(F.lit('"osint":'), F.col("summary")))
    pieces += [F.concat(F.lit('"coverage":'), F.to_json("coverage")), F.concat(F.lit('"evidence":{'), F.col("evidence"), F.lit("}"))]
    row = row.withColumn("j", quoted(F.lit(m.name)))
    text = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return row.select(text.alias("document"), "n_items", "n_cited").withColumn("token_estimate", F.floor(F.length("document") / 4)).select("document", "token_estimate", "n_items", "n_cited")
