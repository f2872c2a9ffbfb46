"""Links between pages, code and endpoints: pruning, referers, references, reconciliation and open questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.domains import in_scope
from trailmark.functions.template import match_key


def not_found(nodes: DataFrame) -> DataFrame:
    """Routes and endpoints that only ever answered 404 or 410 (and answered at all)."""
    only = (F.size("statuses") > 0) & F.forall("statuses", lambda s: s.isin(404, 410))
    return nodes.filter(F.col("type").isin("route", "endpoint") & only).select("id")


def prune(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes that were not found, their edges and their parameters."""
    gone = not_found(nodes)
    params = edges.filter("type = 'USES_PARAMETER'").join(gone, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    kept = nodes.join(gone.unionByName(params), "id", "left_anti")
    links = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, links.select(*edges.columns)


def referer_edges(x: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """From the page that was open to what was requested: CALLS, INCLUDES or NAVIGATES_TO; contributions with ev."""
    pages = nodes.filter("type = 'route'").select(F.col("id").alias("page"), F.col("host").alias("referer_host"), F.col("path").alias("referer_path"))
    targets = nodes.select(F.col("id").alias("node_id"))
    asked = x.filter(F.col("first_party") & F.col("node_id").isNotNull() & F.col("referer_host").isNotNull() & in_scope(F.col("referer_host"), scope))
    kind = F.when(F.col("kind") == "endpoint", "CALLS").when(F.col("kind") == "script", "INCLUDES").otherwise("NAVIGATES_TO")
    found = asked.join(pages, ["referer_host", "referer_path"]).join(targets, "node_id", "left_semi").filter(F.col("page") != F.col("node_id"))
    return found.select(F.col("page").alias("src"), F.col("node_id").alias("dst"), kind.alias("type"), F.lit("OBSERVED").alias("state"), F.col("id").alias("ev"))


def references(x: DataFrame, nodes: DataFrame, scope: list[str], primary: str | None) -> DataFrame:
    """One row per reference in code: src, method, host, path, base_host, ev; unknown hosts and methods are null."""
    at_page = F.when(F.col("referer_host").isNotNull() & in_scope(F.col("referer_host"), scope), F.col("referer_host")).otherwise(F.lit(primary))
    base = F.when(~F.col("first_party") | (F.col("kind") == "script"), at_page).otherwise(F.col("host"))
    rows = x.filter(~F.col("probe") & F.col("node_id").isNotNull() & (F.size("js_refs") > 0)).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    rows = rows.select(F.col("node_id").alias("src"), "first_party", base.alias("base_host"), F.col("id").alias("ev"), F.explode("js_refs").alias("r"))
    return rows.select("src", "first_party", "base_host", "ev", "r.method", "r.host", "r.path")


def linked_references(refs: DataFrame, nodes: DataFrame, scope: list[str], primary: str | None) -> tuple[DataFrame, DataFrame]:
    """(edge contributions, contributions of nodes that only code names) of references.

    A reference matches every endpoint seen at run time with its match key whose host and method do not contradict it.
    Without a match it becomes an endpoint of its own, ``*`` for an unknown method; a host out of scope becomes a third
    party; paths relative to somebody else's code are left out.
    """
    outside = refs.filter(F.col("host").isNotNull() & ~in_scope(F.col("host"), scope))
    inside = refs.filter((F.col("host").isNull() & F.col("first_party")) | in_scope(F.col("host"), scope)).withColumn("key", match_key(F.col("path")))
    seen = nodes.filter("type = 'endpoint'").select(F.col("id").alias("dst"), F.col("host").alias("at"), F.col("method").alias("verb"), match_key(F.col("path")).alias("key"))
    fits = (F.col("r.key") == F.col("s.key")) & (F.col("r.host").isNull() | (F.col("r.host") == F.col("s.at"))) & (F.col("r.method").isNull() | (F.col("r.method") == F.col("s.verb")))
    hits = inside.alias("r").join(seen.alias("s"), fits).select("r.src", "s.dst", "r.ev")
    lost = inside.alias("r").join(seen.alias("s"), fits, "left_anti")
    target, verb = F.coalesce("host", "base_host"), F.coalesce("method", F.lit("*"))
    new_id = F.concat(F.lit("endpoint:"), verb, F.lit(":"), target, F.lit(":"), F.col("path"))
    label = F.concat(verb, F.lit(" "), F.when(target == F.lit(primary), "").otherwise(target), F.col("path"))
    named = lost.select("src", new_id.alias("id"), label.alias("label"), target.alias("host"), "path", "method", "ev")
    third = outside.select("src", F.concat(F.lit("host:"), F.col("host")).alias("id"), F.col("host").alias("label"), "ev")
    edges = hits.unionByName(named.select("src", F.col("id").alias("dst"), "ev")).unionByName(third.select("src", F.col("id").alias("dst"), "ev"))
    edges = edges.select("src", "dst", F.lit("REFERENCES").alias("type"), F.lit("INFERRED").alias("state"), "ev")
    none = F.lit(None).cast("string")
    extra = named.select("id", F.lit("endpoint").alias("type"), F.lit(4).alias("layer"), "label", "host", "path", "method", "ev").unionByName(
        third.select("id", F.lit("third_party").alias("type"), F.lit(5).alias("layer"), "label", none.alias("host"), none.alias("path"), none.alias("method"), "ev")
    )
    cited = hits.select(F.col("dst").alias("id"), "ev")
    return edges, extra.unionByName(cited, allowMissingColumns=True)


def reconcile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with api_state of endpoints: named in code, seen at run time, or both."""
    named = edges.filter("type = 'REFERENCES'").select(F.col("dst").alias("id")).distinct().withColumn("named", F.lit(True))
    state = F.when(F.col("named") & (F.col("requests") > 0), "BOTH").when(F.col("named"), "STATIC_ONLY").otherwise("RUNTIME_ONLY")
    return nodes.join(named, "id", "left").withColumn("api_state", F.when(F.col("type") == "endpoint", state)).drop("named")


def worker_links(x: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(src, dst, kind, ev) of workers that scripts start, and (src, host, path, captured) of source maps they name."""
    rows = x.filter(~F.col("probe") & F.col("first_party") & (F.col("kind") == "script")).select(F.col("node_id").alias("src"), F.col("id").alias("ev"), F.explode("js_assets").alias("a"))
    rows = rows.select("src", "ev", "a.*").filter(in_scope(F.col("host"), scope))
    workers = rows.filter("kind <> 'sourcemap'").select("src", F.concat(F.lit("script:"), F.col("host"), F.col("path")).alias("dst"), "kind", "ev")
    got = x.filter(~F.col("probe") & (F.col("status") < 400)).select("host", F.col("path_template").alias("path")).distinct().withColumn("captured", F.lit(True))
    maps = rows.filter("kind = 'sourcemap'").select("src", "host", "path").distinct().join(got, ["host", "path"], "left")
    return workers, maps.select("src", "host", "path", F.coalesce("captured", F.lit(False)).alias("captured"))


def unknowns(nodes: DataFrame, name: str, roles_seen: bool, creds_seen: bool, skipped: int = 0, truncated: DataFrame | None = None, maps: DataFrame | None = None) -> DataFrame:
    """Named blind spots: type, entity, we_know, we_dont_know, next_step."""
    spark = nodes.sparkSession
    schema = "type string, entity string, we_know array<string>, we_dont_know string, next_step string"
    whole = []
    if not roles_seen and not creds_seen:
        whole.append(("AUTHENTICATED_STATE_NOT_OBSERVED", f"app:{name}", ["no credentials were sent", "no role was given"], "how the application behaves after login", "capture a logged-in session with a role"))
    elif not roles_seen:
        whole.append(("ROLE_NOT_TAGGED", f"app:{name}", ["credentials were sent", "no role was given"], "whose requests these are", "capture each account with its role"))
    if skipped:
        whole.append(("CAPTURE_ITEMS_SKIPPED", f"app:{name}", [f"{skipped} items were not readable"], "what these requests held", "export the history again"))
    out = spark.createDataFrame(whole, schema)

    def rule(rows: DataFrame, kind: str, know, unknown: str, step: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("type"), F.col("id").alias("entity"), know.alias("we_know"), F.lit(unknown).alias("we_dont_know"), F.lit(step).alias("next_step"))

    ends = nodes.filter("type = 'endpoint'")
    known = F.array_compact(F.array(F.lit("named in code"), F.lit("never requested"), F.when(F.col("method").isNull(), "its method is not known")))
    errored = (F.size("statuses") > 0) & F.forall("statuses", lambda s: s >= 400)
    parts = [
        rule(ends.filter("api_state = 'STATIC_ONLY'"), "API_PURPOSE_UNKNOWN", known, "what it does and whether it answers", "request it in an authorised session"),
        rule(ends.filter(errored), "ENDPOINT_ONLY_ERRORED", F.array(F.concat(F.lit("statuses: "), F.concat_ws(", ", F.col("statuses").cast("array<string>")))), "how it answers valid requests", "use the feature as intended"),
        rule(ends.filter(F.size("roles") > 0), "AUTHORIZATION_UNKNOWN", F.array(F.concat(F.lit("reached by: "), F.concat_ws(", ", "roles"))), "whether access is checked", "repeat with a second account and compare"),
    ]
    if truncated is not None:
        cut = nodes.join(truncated, "id", "left_semi")
        parts.append(rule(cut, "SCRIPT_PARTIALLY_SCANNED", F.array(F.lit("the script is longer than is scanned")), "what the rest refers to", "scan the script by itself"))
    if maps is not None:
        parts.append(rule(maps.filter(~F.col("captured")).withColumnRenamed("src", "id"), "SOURCE_MAP_NOT_CAPTURED", F.array(F.concat(F.lit("a source map is named: "), F.col("path"))), "the original sources", "request the map and capture again"))
    for p in parts:
        out = out.unionByName(p)
    return out
