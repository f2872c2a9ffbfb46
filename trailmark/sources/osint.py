"""Saved results about a domain (DNS, certificate, headers, ports) as facts and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers that a site is expected to send.
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy"]


def facts(spark: SparkSession, path: str) -> DataFrame:
    """(run, section, key, value): the leaves of saved JSON files down to three levels."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run"), "value")
    top = raw.select("run", F.explode(F.from_json("value", "map<string, string>")).alias("section", "v"))
    return leaves(top)


def leaves(top: DataFrame, depth: int = 3) -> DataFrame:
    """Leaves of JSON texts ``v``: objects by their keys, arrays by their places."""
    rows, out = top.select("run", "section", F.lit("").alias("key"), "v"), None
    for _ in range(depth):
        shape = F.substring(F.ltrim("v"), 1, 1)
        ends = rows.filter(~shape.isin("{", "[") | F.col("v").isNull())
        out = ends if out is None else out.unionByName(ends)
        at = lambda k: F.when(F.col("key") == "", k).otherwise(F.concat_ws(".", "key", k))
        objects = rows.filter(shape == "{").select("run", "section", "key", F.explode(F.from_json("v", "map<string, string>")).alias("k", "x"))
        arrays = rows.filter(shape == "[").select("run", "section", "key", F.posexplode(F.from_json("v", "array<string>")).alias("k", "x"))
        rows = objects.select("run", "section", at(F.col("k")).alias("key"), F.col("x").alias("v")).unionByName(arrays.select("run", "section", at(F.col("k").cast("string")).alias("key"), F.col("x").alias("v")))
    return out.unionByName(rows).select("run", "section", "key", F.col("v").alias("value"))


def spf_policy(record: Column) -> Column:
    """strict, soft, neutral, open or none of an SPF record."""
    return F.when(~F.coalesce(record.rlike("(?i)^v=spf1"), F.lit(False)), "none").when(record.rlike(r"-all\b"), "strict").when(record.rlike(r"~all\b"), "soft").when(record.rlike(r"\+all\b"), "open").otherwise("neutral")


def dmarc_policy(record: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(record, r"(?i)\bp=(\w+)", 1)), F.lit("")), F.lit("none"))


def header_check(present: Column) -> tuple[Column, Column]:
    """(present, missing) of the expected headers, from names."""
    want = F.array(*map(F.lit, SECURITY_HEADERS))
    have = F.transform(present, F.lower)
    return F.array_intersect(want, have), F.array_except(want, have)


def subdomains(names: DataFrame, domain: str) -> DataFrame:
    """Names below a domain: wildcards and case dropped, one row each."""
    name = F.regexp_replace(F.lower(F.trim("name")), r"^\*\.", "")
    return names.select(name.alias("name")).filter(F.endswith(F.col("name"), F.lit("." + domain))).distinct()


def graph(facts_: DataFrame, nodes: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) hung off ``host`` as EXTERNAL; a subdomain that the capture has as a host is linked, not repeated."""
    kinds = {"dns.A": ("ip", "RESOLVES_TO"), "dns.NS": ("nameserver", "DELEGATED_TO"), "dns.MX": ("mail_server", "MAIL_VIA"), "dns.CNAME": ("dns_name", "ALIASES"), "subdomains.names": ("subdomain", "SUBDOMAIN_OF"), "tls.san": ("certificate", "COVERS"), "ports.open": ("port", "LISTENS_ON"), "files.robots.disallow": ("robots_path", "DISCLOSES")}
    where = F.regexp_replace(F.concat_ws(".", "section", "key"), r"\.\d+(\.port)?$", "")
    table = facts_.sparkSession.createDataFrame([(k, *v) for k, v in kinds.items()], "place string, type string, edge string")
    found = facts_.withColumn("place", where).join(F.broadcast(table), "place").select("type", "edge", F.col("value").alias("label")).distinct()
    known = nodes.filter("type = 'host'").select("label", F.col("id").alias("known"))
    found = found.join(known, "label", "left").withColumn("id", F.coalesce("known", F.concat(F.lit("ext:"), F.col("type"), F.lit(":"), F.col("label"))))
    new = found.filter("known is null").select("id", "type", F.lit(0).alias("layer"), "label")
    return new, found.select(F.lit(f"host:{host}").alias("src"), F.col("id").alias("dst"), F.col("edge").alias("type"), F.lit("EXTERNAL").alias("state"))


_STRINGS = "array<string>"
REPORT = (
    f"host string, generated_at string, dns struct<A: {_STRINGS}, AAAA: {_STRINGS}, MX: {_STRINGS}, NS: {_STRINGS}, CNAME: {_STRINGS}>, tls struct<tls_version: string, issuer: string, not_after: string, days_until_expiry: int>, "
    f"http struct<security_headers_missing: {_STRINGS}>, technology array<struct<name: string>>, email_security struct<spf_note: string, dmarc_policy: string, dmarc_note: string, dkim_selector_found: string>, "
    f"subdomains struct<count: int, names: {_STRINGS}>, registration struct<registrar: string>, ip_geo struct<network: string, country: string>, files struct<robots: struct<disallow: {_STRINGS}>>, "
    f"archive struct<last_snapshot: string>, ports struct<open: array<struct<port: int>>>, notes {_STRINGS}"
)
SAMPLE, ROBOTS = 25, 20
PROVENANCE = "external recon, collected live against the target; not from the capture"


def summary(raw: DataFrame) -> DataFrame:
    """(run, summary): saved results (run, value) trimmed to what a reader of a package needs, as JSON; what is empty is left out."""
    r = raw.select("run", F.from_json("value", REPORT).alias("r")).select("run", "r.*")
    some = lambda c: F.when(F.size(c) > 0, F.col(c) if isinstance(c, str) else c)

    def told(c: str, fields: list[str], texts: bool = True) -> Column:
        """A struct of the fields that say something; null if none does."""
        values = [F.nullif(F.col(f"{c}.{f}").cast("string"), F.lit("")).alias(f) if texts else some(f"{c}.{f}").alias(f) for f in fields]
        return F.when(F.coalesce(*[v.isNotNull().cast("int") * 0 + F.when(v.isNotNull(), 1) for v in values]).isNotNull(), F.struct(*values)).alias(c)

    view = F.struct(
        "host", F.col("generated_at").alias("collected_at"), told("dns", ["A", "AAAA", "MX", "NS", "CNAME"], texts=False), told("tls", ["tls_version", "issuer", "not_after", "days_until_expiry"]),
        some("http.security_headers_missing").alias("security_headers_missing"), some(F.transform("technology", lambda t: t["name"])).alias("technology"),
        told("email_security", ["spf_note", "dmarc_policy", "dmarc_note", "dkim_selector_found"]), F.col("subdomains.count").alias("subdomains_count"), some(F.slice("subdomains.names", 1, SAMPLE)).alias("subdomains_sample"),
        F.nullif("registration.registrar", F.lit("")).alias("registrar"), told("ip_geo", ["network", "country"]).alias("hosting"), some(F.slice("files.robots.disallow", 1, ROBOTS)).alias("robots_disallow"),
        F.nullif("archive.last_snapshot", F.lit("")).alias("wayback_last_snapshot"), some(F.transform("ports.open", lambda p: p["port"])).alias("open_ports"), some("notes").alias("notes"), F.lit(PROVENANCE).alias("provenance"),
    )
    return r.select("run", F.to_json(view).alias("summary"))
