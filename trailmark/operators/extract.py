"""References in scripts and pages: calls with their methods, API-looking strings, forms, workers and links.

Each kind of reference is one pattern whose matches come out as rows; no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.classify import API_HINT
from trailmark.functions.template import template_path
from trailmark.functions.text import let

#: Characters of a body that are scanned; longer ones are flagged.
MOST = 10 * 1024 * 1024
URL = r"(?:\{param\})?(?:https?:)?/[^\s\"'`<>\\]{0,300}?"
FILES = r"(?i)\.(?:png|jpe?g|gif|svg|ico|webp|avif|css|woff2?|ttf|otf|eot|map|mp4|webm|mp3|html?|js|mjs|json|txt|md)$"
# How calls are written.
VERB_CALL = r"(?i)\.(get|post|put|patch|delete|head)\s*\(\s*([\"'`])(" + URL + r")\2"
XHR_CALL = r"(?i)\.open\s*\(\s*[\"'](GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[\"']\s*,\s*([\"'`])(" + URL + r")\2"
FETCH_CALL = r"(?:\b(?:fetch|axios|ajax|request)|\$http)\s*\(\s*([\"'`])(" + URL + r")\1"
#: What follows a call up to its end: 200 characters, no further than the next statement or call.
CALL_TAIL = r"((?:(?!;|fetch\(|axios|\.open\(|\.then\(|\n\n)[\s\S]){0,200})"
METHOD = r"(?i)method\s*:\s*[\"'`](GET|POST|PUT|PATCH|DELETE|HEAD)[\"'`]"
STRING = r"([\"'`])(" + URL + r")\1"
FORM = r"(?i)<form\b([^>]*)>"


def scanned(body: Column) -> Column:
    """The part of the body that is scanned, expressions of template literals as ``{param}``."""
    return F.regexp_replace(F.substring(body, 1, MOST), r"\$\{[^{}`]{0,120}\}", "{param}")


def _ref(method: Column, raw: Column, kind: str) -> Column:
    return F.struct(F.upper(method).alias("method"), raw.alias("raw"), F.lit(kind).alias("kind"))


def _all(body: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), group)


def raw_references(body: Column) -> Column:
    """array<struct<method, raw, kind>> of a script."""
    return let(scanned(body), _raw_references)


def _raw_references(b: Column) -> Column:
    none = F.lit(None).cast("string")

    def calls(pattern: str) -> Column:
        return F.transform(F.arrays_zip(_all(b, pattern, 1).alias("m"), _all(b, pattern, 3).alias("u")), lambda x: _ref(x["m"], x["u"], "call"))

    fetches = F.transform(
        F.arrays_zip(_all(b, FETCH_CALL + CALL_TAIL, 2).alias("u"), _all(b, FETCH_CALL + CALL_TAIL, 3).alias("t")),
        lambda x: _ref(F.nullif(F.regexp_extract(x["t"], METHOD, 1), F.lit("")), x["u"], "call"),
    )
    called = F.concat(_all(b, VERB_CALL, 3), _all(b, XHR_CALL, 3), _all(b, FETCH_CALL, 2))
    strings = let(called, lambda c: F.filter(F.transform(_all(b, STRING, 2), lambda u: _ref(none, u, "string")), lambda r: ~F.array_contains(c, r["raw"])))
    return F.concat(calls(XHR_CALL), calls(VERB_CALL), fetches, strings)


def form_references(html: Column) -> Column:
    """array<struct<method, raw, kind>> of the forms of a page; a form without a method is a GET."""
    attrs = _all(html, FORM, 1)

    def attr(a: Column, name: str) -> Column:
        return F.regexp_extract(a, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)

    return F.transform(attrs, lambda a: _ref(F.when(attr(a, "method") == "", "GET").otherwise(attr(a, "method")), attr(a, "action"), "form"))


def normal_references(refs: Column) -> Column:
    """Distinct (method, host, path, kind) of an array of references (method, raw, kind); what is no path is left out.

    A slash at the end is where code adds a value.  A path that begins with a value and names no API says nothing.
    """

    def bare(r: Column) -> Column:
        raw = F.regexp_replace(F.trim(r["raw"]), r"^\{param\}", "")
        return F.struct(r["method"].alias("method"), r["kind"].alias("kind"), F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw).alias("raw"))

    def split(r: Column) -> Column:
        raw = r["raw"]
        absolute = raw.rlike(r"(?i)^https?://")
        host = F.when(absolute, F.nullif(F.lower(F.regexp_extract(raw, r"(?i)^https?://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")))
        path = F.regexp_replace(F.when(absolute, F.regexp_replace(raw, r"(?i)^https?://[^/?#]*", "")).otherwise(raw), r"[?#][\s\S]*$", "")
        return F.struct(r["method"].alias("method"), host.alias("host"), F.when(absolute & (path == ""), "/").otherwise(path).alias("path"), r["kind"].alias("kind"))

    def whole(r: Column) -> Column:
        path = F.when((F.length(r["path"]) > 1) & r["path"].endswith("/"), F.concat(r["path"], F.lit("{param}"))).otherwise(r["path"])
        return F.struct(r["method"].alias("method"), r["host"].alias("host"), path.alias("path"), r["kind"].alias("kind"))

    def templated(r: Column) -> Column:
        return F.struct(r["method"].alias("method"), r["host"].alias("host"), template_path(r["path"]).alias("path"), r["kind"].alias("kind"))

    def kept(r: Column) -> Column:
        path, own = r["path"], r["host"].isNull()
        api = path.rlike(API_HINT)
        keep = ~((path == "/") & own) & ~(own & path.startswith("{param}")) & ~(own & path.startswith("/{param}") & ~api)
        return keep & ((r["kind"] != "string") | (api & ~path.rlike(FILES)))

    found = F.transform(F.transform(F.transform(refs, bare), split), whole)
    paths = F.filter(found, lambda r: r["path"].startswith("/") & ~r["path"].contains("//") & (F.length(r["path"]) <= 200))
    return F.array_distinct(F.filter(F.transform(paths, templated), kept))


def normalised(df: DataFrame, refs: str = "ref") -> DataFrame:
    """Rows with ``refs`` (struct method, raw, kind) as method, ref_host, ref_path, kind."""
    others = [c for c in df.columns if c != refs]
    rows = df.select(*others, F.explode(normal_references(F.array(F.col(refs)))).alias("r"))
    return rows.select(*others, "r.method", F.col("r.host").alias("ref_host"), F.col("r.path").alias("ref_path"), "r.kind").distinct()


def script_references(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    return normalised(df.select(F.col(id_col), F.explode(raw_references(F.col(body_col))).alias("ref")))


def page_references(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Forms, and the references of inline scripts."""
    inline = F.concat_ws("\n", _all(F.col(html_col), r"(?is)<script\b[^>]*>(.*?)</script>", 1))
    return normalised(df.select(F.col(id_col), F.explode(F.concat(form_references(F.col(html_col)), raw_references(inline))).alias("ref")))


def script_assets(body: Column, source_map: Column | None = None) -> Column:
    """array<struct<kind, raw>>: source maps, workers, service workers and imported scripts that a script names.

    ``source_map``: the value of the response's header that names one.
    """
    named_once = [("worker", r"new\s+(?:Shared)?Worker"), ("service_worker", r"serviceWorker\s*\.\s*register"), ("import_scripts", "importScripts")]
    quoted = r"\s*\(\s*([\"'`])([^\"'`\s]{1,200})\1"

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("raw")))

    b = F.substring(F.coalesce(body, F.lit("")), 1, MOST)
    maps = F.concat(_all(b, r"//[#@]\s*sourceMappingURL=([^\s'\"]+)", 1), F.array_compact(F.array(source_map if source_map is not None else F.lit(None).cast("string"))))
    return F.concat(named("sourcemap", maps), *[named(kind, _all(b, pattern + quoted, 2)) for kind, pattern in named_once])


def resolved(raw: Column, host: Column, path: Column) -> Column:
    """struct<host, path> of a file that a script at ``host`` and ``path`` names: templated, without ``.`` and ``..``.

    Null for data, blobs, what code puts together at run time, and what is no path of a file.
    """
    u = F.trim(raw)
    authority = r"^(?:[^/?#]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)"
    named = F.struct(u.alias("u"), (u.contains("://") | u.startswith("//")).alias("absolute"), F.regexp_extract(u, authority, 1).alias("at"), F.regexp_replace(path, r"[?#][\s\S]*$", "").alias("base"))

    def own(x: Column) -> Column:
        """The path that is named, by itself."""
        told = F.when(x["absolute"], F.regexp_replace(x["u"], r"^(?:[^/?#]*:)?//[^/?#]*", "")).otherwise(x["u"])
        return F.struct(x["u"].alias("u"), x["absolute"].alias("absolute"), F.when(x["absolute"] & (x["at"] != ""), F.lower(x["at"])).otherwise(host).alias("at"), x["base"].alias("base"), F.regexp_replace(told, r"[?#][\s\S]*$", "").alias("own"))

    def whole(x: Column) -> Column:
        """The path from the root on, in segments; dot segments are still in it."""
        beside = F.regexp_replace(F.concat(F.regexp_replace(x["base"], r"[^/]*$", ""), x["own"]), "/{2,}", "/")
        target = F.when(x["own"] == "", x["base"]).when(x["own"].startswith("/"), x["own"]).otherwise(beside)
        return F.struct(x["u"].alias("u"), x["absolute"].alias("absolute"), x["at"].alias("at"), x["own"].alias("own"), F.split(target, "/").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(s == ".", done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    def plain(x: Column) -> Column:
        rest = F.slice(x["parts"], 2, F.greatest(F.size(x["parts"]) - 1, F.lit(0)))
        walked = F.concat_ws("/", F.aggregate(rest, F.array(F.lit("")).cast("array<string>"), step))
        walked = F.concat(walked, F.when(F.element_at(x["parts"], -1).isin(".", ".."), "/").otherwise(""))
        return F.struct(x["u"].alias("u"), x["at"].alias("at"), F.when(x["absolute"], x["own"]).when(walked == "", "/").otherwise(walked).alias("to"))

    def known(x: Column) -> Column:
        good = (x["u"] != "") & ~x["u"].rlike(r"^(?:data:|blob:)") & ~x["u"].contains("{param}") & x["to"].startswith("/") & ~x["to"].contains("//") & (F.length(x["to"]) <= 200)
        return F.when(good, F.struct(x["at"].alias("host"), template_path(x["to"]).alias("path")))

    return let(let(let(let(named, own), whole), plain), known)


def resolved_assets(assets: Column, host: Column, path: Column) -> Column:
    """Distinct array<struct<kind, host, path>> of ``script_assets`` of the script at ``host`` and ``path``, in order."""
    found = F.transform(assets, lambda a: F.struct(a["kind"].alias("kind"), resolved(a["raw"], host, path).alias("at")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda a: a["at"].isNotNull()), lambda a: F.struct(a["kind"].alias("kind"), a["at"]["host"].alias("host"), a["at"]["path"].alias("path")))))


def links(html: Column) -> Column:
    """Targets of links in order, fragments dropped, other schemes than http left out."""
    found = F.transform(_all(html, r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), lambda u: F.regexp_replace(F.trim(u), "#.*$", ""))
    return F.filter(found, lambda u: (u != "") & ~u.rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.\-]*:"))


def disallowed(robots: Column) -> Column:
    """array<string>: the path prefixes that a robots.txt closes, to whichever agent."""
    return F.filter(_all(robots, r"(?im)^disallow:\s*(\S*)", 1), lambda p: p != "")


def sitemaps(robots: Column) -> Column:
    """array<string>: the site maps that a robots.txt names."""
    return _all(robots, r"(?im)^sitemap:\s*(\S+)", 1)


def sitemap_pages(xml: Column) -> Column:
    """array<string>: the addresses that a site map lists, in order."""
    return F.transform(_all(xml, r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def admitted(links_: DataFrame, scope_host: str, per_template: int = 25, per_path: int = 15, closed: Sequence[str] = ()) -> DataFrame:
    """(seq, host, path, query, reason) for candidate links in order of ``seq``: what a crawl would take, and why not.

    Columns in: seq, host, path, query.  ``closed``: prefixes of ``disallowed``, those of one host.  Reasons: out_of_scope,
    unsafe, robots, duplicate, template_cap, variant_cap, ok.
    """
    template = template_path(F.col("path"))
    unsafe = F.col("path").rlike(r"(?i)(logout|signout|sign-out|delete|remove|destroy)")
    closed_path = F.exists(F.array(*map(F.lit, closed)).cast("array<string>"), lambda p: F.startswith("path", p))
    first = Window.partitionBy("host", "path", "query").orderBy("seq")
    rows = links_.withColumn("template", template).withColumn("reason", F.when(~F.col("host").eqNullSafe(F.lit(scope_host)), "out_of_scope").when(unsafe, "unsafe").when(closed_path, "robots"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "duplicate").otherwise(F.col("reason")))
    open_ = F.col("reason").isNull().cast("int")
    by_path = Window.partitionBy("host", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.sum(open_).over(by_path) > per_path), "variant_cap").otherwise(F.col("reason")))
    by_template = Window.partitionBy("host", "template").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.sum(open_).over(by_template) > per_template), "template_cap").otherwise(F.col("reason")))
    return rows.select("seq", "host", "path", "query", F.coalesce("reason", F.lit("ok")).alias("reason"))
