"""Readers of proxy XML, logger CSV, HAR and saved JSON lines; each gives masked exchanges.

Masking is part of the same plan as decoding: nothing unmasked is written, cached or checkpointed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions import classify, http, redact
from trailmark.functions.template import query_pairs, route_template, template_path
from trailmark.operators import content, extract, stack
from trailmark.schema import EXCHANGE, conform
from trailmark.tables import settle

ITEM = "url string, host string, port int, method string, scheme string, path string, mime string, status int, request binary, response binary, truncated boolean, source string, item bigint"
HOST, METHOD = r"^[a-z0-9.\-:\[\]]{1,255}$", r"^[A-Z]{1,20}$"
PANE = 20_000
#: What the nodes, edges and unknowns of a graph are made of: all but texts, masked values and technologies, which are tables of their own.
GRAPH = [c for c in EXCHANGE.fieldNames() if c not in ("req", "resp", "secrets", "stack")]


def check_entities(spark: SparkSession, path: str) -> None:
    """Refuse XML files that declare entities, in UTF-8 or UTF-16."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    plain = F.replace(F.decode(F.col("content"), "ISO-8859-1"), F.lit("\x00"))  # UTF-16 of either order reads as ASCII then
    seen = F.upper(plain).contains("<!ENTITY")
    bad = raw.filter(seen).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']} declares entities")


def proxy_xml(spark: SparkSession, path: str) -> DataFrame:
    """Items of saved proxy XML."""
    check_entities(spark, path)
    text = "struct<_VALUE: string, _base64: boolean>"
    schema = f"url string, host struct<_VALUE: string, _ip: string>, port int, protocol string, method string, path string, mimetype string, status string, request {text}, response {text}"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    pane = lambda c: F.when(F.col(f"{c}._base64"), http.base64_or_raw(F.col(f"{c}._VALUE"))).otherwise(F.encode(F.col(f"{c}._VALUE"), "UTF-8"))
    return rows.select(
        "url", F.col("host._VALUE").alias("host"), "port", "method", F.col("protocol").alias("scheme"), "path", F.col("mimetype").alias("mime"), F.expr("try_cast(status as int)").alias("status"),
        pane("request").alias("request"), pane("response").alias("response"), F.lit(False).alias("truncated"), F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("item"),
    )


def logger_csv(spark: SparkSession, path: str, skip_tools: list[str] | None = None, only_tools: list[str] | None = None, marked: bool = False) -> DataFrame:
    """Items of a logger's CSV export; ``marked``: with the tool of each, and those of unwanted tools too, as ``filtered``.

    A row with only its first cell filled, and not by a number, goes on with the response of the row before it (the
    request, if that has none); rows of a file are put in order for that.  Cells of 32000 to 32767 characters are cut.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    missing = {"Method", "Host", "Request", "Response"} - set(rows.columns)
    if missing:
        raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
    first = rows.columns[0]
    rows = rows.select("*", F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("item"))
    others = [F.col(f"`{c}`").isNull() for c in rows.columns if c not in (first, "source", "item")]
    spill = F.lit(True)
    for o in others:
        spill = spill & o
    rows = rows.withColumn("spill", spill & F.col(f"`{first}`").isNotNull() & ~F.col(f"`{first}`").rlike(r"^\s*\d+\s*$"))
    w = Window.partitionBy("source").orderBy("item")
    rows = rows.withColumn("start", F.max(F.when(~F.col("spill"), F.col("item"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = rows.filter("spill").groupBy("source", "start").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("item", F.col(f"`{first}`").alias("t")))), lambda x: x["t"])).alias("more"))
    full = rows.filter(~F.col("spill")).join(more, ["source", "start"], "left")
    cell = lambda c: F.col(c) if c in full.columns else F.lit(None).cast("string")
    tool = F.coalesce(F.nullif(F.trim(cell("Tool")), F.lit("")), F.lit("?"))
    names = lambda tools: [t.strip().lower() for t in tools or [] if t.strip()]
    unwanted = F.lower(tool).isin(names(skip_tools)) if names(skip_tools) else F.lit(False)
    unwanted = unwanted | ~F.lower(tool).isin(names(only_tools)) if names(only_tools) else unwanted
    full = full.withColumns({"tool": tool, "filtered": unwanted})
    full = full if marked else full.filter(~F.col("filtered"))
    in_response = F.col("Response").isNotNull()
    request = F.when(in_response, F.col("Request")).otherwise(F.concat(F.coalesce("Request", F.lit("")), F.coalesce("more", F.lit(""))))
    response = F.when(in_response, F.concat(F.col("Response"), F.coalesce("more", F.lit(""))))
    cut = F.col("more").isNull() & (F.length("Request").between(32_000, 32_767) | F.coalesce(F.length("Response").between(32_000, 32_767), F.lit(False)))
    query = F.when(F.coalesce(cell("Query"), F.lit("")) != "", F.concat(F.lit("?"), cell("Query"))).otherwise("")
    return full.select(
        cell("URL").alias("url"), F.col("Host").alias("host"), F.expr("try_cast(Port as int)" if "Port" in full.columns else "cast(null as int)").alias("port"), F.col("Method").alias("method"), cell("Protocol").alias("scheme"),
        F.concat(cell("Path"), query).alias("path"), cell("MIME type").alias("mime"), F.expr("try_cast(`Status code` as int)" if "Status code" in full.columns else "cast(null as int)").alias("status"),
        http.base64_or_raw(request).alias("request"), http.base64_or_raw(response).alias("response"), F.coalesce(cut, F.lit(False)).alias("truncated"), "source", "item", *(["tool", "filtered"] if marked else []),
    )


def har(spark: SparkSession, path: str) -> DataFrame:
    """Items of HAR files, HTTP/2 pseudo headers dropped; an entry without a response status has no host, so it is no exchange."""
    pair = "array<struct<name: string, value: string>>"
    schema = (
        f"log struct<entries: array<struct<request: struct<method: string, url: string, httpVersion: string, headers: {pair}, postData: struct<text: string, params: {pair}>>, "
        f"response: struct<status: int, statusText: string, headers: {pair}, content: struct<mimeType: string, text: string, encoding: string>>>>>, _corrupt string"
    )
    raw = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(path).withColumn("source", F.input_file_name())
    rows = raw.select("source", "_corrupt", F.posexplode_outer("log.entries").alias("item", "e"))
    rows = rows.filter(F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("no HAR: "), F.col("source"))).cast("boolean")).otherwise(F.col("e").isNotNull()))
    answered = F.coalesce(F.col("e.response.status") > 0, F.lit(False))
    url = F.col("e.request.url")
    drop = ["content-encoding", "transfer-encoding", "content-length"]

    def head(first: Column, hs: Column) -> Column:
        kept = F.filter(hs, lambda h: ~h["name"].startswith(":") & ~F.lower(h["name"]).isin(drop))
        return F.concat_ws("\r\n", F.concat(F.array(first), F.transform(kept, lambda h: F.concat(h["name"], F.lit(": "), h["value"]))), F.lit(""), F.lit(""))

    target = F.regexp_replace(url, r"(?i)^https?://[^/?#]*", "")
    target = F.when(target == "", "/").otherwise(target)
    params = F.concat_ws("&", F.transform("e.request.postData.params", lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(F.coalesce(p["value"], F.lit(""))))))
    sent = F.coalesce(F.col("e.request.postData.text"), params, F.lit(""))
    got = F.coalesce(F.when(F.col("e.response.content.encoding") == "base64", F.try_to_binary(F.col("e.response.content.text"), F.lit("base64"))), F.encode(F.coalesce("e.response.content.text", F.lit("")), "UTF-8"))
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    port = F.regexp_extract(url, r"(?i)^https?://[^/?#]*:(\d+)", 1)
    return rows.select(
        url.alias("url"), F.when(answered, F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))).alias("host"), F.coalesce(F.expr("null").cast("int"), F.when(port != "", port.cast("int")), F.when(scheme == "https", 443).otherwise(80)).alias("port"),
        F.upper("e.request.method").alias("method"), scheme.alias("scheme"), target.alias("path"), F.col("e.response.content.mimeType").alias("mime"), F.col("e.response.status").alias("status"),
        F.encode(F.concat(head(F.concat_ws(" ", F.col("e.request.method"), target, F.lit("HTTP/1.1")), F.col("e.request.headers")), sent), "UTF-8").alias("request"),
        F.concat(F.encode(head(F.concat_ws(" ", F.lit("HTTP/1.1"), F.col("e.response.status").cast("string"), F.col("e.response.statusText")), F.col("e.response.headers")), "UTF-8"), got).alias("response"),
        F.lit(False).alias("truncated"), "source", F.col("item").cast("long").alias("item"),
    )


def _decoded(items: DataFrame) -> DataFrame:
    """Messages taken apart, still unmasked; rows with a malformed host or method are left out."""
    ok = items.filter(well_formed()).withColumns({"host": F.lower(F.trim("host")), "method": F.upper(F.trim("method"))})
    # Named columns, not expressions: what several columns below need is planned and worked out once.
    rows = ok.withColumns({"asked_in": http.parted(F.col("request")), "told_in": http.parted(F.coalesce("response", F.encode(F.lit(""), "UTF-8")))})
    rows = rows.withColumns({"rh": http.headers(F.col("asked_in")[0]), "sh": http.headers(F.col("told_in")[0]), "req_line": http.first_line(F.col("asked_in")[0]), "resp_line": http.first_line(F.col("told_in")[0])})
    rows = rows.withColumns({f"{side}_{c}": http.header(F.col(hs), f"{c}-encoding") for side, hs in (("req", "rh"), ("resp", "sh")) for c in ("transfer", "content")})
    rows = rows.withColumn("req_text", http.body_text(F.col("asked_in"), F.col("req_transfer"), F.col("req_content")))
    rows = rows.withColumn("resp_text", http.body_text(F.col("told_in"), F.col("resp_transfer"), F.col("resp_content")))
    rows = rows.withColumn("path", F.coalesce("path", F.nullif(F.regexp_extract("req_line", r"^\S+\s+(\S+)", 1), F.lit("")), F.lit("/")))
    rows = rows.withColumn("mime", F.lower(F.coalesce(F.substring_index(http.header(F.col("sh"), "content-type"), ";", 1), F.col("mime"), F.lit(""))))
    rows = rows.withColumn("status", F.coalesce("status", F.expr("try_cast(regexp_extract(resp_line, '^HTTP/[0-9.]+ ([0-9]{3})', 1) as int)")))
    rows = rows.withColumns({"query": query_pairs(F.col("path")), "templated": template_path(F.col("path")), "sent_type": http.header(F.col("rh"), "content-type"), "cookies_set": http.set_cookies(F.col("sh"))})
    rows = rows.withColumn("template", route_template(F.col("path"), F.col("templated")))
    rows = rows.withColumns({"markup": classify.is_html(F.col("mime")), "script": classify.is_script(F.col("mime"), F.col("template")), "raw_path": F.substring_index("path", "?", 1)})
    told, marked, walked = stack.looked_at(F.col("sh"), F.concat(F.transform("cookies_set", lambda c: c["name"]), http.cookie_names(F.col("rh"))), F.col("path"))
    return rows.withColumns({"code": F.when(F.col("markup") | F.col("script"), F.col("resp_text")), "told": told, "marked": marked, "walked": walked})


#: What technologies are told by.
TELLING = ["told", "marked", "walked", "code"]


def technologies(items: DataFrame) -> DataFrame:
    """(name, category, how, version, times) of items: responses that tell the same are looked at once, ``times`` is their number."""
    alike = _decoded(items).groupBy(*TELLING).agg(F.count(F.lit(1)).alias("times"))
    # The outer form, for the plain one is filtered by what it explodes, so that it would be worked out twice.
    return alike.select("times", F.explode_outer(stack.detected_in(*map(F.col, TELLING))).alias("s")).filter("s IS NOT NULL").select("s.*", "times")


def exchanges(items: DataFrame, role: str | None = None, key: bytes = b"", columns: Sequence[str] | None = None) -> DataFrame:
    """Masked exchanges of items; rows with a malformed host or method are left out.

    Ids number the items from 1 in the order of source and item.  ``columns``: those that are asked for (of a pane also
    its parts, as ``resp.body``); others are not worked out and are null or empty.
    """
    wanted = set(EXCHANGE.fieldNames() if columns is None else columns)
    rows = _decoded(items)
    # Many responses hold the same page or script: what is found in it is worked out once.
    finds, inputs = {}, []
    if "stack" in wanted:
        finds["stack"] = stack.detected_in(*map(F.col, TELLING))
        inputs += TELLING
    if "js_refs" in wanted:
        none = F.array().cast("array<struct<method: string, raw: string, kind: string>>")
        inline = F.concat_ws("\n", F.regexp_extract_all("code", F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), 1))
        forms, called = F.when(F.col("markup"), extract.form_references(F.col("code"))), extract.raw_references(F.when(F.col("script"), F.col("code")).when(F.col("markup"), inline))
        finds["js_refs"] = extract.normal_references(F.concat(F.coalesce(forms, none), F.coalesce(called, none)))
        inputs += ["markup", "script", "code"]
    if "js_assets" in wanted:
        header_map = F.coalesce(http.header(F.col("sh"), "sourcemap"), http.header(F.col("sh"), "x-sourcemap"))
        rows = rows.withColumns({c: F.when(F.col("script"), of) for c, of in (("map_named", header_map), ("at_host", F.col("host")), ("at_path", F.col("template")))})
        finds["js_assets"] = extract.resolved_assets(F.when(F.col("script"), extract.script_assets(F.col("code"), F.col("map_named"))), F.col("at_host"), F.col("at_path"))
        inputs += ["script", "code", "map_named", "at_host", "at_path"]
    if wanted & {"resp", "resp.body"}:
        finds["masked_code"] = redact.mask_named(F.substring("code", 1, PANE))
        inputs += ["code"]
    if finds:
        rows = content.found_once(rows, list(dict.fromkeys(inputs)), finds)
    if wanted & {"referer_host", "referer_path"}:
        ref_host, ref_path = http.referer(F.col("rh"))
        rows = rows.withColumns({"referer_host": ref_host, "referer_path": ref_path})
    if "secrets" in wanted:
        hidden = F.concat(redact.found_values(F.coalesce("req_text", F.lit(""))), redact.found_values(F.coalesce("resp_text", F.lit(""))), redact.found_values(F.col("raw_path")))
        rows = rows.withColumn("hidden", hidden)
    if "path" in wanted:
        rows = rows.withColumn("asked", F.transform(redact.mask_params(F.col("query")), lambda p: F.concat_ws("=", p["name"], p["value"])))

    def pane(name: str, line: str, hs: str, text: str) -> Column:
        masked = lambda: redact.mask_named(F.substring(F.col(text), 1, PANE))
        parts = {
            "line": lambda: redact.mask_values(F.col(line)), "headers": lambda: redact.mask_headers(F.col(hs)), "body": lambda: F.when(F.col("code").isNotNull(), F.col("masked_code")).otherwise(masked()) if name == "resp" else masked(),
            "truncated": lambda: (F.length(text) > PANE) | F.col("truncated"),
        }
        return F.struct(*[(parts[f.name]() if wanted & {name, f"{name}.{f.name}"} else F.lit(None).cast(f.dataType)).alias(f.name) for f in EXCHANGE[name].dataType])

    made = {
        **{c: lambda c=c: F.col(c) for c in ("source", "item", "method", "scheme", "host", "port", "status", "mime", "referer_host", "referer_path")},
        "role": lambda: F.lit(role).cast("string"),
        "path": lambda: redact.mask_values(F.concat("templated", F.when(F.size("query") > 0, F.concat(F.lit("?"), F.concat_ws("&", "asked"))).otherwise(""))),
        "path_template": lambda: F.col("template"), "query_params": lambda: F.array_distinct(F.transform("query", lambda p: p["name"])),
        "body_params": lambda: F.array_distinct(F.transform(http.body_params(F.col("req_text"), F.col("sent_type")), lambda p: p["name"])),
        "set_cookies": lambda: F.col("cookies_set"), "credentials": lambda: http.credentials(F.col("rh"), F.col("query")),
        "tech": lambda: F.transform(F.filter("sh", lambda h: F.lower(h["name"]).isin("server", "x-powered-by")), lambda h: F.struct(F.lower(h["name"]).alias("header"), h["value"].alias("value"))),
        **{c: lambda c=c: F.col(c) for c in finds if c != "masked_code"},
        "scan_truncated": lambda: F.length("resp_text") > extract.MOST, "gql_ops": lambda: http.graphql_operations(F.col("template"), F.col("req_text")),
        "preflight": lambda: (F.col("method") == "OPTIONS") & http.header(F.col("rh"), "access-control-request-method").isNotNull(),
        "secrets": lambda: F.transform("hidden", lambda v: redact.fingerprint(v["value"], key, v["kind"])),
        "req": lambda: pane("req", "req_line", "rh", "req_text"), "resp": lambda: pane("resp", "resp_line", "sh", "resp_text"),
    }
    whole = {c.split(".")[0] for c in wanted}
    if "id" not in whole:
        return conform(rows.select(*[of().alias(c) for c, of in made.items() if c in whole]))
    # Decoded and masked once; the ids are worked out on a narrow table and meet the rows in one join.
    out = settle(rows.select(F.monotonically_increasing_id().alias("uid"), *[of().alias(c) for c, of in made.items() if c in whole | {"source", "item"}]), "masked")
    return conform(out.join(numbered(out.select("uid", "source", "item"), ["source", "item"]), "uid").drop("uid"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """(uid, id) of rows (uid, columns of ``order``): ids from 1 in that order, numbered in many tasks.

    Rows are dealt out by ranges and numbered within each; what comes before a range is the sum of the counts of those
    before it, a number for each partition.
    """
    dealt = settle(rows.repartitionByRange(*order, "uid").withColumn("part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order, "uid"))
    base = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, before long"))
    return dealt.withColumn("own", own).join(base, "part").select("uid", (F.col("before") + F.col("own")).alias("id"))


READERS = {"xml": proxy_xml, "csv": logger_csv, "har": har}
#: Bytes of a ``.json`` file that tell whether it is a HAR.
SNIFFED = 4096


def looks_like_har(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as a JSON object and soon names its log."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        head = bytes(stream.readNBytes(SNIFFED))
    finally:
        stream.close()
    return head.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"{") and b'"log"' in head


def kind_of(spark: SparkSession, path: str) -> str:
    """xml, csv, har or jsonl, by the extension of a capture's name; a ``.json`` must look like a HAR."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json" and looks_like_har(spark, path):
        return "har"
    if kind not in READERS and kind != "jsonl":
        raise ValueError(f"unknown capture: {path}")
    return kind


def read(spark: SparkSession, path: str, role: str | None = None, key: bytes = b"") -> DataFrame:
    """Exchanges of a capture, by the kind of the file."""
    kind = kind_of(spark, path)
    return saved(spark, path) if kind == "jsonl" else exchanges(READERS[kind](spark, path), role, key)


def counted(spark: SparkSession, path: str, role: str | None = None, key: bytes = b"", skip_tools: list[str] | None = None, only_tools: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(exchanges, counts) of a capture; counts has tool, items, parsed, skipped and filtered, a row for each tool of a logger (else ``?``).

    Items of unwanted tools are filtered and count as nothing else; the others are items, parsed or skipped.
    """
    kind = kind_of(spark, path)
    if kind == "csv":
        rows = logger_csv(spark, path, skip_tools, only_tools, marked=True)
    else:
        rows = READERS[kind](spark, path).withColumns({"tool": F.lit("?"), "filtered": F.lit(False)})
    wanted = ~F.col("filtered")
    good = F.coalesce(well_formed(), F.lit(False))
    counts = rows.groupBy("tool").agg(
        F.count_if(wanted).alias("items"), F.count_if(wanted & good).alias("parsed"), F.count_if(wanted & ~good).alias("skipped"), F.count_if("filtered").alias("filtered")
    )
    return exchanges(rows.filter(wanted).drop("tool", "filtered"), role, key), counts


def well_formed() -> Column:
    return F.lower(F.trim("host")).rlike(HOST) & F.upper(F.trim("method")).rlike(METHOD)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """Masked exchanges saved as JSON lines (one file or folder per role), numbered anew over all files."""
    rows = settle(spark.read.schema(EXCHANGE).json(path).withColumn("uid", F.monotonically_increasing_id()), "saved")
    ids = numbered(rows.select("uid", "role", "source", "item", F.col("id").alias("old")), ["role", "source", "item", "old"])
    return conform(rows.drop("id").join(ids, "uid").drop("uid"))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Exchanges from dictionaries in memory."""
    return conform(spark.createDataFrame(rows, EXCHANGE))
