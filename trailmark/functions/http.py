"""HTTP messages: decoding, headers, bodies, cookies and credentials."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.template import query_pairs, route_template, segment_kind, template_path
from trailmark.functions.text import let

INFLATED = 50 * 1024 * 1024
# How far a JSON body is looked into for parameters.
DEEPEST, LISTED, LONGEST_KEY = 12, 5, 200
# Header and cookie names that carry credentials.
CREDENTIAL_HEADERS = ["x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token", "api-key"]
SESSION_COOKIE = r"(?i)(sess|sid|auth|token|jwt|csrf|remember)"


def base64_or_raw(c: Column) -> Column:
    """Bytes of base64 text, white space and missing padding allowed; text that is no base64 as it stands."""
    packed = F.regexp_replace(c, r"\s+", "")
    padded = F.concat(packed, F.repeat(F.lit("="), F.pmod(-F.length(packed), F.lit(4))))
    return F.coalesce(F.try_to_binary(padded, F.lit("base64")), F.encode(c, "UTF-8"))


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return body
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(body: bytes, coding: str) -> bytes | None:
    """The first ``INFLATED`` bytes of what a coding packed, in all its members; None if it is not known or damaged."""
    try:
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):
                try:
                    return _members(body, bits)
                except zlib.error:
                    continue
        if coding == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as stream:
                return stream.read(INFLATED)
    except Exception:
        return None
    return None


def _members(body: bytes, bits: int) -> bytes:
    out, size = [], 0
    while True:
        member = zlib.decompressobj(bits)
        out.append(member.decompress(body, INFLATED - size))
        size += len(out[-1])
        body = member.unused_data
        if not member.eof or bits < 0 or size >= INFLATED or not body.startswith(b"\x1f\x8b"):
            return b"".join(out)


@F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("handled", T.BooleanType())]))
def decoded_body(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(body, transfer-encoding, content-encoding) -> the plain body, and whether its coding is known; at most 50 MB."""
    for bodies, transfers, codings in batches:
        out, handled = [], []
        for body, transfer, coding in zip(bodies, transfers, codings, strict=True):
            raw = bytes(body) if body is not None else b""
            if transfer and "chunked" in transfer.lower():
                raw = _dechunked(raw)
            names = [x.strip() for x in (coding or "").lower().split(",") if x.strip() and x.strip() != "identity"]
            known = True
            for name in reversed(names):
                plain = _inflated(raw, name)
                known = known and plain is not None
                raw = raw if plain is None else plain
            out.append(raw)
            handled.append(known)
        yield pd.DataFrame({"body": out, "handled": handled})


def head_text(message: Column) -> Column:
    """Everything before the first empty line, as ISO-8859-1 text."""
    return F.split(F.decode(message, "ISO-8859-1"), r"\r?\n\r?\n", 2)[0]


def body_bytes(message: Column) -> Column:
    """Everything after the first empty line."""
    text = F.decode(message, "ISO-8859-1")
    return F.encode(F.coalesce(F.get(F.split(text, r"\r?\n\r?\n", 2), F.lit(1)), F.lit("")), "ISO-8859-1")


def parted(message: Column) -> Column:
    """array<string> of what is before the first empty line and what is after it, as ISO-8859-1 text."""
    return F.split(F.decode(message, "ISO-8859-1"), r"\r?\n\r?\n", 2)


def body_text(parts: Column, transfer: Column, content: Column) -> Column:
    """The plain body, as text, of a message in its parts, with these codings; only bodies that are coded leave the JVM."""
    body = F.encode(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "ISO-8859-1")
    coded = F.coalesce(transfer, content).isNotNull()
    return F.decode(F.when(coded, decoded_body(F.when(coded, body), transfer, content)["body"]).otherwise(body), "UTF-8")


def first_line(head: Column) -> Column:
    return F.split(head, r"\r?\n")[0]


def headers(head: Column) -> Column:
    """array<struct<name, value>> of all lines after the first that have a colon."""
    lines = F.filter(F.slice(F.split(head, r"\r?\n"), 2, 10_000), lambda x: F.contains(x, F.lit(":")))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))


def header(hs: Column, name: str) -> Column:
    """The value of the first header of that name, whatever its case; null without one."""
    return F.get(F.filter(hs, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def json_leaves(body: Column) -> Column:
    """array<struct<name, value>> of the values in a JSON text that are no objects or lists, by their paths from ``$``.

    Values lie at most ``DEEPEST`` steps down; of a list the first ``LISTED`` items count.  A key that is itself a value (an
    address, a token) becomes its placeholder, so none stands in a name.  Null for what is no JSON, and for an object
    with the same key twice.
    """
    node = "array<struct<name: string, value: variant, leaf: boolean>>"

    def entry(name: Column, value: Column) -> Column:
        nested = F.expr("null").cast("boolean")  # decided when its turn comes
        return F.struct(name.alias("name"), value.alias("value"), nested.alias("leaf"))

    def key(k: Column) -> Column:
        short = F.substring(k, 1, LONGEST_KEY)
        return F.coalesce(segment_kind(short), short)

    def opened(x: Column) -> Column:
        parts = F.struct(F.try_variant_get(x["value"], "$", "map<string, variant>").alias("fields"), F.try_variant_get(x["value"], "$", "array<variant>").alias("items"))
        itself = F.array(F.struct(x["name"].alias("name"), x["value"].alias("value"), F.lit(True).alias("leaf")))
        return F.when(x["leaf"], itself).otherwise(let(parts, lambda p: under_or_itself(x, itself, p["fields"], p["items"])))

    def under_or_itself(x: Column, itself: Column, fields: Column, items: Column) -> Column:
        under = F.transform(F.map_entries(fields), lambda e: entry(F.concat(x["name"], F.lit("."), key(e["key"])), e["value"]))
        listed = F.transform(F.slice(items, 1, LISTED), lambda v, i: entry(F.concat(x["name"], F.lit("["), i.cast("string"), F.lit("]")), v))
        return F.when(fields.isNull() & items.isNull(), itself).otherwise(F.coalesce(under, listed))

    return let(F.try_parse_json(body), lambda parsed: _leaves(parsed, entry, opened, node))


def _leaves(parsed: Column, entry, opened, node: str) -> Column:
    """Leaves are set aside once found, so that a step works on what is still open only."""
    state = f"struct<done: {node}, open: {node}>"
    root = F.struct(F.array().cast(node).alias("done"), F.array(entry(F.lit("$"), parsed)).alias("open")).cast(state)

    def step(found: Column, _: Column) -> Column:
        grown = let(
            F.flatten(F.transform(found["open"], opened)).cast(node),
            lambda x: F.struct(F.concat(found["done"], F.filter(x, lambda v: v["leaf"].isNotNull())).alias("done"), F.filter(x, lambda v: v["leaf"].isNull()).alias("open")),
        )
        return F.when(F.size(found["open"]) == 0, found).otherwise(grown.cast(state))

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), root, step, lambda found: found["done"])
    leaves = F.transform(walked, lambda x: F.struct(x["name"].alias("name"), x["value"].cast("string").alias("value")))
    return F.when(parsed.isNotNull(), leaves)


def body_params(body: Column, content_type: Column) -> Column:
    """array<struct<name, value>> of a form, or of the values in a JSON text (``json_leaves``)."""
    form = query_pairs(F.concat(F.lit("?"), body))
    none = F.array().cast("array<struct<name: string, value: string>>")
    low = F.coalesce(F.lower(content_type), F.lit(""))
    return F.coalesce(F.when(low.contains("x-www-form-urlencoded"), form).when(low.contains("json"), json_leaves(body)), none)


def graphql_operations(template: Column, body: Column) -> Column:
    """Names of GraphQL operations: operationName, else the name in the query, else its kind."""
    query = F.get_json_object(body, "$.query")
    named = F.nullif(F.regexp_extract(query, r"^\s*(?:query|mutation|subscription)\s+(\w+)", 1), F.lit(""))
    kind = F.nullif(F.regexp_extract(query, r"^\s*(query|mutation|subscription)\b", 1), F.lit(""))
    op = F.coalesce(F.get_json_object(body, "$.operationName"), named, kind)
    return F.when(F.lower(template).contains("graphql") & op.isNotNull(), F.array(op)).otherwise(F.array().cast("array<string>"))


def cookie_names(hs: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(header(hs, "cookie"), F.lit("")), ";"), lambda p: F.trim(F.substring_index(p, "=", 1))), lambda n: n != "")


def set_cookies(hs: Column) -> Column:
    """array<struct<name, httponly, secure, samesite>> of all Set-Cookie headers."""
    values = F.transform(F.filter(hs, lambda h: F.lower(h["name"]) == "set-cookie"), lambda h: h["value"])
    return F.transform(
        values,
        lambda v: F.struct(
            F.trim(F.substring_index(F.substring_index(v, ";", 1), "=", 1)).alias("name"), v.rlike(r"(?i);\s*httponly").alias("httponly"), v.rlike(r"(?i);\s*secure").alias("secure"),
            F.nullif(F.regexp_extract(v, r"(?i);\s*samesite\s*=\s*(\w+)", 1), F.lit("")).alias("samesite"),
        ),
    )


def credentials(hs: Column, query: Column) -> Column:
    """Kinds of credentials a request carries, sorted: auth scheme, header:*, cookie:*, query:*."""
    scheme = F.transform(F.filter(hs, lambda h: F.lower(h["name"]) == "authorization"), lambda h: F.lower(F.substring_index(F.trim(h["value"]), " ", 1)))
    named = F.transform(F.filter(hs, lambda h: F.lower(h["name"]).isin(CREDENTIAL_HEADERS)), lambda h: F.concat(F.lit("header:"), F.lower(h["name"])))
    cookies = F.transform(F.filter(cookie_names(hs), lambda n: n.rlike(SESSION_COOKIE)), lambda n: F.concat(F.lit("cookie:"), n))
    asked = F.transform(F.filter(query, lambda p: F.lower(p["name"]).rlike("^(access_token|api_?key|token|auth)$")), lambda p: F.concat(F.lit("query:"), F.lower(p["name"])))
    return F.array_sort(F.array_distinct(F.concat(scheme, named, cookies, asked)))


def referer(hs: Column) -> tuple[Column, Column]:
    """(host, templated path) of the Referer header; nulls without one."""
    value = header(hs, "referer")
    host = F.nullif(F.lower(F.regexp_extract(value, r"(?i)^https?://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    path = F.regexp_replace(value, r"(?i)^https?://[^/?#]*", "")
    path = F.when(path == "", "/").otherwise(path)
    return host, F.when(host.isNotNull(), let(path, lambda p: let(template_path(p), lambda t: route_template(p, t))))
