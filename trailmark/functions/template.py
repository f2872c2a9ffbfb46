"""Path templates: value-like segments become placeholders, so that requests of one kind share one path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import redact
from trailmark.functions.text import digits, entropy, let

# Parameters by which a front controller chooses the page.
ROUTE_PARAMS = ["page", "action", "view", "module", "route", "section", "tab", "controller", "do", "cmd", "mode", "screen", "op", "task", "act", "content", "p"]
STATIC_PATH = r"(?i)\.(png|jpe?g|gif|svg|ico|webp|css|js|mjs|map|woff2?|ttf|eot|json|txt|xml|pdf)$"


#: Words in small letters, dots among them, that are too short for the shape of any secret or hash: never values.
WORD = r"^[a-z_.]{1,19}$"
#: What stands in a path that has other segments than such words, numbers and empty ones.
ODD = r"[^a-z_.0-9/]|[a-z_.][0-9]|[0-9][a-z_.]|[a-z_.]{20}"


def segment_kind(seg: Column) -> Column:
    """The placeholder of a path segment that is a value; null for one to keep.

    The first rule that fits decides: ids first, then shapes of secrets, then codes and random-looking tokens.
    """
    known = lambda x: let(F.struct(x.alias("seg"), F.coalesce(F.try_url_decode(x), x).alias("s")), lambda y: _kind(y["seg"], y["s"]))
    return let(seg, lambda x: F.when((x == "") | x.rlike(WORD), None).when(x.rlike(r"^[0-9]+$"), "{id}").otherwise(known(x)))


def _kind(seg: Column, s: Column) -> Column:
    kind = (
        F.when(seg.isNull() | (seg == "") | (seg.startswith("{") & seg.endswith("}")), None)
        .when(s.rlike(r"^\d+$"), "{id}")
        .when(s.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}")
        .when(s.rlike(r"^[0-9a-fA-F]{24,}$"), "{hash}")
        .when(s.rlike(r"^[0-9a-fA-F]{3,8}-[0-9a-fA-F]{8,}$") & s.rlike(r"\d"), "{id}")
    )
    for name, pattern in redact.VALUE_PATTERNS:
        hit = s.rlike(pattern)
        if name in redact.TELLTALES:
            hit = redact.may_hold(s, name) & hit
        if name == "card":
            hit = hit & redact.is_card(digits(F.regexp_extract(s, pattern, 0)))
        kind = kind.when(hit, "{" + name + "}")
    return (
        kind.when(s.rlike(r"^[A-Z0-9]{8,24}$") & s.rlike(r"\d") & s.rlike("[A-Z]"), "{code}")
        .when(s.rlike(r"^[A-Za-z0-9_\-+/=]{32,}$") & (entropy(s) >= 3.5), "{token}")
        .when(
            s.rlike(r"^[A-Za-z0-9_\-+=~]{12,}$") & s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike(r"\d.*\d") & (entropy(s) >= 3.0), "{token}"
        )
    )


def _matrix(seg: Column) -> Column:
    """``name;k=v`` with sensitive or value-like v as ``{value}``."""
    def one(p: Column) -> Column:
        k, v = F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=?", "")
        return F.when((v != "") & (redact.sensitive_param(k) | segment_kind(v).isNotNull()), F.concat(k, F.lit("={value}"))).otherwise(p)

    def whole(parts: Column) -> Column:
        return F.concat_ws(";", F.concat(F.array(F.coalesce(segment_kind(parts[0]), parts[0])), F.transform(F.slice(parts, 2, 10_000), one)))

    return let(F.split(seg, ";"), whole)


def _asset(seg: Column) -> Column:
    """A build hash in the name of a static file as ``{hash}``; null for other segments."""
    pattern = r"^(.+?[-._])([0-9a-fA-F]{8,32})(\.(?:js|mjs|css|map|woff2?|png|jpe?g|svg|webp))$"
    hashed = seg.rlike(pattern) & F.regexp_extract(seg, pattern, 2).rlike(r"\d") & ~seg.rlike(r"\.min\.(js|css)$")
    return F.when(hashed, F.concat(F.regexp_extract(seg, pattern, 1), F.lit("{hash}"), F.regexp_extract(seg, pattern, 3)))


def template_path(path: Column) -> Column:
    """The path without query and fragment, its values as placeholders; ``/`` if nothing is left."""
    def segment(s: Column) -> Column:
        return F.when((s == "") | s.rlike(WORD), s).when(s.contains(";"), _matrix(s)).otherwise(F.coalesce(segment_kind(s), _asset(s), s))

    def whole(bare: Column) -> Column:
        numbered = F.regexp_replace(bare, r"(?<![^/])[0-9]+(?![^/])", "{id}")
        return F.when(bare.rlike(ODD), F.concat_ws("/", F.transform(F.split(bare, "/"), segment))).otherwise(numbered)

    bare = F.regexp_replace(path, r"[?#][\s\S]*$", "")
    return let(let(bare, whole), lambda o: F.when(o == "", "/").otherwise(o))


def query_pairs(path: Column) -> Column:
    """Query parameters in order, blanks and repeats kept: array of struct(name, value)."""
    query = F.regexp_replace(F.regexp_replace(path, r"#[\s\S]*$", ""), r"^[^?]*\??", "")

    def text(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(text(F.substring_index(p, "=", 1)).alias("name"), text(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))


def route_template(path: Column, base: Column) -> Column:
    """``base`` with up to two page-choosing parameters in order of their names.

    Numbers (pages of a listing), values shaped like ids or secrets, and static files are left out.
    """
    return F.when(F.coalesce(path.contains("?"), F.lit(False)), _routed(path, base)).otherwise(base)


def _routed(path: Column, base: Column) -> Column:
    good = F.filter(
        query_pairs(path),
        lambda p: F.lower(p["name"]).isin(ROUTE_PARAMS)
        & p["value"].rlike(r"^[A-Za-z0-9_.\-/]{1,60}$")
        & ~p["value"].rlike(r"^\d+$")
        & segment_kind(p["value"]).isNull()
        & ~redact.sensitive_param(F.lower(p["name"])),
    )
    lowered = F.transform(good, lambda p: F.struct(F.lower(p["name"]).alias("name"), p["value"].alias("value")))
    names = F.slice(F.array_sort(F.array_distinct(F.transform(lowered, lambda p: p["name"]))), 1, 2)
    kept = F.transform(names, lambda n: F.concat(n, F.lit("="), F.filter(lowered, lambda p: p["name"] == n)[0]["value"]))
    return F.when(base.rlike(STATIC_PATH) | (F.size(kept) == 0), base).otherwise(F.concat(base, F.lit("?"), F.concat_ws("&", kept)))


def match_key(path: Column) -> Column:
    """Placeholders alike and no slash at the end: `/users/{id}` and `/users/{param}/` match."""
    key = F.regexp_replace(F.regexp_replace(path, r"\{[^/{}]*\}", "{}"), "/+$", "")
    return F.when(key == "", "/").otherwise(key)
