"""Hosts, public suffixes and scope."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A small public suffix list; callers pass their own for more.
SUFFIXES = ["com", "net", "org", "io", "dev", "test", "example", "uk", "co.uk", "org.uk", "ac.uk", "jp", "co.jp", "*.ck", "!www.ck", "au", "com.au", "de", "fr", "es", "in", "co.in", "github.io", "herokuapp.com"]


def ascii_name(host: str) -> str:
    """A host name with its international labels in their ASCII form (``xn--``); a label that has none stays."""
    def label(x: str) -> str:
        try:
            return x if x.isascii() else x.encode("idna").decode()
        except UnicodeError:
            return x

    return host if host.isascii() else ".".join(label(x) for x in host.split("."))


@F.pandas_udf(T.StringType())
def _ascii_names(hosts: pd.Series) -> pd.Series:
    known = {h: ascii_name(h) for h in hosts.dropna().unique()}
    return hosts.map(known)


def ascii_host(host: Column) -> Column:
    """``host`` in lower case, its international labels in their ASCII form, which scopes and suffix rules are compared in.

    Only names that are not ASCII are worth this call: it is the one function here that leaves the JVM.
    """
    low = F.lower(F.trim(host))
    return F.when(low.rlike(r"[^\x00-\x7F]"), _ascii_names(low)).otherwise(low)


def bare_host(host: Column) -> Column:
    """Lower case, without port or brackets; an IPv6 address keeps its colons."""
    h = F.lower(F.trim(host))
    return (
        F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)", 1)).when(F.length(h) - F.length(F.replace(h, F.lit(":"))) > 1, h).otherwise(F.substring_index(h, ":", 1))
    )


def suffixes_of(host: Column) -> Column:
    """All endings of a host at a dot, the longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def public_suffix(host: Column, rules: list[str] = SUFFIXES) -> Column:
    """The longest rule that fits: ``!`` exceptions first, ``*`` for any one label; the last label if none fits."""
    rules = [ascii_name(r.lower()) for r in rules]
    plain = [r for r in rules if r[0] not in "*!"]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    barred = [r[1:] for r in rules if r.startswith("!")]
    ends = suffixes_of(bare_host(host))
    excepted = F.filter(ends, lambda s: s.isin(barred))
    fits = F.filter(ends, lambda s: s.isin(plain) | F.regexp_replace(s, r"^[^.]+\.", "").isin(wild) & s.contains("."))
    return F.when(F.size(excepted) > 0, F.regexp_replace(excepted[0], r"^[^.]+\.", "")).when(F.size(fits) > 0, fits[0]).otherwise(F.element_at(ends, -1))


def registrable_domain(host: Column, rules: list[str] = SUFFIXES) -> Column:
    """One label more than the public suffix; the host itself for addresses and bare suffixes."""
    h, suffix = bare_host(host), public_suffix(host, rules)
    n = F.size(F.split(suffix, r"\.")) + 1
    return F.when(h.rlike(r"^[\d.]+$") | h.contains(":") | (h == suffix), h).otherwise(F.concat_ws(".", F.slice(F.split(h, r"\."), F.greatest(F.lit(1), F.size(F.split(h, r"\.")) - n + 1), n)))


def same_site(a: Column, b: Column, rules: list[str] = SUFFIXES) -> Column:
    return registrable_domain(a, rules) == registrable_domain(b, rules)


def clean_scope(scope: list[str]) -> list[str]:
    """Scope entries without scheme, path, port, wildcard and leading dot."""
    out = []
    for s in scope:
        s = s.strip().lower().split("://")[-1].split("/")[0]
        s = s[1:].split("]")[0] if s.startswith("[") else s if s.count(":") > 1 else s.split(":")[0]
        out.append(ascii_name(s.lstrip("*").lstrip(".")))
    return [s for s in out if s]


def in_scope(host: Column, scope: list[str]) -> Column:
    """The host is an entry of the scope or below one."""
    h, found = bare_host(host), F.lit(False)
    for s in clean_scope(scope):
        found = found | (h == s) | h.endswith("." + s)
    return F.coalesce(found, F.lit(False))
