"""Filters over requests, nodes and edges, built from Python: ``term("req.method", "eq", "POST") & ~text("admin")``.

A filter is a tree of terms that is compiled to one Column for its table, so Catalyst sees plain predicates.  Text is
compared without the case of A-Z; values are literals, never part of SQL text.  ``ne`` and ``ncont`` of text hold for
null, comparisons of numbers never do, and NOT keeps SQL's three-valued logic.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import nocase

DEFAULT_LIMIT, MOST = 100, 5000
TEXT_OPS = ("eq", "ne", "cont", "ncont", "like", "regex")
NUMBER_OPS = ("eq", "ne", "gt", "gte", "lt", "lte")


class FilterError(ValueError):
    """A filter that has no meaning."""


def _headers(pane: str) -> Column:
    return F.concat_ws("\n", F.transform(F.col(f"{pane}.headers"), lambda h: F.concat(h["name"], F.lit(": "), h["value"])))


#: name -> (column, is a number)
REQUEST_FIELDS: dict[str, tuple[Callable[[], Column], bool]] = {
    "req.method": (lambda: F.col("method"), False),
    "req.host": (lambda: F.col("host"), False),
    "req.path": (lambda: F.col("path"), False),
    "req.template": (lambda: F.col("path_template"), False),
    "req.line": (lambda: F.col("req.line"), False),
    "req.headers": (lambda: _headers("req"), False),
    "req.body": (lambda: F.col("req.body"), False),
    "resp.code": (lambda: F.col("status"), True),
    "resp.mime": (lambda: F.col("mime"), False),
    "resp.headers": (lambda: _headers("resp"), False),
    "resp.body": (lambda: F.col("resp.body"), False),
    "role": (lambda: F.col("role"), False),
    "source": (lambda: F.col("source"), False),
    "id": (lambda: F.col("id"), True),
}
NODE_FIELDS: dict[str, tuple[Callable[[], Column], bool]] = {
    "node.id": (lambda: F.col("id"), False),
    "node.type": (lambda: F.col("type"), False),
    "node.label": (lambda: F.col("label"), False),
    "node.layer": (lambda: F.col("layer"), True),
    "node.host": (lambda: F.col("host"), False),
    "node.path": (lambda: F.col("path"), False),
    "node.method": (lambda: F.col("method"), False),
    "node.state": (lambda: F.col("api_state"), False),
    "node.requests": (lambda: F.col("requests"), True),
    "node.first_build": (lambda: F.col("first_build"), True),
    "node.last_build": (lambda: F.col("last_build"), True),
}
EDGE_FIELDS: dict[str, tuple[Callable[[], Column], bool]] = {
    "edge.type": (lambda: F.col("type"), False),
    "edge.state": (lambda: F.col("state"), False),
    "edge.src": (lambda: F.col("src"), False),
    "edge.dst": (lambda: F.col("dst"), False),
    "edge.src_type": (lambda: F.col("src_type"), False),
    "edge.dst_type": (lambda: F.col("dst_type"), False),
    "edge.src_label": (lambda: F.col("src_label"), False),
    "edge.dst_label": (lambda: F.col("dst_label"), False),
}
FIELDS = {"requests": REQUEST_FIELDS, "nodes": NODE_FIELDS, "edges": EDGE_FIELDS}
FREE_TEXT = {
    "requests": ["req.method", "req.host", "req.path", "resp.mime", "req.body", "resp.body"],
    "nodes": ["node.id", "node.label"],
    "edges": ["edge.type", "edge.src_label", "edge.dst_label"],
}
ORDER = {"requests": ["id"], "nodes": ["layer", "type", "label", "id"], "edges": ["src", "type", "dst"]}


@dataclass(frozen=True)
class Filter:
    """A node of the tree: term, text, and, or, not."""

    kind: str
    parts: tuple

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", (self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", (self, other))

    def __invert__(self) -> Filter:
        return Filter("not", (self,))

    def names(self) -> set[str]:
        if self.kind == "term":
            return {self.parts[0]}
        return set() if self.kind == "text" else set().union(*[p.names() for p in self.parts])


def term(field: str, op: str, value: object) -> Filter:
    return Filter("term", (field, op, value))


def text(value: str) -> Filter:
    """The value in any of the table's main columns."""
    return Filter("text", (value,))


def target(f: Filter) -> str:
    """The table that has all fields of the filter; requests if it has none."""
    names = f.names()
    fits = [t for t, fields in FIELDS.items() if all(n in fields or (t == "nodes" and n in ("node.role", "node.evidence")) for n in names)]
    if not fits:
        raise FilterError(f"no table has all of: {', '.join(sorted(names))}")
    return fits[0]


def number_term(c: Column, op: str, value: object) -> Column:
    if op not in NUMBER_OPS or not re.fullmatch(r"-?\d+", str(value).strip()):
        raise FilterError(f"numbers take {', '.join(NUMBER_OPS)} and a whole number, not {op} {value!r}")
    n = F.lit(int(str(value)))
    return {"eq": c == n, "ne": c != n, "gt": c > n, "gte": c >= n, "lt": c < n, "lte": c <= n}[op]


def text_term(c: Column, op: str, value: object) -> Column:
    if op not in TEXT_OPS:
        raise FilterError(f"text takes {', '.join(TEXT_OPS)}, not {op}")
    v = str(value)
    low, other = nocase(c), nocase(F.lit(v))
    if op == "eq":
        return low == other
    if op == "ne":
        return c.isNull() | (low != other)
    if op == "cont":
        return F.contains(low, other)
    if op == "ncont":
        return c.isNull() | ~F.contains(low, other)
    if op == "like":  # * is the only wildcard
        return low.rlike("(?s)^" + ".*".join(re.escape(p) for p in _lower(v).split("*")) + "$")
    try:
        re.compile(v)
    except re.error as e:
        raise FilterError(f"bad regex: {v!r}") from e
    return F.coalesce(c.rlike("(?i)" + v), F.lit(False))


def _lower(v: str) -> str:
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in v)


def _element(name: str, op: str, value: object) -> Column:
    """Terms on the arrays of a node."""
    if name == "node.role":
        hit = F.exists("roles", lambda r: nocase(r) == nocase(F.lit(str(value))))
        if op in ("eq", "ne"):
            return hit if op == "eq" else ~hit
        return text_term(F.to_json("roles"), op, value)
    m = re.fullmatch(r"(?:ev_|evd\s*)?(\d+)", str(value).strip(), re.I)
    if not m or op not in ("eq", "ne"):
        raise FilterError("node.evidence takes eq or ne and an evidence number")
    hit = F.array_contains("evidence", int(m[1]))
    return hit if op == "eq" else ~hit


def compiled(f: Filter, table: str | None = None) -> Column:
    table = table or target(f)
    fields = FIELDS[table]
    if f.kind == "term":
        name, op, value = f.parts
        if table == "nodes" and name in ("node.role", "node.evidence"):
            return _element(name, op, value)
        if name not in fields:
            raise FilterError(f"{table} has no {name}")
        make, number = fields[name]
        return (number_term if number else text_term)(make(), op, value)
    if f.kind == "text":
        if not f.parts[0]:
            raise FilterError("empty text")
        out = F.lit(False)
        for name in FREE_TEXT[table]:
            out = out | text_term(fields[name][0](), "cont", f.parts[0])
        return out
    if f.kind == "not":
        return ~compiled(f.parts[0], table)
    a, b = (compiled(p, table) for p in f.parts)
    return a & b if f.kind == "and" else a | b


def clamp(limit: int | None) -> int:
    return max(1, min(MOST, DEFAULT_LIMIT if limit is None else limit))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with type and label of both ends."""
    for end in ("src", "dst"):
        named = nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), F.col("label").alias(f"{end}_label"))
        edges = edges.join(named, end, "left")
    return edges


def run_filter(df: DataFrame, f: Filter, table: str | None = None) -> DataFrame:
    """All rows that match."""
    return df.filter(compiled(f, table or target(f)))


def top(df: DataFrame, f: Filter, limit: int | None = None) -> DataFrame:
    """The first rows that match, in the table's order; at most ``limit``, which is kept between 1 and 5000."""
    table = target(f)
    return run_filter(df, f, table).orderBy(*ORDER[table]).limit(clamp(limit))


def read_only_sql(spark, query: str) -> DataFrame:
    """``spark.sql`` for a single query over registered tables; commands are refused before they run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise FilterError(f"not a query: {str(e).splitlines()[0]}") from e
    names = [plan.getClass().getName()]
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        names.append(node.getClass().getName())
        children = node.children()
        waiting.extend(children.apply(i) for i in range(children.size()))
    if any(re.search(r"Command|\.(Insert|Create|Drop|Alter|Delete|Update|Merge|Set|Truncate|Replace|Append|Overwrite)\w*(Statement|Table|View|Into)", n) for n in names):
        raise FilterError("only queries are run")
    return spark.sql(query)
