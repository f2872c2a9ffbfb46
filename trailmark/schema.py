"""Schemas and closed vocabularies of captures and their graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def _struct(**fields: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()])


def _list(kind: T.DataType | str) -> T.ArrayType:
    return T.ArrayType(_TYPES[kind] if isinstance(kind, str) else kind)


_PANE = _struct(line="string", headers=_list(_struct(name="string", value="string")), body="string", truncated="boolean")

#: One recorded request and response, masked.
EXCHANGE = _struct(
    id="bigint", source="string", item="bigint", role="string", method="string", scheme="string", host="string", port="int", path="string", path_template="string",
    status="int", mime="string", query_params=_list("string"), body_params=_list("string"), referer_host="string", referer_path="string",
    set_cookies=_list(_struct(name="string", httponly="boolean", secure="boolean", samesite="string")), credentials=_list("string"),
    tech=_list(_struct(header="string", value="string")), js_refs=_list(_struct(method="string", host="string", path="string", kind="string")),
    js_assets=_list(_struct(kind="string", host="string", path="string")), stack=_list(_struct(name="string", category="string", how="string", version="string")),
    scan_truncated="boolean", gql_ops=_list("string"), preflight="boolean", secrets=_list(_struct(kind="string", hmac_12="string", length="int", entropy="double")),
    req=_PANE, resp=_PANE,
)

# Node types and their layers.
LAYERS = {"host": 1, "tech": 1, "route": 2, "script": 3, "endpoint": 4, "parameter": 4, "operation": 4, "third_party": 5, "role": 5, "auth": 5, "cookie": 5}
STATES = ["OBSERVED", "INFERRED", "EXTERNAL"]
API_STATES = ["BOTH", "STATIC_ONLY", "RUNTIME_ONLY"]


def conform(df: DataFrame) -> DataFrame:
    """``df`` with all columns of an exchange; those that it lacks are null (arrays: empty)."""
    have = set(df.columns)

    def column(f: T.StructField):
        if f.name in have:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        empty = F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(None)
        return empty.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in EXCHANGE.fields])
