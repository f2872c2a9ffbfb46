"""Bodies scanned once: what is found in a body depends on its content only, so equal bodies share one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators import extract
from trailmark.tables import Store, settle


def scanned_once(rows: DataFrame, body: str, scan: Callable[[DataFrame], DataFrame], store: str | None = None, batch_id: int = 0) -> DataFrame:
    """``rows`` with the columns that ``scan`` finds in their bodies; null where the body is.

    ``scan`` takes (content, body), a row for each distinct body, and gives content and what it found.  With ``store``,
    results are kept in that folder under the batch's number, and a body that any earlier batch had is not scanned again;
    a batch that comes again replaces its own results.
    """
    spark, names = rows.sparkSession, rows.columns
    marked = rows.withColumn("content", F.when(F.col(body).isNotNull(), F.concat(F.length(body).cast("string"), F.lit(":"), F.sha2(body, 256))))
    bodies = marked.filter("content IS NOT NULL").groupBy("content").agg(F.any_value(body).alias("body"))
    kept = Store(store) if store else None
    earlier = [r for r in kept.ranges(spark) if r[0] != batch_id] if kept else []
    known = kept.read(spark, earlier) if earlier else None
    fresh = scan(bodies if known is None else bodies.join(known.select("content"), "content", "left_anti"))
    if kept:
        kept.write(fresh, (batch_id, batch_id))
        fresh = kept.read(spark, [(batch_id, batch_id)])
    else:
        fresh = settle(fresh, "scans")
    found = fresh if known is None else fresh.unionByName(known)
    return marked.join(found, "content", "left").select(*names, *[c for c in found.columns if c != "content"])


def found_once(rows: DataFrame, inputs: list[str], finds: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``finds``, which are worked out from ``inputs`` alone: once for all rows that have the same."""
    kinds = dict(rows.select(*inputs).dtypes)
    shape = [F.col(c).isNull() for c in inputs] + [F.size(c) for c in inputs if kinds[c].startswith("array")]
    # Two hashes of 64 bits, over what is null and how long lists are too: hashes by themselves pass over nulls.
    keys = {f"__{i}": F.xxhash64(F.lit(i), *shape, *inputs) for i in (0, 1)}
    found = settle(rows.select(*inputs).distinct().select(*[k.alias(c) for c, k in keys.items()], *[f.alias(c) for c, f in finds.items()]), "found")
    return rows.withColumns(keys).join(found, [*keys], "left").drop(*keys)


def script_scan(bodies: DataFrame) -> DataFrame:
    """What scripts refer to, and the files that they name as they write them."""
    refs = extract.normal_references(extract.raw_references(F.col("body")))
    return bodies.select("content", refs.alias("refs"), extract.script_assets(F.col("body")).alias("assets"))
