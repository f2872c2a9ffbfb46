"""Nodes and edges as partial aggregates that merge: what one set of requests adds to a graph can be added to another's.

Sets, sums, minima and first values are kept with what orders them, so merging is associative and the merged whole equals
one aggregation over all contributions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETS = ["roles", "statuses", "credentials", "status_by_role"]
SUMS = ["n_evidence", "requests", "anonymous_requests"]
FIELDS = ["type", "layer", "label", "host", "path", "method", "location"]
COLUMNS = ["id", *FIELDS, "first_ev", "n_evidence", "roles", "statuses", "credentials", "requests", "anonymous_requests", "status_by_role", "httponly", "secure", "samesite"]


def _flag_rank() -> Column:
    return F.when(F.lower("samesite") == "strict", 2).when(F.lower("samesite") == "lax", 1).otherwise(0)


def node_partials(contributions: DataFrame) -> DataFrame:
    """One row per node of the contributions: its fields with their place (``at``), sets, sums, and the weakest flags of a cookie."""
    at = F.struct((F.coalesce("main", F.lit(True)).cast("int") * -1).alias("main"), "ev", "pos")
    weak = F.when(F.col("samesite").isNotNull(), F.struct(_flag_rank().alias("rank"), "ev", "pos", F.col("samesite").alias("value")))
    return contributions.groupBy("id").agg(
        F.min(at).alias("at"), F.min_by(F.struct(*FIELDS), at).alias("first"), F.min("ev").alias("first_ev"),
        F.count_if("once").alias("n_evidence"), F.count_if("main").alias("requests"), F.coalesce(F.sum("anonymous"), F.lit(0)).cast("long").alias("anonymous_requests"),
        F.collect_set("role").alias("roles"), F.collect_set("status").alias("statuses"), F.collect_set("cred").alias("credentials"),
        F.collect_set(F.when(F.col("role").isNotNull() & F.col("status").isNotNull(), F.struct("role", "status"))).alias("status_by_role"),
        F.bool_and("httponly").alias("httponly"), F.bool_and("secure").alias("secure"), F.min(weak).alias("samesite"), F.min(F.when(F.col("samesite").isNull(), F.struct(_flag_rank().alias("rank"), "ev", "pos"))).alias("unset"),
    )


def merged_nodes(partials: DataFrame) -> DataFrame:
    """Partials of several sets of requests as those of all of them; a node has as many rows as there are sets."""
    sets = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in SETS]
    sums = [F.sum(c).alias(c) for c in SUMS]
    return partials.groupBy("id").agg(
        F.min("at").alias("at"), F.min_by("first", "at").alias("first"), F.min("first_ev").alias("first_ev"), *sums, *sets,
        F.bool_and("httponly").alias("httponly"), F.bool_and("secure").alias("secure"), F.min("samesite").alias("samesite"), F.min("unset").alias("unset"),
    )


def finished_nodes(merged: DataFrame) -> DataFrame:
    """The nodes of merged partials."""
    # A contribution without the flag has the lowest rank; the first of the lowest rank decides.
    value = F.when(F.col("unset").isNull() | (F.struct("samesite.rank", "samesite.ev", "samesite.pos") < F.col("unset")), F.col("samesite.value"))
    sorted_sets = {c: F.array_sort(c) for c in SETS}
    return merged.withColumns({**sorted_sets, "samesite": value}).select("id", "first.*", *COLUMNS[1 + len(FIELDS) :])


def edge_partials(contributions: DataFrame) -> DataFrame:
    """One row per edge of the contributions."""
    return contributions.groupBy("src", "dst", "type").agg(F.min_by("state", "ev").alias("state"), F.min("ev").alias("first_ev"), F.count(F.lit(1)).alias("n_evidence"))


def merged_edges(partials: DataFrame) -> DataFrame:
    """Partials of several sets of requests as those of all; merged ones are the edges."""
    return partials.groupBy("src", "dst", "type").agg(F.min_by("state", "first_ev").alias("state"), F.min("first_ev").alias("first_ev"), F.sum("n_evidence").alias("n_evidence"))
