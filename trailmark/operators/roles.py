"""Inputs recorded under several roles, of which one is added or recorded anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_beside(role: str | None, fresh: bool = False) -> Column:
    """Which saved exchanges stay beside a new input of ``role``.

    An input without a role, or a fresh one, starts over: nothing stays.  Otherwise the input replaces that of its own
    role and the one without a role; those of other roles stay.
    """
    if role is None or fresh:
        return F.lit(False)
    return F.coalesce(F.col("role") != role, F.lit(False))


def merged(saved: DataFrame, new: DataFrame, role: str | None, fresh: bool = False) -> DataFrame:
    """Saved exchanges and those of a new input, which all get its role.

    Ids are those of the inputs; ``sources.captures.numbered`` numbers them anew.  Empty inputs are allowed: one of a
    role takes that role's exchanges away.
    """
    named = new.withColumn("role", F.lit(role).cast("string"))
    return saved.filter(kept_beside(role, fresh)).unionByName(named, allowMissingColumns=True)
