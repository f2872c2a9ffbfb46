"""Text comparison without ASCII case, and entropy."""

from __future__ import annotations

import string

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nocase(c: Column) -> Column:
    """``c`` with A-Z lowered and nothing else changed, so 'É' and 'é' stay different."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty string, null for null."""
    def of(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars).cast("double"))
        return F.when(F.size(chars) == 0, 0.0).otherwise(-F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p)))

    return let(F.array_remove(F.split(c, ""), ""), lambda chars: F.when(chars.isNotNull(), of(chars)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once, however often ``f`` looks at it."""
    return F.transform(F.array(value), f)[0]
