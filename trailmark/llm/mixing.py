"""Mixing of sources to target weights: raking, then sampling.

Tokens are counted by cell (source, language, topic).  Iterative proportional fitting scales the cells until their
margins meet the target of each axis; a document then enters the mixture with the probability that brings its cell to
its share of the token budget.  Probabilities above one are cut to one and their rest goes to the other cells
(bisection on the scale), so the expected number of tokens is the budget.

Without given targets every value of an axis, null too, has a target of its own, in proportion to a power of its tokens.
A given target is a share for named values; all other values of that axis form one more group, ``None``, with the share
that is left.  Up to ``MOST_CELLS`` cells are raked by arrays on the driver and sent to the tasks; with more, margins are
grouped sums that are joined to a table of cells, written in each round, with the same result.

Defined results: with given targets nulls of an axis belong to the group of other values; a text that is null or has no
word has no tokens and is never drawn; repeated rows get equal probabilities and equal draws; an empty table gives an
empty result; extra columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
Targets = dict[str, dict[str | None, float]]

#: Most cells that go through the driver.
MOST_CELLS = 50_000
#: Tokens of a value count by this power when no targets are given.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.85}
#: Parts of a cell's documents, where cells are joined by a shuffle.
SALTS = 32
ROUNDS = 200
CLOSE = 1e-9


def tokens(text: Column) -> Column:
    """Words of a text, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of writing, from the form of the text: listing, notes, article or treatise."""
    n = F.length(F.coalesce(text, F.lit("")))
    bars = F.length(text) - F.length(F.translate(text, "|#$%&*<>", ""))
    return F.when(bars * 20 > n, "listing").when(n < 600, "notes").when(n < 3000, "article").otherwise("treatise")


def rake(cells: dict[tuple, float], shares: list[dict], rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple, float]:
    """Iterative proportional fitting of ``cells`` to the shares of each axis.

    A value that no cell has gives its share to the others in proportion.  The weights sum to one.
    """
    keys = [k for k, v in cells.items() if v > 0]
    if not keys:
        return dict.fromkeys(cells, 0.0)
    w = np.array([cells[k] for k in keys], float)
    w /= w.sum()
    codes, goals = [], []
    for a, share in enumerate(shares):
        values = {v: i for i, v in enumerate(dict.fromkeys(k[a] for k in keys))}
        codes.append(np.array([values[k[a]] for k in keys]))
        goal = np.array([share.get(v, 0.0) for v in values])
        goals.append(goal / goal.sum() if goal.sum() > 0 else np.full(len(values), 1 / len(values)))
    for _ in range(rounds):
        far = 0.0
        for code, goal in zip(codes, goals, strict=True):
            margin = np.bincount(code, w, len(goal))
            far = max(far, float(np.abs(goal - margin).max()))
            w = w * np.divide(goal, margin, out=np.zeros_like(goal), where=margin > 0)[code]
        if far < close:
            break
    return dict.fromkeys(cells, 0.0) | dict(zip(keys, w.tolist(), strict=True))


def rake_table(cells: DataFrame, axes: list[str], goals: list[DataFrame], scratch: Scratch, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``rake`` of a table with ``n`` > 0 and non-null axes; ``goals``: axis, share of each.  Adds ``w``."""
    total = cells.agg(F.sum("n")).first()[0]
    met = []
    for a, goal in zip(axes, goals, strict=True):
        here = scratch.save(cells.select(a).distinct().join(goal, a, "left").select(a, F.coalesce("share", F.lit(0.0)).alias("share")), "goal")
        whole, size = here.agg(F.sum("share"), F.count(F.lit(1))).first()
        met.append(here.select(a, (F.col("share") / F.lit(whole) if whole > 0 else F.lit(1.0 / size)).alias("goal")))
    w = cells.withColumns({"w": F.col("n") / F.lit(float(total)), "far": F.lit(0.0)})
    for _ in range(rounds):
        before, w = w, w.withColumn("far", F.lit(0.0))
        for a, goal in zip(axes, met, strict=True):
            margin = w.groupBy(a).agg(F.sum("w").alias("m")).join(goal, a)
            ratio = margin.select(a, F.when(F.col("m") > 0, F.col("goal") / F.col("m")).otherwise(0.0).alias("ratio"), F.abs(F.col("goal") - F.col("m")).alias("off"))
            joined = w.join(ratio, a)
            w = scratch.save(joined.withColumns({"w": F.col("w") * F.col("ratio"), "far": F.greatest("far", "off")}).drop("ratio", "off"), "round")
        if w.agg(F.max("far")).first()[0] < close:
            break
    return w.drop("far")


def capped(total, budget: float) -> float:
    """The scale s for which the sum of n * min(1, s * weight / n) is the budget; infinite when all there is is less.

    ``total(s)``: tokens of the cells with s * weight >= n, weight of the others.  Each round caps more cells, never fewer.
    """
    full, rest = total(0.0)
    scale, most = 0.0, full
    while rest > 0:
        new = (budget - full) / rest
        if new <= scale:
            break
        scale = new
        full, rest = total(scale)
        if full == most:
            break
        most = full
    return scale if rest > 0 else math.inf


def calibrate(cells: dict[tuple, float], weights: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """For each cell the probability of a document, such that the expected tokens are the budget, or all there are."""
    keys = [k for k, n in cells.items() if n > 0 and weights[k] > 0]
    n, w = np.array([cells[k] for k in keys]), np.array([weights[k] for k in keys])
    scale = capped(lambda s: (float(n[s * w >= n].sum()), float(w[s * w < n].sum())), budget)
    chance = np.minimum(1.0, scale * w / n) if keys else w
    return dict.fromkeys(cells, 0.0) | dict(zip(keys, chance.tolist(), strict=True))


def tempered(cells: dict[tuple, float], axis: int, power: float) -> dict[str | None, float]:
    """Shares in proportion to tokens ** power, for every value of an axis."""
    by: dict[str | None, float] = {}
    for k, n in cells.items():
        by[k[axis]] = by.get(k[axis], 0.0) + n
    total = math.fsum(n**power for n in by.values())
    return {v: n**power / total for v, n in by.items()} if total > 0 else {}


def uniform(id_: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def mix(df: DataFrame, targets: Targets | None = None, budget: float = 0.7, id_col: str = "doc_id", text_col: str = "text", axes: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of its columns), ``cell``, n_tokens, probability, weight (share of its cell) and drawn.

    budget is a share of all tokens.  Without targets, shares of an axis go by the powers in ``POWERS``.
    ``cell`` has the values of the axes, other ones than a given target names as null.
    """
    axes = axes or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text_col))}
    scratch, spark = scratch or Scratch(df.sparkSession, "mixing"), df.sparkSession
    named = {a: f"__axis_{i}" for i, a in enumerate(axes)}
    given = {a: t for a, t in (targets or {}).items() if t}

    def group(a: str, value: Column) -> Column:
        """A value of the axis, never null: values start with an equals sign."""
        value = F.concat(F.lit("="), value.cast("string"))
        known = [f"={v}" for v in given.get(a, {}) if v is not None]
        value = F.when(value.isin(known), value) if a in given else value
        return F.coalesce(value, F.lit(""))

    def key(v: str | None) -> str:
        return "" if v is None else f"={v}"

    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("__id"),
        tokens(F.col(f"`{text_col}`")).alias("n_tokens"),
        *[group(a, c).alias(named[a]) for a, c in axes.items()],
    )
    counts = rows.groupBy(*named.values()).agg(F.sum("n_tokens").alias("n")).filter("n > 0")
    counts = scratch.save(counts, "cells")
    size, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= MOST_CELLS:
        cells = {tuple(r[c] for c in named.values()): float(r["n"]) for r in counts.collect()}
        shares = [{key(v): x for v, x in given[a].items()} if a in given else tempered(cells, i, POWERS.get(a, 1.0)) for i, a in enumerate(axes)]
        weights = rake(cells, shares)
        chance = calibrate(cells, weights, budget * total)
        schema = ", ".join([f"{c} string" for c in named.values()] + ["probability double", "weight double"])
        table = spark.createDataFrame([(*k, chance[k], weights[k]) for k in cells], schema)
        out = rows.join(F.broadcast(table), list(named.values()), "left")  # at most MOST_CELLS rows
    else:
        goals = []
        for a, c in named.items():
            if a in given:
                goals.append(spark.createDataFrame([(key(v), float(x)) for v, x in given[a].items()], f"{c} string, share double"))
            else:
                goals.append(counts.groupBy(c).agg(F.pow(F.sum("n").cast("double"), F.lit(POWERS.get(a, 1.0))).alias("share")))
        raked = rake_table(counts, list(named.values()), goals, scratch)

        def sums(s: float) -> tuple[float, float]:
            over = F.lit(s) * F.col("w") >= F.col("n")
            r = raked.filter("w > 0").agg(F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
            return float(r[0] or 0), float(r[1] or 0)

        p = F.least(F.lit(1.0), F.lit(capped(sums, budget * total)) * F.col("w") / F.col("n"))
        table = raked.select(*named.values(), F.when(F.col("w") > 0, p).otherwise(0.0).alias("probability"), F.col("w").alias("weight"))
        # A cell may hold a large part of all documents, never more than one row of the table.
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "n_tokens"), F.lit(SALTS)).cast("int"))
        out = salted.join(table, [*named.values(), "__salt"], "left")
    p = F.coalesce("probability", F.lit(0.0))
    cell = F.struct(*[F.when(F.col(c) != "", F.expr(f"substring({c}, 2)")).alias(a) for a, c in named.items()])
    return out.select(
        "row", cell.alias("cell"), "n_tokens", p.alias("probability"), F.coalesce("weight", F.lit(0.0)).alias("weight"), ((F.col("n_tokens") > 0) & (uniform(F.col("__id")) < p)).alias("drawn")
    )
