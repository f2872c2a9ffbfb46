"""Folding of sibling path segments that are values in words: `/live/aaj-tak`, `/live/dangal`, ... become `/live/{slug}`.

Depth by depth, under each host and prefix: eight or more siblings with a common stem before their last dash become
``stem{slug}``; of the others, twelve or more that have the same children, at least four fifths of those that have any,
become ``{slug}``.  Names of files and segments that are placeholders already stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.classify import is_probe
from trailmark.tables import settle

STEM, SHAPE, SHARE, STEM_LENGTH = 8, 12, 0.8, 6
FILE = r"\.[A-Za-z0-9]{1,6}$"


def _counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with how many have the same ``keys``: counts are combined in the tasks that read, however many siblings there are."""
    return rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")


def _fold_level(paths: DataFrame, d: int) -> DataFrame:
    """(host, base, segs) with segment d (from 0) folded."""
    at = paths.filter(F.size("segs") > d).select("host", F.slice("segs", 1, d).alias("prefix") if d else F.array().cast("array<string>").alias("prefix"), F.col("segs")[d].alias("seg"), F.when(F.size("segs") > d + 1, F.col("segs")[d + 1]).alias("child"))
    kept = at.filter(~F.col("seg").contains("{") & ~F.col("seg").rlike(FILE)).withColumn("stem", F.when(F.col("seg").contains("-"), F.regexp_replace("seg", "[^-]*$", "")))
    # A segment's children are told apart by their number and the sum of their hashes: nothing gathers a set of them.
    each = kept.select("host", "prefix", "seg", "stem", "child").distinct()
    plain = settle(each.groupBy("host", "prefix", "seg", "stem").agg(F.count("child").alias("n_children"), F.sum(F.when(F.col("child").isNotNull(), F.xxhash64("child").cast("decimal(38,0)"))).alias("children")), "segments")
    marked = _counted(_counted(plain, ["host", "prefix"], "siblings"), ["host", "prefix", "stem"], "stemmed")
    marked = marked.withColumn("by_stem", F.coalesce((F.col("siblings") >= STEM) & (F.col("stemmed") >= STEM) & (F.length("stem") >= STEM_LENGTH), F.lit(False)))
    rest = _counted(marked.filter(~F.col("by_stem")).drop("siblings", "stemmed", "stem"), ["host", "prefix"], "left").filter((F.col("left") >= SHAPE) & (F.col("n_children") > 0))
    rest = _counted(_counted(rest, ["host", "prefix"], "with"), ["host", "prefix", "n_children", "children"], "same")
    shaped = rest.filter((F.col("same") >= SHAPE) & (F.col("same") >= SHARE * F.col("with"))).select("host", "prefix", "seg", F.lit("{slug}").alias("to"))
    to = marked.filter("by_stem").select("host", "prefix", "seg", F.concat("stem", F.lit("{slug}")).alias("to")).unionByName(shaped)
    keyed = paths.withColumn("prefix", F.slice("segs", 1, d) if d else F.array().cast("array<string>")).withColumn("seg", F.when(F.size("segs") > d, F.col("segs")[d]))
    joined = keyed.join(to, ["host", "prefix", "seg"], "left")
    segs = F.when(F.col("to").isNotNull(), F.concat(F.col("prefix"), F.array("to"), F.slice("segs", F.lit(d + 2), F.size("segs")))).otherwise(F.col("segs"))
    return joined.select("host", "base", segs.alias("segs"))


def folded_paths(exchanges: DataFrame, depth: int | None = None) -> DataFrame:
    """(host, base, folded) of the paths that change; base is a path template without its query."""
    base = F.substring_index("path_template", "?", 1)
    last = F.element_at(F.split("path_template", "/"), -1)
    rows = exchanges.filter((F.col("method") != "OPTIONS") & ~is_probe(F.col("method"), F.col("path")) & ~last.rlike(FILE))
    paths = rows.select("host", base.alias("base")).distinct().withColumn("segs", F.array_remove(F.split("base", "/"), ""))
    if depth is None:
        depth = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    paths = before = settle(paths, "paths")
    for d in range(depth):
        level = paths.filter(F.size("segs") > d).select("host", F.slice("segs", 1, d).alias("prefix") if d else F.array().cast("array<string>").alias("prefix"), F.col("segs")[d].alias("seg"))
        if not level.distinct().groupBy("host", "prefix").count().filter(F.col("count") >= min(STEM, SHAPE)).isEmpty():
            paths = settle(_fold_level(paths, d), "paths")
    changed = paths.join(before.withColumnRenamed("segs", "old"), ["host", "base"]).filter(F.col("segs") != F.col("old"))
    slash = F.when(F.col("base").endswith("/") & (F.length("base") > 1), "/").otherwise("")
    return changed.select("host", "base", F.concat(F.lit("/"), F.concat_ws("/", "segs"), slash).alias("folded"))


def fold_siblings(exchanges: DataFrame) -> DataFrame:
    """``exchanges`` with path_template and referer_path folded alike."""
    to = settle(folded_paths(exchanges), "folds")
    return exchanges if to.isEmpty() else apply_folds(exchanges, to)


def apply_folds(exchanges: DataFrame, to: DataFrame) -> DataFrame:
    """``exchanges`` with the paths of ``to`` (host, base, folded) replaced."""
    names = exchanges.columns

    def apply(df: DataFrame, host: str, path: str) -> DataFrame:
        m = to.select(F.col("host").alias("__host"), F.col("base").alias("__base"), "folded")
        base = F.substring_index(F.col(path), "?", 1)
        joined = df.join(m, (F.col(host) == F.col("__host")) & (base == F.col("__base")), "left")
        new = F.coalesce(F.concat(F.col("folded"), F.expr(f"substring({path}, length(__base) + 1)")), F.col(path))
        return joined.select(*[new.alias(c) if c == path else F.col(c) for c in names])

    return apply(apply(exchanges, "host", "path_template"), "referer_host", "referer_path")
