"""Exact de-duplication of texts whose groups of copies may be huge (DataFrame functions only).

Copies are combined in three steps, each of which compares whole normalised texts because the text itself is a
grouping key beside its digest:

1. every map task folds the copies it has read (the partial aggregate of step 2);
2. the folded rows meet under (digest, salt), so a group with a third of all rows is spread over ``SALTS`` keys;
3. the winners of the salts, at most ``SALTS`` rows a text, meet under the digest.

The way back from documents to groups joins on (digest, salt) as well; no step sees a whole group in one task.

Defined results: a null text counts as empty; a null id loses against any id; of repeated rows with one id and one
text exactly one stays; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.store import Scratch

WHITE = r"[\x20\x09-\x0D]+"
SALTS = 32


def normalised(text):
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select(
        "id", "norm", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("fp"), F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt")
    )


def winners(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text: sha, fp, keep_id, group_size, and in ``salts`` a bit for each salt that holds copies."""
    salted = (
        _digests(df, id_col, text_col)
        .groupBy("sha", "fp", "salt", "norm")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    )
    bit = F.expr("shiftleft(1L, salt)")
    return (
        salted.groupBy("sha", "fp", "norm")
        .agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(bit).alias("salts"))
        .select("sha", "fp", "keep_id", "group_size", "salts")
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(df.sparkSession, "exact")
    by_salt = winners(df, id_col, text_col).select(
        "sha", "fp", "keep_id", "group_size",
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1L) = 1L)")).alias("salt"),
    )
    rows = _digests(df, id_col, text_col).drop("norm").join(by_salt, ["sha", "fp", "salt"])
    # Repeated rows tie on the smallest id: which one of them stays is settled on the small, written table.
    rows = scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    first = (
        rows.filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("sha", "fp")
        .agg(F.min("uid").alias("uid"))
        .select("uid", F.lit(True).alias("first"))
    )
    return rows.join(first, "uid", "left").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``."""
    names = df.columns
    scratch = scratch or Scratch(df.sparkSession, "exact")
    keep = scratch.save(winners(df, id_col, text_col).select("sha", "fp", "keep_id"), "keep")
    norm = normalised(F.col(text_col))
    tagged = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("fp"), F.col(id_col).alias("id")
    )
    kept = tagged.alias("t").join(
        keep.alias("k"),
        (F.col("t.sha") == F.col("k.sha")) & (F.col("t.fp") == F.col("k.fp")) & F.col("t.id").eqNullSafe(F.col("k.keep_id")),
        "left_semi",
    )
    ids = df.select(F.col(id_col).alias("id"), F.lit(1).alias("one"))
    repeated = ids.groupBy("id").agg(F.count("one").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["sha", "fp"])
    return kept.select("row.*")
