"""A corpus pipeline: each stage works on what its predecessor kept, written as Parquet in between.

Defined results: a null or empty text fails the quality rules; nulls of source or language belong to the group of other
values; of repeated rows one stays; texts of any length are handled whole; an empty table gives an empty result; other
columns go along as far as the mixing, whatever their names, and the encoding keeps doc_id, lang and source.

Stages of one session are meant to run one after another, each on the written result of the one before: a stage deletes
the intermediate tables of the stage before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_scan
from trailmark.llm.store import Scratch


_held: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Where a stage keeps its intermediate tables; those of the stage before are not read any more."""
    for old in _held:
        if old.spark is spark:
            old.clear()
    _held[:] = [Scratch(spark, name)]
    return _held[0]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior or the base checks reject go."""
    return quality.keep_good(docs, scratch=_scratch(spark, "quality"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs, scratch=_scratch(spark, "exact"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles, the smallest doc_id stays."""
    return ngram_join.keep_one(docs, scratch=_scratch(spark, "ngram"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and kinds of writing have their target weights."""
    return mixing.mix(docs, scratch=_scratch(spark, "mixing")).filter("drawn").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents that are left."""
    return sentencepiece_scan.encode(docs, keep=["doc_id", "lang", "source"], check=True, scratch=_scratch(spark, "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: Expectation-maximisation, raking to convergence and best segmentations are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name.split()[0])
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
