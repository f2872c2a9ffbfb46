"""Token counts of texts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

Pre-tokens are words ``[^\\x20\\x09-\\x0D]+`` with a leading space.  A task puts the distinct pre-tokens it meets in a
trie; the forward scores are computed once for every prefix, whichever pre-tokens share it, and the end of a pre-token
holds its token count.  A text's count is the sum over its pre-tokens.  Trie and counts start afresh when the trie is
full, which costs time and changes no count.  Nothing is shuffled.

Defined results: a null or empty text has no tokens; repeated rows get equal counts; an empty table gives an empty
result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.pieces import MODEL, Counts, load


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for x in batch.column(1).cast(pa.large_binary()):
                words = (x.as_py() or b"").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: id, n_words, n_tokens."""
    vocabulary = df.sparkSession.sparkContext.broadcast(load(model))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_count(vocabulary), schema).withColumnRenamed("id", id_col)
