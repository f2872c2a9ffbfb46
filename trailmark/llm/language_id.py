"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits.  One binary classifier for each bit, a logistic regression on hashed byte
n-grams of one to three bytes, predicts the bit of a text; the languages' codewords are compared with the predicted
margins by loss-weighted decoding (the sum of logistic losses), and the nearest one wins.  A text whose two nearest
codewords are about equally far is flagged as ambiguous.

Every value of the label column that has a text to learn from is a language.  The classifiers are fitted on a bounded
sample, at most ``SAMPLE`` labelled rows of each language chosen by a hash of id and text, of which whole texts are used;
equal rows count once there.  Prediction reads whole texts and nothing but the text.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing was learned; rows with a
null label are predicted but not learned from; with one learned language every text with a letter gets it; repeated
rows get equal results; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows of a language that the classifiers are fitted on; most of all languages together, of which each has
#: an equal part, but LEAST rows in any case.
SAMPLE = 1500
ROWS = 16_000
LEAST = 20
BUCKETS = 4096
UNSURE = 0.6
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Signs such as ½ or ① are alphanumeric, but no letters."""
    return any(m.group().isalpha() for m in _MAYBE.finditer(text))


def held_out(id_: Column, of: int = 4, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % of == rest


def grams(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams of one to three bytes; digits and punctuation count as spaces."""
    raw = np.frombuffer(b"  " + text.lower() + b"  ", np.uint8)
    x = np.where((raw >= 128) | ((raw >= 97) & (raw <= 122)), raw, 32).astype(np.uint32)
    two = (x[:-1] << 8) | x[1:]
    three = (two[:-1] << 8) | x[2:]
    counts = np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    counts = counts + np.bincount((two * np.uint32(2246822519)) >> np.uint32(20), minlength=BUCKETS)
    return counts + np.bincount((x * np.uint32(3266489917)) >> np.uint32(20), minlength=BUCKETS)


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length one: long texts and short ones look alike."""
    f = np.sqrt(counts.astype(np.float32))
    return f / np.maximum(np.linalg.norm(f, axis=-1, keepdims=True), 1e-9)


def codebook(n: int) -> np.ndarray:
    """n codewords of +1 and -1.

    Up to five languages, all distinct splits of the languages (an exhaustive code); for more, random columns of which
    the set with the largest least distance is taken.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        columns = [(1, *bits) for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(columns, float).T
    width = math.ceil(10 * math.log2(n))
    best, far = None, -1.0
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, width))
        if (np.abs(code.sum(0)) == n).any():
            continue
        least = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if least > far:
            best, far = code, least
    return best


def fit(x: np.ndarray, labels: np.ndarray, code: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression a bit, all at once; languages weigh the same, however many rows they have."""
    y = code[labels]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    weight = (1 / np.maximum(np.bincount(labels, minlength=len(code)), 1))[labels].astype(np.float32)[:, None]
    weight /= weight.sum()
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = weight * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        speed_w = 0.9 * speed_w + x.T @ pull.astype(np.float32) - ridge * w
        speed_b = 0.9 * speed_b + pull.sum(0)
        w, b = (w + 8 * speed_w).astype(np.float32), (b + 8 * speed_b).astype(np.float32)
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword by logistic loss, its score (softmax of the negated losses), and whether it is ambiguous."""
    loss = np.logaddexp(0, -margins) @ (code > 0).T + np.logaddexp(0, margins) @ (code < 0).T
    near = np.exp(loss.min(1, keepdims=True) - loss)
    p = near / near.sum(1, keepdims=True)
    best = p.argmax(1)
    score = p[np.arange(len(p)), best]
    return best, score, score < UNSURE


def predict(model):
    """model: broadcast of (languages, code, weights, biases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, w, b = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at: list[int] = []
            held: list[np.ndarray] = []

            def settle(at=at, held=held, lang=lang, score=score, unsure=unsure) -> None:
                if at:
                    k, s, u = decode(features(np.stack(held)) @ w + b, code)
                    for i, x in zip(at, k, strict=True):
                        lang[i] = langs[x]
                    score[at], unsure[at] = s, u
                    at.clear(), held.clear()

            for i, x in enumerate(texts):
                text = x.as_py()
                if langs and text and has_letter(text):
                    at.append(i)
                    held.append(grams(text.encode("utf-8", "replace")))
                    if len(at) == 256:
                        settle()
            settle()
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], kept + ["lang_pred", "score", "ambiguous"]
            )

    return run


def share_of(most: int, languages: int) -> int:
    """Most rows of each of so many languages."""
    return max(min(most, LEAST), min(most, ROWS // max(languages, 1)))


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE) -> DataFrame:
    """lang, text of about ``most`` different rows (or the language's share of ROWS) of each language among the rows that may be learned from."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    counts = rows.select("lang", "h").distinct().groupBy("lang").count()
    most = share_of(most, counts.count())
    # Hashes are spread evenly, so this share of them has about ``most`` rows, with room for chance; learn() cuts the rest.
    share = F.least(F.lit(1.0), F.lit(most + 5 * math.sqrt(most)) / F.col("count"))
    cuts = counts.select(F.col("lang").alias("l"), F.ceil(share * 1_000_003).alias("cut"))
    near = rows.join(F.broadcast(cuts), F.col("lang") == F.col("l")).filter(F.pmod("h", F.lit(1_000_003)) < F.col("cut"))
    return near.dropDuplicates(["lang", "h"]).select("lang", "text")


def sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang"))
        found = [features(grams(x.as_py().encode("utf-8", "replace"))).astype("<f2").tobytes() for x in batch.column(batch.schema.get_field_index("text"))]
        yield pa.RecordBatch.from_arrays([langs, pa.array(found, pa.binary())], ["lang", "grams"])


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, code, weights, biases) from the labelled rows."""
    seen: dict[str, list[np.ndarray]] = {}
    for r in sample(df, id_col, text_col, lang_col, most).mapInArrow(sample_grams, "lang string, grams binary").toLocalIterator():
        if len(own := seen.setdefault(r["lang"], [])) < most:
            own.append(np.frombuffer(bytes(r["grams"]), "<f2"))
    # One share for all, as hashes are chosen with room for chance.
    limit = share_of(most, len(seen))
    langs = sorted(seen)
    seen = {k: seen[k][:limit] for k in langs}
    code = codebook(len(langs))
    if len(langs) < 2:
        return langs, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32)
    x = np.concatenate([np.stack(seen[k]) for k in langs]).astype(np.float32)
    labels = np.repeat(np.arange(len(langs)), [len(seen[k]) for k in langs])
    return langs, code, *fit(x, labels, code)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, ambiguous."""
    model = df.sparkSession.sparkContext.broadcast(learn(df, id_col, text_col, lang_col, most))
    rows = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rows.mapInArrow(predict(model), schema).withColumnRenamed("id", id_col)
