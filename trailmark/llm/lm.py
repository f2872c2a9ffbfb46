"""Log-bilinear language model, trained by noise-contrastive estimation, and scores of whole texts.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end.  The model predicts the class of a token from
the token before it.  The ``FREQUENT`` most frequent words are a class each, the end is one (and is the context of the
first word), and the other words share ``ENDINGS`` classes by their last two bytes, within which a word has its smoothed
share of the class.  As a context, every head word met ``OWN_CONTEXT`` times or more has a vector of its own, and only
rarer words use that of their class.

Training sees every training text.  Counts of class pairs, a table of bounded size, give the vectors of the classes.
Counts of (word, class after it), a table that grows with vocabulary and corpus and is grouped by word in a shuffle, give
each word its vector: the same noise-contrastive objective with the predicted side held fixed, drawn to the vector of the
word's class, many words at a time.  Estimation runs in numpy, with the expectation over the noise taken exactly, and
matrix products normalise over all classes.

Three passes over the texts: count words, count pairs, score.  Counts and vectors of the most frequent words (at most
``HEAD``) go to the tasks as a broadcast; the counts of all other words meet the documents' rare words in a shuffled
join, so nothing that grows with the vocabulary is sent to one place.

Defined results: a null text counts as empty, which is one token, the end; repeated rows get equal scores, each its own
row; a null id is a training row; without training texts all counts are zero; an empty table gives an empty result;
extra columns do not matter.  Texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.store import Scratch

FREQUENT = 512
ENDINGS = 128
CLASSES = 1 + FREQUENT + ENDINGS
#: Most words whose counts are sent to every task.
HEAD = 200_000
#: Training tokens from which on a head word has a vector of its own as a context.
OWN_CONTEXT = 8
#: Numbers in a vector, and noise tokens for one that was seen.
WIDE = 24
NOISE = 10
#: Distinct words, or pairs, that a task holds before it hands its counts on.
HELD_WORDS = 200_000
HELD_PAIRS = 2_000_000
END = b""


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, which is what is asked for."""
    return text.lower().split() if text else []


def held_out(id_: Column, of: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % of == rest


def ending_class(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word[-2:]) % ENDINGS


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return (x.as_py() for x in column)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in _texts(batch):
            counts.update(words(text))
            counts[END] += 1
            if len(counts) > HELD_WORDS:
                yield flush()
    yield flush()


class _Classes(dict):
    """word -> class; words that are not listed are classed by their ending and remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            for w in [w for w, k in self.items() if k > FREQUENT]:
                del self[w]
        self[word] = k = ending_class(word)
        return k


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times), len(found)).astype(np.int64)


def count_pairs(head):
    """head: broadcast of (head words, the class of each, the context of each); counts of pairs of classes, and of words with
    a context of their own and the class after them.  A pair is context * CLASSES + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, classes, contexts = head.value
        places = {w: i for i, w in enumerate(words_)}
        get, rare = places.get, len(words_)
        endings = _Classes()
        total = np.zeros(CLASSES * CLASSES, np.int64)
        held: list[np.ndarray] = []
        own: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = kept = 0

        def batch_of(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["pair", "n"])

        def fold() -> None:
            nonlocal size, kept
            pairs = np.concatenate(held)
            total[:] += np.bincount(pairs[:, 1], minlength=len(total))
            mine = pairs[pairs[:, 0] >= CLASSES * CLASSES, 0]
            if len(mine):
                found, n = np.unique(mine, return_counts=True)
                own.append(found)
                times.append(n)
                kept += len(found)
            held.clear()
            size = 0

        for batch in batches:
            for text in _texts(batch):
                tokens = words(text)
                at = np.array([get(w, rare) for w in tokens], np.int64)
                kinds, before = np.zeros(len(at) + 2, np.int64), np.zeros(len(at) + 1, np.int64)
                kinds[1:-1], before[1:] = classes[at], contexts[at]
                lost = np.flatnonzero(at == rare)
                if len(lost):
                    kinds[lost + 1] = before[lost + 1] = [endings[tokens[i]] for i in lost]
                held.append(np.stack([before * CLASSES + kinds[1:], kinds[:-1] * CLASSES + kinds[1:]], 1))
                size += len(before)
                if size > 1_000_000:
                    fold()
                if kept > HELD_PAIRS:
                    pairs, n = _summed(own, times)
                    own, times, kept = [pairs], [n], len(pairs)
                    if kept > HELD_PAIRS // 2:
                        yield from batch_of(pairs, n)
                        own, times, kept = [], [], 0
        if held:
            fold()
        if own:
            yield from batch_of(*_summed(own, times))
        at = np.flatnonzero(total)
        yield from batch_of(at, total[at])

    return run


def count_endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and distinct words in each class of endings."""
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        for word, k in zip(_texts(batch, "word"), batch.column(batch.schema.get_field_index("n")).to_pylist(), strict=True):
            c = ending_class(word)
            n[c] += k
            v[c] += 1
    at = np.flatnonzero(v)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(v[at])], ["class", "n", "v"])


def learn(pairs: np.ndarray, width: int = WIDE, noise: int = NOISE, steps: int = 150, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of classes as contexts, vectors of predicted classes and their biases, from the counts of pairs.

    The score of a pair is (r[before] C) . q[after] + b[after]; noise words come from the smoothed unigram distribution.
    """
    rng = np.random.default_rng(seed)
    k = len(pairs)
    unigram = smoothed(pairs)
    before = pairs.sum(1)
    total = max(1.0, float(before.sum()))
    expected = np.log(noise * unigram)[None, :]
    params = [rng.normal(0, 0.1, (k, width)), np.eye(width), rng.normal(0, 0.1, (k, width)), np.log(unigram)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen, drawn = pairs / total, (before / total)[:, None] * noise * unigram[None, :]
    for step in range(1, steps + 1):
        r, c, q, b = params
        guess = r @ c
        sure = 1 / (1 + np.exp(-np.clip(guess @ q.T + b - expected, -30, 30)))
        slope = seen * (1 - sure) - drawn * sure
        back = slope @ q
        grads = [back @ c.T, r.T @ back, slope.T @ guess, slope.sum(0)]
        for i, g in enumerate(grads):
            scale = np.sqrt(np.mean(g * g)) + 1e-12  # counts differ by orders of magnitude between rows
            g = g / scale
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            params[i] = params[i] + rate * (1 - step / (steps + 1)) * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-3)
    r, c, q, b = params
    return r @ c, q, b


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """Shares of the predicted classes."""
    return (pairs.sum(0) + 1.0) / (pairs.sum() + len(pairs))


def normalised(contexts: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 P(class | context) for each context, by one matrix product."""
    s = contexts @ q.T + b
    s -= s.max(1, keepdims=True)
    return (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)


def train(pairs: np.ndarray, **settings) -> np.ndarray:
    """Normalised log10 P(class | class before), from the counts of pairs."""
    return normalised(*learn(pairs, **settings))


def own_vectors(counts: np.ndarray, start: np.ndarray, q: np.ndarray, b: np.ndarray, unigram: np.ndarray, noise: int = NOISE, pull: float = 1.0, steps: int = 6) -> np.ndarray:
    """Vectors of words as contexts, from the counts of the classes after them; ``start``: the vectors of their classes.

    Newton steps on the noise-contrastive objective of each word less ``pull`` / 2 times the squared distance from the
    start, which is concave, so the result does not depend on the batch.
    """
    width = q.shape[1]
    squares = (q[:, :, None] * q[:, None, :]).reshape(len(q), width * width)
    expected = b - np.log(noise * unigram)
    drawn = counts.sum(1, keepdims=True) * noise * unigram
    at = start.copy()
    for _ in range(steps):
        sure = 1 / (1 + np.exp(-np.clip(at @ q.T + expected, -30, 30)))
        slope = (counts * (1 - sure) - drawn * sure) @ q - pull * (at - start)
        bend = (((counts + drawn) * sure * (1 - sure)) @ squares).reshape(-1, width, width) + pull * np.eye(width)
        move = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        far = np.sqrt((move * move).sum(1, keepdims=True))
        at += move * np.minimum(1, 4 / np.maximum(far, 1e-12))
    return at


def fit_contexts(model):
    """model: broadcast of (vectors and classes of the contexts, predicted vectors, biases, shares of classes).

    From (context, classes after it, their counts): the context, its vector, and the log10 of the sum that normalises it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, classes, q, b, unigram = model.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                ids = batch.column(0).to_numpy()
                after, n = batch.column(1), batch.column(2)
                row = np.repeat(np.arange(len(ids)), np.diff(after.offsets.to_numpy()))
                counts = np.zeros((len(ids), CLASSES))
                counts[row, after.flatten().to_numpy()] = n.flatten().to_numpy()
                found = own_vectors(counts, starts[classes[ids - CLASSES]], q, b, unigram).astype(np.float32)
                s = found @ q.T + b
                top = s.max(1, keepdims=True)
                room = (top[:, 0] + np.log(np.exp(s - top).sum(1))) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in found], pa.binary()), pa.array(room)], ["context", "vector", "room"])

    return run


def score_texts(model):
    """model: broadcast of (head words, their classes, log10(c + 1), log10 share in the class, pair table, room of each class, count of the end,
    contexts of the head words, vectors of the contexts that are not classes with what normalises them, predicted vectors and biases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes, base, share, table, room, ends, contexts, vectors, sums, q, bias = model.value
        index = {w: i for i, w in enumerate(head)}
        get, rare = index.get, len(head)
        flat = table.ravel()
        for batch in batches:
            out: list[tuple] = []
            for text in _texts(batch):
                tokens = words(text)
                at = np.array([get(w, rare) for w in tokens], np.int64)
                kinds, before = np.zeros(len(at) + 2, np.int64), np.zeros(len(at) + 1, np.int64)
                known = at < rare
                kinds[1:-1], before[1:] = classes[at], contexts[at]
                lost = np.flatnonzero(~known)
                tail = Counter(tokens[i] for i in lost)
                b = float(base[at].sum() + np.log10(ends + 1))
                s = float(share[at].sum())
                if len(lost):
                    own = [ending_class(tokens[i]) for i in lost]
                    kinds[lost + 1] = before[lost + 1] = own
                    s -= float(room[own].sum())
                after, mine = kinds[1:], before >= CLASSES
                s += float(flat[before[~mine] * CLASSES + after[~mine]].sum())
                w, k = before[mine] - CLASSES, after[mine]
                for i in range(0, len(w), 100_000):
                    w_, k_ = w[i : i + 100_000], k[i : i + 100_000]
                    s += float(((np.einsum("ij,ij->i", vectors[w_], q[k_]) + bias[k_]) / np.log(10) - sums[w_]).sum(dtype=np.float64))
                out.append((len(at) + 1, int(known.sum()) + (ends > 0), b, s, list(tail), list(tail.values())))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds_ = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            names = ["n_tokens", "n_known", "base", "score", "tail", "times"]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)], kept + names
            )

    return run


def head_floor(counts: DataFrame, most: int) -> int:
    """The least count n such that at most ``most`` words have n or more."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["s"], r["k"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()), reverse=True)
    floor, total = None, 0
    for _, k, least in sizes:  # at most 16 * 63 steps
        total += k
        if total > most:
            break
        floor = least
    return floor if floor is not None else 2**62


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lm")
    sc = spark.sparkContext
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    training = rows.filter(~F.col("held_out")).select("text")
    counts = scratch.save(training.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    floor = head_floor(counts, head)
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(F.col("n") >= floor).toLocalIterator()), key=lambda x: (-x[1], x[0]))
    frequent = [w for w, _ in top if w != END][:FREQUENT]
    listed = set(frequent) | {END}
    of = {w: i + 1 for i, w in enumerate(frequent)} | {END: 0}
    classes = np.array([of.get(w, -1) if w in listed else ending_class(w) for w, _ in top] + [0], np.int64)
    contexts = np.array([k if w in listed or n_ < OWN_CONTEXT else CLASSES + i for i, ((w, n_), k) in enumerate(zip(top, classes))] + [0], np.int64)
    found = training.mapInArrow(count_pairs(sc.broadcast(([w for w, _ in top], classes, contexts))), "pair long, n long")
    found = scratch.save(found.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    pairs = np.zeros(CLASSES * CLASSES)
    for r in found.filter(F.col("pair") < CLASSES * CLASSES).toLocalIterator():  # at most CLASSES ** 2 rows
        pairs[r["pair"]] = r["n"]
    pairs = pairs.reshape(CLASSES, CLASSES)
    starts, q, bias = learn(pairs)
    table = normalised(starts, q, bias).astype(np.float32)
    after = F.collect_list(F.struct((F.col("pair") % CLASSES).alias("k"), "n"))  # at most CLASSES of them
    own = found.filter(F.col("pair") >= CLASSES * CLASSES).groupBy(F.floor(F.col("pair") / CLASSES).alias("context")).agg(after.alias("after"))
    own = own.select("context", F.col("after.k").alias("k"), F.col("after.n").alias("n"))
    vectors, sums = np.zeros((len(top), WIDE), np.float32), np.zeros(len(top), np.float32)
    for r in own.mapInArrow(fit_contexts(sc.broadcast((starts, classes, q, bias, smoothed(pairs)))), "context long, vector binary, room double").toLocalIterator():  # at most ``head`` rows
        vectors[r["context"] - CLASSES], sums[r["context"] - CLASSES] = np.frombuffer(r["vector"], np.float32), r["room"]
    inside, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    frequent_rows = spark.createDataFrame([(w,) for w in listed], "word binary")
    tails = counts.join(F.broadcast(frequent_rows), "word", "left_anti").mapInArrow(count_endings, "class long, n long, v long")
    for r in tails.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        inside[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    room = np.log10(inside + kinds + 1)
    logs = np.array([np.log10(k + 1) for _, k in top] + [0.0])
    share = np.array([0.0 if w in listed else np.log10(k + 1) - room[ending_class(w)] for w, k in top] + [0.0])
    # The end is in no document's tail, so its count goes along whether it is among the head words or not.
    ends = counts.filter(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = sc.broadcast(([w for w, _ in top], classes, logs, share, table, room, int(ends), contexts, vectors, sums, q.astype(np.float32), bias.astype(np.float32)))
    # Row ids are fixed by writing them: what follows reads the table.
    first = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "held_out", "text")
    schema = f"rid long, id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<binary>, times array<long>"
    scored = scratch.save(first.mapInArrow(score_texts(model), schema), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("m"))
    more = (
        rare.join(counts.filter(F.col("n") < floor), "word")
        .groupBy("rid")
        .agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more"), F.sum("m").alias("known"))
    )
    more_ = F.coalesce("more", F.lit(0.0))
    return scored.join(more, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + more_ - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("score") + more_).alias("score"),
    )
