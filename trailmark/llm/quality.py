"""Quality verdicts by weak supervision (DataFrame functions only).

Each rule votes good or bad, or abstains, on figures of the text.  The votes of all documents that pass the base checks,
counted by pattern (at most 3 ** rules patterns, whatever the input), go through expectation-maximisation, which
estimates for every rule how often it votes either way on good and on bad documents.  A document is kept if its posterior probability of being
good is at least a half.

Figures of a text, over words ``[^\\x20\\x09-\\x0D]+``: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words
(words in windows of three words that the text holds twice or more; windows are compared by a 64-bit hash).

Defined results: a null or empty text has no words and fails; repeated rows get equal verdicts; an empty table gives an
empty result; extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.store import Scratch

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_runs", "n_lone", "n_distinct"]
ROUNDS = 60


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (good if, bad if); neither: the rule abstains."""
    never = F.lit(False)
    mean = _ratio("word_chars", "n_words")
    letters = _ratio("n_letters", "word_chars")
    variety = F.col("n_distinct") / F.sqrt(F.greatest("n_words", F.lit(1)))
    return {
        "word_length": (never, (mean < 2.5) | (mean > 14)),
        "letters": (letters > 0.93, letters < 0.8),
        "symbols": (never, _ratio("n_symbols", "word_chars") > 0.03),
        "runs": (never, _ratio("n_runs", "n_words") > 0.1),
        "lone": (never, _ratio("n_lone", "n_words") > 0.1),
        "capitals": (never, _ratio("n_upper", "word_chars") > 0.3),
        "digits": (never, _ratio("n_digits", "word_chars") > 0.3),
        "lines": (never, _ratio("n_dup_lines", "n_lines") > 0.3),
        "windows": (never, _ratio("n_repeat_words", "n_words") > 0.3),
        "variety": (variety > 5, variety < 2.5),
    }


def with_figures(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` as a struct column ``row``, and the figures of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda chars: F.length(F.col("packed")) - F.length(F.regexp_replace("packed", chars, ""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    split = rows.select(
        "row",
        text.alias("text"),
        F.array_remove(F.split(text, WHITE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace(text, WHITE, "").alias("packed"),
    )
    counted = split.select(
        "row",
        F.size("words").alias("n_words"),
        F.length("packed").alias("word_chars"),
        bare(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        bare(r"\p{Lu}").alias("n_upper"),
        bare(r"\d").alias("n_digits"),
        bare(r"\p{L}").alias("n_letters"),
        F.regexp_count("packed", F.lit(r"[^\p{L}\p{N}]{2,}")).alias("n_runs"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).alias("n_lone"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.expr("CASE WHEN size(words) < 4 THEN array() ELSE transform(sequence(1, size(words) - 2), i -> xxhash64(words[i - 1], words[i], words[i + 1])) END").alias("windows"),
    )
    counted = counted.withColumn("several", F.size(F.array_distinct("windows")) < F.size("windows"))
    ordered = counted.withColumn("windows", F.expr("CASE WHEN several THEN array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"))
    repeated = ordered.withColumn(
        "at",
        F.expr("CASE WHEN several THEN transform(filter(windows, (w, k) -> (k > 0 AND windows[k - 1].h = w.h) OR (k + 1 < size(windows) AND windows[k + 1].h = w.h)), w -> w.i) END"),
    ).drop("windows")
    covered = F.expr("CASE WHEN several THEN size(array_distinct(flatten(transform(at, i -> array(i, i + 1, i + 2))))) ELSE 0 END")
    return repeated.select("row", *[(covered if c == "n_repeat_words" else F.col(c)).cast("long").alias(c) for c in FIGURES])


def votes() -> list[Column]:
    """For every rule 1 (good), -1 (bad) or 0."""
    return [F.when(good, 1).when(bad, -1).otherwise(0).cast("int").alias(f"vote_{name}") for name, (good, bad) in rules().items()]


#: What is believed of a rule before any data: how often it votes good, neither and bad on a good and on a bad document.
#: Counted as this share of all documents, so that data can move it and a rule that never fires can't run away.
BELIEF = {1: {1: 0.5, 0: 0.48, -1: 0.02}, 0: {1: 0.1, 0: 0.5, -1: 0.4}}
BELIEF_SHARE = 0.02


def fit(patterns: Iterable[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """The prior log odds of good, and for each rule the log odds that a vote adds.

    Expectation-maximisation for two hidden classes and independent three-valued votes, started from ``BELIEF`` and kept
    near it by a Dirichlet prior.  A good vote never speaks against a document, a bad one never for it and an abstention
    neither way: without that, the classes could change places.
    """
    patterns = [(v, n) for v, n in patterns if n]
    if not patterns:
        return 0.0, []
    weight = BELIEF_SHARE * sum(n for _, n in patterns) + 1
    start = {x: math.log(BELIEF[1][x] / BELIEF[0][x]) if x else 0.0 for x in (-1, 0, 1)}
    prior, odds = 0.0, [dict(start) for _ in patterns[0][0]]

    def posterior(v: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(o[x] for o, x in zip(odds, v, strict=True))))))

    for _ in range(rounds):
        good = [posterior(v) for v, _ in patterns]
        mass = {1: sum(n * p for (_, n), p in zip(patterns, good, strict=True))}
        mass[0] = sum(n for _, n in patterns) - mass[1]
        prior = math.log((mass[1] + weight) / (mass[0] + weight))
        for j, o in enumerate(odds):
            share = {}
            for c in (0, 1):
                votes_of = {x: weight * BELIEF[c][x] for x in (-1, 0, 1)}
                for (v, n), p in zip(patterns, good, strict=True):
                    votes_of[v[j]] += n * (p if c else 1 - p)
                share[c] = {x: k / (mass[c] + weight) for x, k in votes_of.items()}
            o[1] = max(0.0, math.log(share[1][1] / share[0][1]))
            o[-1] = min(0.0, math.log(share[1][-1] / share[0][-1]))
    return prior, odds


def _verdicts(figures: DataFrame) -> DataFrame:
    names = [f"vote_{r}" for r in rules()]
    figures = figures.select("*", *votes())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = figures.filter(~failed).groupBy(*names).count().collect()  # at most 3 ** len(rules()) rows
    prior, odds = fit((tuple(r[c] for c in names), r["count"]) for r in counted)
    total = F.lit(float(prior))
    for c, o in zip(names, odds, strict=False):
        total = total + F.when(F.col(c) == 1, F.lit(float(o[1]))).when(F.col(c) == -1, F.lit(float(o[-1]))).otherwise(F.lit(0.0))
    return (
        figures.withColumn("base_failed", failed)
        .withColumn("quality", 1 / (1 + F.exp(-total)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the base figures, base_failed, kept, quality (the posterior) and the votes.

    The figures, without the texts, are written once and read for both the fit and the verdicts.
    """
    figures = with_figures(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    figures = Scratch(df.sparkSession, "quality").save(figures.select(F.col("row.id").alias("id"), *FIGURES), "figures")
    out = _verdicts(figures)
    return out.select(F.col("id").alias(id_col), *FIGURES[:5], "base_failed", "kept", "quality", *[c for c in out.columns if c.startswith("vote_")])


def keep_good(df: DataFrame, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``df`` that are kept, with the columns of ``df``."""
    figures = (scratch or Scratch(df.sparkSession, "quality")).save(with_figures(df, text_col), "figures")
    return _verdicts(figures).filter("kept").select("row.*")
