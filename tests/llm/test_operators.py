"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import exact_dedup, language_id, licenses, links, lm, mixing, ngram_join, passages, quality, sets, shingles
from trailmark.llm.shingles import windows, word_hashes
from trailmark.llm.store import SHUFFLES_END, Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(17)
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w + (".\n" if i % 23 == 22 else "." if i % 9 == 8 else ""))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="module")
def rows():
    base = [prose(rng.randrange(60, 220), s) for s in range(30)]
    texts = list(base)
    texts += [base[0], base[0].replace(" ", "  "), base[1] + " tail", base[2].replace(" ", "\t", 3)]
    for k in range(12):  # a group of near copies of one original
        w = base[3].split(" ")
        w[5 + 3 * k] = f"edit{k}"
        texts.append(" ".join(w))
    texts += ["", "   \n\t ", "one", "one two", "One TWO", "x " * 300, "A" * 5000, "é ü ß " * 20, "!!! ### $$$", None, None]
    passage = prose(60, 999)
    texts += [prose(80, 500) + " " + passage, prose(90, 501) + ".\n" + passage + "\n" + prose(30, 502)]
    return [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}", "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "src0", "clash", 1), (None, base[5], "en", None, "clash", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, kept string, c int"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (min(named) if named else None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def brute_figures(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_and_verdicts(docs, rows, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], brute_figures(r[1])) for r in rows)
    assert Counter((r["doc_id"], tuple(r[c] for c in quality.FIGURES[:5])) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_fit_finds_the_bad_cluster():
    good, bad = (0, 1, 0, 0), (-1, -1, -1, 0)
    prior, odds = quality.fit([(good, 900), (bad, 60), ((-1, 0, 0, 0), 5)])
    assert prior > 0
    score = lambda v: prior + sum(o[x] for o, x in zip(odds, v))
    assert score(good) > 0 > score(bad)
    assert quality.fit([]) == (0.0, [])


def test_language_model_base_scores(docs, rows, empty):
    got = lm.score(docs, head=40).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not crc(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        ws = tokens(r[1])
        want[r[0], crc(r[0]), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score(empty).count() == 0


@pytest.mark.parametrize("head", [1, 3])
def test_language_model_counts_the_end_beyond_the_head(spark, head):
    """In few, long documents the end is rarer than the words that are sent to every task."""
    data = [(i, "a b c d e " * 50) for i in range(20)]
    got = lm.score(spark.createDataFrame(data, "doc_id long, text string"), head=head).collect()
    docs_ = sum(not r["held_out"] for r in got)
    n, v = 251 * docs_, 6
    for r in got:
        assert r["train_tokens"] == n and r["n_known"] == r["n_tokens"] == 251
        assert r["base_score"] == pytest.approx(250 * math.log10((50 * docs_ + 1) / (n + v + 1)) + math.log10((docs_ + 1) / (n + v + 1)))


def test_language_model_is_normalised():
    import numpy as np

    pairs = np.random.default_rng(1).poisson(3, (12, 12)).astype(float)
    pairs[3, 4] = 500
    table = lm.train(pairs, width=4, steps=80)
    assert np.allclose((10.0**table).sum(1), 1)
    assert table[3, 4] > table[2, 4]


def test_vectors_of_words_maximise_their_objective():
    import numpy as np

    r = np.random.default_rng(3)
    q, b, unigram = r.normal(0, 0.5, (20, 4)), r.normal(-3, 0.5, 20), np.full(20, 1 / 20)
    counts, start = r.poisson(2, (6, 20)).astype(float), r.normal(0, 0.3, (6, 4))
    counts[5] = 0
    got = lm.own_vectors(counts, start, q, b, unigram, steps=20)

    def objective(at, i):
        margin = q @ at + b - np.log(lm.NOISE * unigram)
        return -(counts[i] * np.log1p(np.exp(-margin)) + counts[i].sum() * lm.NOISE * unigram * np.log1p(np.exp(margin))).sum() - ((at - start[i]) ** 2).sum() / 2

    for i in range(6):
        assert all(objective(got[i], i) >= objective(got[i] + d, i) for d in r.normal(0, 0.05, (50, 4)))
    assert np.allclose(got[5], start[5])


def test_language_model_learns_what_follows_rare_words(spark):
    """Words far beyond the frequent ones that tell the next word: held-out texts score above the base and above classes alone."""
    chain = [f"w{i}x" for i in range(1500)]
    tell = {w: random.Random(w).choice(["alpha", "beta", "gamma", "delta"]) for w in chain}
    text = lambda i: " ".join(x for w in random.Random(i).choices(chain, k=150) for x in (w, tell[w]))
    got = lm.score(spark.createDataFrame([(i, text(i)) for i in range(150)], "doc_id long, text string")).filter("held_out").collect()
    n = sum(r["n_tokens"] for r in got)
    assert n and sum(r["score"] for r in got) / n > sum(r["base_score"] for r in got) / n + 0.3
    # A word drawn from 1500 costs log10(1500), so the words that it tells must cost less than one of four does.
    told = (sum(r["score"] for r in got) + len(got) * 150 * math.log10(1500)) / (len(got) * 150)
    assert told > math.log10(1 / 4)


def test_language_identification(spark, empty):
    kinds = {"en": "the of and thing edly tion", "fr": "éaux le une oiment què ç", "de": "schung der ß ücht pf ei"}
    data = [(i, " ".join(random.Random(i).choice(kinds[k].split()) for _ in range(25)), k) for i in range(150) for k in [list(kinds)[i % 3]]]
    df = spark.createDataFrame([*data, (900, None, "en"), (901, "123 !!", "en"), (902, "thing of the", None), (902, "thing of the", None)], "doc_id long, text string, lang string")
    got = language_id.identify(df).collect()
    truth = {i: k for i, _, k in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    rest = {r["doc_id"]: r for r in got if r["doc_id"] >= 900}
    assert rest[900]["lang_pred"] == rest[901]["lang_pred"] == "und" and rest[900]["score"] == 0
    assert rest[902]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] == 902 for r in got) == 2
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More than 64 languages, and one of many rows that share one id."""
    langs = [f"l{k:02d}" for k in range(70)]
    kinds = {k: ["".join(random.Random(f"{k}{i}").choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for i in range(12)] for k in [*langs, "one id"]}
    text = lambda k, i: " ".join(random.Random(f"{k}:{i}").choices(kinds[k], k=30))
    data = [(100 * a + i, text(k, i), k) for a, k in enumerate(langs) for i in range(12)]
    one = next(i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = spark.createDataFrame(data + [(one, text("one id", i), "one id") for i in range(3000)], "doc_id long, text string, lang string").cache()
    assert {r["lang"] for r in language_id.sample(df, "doc_id", "text", "lang").select("lang").distinct().collect()} == set(kinds)
    sample = language_id.sample(df, "doc_id", "text", "lang", most=100).groupBy("lang").count().collect()
    assert 20 <= {r["lang"]: r["count"] for r in sample}["one id"] < 300
    got = language_id.identify(df.filter(F.col("lang") != "one id")).collect()
    assert {r["lang_pred"] for r in got} == set(langs)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords_are_far_apart(n):
    code = language_id.codebook(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 3 else 2)


def test_mixing_meets_margins(docs, rows, empty):
    cells = {("a", "x"): 100.0, ("a", "y"): 300.0, ("b", "x"): 50.0, (None, "y"): 550.0}
    shares = [{"a": 0.5, "b": 0.2, None: 0.3}, {"x": 0.4, "y": 0.6}]
    w = mixing.rake(cells, shares)
    assert sum(w.values()) == pytest.approx(1)
    assert sum(v for k, v in w.items() if k[0] == "a") == pytest.approx(0.5, abs=1e-6)
    p = mixing.calibrate(cells, w, 400)
    assert sum(n * p[k] for k, n in cells.items()) == pytest.approx(400, rel=1e-6) and max(p.values()) <= 1
    got = mixing.mix(docs, budget=0.6).collect()
    assert len(got) == len(rows)
    total = sum(r["n_tokens"] for r in got)
    assert total == sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(0.6 * total, rel=1e-6)
    assert not any(r["drawn"] for r in got if r["n_tokens"] == 0)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("most", [mixing.MOST_CELLS, 0])
def test_mixing_against_plain_raking(spark, monkeypatch, most):
    """More than 256 sources, a hot one, nulls, texts without words and repeated rows; by arrays and by tables."""
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    r = random.Random(5)
    data = [(i, " ".join(["w"] * r.randrange(0, 90)) if i % 50 else None, r.choice(["en", "en", "fr", None]), "hot" if i % 3 == 0 else None if i % 31 == 0 else f"s{i % 290}") for i in range(900)]
    data += data[:5]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()
    kind = lambda t: "notes" if len(t or "") < 600 else "article"
    cells = Counter()
    for i, t, lang, source in data:
        cells[source, lang, kind(t)] += len((t or "").split())
    cells = {k: n for k, n in cells.items() if n}
    assert len({k[0] for k in cells}) > 256
    total = sum(cells.values())
    goals = []
    for a, power in enumerate((0.5, 0.7, 0.85)):
        by = Counter()
        for k, n in cells.items():
            by[k[a]] += n
        goals.append({v: n**power / sum(m**power for m in by.values()) for v, n in by.items()})
    w = {k: n / total for k, n in cells.items()}
    for _ in range(60):
        for a, goal in enumerate(goals):
            by = Counter()
            for k, x in w.items():
                by[k[a]] += x
            w = {k: x * goal[k[a]] / by[k[a]] for k, x in w.items()}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(n, mid * w[k]) for k, n in cells.items()) < 0.7 * total else (low, mid)
    assert len(got) == len(data)
    want = {i: (len((t or "").split()), cells.get((source, lang, kind(t)), 0), w.get((source, lang, kind(t)), 0.0)) for i, t, lang, source in data}
    for x in got:
        n, size, weight = want[x["row"]["doc_id"]]
        assert x["n_tokens"] == n and x["cell"] == (x["row"]["source"], x["row"]["lang"], kind(x["row"]["text"]))
        assert x["weight"] == pytest.approx(weight, rel=1e-5, abs=1e-12) and x["probability"] == pytest.approx(min(1, high * weight / size) if size else 0, rel=1e-5, abs=1e-9)
    draws = {}
    assert all(draws.setdefault(x["row"]["doc_id"], x["drawn"]) == x["drawn"] for x in got)


def test_mixing_to_given_targets(docs):
    got = mixing.mix(docs, {"source": {"src0": 0.5, "src1": 0.2, None: 0.3}}, budget=0.2).collect()
    share = Counter()
    for x in {(x["cell"], x["weight"]) for x in got}:
        share[x[0]["source"]] += x[1]
    assert share == {"src0": pytest.approx(0.5, abs=1e-6), "src1": pytest.approx(0.2, abs=1e-6), None: pytest.approx(0.3, abs=1e-6)}


def test_license_notices(spark, rows, empty):
    notices = [(1, "Some words.\nReleased under the MIT License.\nmore", "mit"), (2, "Licensed under the Apache License, Version 2.0.", "apache-2.0"), (3, "This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), (4, "Licensed under CC BY-NC 4.0.", "cc-by-nc")]
    data = [(i, t) for i, t, _ in notices] + [(100 + k, r[1]) for k, r in enumerate(rows)] + [(500, "She studied at MIT and then moved."), (501, prose(90, 3) + " released under the MIT License. " + prose(40, 4))]
    got = licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).filter("confirmed").collect()
    found = {r["doc_id"]: r["family"] for r in got}
    assert found == {i: f for i, _, f in notices} | {501: "mit"}
    assert {r["paragraph"] for r in got if r["doc_id"] == 1} == {1}
    assert licenses.scan(empty).count() == 0


def test_dual_and_wrapped_license_notices(spark, rows):
    grant = " ".join(licenses.TEMPLATES["mit"][2].split())
    half = len(grant.split()) // 2
    wrapped = [" * " + " ".join(grant.split()[:half]), " * " + " ".join(grant.split()[half:]) + "."]
    data = [
        (1, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
        (2, "Released under the MIT License. " + prose(40, 8).replace("\n", " ") + " Licensed under the Apache License, Version 2.0."),
        (3, "\n".join([prose(30, 9).replace("\n", " ") + ".", "", *wrapped, "", "The end."])),
    ]
    data += [(100 + k, r[1]) for k, r in enumerate(rows)]
    got = licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).filter("doc_id < 100").collect()
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]}
    assert found == {(1, 0, "mit"), (1, 0, "apache-2.0"), (2, 0, "mit"), (2, 0, "apache-2.0"), (3, 2, "mit")}
    assert sum(r["doc_id"] == 3 for r in got) == 1


def test_shared_passages(docs, rows, empty):
    got = passages.repeated(docs).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append(r)
    last = max(r[0] for r in rows if r[0] is not None)
    for i in (last - 1, last):  # the passage inside a longer line, and as lines of its own
        assert sum(r["n_words"] for r in spans[i]) >= 45
    assert any(r["removed"] for r in spans[last]) and not any(r["removed"] for r in spans[last - 1])
    words = {r[0]: tuple((r[1] or "").lower().split()) for r in rows}
    for r in got:  # nothing is reported that no other document has nearly
        own = words[r["doc_id"]][r["start_word"] : r["end_word"]]
        grams = {own[k : k + 5] for k in range(len(own) - 4)}
        assert any(len(grams & {w[k : k + 5] for k in range(len(w) - 4)}) >= 0.5 * len(grams) for i, w in words.items() if i != r["doc_id"])
    assert passages.repeated(empty).count() == 0
    cut = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs.filter(F.col("doc_id") >= last - 1)).collect()}
    assert len(cut[last].split()) < len(words[last]) and len(cut[last - 1].split()) == len(words[last - 1])


def test_passages_keep_only_what_their_result_reads(spark, docs):
    """The tables that a step before has read are gone."""
    scratch = Scratch(spark, "test")
    got = passages.repeated(docs, scratch=scratch)
    kept = {p.name.split("-", 1)[1] for p in Path(scratch.path.removeprefix("file:")).iterdir()}
    assert not kept & {"met", "lines", "places", "items", "tiles", "units", "classes", "hits", "ends", "asked"} and {"spans", "more"} <= kept
    assert got.count()


def test_shuffle_files_go_with_the_writing(spark, docs):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for f in folders for p in Path(f).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(SHUFFLES_END)
    saved = Scratch(spark, "test").save(docs.groupBy("doc_id").count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and saved.count() and spark.conf.get(SHUFFLES_END) == setting


@pytest.mark.parametrize("ends", [0, 4, 9])
def test_shared_passages_at_every_offset(spark, ends):
    """52 shared words inside longer lines, whatever is around them, are found to their ends."""
    r = random.Random(ends)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(4))
    stopped = lambda ws: [w + "." if ends and i % ends == ends - 1 else w for i, w in enumerate(ws)]
    data, want = [], {}
    for k in range(60):
        passage = stopped([word() for _ in range(52)])
        for copy in range(2):
            before = [word() for _ in range(5 + (k * (copy + 1)) % 61)]
            data.append((2 * k + copy, " ".join([*stopped(before), *passage, *[word() for _ in range(5 + k % 7)]])))
            want[2 * k + copy] = (len(before), len(before) + 52, copy == 1, 2 * k)
    got = passages.repeated(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(want)
    for r in got:
        start, end, removed, keep = want[r["doc_id"]]
        assert (r["removed"], r["keep_id"]) == (removed, keep) and r["start_word"] <= start and end <= r["end_word"]
        assert r["n_words"] <= 52 + 2  # a word that follows by chance
    assert sum(r["n_words"] == 52 for r in got) >= 0.7 * len(got)


def test_line_links_find_near_copies(spark):
    """Against all pairs of lines: of those alike by 0.8 or more, 0.9 at least are in one component, and no others."""
    r = random.Random(12)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(4))
    lines = []
    for _ in range(120):
        ws = [word() for _ in range(r.randrange(9, 70))]
        lines.append(ws)
        for _ in range(2):
            v = list(ws)
            for _ in range(r.randrange(1, 3)):
                v[r.choice([0, len(v) - 1, r.randrange(len(v))])] = word()
            lines.append(v)
    shingles = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in lines]
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j])}
    df = spark.createDataFrame([(i, 0, " ".join(x)) for i, x in enumerate(lines)], "id long, t int, text string")
    met = df.mapInArrow(passages._units, passages.ROW.format("long")).filter("start < 0")
    tiles = links.shared_keys(met.select("key", "c")).join(met.select("key", "c", "id", "t"), ["key", "c"])
    scratch = Scratch(spark, "test")
    labels, places = passages.line_links(df, scratch.save(tiles), scratch)
    label = {x["id"]: x["label"] for x in places.join(labels, "c").collect()}
    assert len(alike) > 80 and sum(i in label and label[i] == label.get(j) for i, j in alike) >= 0.9 * len(alike)
    parent = list(range(len(lines)))
    for i, j in sorted(alike) * 3:
        parent[i] = parent[j] = min(parent[i], parent[j])
    assert all(parent[i] == parent[j] for i in label for j in label if label[i] == label[j])


def test_removed_words_are_in_another_document(spark):
    """Between two shared runs with a few words of its own, those words stay."""
    word = lambda k: f"w{k}x"
    left, right = [word(k) for k in range(30)], [word(k) for k in range(100, 130)]
    data = [(1, " ".join([*left, *right])), (2, " ".join(["aa", *left, "own", "words", "in", "here", "are", "six", *right, "zz"])), (2, " ".join(["aa", *left, "own", "words", "in", "here", "are", "six", *right, "zz"]))]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, `__id` string, spans int")
    got = sorted((r["start_word"], r["end_word"]) for r in passages.repeated(df).collect() if r["doc_id"] == 2)
    assert got == [(1, 31), (37, 67)]
    texts = {r["text"] for r in passages.without_repeats(df).filter("doc_id = 2").collect()}
    assert {t.replace("  ", " ").strip() for t in texts} == {"aa own words in here are six zz"}


def test_short_near_copies_share_a_band():
    import numpy as np

    r, found = np.random.default_rng(9), 0
    for k in range(300):
        a = r.integers(0, 2**63, 13 + k % 12).astype(np.uint64)
        b = np.r_[a, r.integers(0, 2**63, 1 + k % 2).astype(np.uint64)]
        keys = [passages.banded(windows(x, 5), np.zeros(1, np.int64), np.array([len(x)]), np.ones(1, np.uint64))[0] for x in (a, b)]
        found += len(np.intersect1d(*keys)) > 0
    assert found >= 290


def brute_components(rows, n, num, den):
    sets_ = []
    for r in rows:
        w = tuple((r[1] or "").encode().lower().split())
        sets_.append(frozenset(w[k : k + n] for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([w] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets_[i] & sets_[j])
            if both and den * both >= num * (len(sets_[i]) + len(sets_[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets_, strict=True))]


@pytest.mark.parametrize(("n", "threshold"), [(3, Fraction(9, 10)), (5, Fraction(8, 10))])
def test_ngram_join(docs, rows, empty, n, threshold):
    got = ngram_join.join(docs, n=n, threshold=threshold).collect()
    want = brute_components(rows, n, threshold.numerator, threshold.denominator)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert ngram_join.join(empty).count() == 0


def test_tile_keys_share_for_similar_sets():
    import numpy as np

    r, t = np.random.default_rng(3), Fraction(9, 10)
    for size in (10, 11, 14, 19, 40, 150, 151, 700):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            changed = int(r.integers(0, sets.differing(t, size, size) // 2 + 1))
            b = np.unique(np.r_[a[changed:], r.integers(0, 2**63, changed).astype(np.uint64)])
            if not np.array_equal(a, b) and sets.alike(a, b, t):
                assert np.intersect1d(ngram_join.tile_keys(a, t, ngram_join.bands(1)), ngram_join.tile_keys(b, t, ngram_join.bands(1))).size
                assert sets.bits_apart(sets.bitmap(a).tobytes(), sets.bitmap(b).tobytes()) <= sets.differing(t, len(a), len(b))


def item_table(spark, sets_):
    rows = [(i, len(e), bytearray(sets.bitmap(e).tobytes()), bytearray(e.tobytes())) for i, e in enumerate(sets_)]
    return spark.createDataFrame(rows, ngram_join.ITEM)


@pytest.mark.parametrize("items", [7, 1000])
def test_clusters_of_several_blocks(spark, monkeypatch, items):
    """A chain of sets, each similar to the next alone, is one group however it and its tile are cut into blocks."""
    import numpy as np

    monkeypatch.setattr(links, "BLOCK", 150)
    monkeypatch.setattr(links, "ITEMS", items)
    all_ = np.unique(np.random.default_rng(5).integers(0, 2**63, 400).astype(np.uint64))
    chain = [np.sort(all_[i * 4 : i * 4 + 100]) for i in range(20)] + [np.sort(all_[300:390])]
    tiles = spark.createDataFrame([(1, i, 0) for i in range(len(chain))], "key long, c long, low long")
    got = links.groups(tiles, item_table(spark, chain), Fraction(9, 10), Scratch(spark, "test")).collect()
    assert {r["node"]: r["label"] for r in got} == dict.fromkeys(range(20), 0)


def test_heavy_values_are_spread(spark, monkeypatch):
    monkeypatch.setattr(links, "HEAVY", 10)
    left = spark.createDataFrame([(1 if i < 60 else None if i < 90 else i, i) for i in range(100)], "k long, v long")
    right = spark.createDataFrame([(i, i * 2) for i in [1, *range(95, 120)]], "k long, w long")
    plain = lambda how: sorted(map(str, left.join(right, "k", how).collect()))
    for how in ("inner", "left"):
        assert sorted(map(str, links.spread_join(left, right, "k", how).collect())) == plain(how)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in links.components(edges, Scratch(spark, "test")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    r = random.Random(4)
    pairs = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(0, k) for k in range(200, 230)]
    want = {}
    for a, b in pairs * 120:
        if a != b:
            want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    got = links.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)


def test_windows_tell_order_and_length():
    one = lambda s: set(windows(word_hashes(s.encode())[1], 3).tolist())
    assert one("a b c") != one("c b a") and one("a b") != one("b a") and len(one("a b c a b c")) == 3 and one("a b") & one("a b c") == set()


def test_word_hashes_of_any_block(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices("ab\u00e9", k=r.choice([1, 2, 3, 9, 63, 64, 65, 200]))) for _ in range(3000)]
    raw = b"\t ".join(w.encode() for w in ["", *words, ""])
    starts, hashes = shingles.word_hashes(raw)
    assert [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] == starts.tolist()
    assert len(dict(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert all(h == g for w, h in zip(words, hashes.tolist()) for g in shingles.word_hashes(w.encode())[1].tolist())
    monkeypatch.setattr(shingles, "BLOCK", 100)
    assert all(np.array_equal(a, b) for a, b in zip(shingles.word_hashes(raw), (starts, hashes)))
    assert [len(x) for x in shingles.word_hashes(b"")] == [len(x) for x in shingles.word_hashes(b" \n ")] == [0, 0]
    assert [x.tolist() for x in passages.paragraphs([None, b"a b\n\n c", b"", b"d\n"])[1:]] == [[2, 1, 1], [0, 3, 0, 1]]
