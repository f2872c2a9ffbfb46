"""Segmentations against the SentencePiece library with the same pieces and scores, and exact round trips."""

import random
import struct

import pytest

from trailmark.llm import pieces, sentencepiece_scan, token_counts
from trailmark.llm.store import Scratch


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's own unigram segmentation over our vocabulary; only what compares with it needs it."""
    spm = pytest.importorskip("sentencepiece")
    old = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    scores = {i: s for s, i in vocabulary.scores.values()}
    out = b""
    for i in range(old.get_piece_size()):
        kind = 2 if old.is_unknown(i) else 3 if old.is_control(i) else 6 if old.is_byte(i) else 1
        out += _field(1, _field(1, old.id_to_piece(i).encode()) + _field(2, float(scores.get(i, 0.0))) + _field(3, kind))
    out += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    return spm.SentencePieceProcessor(model_proto=out)


TEXTS = ["", " ", "the cat sat", "  two  spaces ", "line\nbreak\tand ünïcode", "Éauxment de la oià", "x" * 50, "日本語 text 🙂", "under ▁ score", "!!!###%%% 123456 a,b.c", "\n\n", "thethethethe ingingtion"]


def test_best_score_equals_library(vocabulary, library):
    encoder = pieces.Encoder(vocabulary)
    by_id = {i: s for s, i in vocabulary.scores.values()}
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["th", "er", "on", " ", "tion", "é", "Q", "7", ".", " "]) for _ in range(60)) for _ in range(60)]
    for text in texts:
        ids, score = sentencepiece_scan.encode_text(text, encoder)
        theirs = library.encode(text)
        own = sum(by_id.get(i, 0.0) for i in ids)
        other = sum(by_id.get(i, 0.0) for i in theirs)
        assert own == pytest.approx(other, abs=1e-2), text
        if ids != theirs and "▁" not in text:
            assert len(ids) == pytest.approx(len(theirs), abs=2)


def test_round_trip_and_chunks(spark, vocabulary):
    rng = random.Random(5)
    long = ["".join(rng.choice(["th", "er", "on", " ", "tion", "é", "Q", "\n", ".", "  "]) for _ in range(900)), "".join(rng.choice("thering") for _ in range(700)), " " * 333, "é" * 300]
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + long)] + [(99, None, "x"), (0, "", "x"), (13, long[0], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoder = pieces.Encoder(vocabulary)
    got = sentencepiece_scan.decode(sentencepiece_scan.encode(df, giant=120, chunk=40)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == r["text"]
        if r["text"] is None:
            assert r["ids"] is None and r["n_pieces"] is None
            continue
        ids, score = sentencepiece_scan.encode_text(r["text"], encoder)
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["n_pieces"] == len(r["ids"])
        assert r["ids"] == ids and r["score"] == score


def test_ties_are_settled_alike_in_whole_and_cut_texts(spark):
    """A vocabulary of many equal segmentations: together, alone and in chunks the ids are the same, those of brute force."""
    pairs = ["a", "b", "ab", "ba", "aa", "aba", "bab", " a", " b", " ", " ab"]
    v = pieces.Vocabulary({p: (-1.0 * len(p.strip() or " "), i) for i, p in enumerate(pairs)}, list(range(100, 356)), -20.0)
    encoder = pieces.Encoder(v)

    def brute(text):
        best = [(0.0, [])]
        for e in range(1, len(text) + 1):
            found = [(best[s][0] + v.scores[text[s:e]][0], -s, best[s][1] + [v.scores[text[s:e]][1]]) for s in range(e) if text[s:e] in v.scores]
            top = max(found, key=lambda x: x[:2])
            best.append((top[0], top[2]))
        return best[-1][1]

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab" if k % 3 else "aab ") for _ in range(rng.randrange(20, 200))) for k in range(60)] + ["ab" * 90, "a" * 77, "ab " * 60]
    want = [brute(" " + t) for t in texts]
    assert [sentencepiece_scan.encode_text(t, encoder)[0] for t in texts] == want
    words = sorted({s for t in texts for s in v.segments(" " + t)})
    assert [encoder.gathered(encoder.places([w]))[0].tolist() for w in words] == [encoder.best(w)[0] for w in words]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = sentencepiece_scan.scan(df, spark.sparkContext.broadcast(v), v.longest, Scratch(spark, "test"), chunk=11).collect()
    assert {r["rid"]: r["ids"] for r in got} == dict(enumerate(want))


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "the cat", "x", 2)], "doc_id long, `text` string, `a.b` string, round_trip int")
    got = sentencepiece_scan.encode(df, check=True)
    assert got.columns == ["doc_id", "text", "a.b", "n_pieces", "score", "ids", "round_trip"]
    assert got.first()["round_trip"] is True and sentencepiece_scan.encode(df, giant=2, check=True).first()["ids"] == got.first()["ids"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_scan.decode(sentencepiece_scan.encode(empty)).count() == 0
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_equal_library(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (50, None), (60, "w" * 900)], "id2 long, body string")
    got = {r["id2"]: r for r in token_counts.token_counts(df, "id2", "body").collect()}
    assert got[50]["n_tokens"] == 0 and got[60]["n_words"] == 1
    for i, t in enumerate(TEXTS):
        words = [w.decode() for w in t.encode().split()]
        if "▁" not in t:
            assert got[i]["n_tokens"] == sum(len(library.encode(w)) for w in words), t
        assert got[i]["n_words"] == len(words)


def test_tries_that_start_afresh_change_nothing(vocabulary):
    words = [w.encode() for w in "the then there thing other another ion tion nation".split()]
    small, large = pieces.Counts(vocabulary), pieces.Counts(vocabulary)
    small.trie.most = 3
    assert [small[w] for w in words * 3] == [large[w] for w in words * 3]
