"""Operators on token ids and filters against brute force: alignment, token files, audit of filters."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import prose
from trailmark.llm import alignment, filter_audit, huffman, segments, token_files

SCHEMA = "doc_id long, text string, lang string, ids string, n int, file long"
SPACES = ["a", "b", "the", " ", "  ", "\n", "\t", " \n", "'s", "é", " ", "\x1c", "\x85", "😀", "1", ".", "!!", "<|endoftext|>", "<s>", "<0x0A>", "\0", "漢字", "\r\n", "▁"]


def texts():
    r = random.Random(5)
    some = [prose(r.randrange(1, 200), s) for s in range(40)]
    some += ["".join(r.choice(SPACES) for _ in range(r.randrange(1, 25))) for _ in range(300)]
    some += ["", None, " ", "▁", "x" * 3000, "word " * 4000, some[0], some[0]]
    return some


@pytest.fixture(scope="module")
def rows():
    return [(3 * i % 501, t, ["en", "fr", None][i % 3], "clash", 1, 2) for i, t in enumerate(texts())] + [(0, "twice", "en", "", 0, 0), (0, "twice", "en", "", 0, 0), (None, "no id", "en", "", 0, 0), (None, "twice", "fr", "", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tokenizers():
    return segments.byte_tokenizer(segments.read(segments.BYTE_MODEL).decode(), False), segments.piece_tokenizer(segments.read(segments.PIECE_MODEL))


@pytest.mark.parametrize("kind", ["bytes", "bare bytes", "pieces"])
def test_words_give_the_ids_of_whole_texts(tokenizers, kind, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 900)
    monkeypatch.setattr(segments, "ROOM", 20_000)
    tokenizer, bare = tokenizers[kind == "pieces"], kind == "bare bytes"
    assert tokenizer.cuts
    # A piece tokenizer takes the letter that it writes for a space for one; such texts are not spelled by their ids.
    some = [t for t in texts() if t and not (kind == "pieces" and "▁" in t)]
    ids = segments.Ragged(tokenizer.kind)
    words = segments.Words(lambda ws, first: ids.extend(*(tokenizer.bare if first else tokenizer.spaced)(ws)), ids.keep, bare=bare)
    whole = tokenizer.whole([f" {t}" if kind == "bytes" else t for t in some])
    for at, group in segments.groups(pa.array(some)):
        for i, text in enumerate(group) if len(group) > 1 else []:
            rows, n = words.of([text])
            assert len(rows) == n.sum()
            assert ids.take(rows)[0].tolist() == whole[at + i].tolist(), text
        if len(group) == 1:
            got = np.concatenate([ids.take(words.of([b], k == 0)[0])[0] for k, b in enumerate(segments.blocks(group[0]))])
            assert got.tolist() == whole[at].tolist()


def aligned(rows, a, b):
    """By the byte ranges of all tokens."""
    out, counts = [], Counter()
    for doc_id, text, *_ in rows:
        x, y = (a.whole([f" {text}"])[0].tolist(), b.whole([text])[0].tolist()) if text else ([], [])
        ranges = []
        for ids, spelled in ((x, a.bytes), (y, b.bytes)):
            ends = np.cumsum([len(spelled[i]) for i in ids]).tolist()
            ranges.append(list(zip([0, *ends[:-1]], ends)))
        if not text or any(b"".join(s[i] for i in ids) != b" " + text.encode() for ids, s in ((x, a.bytes), (y, b.bytes))):
            out.append((doc_id, [], [], [], []))
            continue
        links = [(x[i], y[j]) for i, p in enumerate(ranges[0]) for j, q in enumerate(ranges[1]) if p[0] < q[1] and q[0] < p[1]] if len(x) < 400 else linked(x, y, *ranges)
        groups, begin = [], 0
        for end in sorted({p[1] for p in ranges[0]} & {q[1] for q in ranges[1]}):
            groups.append(tuple([i for i, p in zip(ids, r) if begin < p[1] <= end] for ids, r in zip((x, y), ranges)) if len(x) < 400 else ([], []))
            begin = end
        counts.update(links)
        out.append((doc_id, x, y, groups, links))
    return out, counts


def linked(x, y, p, q):
    i = j = 0
    while i < len(x) and j < len(y):
        if p[i][0] < q[j][1] and q[j][0] < p[i][1]:
            yield x[i], y[j]
        i, j = i + (p[i][1] <= q[j][1]), j + (q[j][1] <= p[i][1])


def test_alignment(spark, docs, rows, tokenizers):
    found, counts = aligned(rows, *tokenizers)
    best = Counter()
    for (_, second), n in counts.items():
        best[second] = max(best[second], n)
    want = Counter()
    for doc_id, x, y, groups, links in found:
        links = list(links) if isinstance(links, list) else list(linked_again(x, y, tokenizers))
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups and len(x) < 400 else "" if not groups else None
        want[(doc_id, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)] += 1
    for at_once in (alignment.PAIRS, 3):
        got = Counter()
        for r in alignment.summary(docs, at_once=at_once).collect():
            sha = r["groups_sha256"]
            key = (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"])
            got[(*key, sha if (*key, sha) in want or (*key, None) not in want else None)] += 1
        assert got == want
    assert alignment.summary(docs.limit(0)).count() == 0


def linked_again(x, y, tokenizers):
    ends = [np.cumsum([len(t.bytes[i]) for i in ids]).tolist() for ids, t in ((x, tokenizers[0]), (y, tokenizers[1]))]
    return linked(x, y, *(list(zip([0, *e[:-1]], e)) for e in ends))


def test_alignment_of_long_texts_block_by_block(tokenizers, monkeypatch):
    text = prose(2500, 8).replace(". ", " .  ")
    whole = next(alignment.Aligner(*tokenizers).texts([text]))
    monkeypatch.setattr(segments, "BLOCK", 700)
    parts = next(alignment.Aligner(*tokenizers).texts([text]))
    assert whole[:2] == parts[:2] and all(np.array_equal(p, q) for p, q in zip(whole[2:], parts[2:]))


def test_groups_spell_the_text(docs, rows, tokenizers):
    spelled, want = Counter(), Counter()
    for r in alignment.groups(docs).collect():
        sides = [b"".join(t.bytes[i] for i in ids) for t, ids in zip(tokenizers, (r["a_ids"], r["b_ids"]))]
        assert sides[0] == sides[1] and len(sides[0]) == r["end"] - r["begin"] > 0
        spelled[r["doc_id"], r["begin"], sides[0]] += 1
    for i, text, *_ in rows:
        if text and "▁" not in text:
            want[i] += len(text.encode()) + 1
            raw = b" " + text.encode()
            assert any(raw.startswith(part) for (j, begin, part) in spelled if j == i and begin == 0)
    got = Counter()
    for (i, _, part), n in spelled.items():
        got[i] += n * len(part)
    assert got == want


def test_code_lengths():
    r = np.random.default_rng(2)
    for n, longest in ((1, 4), (2, 4), (5, 3), (60, 6), (300, 9)):
        counts = np.r_[r.zipf(1.4, n) % 5000 + 1, 0]
        lengths = huffman.code_lengths(counts, longest)
        assert lengths[-1] == 0 and lengths[:-1].min() >= 1 and lengths.max() <= longest
        assert (2.0 ** -lengths[:-1]).sum() <= 1
        if n <= 5:  # no other lengths are shorter together
            grid = np.stack(np.meshgrid(*[np.arange(1, longest + 1)] * n), -1).reshape(-1, n)
            fits = grid[(2.0**-grid).sum(1) <= 1]
            assert (lengths[:-1] * counts[:-1]).sum() == (fits * counts[:-1]).sum(1).min()


def test_pack_and_unpack():
    r = np.random.default_rng(3)
    counts = np.bincount(r.zipf(1.2, 20_000) % 3000, minlength=3000)
    codec = huffman.Codec(huffman.code_lengths(counts))
    sizes = np.array([0, 1, huffman.LANE, huffman.LANE + 1, 5000, 0, 3, 2 * huffman.LANE])
    ids = r.choice(np.flatnonzero(counts), sizes.sum())
    bits, gaps, n = codec.pack(ids, sizes)
    begin = np.cumsum([0, *map(len, bits)])[:-1]
    assert n.tolist() == [max(0, x - 1) // huffman.LANE for x in sizes]
    assert codec.unpack(b"".join(bits), begin, sizes, gaps).tolist() == ids.tolist()


def test_token_files(spark, docs, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(segments.BYTE_MODEL)
    encoded = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    for limit in (token_files.BLOCK, 300):
        monkeypatch.setattr(token_files, "BLOCK", limit)
        token_files.write(docs, f"{tmp_path}/{limit}")
        got = token_files.read(spark, f"{tmp_path}/{limit}").collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == sorted((i is not None, i or 0, np.array(x, "<u4").tobytes()) for i, x in encoded)
        # Starts follow one another in the order of the ids, those without id first.
        inorder = sorted(got, key=lambda r: r["start"])
        assert [r["doc_id"] for r in inorder] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
        assert [r["start"] for r in inorder] == [0, *np.cumsum([len(r["ids"]) // 4 for r in inorder]).tolist()[:-1]]
    token_files.write(docs.limit(0), f"{tmp_path}/none")
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_damaged_block(spark, docs, tmp_path):
    token_files.write(docs.limit(5), f"{tmp_path}/a")
    blocks = spark.read.parquet(f"{tmp_path}/a/blocks")
    blocks.withColumn("crc", blocks["crc"] + 1).write.parquet(f"{tmp_path}/b/blocks")
    for name in ("codes", "files"):
        spark.read.parquet(f"{tmp_path}/a/{name}").write.parquet(f"{tmp_path}/b/{name}")
    with pytest.raises(Exception, match="damaged"):
        token_files.read(spark, f"{tmp_path}/b").collect()


def failures(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]


def test_filter_audit(spark):
    r = random.Random(9)
    base = [prose(r.choice([20, 199, 200, 400]), 50 + i) for i in range(12)]
    base += [base[0] + " #", base[3].upper(), base[5] + " x" * 500, "é" * 97 + "ABC", "é" * 96 + "ABC", "", None, "x " * 200]
    rows = [(i if i % 11 else None, r.choice(base), r.choice(["en", "fr", "", None]), "sha", True, 1) for i in range(150)]
    rows += [(1, base[0], "en", "", True, 0), (1, base[0], "en", "", True, 0), (1, base[0], "fr", "", False, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, sha string, good boolean, mask int").repartition(3)
    given = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    marked = {k: {i for i, *x in given if x[k] == 1 and i is not None} for k in (0, 1)}
    fails = [failures(t or "", i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, *_ in rows)) for i, t, *_ in rows]
    got = {(x["part"], x["filter_order"], x["step"]): x for x in filter_audit.audit(docs, labels).collect()}
    parts = {x[2] or "" for x in rows}
    assert len(got) == len(parts) * 600
    shapley = Counter()
    for part in parts:
        mine = [(x[0], f) for x, f in zip(rows, fails) if (x[2] or "") == part]
        for order in permutations(range(5)):
            left = list(mine)
            for step, k in enumerate(order):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                x = got[part, "".join("ABCDE"[i] for i in order), step + 1]
                assert (x["kept"], x["removed"]) == (len(left), len(gone))
                assert x["redundant"] == sum(f[k] for _, f in mine) - len(gone) - sum(f[k] for _, f in left)
                assert x["unique_fails"] == sum(f[k] and sum(f) == 1 for _, f in mine)
                assert [x["good_lost"], x["toxic_lost"]] == [sum(i in marked[c] for i, _ in gone) for c in (0, 1)]
                shapley[part, k] += len(gone)
    assert all(x["shapley"] == shapley[part, "ABCDE".index(order[step - 1])] for (part, order, step), x in got.items())
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_first_failure_table():
    table = filter_audit.first_failure(5)
    assert table.shape == (32, 120)
    for mask in (0, 1, 6, 31):
        for order, step in zip(filter_audit.orders(5), table[mask]):
            assert step == next((k for k, i in enumerate(order) if mask >> i & 1), 5)


def test_masks_of_long_texts_block_by_block(monkeypatch):
    text = ("Word  " * 300 + prose(300, 1)).encode()
    whole = filter_audit.text_mask(text)
    monkeypatch.setattr(filter_audit, "BLOCK", 50)
    assert filter_audit.text_mask(text) == whole


def test_signs_are_no_letters():
    from trailmark.llm import language_id

    assert [language_id.has_letter(t) for t in ("½ ② ٣ _ 12", "a", "½ é", "", "漢", "!!!")] == [False, True, True, False, True, False]


def test_examples_of_licences_do_not_depend_on_the_layout(spark):
    from trailmark.llm import licenses

    rows = [(i, "\n".join(f"line {i} {k}" for k in range(i % 9))) for i in range(60)] + [(None, "x\ny"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    picked = [sorted(licenses.examples(df.repartition(n), "doc_id", "text", 12, 3)) for n in (1, 5)]
    assert picked[0] == picked[1] and 0 < len(picked[0]) <= 36
    assert licenses.examples(df.limit(0), "doc_id", "text") == []
