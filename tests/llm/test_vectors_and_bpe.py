"""Forced-boundary encoding, hard negatives and vector codes against the library and brute force."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ctrlspark.llm import forced_bpe, hard_negatives, vector_codes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
DOCS = "doc_id long, text string, ids string, key string, start int"
VECTORS = "vec_id long, embedding array<double>, label int, vector string, score string, anchor_id int, size int, turn int"
TEXTS = [
    None, "", " \n\t ", "a", "it's 've DON'T  two  spaces \n\n x", "é" * 300 + " 日本語 😀 １２３ ﷽", "x" * 9000, " " * 4000 + "y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "\n\n\r\n b",
    "same text", "same text", "".join(map(chr, range(1, 700))), "zqjxvkwqzj" * 50, "Ġ Ċ ġ", " <|endoftext|>\n",
]


def documents(spark, texts):
    return spark.createDataFrame([(None if i == 4 else i, t, "clash", "clash", 1) for i, t in enumerate(texts)], DOCS)


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_matches_the_library(spark):
    texts = TEXTS + ["lorem ipsum dolor. " * 60_000]  # the last has more than a megabyte
    docs = documents(spark, texts)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in forced_bpe.digest(forced_bpe.encode(docs)).collect())
    assert got == sorted((-1 if i == 4 else i, *expected(t)) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in forced_bpe.decode(forced_bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if i != 4)


def test_codec_of_empty_tables_and_null_ids(spark):
    empty = documents(spark, [])
    assert forced_bpe.digest(forced_bpe.encode(empty)).count() == 0 and forced_bpe.decode(forced_bpe.encode(empty)).count() == 0
    null = spark.createDataFrame([(1, None), (2, []), (3, [50256, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in forced_bpe.decode(null).collect()} == {1: "", 2: "", 3: "<|endoftext|>a"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab 'stre\n", max_size=60), st.just("<|endoftext|>"), st.text("éüß漢😀 ", max_size=20)), max_size=6))
def test_fragments_equal_the_library_on_random_texts(parts):
    texts = [*parts, "".join(parts)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, at = forced_bpe.codec(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    for k, t in enumerate(texts):
        mine = ids[at[k] : at[k + 1]]
        assert mine.tolist() == LIB.encode(t, add_special_tokens=False).ids
        assert forced_bpe.codec(PATH).decode(mine).decode() == LIB.decode(mine.tolist(), skip_special_tokens=False)


def test_decoder_replaces_broken_characters():
    codec = forced_bpe.codec(PATH)
    for text in ("日本", "😀", "é"):
        ids = LIB.encode(text, add_special_tokens=False).ids
        for cut in range(len(ids)):
            assert codec.decode(np.array(ids[:cut], np.uint32)).decode() == LIB.decode(ids[:cut], skip_special_tokens=False)
    with pytest.raises(ValueError):
        codec.decode(np.array([50257]))


def test_cut_pairs_stand_in_no_token():
    codec = forced_bpe.codec(PATH)
    buf = np.frombuffer(b"zqjxvk\xc3\xa9 the", np.uint8)
    cut = set(np.flatnonzero(codec.starts(buf, np.array([0, len(buf)]))).tolist())
    tokens = [LIB.decode([i], skip_special_tokens=False).encode() for i in range(0, 50_256) if LIB.id_to_token(i)]
    for i in range(1, len(buf)):
        if not any(bytes(buf[i - 1 : i + 1]) in t for t in tokens) and buf[i - 1] < 0x80 > buf[i]:
            assert i in cut


# --- hard negatives ---------------------------------------------------------
def mined(rows, every, positives, negatives, low=30, high=90, scale=256):
    """Brute force with Python integers."""
    rows = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, g in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (v, g))
    out = []
    for a, (va, ga) in anchors.items():
        pairs = sorted((-sum(x * y for x, y in zip(va, v)), i, g) for i, v, g in rows if i != a and len(v) == len(va))
        for s, p, _ in [x for x in pairs if x[2] == ga][:positives]:
            fine = [(i, n) for n, i, g in pairs if g != ga and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, k, i, -s, -n) for k, (i, n) in enumerate(fine, 1)]
    return sorted(out)


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "clash", 0, 0, 0) for r in rows], VECTORS).repartition(parts)


def clouds(seed, n, dim=6, labels=4, grid=8):
    r = random.Random(seed)
    return [(i, [r.randint(-grid, grid) / grid for _ in range(dim)], r.randrange(labels)) for i in range(n)]


HARD = [
    (None, [1.0] * 6, 1), (-20, [0.5] * 6, 2), (2001, None, 1), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] * 6, 1),
    (2005, [0.25] * 6, None), (2010, [0.0] * 6, 0), (2020, [1.0, 2.0], 0), (2021, [1.0, 1.5], 0), (2022, [0.7, 0.9], 1), (2030, [], 1), (2031, [], 2), (2032, [], 1),
]


@pytest.mark.parametrize("blocks", [(512, 4096, 16_384), (3, 7, 5)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHOR_BLOCK", "ROW_BLOCK", "ANCHORS"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clouds(3, 300) + HARD + clouds(3, 40) + [(400 + i, [0.5] * 6, i % 2) for i in range(60)]  # repeated ids, ties
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, rows), every=10, positives=3, negatives=4).collect())
    want = mined(rows, 10, 3, 4)
    assert got == want and len({r[0] for r in want}) > 20


def test_hard_negatives_of_empty_tables_and_large_values(spark):
    assert hard_negatives.mine(vectors(spark, [])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1), (2, [1.0], 1)])).count() == 0  # no anchor
    assert hard_negatives.mine(vectors(spark, [(100, [1.0], 1), (2, [1.0], 1)])).count() == 0  # no negative
    big = [(0, [1e5, 3e5], 1), (1, [1e5 + 1, 3e5], 1), (2, [1e5, 1e5 + 0.3], 2), (3, [9e4, 2e5], 2)]
    assert sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, big)).collect()) == mined(big, 100, 5, 10)


def test_keys_sort_by_anchor_descending_score_kind_and_id():
    r = random.Random(1)
    rows = [(r.choice([-5, 0, 7]), r.choice([-(1 << 62), -1, 0, 1, 1 << 62]), r.randrange(2), r.choice([-3, 0, 1 << 60])) for _ in range(200)]
    assert [hard_negatives.unpacked(k) for k in sorted(hard_negatives.packed(*x) for x in rows)] == sorted(rows, key=lambda x: (x[0], -x[1], x[2], x[3]))


def test_windows_hold_one_anchor_at_a_time():
    keys = iter(sorted(hard_negatives.packed(a, s, k, i) for a in (1, 2) for s, k, i in ((10, 0, 5), (0, 0, 6), (0, 1, 3), (9, 1, 4), (3, 1, 8), (2, 1, 9))))
    assert list(hard_negatives.windows_of(keys, 5, 10, 30, 90)) == [(a, p, n, i, ps, s) for a in (1, 2) for p, n, i, ps, s in ((5, 1, 4, 10, 9), (5, 2, 8, 10, 3), (6, 1, 3, 0, 0))]


# --- vector codes -----------------------------------------------------------
def coded(rows, parts, entries, rounds, scale):
    """Brute force: (vec_id, code, error, label_error), the hash of the codebooks."""
    rows = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    lead = min(((i, len(v)) for i, v, _ in rows if i is not None), default=(0, 0))[1]
    rows = [r for r in rows if len(r[1]) == lead]
    width = lead // parts
    first = {}
    for i, v, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    start = [first[i] for i in sorted(first)[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in start] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(v, p)[1] for p in range(parts)] for _, v, _ in rows]
        books = [[[sum(c) // len(c) for c in zip(*own)] if (own := [cut(v, p) for (_, v, _), c in zip(rows, chosen) if c[p] == k]) else e for k, e in enumerate(books[p])] for p in range(parts)]
    final = [(i, g, [near(v, p) for p in range(parts)]) for i, v, g in rows]
    by = {}
    for _, g, c in final:
        by[g] = by.get(g, 0) + sum(d for d, _ in c)
    return sorted((i if i is not None else -1, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), by[g]) for i, g, c in final), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def digest(spark, rows, **how):
    got = vector_codes.digest(*vector_codes.compress(vectors(spark, rows), **how)).collect()
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


@pytest.mark.parametrize("hot", [50, 100_000])
def test_vector_codes(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "HOT_ROWS", hot)
    rows = [(i, v, None if g == 3 else g) for i, v, g in clouds(5, 400)] + HARD + clouds(5, 30) + [(None, [0.1] * 6, 7)]
    how = dict(parts=3, entries=16, rounds=4, scale=32)
    got, names = digest(spark, rows, **how)
    want, name = coded(rows, *how.values())
    assert got == want and names == {name}
    few, names = digest(spark, rows[:5], **how)  # fewer vectors than entries
    assert (few, names) == (coded(rows[:5], *how.values())[0], {coded(rows[:5], *how.values())[1]})
    assert digest(spark, [(1, [0.5] * 8, 1)], entries=1) == (coded([(1, [0.5] * 8, 1)], 8, 1, 6, 4096)[0], {coded([(1, [0.5] * 8, 1)], 8, 1, 6, 4096)[1]})


def test_vector_codes_of_empty_tables_and_odd_lengths(spark):
    assert digest(spark, []) == ([], set())
    assert digest(spark, [(1, None, 1), (2, [], 1), (None, [1.0] * 8, 1)]) == ([], set())
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 7, 1)]))


def test_orchard_search_is_exact_and_skips():
    r = np.random.default_rng(2)
    for k in (1, 2, 16, 60):
        for spread in (3, 50):
            book = vector_codes.Codebook(r.integers(-spread, spread, (k, 4)))
            points = r.integers(-spread, spread, (500, 4))
            apart = ((points[:, None] - book.entries) ** 2).sum(axis=2)
            entry, error = book.nearest(points)
            assert (entry == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
    # well parted entries: most are never measured
    book, measured = vector_codes.Codebook(1000 * r.integers(-50, 50, (60, 4))), []
    book.measure = lambda p, e, own=book.measure: measured.append(len(e)) or own(p, e)
    book.nearest(book.entries[r.integers(0, 60, 500)] + r.integers(-3, 3, (500, 4)))
    assert sum(measured) < 500 * 60 * 0.7


def test_codes_give_vectors_back(spark):
    rows = clouds(8, 10)
    codes, books = vector_codes.compress(vectors(spark, rows), parts=2, entries=16, rounds=1, scale=8)
    back = {r.vec_id: r.embedding for r in vector_codes.reconstruct(codes, books, scale=8).collect()}
    assert all(np.allclose(back[i], np.floor(np.array(v) * 8) / 8) for i, v, _ in rows)  # ten entries for ten vectors
