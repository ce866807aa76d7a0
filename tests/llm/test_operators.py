"""The operators against brute force on small fixtures, with nulls, empties, repeats and clashing columns."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ctrlspark.llm import ann, decontaminate, licenses, line_dedup, ngram_join, packing, quality, secret_scan, suffix_dedup, token_counts

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, offset int, piece int, set long, row int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts, first=1):
    rows = [(None if t == "NULL ID" else i, t, "en", "s", len(t or ""), "k", 0, 0, 0, 0) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60))) for _ in range(n)]


EDGE = [None, "", " \n\t ", "a", "NULL ID", "it's 've DON'T  two  spaces \n\n x", "é" * 300 + " 日本語 😀 １２３", "x" * 9000, " " * 4000 + "y", "<|endoftext|> a", "\n\n\r\n b"]


def test_token_counts(spark):
    texts = EDGE + sentences(1, 20)
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.count_tokens(table(spark, texts)).collect()}
    lib = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts, 1):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        r = got[None if t == "NULL ID" else i, len((t or "").encode())]
        assert (r.n_tokens, r.over_limit) == (n, n > 512), t
    assert token_counts.count_tokens(table(spark, [])).count() == 0


def test_token_counts_across_chunk_lanes():
    from ctrlspark.llm import pretokens

    text = ("z" * 5000 + " ab" * 3000 + "\n").encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    fst = token_counts.transducer(PATH)
    n = fst.changes(buf, pretokens.starts(buf, offs)).sum()
    assert n == len(Tokenizer.from_file(PATH).encode(text.decode(), add_special_tokens=False).ids)


def test_state_maps_compose(monkeypatch):
    """Runs of many chunks inside one pre-token: equal to the library, and mapped in few rounds however long they are."""
    from ctrlspark.llm import pretokens

    rng = random.Random(3)
    lib, fst = Tokenizer.from_file(PATH), token_counts.Transducer(PATH)
    monkeypatch.setattr(token_counts, "LANE", 64)
    rounds = []
    heads = fst.heads
    monkeypatch.setattr(fst, "heads", lambda *a: rounds.append(len(a[1])) or heads(*a))
    runs = ["z" * 30_000, "ab" * 9_000 + "aba" * 3_000, "".join(rng.choices("abcdefgh", k=20_000)), "=" * 9_999, "é" * 5_000, "the" * 4_001 + "internationalization" * 300, "x" * 64, "y" * 63, "w" * 65]
    texts = [f"{a} {b}" for a in runs for b in ("", "and then", runs[3])] + ["a", "", "q" * 128 + "\n" + "r" * 200]
    for t in texts:
        raw = t.encode()
        buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        rounds.clear()
        if raw:
            assert fst.changes(buf, pretokens.starts(buf, offs)).sum() == len(lib.encode(t, add_special_tokens=False).ids), t[:40]
            assert len(rounds) <= 70 and sum(rounds) < 300 + 4 * (len(raw) // 64), (t[:40], rounds)


def test_packing(spark):
    texts = EDGE + sentences(2, 60) + sentences(2, 3)
    rows = packing.pack(table(spark, texts), size=64, shard_pieces=40).collect()
    lib = Tokenizer.from_file(PATH)
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(texts, 1):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(docs[None if t == "NULL ID" else i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 64 for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    total = sum(r.length for r in rows)
    assert len(seqs) <= 1.15 * -(-total // 64)
    assert packing.pack(table(spark, [])).count() == 0


def test_sum_of_squares_rule():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 30, 300)
    bins, places = packing.sum_of_squares(lengths, 30)
    gaps, count = {}, np.zeros(31, int)
    for n, b in zip(lengths, bins):
        options = {}
        for g in [*range(n, 31)]:
            if g == 30 or count[g]:
                after = count.copy()
                if not (g == 30 and b not in gaps):
                    after[g] -= g < 30
                after[g - n] += g - n > 0
                options[g] = (after**2).sum()
        gap = gaps.get(b, 30)
        assert options[gap] == min(options.values())
        if gap < 30:
            count[gap] -= 1
        gaps[b] = gap - n
        if gaps[b]:
            count[gaps[b]] += 1


def test_secrets(spark):
    der = bytes.fromhex("301c020100") + b"".join(b"\x02\x01\x03" for _ in range(8)) + b"\x02\x00"
    der = b"\x30" + bytes([3 + 8 * 3]) + b"\x02\x01\x00" + b"\x02\x01\x03" * 8
    body = base64.b64encode(b"\x30\x81" + bytes([3 + 8 * 19]) + b"\x02\x01\x00" + (b"\x02\x11" + b"\x41" * 17) * 8).decode()
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
    claims = base64.urlsafe_b64encode(json.dumps({"sub": "1"}).encode()).decode().rstrip("=")
    assert secret_scan.is_der_key(der) and not secret_scan.is_der_key(der[:-1]) and not secret_scan.is_der_key(der + b"\0")
    field = lambda b: len(b).to_bytes(4) + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(field(b"ssh-ed25519") + field(b"k" * 32)) + field(b"x" * 64)
    assert secret_scan.is_ssh_key(ssh) and not secret_scan.is_ssh_key(ssh[:-1])
    kinds = lambda t: [k for k, _, _ in secret_scan.scan(t)]
    assert kinds(f"x {head}.{claims}.c2ln y") == ["signed_token"]
    assert kinds(f"x {head[:-3]}.{claims}.c2ln y") == []
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----") == ["pem_key"]
    assert kinds(f"key {body} end") == ["der_key"] and kinds(f"key {'M' + body[1:-8]} end") == []
    assert kinds(base64.b64encode(ssh).decode()) == ["ssh_key"]
    texts = [None, "", "Password: hunter2 token='abcdefgh1' ſecret=12345678", "AKIA" + "A" * 12 + " AKIAB", "f" * 31 + " " + "0" * 40, 'API_KEY = "a.b/c+d="', "NULL ID"]
    rows = {r.doc_id: r for r in secret_scan.digest(secret_scan.find_secrets(table(spark, texts))).collect()}
    assert [rows[i].n_assign for i in (1, 2, 3, 6)] == [0, 0, 1, 1] and rows[4].n_access == 1 and rows[5].n_hex == 1
    assert rows[3].base_sha256 == hashlib.sha256(b"assign:18:34").hexdigest()
    assert secret_scan.redact("a secret=abcdefgh b", secret_scan.scan("a secret=abcdefgh b")) == "a [secret] b"


def test_licenses(spark):
    texts = [None, "", "NULL ID", "The MIT License, again: mit  LICENSE.", "Licensed under the Apache License, Version 2.0.", "license apache version", "Licensed under CC BY-NC 4.0.", "x " * 3000 + "GNU General Public License"]
    rows = {r.doc_id: r for r in licenses.digest(licenses.scan_licenses(table(spark, texts))).collect()}
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word, rows[4].base_labels) == (2, 1, 4, "mit")
    assert rows[5].labels == "apache,apache-2.0" and rows[5].score == 1.0, rows[5]
    assert rows[6].labels == "" and rows[6].score == 0 and rows[6].n_words == 3
    assert rows[7].labels == "cc-by-nc-4.0" and rows[7].base_labels == ""
    assert rows[8].first_word == 3001 and rows[1].n_words == 0 and rows[1].first_word is None
    plan = licenses.scan_licenses(table(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text, n):
    w = BLANK.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 9, 10, 256), (5, 8, 10, 7)])
def test_jaccard_components(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    r = random.Random(n)
    texts = EDGE + sentences(3, 30)
    for t in sentences(4, 6):
        for _ in range(8):
            w = t.split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
            texts.append(" ".join(w))
    texts += sentences(3, 3)
    docs = table(spark, texts).filter("doc_id is not null")
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs, n, f"{num / den}").collect()}
    sets = {i: shingles(t, n) for i, t in enumerate(texts, 1) if t != "NULL ID"}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root(i)) for i in sets}
    kept = ngram_join.keep_one(table(spark, texts), n, f"{num / den}")
    assert kept.columns == table(spark, []).columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i in sets if root(i) == i}
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((900, 16))
    v[100:130] = v[0]
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None, 1.0] * 8), (2200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    recall = []
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        recall.append(len({i for i, _ in got[q]} & set(best.tolist())) / 5)
        assert all(abs(c - unit[i] @ unit[q]) < 1e-12 for i, c in got[q])
    assert np.mean(recall) >= 0.9 and [i for i, _ in got[0]] == [100, 101, 102, 103, 104]
    assert not {2000, 2050, 2100, 2150, 2200} & set(got) and ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [10**6, 300])
def test_decontamination(spark, block):
    items = [*sentences(6, 12), "only three words", "", None, "one", sentences(6, 1)[0], "nobody owns this"]
    bench = spark.createDataFrame([(None if t == "nobody owns this" else i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    texts = EDGE + sentences(7, 10) + [f"{a} {b.upper()}!" for a, b in zip(sentences(8, 8), items)] + ["Only, THREE; words", "one", "nobody owns this"]
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = WORD.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])] |= {str(i)} - {str(len(items) - 1)}
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.hits(table(spark, texts), bench, part_chars=block)).collect()}
    clean = {r.doc_id for r in decontaminate.decontaminate(table(spark, texts), bench, part_chars=block).collect()}
    assert block > 1000 or len(decontaminate.pattern_parts(bench, 13, block)) > 1
    for i, t in enumerate(texts, 1):
        if t == "NULL ID":
            continue
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        bad = bool(hit) and 20 * len(hit) >= len(w)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bad)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and (i in clean) != bad


@pytest.mark.parametrize(("batches", "hot", "piece"), [(1, 4096, 1 << 20), (4, 4096, 1 << 20), (8, 0, 1 << 20), (3, 0, 150)])
def test_suffix_dedup(spark, monkeypatch, batches, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 0)
    if piece < 1000:  # tasks see the module's own value, so pieces are tested here
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        buf = np.frombuffer(" ".join(sentences(9, 40)).encode(), np.uint8)
        offs = np.array([0, len(buf)])
        windows = lambda base, r: {(int(r.at[i]) + base, int(f) + base) for i in range(len(r.at)) for f in range(r.first[i], r.first[i] + r.count[i])}
        whole = windows(0, suffix_dedup.Runs(buf, offs, 100))
        parts = [windows(base, suffix_dedup.Runs(p, o, 100)) for base, p, o in suffix_dedup._pieces(buf, offs, 100)]
        assert len(parts) > 3 and set().union(*parts) == whole and sum(map(len, parts)) == len(whole) == len(buf) - 99
    s = sentences(9, 12)
    texts = [None, "", "short", s[0] + s[1] + s[2], s[3] + s[1] + s[2] + s[4], "ab" * 200, s[0] + s[1] + s[2], s[5] + "é" * 80 + s[6], s[7] + "é" * 80 + s[6], s[6] + s[6], "NULL ID", s[1] + s[2], *(f"{i} {s[8]} {s[9]} {s[10]} {i * 7}" for i in range(30)), "ab\0" * 90, "ab\0" * 60 + "ab"]
    got = {r.doc_id: r for r in suffix_dedup.digest(table(spark, texts), batches=batches).collect()}
    seen = set()
    for i, t in enumerate(texts, 1):
        if t == "NULL ID":
            continue
        raw, spans = (t or "").encode(), []
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + 100
                else:
                    spans.append([p, p + 100])
            seen.add(w)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        want = (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + raw[at:]).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert suffix_dedup.digest(table(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [100_000, 1])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_WORD", hot)
    r = random.Random(1)
    pool = sentences(10, 25, 200) + [" ".join(x) for x in zip(*[iter(sentences(13, 40, 900))] * 8)]
    texts = [None, "", " \n ", "NULL ID"]
    for _ in range(25):
        lines = []
        for _ in range(r.randint(1, 5)):
            w = r.choice(pool).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"w{r.randrange(50)}"
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    seen, gone = [], defaultdict(set)
    for i, t in enumerate(texts, 1):
        for k, line in enumerate((t or "").split("\n")):
            s = set(BLANK.findall(line.translate(LOW)))
            if not s or t == "NULL ID":
                continue
            if any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                gone[i].add(k)
            seen.append(s)
    rows = line_dedup.repeated_lines(table(spark, texts)).collect()
    got = defaultdict(set)
    for x in rows:
        if x.gone:
            got[x.doc_id].add(x.line)
    assert dict(got) == dict(gone) and len(gone) > 3
    cut = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in gone[i]]
        if gone[i] and not any(x.strip() for x in left):
            assert i not in cut
        elif t != "NULL ID":
            assert cut[i] == (t if t is None else "\n".join(left))
    assert line_dedup.repeated_lines(table(spark, [])).count() == 0


def test_quality(spark):
    good = sentences(11, 60)
    junk = [t.upper().replace(" ", "!! ") for t in sentences(12, 10)] + ["$$ ## %% " * 30]
    docs = table(spark, good + junk + [None, "", "NULL ID"])
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(1, 51)] + [(61, 0, 0, "x"), (51, 1, 1, "x"), (52, 1, None, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = {r.doc_id: r for r in quality.classify(docs, labels, 1.0).collect()}
    assert all(rows[i].keep for i in range(1, 51)) and not any(rows[i].keep for i in range(61, 72))
    assert rows[72].perplexity is None and rows[73].keep
    kept = quality.keep_good(docs, labels, 1.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == {i for i, r in rows.items() if r.keep} - {None}
    trusted = quality._trusted(docs, labels)
    tables = quality.train(trusted)
    joined = {r.doc_id: r.perplexity for r in quality.Scorer(tables, broadcast_rows=0).score(docs).collect()}
    for i, r in rows.items():
        assert (joined[i] is None) == (r.perplexity is None) and (joined[i] is None or abs(joined[i] - r.perplexity) < 1e-6 * r.perplexity)
    # probabilities after a seen context sum to one over all characters
    model = {k: {(r.lang, r.gram): r.p for r in t.collect()} for k, t in tables.items()}
    context = max(g >> 21 for lang, g in model["tri"])
    chars = [g for lang, g in model["uni"] if g >= 0]
    arrays = {k: (np.array(sorted(g for _, g in v)), np.array([v[x] for x in sorted(v)])) for k, v in model.items()}
    p = np.exp(quality._log_p(arrays, np.array([context << 21 | ch for ch in chars])))
    assert 0.9 < p.sum() <= 1.0 + 1e-9
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect()) and quality.classify(docs.limit(0), labels).count() == 0


def test_quality_threshold_from_labels(spark):
    """Labelled bad documents just beyond most trusted ones are rejected; without bad labels the quantile holds."""
    good = sentences(21, 200)
    low, toxic = ([" ".join(w if i % 3 else "".join(random.Random(f"{w}{seed}").choices("stuvwxyz", k=4)) for i, w in enumerate(t.split())) for t in sentences(21, 240)[200:]] for seed in (1, 2))
    # odd trusted documents fill the upper twentieth, beyond which a quantile of 0.995 alone would look
    odd = [" ".join(random.Random(i).choices(["qqzzkk", "jjwwvv", "mmnnpp", "rrttyy"], k=30)).upper() + str(i) * 9 for i in range(10)]
    texts = good + odd + low + toxic
    rows = [(i, 1, 0) for i in range(1, 211)] + [(i, 0, 0) for i in range(211, 251)] + [(i, 1, 1) for i in range(251, 291)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert sum(not got[i].keep for i in range(211, 291)) >= 72 and sum(got[i].keep for i in range(1, 201)) >= 190
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, r in got.items() if r.keep}
    scored = spark.createDataFrame([("a", "trusted", float(i)) for i in range(1, 101)] + [("a", "toxic", 95.5)] * 3 + [("b", "trusted", float(i)) for i in range(1, 1001)] + [("c", "low", 1.0)], "lang string, kind string, perplexity double")
    cuts = {r.lang: r for r in quality.best_cuts(scored).collect()}
    assert set(cuts) == {"a", "b"} and 95 <= cuts["a"].threshold < 95.5 and cuts["a"].toxic == 1.0 and cuts["a"].low is None
    assert 995 <= cuts["b"].threshold < 996 and cuts["b"].trusted == 0.005


@pytest.mark.parametrize(("n", "num", "den", "sizes"), [(3, 9, 10, range(9, 46)), (5, 8, 10, range(4, 46))])
def test_jaccard_links_at_the_threshold(spark, n, num, den, sizes):
    """Every size with words appended, or one inserted, down to exactly the threshold; each pair has words of its own."""
    texts = []
    for copy in range(3):
        for size in sizes:
            words = [f"w{copy}x{size}x{i}" for i in range(size + n - 1)]
            for more in range(1, size * den // num - size + 1):
                own = [f"{w}x{more}" for w in words]
                texts += [" ".join(own), " ".join(own + [f"y{copy}x{size}x{more}x{i}" for i in range(more)])]
            at = [f"{w}xi" for w in words]
            texts += [" ".join(at), " ".join(at[: size // 2 + n // 2] + [f"z{copy}x{size}"] + at[size // 2 + n // 2 :])]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(spark, texts), n, f"{num / den}").collect()}
    exact = 0
    for i in range(1, len(texts), 2):
        a, b = shingles(texts[i - 1], n), shingles(texts[i], n)
        linked = den * len(a & b) >= num * len(a | b)
        exact += den * len(a & b) == num * len(a | b)
        assert (got[i], got[i + 1]) == (i, i if linked else i + 1), (len(a), len(b))
    assert exact >= 12


@pytest.mark.parametrize(("rows", "cells"), [(5, 10**6), (10**6, 200)])
def test_jaccard_of_large_templates(spark, monkeypatch, rows, cells):
    """Near copies in many blocks, linked through a hub, through one another, over size classes or not at all; and copies of one text."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ngram_join, "BLOCK_CELLS", cells)
    monkeypatch.setattr(ngram_join, "HUB_BLOCKS", 2)
    r = random.Random(31)
    texts = []
    for base in range(3):
        words = [f"t{base}w{i}" for i in range(40)]
        for copy in range(60):
            w = words + [f"t{base}more{i}" for i in range(r.randint(0, 25))]
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"edit{base}x{copy}"
            texts.append(" ".join(w))
    texts += texts[:3] * 30
    r.shuffle(texts)
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(table(spark, texts), 3, "0.8").collect()}
    sets = {i: shingles(t, 3) for i, t in enumerate(texts, 1)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    assert got == label and len(set(label.values())) > 6


def test_hubs_spare_products(spark, monkeypatch):
    """Rows that a hub links are in no further product with one another."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 10)
    dealt = []
    product = ngram_join._product
    monkeypatch.setattr(ngram_join, "_product", lambda rows, share: dealt.append(rows.count()) or product(rows, share))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words + [f"own{copy}"]) for copy in range(400)]
    got = ngram_join.jaccard_components(table(spark, texts), 3, "0.8").collect()
    assert {x.component_id for x in got} == {1} and sum(dealt) < 1200


def test_joined_scores_of_hot_trigrams(spark, monkeypatch):
    """Scores by shuffle equal the model's with a trigram's documents split over many keys; none where there is no model."""
    monkeypatch.setattr(quality, "SALT_ROWS", 7)
    docs = table(spark, sentences(41, 60) + ["the same text"] * 40 + [None, "", " ", "ä中\U0001f600"])
    tables = quality.train(docs.limit(50).select("lang", "text"))
    want = {r.doc_id: r.perplexity for r in quality.Scorer(tables).score(docs).collect()}
    got = {r.doc_id: r.perplexity for r in quality.Scorer(tables, broadcast_rows=0).score(docs).collect()}
    assert set(got) == set(want) and sum(p is not None for p in got.values()) > 100
    assert all((got[i] is None) == (p is None) and (p is None or abs(got[i] - p) < 1e-9 * p) for i, p in want.items())
    other = docs.withColumn("lang", F.lit("none"))
    assert all(r.perplexity is None for r in quality.Scorer(tables, broadcast_rows=0).score(other).collect()) and quality.Scorer(tables, broadcast_rows=0).score(docs.limit(0)).count() == 0
