"""The pipeline's stages, one after the other: on the smallest tables, and against brute force on planted cases."""

import random
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from test_operators import BLANK, LOW, WORD, sentences, shingles
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use inside
MORE = ", key string, offset int, piece int, line int, keep boolean, row int, item_id string, label int, perplexity double"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    before = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= before and len(ids) > 0.5 * len(before)
        docs, before = kept, ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == before


def planted():
    """(texts by doc_id, labels, benchmark items): clean, junk, repeated lines, near copies, leaked items, odd ones."""
    rng = random.Random(21)
    both = sentences(51, 100, 900)
    words, rest = both[:60], both[60:]
    texts = {i: t for i, t in enumerate(words, 1)}
    junk = {i: " ".join("".join(rng.choices("#$%&0123456789XQZ", k=7)) for _ in range(60)) for i in range(201, 241)}
    items = {f"i{k}": " ".join(rest[k].split()[:40]) for k in range(3)} | {"short": " ".join(rest[5].split()[:6]), "none": None, "blank": " !"}
    texts |= junk
    texts[301] = rest[8] + "\n" + texts[3].split("\n")[0]  # a whole text as a later line
    texts[302] = " ".join(w if k % 40 else "changed" for k, w in enumerate(texts[5].split()))  # nearly the text 5
    texts[303] = texts[7]
    long = " ".join(rest[12:20]).split()  # the same words in other lines
    texts |= {n: "\n".join(" ".join(long[k : k + wide]) for k in range(0, len(long), wide)) for n, wide in ((311, 7), (312, 11), (313, 16))}
    texts[304] = rest[9] + " " + items["i1"]  # leaked
    texts[305] = rest[10] * 40 + " " + items["i2"]  # leaked, but much more is its own
    texts[306] = rest[11] + "\n\n" + rest[11] + "\nown words end this one"
    texts |= {307: None, 308: "", 309: " \n\t", 310: "word"}
    labels = [(i, 1, 0) for i in range(1, 51)] + [(i, 0, 0) for i in junk] + [(None, 1, 0), (999, 1, None)]
    return texts, labels, items


def lines_left(texts):
    """Each text without lines like an earlier one; a text left without any isn't there."""
    seen, out = [], {}
    for i in sorted(texts):
        lines, left = (texts[i] or "").split("\n"), []
        for line in lines:
            s = set(BLANK.findall(line.translate(LOW)))
            if not s or not any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                left.append(line)
            if s:
                seen.append(s)
        if len(left) == len(lines) or any(BLANK.search(x) for x in left):
            out[i] = texts[i] if len(left) == len(lines) else "\n".join(left)
    return out


def one_of_each(texts):
    """The smallest doc_id of each group linked by five-word shingles, and all texts without words."""
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: t for i, t in texts.items() if root[i] == i}


def clean(texts, items):
    """Texts with less than a twentieth of their words inside windows of 13 item words."""
    windows = set()
    for t in items.values():
        w = WORD.findall((t or "").translate(LOW))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    out = {}
    for i, t in texts.items():
        w, hit = WORD.findall((t or "").translate(LOW)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_run_against_brute_force(spark, tmp_path):
    texts, labels, items = planted()
    rows = [(i, t, "en", "s", len(t or ""), "k", 1, 2, 3, True, 4, "x", 5, 0.5) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA + MORE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, sizes = texts, []
    plain = {"line_dedup": lines_left, "ngram_jaccard_join": one_of_each, "benchmark_decontamination": lambda t: clean(t, items)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path)).collect()
        assert all(tuple(r)[2:] == ("en", "s", len(texts[r.doc_id] or ""), "k", 1, 2, 3, True, 4, "x", 5, 0.5) for r in got), name
        left = {r.doc_id: r.text for r in got}
        assert len(left) == len(got)
        if name in plain:
            assert left == plain[name](now), name
        else:  # the model has its own brute force in test_hard_cases
            assert all(left[i] == now[i] for i in left) and not left.keys() & set(range(201, 241))
            assert len(left.keys() & set(range(1, 61))) >= 54 and {307, 308, 309} <= left.keys()
        sizes.append(len(left))
        now, docs = left, spark.createDataFrame(got, SCHEMA + MORE)
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths, places = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert lengths == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in now.items()}
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
