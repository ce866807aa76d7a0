"""Quality classifier: an interpolated modified Kneser-Ney model of character trigrams.

The model of a language is trained on its trusted documents.  Trigram counts are
summed in shards by trigram; continuation counts, context totals and discounts
come from them by group-bys, and the interpolated probabilities by joins of the
count tables on context and suffix.  Documents are scored by perplexity per
character; one over its language's threshold is rejected.

The threshold is chosen from labelled documents that the scoring model has not
seen: trusted texts are dealt into folds by hash, the counts of all other folds
make a fold's model, and of all perplexities that one is taken which parts
trusted documents best from those labelled low in quality or toxic.

Characters of a trigram are packed into one long, 21 bits each, so that context
and suffix are shifts and masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .pretokens import SPACE, classes
from .staging import staged

BEGIN = 2  # stands for the characters before a text
LOW42, LOW21 = (1 << 42) - 1, (1 << 21) - 1
#: the quantile of held-out trusted documents' perplexity beyond which a document is rejected in any case
QUANTILE = 0.995
#: folds of trusted texts, and steps of a perplexity's natural logarithm among which the threshold is chosen
FOLDS, STEPS = 5, 2000
KINDS = ("trusted", "low", "toxic")
#: rows of the probability tables that are broadcast; a larger model is joined by shuffle
BROADCAST_ROWS = 3_000_000
#: trusted ids that are broadcast; more are joined by shuffle
BROADCAST_IDS = 2_000_000
#: documents' counts of one trigram in a key of the join by shuffle, about
SALT_ROWS = 1_000_000


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of the texts with blanks collapsed, and each text's offset."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    edges = np.searchsorted(at, offs)
    space = classes()[cps] == SPACE
    before = np.empty(len(cps), bool)
    before[1:] = space[:-1]
    before[edges[:-1][edges[:-1] < len(cps)]] = True
    keep = ~(space & before)
    cps = np.where(space, 0x20, cps)[keep]
    edges = np.concatenate(([0], np.cumsum(keep)))[edges]
    one = np.concatenate(([BEGIN], cps[:-1]))
    two = np.concatenate(([BEGIN, BEGIN], cps[:-2]))[: len(cps)]
    first = edges[:-1][edges[:-1] < edges[1:]]
    one[first], two[first] = BEGIN, BEGIN
    second = first + 1
    two[second[second < len(cps)]] = BEGIN
    return two << 42 | one << 21 | cps, edges


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents whose every label row says quality 1 and toxic 0."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count("quality").alias("n"), F.count("toxic").alias("m"), F.count("*").alias("all")).filter("doc_id is not null and q = 1 and t = 0 and n = all and m = all").select("doc_id")


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return _of_ids(docs, staged(trusted_ids(labels), "trusted"))


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return named.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi" if ids.columns == ["doc_id"] else "inner")


def label_kinds(labels: DataFrame) -> DataFrame:
    """doc_id, kind of labelled documents: 'trusted'; 'low' (a label row says quality 0), 'toxic' (toxic 1) or both as two rows."""
    bad = labels.filter("doc_id is not null").select("doc_id", F.explode(F.expr("filter(array(if(quality = 0, 'low', null), if(toxic = 1, 'toxic', null)), x -> x is not null)")).alias("kind")).distinct()
    return trusted_ids(labels).withColumn("kind", F.lit("trusted")).unionByName(bad)


def _runs(names: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """(language, row numbers) of a chunk."""
    codes = names.dictionary_encode()
    which = codes.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(which == k)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over whole texts of ``docs(lang, text)``."""

    def count(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, at = _trigrams(buf, offs)
        for lang, docs_of in _runs(rows.column(0)):
            own = grams[textvec.ragged(at[docs_of], at[docs_of + 1] - at[docs_of])]
            gram, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return textvec.per_chunk(docs, count, "lang string, gram long, n long", ("lang", "text")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _with_discounts(counts: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """Counts with context total and discounted count; and each context's total and back-off weight.

    The three discounts of an order come from how many grams occur 1, 2, 3 and 4 times.
    """
    of = counts.groupBy("lang").agg(*(F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = "try_divide(n1, n1 + 2 * n2)"
    cut = of.selectExpr("lang", *(f"least({k}, greatest(0.05, coalesce({k} - {k + 1} * {y} * try_divide(n{k + 1}, n{k}), 0.5))) as d{k}" for k in (1, 2, 3)))
    cut = F.broadcast(cut)  # a row for each language
    taken = F.expr("case n when 1 then d1 when 2 then d2 else d3 end")
    cells = counts.join(cut, "lang").withColumn("context", F.expr(context)).withColumn("taken", taken)
    contexts = cells.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), (F.sum("taken") / F.sum("n")).alias("back"))
    return cells, contexts


def train(trusted: DataFrame) -> dict[str, DataFrame]:
    """Probability tables: tri(lang, gram, p), bi(lang, gram, p), uni(lang, gram, p), and the
    back-off weights of two-character (tri_back) and one-character contexts (bi_back)."""
    return tables(staged(trigram_counts(trusted), "c3"))


def tables(c3: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``train`` from trigram counts (lang, gram, n)."""
    c2 = staged(c3.groupBy("lang", F.expr(f"gram & {LOW42}L").alias("gram")).agg(F.count("*").alias("n")), "c2")
    c1 = staged(c2.groupBy("lang", F.expr(f"gram & {LOW21}L").alias("gram")).agg(F.count("*").alias("n")), "c1")
    # order 1 falls back to one share for each known character and one for all others
    total = c1.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    uni = c1.join(F.broadcast(total), "lang").selectExpr("lang", "gram", "(n + 0.0D) / (total + 1) + 1.0D / (total + 1) / (kinds + 1) as p")
    unseen = total.selectExpr("lang", "-1L as gram", "1.0D / (total + 1) / (kinds + 1) / 1000 as p")
    uni = staged(uni.union(unseen), "uni")
    cells, back2 = _with_discounts(c2, "shiftright(gram, 21)")
    bi = cells.withColumn("low", F.expr(f"gram & {LOW21}L")).join(back2, ["lang", "context"]).join(uni.selectExpr("lang", "gram as low", "p as p_low"), ["lang", "low"])
    bi = staged(bi.selectExpr("lang", "gram", "(n - taken) / total + back * p_low as p"), "bi")
    cells, back3 = _with_discounts(c3, "shiftright(gram, 21)")
    tri = cells.withColumn("low", F.expr(f"gram & {LOW42}L")).join(back3, ["lang", "context"]).join(bi.selectExpr("lang", "gram as low", "p as p_low"), ["lang", "low"])
    tri = staged(tri.selectExpr("lang", "gram", "(n - taken) / total + back * p_low as p"), "tri")
    named = lambda b: b.selectExpr("lang", "context as gram", "back as p")
    return {"tri": tri, "bi": bi, "uni": uni, "tri_back": staged(named(back3), "back3"), "bi_back": staged(named(back2), "back2")}


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, found) of keys in a sorted table."""
    names, values = table
    if not len(names):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return values[at], names[at] == keys


def _log_p(model: dict[str, tuple[np.ndarray, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """Natural log of each trigram's probability, backing off through seen contexts."""
    p, seen = _lookup(model["tri"], grams)
    rest = np.flatnonzero(~seen)
    if len(rest):
        some, back = np.unique(grams[rest], return_inverse=True)
        p2, seen2 = _lookup(model["bi"], some & LOW42)
        p1, seen1 = _lookup(model["uni"], some & LOW21)
        p1 = np.where(seen1, p1, _lookup(model["uni"], np.array([-1]))[0])
        weight2, known2 = _lookup(model["bi_back"], some >> 21 & LOW21)
        p2 = np.where(seen2, p2, np.where(known2, weight2, 1.0) * p1)
        weight3, known3 = _lookup(model["tri_back"], some >> 21)
        p[rest] = (np.where(known3, weight3, 1.0) * p2)[back]
    return np.log(p)


TABLES = ("tri", "bi", "uni", "tri_back", "bi_back")


def perplexity(arrays: Broadcast, langs: pa.Array, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per character, of each text of a chunk; nan for texts without characters or a language without model."""
    grams, at = _trigrams(buf, offs)
    out = np.full(len(offs) - 1, np.nan)
    none = (np.zeros(0, np.int64), np.zeros(0))
    for lang, docs in _runs(langs):
        model = arrays.value.get(lang)
        n = at[docs + 1] - at[docs]
        docs, n = docs[n > 0], n[n > 0]
        if model is not None and len(docs):
            log_p = _log_p({k: model.get(k, none) for k in TABLES}, grams[textvec.ragged(at[docs], n)])
            out[docs] = np.exp(-np.add.reduceat(log_p, np.cumsum(n) - n) / n)
    return out


class Scorer:
    """A trained model as sorted arrays by language, or its tables if they are too many to broadcast."""

    def __init__(self, tables: dict[str, DataFrame], broadcast_rows: int = BROADCAST_ROWS):
        self.tables = tables
        self.arrays: Broadcast | None = None
        if sum(t.count() for t in tables.values()) <= broadcast_rows:
            model: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
            for name, table in tables.items():
                got = table.select("lang", "gram", "p").toArrow()  # columns, not a Python object for each row
                names = got["lang"].combine_chunks().dictionary_encode()
                code, gram, p = names.indices.to_numpy(), got["gram"].to_numpy(), got["p"].to_numpy()
                for k, lang in enumerate(names.dictionary.to_pylist()):
                    on = np.flatnonzero(code == k)
                    on = on[np.argsort(gram[on])]
                    model.setdefault(lang, {})[name] = (gram[on], p[on])
                del got, names, code, gram, p
            self.arrays = tables["tri"].sparkSession.sparkContext.broadcast(model)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang, n_bytes, perplexity (null where there is none) of every row."""
        if self.arrays is None:
            return self._score_by_join(docs)
        kind, arrays = docs.schema["doc_id"].dataType.simpleString(), self.arrays

        def run(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
            got = perplexity(arrays, rows.column(1), buf, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(offs)), pa.array(got, mask=np.isnan(got))], ["doc_id", "lang", "n_bytes", "perplexity"])

        named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
        return textvec.per_chunk(named, run, f"doc_id {kind}, lang string, n_bytes long, perplexity double", ("doc_id", "lang", "text"))

    def _score_by_join(self, docs: DataFrame) -> DataFrame:
        """The same for a model of any size, by shuffle joins.

        The distinct trigrams of all documents meet the tables' shards: each is one row
        there, so that a frequent character keys no more rows than it has neighbours.  Then
        the documents' counts meet the probabilities; a trigram of all documents is
        split by salt, so that a key has about ``SALT_ROWS`` rows at most.
        """
        kind = docs.schema["doc_id"].dataType.simpleString()

        def count(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
            grams, at = _trigrams(buf, offs)
            pairs = [np.unique(grams[lo:hi], return_counts=True) for lo, hi in zip(at[:-1], at[1:])]
            gram, n = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
            cells = pa.StructArray.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])
            starts = pa.array(np.concatenate(([0], np.cumsum([len(p[0]) for p in pairs]))), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(offs)), pa.ListArray.from_arrays(starts, cells)], ["doc_id", "lang", "n_bytes", "cells"])

        named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
        rows = textvec.per_chunk(named, count, f"doc_id {kind}, lang string, n_bytes long, cells array<struct<gram: long, n: long>>", ("doc_id", "lang", "text"))
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "grams")
        salts = rows.count() // SALT_ROWS + 1
        cells = rows.select("row", "lang", F.explode("cells").alias("c")).select("row", "lang", "c.gram", "c.n")
        p = self._known(cells.select("lang", "gram").distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = cells.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
        total = salted.join(p, ["lang", "gram", "salt"]).groupBy("row").agg(F.exp(F.sum(F.col("log_p") * F.col("n")) / -F.sum("n")).alias("perplexity"))
        return rows.drop("cells").join(total, "row", "left").drop("row")

    def _known(self, grams: DataFrame) -> DataFrame:
        """lang, gram, log_p of distinct trigrams; none of a language without model."""
        t = {k: v.select("lang", F.col("gram").alias("key"), F.col("p").alias(k)) for k, v in self.tables.items()}
        keys = {"tri": "gram", "bi": f"gram & {LOW42}L", "uni": f"gram & {LOW21}L", "tri_back": "shiftright(gram, 21)", "bi_back": f"shiftright(gram, 21) & {LOW21}L"}
        for name, key in keys.items():
            grams = grams.withColumn("key", F.expr(key)).join(t[name], ["lang", "key"], "left").drop("key")
        other = F.broadcast(self.tables["uni"].filter("gram = -1").select("lang", F.col("p").alias("other")))  # a row for each language
        p = F.expr("coalesce(tri, coalesce(tri_back, 1) * coalesce(bi, coalesce(bi_back, 1) * coalesce(uni, other)))")
        return grams.join(other, "lang").select("lang", "gram", F.log(p).alias("log_p"))


def thresholds(scored_trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, threshold, quantile: that quantile of trusted documents' perplexities."""
    return scored_trusted.filter("perplexity is not null").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"), F.lit(float(quantile)).alias("quantile"))


def best_cuts(scored: DataFrame) -> DataFrame:
    """lang, threshold, quantile, and the shares of its ``kind`` rows beyond it, from ``scored(lang, kind, perplexity)``.

    The labels choose a quantile of the language's trusted perplexities, and the threshold is that quantile.  It has the largest excess of rejected bad documents (mean of the
    shares of the kinds 'low' and 'toxic' that there are) over rejected trusted
    ones, and is no higher than the trusted ones' ``QUANTILE``.  Perplexities are
    counted in steps of 1 / ``STEPS`` of their logarithm, so that windows run over
    those, and not over documents.
    """
    scored = scored.filter("perplexity is not null")
    counts = scored.groupBy("lang", F.floor(F.log("perplexity") * STEPS).alias("step")).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS))
    whole = Window.partitionBy("lang")
    over = whole.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    shares = counts.select("lang", "step", *((F.coalesce(F.sum(k).over(over), F.lit(0)) / F.nullif(F.sum(k).over(whole), F.lit(0))).alias(k) for k in KINDS))
    # nothing above the lowest step that keeps the quantile; of equal gains, or where nothing bad is labelled, the highest
    known = shares.filter("trusted is not null").withColumn("most", F.min(F.when(F.col("trusted") <= 1 - QUANTILE, F.col("step"))).over(whole))
    order = F.struct(F.coalesce(F.expr("coalesce((low + toxic) / 2, low, toxic) - trusted"), F.lit(0.0)).alias("gain"), "step", *KINDS)
    best = known.filter("step <= most").groupBy("lang").agg(F.max(order).alias("best"))
    return best.select("lang", F.exp((F.col("best.step") + 1) / F.lit(float(STEPS))).alias("threshold"), (1 - F.col("best.trusted")).alias("quantile"), *(f"best.{k}" for k in KINDS))


def held_out(docs: DataFrame, labels: DataFrame, per_fold: DataFrame) -> DataFrame:
    """lang, kind, perplexity of labelled documents by the model without their fold (``per_fold``: lang, fold, gram, n)."""
    others = per_fold.withColumn("out", F.explode(F.expr(f"filter(sequence(0, {FOLDS - 1}), x -> x <> fold)")))
    c3 = others.groupBy(F.expr("concat(out, ' ', lang)").alias("lang"), "gram").agg(F.sum("n").alias("n"))
    kinds = staged(label_kinds(labels).groupBy("doc_id").agg(F.collect_list("kind").alias("kinds")), "kinds")
    rows = _of_ids(docs, kinds).select(F.col("kinds").alias("doc_id"), F.concat(_fold(), F.lit(" "), "lang").alias("lang"), "text")
    scored = Scorer(tables(staged(c3, "c3"))).score(rows)
    return scored.select(F.expr("substring(lang, instr(lang, ' ') + 1)").alias("lang"), F.explode("doc_id").alias("kind"), "perplexity")


def _fold() -> Column:
    """Equal texts have equal folds."""
    return F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")


def _fit(docs: DataFrame, labels: DataFrame, quantile: float | None, broadcast_rows: int = BROADCAST_ROWS) -> tuple[Scorer, DataFrame]:
    """The model of all trusted documents, and each language's threshold (lang, threshold, quantile)."""
    trusted = _trusted(docs, labels)
    if quantile is not None:
        scorer = Scorer(train(trusted), broadcast_rows)
        return scorer, staged(thresholds(scorer.score(trusted), quantile), "limits")
    dealt = trusted.select(F.concat(_fold(), F.lit(" "), "lang").alias("lang"), "text")
    per_fold = staged(trigram_counts(dealt).selectExpr("substring(lang, instr(lang, ' ') + 1) as lang", "cast(substring_index(lang, ' ', 1) as int) as fold", "gram", "n"), "folds")
    limits = staged(best_cuts(held_out(docs, labels, per_fold)).select("lang", "threshold", "quantile"), "limits")
    return Scorer(tables(staged(per_fold.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "c3")), broadcast_rows), limits


def classify(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep, quantile for every row of ``docs(doc_id, text, lang)``.

    ``labels(doc_id, quality, toxic)`` names the trusted documents, and those low in
    quality or toxic.  The threshold is a quantile of trusted perplexities: the one that
    ``best_cuts`` chooses for a language from held-out ones, or a given ``quantile``, as the model that has seen them scores them.
    A null language is one of its own, ''.  A row is kept unless its perplexity is over its
    language's threshold: null, empty and blank texts have none and are kept, as are
    all rows of a language without trusted documents in two folds (or any, with a ``quantile``).  Null doc_ids are scored,
    but never trusted; repeated rows are scored each; an empty table gives none;
    other columns are ignored.
    """
    scorer, limits = _fit(docs, labels, quantile)
    return scorer.score(docs).join(F.broadcast(limits), "lang", "left").select("doc_id", "lang", "n_bytes", "perplexity", "threshold", (~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))).alias("keep"), "quantile")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects; all columns stay as they are.

    Null, empty and blank texts stay, as do null doc_ids unless their text is rejected;
    repeated rows stay or go together, but rows of one doc_id and text in different
    languages are judged each by its own; an empty table gives none.
    """
    scorer, table = _fit(docs, labels, quantile, broadcast_rows)
    limits = {r["lang"]: r["threshold"] for r in table.collect()}  # a row for each language
    if scorer.arrays is None:
        key = F.struct("doc_id", F.xxhash64("text").alias("key"), F.coalesce("lang", F.lit("")).alias("tongue"))
        bad = scorer.score(docs.select(key.alias("doc_id"), "lang", "text")).join(F.broadcast(table), "lang").filter("perplexity > threshold").select("doc_id.*").distinct().toDF("__id", "__key", "__lang")
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]) & (F.coalesce(docs["lang"], F.lit("")) == bad["__lang"]), "left_anti")

    arrays = scorer.arrays

    def keep(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs = rows.column(rows.schema.names.index("lang")).fill_null("")
        limit = np.array([limits.get(x, np.inf) for x in langs.to_pylist()])
        yield rows.filter(pa.array(~(perplexity(arrays, langs, buf, offs) > limit)))

    return textvec.per_chunk(docs, keep, docs.schema, tuple(docs.columns))
