"""Coverage analytics over statements and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import phrase_sets
from ..sources.tables import staged

EXPECTED = ("NIST 800-53", "ISO 27001", "SOC 2", "NIST CSF 2.0")
STRENGTH_BONUS = {"must": 0.4, "shall": 0.4, "prohibited": 0.35, "should": 0.2, "may": 0.05}
#: fixed values: (phrases, issue, advice)
STALE = (
    (("iso 27001:2013", "iso/iec 27001:2013"), "cites ISO 27001:2013", "Update citation to ISO/IEC 27001:2022"),
    (("nist csf 1.1", "framework version 1.1"), "cites NIST CSF 1.1", "Update citation to NIST CSF 2.0"),
    (("800-53 rev 4", "800-53 revision 4"), "cites NIST SP 800-53 Rev. 4", "Update citation to Rev. 5"),
)


def coverage_matrix(hits: DataFrame) -> DataFrame:
    """framework, controls (distinct, sorted) of each document version."""
    return hits.groupBy("doc_id", "version_ord", "framework").agg(F.sort_array(F.collect_set("control_id")).alias("controls"))


def coverage_gaps(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Expected frameworks that no hit of a document version names."""
    wanted = docs.select("doc_id", "version_ord").distinct().withColumn("framework", F.explode(F.array(*map(F.lit, EXPECTED))))
    return wanted.join(hits.hint("merge"), ["doc_id", "version_ord", "framework"], "left_anti")


def blast_radius(hits: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """What a change of statements touches: framework, control, title, statement, source."""
    if statements is not None:
        hits = hits.join(statements.select("statement_id").distinct().hint("merge"), "statement_id", "left_semi")
    return hits.select("doc_id", "version_ord", "framework", "control_id", "title", "statement_id", "source")


def framework_rollup(hits: DataFrame) -> DataFrame:
    """Per framework over the corpus: counts of controls and statements, control ids."""
    return hits.groupBy("framework").agg(F.count_distinct("control_id").alias("control_count"), F.count_distinct("statement_id").alias("statement_count"), F.array_join(F.sort_array(F.collect_set("control_id")), ";").alias("control_ids"))


def control_rollup(hits: DataFrame, statements: DataFrame) -> DataFrame:
    """Per framework and control: first non-empty title, sources, best confidence, number of statements, and the statements in first-seen order.

    Order is that of document, version, statement and hit; a statement counts where it is first seen.  The
    lists (ids, strengths, kinds, confidences, texts) of a control come document by document, a row each, as one
    list of a whole corpus would not fit a row; in order of doc_id they are the whole list.
    """
    key = ["framework", "control_id"]
    place = F.struct("doc_id", "version_ord", "stmt_ord", "source", "hit_ord")
    about = hits.groupBy(*key).agg(
        F.coalesce(F.min_by("title", F.when(F.col("title") != "", place)), F.lit("")).alias("title"),
        F.array_join(F.sort_array(F.collect_set("source")), ";").alias("sources"),
        F.format_string("%.3f", F.max("confidence")).alias("max_confidence"),
        F.count_distinct("statement_id").alias("statement_count"),
    )
    first = hits.groupBy(*key, "doc_id", "statement_id").agg(F.min(F.struct("version_ord", "stmt_ord")).alias("at")).select(*key, "doc_id", "statement_id", "at", "at.version_ord")
    said = statements.select("doc_id", "version_ord", "statement_id", "text", "strength", "statement_kind", F.format_string("%.2f", "confidence").alias("sure"))
    row = F.struct("at", "statement_id", "strength", "statement_kind", "sure", "text")
    lists = first.join(said.hint("merge"), ["doc_id", "version_ord", "statement_id"]).groupBy(*key, "doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    names = {"statement_ids": ("statement_id", ";"), "strengths": ("strength", ";"), "statement_kinds": ("statement_kind", ";"), "classifier_confidences": ("sure", ";"), "obligations": ("text", " | ")}
    joined = lists.select(*key, "doc_id", *(F.array_join(F.col("rows")[c], by).alias(name) for name, (c, by) in names.items()))
    return joined.join(about, key).select(*about.columns, "doc_id", *names)


def stale_refs(statements: DataFrame) -> DataFrame:
    """Citations of outdated catalog versions: one row for each statement and rule."""
    low = F.lower("text")
    found = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.struct(F.lit(issue).alias("issue"), F.lit(advice).alias("recommendation"))) for words, issue, advice in STALE]
    rows = statements.select("doc_id", "version_ord", "statement_id", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("doc_id", "version_ord", "statement_id", "f.issue", "f.recommendation")


def evidence_packet(statements: DataFrame, hits: DataFrame, control_id: str, exact: bool = False) -> DataFrame:
    """Statements that support a control: with a hit on it, or citing it; related hits are counted, and ``mappings`` lists them (else the statement's first three).

    Ids match by substring, so AC-2 finds AC-20; ``exact`` compares whole ids.
    """
    want = control_id.upper().replace(" ", "")
    own = F.upper(F.regexp_replace("control_id", " ", ""))
    meets = own == want if exact else F.contains(own, F.lit(want))
    nth = F.row_number().over(Window.partitionBy("doc_id", "version_ord", "statement_id").orderBy("source", "hit_ord", "framework", "control_id"))
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("nth", F.concat_ws(":", "framework", "control_id").alias("c"))))), lambda x: x["c"]), ", ")
    related = hits.withColumns({"nth": nth, "meets": meets}).groupBy("doc_id", "version_ord", "statement_id").agg(F.nullif(F.count(F.when(F.col("meets"), 1)), F.lit(0)).alias("related"), listed(F.col("meets")).alias("own"), listed(F.col("nth") <= 3).alias("first"))
    cites = F.array_contains("framework_ids", want) if exact else F.contains(F.array_join("framework_ids", " "), F.lit(want))
    joined = statements.join(related.hint("merge"), ["doc_id", "version_ord", "statement_id"], "left").filter(F.col("related").isNotNull() | cites)
    return joined.select("doc_id", "version_ord", "statement_id", "text", "strength", F.coalesce("related", F.lit(0)).cast("long").alias("related"), F.coalesce(F.nullif("own", F.lit("")), "first", F.lit("")).alias("mappings"))


def control_graph(statements: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, label; edges: src, dst, kind) of documents, statements and controls.

    A node is one row: of several that share an id the last one stays, in order of
    document, version, statement and hit.
    """
    doc = F.concat(F.lit("doc:"), F.col("doc_id"))
    control = F.concat_ws(":", F.lit("control"), "framework", "control_id")
    order = lambda *more: F.struct("doc_id", "version_ord", "stmt_ord", *more).alias("place")
    none = [F.lit("").alias("source"), F.lit(0).cast("long").alias("hit_ord")]
    nodes = [
        statements.select(doc.alias("id"), F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("label"), order(*none)),
        statements.select(F.col("statement_id").alias("id"), F.lit("statement").alias("kind"), F.substring("text", 1, 80).alias("label"), order(*none)),
        hits.select(control.alias("id"), F.lit("control").alias("kind"), F.trim(F.concat_ws(" ", "control_id", "title")).alias("label"), order("source", "hit_ord")),
    ]
    edges = [statements.select(doc.alias("src"), F.col("statement_id").alias("dst"), F.lit("contains").alias("kind")), hits.select(F.col("statement_id").alias("src"), control.alias("dst"), F.col("relationship").alias("kind"))]
    last = nodes[0].union(nodes[1]).union(nodes[2]).groupBy("id", "kind").agg(F.max_by("label", "place").alias("label"))
    return last, edges[0].union(edges[1]).distinct()


#: words of all questions that one automaton looks for; more take further ones
VOCABULARY = 100_000
#: statements of each word that set a question's first bound
SEEDS = 32
#: statements of one key of a join; longer lists are split
BLOCK = 50_000


def questionnaire_topk(questions: DataFrame, statements: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best statements for each question(question_id, text): question_id, rank, statement_id, score.

    A question's words of more than two letters count if they stand anywhere in a
    statement's text, domains, headings, controls or titles; strength and the
    number of hits add to the score.  Questions of equal text are answered once.

    The words' statement lists form an inverted index.  Statements with the same words
    and the same additions differ in their order only, so ``k`` of each such
    class are kept.  A question is first held against ``SEEDS`` promising statements of
    each of its words; the ``k``-th best of them is a bound.  A statement that reaches it must have
    so many of the question's words that it has one of the rarest few; only the lists of those are read,
    and lists that most questions and statements share drop out.  The result is exact: a statement
    outside these lists scores less than the bound.  A null or blank question gets no row.
    """
    asked = questions.select("question_id", "text")
    key = ["doc_id", "version_ord", "statement_id"]
    place = ["doc_id", "version_ord", "stmt_ord", "statement_id"]
    names = hits.groupBy(*key).agg(F.concat_ws(" ", F.sort_array(F.collect_set(F.lower(F.concat_ws(" ", "control_id", "title"))))).alias("names"), F.count("*").alias("n"))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in STRENGTH_BONUS.items() for x in kv])[F.col("strength")], F.lit(0.0))
    s = statements.join(names.hint("merge"), key, "left").select(*place, F.lower(F.concat_ws(" ", "text", F.array_join("keywords", " "), F.array_join("heading_path", " "), "names")).alias("hay"), (bonus + F.least(F.lit(0.5), 0.05 * F.coalesce("n", F.lit(0)))).alias("extra"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    q = asked.select("text").distinct().select("text", F.explode(words).alias("word"))
    met = phrase_sets(s, "hay", q, "word", "met", VOCABULARY).filter(F.size("met") > 0).drop("hay").withColumn("met", F.array_sort("met"))
    nth = F.row_number().over(Window.partitionBy("met", "extra").orderBy(*place))
    index = staged(met.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth"), "question_index")

    lists = index.select("*", F.explode("met").alias("word"))
    sizes = lists.groupBy("word").agg(F.count("*").alias("n"), F.max("extra").alias("most"))
    met_by = q.join(sizes, "word").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"), F.max("most").alias("most"))
    q = staged(met_by.select("text", F.col("w.word").alias("words"), F.col("w.n").alias("sizes"), "most"), "questions")
    score = F.size(F.array_intersect("words", "met")) + F.col("extra")

    promising = F.row_number().over(Window.partitionBy("word").orderBy(F.size("met").desc(), F.desc("extra"), *place))
    seeds = lists.withColumn("nth", promising).filter(F.col("nth") <= SEEDS)
    seen = q.select("text", "words", F.explode("words").alias("word")).join(seeds, "word").groupBy("text", *place).agg(F.max(score).alias("score"))
    kth = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score")))
    bound = seen.withColumn("nth", kth).filter(F.col("nth") == k).select("text", F.col("score").alias("bound"))
    # words a statement may lack and yet stay below the bound; scores equal in nine places are ties
    spare = F.greatest(F.ceil(F.col("bound") - 1e-6 - F.col("most")) - 1, F.lit(0))
    needed = F.least(F.size("words"), F.size("words") - F.coalesce(spare, F.lit(0))).cast("int")
    parts = lambda n: (1 + F.floor(n / BLOCK)).cast("int")
    rare = q.join(bound, "text", "left").select("text", "words", F.explode(F.slice(F.arrays_zip("words", "sizes"), F.lit(1), needed)).alias("x"))
    wanted = rare.select("text", "words", F.col("x.words").alias("word"), F.explode(F.sequence(F.lit(0), parts(F.col("x.sizes")) - 1)).alias("part"))
    read = lists.join(sizes.select("word", "n"), "word").withColumn("part", F.pmod(F.xxhash64(*place), parts(F.col("n"))).cast("int"))
    # a statement counts where its rarest word of the question is
    scored = wanted.join(read, ["word", "part"]).filter(F.array_intersect("words", "met")[0] == F.col("word")).select("text", *place, score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.round("score", 9).desc(), "doc_id", "version_ord", "stmt_ord"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("text", F.col("rank").cast("long").alias("rank"), "statement_id", F.round("score", 2).alias("score"))
    return asked.join(best, "text").drop("text")
