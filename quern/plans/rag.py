"""The online path for a batch of questions: guard, diagnose, route, retrieve by route, and shape the answer.

Every question is a row; the branches are filters of one frame, and what a search leaves beside its
documents (the side channel) is one column of sections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import lexicon as X
from ..functions import text as T
from ..operators import bm25, fusion, routing, samples, vector, votes
from ..session import cut
from . import lexicons as L

NAME = "[一-鿿]{2}[汤散丸饮煎]"
NOTHING = "抱歉，知识库中没有检索到与这个问题相关的内容。"
OUTSIDE = "本系统仅收录经典相关知识，不涵盖此查询领域。"


@dataclass(frozen=True)
class Lexicons:
    """Word lists of the retrieval.  concepts are (name, brief, defining clauses, treating clauses, formulas,
    keywords); rules are (symptoms, concept); votes are (symptom, label)."""

    herbs: Sequence[str]
    out_of_scope: Sequence[str]
    concepts: Sequence[tuple]
    question_words: Sequence[str]
    symptoms: Sequence[str]
    colloquial: Sequence[tuple[str, str]]
    rules: Sequence[tuple[Sequence[str], str]]
    votes: Sequence[tuple[str, str]]
    soft: Sequence[str] = ()


#: The lists that the catalog's queries use.
LEXICONS = Lexicons(L.HERBS, (*L.OUT_OF_SCOPE, *L.OUTSIDE_HERE), L.CONCEPT_TABLE, L.QUESTION_WORDS, L.SYMPTOMS, L.COLLOQUIAL, L.RULES, L.SYMPTOM_VOTES, L.SOFT)


def formulas_of(clauses: DataFrame, herbs: Sequence[str], syndromes: Sequence[str]) -> DataFrame:
    """(name, clause_id, herbs, syndrome): every formula that a clause names, with the first clause that does
    and what that clause holds of herbs and syndromes."""
    c = clauses.select("clause_id", F.col("original_text").alias("t"))
    first = c.select("clause_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(NAME), F.lit(0)))).alias("name")).groupBy("name").agg(F.min("clause_id").alias("clause_id"))
    return first.join(c, "clause_id").select("name", "clause_id", X.found_terms(F.col("t"), herbs, False).alias("herbs"), T.first_word(F.col("t"), syndromes, None).alias("syndrome"))


def understood(questions: DataFrame, lex: Lexicons) -> DataFrame:
    """(query, question, status, route, kind and what each kind searches for): one row per question (id, question).

    A semantic question is out_of_scope, about a concept by name or by symptoms, or open."""
    q = F.col("question")
    names = routing.names_in(q, NAME)
    concept = X.concept(q, [c[0] for c in lex.concepts], lex.question_words)
    said = X.symptoms(q, lex.symptoms, lex.colloquial)
    df = questions.select(F.col("id").alias("query"), q, names.alias("names"), concept.alias("named"), said.alias("symptoms"))
    status = F.when(~G.question_ok(q), "invalid").otherwise(F.coalesce(G.input_guard(q), F.lit("ok")))
    df = df.withColumn("status", status).withColumn("route", routing.route(q, F.col("names"), lex.herbs))
    df = df.withColumn("by_symptoms", F.when(F.size("symptoms") > 0, X.concept_by_symptoms(F.col("symptoms"), lex.rules)))
    core = F.regexp_replace(routing.rewritten(q), "^[？?。.，,的]+|[？?。.，,的]+$", "")
    grown, formal = X.expand_concept(q, F.col("named"), [(c[0], c[5]) for c in lex.concepts]), X.expand(q, lex.colloquial)
    known = [c[0] for c in lex.concepts if c[2] or c[3]]
    semantic = F.when(q.rlike(T.one_of(lex.out_of_scope)), "out_of_scope").when(F.col("named").isin(*known), "concept").when(F.col("by_symptoms").isin(*known), "symptom").otherwise("open")
    return df.select(
        "query", "question", "status", "route", F.when(F.col("route") == "semantic", semantic).otherwise(F.col("route")).alias("kind"), routing.clause_number(q).cast("long").alias("clause"),
        F.try_element_at(routing.longest_first(F.col("names")), F.lit(1)).alias("formula"), routing.longest_first(F.array_distinct(F.regexp_extract_all("question", F.lit(T.one_of(lex.herbs)), F.lit(0)))).alias("herbs"),
        routing.entities(q, F.col("names")).alias("entities"), F.when(semantic == "concept", F.col("named")).when(semantic == "symptom", F.col("by_symptoms")).alias("concept"), "symptoms", core.alias("core"),
        routing.rewritten(q).alias("rewritten"), formal.alias("formal"), F.when(F.length(formal) > F.length(grown), formal).otherwise(grown).alias("longer"),
    )


def _ranked(df: DataFrame, *order) -> DataFrame:
    """(query, doc, rank) with each document at its first place."""
    one = df.groupBy("query", "doc").agg(F.min(F.struct(*order)).alias("o"))
    return one.select("query", "doc", F.row_number().over(W.partitionBy("query").orderBy("o", "doc")).alias("rank"))


def retrieved(q: DataFrame, clauses: DataFrame, formulas: DataFrame, lex: Lexicons, k: int = 5) -> DataFrame:
    """(query, doc, rank, kind): the k clauses that each understood question gets.

    clause: the clause itself, an unknown number being an open question.  formula: its source, then BM25,
    then vectors.  herb: the sources of all formulas that hold the herbs, then BM25.  comparison: such a
    list for either side, fused.  concept and symptom: the concept's clauses, then BM25 over its keywords
    or the formal words.  open: the sources of formulas of a syndrome whose name holds the question's
    core, then BM25 and vectors fused; where there is no such syndrome, these alone.  All searches of a
    kind of index are one ranking over (query/slot) rows, so each index is read once."""
    q = q.where("status = 'ok'")
    missing = q.where("kind = 'clause'").join(clauses.select(F.col("clause_id").alias("clause")), "clause", "left_anti").select("query", F.lit("open").alias("now"))
    q = cut(q.join(missing, "query", "left").withColumn("kind", F.coalesce("now", "kind")).drop("now"))
    words = [(c[0], " ".join(c[5])) for c in lex.concepts]
    keywords = F.lit(None).cast("string")
    for name, text in words:
        keywords = F.when(F.col("concept") == name, text).otherwise(keywords)
    kind = F.col("kind")
    slot = lambda at, when, text: F.when(when, F.struct(F.lit(at).alias("slot"), text.alias("text")))
    asks = [
        slot("f", kind == "formula", F.col("formula")), slot("h", kind == "herb", F.array_join("herbs", " ")), slot("c", kind == "concept", keywords), slot("s", kind == "symptom", F.col("formal")),
        slot("a", kind == "comparison", F.try_element_at("entities", F.lit(1))), slot("b", kind == "comparison", F.try_element_at("entities", F.lit(2))), slot("o", kind == "open", F.col("longer")), slot("g", kind == "open", F.col("formal")),
    ]
    near = [
        slot("f", kind == "formula", F.concat("formula", F.lit(" 组成 主之"))), slot("a", kind == "comparison", F.try_element_at("entities", F.lit(1))), slot("b", kind == "comparison", F.try_element_at("entities", F.lit(2))),
        slot("o", kind == "open", F.col("rewritten")),
    ]

    def searches(slots: list[Column]) -> DataFrame:
        s = q.select("query", F.explode(F.array_compact(F.array(*slots))).alias("x")).where("x.text is not null")
        return s.select(F.concat_ws("/", F.col("query").cast("string"), "x.slot").alias("sid"), "x.text")

    def back(found: DataFrame) -> DataFrame:
        at = F.split("query", "/")
        return cut(found.select(at[0].cast("long").alias("query"), at[1].alias("slot"), "doc", "rank"))

    words_, vectors_ = back(bm25.top_k(clauses, searches(asks), "clause_id", "original_text", "sid", "text", 2 * k)), back(vector.text_top_k(clauses, searches(near), "clause_id", "original_text", "sid", "text", 2 * k))
    by = lambda df, at, most=2 * k: df.where(f"slot = '{at}' and rank <= {most}").select("query", "doc", "rank")
    source = formulas.select("name", F.col("clause_id").alias("doc"))
    # what is known without a search
    exact = q.where("kind = 'clause'").select("query", F.col("clause").alias("doc"), F.lit(1).alias("rank"))
    named = q.where("kind = 'formula'").select("query", F.col("formula").alias("name")).join(source, "name").select("query", "doc", F.lit(1).alias("rank"))
    need = q.where("kind = 'herb'").select("query", F.explode("herbs").alias("herb"), F.size("herbs").alias("n"))
    holds = formulas.select("name", F.col("clause_id").alias("doc"), F.explode("herbs").alias("herb"))
    herbal = need.join(holds, "herb").groupBy("query", "name", "doc", "n").agg(F.count(F.lit(1)).alias("have")).where("have = n")
    herbal = _ranked(herbal, "name")
    lists = F.array(*[F.struct(F.lit(c[0]).alias("concept"), X.clause_list(*[F.array(*[F.lit(i) for i in ids]).cast("array<bigint>") for ids in c[2:4]]).alias("ids")) for c in lex.concepts])
    ids = F.try_element_at(F.filter(lists, lambda c: c["concept"] == F.col("concept")), F.lit(1))["ids"]
    concepts = q.where("kind in ('concept', 'symptom')").select("query", F.posexplode(ids).alias("rank", "doc")).join(clauses.select(F.col("clause_id").alias("doc")), "doc", "left_semi").select("query", "doc", "rank")
    # a syndrome whose name holds the core: all pieces of the names, so that it is an equi-join
    n = F.length("syndrome")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.substr("syndrome", i, j - i + 1))))
    syndromes = formulas.where("syndrome is not null").select("name", F.col("clause_id").alias("doc"), F.explode(F.array_distinct(F.concat(pieces, F.array(F.lit(""))))).alias("core"))
    fuzzy = cut(_ranked(q.where("kind = 'open'").select("query", "core").join(syndromes, "core"), "doc"))
    some = fuzzy.select("query").distinct()
    fused = fusion.reciprocal_rank([by(words_, "g"), by(vectors_, "o")], 60).join(some, "query", "left_semi")
    plain = fusion.reciprocal_rank([by(words_, "o"), by(vectors_, "o")], 60).join(some, "query", "left_anti")
    pick = lambda df: df.select("query", "doc", "rank")
    sides = []
    for i, at in enumerate("ab"):
        first = q.where("kind = 'comparison'").select("query", F.try_element_at("entities", F.lit(i + 1)).alias("name")).join(source, "name").select("query", "doc", F.lit(1).alias("rank"))
        sides.append(fusion.filled([first, by(words_, at, k), by(vectors_, at, k)], k).select("query", "doc", "rank"))
    compared = fusion.reciprocal_rank(sides, 60)
    stage0 = exact.unionByName(named).unionByName(pick(herbal)).unionByName(concepts).unionByName(pick(fuzzy)).unionByName(pick(compared))
    stage1 = by(words_, "f").unionByName(by(words_, "h", k)).unionByName(by(words_, "c")).unionByName(by(words_, "s")).unionByName(pick(fused)).unionByName(pick(plain))
    done = fusion.filled([stage0, stage1, by(vectors_, "f")], k)
    return done.select("query", "doc", "rank").join(q.select("query", "kind"), "query")


def side_channel(q: DataFrame, formulas: DataFrame, lex: Lexicons) -> DataFrame:
    """(query, context): what else is known to each question, as sections: the concept, the formula, the
    formulas that hold the herbs with their number, either side of a comparison with what they share and
    do not, compositions of a concept's formulas in their order (unknown ones skipped), and the note that
    a question lies outside."""
    text = lambda c: F.array_join(c, "、")
    brief = F.lit(None).cast("string")
    related = F.lit(None).cast("array<string>")
    for c in lex.concepts:
        brief = F.when(F.col("concept") == c[0], c[1]).otherwise(brief)
        related = F.when(F.col("concept") == c[0], F.array(*[F.lit(x) for x in c[4]]).cast("array<string>")).otherwise(related)
    q = q.where("status = 'ok'")
    info = formulas.select("name", F.struct("name", "herbs", "syndrome").alias("info"))
    wanted = q.select("query", "kind", F.posexplode(F.when(F.col("kind") == "formula", F.array("formula")).when(F.col("kind") == "comparison", F.col("entities")).otherwise(related)).alias("at", "name"))
    known = wanted.join(info, "name").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "info"))).alias("x")).select("query", F.transform("x", lambda x: x["info"]).alias("infos"))
    holds = formulas.select("name", F.explode("herbs").alias("herb"))
    need = q.where("kind = 'herb'").select("query", F.explode("herbs").alias("herb"), F.size("herbs").alias("n"))
    lists = need.join(holds, "herb").groupBy("query", "name", "n").agg(F.count(F.lit(1)).alias("have")).where("have = n").groupBy("query").agg(F.sort_array(F.collect_list("name")).alias("formulas"))
    full = q.join(known, "query", "left").join(lists, "query", "left").withColumn("brief", brief)
    one, two = F.try_element_at("infos", F.lit(1)), F.try_element_at("infos", F.lit(2))
    line = lambda i: F.concat(i["name"], F.lit("："), text(i["herbs"]), F.coalesce(F.concat(F.lit("，主治"), i["syndrome"]), F.lit("")))
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(name, F.lit("："), text(c)))
    both = F.concat_ws("\n", F.lit("【方剂对比】"), line(one), line(two), part(F.concat(one["name"], F.lit("独有")), F.array_except(one["herbs"], two["herbs"])), part(F.concat(two["name"], F.lit("独有")), F.array_except(two["herbs"], one["herbs"])), part(F.lit("共有药材"), F.array_intersect(one["herbs"], two["herbs"])))
    sections = F.concat_ws(
        "\n", F.concat(F.lit("【概念参考】"), F.col("brief")), F.when(F.col("kind") == "formula", F.concat(F.lit("【方剂信息】"), line(one))),
        F.when(F.size("formulas") > 0, F.concat(F.lit("【药材查询】含"), text(F.col("herbs")), F.lit("的方剂共"), F.size("formulas").cast("string"), F.lit("首："), text(F.col("formulas")))),
        F.when((F.col("kind") == "comparison") & (F.size("infos") == 2), both), F.when(F.col("concept").isNotNull() & (F.size("infos") > 0), F.concat(F.lit("【方剂组成】\n"), F.array_join(F.transform("infos", line), "\n"))),
        F.when(F.col("kind") == "out_of_scope", F.lit(f"【范围提示】{OUTSIDE}")),
    )
    return full.select("query", F.nullif(sections, F.lit("")).alias("context"))


def diagnosed(q: DataFrame, lex: Lexicons) -> DataFrame:
    """(query, verdict, label, tied, evidence): votes over the symptoms each question names."""
    spark = q.sparkSession
    table = X.lexicon(spark, list(lex.votes), "symptom string, label string")
    terms = list(dict.fromkeys(s for s, _ in lex.votes))
    said = q.where("status = 'ok'").select("query", X.votable(F.col("question"), lex.symptoms, lex.colloquial, terms).alias("said"))
    cases = said.select(F.col("query").alias("case"), F.explode("said").alias("symptom"))
    v = votes.vote(cases, table, tuple(lex.soft))
    return said.join(v, said["query"] == v["case"], "left").select("query", F.coalesce("status", F.lit("rejected")).alias("verdict"), "label", "tied", F.col("said").alias("evidence"))


def lectures_for(d: DataFrame, lectures: DataFrame, k: int = 3) -> DataFrame:
    """(query, lectures): the k lectures (id, book, text) nearest to a diagnosis and its evidence, doses masked,
    150 characters each; a question without any has no row."""
    asked = d.where("verdict = 'diagnosed'").select("query", F.concat_ws(" ", "label", F.array_join("evidence", " ")).alias("search"))
    hits = vector.text_top_k(lectures, asked, "id", "text", "query", "search", k).select("query", F.col("doc").alias("id"), "rank")
    quoted = F.concat(F.coalesce(F.concat(F.lit("（《"), F.col("book"), F.lit("》节选）")), F.lit("")), F.left(G.masked_doses(T.strip(F.col("text"))), F.lit(150)))
    full = hits.join(lectures.where("text is not null"), "id").select("query", F.struct("rank", quoted.alias("said")).alias("x"))
    return full.groupBy("query").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["said"]).alias("lectures"))


def answer_contexts(
    questions: DataFrame, clauses: DataFrame, lectures: DataFrame | None = None, lex: Lexicons = LEXICONS, syndromes: Sequence[str] = L.MERIDIANS, advice: Sequence[tuple[str, str]] = L.ADVICE, k: int = 5,
) -> DataFrame:
    """(query, status, route, kind, docs, context, answer, prompt): one row per question (id, question).

    Guarded questions are stopped before any search; where symptoms leave several directions open the
    answer is to ask; a diagnosis is answered in layers (direction with evidence and clauses, lectures or
    else the clauses themselves, advice); a question with neither documents nor context is declined;
    every other one gets a prompt of its documents and context.  Without lectures (id, book, text) the
    clauses stand in for them."""
    if lectures is None:
        lectures = questions.sparkSession.createDataFrame([], "id bigint, book string, text string")
    q = cut(understood(questions, lex))
    formulas = cut(formulas_of(clauses, lex.herbs, syndromes))
    c = clauses.select(F.col("clause_id").alias("doc"), F.col("original_text").alias("text"))
    d = cut(diagnosed(q, lex))
    stop = d.where("verdict = 'need_clarification'").select("query")
    found = retrieved(q.join(stop, "query", "left_anti"), clauses, formulas, lex, k).join(c, "doc").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "text"))).alias("r"))
    out = q.join(d, "query", "left").join(found, "query", "left").join(side_channel(q, formulas, lex), "query", "left").join(lectures_for(d, lectures), "query", "left")
    shown = F.coalesce(F.transform("r", lambda r: F.concat(F.lit("【第"), r["doc"].cast("string"), F.lit("条】"), r["text"])), F.array().cast("array<string>"))
    short = F.transform(F.slice("r", 1, 3), lambda r: F.concat(F.lit("【第"), r["doc"].cast("string"), F.lit("条】"), F.left(r["text"], F.lit(120))))
    cited = F.concat(F.lit("，与第"), F.array_join(F.transform(F.slice("r", 1, 3), lambda r: r["doc"].cast("string")), "、"), F.lit("条所述相符"))
    direction = F.concat(F.lit("【方向】"), F.col("label"), F.lit("。依据："), F.array_join("evidence", "、"), F.coalesce(cited, F.lit("")), F.lit("。"))
    lecture = F.concat(F.lit("【讲解】\n"), F.coalesce(F.array_join("lectures", "\n"), F.concat(F.lit("以下为经典原文参考：\n"), F.array_join(short, "\n")), F.lit("（暂无相关讲解素材。）")))
    advised = F.lit(None).cast("string")
    for label, said in advice:
        advised = F.when(F.col("label") == label, f"【建议】{said}").otherwise(advised)
    layered = F.concat_ws("\n\n", direction, lecture, advised, F.lit("【提醒】以上仅供参考。"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("verdict") == "need_clarification", "clarify").when(F.col("verdict") == "diagnosed", "diagnosed").when(F.col("r").isNull() & (F.col("kind") == "out_of_scope"), "out_of_scope").when(F.col("r").isNull() & F.col("context").isNull(), "nothing").otherwise("ok")
    out = out.withColumn("status", status)
    ask = F.concat(F.lit("能再详细说说您还有哪些不舒服吗？可能的方向："), F.replace("tied", F.lit(","), F.lit("、")))
    answer = F.when(F.col("status") == "clarify", ask).when(F.col("status") == "diagnosed", layered).when(F.col("status") == "out_of_scope", OUTSIDE).when(F.col("status") == "nothing", NOTHING)
    prompt = F.when(F.col("status") == "ok", samples.prompt(F.col("question"), shown, [F.col("context")]))
    return out.select("query", "status", "route", "kind", F.coalesce(F.array_join(F.transform("r", lambda r: r["doc"].cast("string")), ","), F.lit("")).alias("docs"), "context", answer.alias("answer"), prompt.alias("prompt"))
