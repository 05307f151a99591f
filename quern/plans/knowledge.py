"""Catalog: predicates combined, tags, concepts, symptoms, generated sample families and joint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import lexicon as X
from ..functions import phrases as P
from ..functions import text as T
from ..operators import bm25, graph, metrics, samples, vector
from ..operators import routing as R
from . import lexicons as L
from . import rag
from .common import lit, stripped, table, words
from .searches import LEXICONS

_EVAL = "eval_rigor_results_v1_pre_guard"
_LIFE, _OTHER = L.ORAL[:7], (*L.NOISE_WORDS, "目录")
_ORGANS = tuple(L.ORGAN_ASPECTS)
_SYSTEMS = ("{name}的组成是什么？", "{name}由哪些药物组成？", "请说出{name}的组成。")
_ASK_CLAUSE = ("第{n}条原文是什么？", "请说出第{n}条的内容。", "第{cn}条的原文是什么？", "请引用第{n}条原文。")
_SAY_CLAUSE = ("第{n}条原文：\n{text}", "根据原书第{n}条，原文为：\n{text}", "第{n}条：\n{text}")
_ASK_PLACE = ("“{head}…”是第几条？", "哪一条提到了“{head}”？", "“{head}…”这条原文出自第几条？")
_CONCEPT_ASKS = ("什么是{c}？", "{c}的定义是什么？", "{c}的主要表现是什么？", "请解释{c}的概念。", "{c}的证候特点是什么？")
SEED = 42


def pick(choices: list[Column], key: Column, salt: str) -> Column:
    """One of several texts, chosen by a seeded hash of the row's key: the same on every run."""
    n = F.conv(F.left(F.md5(F.concat_ws("-", key.cast("string"), F.lit(salt), F.lit(str(SEED)))), F.lit(6)), 16, 10).cast("int") % len(choices)
    return F.element_at(F.array(*choices), n + 1)


def filled(template: str, **values: Column) -> Column:
    """A template with {names} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        a, _, b = rest.partition("{")
        name, _, rest = b.partition("}")
        parts += [F.lit(a), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def clause_samples(clauses: DataFrame, first: int = 200, least: int = 10) -> DataFrame:
    """(key, category, instruction, output): each clause asked for by number, and clauses up to a number by their
    beginning; templates are picked by a seeded hash.  Whole texts are answered."""
    n, text = F.col("clause_id"), F.col("original_text")
    v = {"n": n, "cn": T.chinese_number(n), "text": text, "head": F.left(text, F.lit(15))}
    by_number = F.struct(F.lit("number").alias("category"), pick([filled(t, **v) for t in _ASK_CLAUSE], n, "q1").alias("instruction"), pick([filled(t, **v) for t in _SAY_CLAUSE], n, "a1").alias("output"))
    by_text = F.struct(F.lit("place").alias("category"), pick([filled(t, **v) for t in _ASK_PLACE], n, "q2").alias("instruction"), filled("这段内容出自第{n}条。原文完整内容为：\n{text}", **v).alias("output"))
    made = F.array_compact(F.array(by_number, F.when((n <= first) & (F.length(text) >= least), by_text)))
    return clauses.where("original_text is not null").select(F.concat(F.lit("c"), n.cast("string")).alias("key"), F.explode(made).alias("s")).select("key", "s.*")


def formula_samples(formulas: DataFrame, clauses: DataFrame) -> DataFrame:
    """(key, category, instruction, output): each formula's composition, indication, source (where its clause is
    known) and all together."""
    c = clauses.select("clause_id", F.col("original_text").alias("text"))
    f = formulas.join(c, "clause_id", "left").withColumn("list", F.array_join("herbs", "、"))
    v = {"name": F.col("name"), "list": F.col("list"), "s": F.coalesce("syndrome", F.lit("诸证")), "n": F.col("clause_id"), "text": F.col("text")}
    see = F.when(F.col("text").isNotNull(), filled("\n出处：第{n}条", **v)).otherwise("")
    s = lambda cat, q, a: F.struct(F.lit(cat).alias("category"), q.alias("instruction"), a.alias("output"))
    made = F.array_compact(F.array(
        s("composition", pick([filled(t, **v) for t in _SYSTEMS], F.col("name"), "q"), filled("{name}的组成为：{list}。", **v)), s("indication", filled("{name}主治什么证候？", **v), F.concat(filled("{name}主治{s}。", **v), see)),
        F.when(F.col("text").isNotNull(), s("source", filled("{name}出自哪一条？", **v), filled("{name}见于第{n}条。原文：\n{text}", **v))), s("all", filled("请详细介绍{name}的组成和主治。", **v), F.concat(filled("{name}\n组成：{list}\n主治：{s}", **v), see)),
    ))
    return f.select(F.concat(F.lit("f"), "name").alias("key"), F.explode(made).alias("s")).select("key", "s.*")


def concept_samples(spark, clauses: DataFrame, formulas: DataFrame, upto: int = 150) -> DataFrame:
    """(key, category, instruction, output): every concept under five questions with the clause that defines it,
    and for clauses up to a number when their first formula is used."""
    rows = [(c[0], c[1], c[2][0], q.replace("{c}", c[0])) for c in L.CONCEPT_TABLE for q in _CONCEPT_ASKS]
    d = spark.createDataFrame(rows, "concept string, brief string, clause_id long, instruction string").join(clauses.select("clause_id", "original_text"), "clause_id", "left")
    fixed = d.select(F.concat(F.lit("k"), "concept").alias("key"), F.lit("definition").alias("category"), "instruction", F.concat("brief", F.coalesce(F.concat(F.lit("\n\n相关条文：第"), F.col("clause_id").cast("string"), F.lit("条：\n"), "original_text"), F.lit(""))).alias("output"))
    name = F.try_element_at(F.regexp_extract_all("original_text", F.lit(rag.NAME), F.lit(0)), F.lit(1))
    use = clauses.where(f"clause_id <= {upto}").select("clause_id", "original_text", name.alias("name")).join(formulas.select("name"), "name", "left_semi")
    v = {"name": F.col("name"), "n": F.col("clause_id"), "text": F.col("original_text")}
    return fixed.unionByName(use.select(F.concat(F.lit("u"), F.col("clause_id").cast("string")).alias("key"), F.lit("use").alias("category"), filled("什么情况下应该使用{name}？", **v).alias("instruction"), filled("根据第{n}条，{name}的适用情况为：\n{text}", **v).alias("output")))


def all_samples(spark, clauses: DataFrame, seed: int = SEED) -> DataFrame:
    """All families together in a seeded order: order_key is what a sort by puts the shuffle in, so that no
    global numbering is needed."""
    f = rag.formulas_of(clauses, L.HERBS, L.MERIDIANS)
    both = clause_samples(clauses).unionByName(formula_samples(f, clauses)).unionByName(concept_samples(spark, clauses, f))
    return both.withColumn("order_key", F.md5(F.concat_ws("-", "key", "category", "instruction", F.lit(str(seed)))))


def _report(s, d):
    """One joint report of a run: questions, hit rate, keyword accuracy, latencies, judge."""
    e = table(s, d, _EVAL)
    first = e.groupBy("question").agg(F.min_by("retrieved_ids", "id").alias("wanted"))
    x = e.join(first, "question").withColumn("score", F.when(F.col("wall").isNotNull(), F.floor("wall") % 6).otherwise(-1))
    p = F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95)))
    r = x.agg(F.count(F.lit(1)).alias("questions"), F.round(F.coalesce(F.avg(metrics.hit(F.col("retrieved_ids"), F.col("wanted"))), F.lit(0.0)), 4).alias("hit_rate"), F.round(F.avg(metrics.keyword_share(F.col("question"), F.col("answer"))), 4).alias("keyword_accuracy"), F.min("latency").alias("fastest"), F.max("latency").alias("slowest"),
              p.alias("p"), F.round(F.avg(F.when(F.col("score") >= 0, F.col("score"))), 4).alias("judge_mean"), F.round(F.median(F.when(F.col("score") >= 0, F.col("score"))), 4).alias("judge_median"))
    return r.select("questions", "hit_rate", "keyword_accuracy", "fastest", "slowest", F.round(F.col("p")[0], 2).alias("p50"), F.round(F.col("p")[1], 2).alias("p95"), "judge_mean", "judge_median")


def _real_users(s, d):
    """Per category: a question without references counts as met; mean of valid scores; routes that fit."""
    e = table(s, d, _EVAL)
    first = e.groupBy("question").agg(F.min_by("retrieved_ids", "id").alias("wanted"))
    fits = F.when(F.col("category").contains("概念"), F.col("route_type") == "comparison").when(F.col("category").contains("口语"), F.col("route_type") == "semantic").otherwise(F.col("route_type").isin("clause", "semantic", "formula"))
    met = F.coalesce(metrics.hit(F.col("retrieved_ids"), F.col("wanted")), F.lit(1.0))
    score = F.when(F.col("wall").isNotNull(), F.floor("wall") % 6)
    return e.join(first, "question").groupBy("category").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(met), 6).alias("recall"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("judge"), F.round(F.avg(F.coalesce(fits, F.lit(False)).cast("double")), 6).alias("route_fits"))


def _stages(s, d):
    """Four stages side by side, the change from the first to the last, in percent where the base is positive."""
    e = table(s, d, _EVAL).where("category is not null").withColumn("stage", F.concat(F.lit("s"), (F.col("id") % 4).cast("string")))
    p = e.groupBy("category").pivot("stage", ["s0", "s1", "s2", "s3"]).agg(F.round(F.avg("latency"), 6))
    return p.select("*", F.round(F.coalesce("s3", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0)), 4).alias("delta"), F.round(F.when(F.col("s0") > 0, (F.coalesce("s3", F.lit(0.0)) - F.col("s0")) / F.col("s0") * 100).otherwise(0.0), 1).alias("improvement"))


def _reports_joined(s, d):
    """Two reports joined by category, every category of either; what one lacks is 0."""
    x = table(s, d, "sft_samples")
    one = x.where("split = 'train' and quality >= 0.5").groupBy(F.coalesce("book", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("a"))
    two = x.where("split = 'test' and quality < 0.5").groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("b"))
    return one.join(two, "category", "full_outer").select("category", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def _derivations(s, d):
    """What was derived from each order, by the same customer's next one, with the change of price as the edge's own."""
    o = table(s, d, "orders")
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    e = o.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).cast("string").alias("change"))
    return graph.derivations(e.where("dst is not null").withColumn("relation", F.lit("derived_from")))


def _judged(s, d):
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("分数："), F.floor("wall").cast("string"))).when(F.col("id") % 3 == 1, F.concat(F.floor("wall").cast("string"), F.lit("/5")))
    return table(s, d, _EVAL).select("id", G.judged(raw, F.col("error")).alias("j")).select("id", F.round("j.score", 6).alias("score"), "j.error")


def _composition(s, d):
    """Formulas a question names, in its order, with what they hold; unknown ones are skipped."""
    f = rag.formulas_of(table(s, d, "clauses"), L.HERBS, L.MERIDIANS)
    q = table(s, d, _EVAL).select("id", F.posexplode(R.names_in(F.col("question"), rag.NAME)).alias("pos", "name"))
    return q.join(f, "name").select("id", "pos", "name", "clause_id", F.array_join("herbs", "、").alias("herbs"), "syndrome")


def _organs(s, d):
    organ = F.regexp_extract("text", f"({'|'.join(_ORGANS)})", 1)
    out = F.lit(None).cast("string")
    for o, aspects in L.ORGAN_ASPECTS.items():
        out = F.when(F.col("organ") == o, P.organ_aspect(F.col("text"), o, aspects)).otherwise(out)
    return table(s, d, "documents").where("text is not null").withColumn("organ", F.nullif(organ, F.lit(""))).select("doc_id", "organ", out.alias("aspect"))


def _levels(s, d):
    """Instructions by a cascade of eight levels: clause, formula, syndrome, herb, book, topic, best term, key phrase."""
    x = table(s, d, "sft_samples").where("output is not null").select("sample_id", "output", "book", P.key_phrase(F.col("output"), (*L.HERBS, *L.ORGANS, *L.MERIDIANS, *L.SYMPTOMS), "汤散丸饮煎证病脉舌寒热虚实表里阴阳心肝脾肺肾胃胆", (L.HERBS[:30], L.ORGANS, L.SYMPTOMS)).alias("phrase"))
    t, head = F.col("output"), P.first_sentences(F.col("output"))
    number = F.nullif(F.regexp_extract(F.left(t, F.lit(20)), r"第(\d+)条", 1), F.lit(""))
    formula = F.nullif(F.regexp_extract(F.left(t, F.lit(400)), f"({rag.NAME})", 1), F.lit(""))
    levels = [
        (number, "请解释第{}条的原文含义。"), (formula, "请讲解{}的组成、方义和临床应用。"), (T.first_word(t, L.MERIDIANS, 400), "请讲解{}的证候特点和治疗原则。"), (T.first_word(head, L.HERBS, None), "请讲解{}的功效和应用。"),
        (F.when(F.col("book") == "脉案", T.first_word(t, ("脉", "舌"), 100)), "请讲解{}诊在这个病案里的意义。"), (T.first_word(head, L.ORGANS, None), "请讲解{}的生理和病理。"), (T.first_word(t, L.SYMPTOMS, None), "请讲解{}的辨治。"), (F.col("phrase"), "请讲解“{}”。"),
    ]
    aspect = F.when(T.first_aspect(t, L.ASPECTS) == "dose", "（侧重用量）").otherwise("")
    return x.select("sample_id", F.concat(P.instruction_by_level(t, levels, "请讲解本段内容。"), aspect).alias("instruction"))


def queries() -> dict:
    t = table
    return {
        "not_teaching": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", T.is_biography(F.col("text"), _LIFE, 3).alias("life"), T.is_not_teaching(F.col("text"), _LIFE[:4], _OTHER).alias("other")),
        "length_quality": lambda s, d: t(s, d, "sft_samples").select("sample_id", T.length_quality(F.col("output")).alias("quality")).where("quality is not null"),
        "extraction_verdict": lambda s, d: t(s, d, "pages").groupBy("pdf_name").agg(F.round(F.avg(F.length("text")), 6).alias("mean_chars")).withColumn("verdict", T.extraction_verdict(F.col("mean_chars"))),
        "organ_aspect": _organs,
        "paragraph_samples": lambda s, d: t(s, d, "chapters").where("content is not null").select("chapter_id", F.posexplode(T.paragraphs(F.col("content"))).alias("n", "output")).withColumn("instruction", T.instruction(F.col("output"), L.MERIDIANS, L.HERBS)),
        "instruction_levels": _levels,
        "concept_clauses": lambda s, d: t(s, d, _EVAL).select("id", X.concept(F.col("question"), [c[0] for c in L.CONCEPT_TABLE], L.QUESTION_WORDS).alias("concept")).join(
            s.createDataFrame([(c[0], list(c[2]), list(c[3])) for c in L.CONCEPT_TABLE], "concept string, d array<bigint>, t array<bigint>"), "concept").select("id", "concept", F.posexplode(X.clause_list(F.col("d"), F.col("t"))).alias("pos", "clause_id")),
        "concept_expand": lambda s, d: t(s, d, _EVAL).select("id", X.expand_concept(F.col("question"), X.concept(F.col("question"), [c[0] for c in L.CONCEPT_TABLE], L.QUESTION_WORDS), [(c[0], c[5]) for c in L.CONCEPT_TABLE]).alias("expanded")),
        "symptom_extract": lambda s, d: t(s, d, "clauses").select("clause_id", F.array_join(X.symptoms(F.col("original_text"), L.SYMPTOMS, L.COLLOQUIAL), ",").alias("symptoms"), F.array_join(X.votable(F.col("original_text"), L.SYMPTOMS, L.COLLOQUIAL, [a for a, _ in L.SYMPTOM_VOTES]), ",").alias("votable")),
        "composition_enrich": _composition,
        "clause_samples": lambda s, d: clause_samples(t(s, d, "clauses")),
        "formula_samples": lambda s, d: formula_samples(rag.formulas_of(t(s, d, "clauses"), L.HERBS, L.MERIDIANS), t(s, d, "clauses")),
        "concept_samples": lambda s, d: concept_samples(s, t(s, d, "clauses"), rag.formulas_of(t(s, d, "clauses"), L.HERBS, L.MERIDIANS)),
        "all_samples": lambda s, d: all_samples(s, t(s, d, "clauses")),
        "sample_counts": lambda s, d: all_samples(s, t(s, d, "clauses")).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
        "eval_report": _report, "real_user_report": _real_users, "stage_compare_four": _stages, "reports_joined": _reports_joined, "derivations": _derivations, "judge_batch": _judged,
    }


def _formulas_sql() -> str:
    found = f"list_filter({words(L.HERBS)}, lambda w: contains(original_text, w))"
    return (
        f"fn AS (SELECT name, min(clause_id) AS clause_id FROM (SELECT clause_id, unnest(regexp_extract_all(original_text, {lit(rag.NAME)})) AS name FROM clauses) GROUP BY 1), "
        f"fm AS (SELECT name, clause_id, {found} AS herbs, list_filter({words(L.MERIDIANS)}, lambda w: contains(original_text, w))[1] AS syndrome, original_text AS text FROM fn JOIN clauses USING (clause_id))"
    )


def _number_sql(n: str) -> str:
    at = lambda e: f"substr('零一二三四五六七八九', ({e})::INT + 1, 1)"
    h, t, u = f"({n} // 100)", f"({n} // 10 % 10)", f"({n} % 10)"
    unit = f"CASE WHEN {u} > 0 THEN {at(u)} ELSE '' END"
    return (
        f"CASE WHEN {n} < 0 OR {n} > 999 THEN {n}::VARCHAR WHEN {n} = 0 THEN '零' WHEN {n} >= 100 THEN {at(h)} || '百' || CASE WHEN {t} > 0 THEN {at(t)} || '十' WHEN {u} > 0 THEN '零' ELSE '' END || {unit} "
        f"ELSE CASE WHEN {t} = 1 THEN '十' WHEN {t} > 1 THEN {at(t)} || '十' ELSE '' END || {unit} END"
    )


def _pick_sql(choices: list[str], key: str, salt: str) -> str:
    return f"([{', '.join(choices)}])[(('0x' || left(md5({key} || '-{salt}-{SEED}'), 6))::BIGINT % {len(choices)})::INT + 1]"


def _fill_sql(template: str, **v: str) -> str:
    parts, rest = [], template
    while "{" in rest:
        a, _, b = rest.partition("{")
        name, _, rest = b.partition("}")
        parts += [lit(a), f"({v[name]})::VARCHAR"]
    return "(" + " || ".join([*parts, lit(rest)]) + ")"


def _clause_samples_sql() -> str:
    v = {"n": "clause_id", "cn": _number_sql("clause_id"), "text": "original_text", "head": "left(original_text, 15)"}
    fill = lambda ts: [_fill_sql(x, **v) for x in ts]
    return (
        f"cs AS (SELECT 'c' || clause_id AS key, 'number' AS category, {_pick_sql(fill(_ASK_CLAUSE), 'clause_id', 'q1')} AS instruction, {_pick_sql(fill(_SAY_CLAUSE), 'clause_id', 'a1')} AS output FROM clauses WHERE original_text IS NOT NULL "
        f"UNION ALL SELECT 'c' || clause_id, 'place', {_pick_sql(fill(_ASK_PLACE), 'clause_id', 'q2')}, {_fill_sql('这段内容出自第{n}条。原文完整内容为：' + chr(10) + '{text}', **v)} FROM clauses WHERE clause_id <= 200 AND length(original_text) >= 10)"
    )


def _formula_samples_sql() -> str:
    v = {"name": "name", "list": "array_to_string(herbs, '、')", "s": "coalesce(syndrome, '诸证')", "n": "clause_id", "text": "text"}
    f = lambda x: _fill_sql(x, **v)
    see, nl = f("\n出处：第{n}条"), chr(10)
    return (
        f"fs AS (SELECT 'f' || name AS key, 'composition' AS category, {_pick_sql([f(x) for x in _SYSTEMS], 'name', 'q')} AS instruction, {f('{name}的组成为：{list}。')} AS output FROM fm "
        f"UNION ALL SELECT 'f' || name, 'indication', {f('{name}主治什么证候？')}, {f('{name}主治{s}。')} || {see} FROM fm UNION ALL SELECT 'f' || name, 'source', {f('{name}出自哪一条？')}, {f('{name}见于第{n}条。原文：' + nl + '{text}')} FROM fm "
        f"UNION ALL SELECT 'f' || name, 'all', {f('请详细介绍{name}的组成和主治。')}, {f('{name}' + nl + '组成：{list}' + nl + '主治：{s}')} || {see} FROM fm)"
    )


def _concept_samples_sql() -> str:
    rows = ", ".join(f"({lit(c[0])}, {lit(c[1])}, {c[2][0]}, {lit(q.replace('{c}', c[0]))})" for c in L.CONCEPT_TABLE for q in _CONCEPT_ASKS)
    v = {"name": "name", "n": "clause_id", "text": "original_text"}
    return (
        f"ct(concept, brief, clause_id, instruction) AS (VALUES {rows}), un AS (SELECT clause_id, original_text, regexp_extract_all(original_text, {lit(rag.NAME)})[1] AS name FROM clauses WHERE clause_id <= 150), "
        "ks AS (SELECT 'k' || concept AS key, 'definition' AS category, instruction, brief || coalesce(chr(10) || chr(10) || '相关条文：第' || clause_id || '条：' || chr(10) || original_text, '') AS output FROM ct LEFT JOIN clauses USING (clause_id) "
        f"UNION ALL SELECT 'u' || clause_id, 'use', {_fill_sql('什么情况下应该使用{name}？', **v)}, {_fill_sql('根据第{n}条，{name}的适用情况为：' + chr(10) + '{text}', **v)} FROM un WHERE name IN (SELECT name FROM fm))"
    )


def _concept_sql(names) -> str:
    from .common import cut_words

    core = f"trim({cut_words('question', L.QUESTION_WORDS)})"
    same = [f"WHEN {core} = {lit(c)} OR question = {lit(c)} THEN {lit(c)}" for c in names]
    held = [f"WHEN contains(question, {lit(c)}) THEN {lit(c)}" for c in names]
    stem = [f"WHEN contains({core}, {lit(c.rstrip('证病'))}) THEN {lit(c)}" for c in names if len(c.rstrip("证病")) >= 2]
    return "CASE " + " ".join(same + held + stem) + " END"


def _symptoms_sql(c: str) -> str:
    formal = f"list_filter({words(L.SYMPTOMS)}, lambda w: contains({c}, w) AND NOT regexp_matches({c}, '[{X.NEGATIONS}]' || w))"
    said = "[" + ", ".join(f"CASE WHEN contains({c}, {lit(a)}) AND NOT regexp_matches({c}, {lit(f'[{X.NEGATIONS}]{a}')}) THEN {lit(b)} END" for a, b in L.COLLOQUIAL) + "]"
    both = f"list_concat({formal}, list_filter({said}, lambda w: w IS NOT NULL))"
    return f"list_filter({both}, lambda w, i: list_position({both}, w) = i)"


def _known_sql() -> str:
    """Understood questions as CTEs, the last one u (query, question, status, route, kind, clause, formula, herbs,
    entities, concept, symptoms, core, rewritten, formal, longer)."""
    from .common import cut_words
    from .texts import _route

    q = "question"
    name, herb = lit(rag.NAME), lit(T.one_of(L.HERBS))
    uniq = lambda x: f"list_filter({x}, lambda n, i: list_position({x}, n) = i)"
    longest = lambda x: f"list_transform(list_sort(list_transform({x}, lambda n, i: {{'l': -length(n), 'i': i, 'n': n}})), lambda x: x.n)"
    part = f"regexp_replace({cut_words('trim(p)', R.QUESTION)}, '^[？?，,的]+|[？?，,的]+$', '', 'g')"
    rules = "[" + ", ".join(f"{{'s': len(list_intersect(symptoms, {words(need)})) / {len(set(need))}.0::DOUBLE, 'o': {-i}, 'name': {lit(n)}}}" for i, (need, n) in enumerate(L.RULES)) + "]"
    rewritten = f"coalesce(nullif(regexp_replace({cut_words(q, R.QUESTION)}, '^[{R.PUNCTUATION}]+|[{R.PUNCTUATION}]+$', '', 'g'), ''), {q})"
    add = "lambda x, w: CASE WHEN contains(x, w) THEN x ELSE x || ' ' || w END"
    grown = "".join(f" WHEN {lit(c[0])} THEN list_reduce(list_concat([{q}], {words(c[5])}), {add})" for c in L.CONCEPT_TABLE)
    said = ", ".join(f"CASE WHEN contains({q}, {lit(a)}) THEN {lit(b)} END" for a, b in L.COLLOQUIAL)
    formal = f"list_reduce(list_concat([{q}], list_filter([{said}], lambda w: w IS NOT NULL)), {add})"
    outside = lit(T.one_of((*L.OUT_OF_SCOPE, *L.OUTSIDE_HERE)))
    return (
        f"rt AS ({_route()}), k0 AS (SELECT e.id AS query, {q}, rt.route, regexp_extract_all({q}, {name}) AS nr, regexp_extract_all({q}, {herb}) AS hr, list_filter(list_transform(regexp_split_to_array({q}, '和|与|跟|以及'), lambda p: {part}), lambda p: length(p) >= 2) AS parts, "
        f"{_symptoms_sql(q)} AS symptoms, {_concept_sql([c[0] for c in L.CONCEPT_TABLE])} AS named, {rewritten} AS rewritten, {formal} AS formal FROM {_EVAL} e JOIN rt USING (id)), "
        f"k1 AS (SELECT *, {uniq('nr')} AS names, {longest(uniq('hr'))} AS herbs, list_reverse_sort(list_filter({rules}, lambda x: x.s >= 0.5))[1].name AS ruled, CASE named{grown} ELSE {q} END AS grown FROM k0), "
        f"k2 AS (SELECT *, CASE WHEN regexp_matches({q}, {outside}) THEN 'out_of_scope' WHEN named IS NOT NULL THEN 'concept' WHEN len(symptoms) > 0 AND ruled IS NOT NULL THEN 'symptom' ELSE 'open' END AS sem FROM k1), "
        f"u AS (SELECT query, {q}, CASE WHEN NOT (length({q}) <= 500 AND trim({q}) <> '') THEN 'invalid' WHEN regexp_matches({q}, {lit(G.DOSE_QUESTION)}) THEN 'dose' WHEN regexp_matches({q}, {lit(G.EMERGENCY_QUESTION)}) THEN 'emergency' ELSE 'ok' END AS status, route, "
        f"CASE WHEN route = 'semantic' THEN sem ELSE route END AS kind, TRY_CAST(nullif(regexp_extract({q}, '第(\\d+)条', 1), '') AS BIGINT) AS clause, {longest('names')}[1] AS formula, herbs, CASE WHEN len(names) >= 2 THEN {longest('names')} ELSE parts END[1:2] AS entities, "
        f"CASE sem WHEN 'concept' THEN named WHEN 'symptom' THEN ruled END AS concept, symptoms, regexp_replace(rewritten, '^[？?。.，,的]+|[？?。.，,的]+$', '', 'g') AS core, rewritten, formal, CASE WHEN length(formal) > length(grown) THEN formal ELSE grown END AS longer FROM k2)"
    )


def _votes_of_questions_sql() -> str:
    from .searches import votes_ctes

    votable = list(dict.fromkeys(a for a, _ in L.SYMPTOM_VOTES))
    scan = sorted((a for a in votable if len(a) >= 4), key=len, reverse=True)
    tb = ", ".join(f"({i}, {lit(a)}, {lit(b)})" for i, (a, b) in enumerate(L.SYMPTOM_VOTES))
    both = f"list_concat(list_filter(symptoms, lambda w: list_contains({words(votable)}, w)), list_filter({words(scan)}, lambda w: contains(question, w)))"
    return (
        f"WITH {_known_sql()}, sd AS (SELECT query, list_filter(b, lambda w, i: list_position(b, w) = i) AS said FROM (SELECT query, {both} AS b FROM u WHERE status = 'ok')), tb(ord, symptom, label) AS (VALUES {tb}), c AS (SELECT DISTINCT query AS \"case\", unnest(said) AS symptom FROM sd), {votes_ctes('', L.SOFT)} "
        "SELECT query, coalesce(status, 'rejected') AS verdict, label, tied, array_to_string(said, ',') AS evidence FROM sd LEFT JOIN vt ON query = \"case\""
    )


def _retrieved_sql(k: int = 5) -> str:
    """The clauses each question gets, as in rag.retrieved."""
    fill = lambda stages: f"SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY pl, doc) AS rank FROM (SELECT query, doc, min(stage * 1000000 + rank) AS pl FROM ({' UNION ALL '.join(f'SELECT query, doc, {i} AS stage, rank FROM ({x})' for i, x in enumerate(stages))}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY pl, doc) <= {k}"
    fuse = lambda one, two: f"SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY sc DESC, f, doc) AS rank FROM (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS sc, min(l * 1000000 + rank) AS f FROM (SELECT query, doc, rank, 0 AS l FROM ({one}) UNION ALL SELECT query, doc, rank, 1 FROM ({two})) GROUP BY ALL)"
    ids = ", ".join(f"({lit(c[0])}, {lit(' '.join(c[5]))}, [{', '.join(map(str, dict.fromkeys([*c[2], *c[3]])))}]::BIGINT[])" for c in L.CONCEPT_TABLE)
    ask = [("f", "formula", "formula"), ("h", "herb", "array_to_string(herbs, ' ')"), ("c", "concept", "words"), ("s", "symptom", "formal"), ("a", "comparison", "entities[1]"), ("b", "comparison", "entities[2]"), ("o", "open", "longer"), ("g", "open", "formal")]
    near = [("f", "formula", "formula || ' 组成 主之'"), ("a", "comparison", "entities[1]"), ("b", "comparison", "entities[2]"), ("o", "open", "rewritten")]
    slots = lambda xs: " UNION ALL ".join(f"SELECT query || '/{at}' AS sid, {text} AS text FROM q WHERE kind = '{kind}' AND {text} IS NOT NULL" for at, kind, text in xs)
    back = lambda name: f"SELECT split_part(query, '/', 1)::BIGINT AS query, split_part(query, '/', 2) AS slot, doc, rank FROM {name}"
    by = lambda t, at, most=2 * k: f"SELECT query, doc, rank FROM {t} WHERE slot = '{at}' AND rank <= {most}"
    side = lambda i, at: fill([f"SELECT query, clause_id AS doc, 1 AS rank FROM q JOIN fm ON name = entities[{i}] WHERE kind = 'comparison'", by("w", at, k), by("v", at, k)])
    first = " UNION ALL ".join([
        "SELECT query, clause AS doc, 1 AS rank FROM q WHERE kind = 'clause'", "SELECT query, clause_id, 1 FROM q JOIN fm ON name = formula WHERE kind = 'formula'", "SELECT * FROM herbal", "SELECT query, doc, rank FROM (SELECT query, unnest(ids) AS doc, generate_subscripts(ids, 1) - 1 AS rank FROM q WHERE kind IN ('concept', 'symptom')) WHERE doc IN (SELECT clause_id FROM clauses)",
        "SELECT * FROM fuzzy", f"SELECT * FROM ({fuse(side(1, 'a'), side(2, 'b'))})",
    ])
    second = " UNION ALL ".join([by("w", "f"), by("w", "h", k), by("w", "c"), by("w", "s"), f"SELECT * FROM ({fuse(by('w', 'g'), by('v', 'o'))}) WHERE query IN (SELECT query FROM fuzzy)", f"SELECT * FROM ({fuse(by('w', 'o'), by('v', 'o'))}) WHERE query NOT IN (SELECT query FROM fuzzy)"])
    return (
        f"WITH {_known_sql()}, {_formulas_sql()}, cl(concept, words, ids) AS (VALUES {ids}), q AS (SELECT u.* REPLACE (CASE WHEN kind = 'clause' AND clause NOT IN (SELECT clause_id FROM clauses) THEN 'open' ELSE kind END AS kind), words, ids FROM u LEFT JOIN cl USING (concept) WHERE status = 'ok' AND query % 100 = 0), "
        f"asks AS ({slots(ask)}), looks AS ({slots(near)}), {bm25.sql('clauses', 'asks', 'clause_id', 'original_text', 'sid', 'text', 2 * k)}, {vector.text_sql('clauses', 'looks', 'clause_id', 'original_text', 'sid', 'text', 2 * k)}, w AS ({back('bm25')}), v AS ({back('near')}), "
        "hm AS (SELECT query, name, clause_id AS doc FROM q, fm WHERE kind = 'herb' AND len(list_filter(q.herbs, lambda h: list_contains(fm.herbs, h))) = len(q.herbs)), herbal AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY name, doc) AS rank FROM (SELECT query, doc, min(name) AS name FROM hm GROUP BY ALL)), "
        "fuzzy AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM (SELECT DISTINCT query, clause_id AS doc FROM q, fm WHERE kind = 'open' AND fm.syndrome IS NOT NULL AND contains(fm.syndrome, q.core))), "
        f"done AS ({fill([first, second, by('v', 'f')])}) SELECT query, doc, rank, kind FROM done JOIN q USING (query)"
    ).replace(" q AS (", " q AS MATERIALIZED (").replace(" w AS (", " w AS MATERIALIZED (").replace(" v AS (", " v AS MATERIALIZED (").replace(" fuzzy AS (", " fuzzy AS MATERIALIZED (").replace("fm AS (", "fm AS MATERIALIZED (")


def oracle_sql() -> dict[str, str]:
    nl = "chr(10)"
    ls = f"string_split(text, {nl})"
    count = lambda p: f"((length(text) - length(replace(text, {lit(p)}, ''))) // {len(p)})"
    contents = f"({count('·····')} > 3 OR {count('...')} > 3 OR regexp_matches(text, '\\.{{3,}}\\s*\\d+') OR regexp_matches(text, '[一二三四五六七八九十百千\\d]+[、.]\\s*[一-鿿]+\\s*\\.{{3,}}') OR (len({ls}) > 5 AND len(list_filter({ls}, lambda x: length(trim(x)) < 15)) > len({ls}) * 0.7::DOUBLE))"
    some = lambda ws, n: f"len(list_filter({words(ws)}, lambda w: contains(text, w))) >= {n}"
    early = f"len(list_filter({words(_OTHER)}, lambda w: instr(text, w) BETWEEN 1 AND 200)) > 0"
    names = [c[0] for c in L.CONCEPT_TABLE]
    aspects = "CASE organ " + " ".join(f"WHEN {lit(o)} THEN CASE " + " ".join(f"WHEN contains(left(text, 400), {lit(w)}) THEN {lit(x)}" for w, x in a) + f" ELSE {lit(o + '的主要生理功能和病理表现')} END" for o, a in L.ORGAN_ASPECTS.items()) + " END"
    lists = ", ".join(f"({lit(c[0])}, [{', '.join(map(str, dict.fromkeys([*c[2], *c[3]])))}]::BIGINT[])" for c in L.CONCEPT_TABLE)
    grown = ""
    for c in L.CONCEPT_TABLE:
        e = "question"
        for w in c[5]:
            e = f"(CASE WHEN contains({e}, {lit(w)}) THEN {e} ELSE {e} || {lit(' ' + w)} END)"
        grown += f" WHEN {lit(c[0])} THEN {e}"
    votable = [a for a in dict.fromkeys(a for a, _ in L.SYMPTOM_VOTES)]
    scan = sorted((a for a in votable if len(a) >= 4), key=len, reverse=True)
    kw = "CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(coalesce(answer, ''), w))) / len(k)::DOUBLE ELSE 1.0 END"
    seen = f"w AS (SELECT question, arg_min(retrieved_ids, id) AS wanted FROM {_EVAL} WHERE retrieved_ids IS NOT NULL GROUP BY 1), x AS (SELECT e.*, w.wanted, CASE WHEN len(w.wanted) > 0 THEN coalesce(list_has_any(retrieved_ids[1:5], w.wanted), false)::INT::DOUBLE END AS h, list_distinct(regexp_extract_all(e.question, '[一-鿿]{{2,}}')) AS k, floor(wall)::BIGINT % 6 AS score FROM {_EVAL} e LEFT JOIN w USING (question))".replace("{{", "{").replace("}}", "}")
    samples_ = f"WITH {_formulas_sql()}, {_clause_samples_sql()}, {_formula_samples_sql()}, {_concept_samples_sql()}, al AS (FROM cs UNION ALL FROM fs UNION ALL FROM ks)"
    return {
        "question_kinds": f"WITH {_known_sql()} SELECT query, status, kind, concept, array_to_string(entities, ',') AS entities, array_to_string(symptoms, ',') AS symptoms, core, longer FROM u",
        "question_votes": _votes_of_questions_sql(),
        "hybrid_retrieval": _retrieved_sql(),
        "not_teaching": f"SELECT doc_id, {some(_LIFE, 3)} AS life, ({some(_LIFE[:4], 2)} OR {contents} OR {early}) AS other FROM documents WHERE text IS NOT NULL",
        "length_quality": "SELECT sample_id, CASE WHEN length(output) < 50 THEN 'short' WHEN length(output) < 100 THEN 'medium' ELSE 'good' END AS quality FROM sft_samples WHERE length(output) >= 30",
        "extraction_verdict": "SELECT pdf_name, round(avg(length(text)), 6) AS mean_chars, CASE WHEN round(avg(length(text)), 6) > 500 THEN 'pass' WHEN round(avg(length(text)), 6) > 100 THEN 'warning' ELSE 'fail' END AS verdict FROM pages GROUP BY 1",
        "organ_aspect": f"WITH o AS (SELECT doc_id, text, nullif(regexp_extract(text, '({'|'.join(_ORGANS)})', 1), '') AS organ FROM documents WHERE text IS NOT NULL) SELECT doc_id, organ, {aspects} AS aspect FROM o",
        "concept_clauses": f"WITH c AS (SELECT id, {_concept_sql(names)} AS concept FROM {_EVAL}), l(concept, ids) AS (VALUES {lists}) SELECT id, concept, (generate_subscripts(ids, 1) - 1)::INT AS pos, unnest(ids) AS clause_id FROM c JOIN l USING (concept)",
        "concept_expand": f"WITH c AS (SELECT id, question, {_concept_sql(names)} AS concept FROM {_EVAL}) SELECT id, CASE concept{grown} ELSE question END AS expanded FROM c",
        "symptom_extract": f"WITH s AS (SELECT clause_id, original_text AS t, {_symptoms_sql('original_text')} AS s FROM clauses), v AS (SELECT clause_id, s, list_concat(list_filter(s, lambda w: list_contains({words(votable)}, w)), list_filter({words(scan)}, lambda w: contains(t, w))) AS v FROM s) SELECT clause_id, array_to_string(s, ',') AS symptoms, array_to_string(list_filter(v, lambda w, i: list_position(v, w) = i), ',') AS votable FROM v",
        "composition_enrich": f"WITH {_formulas_sql()}, r AS (SELECT id, regexp_extract_all(question, {lit(rag.NAME)}) AS r FROM {_EVAL}), n AS (SELECT id, list_filter(r, lambda x, i: list_position(r, x) = i) AS n FROM r), u AS (SELECT id, unnest(n) AS name, (generate_subscripts(n, 1) - 1)::INT AS pos FROM n) SELECT id, pos, name, clause_id, array_to_string(herbs, '、') AS herbs, syndrome FROM u JOIN fm USING (name)",
        "clause_samples": f"WITH {_clause_samples_sql()} FROM cs",
        "formula_samples": f"WITH {_formulas_sql()}, {_formula_samples_sql()} FROM fs",
        "concept_samples": f"WITH {_formulas_sql()}, {_concept_samples_sql()} FROM ks",
        "all_samples": samples_ + f" SELECT *, md5(key || '-' || category || '-' || instruction || '-{SEED}') AS order_key FROM al",
        "sample_counts": samples_ + " SELECT category, count(*) AS n FROM al GROUP BY 1",
        "chinese_numbers": f"SELECT clause_id, {_number_sql('clause_id')} AS name FROM clauses",
        "eval_report": f"WITH {seen} SELECT count(*) AS questions, round(coalesce(avg(h), 0), 4) AS hit_rate, round(avg({kw}), 4) AS keyword_accuracy, min(latency) AS fastest, max(latency) AS slowest, round(quantile_cont(latency, 0.5), 2) AS p50, round(quantile_cont(latency, 0.95), 2) AS p95, round(avg(score), 4) AS judge_mean, round(median(score), 4) AS judge_median FROM x",
        "real_user_report": f"WITH {seen} SELECT category, count(*) AS questions, round(avg(coalesce(h, 1.0)), 6)::DOUBLE AS recall, round(coalesce(avg(score), 0.0), 6) AS judge, round(avg(coalesce(CASE WHEN contains(category, '概念') THEN route_type = 'comparison' WHEN contains(category, '口语') THEN route_type = 'semantic' ELSE route_type IN ('clause', 'semantic', 'formula') END, false)::INT), 6) AS route_fits FROM x GROUP BY 1",
        "stage_compare_four": f"WITH a AS (SELECT category, {', '.join(f'round(avg(latency) FILTER (id % 4 = {i}), 6) AS s{i}' for i in range(4))} FROM {_EVAL} WHERE category IS NOT NULL GROUP BY 1) SELECT *, round(coalesce(s3, 0) - coalesce(s0, 0), 4) AS delta, CASE WHEN s0 > 0 THEN round((coalesce(s3, 0) - s0) / s0 * 100, 1) ELSE 0.0 END AS improvement FROM a",
        "reports_joined": "WITH a AS (SELECT coalesce(book, 'none') AS category, count(*) AS a FROM sft_samples WHERE split = 'train' AND quality >= 0.5 GROUP BY 1), b AS (SELECT coalesce(category, 'none') AS category, count(*) AS b FROM sft_samples WHERE split = 'test' AND quality < 0.5 GROUP BY 1) SELECT coalesce(a.category, b.category) AS category, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.category = b.category",
        "derivations": "WITH d AS (SELECT o_orderkey AS src, lag(o_orderkey) OVER w AS dst, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT dst::VARCHAR AS base, src::VARCHAR AS derived, c::VARCHAR AS change FROM d WHERE dst IS NOT NULL",
        "judge_batch": f"SELECT id, CASE WHEN error IS NOT NULL OR id % 3 = 2 OR wall IS NULL THEN -1.0 WHEN id % 3 = 0 THEN least(5.0, floor(wall)::DOUBLE) ELSE floor(wall)::DOUBLE END::DOUBLE AS score, CASE WHEN error IS NOT NULL THEN error WHEN id % 3 = 2 OR wall IS NULL THEN 'no reply' END AS error FROM {_EVAL}",
        "text_vectors": "WITH qq AS (SELECT id, question FROM " + _EVAL + " WHERE id % 100 = 0), " + vector.text_sql("clauses", "qq", "clause_id", "original_text", "id", "question", 5) + " SELECT query, doc, score, rank FROM near",
    }
