"""Catalog: phrases, generated samples, closures, clarifying rounds and batch shapes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import phrases as P
from ..functions import text as T
from ..operators import graph, samples, votes
from . import lexicons as L
from .common import lit, table
from .searches import _cases, _edges, _votes, _votes_sql

_EVAL = "eval_rigor_results_v1_pre_guard"
_DOMAIN = "汤散丸饮煎证病脉舌寒热虚实表里阴阳心肝脾肺肾胃胆"
_TERMS = (*L.HERBS, *L.ORGANS, *L.MERIDIANS)
_DEFAULT = "请讲解本段内容。"
_ADVICE = (("buyer", "先看订单"), ("reader", "先看目录"), ("trouble", "先看日志"))
_CLOSING = "【提醒】以上仅供参考。"
_LEVELS = ("请讲解{}的用法。", "请讲解{}的病机。", "请讲解“{}”。")


def _derived(s, d):
    """Every order and the same customer's order before it."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst"))
    return o.where("dst is not null")


def _phrases(s, d):
    """The phrase is found once and bound, so the levels do not repeat its search."""
    x = table(s, d, "documents").where("text is not null").select("doc_id", "text", P.key_phrase(F.col("text"), _TERMS, _DOMAIN, (L.HERBS[:30], L.ORGANS, L.SYMPTOMS[:20])).alias("phrase"))
    levels = [(T.first_word(P.first_sentences(F.col("text")), L.HERBS, None), _LEVELS[0]), (T.first_word(P.first_sentences(F.col("text")), L.ORGANS, None), _LEVELS[1]), (F.col("phrase"), _LEVELS[2])]
    return x.select("doc_id", "phrase", P.instruction_by_level(F.col("text"), levels, _DEFAULT).alias("instruction"))


def _pair_samples(s, d):
    e = _edges(s, d)
    pairs = graph.pairs_sharing(e, "o", "p", 2)
    held = pairs.join(e.select("o", F.col("p").alias("a")), "a").join(e.select("o", F.col("p").alias("b")), ["o", "b"]).groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_set("o")), lambda x: x.cast("string")), "、").alias("orders"))
    return held.select("a", "b", F.format_string("同时含有%d和%d的有哪些？", "a", "b").alias("instruction"), F.concat(F.lit("有："), F.col("orders"), F.lit("。")).alias("output"))


def _compare_samples(s, d):
    pairs = table(s, d, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("a")).withColumn("b", F.col("a") + 1)
    c = graph.compare(_edges(s, d), pairs, "o", "p")
    part = lambda name, col: F.when(F.col(col) != "", F.concat(F.lit(name), F.col(col)))
    return c.select("a", "b", F.concat_ws("\n", part("共同：", "common"), part("前者独有：", "only_a"), part("后者独有：", "only_b")).alias("output"))


def _lengths(s, d):
    return table(s, d, "sft_samples").where("output is not null").select("sample_id", F.size(T.bigrams(F.concat("instruction", "output"))).alias("n"))


def _answered(s, d):
    """Cases that had to be told apart answer the question about their first tied label."""
    v = _votes(s, d).where("status = 'need_clarification'").select("case", F.element_at(F.split("tied", ","), 1).alias("label"))
    t = X.lexicon(s, L.VOTES, "symptom string, label string")
    first = t.groupBy("label").agg(F.max_by("symptom", "ord").alias("symptom"))
    return votes.round_trip(_cases(s, d), v.join(F.broadcast(first), "label").select("case", "symptom"), t, ("error",))


def _scenarios(s, d):
    """Share of cases whose status is what the number of their symptoms lets expect."""
    n = _cases(s, d).distinct().groupBy("case").agg(F.count(F.lit(1)).alias("symptoms"))
    v = _votes(s, d).join(n, "case").withColumn("expected", F.when(F.col("symptoms") == 1, "need_clarification").otherwise("diagnosed"))
    return v.groupBy("symptoms").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("status") == F.col("expected")).cast("double")), 6).alias("accuracy"))


def queries() -> dict:
    t = table
    return {
        "key_phrase": _phrases,
        "pair_samples": _pair_samples,
        "compare_samples": _compare_samples,
        "derivation_closure": lambda s, d: graph.closure(_derived(s, d)),
        "derived_from": lambda s, d: _derived(s, d).select(F.col("src").alias("derived"), F.col("dst").alias("base")),
        "vote_hints": lambda s, d: votes.hints(_votes(s, d), X.lexicon(s, L.VOTES, "symptom string, label string")),
        "vote_round_trip": _answered,
        "vote_answers": lambda s, d: votes.layered(_votes(s, d), _cases(s, d), s.createDataFrame(list(_ADVICE), "label string, advice string"), _CLOSING),
        "scenario_accuracy": _scenarios,
        "token_stats": lambda s, d: _lengths(s, d).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") >= 512).alias("at_limit")),
        "batch_padding": lambda s, d: _lengths(s, d).groupBy(F.floor(F.col("sample_id") / 32).alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("width"), (F.count(F.lit(1)) * F.max("n") - F.sum("n")).alias("padding")),
        "sampled_pages": lambda s, d: t(s, d, "pages").where(F.col("number").isin(15, 50, 100, 150, 200)).select("page_id", "pdf_name", "number", F.length("text").alias("chars")),
        "judge_prompt": lambda s, d: t(s, d, _EVAL).where("answer is not null").select("id", F.concat(F.lit("问题："), F.col("question"), F.lit("\n答案："), F.left("answer", F.lit(500))).alias("prompt")),
        "herb_formulas": lambda s, d: t(s, d, "clauses").select(F.explode(F.array_distinct(F.regexp_extract_all("original_text", F.lit(T.one_of(L.HERBS)), F.lit(0)))).alias("herb"), F.regexp_extract_all("original_text", F.lit("[一-鿿]{2}[汤散丸饮煎]"), F.lit(0)).alias("f")).select("herb", F.explode("f").alias("formula")).groupBy("herb").agg(F.countDistinct("formula").alias("formulas"), F.array_join(F.slice(F.array_sort(F.collect_set("formula")), 1, 5), ",").alias("first_five")),
        "chat_render": lambda s, d: t(s, d, _EVAL).select("id", samples.rendered(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))).alias("text")),
    }


def oracle_sql() -> dict[str, str]:
    e = "e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
    clean = lambda c: f"regexp_replace(lower({c}), '[^0-9a-z一-鿿]+', ' ', 'g')"
    n = "len(list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda p: NOT contains(p, ' ')))::INT"
    sizes = f"z AS (SELECT sample_id, {n} AS n FROM (SELECT sample_id, {clean('instruction || output')} AS t FROM sft_samples WHERE output IS NOT NULL))"
    der = "d AS (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders), dd AS (SELECT * FROM d WHERE dst IS NOT NULL)"
    text = "array_to_string(list_sort(%s), ',')"
    advice = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in _ADVICE)
    herb = lit(T.one_of(L.HERBS))
    return {
        "pair_samples": f"WITH {e}, g AS (SELECT x.p AS a, y.p AS b, x.o AS o FROM e x JOIN e y ON x.o = y.o AND x.p < y.p), h AS (SELECT a, b, array_to_string(list_sort(list(o)), '、') AS l FROM g GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, '同时含有' || a || '和' || b || '的有哪些？' AS instruction, '有：' || l || '。' AS output FROM h",
        "compare_samples": f"WITH {e}, s AS (SELECT o, list(p) AS s FROM e GROUP BY 1), c AS (SELECT x.o AS a, y.o AS b, {text % 'list_filter(x.s, lambda i: list_contains(y.s, i))'} AS c, {text % 'list_filter(x.s, lambda i: NOT list_contains(y.s, i))'} AS f, {text % 'list_filter(y.s, lambda i: NOT list_contains(x.s, i))'} AS g FROM orders JOIN s x ON x.o = o_orderkey JOIN s y ON y.o = o_orderkey + 1 WHERE o_orderkey % 100 = 0) SELECT a, b, concat_ws(chr(10), '共同：' || nullif(c, ''), '前者独有：' || nullif(f, ''), '后者独有：' || nullif(g, '')) AS output FROM c",
        "derivation_closure": f"WITH RECURSIVE {der}, r AS (SELECT src, dst, 1 AS hops FROM dd UNION ALL SELECT r.src, dd.dst, hops + 1 FROM r JOIN dd ON r.dst = dd.src) SELECT src, dst, min(hops)::INT AS hops FROM r GROUP BY ALL",
        "derived_from": f"WITH {der} SELECT src AS derived, dst AS base FROM dd",
        "vote_hints": _votes_sql() + f", u AS (SELECT \"case\", unnest(string_split(tied, ',')[1:2]) AS label, generate_subscripts(string_split(tied, ',')[1:2], 1) AS pos FROM vt WHERE status = 'need_clarification'), m AS (SELECT \"case\", symptom, min(pos * 1000 + ord) AS o FROM u JOIN tb USING (label) GROUP BY ALL), r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY \"case\" ORDER BY o, symptom) <= 6) SELECT \"case\", string_agg(symptom, '、' ORDER BY o, symptom) AS hints FROM r GROUP BY 1",
        "vote_answers": _votes_sql() + f", ev AS (SELECT \"case\", string_agg(symptom, '、' ORDER BY symptom) AS e FROM c GROUP BY 1), ad(label, advice) AS (VALUES {advice}) SELECT \"case\", concat_ws(chr(10) || chr(10), '【方向】' || label || '。依据：' || e, '【建议】' || advice, {lit(_CLOSING)}) AS answer FROM vt JOIN ev USING (\"case\") LEFT JOIN ad USING (label) WHERE status = 'diagnosed'",
        "vote_round_trip": _votes_sql("again AS (SELECT \"case\", (SELECT arg_max(symptom, ord) FROM tb WHERE tb.label = string_split(vt.tied, ',')[1]) AS symptom FROM vt WHERE status = 'need_clarification')") + " FROM vt2",
        "scenario_accuracy": _votes_sql() + ", n AS (SELECT \"case\", count(*) AS symptoms FROM c GROUP BY 1) SELECT symptoms, count(*) AS cases, round(avg((status = CASE WHEN symptoms = 1 THEN 'need_clarification' ELSE 'diagnosed' END)::INT), 6) AS accuracy FROM vt JOIN n USING (\"case\") GROUP BY 1",
        "token_stats": f"WITH {sizes} SELECT count(*) AS rows, round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (n >= 512) AS at_limit FROM z",
        "batch_padding": f"WITH {sizes} SELECT floor(sample_id / 32.0)::BIGINT AS batch, count(*) AS rows, max(n) AS width, (count(*) * max(n) - sum(n))::BIGINT AS padding FROM z GROUP BY 1",
        "sampled_pages": "SELECT page_id, pdf_name, number, length(text)::INT AS chars FROM pages WHERE number IN (15, 50, 100, 150, 200)",
        "judge_prompt": f"SELECT id, '问题：' || question || chr(10) || '答案：' || left(answer, 500) AS prompt FROM {_EVAL} WHERE answer IS NOT NULL",
        "herb_formulas": f"WITH x AS (SELECT unnest(list_distinct(regexp_extract_all(original_text, {herb}))) AS herb, regexp_extract_all(original_text, '[一-鿿]{{2}}[汤散丸饮煎]') AS f FROM clauses), y AS (SELECT DISTINCT herb, unnest(f) AS formula FROM x) SELECT herb, count(*) AS formulas, array_to_string(list_sort(list(formula))[1:5], ',') AS first_five FROM y GROUP BY 1",
        "chat_render": f"SELECT id, '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS text FROM {_EVAL}",
    }
