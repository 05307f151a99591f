"""Guards, phrases, retrieval by every kind of question, stores and graphs, against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import guards as G
from quern.functions import lexicon as X
from quern.functions import phrases as P
from quern.functions import text as T
from quern.operators import graph, vector
from quern.plans import rag
from quern.sources import files

LEX = rag.Lexicons(
    ("桂枝", "麻黄", "杏仁", "甘草"), ("高血压", "电影"), (("少阴病", "少阴病主虚寒。", (3,), (2, 3), ("四逆汤",), ("脉微细",)), ("太阳病", "太阳病主表。", (1,), (), (), ("脉浮",))), ("什么是", "？", "是什么"),
    ("汗出", "恶寒", "头痛", "口苦"), (("怕冷", "恶寒"), ("出汗", "汗出")), ((("恶寒", "头痛"), "太阳病"),), (("恶寒", "太阳伤寒"), ("头痛", "太阳伤寒"), ("汗出", "太阳中风"), ("口苦", "少阳")), (),
)
CLAUSES = [(1, "太阳之为病，脉浮，头项强痛而恶寒。"), (2, "少阴病，四逆汤主之，甘草炙。"), (3, "少阴之为病，脉微细，但欲寐也。"), (12, "太阳中风，桂枝汤主之，桂枝甘草同煎。"), (35, "太阳病，麻黄汤主之，麻黄桂枝杏仁甘草。"), (99, "三阳合病，腹满身重。")]
LECTURES = [(7, "讲录", "太阳伤寒恶寒头痛，麻黄三两。以水九升。"), (8, None, "少阴只是想睡。"), (9, "夜课", None)]


def ask(spark, *questions):
    q = spark.createDataFrame(list(enumerate(questions)), "id bigint, question string")
    c = spark.createDataFrame(CLAUSES, "clause_id bigint, original_text string")
    lec = spark.createDataFrame(LECTURES, "id bigint, book string, text string")
    return {r["query"]: r for r in rag.answer_contexts(q, c, lec, LEX, ("太阳", "少阴"), (("太阳伤寒", "避风。"),)).collect()}


def test_every_kind_of_question(spark):
    got = ask(
        spark, "第35条讲什么", "桂枝汤的组成是什么？", "哪些方子含有桂枝和杏仁", "麻黄汤和桂枝汤有什么区别", "什么是少阴病？", "高血压怎么办", "阳合病腹满", "我流鼻血一直止不住，怎么办", "桂枝吃多少克", "怕冷，头痛", "怕冷", "第777条讲三阳合病", "中风",
    )
    first = lambda i: got[i]["docs"].split(",")[0]
    assert got[0]["kind"] == "clause" and got[0]["docs"] == "35"
    assert got[1]["kind"] == "formula" and first(1) == "12" and got[1]["context"] == "【方剂信息】桂枝汤：桂枝、甘草，主治太阳"
    assert got[2]["kind"] == "herb" and first(2) == "35" and "共1首：麻黄汤" in got[2]["context"]
    assert got[3]["kind"] == "comparison" and set(got[3]["docs"].split(",")[:2]) == {"12", "35"} and "麻黄汤独有：麻黄、杏仁" in got[3]["context"] and "共有药材：桂枝、甘草" in got[3]["context"]
    assert got[4]["kind"] == "concept" and got[4]["docs"].split(",")[:2] == ["3", "2"] and "【概念参考】少阴病主虚寒。" in got[4]["context"] and "四逆汤：甘草" in got[4]["context"]
    assert got[5]["status"] == "out_of_scope" and got[5]["answer"] == rag.OUTSIDE and got[5]["docs"] == ""
    assert got[6]["kind"] == "open" and first(6) == "99" and got[6]["prompt"].endswith("问题：阳合病腹满")
    assert got[7]["status"] == "emergency" and got[8]["status"] == "dose" and got[7]["prompt"] is None
    assert got[9]["status"] == "diagnosed" and got[9]["kind"] == "symptom" and first(9) == "1"
    assert "太阳伤寒" in got[9]["answer"] and "〔剂量从略〕" in got[9]["answer"] and "三两" not in got[9]["answer"] and "煎服方法从略" in got[9]["answer"] and "【建议】避风。" in got[9]["answer"]
    assert got[10]["status"] == "clarify" and "太阳伤寒" in got[10]["answer"]
    assert got[11]["kind"] == "clause" and first(11) == "99"
    assert got[12]["status"] == "ok"


def test_layers_fall_back_to_clauses(spark):
    q = spark.createDataFrame([(0, "怕冷，头痛")], "id bigint, question string")
    c = spark.createDataFrame(CLAUSES, "clause_id bigint, original_text string")
    none = spark.createDataFrame([], "id bigint, book string, text string")
    row = rag.answer_contexts(q, c, none, LEX, ("太阳",)).first()
    assert "以下为经典原文参考" in row["answer"] and "【第1条】" in row["answer"]
    assert rag.answer_contexts(q.limit(0), c, none, LEX, ("太阳",)).count() == 0


@pytest.mark.parametrize("question,kind", [
    ("我流鼻血一直止不住，怎么办", "emergency"), ("吐血了", "emergency"), ("突然昏迷不醒", "emergency"), ("急救怎么做", "emergency"), ("桂枝用量是多少", "dose"), ("麻黄几克", "dose"), ("帮我开个方", "dose"), ("昏迷是什么病机", None), ("什么是太阳中风", None), ("桂枝汤主治什么", None),
])
def test_input_guard(spark, question, kind):
    assert spark.createDataFrame([(question,)], "q string").select(G.input_guard(F.col("q"))).first()[0] == kind


def test_notices_and_masks(spark):
    say = lambda t: spark.createDataFrame([(t,)], "t string").select(G.with_notices(F.col("t"), "【免责】", "【就医】"), G.masked_doses(F.col("t"))).first()
    assert [say(t)[0][len(t) :] for t in ("你可以吃点药", "给你开三味", "开点药就好", "桂枝5钱", "心梗发作", "讲讲桂枝")] == ["【免责】"] * 4 + ["【就医】", ""]
    assert say("酒七合，粉一斗")[1] == "酒〔剂量从略〕，粉〔剂量从略〕"


def test_noise_patterns(spark):
    t = "微信公众号：abc 正文\n12\n版权所有\n电子文稿，某某\nhttps://a.b/c 见\n目录....12\n第 3 页"
    assert [x for x in spark.createDataFrame([(t,)], "t string").select(T.denoise(F.col("t"))).first()[0].split("\n") if x.strip()] == [" 正文", " 见"]


def test_phrases(spark):
    ok = lambda p: spark.createDataFrame([(p,)], "p string").select(P.valid(F.col("p"), ("桂枝汤", "脾脏"), "汤证脾脏脉")).first()[0]
    assert [ok(p) for p in ("桂枝汤证", "你的桂枝汤", "反正桂枝汤", "桂枝汤怎么用", "打桂枝汤", "“桂枝汤", "桂枝汤", "汤证", "桂枝汤。", "好桂枝汤")] == [True, False, False, False, False, False, True, False, False, False]


def test_symptoms(spark):
    cols = lambda t: spark.createDataFrame([(t,)], "t string").select(X.symptoms(F.col("t"), LEX.symptoms, LEX.colloquial), X.votable(F.col("t"), LEX.symptoms, LEX.colloquial, ("恶寒", "往来寒热", "往来寒热不止"))).first()
    assert cols("怕冷，不出汗，头痛")[0] == ["头痛", "恶寒"] and cols("没有头痛，恶寒怕冷")[0] == ["恶寒", "头痛"] and cols("不头痛")[0] == []
    assert cols("怕冷，往来寒热不止")[1] == ["恶寒", "往来寒热不止", "往来寒热"]


def test_terms_of_any_length(spark):
    long = "甲乙丙丁戊己庚辛壬癸子丑寅卯"
    texts = spark.createDataFrame([(1, f"前{long}后"), (2, "甲"), (3, None)], "id bigint, t string")
    terms = spark.createDataFrame([(long,), ("甲",), ("无",)], "term string")
    assert {(r["id"], r["term"]) for r in X.matches_by_pattern(texts, "t", terms).collect()} == {(1, long), (1, "甲"), (2, "甲")}


def test_text_vectors(spark):
    d = spark.createDataFrame([*CLAUSES, (500, None), (501, "")], "clause_id bigint, original_text string")
    q = spark.createDataFrame([(1, "麻黄桂枝杏仁"), (2, ""), (3, None)], "id bigint, q string")
    got = vector.text_top_k(d, q, "clause_id", "original_text", "id", "q", 2).orderBy("rank").collect()
    assert got[0]["doc"] == 35 and {r["query"] for r in got} == {1} and len(got) == 2


def test_stores(spark, tmp_path):
    lec = spark.createDataFrame([(0, "甲" * 50, "讲录", None, "桂枝汤的桂枝要去皮用"), (1, None, None, "forum", "少阴只是想睡觉而已")], "i bigint, instruction string, book string, source string, output string")
    at = str(tmp_path / "store")
    fake = lambda texts: [[float("桂枝" in t), float("少阴" in t), 2.0] for t in texts]
    assert files.build_lecture_store(lec, at, "i", fake) == files.build_lecture_store(lec, at, "i", fake) == 2
    rows = {r["id"]: r for r in spark.read.parquet(at).collect()}
    assert rows["lect_0"]["metadata"] == {"book": "讲录", "topic": "甲" * 40, "source": "lecture"} and rows["lect_1"]["metadata"]["source"] == "forum"
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in rows.values())
    assert files.probed(spark, at) == "lect_0"
    with pytest.raises(ValueError):
        files.build_lecture_store(lec.limit(0), at, "i", fake)
    assert {tuple(r) for r in files.write_jsonl(lec, str(tmp_path / "j"), count_by="source").collect()} == {(None, 1), ("forum", 1)}
    assert files.joined_pages(spark.createDataFrame([("a", 2, "乙"), ("a", 1, "甲"), ("a", 3, " ")], "pdf_name string, number int, text string")).first()["text"] == "甲\n\n乙"
    assert files.report_json(lec.select("i").limit(1)).first()[0] == '{"i":0}'


def test_graphs_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("乙", "甲", "加附子")], "src string, dst string, change string")
    v, edges = graph.build([(e, "derived_from", "formula", "formula"), (e.select("src", F.lit("草").alias("dst")), "contains", "formula", "herb")])
    files.write_graph(v, edges, str(tmp_path / "t"))
    files.write_graph_json(v, edges, str(tmp_path / "j"))
    for at in ("t", "j"):
        v2, e2 = files.read_graph(spark, str(tmp_path / at))
        assert {tuple(r) for r in v2.collect()} == {tuple(r) for r in v.collect()} and {tuple(r) for r in e2.collect()} == {tuple(r) for r in edges.collect()}
        assert [tuple(r) for r in graph.derivations(e2).collect()] == [("甲", "乙", "加附子")]


def test_judging_keeps_errors(spark):
    df = spark.createDataFrame([("分数：4", None), (None, None), ("分数：3", "timeout"), ("9/5", None)], "raw string, error string")
    assert [tuple(r[0]) for r in df.select(G.judged(F.col("raw"), F.col("error"))).collect()] == [(4.0, None), (-1.0, "no reply"), (-1.0, "timeout"), (9.0, None)]
