"""Catalog: cleaning, judging, cutting and matching texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import lexicon as X
from ..functions import text as T
from ..operators import routing as R
from . import lexicons as L
from .common import cut_words, lit, replaced, rx, stripped, table, words

_EDGE = "[ \t\r　]"
_NAME = "[一-鿿]{2}[汤散丸饮煎]"
_HEAD = r"(?:[一二三四五六七八九十百零]{1,4}[：:]|\d{1,3} +[一-鿿].*?[汤散丸饮煎])"
_CLOSE = r"^[，。、！？：；\s]+"
_NOTICE, _URGENT = "（本内容仅供参考。）", "（请立即就医。）"
_EVAL = "eval_rigor_results_v1_pre_guard"


def _clauses_cited(c):
    return F.concat(F.coalesce(c, F.lit("")), F.lit("【第"), (F.col("id") % 7).cast("string"), F.lit("条】见第"), (F.col("id") % 600).cast("string"), F.lit("条。"))


def _judge_text():
    s = F.floor("wall").cast("string")
    return F.when(F.col("id") % 4 == 0, F.concat(F.lit("分数："), s, F.lit("\n理由：依据充分"))).when(F.col("id") % 4 == 1, F.concat(s, F.lit(" / 5"))).when(F.col("id") % 4 == 2, F.concat(s, F.lit(" 分"))).otherwise(F.col("focus"))


def _sse():
    """The body of a stream that sends the whole answer, ten code points a chunk."""
    last = F.greatest(F.ceil(F.length("answer") / 10).cast("int") - 1, F.lit(0))
    chunk = lambda i: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("chunk").alias("type"), F.substring(F.col("answer"), i * 10 + 1, F.lit(10)).alias("content"))), F.lit("\n\n"))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), chunk), ""), F.lit('data: {"type":"done","latency":'), F.format_string("%.2f", "wall"), F.lit("}\n\n"))


def queries() -> dict:
    t = table
    return {
        "clean_denoise": lambda s, d: t(s, d, "pages").select("page_id", T.denoise(F.col("text")).alias("text")),
        "clean_normalize": lambda s, d: t(s, d, "pages").select("page_id", T.normalize_page(F.col("text")).alias("text")),
        "line_filter": lambda s, d: t(s, d, "pages").select("page_id", T.keep_lines(F.col("text"), L.LINE_NOISE).alias("text")),
        "keep_abbrev_strip": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", T.strip_foreign(T.strip_episode(F.col("text"))).alias("text")),
        "contents_pages": lambda s, d: t(s, d, "chapters").where("content is not null").select("chapter_id", T.is_contents_page(F.col("content")).alias("is_contents")),
        "marker_count": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", T.markers_in(F.col("text"), L.ORAL).alias("markers"), T.early_marker(F.col("text"), L.ORAL, 20).alias("early")),
        "quality_filter": lambda s, d: t(s, d, "documents").where(T.quality_ok(F.col("text"), L.ORAL, L.NOISE_WORDS, L.HERBS)).select("doc_id", F.length("text").alias("n")),
        "garbage_ratio": lambda s, d: t(s, d, "pages").groupBy("pdf_name").agg(F.round(F.avg(T.garbage_ratio(F.col("text"))), 6).alias("ratio"), F.count(F.lit(1)).alias("pages")),
        "opening_fix": lambda s, d: t(s, d, "sft_samples").where("output is not null").select("sample_id", T.fix_opening(F.col("output"), least=100).alias("output")).where("output is not null"),
        "sentence_split": lambda s, d: t(s, d, "sft_samples").where("output is not null").select("sample_id", F.filter(F.split("output", "(?<=[。！？])", -1), lambda x: x != "").alias("p")).select("sample_id", F.size("p").alias("sentences"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest")),
        "sentence_chunks": lambda s, d: t(s, d, "sft_samples").select("sample_id", F.posexplode(T.pack_sentences(F.col("output"), 800, 200, "。！？\n")).alias("n", "chunk")),
        "line_segments": lambda s, d: t(s, d, "chapters").select("chapter_id", F.posexplode(T.line_segments(F.col("content"), (r"^[一二三四五六七八九十百千]+[：:]", r"\[第\d+\s*集\]", "我们回头想|接着看"))).alias("n", "segment")),
        "heading_segment": lambda s, d: t(s, d, "chapters").where("content is not null").select("chapter_id", F.posexplode(T.sections(F.concat_ws("\n", "title", "content"))).alias("n", "s")).select("chapter_id", "n", "s.title", "s.content"),
        "content_type": lambda s, d: t(s, d, "clauses").select("clause_id", T.content_type(F.concat_ws("：", "clause_id_cn", "original_text"), L.MERIDIANS, L.HERBS).alias("with_number"), T.content_type(F.col("original_text"), L.MERIDIANS, L.HERBS).alias("kind")),
        "instruction": lambda s, d: t(s, d, "chapters").where("content is not null").select("chapter_id", T.instruction(F.concat_ws("\n", "title", "content"), L.MERIDIANS, L.HERBS).alias("instruction"), T.instruction(F.col("content"), L.MERIDIANS, L.HERBS).alias("body_instruction")),
        "first_topic": lambda s, d: t(s, d, "documents").select("doc_id", T.first_word(F.col("text"), L.HERBS, 400).alias("herb"), T.first_word(F.col("text"), L.ORGANS, 50).alias("organ")),
        "aspect_detect": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", T.first_aspect(F.col("text"), L.ASPECTS).alias("aspect")),
        "lexicon_join": lambda s, d: X.matches(t(s, d, "clauses").select("clause_id", "original_text"), "original_text", X.lexicon(s, [(h,) for h in L.HERBS], "term string")).groupBy("term").agg(F.count(F.lit(1)).alias("clauses"), F.min("clause_id").alias("first_clause")),
        "best_term": lambda s, d: X.best_term(t(s, d, "clauses"), "clause_id", "original_text", X.lexicon(s, [(h,) for h in (*L.HERBS, *L.SYMPTOMS, *L.ORGANS)], "term string"), L.ORGANS),
        "cjk_keywords": lambda s, d: t(s, d, "clauses").select("clause_id", F.array_join(T.cjk_words(F.col("original_text")), "|").alias("words")),
        "bigram_tokens": lambda s, d: t(s, d, "clauses").select(F.explode(T.bigrams(F.col("original_text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
        "chinese_numbers": lambda s, d: t(s, d, "clauses").select("clause_id", T.chinese_number(F.col("clause_id")).alias("name")),
        "html_to_text": lambda s, d: t(s, d, "pages").select("page_id", T.html_text(F.concat(F.lit("<html><head><style>p{}</style><script>var a=1;</script></head><body><!-- x --><div>menu</div><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))).alias("text")),
        "sanitize_doses": lambda s, d: t(s, d, "sft_samples").where("output is not null").select("sample_id", G.masked_doses(F.col("output")).alias("output")),
        "input_guard": lambda s, d: t(s, d, _EVAL).select("id", F.coalesce(G.input_guard(F.concat("question", F.when(F.col("id") % 5 == 0, "剂量").when(F.col("id") % 7 == 0, "突然昏迷不醒").otherwise(""))), F.lit("pass")).alias("guard"), G.question_ok(F.col("question")).alias("ok")),
        "out_of_scope": lambda s, d: t(s, d, _EVAL).select("id", F.col("question").rlike(T.one_of((*L.OUT_OF_SCOPE, *L.OUTSIDE_HERE))).alias("outside")),
        "citation_check": lambda s, d: t(s, d, _EVAL).select("id", G.checked_citations(_clauses_cited(F.col("answer")), F.coalesce("retrieved_ids", F.array().cast("array<bigint>"))).alias("answer")),
        "safety_notices": lambda s, d: t(s, d, "sft_samples").where("output is not null").select("sample_id", G.with_notices(F.col("output"), _NOTICE, _URGENT).alias("output")),
        "judge_parse": lambda s, d: t(s, d, _EVAL).where("wall is not null").select("id", F.round(G.judge_score(_judge_text()), 6).alias("score"), G.judge_reason(_judge_text()).alias("reason")),
        "sse_parse": lambda s, d: t(s, d, _EVAL).where("wall is not null and answer is not null").select("id", G.sse_answer(_sse()).alias("answer"), F.round(G.sse_latency(_sse()), 2).alias("latency")),
        "query_route": lambda s, d: t(s, d, _EVAL).select("id", R.route(F.col("question"), R.names_in(F.col("question"), _NAME), L.HERBS).alias("route"), F.array_join(R.names_in(F.col("question"), _NAME), ",").alias("names")),
        "query_rewrite": lambda s, d: t(s, d, _EVAL).select("id", R.rewritten(F.col("question")).alias("rewritten")),
        "query_expand": lambda s, d: t(s, d, _EVAL).select("id", X.expand(F.col("question"), L.COLLOQUIAL).alias("expanded")),
        "concept_lookup": lambda s, d: t(s, d, _EVAL).select("id", X.concept(F.col("question"), L.CONCEPTS, L.QUESTION_WORDS).alias("concept")),
        "symptom_terms": lambda s, d: t(s, d, "clauses").select("clause_id", F.array_join(X.found_terms(F.col("original_text"), L.SYMPTOMS), ",").alias("symptoms")),
        "symptom_rules": lambda s, d: t(s, d, "clauses").select("clause_id", X.concept_by_symptoms(X.found_terms(F.col("original_text"), L.SYMPTOMS), L.RULES).alias("concept")),
    }


def _count_of(c: str, piece: str) -> str:
    return f"((length({c}) - length(replace({c}, {lit(piece)}, ''))) // {len(piece)})"


def _kind(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({stripped(c)}, '^[一二三四五六七八九十百零]{{1,4}}[：:]') OR regexp_matches(left({c}, 20), '第\\d+条') THEN 'clause' "
        f"WHEN regexp_matches({stripped(c)}, '^\\d{{1,3}} +[一-鿿].*?[汤散丸饮煎]') THEN 'formula' "
        f"WHEN regexp_matches(left({c}, 50), {lit(T.one_of(L.MERIDIANS))}) AND regexp_matches(left({c}, 100), '证|病') THEN 'pattern' "
        f"WHEN regexp_matches(left({c}, 50), {lit(T.one_of(L.HERBS))}) THEN 'herb' ELSE 'general' END"
    )


def _instruction(c: str) -> str:
    k, s = _kind(c), stripped(c)
    first = lambda ws, n: f"list_filter({words(ws)}, lambda w: contains(left({c}, {n}), w))[1]"
    return (
        f"CASE {k} WHEN 'clause' THEN '请解释第' || coalesce(nullif(regexp_extract({s}, '^([一二三四五六七八九十百零]{{1,4}})[：:]', 1), ''), nullif(regexp_extract(left({c}, 20), '第(\\d+)条', 1), '')) || '条的原文含义。' "
        f"WHEN 'formula' THEN '请解释' || regexp_extract({s}, '^\\d{{1,3}} +([一-鿿].*?[汤散丸饮煎])', 1) || '的组成和主治。' "
        f"WHEN 'pattern' THEN '请解释' || {first(L.MERIDIANS, 50)} || '的证候特点和治疗原则。' WHEN 'herb' THEN '请介绍' || {first(L.HERBS, 50)} || '的应用。' "
        f"ELSE CASE WHEN length(regexp_extract({c}, '^[^。！？\\n]*')) > 5 THEN '请讲解以下知识：' || left(regexp_extract({c}, '^[^。！？\\n]*'), 30) || '。' ELSE '请讲解相关的知识。' END END"
    )


def _found(c: str) -> str:
    return f"list_filter({words(L.SYMPTOMS)}, lambda w: contains({c}, w) AND NOT regexp_matches({c}, '[{X.NEGATIONS}]' || w))"


def _expanded() -> str:
    e = "question"
    for a, b in L.COLLOQUIAL:
        e = f"(CASE WHEN contains(question, {lit(a)}) AND NOT contains({e}, {lit(b)}) THEN {e} || {lit(' ' + b)} ELSE {e} END)"
    return e


def _concept() -> str:
    core = f"trim({cut_words('question', L.QUESTION_WORDS)})"
    same = [f"WHEN {core} = {lit(c)} OR question = {lit(c)} THEN {lit(c)}" for c in L.CONCEPTS]
    held = [f"WHEN contains(question, {lit(c)}) THEN {lit(c)}" for c in L.CONCEPTS]
    stem = [f"WHEN contains({core}, {lit(c.rstrip('证病'))}) THEN {lit(c)}" for c in L.CONCEPTS if len(c.rstrip("证病")) >= 2]
    return "CASE " + " ".join(same + held + stem) + " END"


def _rules() -> str:
    parts = [f"SELECT clause_id, {i} AS o, {lit(name)} AS concept, len(list_intersect(f, {words(need)})) / {len(set(need))}.0 AS s FROM f" for i, (need, name) in enumerate(L.RULES)]
    return f"WITH f AS (SELECT clause_id, {_found('original_text')} AS f FROM clauses), r AS ({' UNION ALL '.join(parts)}), b AS (SELECT clause_id, arg_max(concept, s * 1000 - o) AS concept FROM r WHERE s >= 0.5 GROUP BY 1) SELECT clause_id, concept FROM clauses LEFT JOIN b USING (clause_id)"


def _route() -> str:
    any_ = lambda ws: f"regexp_matches(question, {lit(T.one_of(ws))})"
    part = f"regexp_replace({cut_words('trim(p)', R.QUESTION)}, '^[？?，,的]+|[？?，,的]+$', '', 'g')"
    return (
        f"WITH n AS (SELECT id, question, regexp_extract_all(question, {lit(_NAME)}) AS raw, list_filter(list_transform(regexp_split_to_array(question, '和|与|跟|以及'), lambda p: {part}), lambda p: length(p) >= 2) AS parts FROM {_EVAL}), "
        "m AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS names FROM n) "
        f"SELECT id, CASE WHEN regexp_matches(question, '第\\d+条') THEN 'clause' WHEN {any_(R.COMPARE)} AND (len(names) >= 2 OR len(parts) >= 2) THEN 'comparison' "
        f"WHEN ({any_(R.FORMULA)} OR (len(names) > 0 AND starts_with(question, names[1]))) AND len(names) > 0 THEN 'formula' WHEN ({any_(R.HERB)} OR (contains(question, '方') AND {any_(L.HERBS)})) AND {any_(L.HERBS)} THEN 'herb' ELSE 'semantic' END AS route, "
        "array_to_string(names, ',') AS names FROM m"
    )


def _cited() -> str:
    text = "coalesce(answer, '') || '【第' || (id % 7) || '条】见第' || (id % 600) || '条。'"
    numbers = "list_distinct(regexp_extract_all(t, '第\\s*(\\d+)\\s*条', 1))"
    wrong = f"list_filter({numbers}, lambda n: NOT list_contains(list_transform(v, lambda x: x::VARCHAR), regexp_replace(n, '^0+(.)', '\\1')))"
    fixed = "list_reduce(list_concat([t], w), lambda a, n: regexp_replace(regexp_replace(a, '[【\\[]\\s*第\\s*' || n || '\\s*条\\s*[】\\]]', '', 'g'), '第\\s*' || n || '\\s*条', '', 'g'))"
    return f"WITH a AS (SELECT id, coalesce(retrieved_ids, []) AS v, {text} AS t FROM {_EVAL}), b AS (SELECT id, v, t, {wrong} AS w FROM a) SELECT id, CASE WHEN len(v) > 0 AND len(w) > 0 THEN {fixed} ELSE t END AS answer FROM b"


def oracle_sql() -> dict[str, str]:
    line_bad = "|".join(f"(?:{p})" for p in L.LINE_NOISE)
    edges = f"^{_EDGE}+|{_EDGE}+$"
    kept = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {rx(edges)}, '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, {rx(line_bad)})), chr(10))"
    normal = replaced(replaced(replaced(replaced("text", T.NOISE), ["\n{3,}"], "\n\n"), [f"(?m){edges}"]), [r"^[\n \t\r　]+|[\n \t\r　]+$"])
    opened = f"^(?:{T.one_of(T.OPENERS)})"
    rest = f"regexp_replace({stripped(f'regexp_replace(output, {rx(opened)}, {lit(str())})')}, {rx(_CLOSE)}, '')"
    ls = "string_split(content, chr(10))"
    short = f"len(list_filter({ls}, lambda x: length(trim(x)) < 15))"
    doc_lines = "string_split(text, chr(10))"
    terms = (*L.HERBS, *L.SYMPTOMS, *L.ORGANS)
    sections = f"WITH a AS (SELECT chapter_id, concat_ws(chr(10), title, content) AS t FROM chapters WHERE content IS NOT NULL), m AS (SELECT chapter_id, t, regexp_replace(t, '(?m)^({_HEAD})', chr(1) || '\\1', 'g') AS x FROM a), p AS (SELECT chapter_id, unnest(string_split(x, chr(1))[2:]) AS p, generate_subscripts(string_split(x, chr(1))[2:], 1) - 1 AS n FROM m WHERE contains(x, chr(1))) "
    return {
        "clean_denoise": f"SELECT page_id, {replaced('text', T.NOISE)} AS text FROM pages",
        "clean_normalize": f"SELECT page_id, {normal} AS text FROM pages",
        "line_filter": f"SELECT page_id, {kept} AS text FROM pages",
        "contents_pages": f"SELECT chapter_id, {_count_of('content', '·····')} > 3 OR {_count_of('content', '...')} > 3 OR regexp_matches(content, '\\.{{3,}}\\s*\\d+') OR regexp_matches(content, '[一二三四五六七八九十百千\\d]+[、.]\\s*[一-鿿]+\\s*\\.{{3,}}') OR (len({ls}) > 5 AND {short} > len({ls}) * 0.7::DOUBLE) AS is_contents FROM chapters WHERE content IS NOT NULL",
        "marker_count": f"SELECT doc_id, len(list_filter({words(L.ORAL)}, lambda w: contains(text, w)))::INT AS markers, len(list_filter({words(L.ORAL)}, lambda w: instr(text, w) BETWEEN 1 AND 20)) > 0 AS early FROM documents WHERE text IS NOT NULL",
        "quality_filter": f"SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) BETWEEN 100 AND 2000 AND len(list_filter({doc_lines}, lambda x: regexp_matches(trim(x), '^(第\\d+\\s*集$|条辨\\d)'))) <= 5 AND NOT (len({doc_lines}) <= 2 AND NOT regexp_matches(text, {lit(T.one_of(L.ORAL))})) AND NOT regexp_matches(text, {lit(T.one_of(L.NOISE_WORDS))}) AND regexp_matches(text, {lit(T.one_of(L.HERBS))})",
        "garbage_ratio": "SELECT pdf_name, round(avg(1 - length(regexp_replace(text, '[^一-鿿0-9A-Za-z，。！？、；：]', '', 'g')) / greatest(length(text), 1)::DOUBLE), 6) AS ratio, count(*) AS pages FROM pages GROUP BY 1",
        "opening_fix": f"WITH r AS (SELECT sample_id, output AS o, regexp_matches(output, {rx(opened)}) AS opened, {rest} AS rest FROM sft_samples WHERE output IS NOT NULL) SELECT sample_id, CASE WHEN NOT opened THEN o ELSE rest END AS output FROM r WHERE NOT opened OR length(rest) >= 100",
        "sentence_split": "WITH p AS (SELECT sample_id, regexp_extract_all(output, '[^。！？]*[。！？]|[^。！？]+') AS p FROM sft_samples WHERE output IS NOT NULL) SELECT sample_id, len(p)::INT AS sentences, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::INT AS longest FROM p",
        "sentence_chunks": "WITH RECURSIVE p AS (SELECT sample_id, regexp_extract_all(output, '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+') AS p FROM sft_samples WHERE length(output) > 800), r AS (SELECT sample_id, p, 1 AS i, p[1] AS cur, NULL::VARCHAR AS done FROM p UNION ALL SELECT sample_id, p, i + 1, CASE WHEN length(cur) + length(p[i + 1]) > 800 AND cur <> '' THEN p[i + 1] ELSE cur || p[i + 1] END, CASE WHEN length(cur) + length(p[i + 1]) > 800 AND cur <> '' THEN cur END FROM r WHERE i < len(p)), "
        f"o AS (SELECT sample_id, i, {stripped('done')} AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT sample_id, i + 1, {stripped('cur')} FROM r WHERE i = len(p) UNION ALL SELECT sample_id, 0, output FROM sft_samples WHERE length(output) <= 800) SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1)::INT AS n, chunk FROM o WHERE length(chunk) >= 200",
        "heading_segment": sections + f"SELECT chapter_id, n::INT AS n, {stripped(f'regexp_extract(p, {lit(chr(94) + _HEAD)}, 0)')} AS title, {stripped('p')} AS content FROM p UNION ALL SELECT chapter_id, 0, '未分类', {stripped('t')} FROM m WHERE NOT contains(x, chr(1)) AND {stripped('t')} <> ''",
        "content_type": f"SELECT clause_id, {_kind('concat_ws(chr(65306), clause_id_cn, original_text)')} AS with_number, {_kind('original_text')} AS kind FROM clauses",
        "instruction": f"SELECT chapter_id, {_instruction('t')} AS instruction, {_instruction('content')} AS body_instruction FROM (SELECT chapter_id, content, concat_ws(chr(10), title, content) AS t FROM chapters WHERE content IS NOT NULL)",
        "first_topic": f"SELECT doc_id, list_filter({words(L.HERBS)}, lambda w: contains(left(text, 400), w))[1] AS herb, list_filter({words(L.ORGANS)}, lambda w: contains(left(text, 50), w))[1] AS organ FROM documents",
        "aspect_detect": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(left(text, 300), {lit('|'.join(p))}) THEN {lit(n)}" for n, p in L.ASPECTS) + " ELSE 'general' END AS aspect FROM documents WHERE text IS NOT NULL",
        "lexicon_join": f"SELECT term, count(*) AS clauses, min(clause_id) AS first_clause FROM clauses, (SELECT unnest({words(L.HERBS)}) AS term) WHERE contains(original_text, term) GROUP BY 1",
        "best_term": f"WITH l AS (SELECT unnest({words(terms)}) AS term, generate_subscripts({words(terms)}, 1) AS ord), h AS (SELECT clause_id, term, ord, ((length(original_text) - length(replace(original_text, term, ''))) // length(term))::INT AS freq, list_contains({words(L.ORGANS)}, term) AS common FROM clauses, l WHERE contains(original_text, term)) SELECT clause_id, term, freq FROM h QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY common, length(term) DESC, freq DESC, ord) = 1",
        "cjk_keywords": "WITH r AS (SELECT clause_id, regexp_extract_all(original_text, '[一-鿿]{2,}') AS r FROM clauses) SELECT clause_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), '|') AS words FROM r",
        "bigram_tokens": "WITH c AS (SELECT regexp_replace(lower(original_text), '[^0-9a-z一-鿿]+', ' ', 'g') AS t FROM clauses) SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda p: NOT contains(p, ' '))) AS token FROM c) GROUP BY 1",
        "html_to_text": "WITH p AS (SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '" + edges + "', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)copyright|login|menu|nav')) AS l FROM pages) SELECT page_id, array_to_string(l, chr(10)) AS text FROM p",
        "sanitize_doses": f"WITH m AS (SELECT sample_id, regexp_replace(output, {lit(G.DOSE_MENTION)}, '〔剂量从略〕', 'g') AS m FROM sft_samples WHERE output IS NOT NULL) SELECT sample_id, CASE WHEN regexp_matches(m, {lit(G.COOKING)}) THEN regexp_split_to_array(m, {lit(G.COOKING)})[1] || '（煎服方法从略）' ELSE m END AS output FROM m",
        "input_guard": f"WITH q AS (SELECT id, question, question || CASE WHEN id % 5 = 0 THEN '剂量' WHEN id % 7 = 0 THEN '突然昏迷不醒' ELSE '' END AS t FROM {_EVAL}) SELECT id, CASE WHEN regexp_matches(t, {lit(G.DOSE_QUESTION)}) THEN 'dose' WHEN regexp_matches(t, {lit(G.EMERGENCY_QUESTION)}) THEN 'emergency' ELSE 'pass' END AS guard, length(question) <= 500 AND trim(question) <> '' AS ok FROM q",
        "out_of_scope": f"SELECT id, regexp_matches(question, {lit(T.one_of((*L.OUT_OF_SCOPE, *L.OUTSIDE_HERE)))}) AS outside FROM {_EVAL}",
        "citation_check": _cited(),
        "safety_notices": f"SELECT sample_id, output || CASE WHEN regexp_matches(output, {lit(G.DOSE + '|' + G.DOSE_WORDS)}) AND NOT contains(output, {lit(_NOTICE)}) THEN {lit(_NOTICE)} ELSE '' END || CASE WHEN regexp_matches(output, {lit(G.EMERGENCY)}) AND NOT contains(output, {lit(_URGENT)}) THEN {lit(_URGENT)} ELSE '' END AS output FROM sft_samples WHERE output IS NOT NULL",
        "judge_parse": f"WITH w AS (SELECT id, focus, floor(wall)::BIGINT::VARCHAR AS s FROM {_EVAL} WHERE wall IS NOT NULL) SELECT id, round(CASE id % 4 WHEN 0 THEN least(5.0, s::DOUBLE) WHEN 1 THEN s::DOUBLE WHEN 2 THEN least(5.0, s::DOUBLE) ELSE 0.0 END, 6)::DOUBLE AS score, CASE id % 4 WHEN 0 THEN '依据充分' WHEN 1 THEN s || ' / 5' WHEN 2 THEN s || ' 分' ELSE focus END AS reason FROM w",
        "sse_parse": f"SELECT id, answer, round(format('{{:.2f}}', wall)::DOUBLE, 2) AS latency FROM {_EVAL} WHERE wall IS NOT NULL AND answer IS NOT NULL",
        "query_route": _route(),
        "query_rewrite": f"SELECT id, coalesce(nullif(regexp_replace({cut_words('question', R.QUESTION)}, '^[{R.PUNCTUATION}]+|[{R.PUNCTUATION}]+$', '', 'g'), ''), question) AS rewritten FROM {_EVAL}",
        "query_expand": f"SELECT id, {_expanded()} AS expanded FROM {_EVAL}",
        "concept_lookup": f"SELECT id, {_concept()} AS concept FROM {_EVAL}",
        "symptom_terms": f"SELECT clause_id, array_to_string({_found('original_text')}, ',') AS symptoms FROM clauses",
        "symptom_rules": _rules(),
    }
