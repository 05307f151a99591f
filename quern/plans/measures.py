"""Catalog: measures, reports, dedup, splits, samples and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, metrics, samples
from ..session import cut, spread
from ..streaming import events
from . import lexicons as L
from .common import lit, table, words

_EVAL = "eval_rigor_results_v1_pre_guard"
_SYSTEM = "你是讲解经典的老师。"
_TEMPLATES = (("组成", "{name}由哪些药组成？", "{name}：{body}"), ("出处", "{name}出自哪一章？", "第{chapter_id}章"))


def _with_reference(s, d):
    """Every answer with what the first asking of its question retrieved, as the wanted ids."""
    e = table(s, d, _EVAL)
    first = e.groupBy("question").agg(F.min_by("retrieved_ids", "id").alias("wanted"))
    return e.join(first, "question").withColumn("route", F.coalesce("route_type", F.lit("none")))


def _stage_compare(s, d):
    e = table(s, d, _EVAL).where("category is not null").withColumn("stage", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    p = e.groupBy("category").pivot("stage", ["even", "odd"]).agg(F.round(F.avg("latency"), 6))
    return p.select("category", "even", "odd", F.round(F.col("odd") - F.col("even"), 6).alias("delta"), metrics.improvement(F.col("even"), F.col("odd")).alias("improvement"))


def _refine_report(s, d):
    x = table(s, d, "sft_samples").where("output is not null").withColumn("book", F.coalesce("book", F.lit("none")))
    n = F.length("output")
    return x.groupBy("book").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("instruction").alias("instructions"), F.count_if(F.col("output").rlike(T.one_of(L.ORAL))).alias("oral"), F.count_if(n < 200).alias("short"),
        F.count_if((n >= 200) & (n < 500)).alias("medium"), F.count_if((n >= 500) & (n < 800)).alias("long"), F.count_if(n >= 800).alias("very_long"), F.count_if(F.col("output").rlike("[A-Za-z]{3,}")).alias("foreign"), F.round(F.avg(n), 6).alias("mean_chars"),
    )


def _step(c):
    return F.when(F.length(c) < 50, "short").when(T.markers_in(c, L.NOISE_WORDS) > 0, "noise").when(T.is_contents_page(c), "contents").when(T.fix_opening(c, least=100).isNull(), "context").otherwise("kept")


def _chat(s, d):
    x = table(s, d, "sft_samples").where("output is not null")
    return x.select("sample_id", samples.rendered(samples.chat(_SYSTEM, F.col("instruction"), F.col("output")), header=False).alias("text"))


def _masked(s, d):
    x = table(s, d, "sft_samples").where("output is not null").select("sample_id", T.bigrams(F.concat("instruction", "output")).alias("t"), F.size(T.bigrams(F.col("instruction"))).alias("prefix"))
    x = x.select("sample_id", "prefix", F.transform("t", lambda v: F.length(v) + F.ascii(v)).alias("ids"))
    x = x.select("sample_id", samples.masked_labels(F.col("ids"), F.col("prefix"), 384).alias("labels"))
    return x.where(F.size("labels") > 10).select("sample_id", F.size("labels").alias("n"), F.size(F.filter("labels", lambda v: v == -100)).alias("masked"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def _refined(s, d):
    """Clean, drop what does not teach, mend openings, cut to length, name, keep firsts."""
    x = spread(table(s, d, "sft_samples").where("output is not null").select("sample_id", "book", "output"))
    x = x.select("sample_id", "book", T.strip(T.strip_foreign(T.strip_episode(F.col("output")))).alias("text"))
    x = cut(x)
    x = x.where((F.length("text") >= 50) & ~T.is_contents_page(F.col("text"))).select("sample_id", "book", T.fix_opening(F.col("text"), least=100).alias("text")).where("text is not null")
    x = x.select("sample_id", "book", F.posexplode(T.pack_sentences(F.col("text"), 800, 200, "。！？\n")).alias("n", "output"))
    x = cut(x)  # each cut keeps a costly expression from being repeated inside the next
    x = x.withColumn("key", F.format_string("%020d-%06d", "sample_id", "n"))
    x = x.withColumn("instruction", T.instruction(F.col("output"), L.MERIDIANS, L.HERBS))
    return dedup.exact_split(cut(dedup.first_by_prefix(cut(x), "output", "key", 150)), "key").select("key", "book", "instruction", "output", "part")


def queries() -> dict:
    t = table
    kw = lambda: metrics.keyword_share(F.col("question"), F.col("answer"))
    return {
        "hit_rate_at_k": lambda s, d: metrics.hit_rate(_with_reference(s, d), "retrieved_ids", "wanted", ["route"]),
        "keyword_accuracy": lambda s, d: t(s, d, _EVAL).agg(F.round(F.avg(kw()), 6).alias("accuracy"), F.count(F.lit(1)).alias("rows")),
        "category_accuracy": lambda s, d: t(s, d, _EVAL).groupBy("category").agg(F.round(F.avg(kw()), 4).alias("accuracy")),
        "latency_stats": lambda s, d: metrics.latency(t(s, d, _EVAL).where("latency is not null"), "latency", ["category"]),
        "event_latency": lambda s, d: metrics.latency(t(s, d, "events"), "value", ["event_type"]),
        "judge_stats": lambda s, d: metrics.judge(t(s, d, "sft_samples").withColumn("score", F.coalesce(F.col("quality") * 5, F.lit(-1.0))), "score", ["category"]),
        "stage_compare": _stage_compare,
        "route_distribution": lambda s, d: t(s, d, _EVAL).groupBy("route_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("retrieved_ids") == 0).alias("without_docs"), F.count("error").alias("errors")),
        "top_instructions": lambda s, d: t(s, d, "sft_samples").groupBy("instruction").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first")).orderBy(F.desc("n"), "first").limit(10),
        "refine_report": _refine_report,
        "extract_report": lambda s, d: t(s, d, "pages").groupBy("pdf_name").agg(
            F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
            sum((F.max(F.contains("text", F.lit(h)).cast("int")) for h in L.HERBS[1:]), F.max(F.contains("text", F.lit(L.HERBS[0])).cast("int"))).alias("herbs"), F.round(1 - F.sum(F.length(F.regexp_replace("text", "[^一-鿿0-9A-Za-z，。！？、；：\\s]", ""))) / F.sum(F.length("text")), 6).alias("garbage")),
        "step_counters": lambda s, d: t(s, d, "sft_samples").where("output is not null").groupBy(_step(F.col("output")).alias("step")).agg(F.count(F.lit(1)).alias("n")),
        "page_gaps": lambda s, d: t(s, d, "pages").where("number is not null").groupBy("pdf_name").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("number").alias("numbers"), F.max("number").alias("last")).join(t(s, d, "pdf_files").select("pdf_name", "page_count"), "pdf_name", "left"),
        "source_rollup": lambda s, d: t(s, d, "sft_samples").rollup("split", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")),
        "late_rows": lambda s, d: t(s, d, "documents").groupBy("source").agg(F.count_if(F.expr("loaded_at > published_at + interval 7 days")).alias("late"), F.count(F.lit(1)).alias("n")),
        "prefix_dedup_100": lambda s, d: dedup.first_by_prefix(t(s, d, "sft_samples").select("sample_id", "output"), "output", "sample_id", 100),
        "prefix_dedup_150": lambda s, d: dedup.first_by_prefix(t(s, d, "documents").select("doc_id", "text"), "text", "doc_id", 150),
        "train_val_split": lambda s, d: dedup.exact_split(t(s, d, "documents").select("doc_id"), "doc_id", 0.1),
        "ratio_mix": lambda s, d: dedup.ratio_mix(t(s, d, "sft_samples").where("source = 'pdf'").select("sample_id", "source"), t(s, d, "sft_samples").where("source = 'lecture'").select("sample_id", "source"), "sample_id", 0.9),
        "chat_messages": _chat,
        "loss_mask": _masked,
        "prompt_build": lambda s, d: t(s, d, _EVAL).select("id", samples.prompt(F.col("question"), F.coalesce("retrieved_texts", F.array().cast("array<string>")), [F.when(F.col("route_type").isNotNull(), F.concat(F.lit("类型："), F.col("route_type")))]).alias("prompt")),
        "sample_families": lambda s, d: samples.families(t(s, d, "chapters").select("chapter_id", F.nullif(F.regexp_extract("title", r"^\d+ (.+)$", 1), F.lit("")).alias("name"), F.left("content", F.lit(60)).alias("body")), "chapter_id", _TEMPLATES),
        "refine_pipeline": _refined,
        "stream_windows": lambda s, d: events.counted(s, d),
        "stream_closed": lambda s, d: events.closed(s, d),
        "stream_sessions": lambda s, d: events.sessions(s, d).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n"),
    }


_SHARE = "CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(coalesce(answer, ''), w))) / len(k)::DOUBLE ELSE 1.0 END"
_KW = f"k AS (SELECT *, list_distinct(regexp_extract_all(question, '[一-鿿]{{2,}}')) AS k FROM {_EVAL})"
_COLS = "min({0}) AS min, max({0}) AS max, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.95), 6) AS p95"


def oracle_sql() -> dict[str, str]:
    from .texts import _CLOSE, _count_of, stripped, rx

    opened = f"^(?:{T.one_of(T.OPENERS)})"
    rest = f"regexp_replace({stripped(f'regexp_replace(output, {rx(opened)}, {lit(str())})')}, {rx(_CLOSE)}, '')"
    ls = "string_split(output, chr(10))"
    contents = f"({_count_of('output', '·····')} > 3 OR {_count_of('output', '...')} > 3 OR regexp_matches(output, '\\.{{3,}}\\s*\\d+') OR regexp_matches(output, '[一二三四五六七八九十百千\\d]+[、.]\\s*[一-鿿]+\\s*\\.{{3,}}') OR (len({ls}) > 5 AND len(list_filter({ls}, lambda x: length(trim(x)) < 15)) > len({ls}) * 0.7::DOUBLE))"
    clean = lambda c: f"regexp_replace(lower({c}), '[^0-9a-z一-鿿]+', ' ', 'g')"
    tok = lambda c: f"list_filter(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)), lambda p: NOT contains(p, ' '))"
    key = lambda k: f"md5({k} || '-42')"
    n = "length(output)"
    return {
        "hit_rate_at_k": f"WITH w AS (SELECT question, arg_min(retrieved_ids, id) AS wanted FROM {_EVAL} WHERE retrieved_ids IS NOT NULL GROUP BY 1), j AS (SELECT coalesce(route_type, 'none') AS route, CASE WHEN len(wanted) > 0 THEN coalesce(list_has_any(retrieved_ids[1:5], wanted), false)::INT::DOUBLE END AS h FROM {_EVAL} JOIN w USING (question)) SELECT route, count(*) AS rows, round(coalesce(avg(h), 0), 6) AS hit_rate FROM j GROUP BY 1",
        "keyword_accuracy": f"WITH {_KW} SELECT round(avg({_SHARE}), 6) AS accuracy, count(*) AS rows FROM k",
        "category_accuracy": f"WITH {_KW} SELECT category, round(avg({_SHARE}), 4) AS accuracy FROM k GROUP BY 1",
        "latency_stats": f"SELECT category, {_COLS.format('latency')} FROM {_EVAL} WHERE latency IS NOT NULL GROUP BY 1",
        "event_latency": f"SELECT event_type, {_COLS.format('value')} FROM events GROUP BY 1",
        "judge_stats": "SELECT category, count(*) AS n, round(avg(quality * 5), 6) AS mean, round(median(quality * 5), 6) AS median FROM sft_samples WHERE quality * 5 >= 0 GROUP BY 1",
        "stage_compare": f"WITH a AS (SELECT category, round(avg(latency) FILTER (id % 2 = 0), 6) AS even, round(avg(latency) FILTER (id % 2 = 1), 6) AS odd FROM {_EVAL} WHERE category IS NOT NULL GROUP BY 1) SELECT category, even, odd, round(odd - even, 6) AS delta, CASE WHEN even > 0 THEN round((odd - even) / even * 100, 6) ELSE 0.0 END AS improvement FROM a",
        "route_distribution": f"SELECT route_type, count(*) AS n, count(*) FILTER (len(retrieved_ids) = 0) AS without_docs, count(error) AS errors FROM {_EVAL} GROUP BY 1",
        "top_instructions": "SELECT instruction, count(*) AS n, min(sample_id) AS first FROM sft_samples GROUP BY 1 ORDER BY n DESC, first LIMIT 10",
        "refine_report": f"SELECT coalesce(book, 'none') AS book, count(*) AS rows, count(DISTINCT instruction) AS instructions, count(*) FILTER (regexp_matches(output, {lit(T.one_of(L.ORAL))})) AS oral, count(*) FILTER ({n} < 200) AS short, count(*) FILTER ({n} >= 200 AND {n} < 500) AS medium, count(*) FILTER ({n} >= 500 AND {n} < 800) AS long, count(*) FILTER ({n} >= 800) AS very_long, count(*) FILTER (regexp_matches(output, '[A-Za-z]{{3,}}')) AS \"foreign\", round(avg({n}), 6) AS mean_chars FROM sft_samples WHERE output IS NOT NULL GROUP BY 1",
        "extract_report": "SELECT pdf_name, count(*) AS pages, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars, (" + " + ".join(f"max(contains(text, {lit(h)})::INT)" for h in L.HERBS) + ")::INT AS herbs, round(1 - sum(length(regexp_replace(text, '[^一-鿿0-9A-Za-z，。！？、；：\\s]', '', 'g'))) / sum(length(text)), 6) AS garbage FROM pages GROUP BY 1",
        "step_counters": f"WITH s AS (SELECT CASE WHEN length(output) < 50 THEN 'short' WHEN len(list_filter({words(L.NOISE_WORDS)}, lambda w: contains(output, w))) > 0 THEN 'noise' WHEN {contents} THEN 'contents' WHEN regexp_matches(output, {rx(opened)}) AND length({rest}) < 100 THEN 'context' ELSE 'kept' END AS step FROM sft_samples WHERE output IS NOT NULL) SELECT step, count(*) AS n FROM s GROUP BY 1",
        "page_gaps": "SELECT g.*, f.page_count FROM (SELECT pdf_name, count(*) AS rows, count(DISTINCT number) AS numbers, max(number) AS last FROM pages WHERE number IS NOT NULL GROUP BY 1) g LEFT JOIN pdf_files f USING (pdf_name)",
        "source_rollup": "SELECT split, source, count(*) AS n, grouping_id(split, source)::INT AS level FROM sft_samples GROUP BY ROLLUP (split, source)",
        "late_rows": "SELECT source, count(*) FILTER (loaded_at > published_at + INTERVAL 7 DAYS) AS late, count(*) AS n FROM documents GROUP BY 1",
        "prefix_dedup_100": "SELECT sample_id, output FROM sft_samples QUALIFY row_number() OVER (PARTITION BY left(output, 100) ORDER BY sample_id) = 1",
        "prefix_dedup_150": "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, 150) ORDER BY doc_id) = 1",
        "train_val_split": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {key('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r",
        "ratio_mix": f"WITH b AS (SELECT sample_id, source FROM sft_samples WHERE source = 'pdf'), x AS (SELECT sample_id, source, row_number() OVER (ORDER BY {key('sample_id')}, sample_id) AS rn FROM sft_samples WHERE source = 'lecture') SELECT * FROM b UNION ALL SELECT sample_id, source FROM x WHERE rn <= floor((SELECT count(*) FROM b) * (1 - 0.9::DOUBLE) / 0.9::DOUBLE)",
        "chat_messages": f"SELECT sample_id, '<|im_start|>system' || chr(10) || {lit(_SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || output || '<|im_end|>' AS text FROM sft_samples WHERE output IS NOT NULL",
        "loss_mask": f"WITH c AS (SELECT sample_id, {clean('instruction || output')} AS t, {clean('instruction')} AS u FROM sft_samples WHERE output IS NOT NULL), i AS (SELECT sample_id, list_transform({tok('t')}, lambda p: length(p) + unicode(p))[1:384] AS ids, len({tok('u')}) AS pre FROM c), m AS (SELECT sample_id, ids, least(pre, len(ids)) AS p FROM i) SELECT sample_id, len(ids)::INT AS n, p::INT AS masked, (coalesce(list_sum(ids[p + 1:]), 0) - 100 * p)::BIGINT AS total FROM m WHERE len(ids) > 10",
        "prompt_build": f"WITH p AS (SELECT id, question, route_type, list_transform(coalesce(retrieved_texts, []), lambda x, i: '[' || i || '] ' || x) AS l FROM {_EVAL}) SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN route_type IS NOT NULL THEN '类型：' || route_type END, nullif(array_to_string(l, chr(10)), ''), '问题：' || question) AS prompt FROM p",
        "sample_families": "WITH c AS (SELECT chapter_id, nullif(regexp_extract(title, '^\\d+ (.+)$', 1), '') AS name, left(content, 60) AS body FROM chapters) SELECT chapter_id, '组成' AS category, name || '由哪些药组成？' AS instruction, name || '：' || body AS output FROM c WHERE name IS NOT NULL AND body IS NOT NULL UNION ALL SELECT chapter_id, '出处', name || '出自哪一章？', '第' || chapter_id || '章' FROM c WHERE name IS NOT NULL",
        "stream_closed": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
        "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM g), r AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTES AS b, count(*) AS n FROM s GROUP BY user_id, part) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS \"end\", n FROM r WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
        "stream_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }
