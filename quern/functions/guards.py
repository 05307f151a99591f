"""Guards before and after an answer, and parsers of what models and services return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals and units of doses, words of prescribing, of emergencies asked about and answered, and
# signs of cooking directions.
NUMERAL = "[0-9０-９一二三四五六七八九十百千万两半]"
DOSE = NUMERAL + r"+\s*(?:克|钱|两|斤|g|G|ml|毫升|片|粒|枚|付|剂|碗|升)"
DOSE_MENTION = NUMERAL + r"+\s*(?:克|钱|两|斤|g|G|ml|毫升|片|粒|枚|付|剂|碗|升|合|斗)"
DOSE_WORDS = r"剂量|用量|用法|一次\s*\d+|每次\s*\d+|开方|处方|抓药|煎服|水煎服|吃点药|开点药|开个药|给你开|用药治疗|用药建议|吃这个药"
DOSE_QUESTION = "多少克|多少钱|多少两|几克|几钱|剂量|用量|怎么吃|怎么服|吃多少|一次吃|每次吃|一日吃|开个方|开方|处方|给我开|帮我开|药方|抓药|煎药|熬药|服用方法"
EMERGENCY_QUESTION = (
    "脑溢血|脑出血|急性心梗|心肌梗死|休克|大出血|昏迷不醒|抽搐不止|呼吸困难|剧烈胸痛|胸口剧痛|快不行|急救|马上要晕|晕倒在地|中风了|脑中风|中风发作|急性中风|"
    "流血不止|血止不住|止不住|鼻血不止|流鼻血.*不止|吐血|咯血"
)
EMERGENCY = "脑溢血|脑出血|心梗|心肌梗死|休克|大出血|昏迷|抽搐|呼吸困难|剧烈胸痛"
COOKING = "上四味|以水|煮取|温服|煎服|去滓|内诸药|为散|杵捣|杵为"


def input_guard(question: Column, dose: str = DOSE_QUESTION, emergency: str = EMERGENCY_QUESTION) -> Column:
    """Why a question is stopped before retrieval: dose first, then emergency, else null."""
    return F.when(question.rlike(dose), "dose").when(question.rlike(emergency), "emergency")


def question_ok(question: Column, most: int = 500) -> Column:
    return (F.length(question) <= most) & (F.trim(question) != "")


def checked_citations(answer: Column, valid: Column) -> Column:
    """The answer without references to clauses that were not retrieved; unchanged if none was.

    One replacement per distinct wrong number, longest form first."""
    pattern = r"[【\[]\s*第\s*(\d+)\s*条\s*[】\]]|第\s*(\d+)\s*条"
    cited = F.array_distinct(F.concat(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), F.regexp_extract_all(answer, F.lit(pattern), F.lit(2))))
    known = F.transform(valid, lambda x: x.cast("string"))
    wrong = F.filter(cited, lambda x: (x != "") & ~F.exists(known, lambda v: v == F.regexp_replace(x, "^0+(?=.)", "")))
    fixed = F.aggregate(wrong, answer, lambda a, n: F.regexp_replace(F.regexp_replace(a, F.concat(F.lit(r"[【\[]\s*第\s*"), n, F.lit(r"\s*条\s*[】\]]")), F.lit("")), F.concat(F.lit(r"第\s*"), n, F.lit(r"\s*条")), F.lit("")))
    return F.when((F.size(valid) > 0) & (F.size(wrong) > 0), fixed).otherwise(answer)


def with_notices(answer: Column, notice: str, urgent: str) -> Column:
    """Append a notice after doses and another after emergencies, each once."""
    dose = answer.rlike(f"{DOSE}|{DOSE_WORDS}") & ~F.contains(answer, F.lit(notice))
    emergency = answer.rlike(EMERGENCY) & ~F.contains(answer, F.lit(urgent))
    return F.concat(answer, F.when(dose, notice).otherwise(""), F.when(emergency, urgent).otherwise(""))


def masked_doses(text: Column, mask: str = "〔剂量从略〕", rest: str = "（煎服方法从略）") -> Column:
    """Mask doses and cut at the first cooking direction."""
    masked = F.regexp_replace(text, DOSE_MENTION, mask)
    return F.when(masked.rlike(COOKING), F.concat(F.element_at(F.split(masked, COOKING), 1), F.lit(rest))).otherwise(masked)


def judge_score(raw: Column) -> Column:
    """Score of a judge's reply: after its label, or x/5 (not clamped), or a leading number, else 0."""
    number = lambda p, g=1: F.nullif(F.regexp_extract(raw, p, g), F.lit("")).cast("double")
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(0.0), c)))
    return F.coalesce(clamp(number(r"分数[：:]\s*(\d+(?:\.\d+)?)")), number(r"(\d+(?:\.\d+)?)\s*/\s*5"), clamp(number(r"^\s*(\d+(?:\.\d+)?)")), F.lit(0.0))


def judged(raw: Column, error: Column | None = None) -> Column:
    """(score, error) of one judging call in a batch: a failed or missing reply scores -1 and keeps its error."""
    failed = raw.isNull() if error is None else raw.isNull() | error.isNotNull()
    why = F.lit("no reply") if error is None else F.coalesce(error, F.lit("no reply"))
    return F.struct(F.when(failed, -1.0).otherwise(judge_score(raw)).alias("score"), F.when(failed, why).alias("error"))


def judge_reason(raw: Column) -> Column:
    found = F.trim(F.regexp_extract(raw, r"(?s)理由[：:]\s*(.+)", 1))
    return F.when(found != "", found).otherwise(F.left(raw, F.lit(200)))


def sse_answer(body: Column) -> Column:
    """Answer text of a server-sent event body: chunks of its data lines, in order."""
    data = F.transform(F.filter(F.split(body, "\n"), lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.from_json(F.trim(F.substr(x, F.lit(6))), "type string, content string, latency double"))
    return F.array_join(F.transform(F.filter(data, lambda e: e["type"] == "chunk"), lambda e: F.coalesce(e["content"], F.lit(""))), "")


def sse_latency(body: Column) -> Column:
    """Latency of the last closing event, or null."""
    data = F.transform(F.filter(F.split(body, "\n"), lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.from_json(F.trim(F.substr(x, F.lit(6))), "type string, content string, latency double"))
    done = F.filter(data, lambda e: e["type"] == "done")
    return F.when(F.size(done) > 0, F.try_element_at(done, F.lit(-1))["latency"])
