"""Key phrases of a paragraph, and instructions named after what it is about."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_word, one_of, strip

QUOTES = "“”‘’「」『』\"'()\\[\\]（）"
EDGE = "，。、！？：； \t\n"
# Words that spoil a phrase.  None may begin it; those of two characters or more may not stand in it.
STOP = (
    "你", "我", "他", "她", "它", "你们", "我们", "他们",
    "女儿", "儿子", "先生", "太太", "妈妈", "爸爸", "老师", "病人", "患者", "小孩子", "小孩子家",
    "所以", "因为", "但是", "而且", "因此", "然后", "实际上", "简单讲", "就是说", "换句话说", "同样的", "反正", "总之", "不过",
    "怎么开", "怎么做", "怎么用", "怎么办", "怎么回事", "好不好", "对不对", "是不是", "行不行", "为什么", "怎么办呢", "怎么样子", "什么样", "问题", "碰到", "遇到", "就碰到",
    "咬", "打", "骂", "叫", "说", "想", "看", "小心", "注意", "记得", "知道", "了解", "好", "对", "是", "嗯", "哦", "啊",
    "石灰用", "很毒", "很凶", "很厉害", "将来", "以后", "有时候", "有时候要",
)
# Particles that may not begin a phrase, and persons that may not stand in it.
START = ("了", "到", "去", "在", "就", "那", "这", "如果", "当", "地", "条", "（", "(", '"', "“", "‘")
PERSONS = ("你", "我", "他", "她", "咱们", "大家")
_INSIDE = tuple(w for w in STOP if len(w) >= 2)


def first_sentences(c: Column, n: int = 2, most: int = 300) -> Column:
    """The first sentences of the first line, without a clause number."""
    line = F.regexp_replace(strip(F.element_at(F.split(c, "\n"), 1)), r"^[一二三四五六七八九十百千]+[：:]\s*", "")
    return F.left(F.array_join(F.slice(F.split(line, "(?<=[。！？])"), 1, n), ""), F.lit(most))


def cleaned(phrase: Column, most: int = 15) -> Column:
    """Without quotes and outer signs; an overlong one is cut at its first sign after three characters."""
    x = F.regexp_replace(F.regexp_replace(phrase, f"[{QUOTES}]", ""), f"^[{EDGE}]+|[{EDGE}]+$", "")
    x = F.regexp_replace(x, "，{2,}", "，")
    return F.when(F.length(x) > most, F.left(F.regexp_replace(x, "^(.{3}[^，、：；]*)[，、：；].*$", "$1"), F.lit(most))).otherwise(x)


def valid(phrase: Column, terms: Sequence[str], domain: str) -> Column:
    """Three to fifteen characters, no talk, no sentence or quotation, and something of the domain in it."""
    inside = F.length(F.regexp_replace(phrase, f"[^{domain}]", ""))
    commas = F.length(phrase) - F.length(F.replace(phrase, F.lit("，"), F.lit("")))
    return (
        F.length(phrase).between(3, 15) & ~phrase.rlike(f"^(?:{one_of((*STOP, *START))})") & ~phrase.rlike(one_of((*_INSIDE, *PERSONS))) & phrase.rlike("[一-鿿]") & ~phrase.rlike("[。！？；]") & ~phrase.rlike(f"[{QUOTES}]")
        & (inside >= 1) & ((F.length(phrase) <= 6) | (inside >= 2)) & ~phrase.rlike("^[一二三四五六七八九十百千万0-9]+$") & (commas <= 1) & phrase.rlike(one_of(terms))
    )


def key_phrase(text: Column, terms: Sequence[str], domain: str, named: Sequence[Sequence[str]] = ()) -> Column:
    """The first of several readings of the first sentence that makes a valid phrase, else null: what stands
    before a copula, an attribute with its noun, what is talked of, the first known word of each list
    ``named``, and the words the sentence begins with."""
    s = first_sentences(text, 1)
    part = lambda p, g=1: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    of = F.concat(part("^(.{2,8})的(.{2,6})", 1), F.lit("的"), part("^(.{2,8})的(.{2,6})", 2))
    known = [first_word(s, ws, None) for ws in (named or (terms,))]
    tries = F.array_compact(F.array(part("^(.{2,12})[是就]"), of, part("(?:讲到|谈到|说到|提到|讲|谈)(.{2,12})"), *known, part("^([一-鿿]{4,10})")))
    return F.try_element_at(F.filter(F.transform(tries, cleaned), lambda x: valid(x, terms, domain)), F.lit(1))


def organ_aspect(text: Column, organ: str, aspects: Sequence[tuple[str, str]], within: int = 400) -> Column:
    """What a passage about an organ is about: the description of the first keyword in its first characters."""
    head, out = F.left(text, F.lit(within)), None
    for word, said in aspects:
        out = F.when(F.contains(head, F.lit(word)), said) if out is None else out.when(F.contains(head, F.lit(word)), said)
    default = F.lit(f"{organ}的主要生理功能和病理表现")
    return default if out is None else out.otherwise(default)


def instruction_by_level(text: Column, levels: Sequence[tuple[Column, str]], default: str) -> Column:
    """The first level whose topic is found fills its template ({}), else the default."""
    made = [F.concat(*[x for i, p in enumerate(t.split("{}")) for x in (([topic] if i else []) + [F.lit(p)])]) for topic, t in levels]
    return reduce(lambda a, b: F.coalesce(a, b), [*made, F.lit(default)])
