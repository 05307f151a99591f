"""Column functions for cleaning, judging and cutting text.

Every function takes and returns Columns built from Spark's own expressions, so plans stay in the
JVM and filters reach the scan.  Patterns, word lists and limits are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of web copies and printed pages, removed in this order; ``(?m)`` anchors at lines.
NOISE = (
    r"www\.[^\s]+",
    r"https?://[^\s]+",
    r"微信公众号[:：]?\s*\S*",
    r"关注公众号[:：]?\s*\S*",
    r"岐黄传承道法自然",
    r"伤寒V\d+",
    r"电子文稿[，,].*",
    r"公益传播[，,].*",
    r"—\s*\d+\s*—",
    r"-\s*\d+\s*-",
    r"第\s*\d+\s*页",
    r"(?md)^[ \t]*\d+[ \t]*$",
    r"版权所有",
    r"翻版必究",
    r"(?md)^.*\.{3,}\d+[ \t]*$",
)
# Abbreviations kept when foreign words are stripped.
KEEP = ("EKG", "EEG", "FDA", "AIDS", "HIV", "SARS", "ALS", "GMP", "DNA", "RNA", "CT", "MRI", "ICU", "CPR", "BMI", "BP", "HBV", "HCV")
# Sentence openers that depend on what stood before.
OPENERS = (
    "所以", "所以说", "因为", "但是", "而且", "因此", "由此", "这个", "这个方子", "这个条辨", "这个观念", "这个意思", "这个道理", "那这个", "那我们", "那你们", "那他",
    "实际上", "简单讲", "就是这样", "换句话说", "你看", "你想想", "你错了", "你想想看", "好，", "对，", "不对", "嗯，", "现在我们", "现在讲", "现在这个", "再来", "接下来", "下面",
)


def one_of(words: Sequence[str]) -> str:
    """An alternation of literals, the longest first so that it wins."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def strip(c: Column) -> Column:
    """Trim every kind of Unicode blank at both ends (plain trim knows only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_all(c: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def denoise(c: Column, patterns: Sequence[str] = NOISE) -> Column:
    return remove_all(c, patterns)


def normalize_page(c: Column, patterns: Sequence[str] = NOISE) -> Column:
    """Denoise, squeeze blank lines, trim each line and the whole."""
    x = F.regexp_replace(denoise(c, patterns), "\n{3,}", "\n\n")
    x = F.regexp_replace(x, r"(?md)^[ \t\r　]+|[ \t\r　]+$", "")
    return F.regexp_replace(x, r"^[\n \t\r　]+|[\n \t\r　]+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def keep_lines(c: Column, drop: Sequence[str]) -> Column:
    """Trimmed lines without blank ones and without those matching any pattern, joined again."""
    bad = "|".join(f"(?:{p})" for p in drop)
    trimmed = F.transform(lines(c), lambda x: F.regexp_replace(x, r"^[ \t\r　]+|[ \t\r　]+$", ""))
    return F.array_join(F.filter(trimmed, lambda x: (x != "") & ~x.rlike(bad)), "\n")


def strip_foreign(c: Column, keep: Sequence[str] = KEEP) -> Column:
    """Delete runs of Latin letters except listed abbreviations, squeeze blanks and line ends."""
    x = F.regexp_replace(c, rf"(?<![A-Za-z])(?!(?i:{one_of(keep)})(?![A-Za-z]))[A-Za-z]{{2,}}", "")
    x = F.regexp_replace(x, r"(?U)\b[a-zA-Z]\b", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"(?md)[ \t]+$", "")


def strip_episode(c: Column) -> Column:
    return F.regexp_replace(c, r"\[第\d+\s*集\]", "")


def count_of(c: Column, piece: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def is_contents_page(c: Column, short: int = 15, share: float = 0.7) -> Column:
    ls = lines(c)
    few = F.size(F.filter(ls, lambda x: F.length(F.trim(x)) < short))
    return (
        (count_of(c, "·····") > 3) | (count_of(c, "...") > 3) | c.rlike(r"\.{3,}\s*\d+") | c.rlike(r"[一二三四五六七八九十百千\d]+[、.]\s*[一-鿿]+\s*\.{3,}")
        | ((F.size(ls) > 5) & (few > F.size(ls) * share))
    )


def markers_in(c: Column, words: Sequence[str]) -> Column:
    """Number of distinct words that occur."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def early_marker(c: Column, words: Sequence[str], within: int = 200) -> Column:
    """Some word first occurs within the first characters."""
    return reduce(lambda a, b: a | b, [F.instr(c, w).between(1, within) for w in words])


def is_biography(c: Column, markers: Sequence[str], least: int = 2) -> Column:
    """So many of the markers occur."""
    return markers_in(c, markers) >= least


def is_not_teaching(c: Column, life: Sequence[str], other: Sequence[str], within: int = 200) -> Column:
    """A life story, a page of contents, or a marker of something else near the beginning."""
    return is_biography(c, life) | is_contents_page(c) | early_marker(c, other, within)


def length_quality(c: Column) -> Column:
    """short, medium or good by the number of characters; null below what is kept."""
    n = F.length(c)
    return F.when(c.isNull() | (n < 30), F.lit(None).cast("string")).when(n < 50, "short").when(n < 100, "medium").otherwise("good")


def paragraphs(c: Column, least: int = 50, most: int = 800) -> Column:
    """Paragraphs between blank lines, long ones cut at sentences, short ones dropped, overlong sentences truncated."""
    parts = F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda x: x != "")
    cut = F.flatten(F.transform(parts, lambda p: pack_sentences(p, most)))
    return F.transform(F.filter(cut, lambda x: F.length(x) >= least), lambda x: F.left(x, F.lit(most)))


def extraction_verdict(chars_per_page: Column) -> Column:
    """pass, warning or fail by the mean characters of a page."""
    return F.when(chars_per_page > 500, "pass").when(chars_per_page > 100, "warning").otherwise("fail")


def fix_opening(c: Column, openers: Sequence[str] = OPENERS, least: int = 200) -> Column:
    """Cut a dependent opener (the longest that fits) and the signs after it; null if too little is left."""
    opened = c.rlike(f"^(?:{one_of(openers)})")
    rest = F.regexp_replace(strip(F.regexp_replace(c, f"^(?:{one_of(openers)})", "")), r"^[，。、！？：；\s]+", "")
    return F.when(~opened, c).when(F.length(rest) >= least, rest)


def quality_ok(c: Column, oral: Sequence[str], noise: Sequence[str], domain: Sequence[str], least: int = 100, most: int = 2000) -> Column:
    """Length in bounds, few contents lines, not a bare clause, no noise word, some domain word."""
    ls = lines(c)
    contents = F.size(F.filter(ls, lambda x: F.trim(x).rlike(r"^(第\d+\s*集$|条辨\d)")))
    return F.length(c).between(least, most) & (contents <= 5) & ~((F.size(ls) <= 2) & ~c.rlike(one_of(oral))) & ~c.rlike(one_of(noise)) & c.rlike(one_of(domain))


def garbage_ratio(c: Column, normal: str = "一-鿿0-9A-Za-z，。！？、；：") -> Column:
    """Share of characters outside the normal ones."""
    return 1 - F.length(F.regexp_replace(c, f"[^{normal}]", "")) / F.greatest(F.length(c), F.lit(1))


def first_word(c: Column, words: Sequence[str], within: int | None = 400) -> Column:
    """The first word of the list (in its order) that occurs in the first characters, else null."""
    head = F.left(c, F.lit(within)) if within else c
    return F.try_element_at(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(head, w)), F.lit(1))


def first_aspect(c: Column, aspects: Sequence[tuple[str, Sequence[str]]], default: str = "general", within: int = 300) -> Column:
    """Name of the first aspect one of whose patterns matches the first characters."""
    head, out = F.left(c, F.lit(within)), None
    for name, patterns in aspects:
        hit = head.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def content_type(c: Column, meridians: Sequence[str], herbs: Sequence[str], suffix: str = "汤散丸饮煎") -> Column:
    """Kind of a paragraph by how it begins: clause, formula, pattern, herb or general."""
    t = strip(c)
    return (
        F.when(t.rlike("^[一二三四五六七八九十百零]{1,4}[：:]") | F.left(c, F.lit(20)).rlike(r"第\d+条"), "clause")
        .when(t.rlike(rf"^\d{{1,3}} +[一-鿿].*?[{suffix}]"), "formula")
        .when(F.left(c, F.lit(50)).rlike(one_of(meridians)) & F.left(c, F.lit(100)).rlike("证|病"), "pattern")
        .when(F.left(c, F.lit(50)).rlike(one_of(herbs)), "herb")
        .otherwise("general")
    )


def first_sentence(c: Column) -> Column:
    return F.element_at(F.split(c, "[。！？\n]"), 1)


def instruction(c: Column, meridians: Sequence[str], herbs: Sequence[str], suffix: str = "汤散丸饮煎") -> Column:
    """A question that the paragraph answers, by its kind; else by its first sentence."""
    t, kind = strip(c), content_type(c, meridians, herbs, suffix)
    clause = F.coalesce(F.nullif(F.regexp_extract(t, "^([一二三四五六七八九十百零]{1,4})[：:]", 1), F.lit("")), F.nullif(F.regexp_extract(F.left(c, F.lit(20)), r"第(\d+)条", 1), F.lit("")))
    formula = F.regexp_extract(t, rf"^\d{{1,3}} +([一-鿿].*?[{suffix}])", 1)
    first = first_sentence(c)
    return (
        F.when(kind == "clause", F.format_string("请解释第%s条的原文含义。", clause))
        .when(kind == "formula", F.format_string("请解释%s的组成和主治。", formula))
        .when(kind == "pattern", F.format_string("请解释%s的证候特点和治疗原则。", first_word(c, meridians, 50)))
        .when(kind == "herb", F.format_string("请介绍%s的应用。", first_word(c, herbs, 50)))
        .when(F.length(first) > 5, F.format_string("请讲解以下知识：%s。", F.left(first, F.lit(30))))
        .otherwise("请讲解相关的知识。")
    )


def pack_sentences(c: Column, most: int = 800, least: int = 0, ends: str = "。") -> Column:
    """Chunks of whole sentences, filled greedily up to a size; shorter ones than ``least`` go.

    A short text is one chunk.  The loop is an aggregate over the sentences, inside the plan."""
    parts = F.split(c, f"(?<=[{ends}])")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        flush = (F.length(acc["cur"]) + F.length(s) > most) & (acc["cur"] != "")
        return F.struct(F.when(flush, F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]).alias("done"), F.when(flush, s).otherwise(F.concat(acc["cur"], s)).alias("cur"))

    packed = F.aggregate(parts, zero, step, lambda a: F.when(strip(a["cur"]) != "", F.concat(a["done"], F.array(strip(a["cur"])))).otherwise(a["done"]))
    whole = F.when(F.length(c) <= most, F.array(c)).otherwise(packed)
    return F.filter(whole, lambda x: F.length(x) >= least)


def sections(c: Column, heading: str = r"(?:[一二三四五六七八九十百零]{1,4}[：:]|\d{1,3} +[一-鿿].*?[汤散丸饮煎])", untitled: str = "未分类") -> Column:
    """(title, content) of each section beginning with a heading at a line's start; what stands before
    the first one goes, and a text without heading is one untitled section."""
    marked = F.regexp_replace(c, f"(?md)^({heading})", "\u0001$1")
    parts = F.slice(F.split(marked, "\u0001", -1), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001", -1)) - 1, F.lit(0)))
    cut = F.transform(parts, lambda p: F.struct(strip(F.regexp_extract(p, f"^{heading}", 0)).alias("title"), strip(p).alias("content")))
    return F.when(F.contains(marked, F.lit("\u0001")), cut).when(strip(c) != "", F.array(F.struct(F.lit(untitled).alias("title"), strip(c).alias("content")))).otherwise(F.array().cast("array<struct<title:string,content:string>>"))


def line_segments(c: Column, starters: Sequence[str], least: int = 50, most: int = 500, final: int = 80) -> Column:
    """Segments of lines: a new one begins at a starter line once the current is long enough, or when it
    is full; overlong ones are cut at sentences; what stays too short goes."""
    ls = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    starts = "|".join(f"(?:{p})" for p in starters)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def add(cur: Column, x: Column) -> Column:
        return F.when(cur == "", x).otherwise(F.concat(cur, F.lit("\n"), x))

    def step(a: Column, x: Column) -> Column:
        cut = F.left(x, F.lit(30)).rlike(starts) & (a["n"] >= least)
        done = F.when(cut, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        cur, n = add(F.when(cut, "").otherwise(a["cur"]), x), F.when(cut, 0).otherwise(a["n"]) + F.length(x)
        full = n >= most
        return F.struct(F.when(full, F.concat(done, F.array(cur))).otherwise(done).alias("done"), F.when(full, "").otherwise(cur).alias("cur"), F.when(full, 0).otherwise(n).cast("int").alias("n"))

    paras = F.aggregate(ls, zero, step, lambda a: F.when(a["n"] >= least, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    fine = F.flatten(F.transform(paras, lambda p: pack_sentences(p, 800, 0, "。！？")))
    return F.filter(F.transform(fine, strip), lambda x: F.length(x) >= final)


def cjk_words(c: Column) -> Column:
    """Distinct runs of two or more ideographs, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[一-鿿]{2,}"), F.lit(0)))


def bigrams(c: Column) -> Column:
    """Search tokens: all pairs of neighbouring letters or digits within a run, in small letters."""
    t = F.regexp_replace(F.lower(c), "[^0-9a-z一-鿿]+", " ")
    chars = F.array(F.filter(F.split(t, ""), lambda x: x != ""))  # bound once, so the work is linear in the text
    pairs = F.transform(chars, lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat(x, y)))
    return F.filter(pairs[0], lambda p: ~F.contains(p, F.lit(" ")))


def chinese_number(n: Column) -> Column:
    """0..999 in Chinese numerals; other numbers as digits."""
    d = F.array(*[F.lit(x) for x in "零一二三四五六七八九"])
    at = lambda x: F.element_at(d, (x + 1).cast("int"))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    below = lambda lead: F.concat(F.when((t == 1) & ~lead, "十").when(t > 0, F.concat(at(t), F.lit("十"))).when((t == 0) & lead & (u > 0), "零").otherwise(""), F.when(u > 0, at(u)).otherwise(""))
    return (
        F.when((n < 0) | (n > 999), n.cast("string")).when(n == 0, "零")
        .when(n >= 100, F.concat(at(h), F.lit("百"), below(F.lit(True)))).otherwise(below(F.lit(False)))
    )


def html_text(c: Column, drop: Sequence[str] = ("nav", "menu", "login", "copyright")) -> Column:
    """Text of an HTML page by lines: scripts, styles, comments and tags go, common entities are
    resolved, blank lines and lines holding a navigation word are dropped."""
    x = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return keep_lines(x, [f"(?i){one_of(drop)}"])
