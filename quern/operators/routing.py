"""Routing questions to the kind of search that answers them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import one_of

# Words that tell the kind of a question, and question patterns cut from a search.
COMPARE = ("区别", "不同", "差异", "对比", "比较", "区分", "怎么分", "什么时候用哪个", "怎么选", "哪个好", "怎么辨别")
FORMULA = ("组成", "方剂", "配方", "药物", "有哪些药", "怎么用", "治什么", "能治", "什么时候能用", "适合什么")
HERB = ("含有", "含", "用到", "用的", "有.*药", "哪些方子有", "哪些方", "用在哪些", "配什么", "搭配", "一起用", "常配")
QUESTION = ("什么是", "解释一下", "解释", "的组成是什么", "的组成", "原文是什么", "原文", "有哪些", "有什么", "是什么", "区别是什么", "区别", "在主治上的", "在功能上的")
PUNCTUATION = "？?，,。.的！!"


def has_any(c: Column, words: Sequence[str]) -> Column:
    return c.rlike(one_of(words))


def rewritten(query: Column, patterns: Sequence[str] = QUESTION, signs: str = PUNCTUATION) -> Column:
    """The query without question patterns and outer signs; itself if nothing is left."""
    cut = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), patterns, query)
    cut = F.regexp_replace(cut, f"^[{signs}]+|[{signs}]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), query)


def clause_number(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"第(\d+)条", 1), F.lit("")).cast("int")


def names_in(query: Column, pattern: str) -> Column:
    """Distinct names in order of place, as a pattern finds them."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)))


def parts_of(query: Column) -> Column:
    """What stands on either side of a conjunction, without question patterns; two characters at least."""
    cut = lambda p: F.regexp_replace(reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), QUESTION, F.trim(p)), "^[？?，,的]+|[？?，,的]+$", "")
    return F.filter(F.transform(F.split(query, "和|与|跟|以及"), cut), lambda p: F.length(p) >= 2)


def longest_first(names: Column) -> Column:
    """Names by length, the longest first; equal ones in the order given."""
    keyed = F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("l"), i.alias("i"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def entities(query: Column, names: Column) -> Column:
    """The two things a comparison is about: known names, the longest first, else the parts of the query."""
    return F.slice(F.when(F.size(names) >= 2, longest_first(names)).otherwise(parts_of(query)), 1, 2)


def route(query: Column, names: Column, herbs: Sequence[str]) -> Column:
    """clause, comparison, formula, herb or semantic, tested in this order.

    ``names`` are the formula names found in the query.  A comparison needs two of them, or two parts of
    at least two characters around a conjunction."""
    parts = parts_of(query)
    comparison = has_any(query, COMPARE) & ((F.size(names) >= 2) | (F.size(parts) >= 2))
    begins = F.coalesce(F.startswith(query, F.try_element_at(names, F.lit(1))), F.lit(False))
    herb = has_any(query, herbs)
    asks_herb = has_any(query, HERB) | (F.contains(query, F.lit("方")) & herb)
    return (
        F.when(clause_number(query).isNotNull(), "clause")
        .when(comparison, "comparison")
        .when((has_any(query, FORMULA) | begins) & (F.size(names) > 0), "formula")
        .when(asks_herb & herb, "herb")
        .otherwise("semantic")
    )
