"""Matching text against ordered term lists.

Lists are small, given as Python sequences or as frames of a checked size; order decides ties and is
always carried as ``ord``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import one_of

NEGATIONS = "不没未别无"
#: Terms that a lexicon may have to be compared with every text by broadcast; beyond, use matches_by_pattern.
MOST_TERMS = 10_000


def lexicon(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """A term table with its order: rows of (term, ...) become (ord, term, ...)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {columns}")


def matches(texts: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """Texts joined with every term they contain.  The terms are broadcast, their number checked."""
    n = terms.limit(MOST_TERMS + 1).count()
    if n > MOST_TERMS:
        return matches_by_pattern(texts, text, terms, term)
    return texts.join(F.broadcast(terms), F.contains(F.col(text), F.col(term)))


def matches_by_pattern(texts: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """The same for large lexicons: substrings as long as some term meet the terms in an equi-join.

    Only the lengths that terms have come to the driver, so no term is lost, however long it is."""
    t = F.col(text)
    sizes = [r[0] for r in terms.select(F.length(term)).distinct().collect() if r[0]]

    def pieces(n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    cuts = [pieces(n) for n in sorted(sizes)]
    grams = F.array_distinct(F.flatten(F.array(*cuts))) if cuts else F.array().cast("array<string>")
    return texts.withColumn("_gram", F.explode(grams)).join(terms, F.col("_gram") == F.col(term)).drop("_gram")


def negated(text: Column, term: str, signs: str = NEGATIONS) -> Column:
    """Some occurrence of the term follows a negation."""
    return text.rlike(f"[{signs}]{one_of([term])}")


def found_terms(text: Column, terms: Sequence[str], skip_negated: bool = True) -> Column:
    """Terms that occur and are not negated, in the list's order."""
    hits = [F.when(F.contains(text, F.lit(t)) & (~negated(text, t) if skip_negated else F.lit(True)), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits))


def expand(query: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Append to the query the formal word of every colloquial one it has, unless it is there already."""
    table = F.array(*[F.struct(F.lit(a).alias("said"), F.lit(b).alias("formal")) for a, b in pairs])
    return F.aggregate(table, query, lambda q, p: F.when(F.contains(query, p["said"]) & ~F.contains(q, p["formal"]), F.concat(q, F.lit(" "), p["formal"])).otherwise(q))


def symptoms(text: Column, formal: Sequence[str], colloquial: Sequence[tuple[str, str]]) -> Column:
    """Formal words of what the text complains of: formal ones that occur, then those of colloquial ones;
    negated ones are left out, and a formal word is named once."""
    said = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(a)) & ~negated(text, a), F.lit(b)) for a, b in colloquial]))
    return F.array_distinct(F.concat(found_terms(text, formal), said))


def votable(text: Column, formal: Sequence[str], colloquial: Sequence[tuple[str, str]], terms: Sequence[str], long: int = 4) -> Column:
    """Symptoms that a vote knows, then its long terms as they stand in the text, the longest first."""
    known = F.array_intersect(symptoms(text, formal, colloquial), F.array(*[F.lit(t) for t in terms]))
    scan = sorted((t for t in terms if len(t) >= long), key=len, reverse=True)
    return F.array_distinct(F.concat(known, found_terms(text, scan, False)))


def clause_list(defining: Column, treating: Column) -> Column:
    """The clauses of a concept: those that define it, then those that treat it, each once."""
    return F.array_distinct(F.concat(defining, treating))


def expand_concept(query: Column, found: Column, keywords: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The query with the keywords of its concept (``found``) that it does not hold yet."""
    out = query
    for name, words in keywords:
        grown = F.aggregate(F.array(*[F.lit(w) for w in words]).cast("array<string>"), query, lambda q, w: F.when(F.contains(q, w), q).otherwise(F.concat(q, F.lit(" "), w)))
        out = F.when(found == name, grown).otherwise(out)
    return out


def without(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), words, text)


def concept(query: Column, concepts: Sequence[str], question_words: Sequence[str], endings: str = "证病") -> Column:
    """The concept a query is about: equal to it or to its core, else the first contained in it, else
    the first whose stem is contained in its core."""
    core = F.trim(without(query, question_words))
    same = F.coalesce(*[F.when((core == c) | (query == c), F.lit(c)) for c in concepts])
    held = F.coalesce(*[F.when(F.contains(query, F.lit(c)), F.lit(c)) for c in concepts])
    stems = [(c, c.rstrip(endings)) for c in concepts]
    stem = [F.when(F.contains(core, F.lit(s)), F.lit(c)) for c, s in stems if len(s) >= 2]
    return F.coalesce(same, held, *stem)


def concept_by_symptoms(symptoms: Column, rules: Sequence[tuple[Sequence[str], str]], least: float = 0.5) -> Column:
    """The concept of the rule that the symptoms fulfil to the largest part, the earliest of equals."""
    scored = F.array(*[F.struct((F.size(F.array_intersect(symptoms, F.array(*[F.lit(x) for x in need]))) / len(set(need))).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (need, name) in enumerate(rules)])
    best = F.array_max(F.filter(scored, lambda x: x["s"] >= least))
    return best["name"]


def best_term(texts: DataFrame, key: str, text: str, terms: DataFrame, common: Sequence[str] = ()) -> DataFrame:
    """The best term each text contains: not a common one if another occurs, then the longest, the most
    frequent, the earliest in the list.  One row per text that has any."""
    n = (F.length(text) - F.length(F.replace(F.col(text), F.col("term"), F.lit("")))) / F.length("term")
    hit = matches(texts.select(key, text), text, terms).select(key, "term", "ord", n.cast("int").alias("freq"), F.length("term").alias("len"), F.col("term").isin(*common).alias("common"))
    w = W.partitionBy(key).orderBy("common", F.desc("len"), F.desc("freq"), "ord")
    return hit.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "term", "freq")
