"""A property graph as frames of vertices and edges, and the questions asked of it.

Vertices are (id, type), edges (src, dst, relation); every traversal is an equi-join on src or dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def build(edges: list[tuple[DataFrame, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) from frames (src, dst) with their relation and the types of both ends.

    One edge per pair of ends, as in a simple directed graph: the first relation listed wins.  Where a
    frame has a column ``change`` it stays with the edge."""
    changes = any("change" in df.columns for df, *_ in edges)
    all_ = reduce(DataFrame.unionByName, [df.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.struct(F.lit(i).alias("ord"), F.lit(rel).alias("relation"), F.lit(s).alias("st"), F.lit(d).alias("dt"), (F.col("change") if "change" in df.columns else F.lit(None)).cast("string").alias("change")).alias("e")) for i, (df, rel, s, d) in enumerate(edges)])
    one = all_.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("e").alias("e"))
    vertices = one.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("e.st").alias("type")), F.struct(F.col("dst").alias("id"), F.col("e.dt").alias("type")))).alias("v")).groupBy("v.id").agg(F.min("v.type").alias("type"))
    return vertices, one.select("src", "dst", F.col("e.relation").alias("relation"), *([F.col("e.change").alias("change")] if changes else []))


def derivations(edges: DataFrame, relation: str = "derived_from") -> DataFrame:
    """(base, derived, change): what was derived from each vertex, with what the edge says changed.

    Edges (src, dst, relation, change) lead from what was derived to its base."""
    return edges.where(F.col("relation") == relation).select(F.col("dst").cast("string").alias("base"), F.col("src").cast("string").alias("derived"), "change")


def neighbours(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, n, list): sorted distinct ends of each key's edges, as one string."""
    g = edges.select(F.col(key).alias("key"), F.col(other).alias("o")).distinct().groupBy("key")
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("o")), lambda x: x.cast("string")), ",").alias("list"))


#: Members of a group that one part of the pairing join holds on its split side.
PART = 2_000


def pairs_sharing(edges: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """(a, b, n): pairs a < b of members with at least ``least`` groups in common.

    Members of fewer groups are left out first.  Pairs are made within a group only and combined before
    the shuffle; the members of a large group are dealt to parts, so that no task pairs a whole hub."""
    e = edges.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    enough = e.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(f"k >= {least}").select("m")
    e = e.join(enough, "m", "left_semi")
    parts = F.ceil(F.count(F.lit(1)).over(W.partitionBy("g")) / PART).cast("int")
    e = e.withColumn("parts", parts)
    a = e.select("g", F.col("m").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    b = e.select("g", F.col("m").alias("b"), F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("s"))
    return a.join(b, ["g", "s"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least}")


def holding_all(edges: DataFrame, wanted: DataFrame, group: str, member: str) -> DataFrame:
    """(query, g): groups that hold every member a query wants (relational division)."""
    need = wanted.select("query", "member").distinct()
    size = need.groupBy("query").agg(F.count(F.lit(1)).alias("k"))
    e = edges.select(F.col(group).alias("g"), F.col(member).alias("member")).distinct()
    return need.join(e, "member").groupBy("query", "g").agg(F.count(F.lit(1)).alias("n")).join(size, "query").where("n = k").select("query", "g")


def compare(edges: DataFrame, pairs: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, common, only_a, only_b) as sorted lists for pairs of groups."""
    sets = edges.select(F.col(group).alias("g"), F.col(member).alias("m")).groupBy("g").agg(F.sort_array(F.collect_set("m")).alias("s"))
    j = pairs.join(sets.select(F.col("g").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("g").alias("b"), F.col("s").alias("sb")), "b")
    text = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), ",")
    return j.select("a", "b", text(F.array_intersect("sa", "sb")).alias("common"), text(F.array_except("sa", "sb")).alias("only_a"), text(F.array_except("sb", "sa")).alias("only_b"))


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, mids, ends): distinct vertices one and two edges away, over edges (src, mid) and (mid, dst)."""
    m = first.select("src", "mid").distinct()
    e = m.join(second.select("mid", "dst").distinct(), "mid", "left")
    return e.groupBy("src").agg(F.countDistinct("mid").alias("mids"), F.countDistinct("dst").alias("ends"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): vertices by type and edges by relation."""
    return vertices.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("kind"), F.col("type").alias("name"), "n").unionByName(edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), "n"))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, hops): all that is reached from each vertex, by the fewest hops; with ``depth`` only what
    takes no more.

    Paths are joined end to end, so the rounds grow with the logarithm of the longest one; each is cut, and
    the last finds nothing new.  Cycles end, too: a longer way to what is reached is dropped."""
    seen = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("hops", F.lit(1)))
    mark = None
    while True:
        now = tuple(seen.agg(F.count(F.lit(1)), F.sum("hops")).first())
        if now == mark:
            return seen
        mark = now
        ahead = seen.select("src", F.col("dst").alias("mid"), F.col("hops").alias("h")).join(seen.select(F.col("src").alias("mid"), "dst", "hops"), "mid").select("src", "dst", (F.col("h") + F.col("hops")).alias("hops"))
        if depth is not None:
            ahead = ahead.where(f"hops <= {depth}")
        seen = cut(seen.unionByName(ahead).groupBy("src", "dst").agg(F.min("hops").alias("hops")))
