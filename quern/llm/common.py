"""Plumbing shared by the operators: lineage cuts, class tables, linking in sorted order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, spread  # noqa: F401 - used as common.cut, common.spread
from . import kernels as K

#: Rows of one sorted group that a task holds at once; larger groups are joined by Spark.
HELD_ROWS = 50_000
#: Pairs that a task makes of one group at the deepest level; larger groups are joined by Spark.
HELD_PAIRS = 1_000_000
#: Parts into which either side of such a join is salted.
SALT = 8
#: Share of all rows from which a group is hot, rows of the sample that it must be seen in, and share of records sampled to see it.
HOT_SHARE, HOT_SEEN, SAMPLED = 0.005, 200, 0.01


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The named column cast to the kind it must have."""
    return F.col(f"`{name}`").cast(kind)


def prefix_of(label: str | Column, bits: int) -> Column:
    """The first bits of a 64-bit label."""
    return F.shiftrightunsigned(label, 64 - bits)


def hot_labels(rows: DataFrame, bits: int) -> list[int]:
    """Prefixes that hold at least HOT_SHARE of the given sample of rows; at most 1 / HOT_SHARE of them.

    They only decide how the work is spread, never what is found."""
    counts = rows.groupBy(prefix_of("label", bits).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "p").limit(int(1 / HOT_SHARE)).collect()
    total = rows.count() if top and top[0]["n"] >= HOT_SEEN else 0
    return [r["p"] for r in top if total and r["n"] >= max(HOT_SEEN, total * HOT_SHARE)]


def sorted_by_label(rows: DataFrame, bits: int, hot: list[int] = (), spread: Column | None = None) -> DataFrame:
    """Rows (label, node) so that labels with equal first bits share a partition, in order of label.

    The order is that of signed 64-bit numbers; equal prefixes are adjacent in it.  Rows of a hot
    prefix are spread further by a second key."""
    p = prefix_of("label", bits)
    keys = [p, F.when(p.isin(list(hot)), spread).otherwise(F.lit(0).cast("long"))] if hot else [p]
    return rows.repartition(*keys).sortWithinPartitions("label", "node")


def merged_batches(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(label, node) arrays; repeats of a whole row next to each other are dropped."""
    held, n, last = [], 0, None

    def flush():
        lab = np.concatenate([a for a, _ in held])
        node = np.concatenate([b for _, b in held])
        same = np.zeros(len(lab), dtype=bool)
        same[1:] = (lab[1:] == lab[:-1]) & (node[1:] == node[:-1])
        if last is not None and len(lab):
            same[0] = (lab[0], node[0]) == last
        return lab[~same], node[~same]

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
        if n >= rows:
            lab, node = flush()
            held, n = [], 0
            if len(lab):
                last = (lab[-1], node[-1])
                yield lab, node
    if held:
        lab, node = flush()
        if len(lab):
            yield lab, node


def runs(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole runs of rows with an equal first column, by which the rows are sorted.  A run of more
    than HELD_ROWS rows comes in parts and marked True."""
    held, n, large = [], 0, None

    def parts(last: bool):
        nonlocal held, n, large
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column(0).to_numpy()
        at = 0
        if large is not None:
            at = int(np.searchsorted(key, large, "right"))
            if at:
                yield t.slice(0, at), True
            if at < len(key):
                large = None
        k = len(key) if last else max(at, int(np.searchsorted(key, key[-1], "left")))
        if k > at:
            yield t.slice(at, k - at), False
        if k < len(key) and len(key) - k > HELD_ROWS:
            yield t.slice(k), True
            large, k = key[-1], len(key)
        t = t.slice(k)
        held, n = t.to_batches() if t.num_rows else [], 0

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield from parts(False)
    if held:
        yield from parts(True)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])
PAIRS_DDL = "a long, b long, hot boolean"


def _cuts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs, their lengths, and the run of each row."""
    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    s = np.flatnonzero(first)
    return s, np.diff(np.append(s, len(x))), np.cumsum(first) - 1


def _lagged(run: np.ndarray, node: np.ndarray, side: np.ndarray | None):
    """All pairs of rows of one run (of unlike sides, if sides are given), lag by lag."""
    idx = np.arange(len(run))
    d = 1
    while len(idx):
        idx = idx[idx + d < len(run)]
        idx = idx[run[idx] == run[idx + d]]
        at = idx if side is None else idx[side[idx] != side[idx + d]]
        if len(at):
            yield node[at], node[at + d]
        d += 1


class Linker:
    """Turns a stream of rows sorted by label into pairs of nodes.

    ``levels`` are numbers of leading bits, shortest first: depths of the suffix tree.  In a group
    of rows that agree to the first depth all pairs are made if they are at most ``small``; else
    the group is split at the next depth, and so on.  At the last depth all pairs are made; a group
    too large for one task leaves as single rows marked hot, which hot_pairs() joins.
    With ``sided`` the lowest bit of a node tells its side, and pairs are of unlike sides."""

    def __init__(self, levels: tuple[int, ...], small: int, sided: bool):
        self.levels, self.small, self.sided = levels, small, sided

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = node = np.zeros(0, dtype=np.int64)
        self.big: dict[int, int] = {}  # depth -> prefix of a group already known to be large
        for a, b in merged_batches(batches):
            lab, node = np.concatenate([lab, a]), np.concatenate([node, b])
            p = lab.view(np.uint64) >> np.uint64(64 - self.levels[0])
            open_at = len(p) - int((p[::-1] != p[-1]).argmax()) if (p != p[-1]).any() else 0
            if len(p) - open_at > HELD_ROWS:  # close what can be closed of the open group
                open_at = self._inner(lab, open_at)
            if open_at:
                yield from self._pairs(lab[:open_at], node[:open_at])
                lab, node = lab[open_at:], node[open_at:]
            if len(lab) > HELD_ROWS:  # one run at the last depth
                yield self._hot(lab, node)
                self.big[self.levels[-1]] = int(lab.view(np.uint64)[-1] >> np.uint64(64 - self.levels[-1]))
                lab, node = lab[:0], node[:0]
        if len(lab):
            yield from self._pairs(lab, node)

    def _inner(self, lab: np.ndarray, open_at: int) -> int:
        """Where the open group can be cut: before the last group of the shortest depth that a task
        can hold.  Only depths whose open group is larger than that are marked."""
        start = open_at
        for bits, deeper in zip(self.levels, self.levels[1:]):
            self.big[bits] = int(lab.view(np.uint64)[-1] >> np.uint64(64 - bits))
            p = lab.view(np.uint64) >> np.uint64(64 - deeper)
            start = max(open_at, len(p) - int((p[::-1] != p[-1]).argmax())) if (p != p[-1]).any() else open_at
            if len(p) - start <= HELD_ROWS:
                break
        return start

    def _hot(self, lab, node) -> pa.RecordBatch:
        return K.table(PAIRS, lab, node, np.ones(len(lab), dtype=bool))

    def _pairs(self, lab: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        for depth, bits in enumerate(self.levels):
            if not len(lab):
                return
            p = lab.view(np.uint64) >> np.uint64(64 - bits)
            _, size, run = _cuts(p)
            if self.sided:
                one = np.bincount(run, weights=node & 1, minlength=len(size)).astype(np.int64)
                made = one * (size - one)
            else:
                made = size * (size - 1) // 2
            was_big = np.zeros(len(size), dtype=bool)
            if bits in self.big:
                was_big = p[np.append(0, np.cumsum(size)[:-1])] == np.uint64(self.big[bits])
            last = depth == len(self.levels) - 1
            take = (made <= (HELD_PAIRS if last else self.small)) & ~was_big
            use = (take & (made > 0))[run]
            if use.any():
                side = (node[use] & 1) if self.sided else None
                for x, y in self._make(run[use], node[use], side):
                    keep = x != y
                    x, y = x[keep], y[keep]
                    if len(x):
                        yield K.table(PAIRS, np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), dtype=bool))
            rest = (~take & ((made > 0) | was_big))[run]
            lab, node = lab[rest], node[rest]
        if len(lab):
            yield self._hot(lab, node)

    @staticmethod
    def _make(run, node, side):
        """Pairs of many small runs by lag; a long run by blocks."""
        s, size, r = _cuts(run)
        long = size > 256
        small = ~long[r]
        yield from _lagged(r[small], node[small], None if side is None else side[small])
        for i in np.flatnonzero(long):
            part = slice(s[i], s[i] + size[i])
            x = node[part]
            if side is None:
                for j in range(len(x) - 1):
                    yield np.full(len(x) - 1 - j, x[j]), x[j + 1 :]
            else:
                one, two = x[side[part] == 1], x[side[part] == 0]
                for v in one:
                    yield np.full(len(two), v), two


def linked(rows: DataFrame, levels: tuple[int, ...], small: int, sided: bool, sample: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b, n) of nodes with the number of groups they were met in.

    ``sample`` are the rows of a sample of the records.  Groups that are hot in it at the first depth
    are partitioned by the next depth, so that its groups stay whole, and those that are hot at the
    last depth go straight to the salted join; groups that grow beyond what a task holds
    without having been seen in the sample leave it as single rows and are joined alike."""
    first, last = levels[0], levels[-1]
    wide = hot_labels(sample, first) if sample is not None else []
    deep = hot_labels(sample, last) if wide else []
    straight = rows.where(prefix_of("label", last).isin(deep)) if deep else None
    rest = rows.where(~prefix_of("label", last).isin(deep)) if deep else rows
    spread = prefix_of("label", levels[min(1, len(levels) - 1)])
    found = cut(sorted_by_label(rest, first, wide if last != first else [], spread).mapInArrow(Linker(levels, small, sided), PAIRS_DDL))
    made = found.where("not hot").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    hot = found.where("hot").select(prefix_of("a", last).alias("p"), F.col("b").alias("node"))
    if straight is not None:
        hot = hot.unionByName(straight.select(prefix_of("label", last).alias("p"), "node"))
    hot = hot.distinct()
    if straight is None and hot.isEmpty():
        return made
    return made.unionByName(hot_pairs(hot, sided)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def hot_pairs(hot: DataFrame, sided: bool) -> DataFrame:
    """All pairs of nodes of one group, as a salted equi-join: every row of one side goes to SALT
    parts, the other side is spread over them, so that no task holds a whole group."""
    left = hot.where("(node & 1) = 1") if sided else hot
    right = hot.where("(node & 1) = 0") if sided else hot
    left = left.select("p", F.col("node").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    right = right.select("p", F.col("node").alias("y"), (F.xxhash64("node") % SALT + SALT).cast("int").alias("s0")).select("p", "y", F.expr(f"s0 % {SALT}").alias("s"))
    on = left.join(right, ["p", "s"])
    on = on.where("x != y") if sided else on.where("x < y")
    return on.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def group_pairs(rows: DataFrame, group: str, size: str) -> DataFrame:
    """(a, b): all pairs of distinct nodes of one group, from distinct rows (group, node, size) with the
    group's number of nodes; a large group is joined in parts."""
    parts = F.least(F.lit(64), F.ceil(F.col(size) / 2000)).cast("int")
    left = rows.select(F.col(group).alias("p"), F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("s"))
    right = rows.select(F.col(group).alias("p"), F.col("node").alias("b"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("s"))
    return left.join(right, ["p", "s"]).where("a < b").select("a", "b").distinct()


def with_texts(pairs: DataFrame, classes: DataFrame, texts: DataFrame, fields: list[str]) -> DataFrame:
    """pairs (a, b, ...) of nodes with the texts of one member of each; classes (id, node); texts (id, fields).

    Only nodes that occur in a pair are looked up; a class of copies is read once."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = classes.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    full = texts.join(one, "id").groupBy("node").agg(*[F.min(f).alias(f) for f in fields])
    a = full.select(F.col("node").alias("a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    b = full.select(F.col("node").alias("b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    return pairs.join(a, "a").join(b, "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), root being a component's least node.

    Alternates large-star and small-star steps, each a shuffle by node with a map-side minimum;
    the number of rounds grows with the logarithm of the longest chain.  A hub's neighbours are
    never gathered in one row.  Every round is cut, and ends when no edge changed."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def covered(spans: DataFrame) -> DataFrame:
    """(node, covered): places of each node that its spans (node, lo, hi) cover, merged in order by a
    window over (node, lo)."""
    each = spans.groupBy("node", "lo").agg(F.max("hi").alias("hi"))
    seen = F.coalesce(F.max("hi").over(W.partitionBy("node").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("seen", seen).groupBy("node").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "seen"))).alias("covered"))


def expanded(pairs: DataFrame, classes: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of ids, smaller first, from pairs (a, b) of classes (id, node)."""
    left = classes.select(F.col("node").alias("a"), F.col("id").alias("i"))
    right = classes.select(F.col("node").alias("b"), F.col("id").alias("j"))
    both = pairs.join(left, "a").join(right, "b").where("i != j")
    return both.select(F.least("i", "j").alias(a), F.greatest("i", "j").alias(b)).distinct()


def map_rows(df: DataFrame, columns: list[str], f: Callable, schema: pa.Schema) -> DataFrame:
    """Apply f(batch) -> record batches to slices of bounded size."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for part in K.slices(batch, columns):
                    yield from f(part)

    return df.mapInArrow(run, ddl(schema))


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{x.name}` {_DDL[x.type]}" for x in schema)


_DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>", pa.binary(): "binary"}
