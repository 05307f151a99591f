"""Problem 1: the same or nearly the same records across splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Letters of a suffix that a group compares.
SPAN = 16
#: (most letters of a record, neighbouring suffixes of which one is kept): records sharing SPAN + n - 1
#: letters in a row share a kept one.  The shorter a record, the shorter its shared runs may be.
SKIPS = ((130, 2), (200, 4), (400, 8), (None, 16))
#: A pair is met if it shares more than this part of the kept suffixes of either record.
LEAST_SHARED = 0.10
#: Letters of a shingle, and 64-bit words of the bitmap that marks a record's shingles.
SHINGLE, WORDS = 5, 16
#: What a group's pairs count as where they were not counted, and parts into which a large one is dealt at most.
UNCOUNTED, MOST_PARTS = 1 << 62, 64

_SUFFIX = pa.schema([("label", pa.int64()), ("node", pa.int64())])
_MARKS = [f"m{i}" for i in range(WORDS)]
_CLASS = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("places", pa.int64()), ("shingles", pa.int64()), ("ones", pa.int64()), *((m, pa.int64()) for m in _MARKS)])
_CROSSING = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("made", pa.int64())])


def _nodes(batch: pa.RecordBatch, least: int):
    """Letters of the batch's texts with, for each row, its class and whether it counts.

    The class is a 63-bit hash of both fields' letters, its lowest bit the side (1: evaluation)."""
    first, s1 = K.letters(batch.column("head"))
    second, s2 = K.letters(batch.column("body"))
    n1, n2 = np.diff(s1), np.diff(s2)
    starts = np.append(0, np.cumsum(n1 + n2))
    cp = np.empty(starts[-1], dtype=np.uint32)
    body = np.zeros(len(cp), dtype=bool)
    row = np.repeat(np.arange(len(n1)), n1 + n2)
    body[:] = (np.arange(len(cp)) - starts[:-1][row]) >= n1[row]
    cp[~body], cp[body] = first, second
    h = K.row_hash(cp, starts)
    side = batch.column("side").to_numpy(zero_copy_only=False)
    node = K.signed((h & ~np.uint64(1)) | side.astype(np.uint64))
    return cp, starts, node, (n2 >= least) & (side >= 0)


def _marks(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each row, repeats counted, and the bitmap of their hashes.

    The distinct shingles of a row are at most the former and at least the bitmap's ones.  Each bit in which two bitmaps differ takes a shingle that only one of the rows has."""
    h = K.window_hash(K.prefix_hash(cp), SHINGLE)
    row = K.rows_of(starts)[: len(h)]
    use = K.inside(starts, SHINGLE, len(h))
    n, bits = len(starts) - 1, 64 * WORDS
    h, row = h[use], row[use]
    seen = np.zeros(n * bits, dtype=bool)
    for i in range(0, len(h), 1 << 18):  # bounded memory
        part = slice(i, i + (1 << 18))
        seen[row[part] * bits + (h[part] % np.uint64(bits)).astype(np.int64)] = True
    return np.bincount(row, minlength=n), np.packbits(seen).view(np.int64).reshape(n, WORDS)


def _suffixes(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the first SPAN letters, row) of the kept suffixes; a hash repeated in a row is kept once."""
    n, low = np.diff(starts), 0
    labels, rows = [], []
    for most, skip in SKIPS:
        mine = (n > low) & (n <= most) if most else n > low
        low = most
        if not mine.any():
            continue
        part, at = K.only(cp, starts, np.repeat(mine, n))
        h = K.window_hash(K.prefix_hash(part), SPAN)
        places = K.anchors(h, at, SPAN, skip)
        labels.append(h[places])
        rows.append(K.rows_of(at)[places])
    if not labels:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    label, row = np.concatenate(labels), np.concatenate(rows)
    order = np.lexsort((label, row))
    label, row = label[order], row[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
    return label[first], row[first]


def _crossing(batches):
    """Of rows sorted by label, those of groups with both sides, and the cross-split pairs of the
    group; a group larger than a task holds passes whole, uncounted."""

    def whole(lab, node):
        return K.table(_CROSSING, lab, node, np.full(len(lab), UNCOUNTED))

    def closed(lab, node):
        _, size, run = C._cuts(lab)
        one = np.bincount(run, weights=node & 1, minlength=len(size)).astype(np.int64)
        made = one * (size - one)
        keep = (made > 0)[run]
        return K.table(_CROSSING, lab[keep], node[keep], made[run][keep])

    lab = node = np.zeros(0, dtype=np.int64)
    large = None
    for a, b in C.merged_batches(batches):
        lab, node = np.concatenate([lab, a]), np.concatenate([node, b])
        if large is not None:
            k = int(np.searchsorted(lab, large, "right"))
            yield whole(lab[:k], node[:k])
            lab, node = lab[k:], node[k:]
            if not len(lab):
                continue
            large = None
        k = int(np.searchsorted(lab, lab[-1], "left"))
        if k:
            yield closed(lab[:k], node[:k])
            lab, node = lab[k:], node[k:]
        if len(lab) > C.HELD_ROWS:
            yield whole(lab, node)
            large, lab, node = lab[-1], lab[:0], node[:0]
    if len(lab):
        yield closed(lab, node)


def _met(rows: DataFrame, sample: DataFrame, nodes: DataFrame, likeness: float) -> DataFrame:
    """(a, b): the pairs of nodes of unlike sides that share more than LEAST_SHARED of their suffixes.

    All suffixes are put in one order, those of the smallest groups first.  If a record leaves out
    that part of its suffixes that come last in it, two records sharing more of them still meet in
    one that both kept; what half the corpus shares makes no pairs, unless a record holds little
    else.  Groups seen to be hot in the sample are not gathered in a task; large ones are dealt to parts."""
    hot = C.hot_labels(sample, 64)
    rest = rows.where(~F.col("label").isin(hot)) if hot else rows
    crossing = C.sorted_by_label(rest, 64).mapInArrow(_crossing, "label long, node long, made long")
    if hot:
        crossing = crossing.unionByName(rows.where(F.col("label").isin(hot)).distinct().withColumn("made", F.lit(UNCOUNTED)))
    w = W.partitionBy("node")
    ranked = crossing.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("made", "label")))
    kept = ranked.join(nodes.select("node", "places", "shingles", "ones"), "node").where(f"places - n + rank <= greatest(1, ceil(places * {1 - LEAST_SHARED}D))")
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("made") / C.HELD_PAIRS)).cast("int")
    kept = C.cut(kept.select("label", "node", "shingles", "ones", parts.alias("parts")))
    one = kept.where("(node & 1) = 1").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    two = kept.where("(node & 1) = 0").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    one, two = (x.select("label", "part", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "shingles", "ones")]) for x, s in ((one, 1), (two, 2)))
    on = one.join(two, ["label", "part"]).where(f"shingles_1 >= ones_2 * {likeness}D and shingles_2 >= ones_1 * {likeness}D")
    return on.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


def cross_split_pairs(
    df: DataFrame, id_col: str = "sample_id", head: str = "instruction", body: str = "output", split: str = "split",
    train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test"), likeness: float = 0.70, least: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal records, one in a training and one in an evaluation split, whose
    head and body together have at least the given likeness, and the members of the classes.

    Method: the letters of all records form one text, whose suffixes are partitioned by a hash of
    their first SPAN letters and sorted within, so that suffixes with equal prefixes are adjacent (a
    suffix array in parts).  Suffixes at content-defined places are kept, the more of them the
    shorter the record.  Suffixes of unlike splits that meet share a span; each record is paired
    through its rarest spans (see _met), which meets every pair that shares more than LEAST_SHARED
    of its suffixes.  Pairs are then ruled out by bounds of their numbers of distinct shingles and by bitmaps
    of these, both of which exclude only pairs that cannot be alike, and the rest is verified on
    whole texts, where the spans of the evaluation record are read.

    Returns (pairs, classes): pairs (a, b, likeness, letters, spans) with nodes a, b, the letters of
    the evaluation record and the spans of it that the other one holds, as a flat [start, end, ...]
    list; and classes (id, node).  Null texts count as empty; records with a null id or another split, and bodies of
    fewer than ``least`` letters, take no part; equal records form one class, so their number
    costs nothing before the result; an empty table gives no rows; other columns are ignored.
    """
    side = F.when(F.col(f"`{split}`").isin(*evaluation), 1).when(F.col(f"`{split}`").isin(*train), 0).otherwise(-1)
    base = df.select(C.column(df, id_col, "long").alias("id"), C.column(df, head, "string").alias("head"), C.column(df, body, "string").alias("body"), side.cast("int").alias("side"))
    base = C.spread(base.where("id is not null and side >= 0"))

    def classes(b: pa.RecordBatch):
        cp, starts, node, ok = _nodes(b, least)
        n, marks = _marks(cp, starts)
        ones = np.bitwise_count(marks.view(np.uint64)).sum(axis=1).astype(np.int64)
        _, row = _suffixes(cp, starts)
        places = np.bincount(row, minlength=len(node))
        yield K.table(_CLASS, b.column("id").to_numpy()[ok], node[ok], places[ok], n[ok], ones[ok], *marks[ok].T)

    def suffixes(b: pa.RecordBatch):
        cp, starts, node, ok = _nodes(b, least)
        _, once = np.unique(node, return_index=True)
        alone = np.zeros(len(node), dtype=bool)
        alone[once] = True
        label, row = _suffixes(cp, starts)
        keep = (ok & alone)[row]
        yield K.table(_SUFFIX, K.signed(label[keep]), node[row[keep]])

    members = C.cut(C.map_rows(base, ["head", "body"], classes, _CLASS))
    rows, seen = (C.map_rows(x, ["head", "body"], suffixes, _SUFFIX) for x in (base, base.sample(C.SAMPLED, 7)))
    nodes = members.groupBy("node").agg(*[F.max(c).alias(c) for c in ("places", "shingles", "ones", *_MARKS)])
    met = _met(rows, seen, nodes, likeness)
    marks = ["node", "shingles", *_MARKS]
    for at, s in (("a", "1"), ("b", "2")):
        met = met.join(nodes.select(F.col("node").alias(at), *[F.col(c).alias(f"{c}_{s}") for c in marks[1:]]), at)
    apart = " + ".join(f"bit_count({m}_1 ^ {m}_2)" for m in _MARKS)
    met = C.cut(met.where(f"{apart} <= (shingles_1 + shingles_2) * {(1 - likeness) / (1 + likeness)}D + 1e-6D").select("a", "b"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64()), ("letters", pa.int64()), ("spans", pa.list_(pa.int64()))])

    def verify(b: pa.RecordBatch):
        d = {c: b.column(c).to_pylist() for c in b.schema.names}
        rows = []
        kept: dict[int, tuple[str, np.ndarray]] = {}  # letters and distinct shingles of the batch's distinct records

        def shingled(node: int, head: str | None, body: str | None) -> tuple[str, np.ndarray]:
            if node not in kept:
                t = "".join(filter(str.isalnum, (head or "") + (body or "")))
                kept[node] = t, np.unique(K.windows(t, SHINGLE))
            return kept[node]

        for i, (x, y) in enumerate(zip(d["a"], d["b"])):
            (tx, one), (ty, two) = (shingled(v, d[f"head_{s}"][i], d[f"body_{s}"][i]) for v, s in ((x, "a"), (y, "b")))
            like = K.jaccard(one, two)
            if like >= likeness - 1e-12:
                mine, other = (tx, ty) if x & 1 else (ty, tx)
                rows.append((x, y, like, len(mine), K.common_windows(K.windows(mine, SPAN), K.windows(other, SPAN), SPAN)))
        yield K.table(out, *(list(c) for c in zip(*rows))) if rows else K.table(out, [], [], [], [], [])

    full = C.with_texts(met, members, base.select("id", "head", "body"), ["head", "body"])
    return C.map_rows(full, ["head_a", "body_a", "head_b", "body_b"], verify, out), members.select("id", "node")


def found(df: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b), smaller first: every overlapping pair of records."""
    pairs, members = cross_split_pairs(df)
    return C.expanded(pairs, members, "sample_id_a", "sample_id_b")


def records(df: DataFrame, id_col: str = "sample_id", split: str = "split", source: str = "source") -> DataFrame:
    """(id, split, source, copies, coverage): every evaluation record with the number of training records
    it overlaps and the share of its letters that these cover, the spans of all of them merged (null where
    none does).

    Pairs are those of distinct texts; counts are made per class, so a class of many copies is never expanded."""
    pairs, members = cross_split_pairs(df, id_col=id_col, split=split)
    pairs = C.cut(pairs)
    size = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    mine = F.expr("a & 1 = 1")
    nodes = pairs.select(F.when(mine, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(mine, F.col("b")).otherwise(F.col("a")).alias("other"), "letters", "spans")
    copies = nodes.join(size.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("size").alias("copies"), F.max("letters").alias("letters"))
    spans = nodes.where("size(spans) > 0").select("node", F.explode(F.expr("transform(sequence(0, cast(size(spans) / 2 as int) - 1), i -> struct(spans[2*i] as lo, spans[2*i+1] as hi))")).alias("x"))
    hits = copies.join(C.covered(spans.select("node", "x.lo", "x.hi")), "node", "left").withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / F.greatest("letters", F.lit(1)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{split}`").alias("split"), F.col(f"`{source}`").alias("source")).where(F.col("split").isin("val", "test"))
    return rows.join(members.join(hits, "node").select("id", "copies", "coverage"), "id", "left")


def report(df: DataFrame, id_col: str = "sample_id", split: str = "split", source: str = "source") -> DataFrame:
    """Per evaluation split and source: records, records met in training, pairs, and mean coverage.

    A null source is a source of its own."""
    joined = records(df, id_col, split, source)
    return joined.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("copies").alias("overlapping"), F.coalesce(F.sum("copies"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 4).alias("mean_coverage")
    )
