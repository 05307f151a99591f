"""Problem 10: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Code points of the first prefix; one suffix in every run of ``span`` code points begins a group with it.
PREFIX = 60
#: Parts over which the members of a crowded node are spread.
SALT = 64
_CLASS = pa.schema([("id", pa.int64()), ("node", pa.int64())])
_SUFFIX = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("pos", pa.int64())])
_LEAF = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("pos", pa.int64()), ("hot", pa.bool_())])
_SLICE = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("pos", pa.int64()), ("hot", pa.bool_()), ("before", pa.int64()), ("around", pa.binary())])
_RUN = pa.schema([("node", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("held_by", pa.int64()), ("texts", pa.int64())])
_START = pa.schema([("path", pa.int64()), ("node", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64())])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by (prefix, text, place), those whose prefix stands in two texts at least;
    a group larger than a task holds passes whole and is marked."""
    for t, large in C.runs(batches):
        label, node, pos = (t.column(c).to_numpy() for c in ("label", "node", "pos"))
        new = np.ones(len(label), dtype=bool)
        new[1:] = (label[1:] != label[:-1]) | (node[1:] != node[:-1])
        first = new.copy()
        first[1:] |= pos[1:] != pos[:-1]
        keep = first
        if not large:
            _, _, run = C._cuts(label)
            keep = first & (np.bincount(run, weights=new)[run] >= 2)
        n = int(keep.sum())
        if n:
            yield K.table(_LEAF, label[keep], node[keep], pos[keep], np.full(n, large))


def _slices(span: int):
    """Cut out what stands around each wanted suffix: the code points that a run of ``span`` holding
    its prefix may have before it, and those it may have after.

    Only runs count in which the suffix's prefix hash is the least of all: every text that holds such a
    run keeps the suffix there, so its node has all of them; at other suffixes some may be missing."""
    reach = span - PREFIX

    def cut(b: pa.RecordBatch):
        cp, starts = K.codepoints(b.column("text"))
        whole = K.signed(K.row_hash(cp, starts))
        node = b.column("node").to_numpy()
        at = b.column("at")
        off = at.offsets.to_numpy()
        each = at.flatten()
        row = np.repeat(np.arange(len(node)), np.diff(off))
        label, pos, hot = each.field("label").to_numpy(), each.field("pos").to_numpy(), each.field("hot").to_numpy(zero_copy_only=False)
        mine = (whole == node)[row]  # rows of one id may hold different texts
        row, label, pos, hot = row[mine], label[mine], pos[mine], hot[mine]
        here = starts[row] + pos
        left = np.minimum(pos, reach)
        right = np.minimum(starts[row + 1] - here - PREFIX, reach)
        order = K.anchor_order(K.window_hash(K.prefix_hash(cp), PREFIX))
        for step in range(reach, 0, -1):  # up to the nearest prefix that comes before this one
            for side, room, sign in ((left, left, -1), (right, right, 1)):
                at = np.flatnonzero(room >= step)
                smaller = order[here[at] + sign * step] < order[here[at]]
                side[at[smaller]] = step - 1
        size = left + right
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        idx = np.repeat(here - left, size) + step + np.where(step >= np.repeat(left, size), PREFIX, 0)
        ends = np.append(0, np.cumsum(size * 4)).astype(np.int32)
        around = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cp[idx].astype("<u4").tobytes())])
        yield K.table(_SLICE, label, node[row], pos, hot, left, around)

    return cut


def _paths(label: np.ndarray, before: np.ndarray, around: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it exists) of the ``span`` code points from each place at most ``reach`` before a
    suffix on: one row per suffix, in ascending order of places.

    The PREFIX code points in the middle are those of the label, so a path is named by the label,
    the place and the ``reach`` code points that stand around them."""
    m = len(label)
    if isinstance(around, pa.ChunkedArray):
        around = around.combine_chunks()
    off = np.frombuffer(around.buffers()[1], dtype=np.int32)[around.offset : around.offset + m + 1].astype(np.int64)
    data = np.frombuffer(around.buffers()[2], dtype=np.uint8)[off[0] : off[-1]].view("<u4") if off[-1] > off[0] else np.zeros(0, dtype=np.uint32)
    size = np.diff(off) // 4
    wide = 2 * reach
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    x = np.zeros(m * wide, dtype=np.uint32)
    x[np.repeat(np.arange(m) * wide + reach - before, size) + step] = data
    h = K.window_hash(K.prefix_hash(x), reach)
    j = np.arange(reach + 1)
    path = h[np.arange(m)[:, None] * wide + j]
    path = K.mix(path + K.mix(label.view(np.uint64))[:, None] + K.mix(j.astype(np.uint64) + np.uint64(1)))
    after = size - before
    return path, (reach - j <= before[:, None]) & (j <= after[:, None])


def _subtree(span: int):
    """The deep internal nodes of the subtrees of a task's groups.

    Every suffix of a group is followed to depth ``span``; those that agree so far meet in one
    internal node, which is named by the texts below it.  Each suffix gives its starts [lo, hi] whose
    nodes hold the same texts."""
    reach = span - PREFIX

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in C.runs(batches):
            label, node, pos, before = (t.column(c).to_numpy() for c in ("label", "node", "pos", "before"))
            path, real = _paths(label, before, t.column("around"), reach)
            at = np.flatnonzero(real.ravel())
            key, who = path.ravel()[at], node[at // (reach + 1)]
            order = np.lexsort((who, key))
            key, who = key[order], who[order]
            start, _, run = C._cuts(key)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (run[1:] != run[:-1]) | (who[1:] != who[:-1])
            texts = np.add.reduceat(new.astype(np.int64), start) if len(start) else np.zeros(0, dtype=np.int64)
            held = np.bitwise_xor.reduceat(np.where(new, K.mix(who.view(np.uint64)), np.uint64(0)), start) if len(start) else np.zeros(0, dtype=np.uint64)
            held_by = np.zeros(path.size, dtype=np.uint64)
            number = np.zeros(path.size, dtype=np.int64)
            number[at[order]] = texts[run]
            held_by[at[order]] = held[run]
            number, held_by = number.reshape(path.shape), held_by.reshape(path.shape)
            deep = number >= 2
            first = deep.copy()
            first[:, 1:] &= ~deep[:, :-1] | (held_by[:, 1:] != held_by[:, :-1])
            last = deep.copy()
            last[:, :-1] &= ~deep[:, 1:] | (held_by[:, 1:] != held_by[:, :-1])
            r, lo = np.nonzero(first)
            _, hi = np.nonzero(last)
            if len(r):
                yield K.table(_RUN, node[r], pos[r] - reach + lo, pos[r] - reach + hi, K.signed(held_by[r, lo]), number[r, lo])

    return build


def _longer(span: int):
    """The suffixes of crowded groups by their longer prefix of ``span`` code points, from every place that counts."""
    reach = span - PREFIX

    def each(b: pa.RecordBatch):
        label, node, pos, before = (b.column(c).to_numpy() for c in ("label", "node", "pos", "before"))
        path, real = _paths(label, before, b.column("around"), reach)
        r, j = np.nonzero(real)
        yield K.table(_START, K.signed(path[r, j]), node[r], K.signed(K.mix(node[r].view(np.uint64))), pos[r] - reach + j)

    return each


def shared_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = 100) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats of at least ``span`` code points among distinct texts, verbatim.

    Method: suffix trees partitioned by variable-length prefixes.  Suffixes begin at content-defined
    places, at least one in every run of ``span`` code points; their first PREFIX code points assign
    them to groups, and groups of a single text are dropped.  What is left is followed further, also
    to the left as far as a run may begin: in a task that holds the whole group the subtree is built
    and read at depth ``span``; a group too large for a task is split by the longer prefix of
    ``span`` code points, and its nodes are counted without being gathered.  Every internal node at
    that depth is a repeat; nodes in a row held by the same texts are one.  The work is linear in the
    suffixes; no pairs of texts are made.

    Returns (runs, classes): runs (node, lo, hi, held_by, texts), where every run of ``span`` code
    points of text ``node`` that starts from lo to hi stands in the same ``texts`` texts, named by the
    hash held_by; and classes (id, node).  Texts shorter than ``span``, null and empty ones take no
    part; equal texts form one class; rows with a null id are left out; repeated rows count once; an
    empty table gives no rows; other columns are ignored.
    """
    if span <= PREFIX:
        raise ValueError(f"spans must be longer than {PREFIX}")
    base = df.select(C.column(df, id_col, "long").alias("id"), C.column(df, text, "string").alias("text")).where(f"id is not null and length(text) >= {span}")
    base = C.spread(base)

    def classes(b: pa.RecordBatch):
        cp, starts = K.codepoints(b.column("text"))
        yield K.table(_CLASS, b.column("id").to_numpy(), K.signed(K.row_hash(cp, starts)))

    def suffixes(b: pa.RecordBatch):
        cp, starts = K.codepoints(b.column("text"))
        pre = K.prefix_hash(cp)
        node = K.signed(K.segment_hash(pre, starts[:-1], starts[1:]))
        _, once = np.unique(node, return_index=True)
        alone = np.zeros(len(node), dtype=bool)
        alone[once] = True
        hashes = K.window_hash(pre, PREFIX)
        at = K.anchors(hashes, starts, PREFIX, span - PREFIX + 1)
        row = K.rows_of(starts)[at]
        at, row = at[alone[row]], row[alone[row]]
        yield K.table(_SUFFIX, K.signed(hashes[at]), node[row], at - starts[row])

    members = C.cut(C.map_rows(base, ["text"], classes, _CLASS))
    rows, seen = (C.map_rows(x, ["text"], suffixes, _SUFFIX) for x in (base, base.sample(C.SAMPLED, 7)))
    hot = C.hot_labels(seen, 64)
    rest = rows.where(~F.col("label").isin(hot)) if hot else rows
    leaves = rest.repartition("label").sortWithinPartitions("label", "node", "pos").mapInArrow(_leaves, C.ddl(_LEAF))
    if hot:
        leaves = leaves.unionByName(rows.where(F.col("label").isin(hot)).distinct().withColumn("hot", F.lit(True)))
    leaves = C.cut(leaves)
    # one row of each text that has leaves is read again
    one = members.join(leaves.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    asked = leaves.join(one, "node").groupBy("id", "node").agg(F.collect_list(F.struct("label", "pos", "hot")).alias("at"))
    slices = C.map_rows(base.join(asked, "id").select("node", "text", "at"), ["text"], _slices(span), _SLICE)
    held = slices.where("not hot").repartition("label").sortWithinPartitions("label", "node", "pos").mapInArrow(_subtree(span), C.ddl(_RUN))
    if leaves.where("hot").isEmpty():
        return C.cut(held), members
    starts = C.cut(C.map_rows(slices.where("hot"), ["around"], _longer(span), _START))
    return C.cut(held.unionByName(_crowded(starts))), members


def _crowded(starts: DataFrame) -> DataFrame:
    """Runs of the nodes of crowded groups: the texts of a node are counted in SALT parts, added up, and
    the sum is given back to each part, so that no task sees a whole node."""
    dealt = starts.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALT)))
    parts = dealt.groupBy("path", "part", "node").agg(F.max("mark").alias("mark")).groupBy("path", "part").agg(F.bit_xor("mark").alias("mark"), F.count(F.lit(1)).alias("texts"))
    nodes = parts.groupBy("path").agg(F.bit_xor("mark").alias("held_by"), F.sum("texts").alias("texts")).where("texts > 1")
    known = parts.select("path", "part").join(nodes, "path")
    return dealt.join(known, ["path", "part"]).select("node", "lo", F.col("lo").alias("hi"), "held_by", "texts").distinct()


def found(df: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: every pair of documents that share such a run.

    Texts are paired once for each set of texts that hold a repeat; copies are paired last."""
    runs, members = shared_spans(df)
    sets = runs.select("held_by", "node", "texts").distinct()
    pairs = C.group_pairs(sets, "held_by", "texts")
    same = members.groupBy(F.col("node").alias("a")).agg(F.count_distinct("id").alias("n")).where("n > 1").select("a", F.col("a").alias("b"))
    return C.expanded(pairs.unionByName(same), members, "doc_id_a", "doc_id_b")


def coverage(df: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = 100) -> DataFrame:
    """(id, n_chars, shared_chars, shared_share, copies, most_texts): how much of each text stands elsewhere.

    Repeats are merged in order by a window over (text, start); a text with copies is shared whole.
    ``copies`` are other rows of the very text, ``most_texts`` the most other distinct texts that
    hold one and the same repeat of it.  Texts that share nothing have 0; null texts have 0 characters."""
    runs, members = shared_spans(df, id_col, text, span)
    merged = C.covered(runs.select("node", "lo", (F.col("hi") + span).alias("hi")))
    most = runs.groupBy("node").agg((F.max("texts") - 1).alias("most_texts"))
    sizes = members.groupBy("node").agg(F.count_distinct("id").alias("copies"))
    info = members.distinct().join(sizes, "node").join(merged, "node", "left").join(most, "node", "left")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)).alias("n_chars")).where("id is not null").distinct()
    shared = F.when(F.col("copies") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0)))
    done = rows.join(info, "id", "left").withColumn("shared_chars", shared)
    return done.select("id", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.greatest("n_chars", F.lit(1)), 4).alias("shared_share"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("copies"), F.coalesce("most_texts", F.lit(0)).alias("most_texts"))


def passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = 100) -> DataFrame:
    """(id, start, length, texts): the longest passages of a record whose every run of ``span`` code points
    the same other distinct texts hold, with their number; copies of one text give the same passages."""
    runs, members = shared_spans(df, id_col, text, span)
    w = W.partitionBy("node", "held_by").orderBy("lo", "hi")
    seen = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    each = runs.withColumn("new", (seen.isNull() | (F.col("lo") > seen + 1)).cast("int"))
    each = each.withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = each.groupBy("node", "held_by", "part").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + span).alias("length"), (F.max("texts") - 1).alias("texts"))
    return members.distinct().join(whole, "node").select("id", "start", "length", "texts")
