"""Problem 2: groups of records that differ by small edits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Trees of the forest, and the longest prefix a tree holds.
TREES, LONGEST = 36, 6
_ENTRY = pa.schema([("label", pa.int64()), ("node", pa.int64())])
_CLASS = pa.schema([("id", pa.int64()), ("node", pa.int64())])


def depth_for(likeness: float, trees: int = TREES, recall: float = 0.99, longest: int = LONGEST) -> int:
    """The longest prefix at which two records of that likeness meet in some tree with the wanted
    probability: prefixes are shortened from the longest until the recall is reached."""
    for d in range(longest, 1, -1):
        if 1 - (1 - likeness**d) ** trees >= recall:
            return d
    return 1


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = K.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (s[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[n:] >> np.uint64(32)).astype(np.uint32)


def near_duplicates(df: DataFrame, id_col: str = "sample_id", text: str = "output", likeness: float = 0.60, shingle: int = 5, least: int = 60, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Groups of records whose texts are alike, directly or through others.

    Method: an LSH forest.  Each distinct letter text gets TREES sequences of MinHash values; each
    tree holds the sequences as labels in sorted order, which is a prefix trie.  Matched prefixes
    are shortened from LONGEST until two texts of the wanted likeness meet with probability
    ``recall``.  At that depth all entries of a bucket are paired, however many it holds; buckets that
    a sample of the records shows to be hot, or that a task cannot hold, are paired by a salted join;
    pairs are then verified on whole texts and the verified links joined into components.  So the
    work is quadratic in the distinct texts of a bucket; equal texts are one.

    Returns (groups, classes): groups (node, root, links) with one row per distinct text that has a
    partner, and classes (id, node).  Texts of fewer than ``least`` letters, null and empty texts
    take no part; equal letter texts form one class; rows with a null id are left out; repeated
    rows count once; an empty table gives no rows; other columns are ignored.
    """
    depth = depth_for(likeness, recall=recall)
    mul, add = _seeds(TREES * LONGEST)
    base = df.select(C.column(df, id_col, "long").alias("id"), C.column(df, text, "string").alias("text")).where("id is not null and text is not null")
    base = C.spread(base)
    tree_bits, level_bits = 6, [10, 10, 10, 10, 9, 9]

    def classes(b: pa.RecordBatch):
        cp, starts = K.letters(b.column("text"))
        ok = np.diff(starts) >= least
        yield K.table(_CLASS, b.column("id").to_numpy()[ok], K.signed(K.row_hash(cp, starts))[ok])

    def entries(b: pa.RecordBatch):
        cp, starts = K.letters(b.column("text"))
        node = K.signed(K.row_hash(cp, starts))
        _, once = np.unique(node, return_index=True)
        ok = np.zeros(len(node), dtype=bool)
        ok[once] = True
        ok &= np.diff(starts) >= least
        if not ok.any():
            return
        h = K.window_hash(K.prefix_hash(cp), shingle)
        row = K.rows_of(starts)[: len(h)]
        use = K.inside(starts, shingle, len(h)) & ok[row]
        x = (h[use] >> np.uint64(32)).astype(np.uint32)
        row = row[use]
        seg = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        who, y = node[row[seg]], np.empty_like(x)
        for t in range(TREES):
            label = np.full(len(seg), t, dtype=np.uint64)
            for level, bits in enumerate(level_bits):
                k = t * LONGEST + level
                np.bitwise_xor(x, add[k], out=y)
                np.multiply(y, mul[k], out=y)
                low = K.mix(np.minimum.reduceat(y, seg).astype(np.uint64))
                label = (label << np.uint64(bits)) | (low >> np.uint64(64 - bits))
            yield K.table(_ENTRY, K.signed(label), who)

    members = C.cut(C.map_rows(base, ["text"], classes, _CLASS))
    bits = tree_bits + sum(level_bits[:depth])
    rows, seen = (C.map_rows(x, ["text"], entries, _ENTRY) for x in (base, base.sample(C.SAMPLED, 7)))
    met = C.cut(C.linked(rows, (bits,), C.HELD_PAIRS, False, seen).select("a", "b"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(b: pa.RecordBatch):
        a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
        kept: dict[int, np.ndarray] = {}  # distinct shingles of the batch's distinct texts

        def shingled(node: int, t: str) -> np.ndarray:
            if node not in kept:
                kept[node] = np.unique(K.windows("".join(filter(str.isalnum, t)), shingle))
            return kept[node]

        good = []
        for i, (s, t) in enumerate(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())):
            one, two = shingled(a[i], s), shingled(c[i], t)
            if min(len(one), len(two)) >= likeness * max(len(one), len(two)) - 1e-9 and K.jaccard(one, two) >= likeness - 1e-12:
                good.append(i)
        yield K.table(out, [a[i] for i in good], [c[i] for i in good])

    links = C.cut(C.map_rows(C.with_texts(met, members, base, ["text"]), ["text_a", "text_b"], verify, out))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return C.components(links).join(degree, "node"), members


def found(df: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b), smaller first: all pairs of records of one group."""
    groups, members = near_duplicates(df)
    root = members.join(groups.select("node", "root"), "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    left = root.select("root", F.col("id").alias("sample_id_a"))
    return left.join(root.select("root", F.col("id").alias("sample_id_b")), "root").where("sample_id_a < sample_id_b").select("sample_id_a", "sample_id_b").distinct()


def groups(df: DataFrame, id_col: str = "sample_id", text: str = "output", likeness: float = 0.60) -> DataFrame:
    """(id, group_id, links): each record with its group, named by the group's least id, and the
    number of verified links of its text.  A record without partner is a group of its own."""
    g, members = near_duplicates(df, id_col, text, likeness)
    m = members.join(g, "node", "left").select("id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    names = m.groupBy("root").agg(F.min("id").alias("group_id"))
    return m.join(names, "root").select("id", "group_id", "links")
