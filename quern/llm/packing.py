"""Problem 8: filling fixed-capacity containers."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import token_counts

#: Items that are packed together in one task; a hash spreads all items over so many groups.
GROUP_ITEMS = 10_000


class _Stock:
    """Unpacked items by size: how many there are and which sizes are left, in order."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in range(len(sizes) - 1, -1, -1):
            self.items[sizes[i]].append(i)
        self.left = [s for s in range(1, capacity + 1) if self.items[s]]

    def at_most(self, gap: int) -> int:
        """The largest size left that fits, or 0."""
        k = bisect_right(self.left, gap)
        return self.left[k - 1] if k else 0

    def take(self, size: int) -> int:
        i = self.items[size].pop()
        if not self.items[size]:
            del self.left[bisect_right(self.left, size) - 1]
        return i

    def back(self, size: int, i: int) -> None:
        if not self.items[size]:
            insort(self.left, size)
        self.items[size].append(i)

    def best_two(self, more_than: int, at_most: int) -> tuple[int, int] | None:
        """The two sizes left with the largest sum in (more_than, at_most]."""
        s = np.array(self.left[: bisect_right(self.left, at_most - 1)], dtype=np.int64)
        if not len(s):
            return None
        k = np.searchsorted(s, at_most - s, side="right") - 1
        single = np.fromiter((len(self.items[x]) < 2 for x in s), dtype=bool, count=len(s)) if len(s) < 64 else None
        ok = k >= 0
        same = ok & (s[np.maximum(k, 0)] == s)
        for i in np.flatnonzero(same):
            if (single[i] if single is not None else len(self.items[s[i]]) < 2):
                k[i] -= 1
        ok = k >= 0
        total = np.where(ok, s + s[np.maximum(k, 0)], 0)
        j = int(total.argmax())
        return (int(s[j]), int(s[k[j]])) if total[j] > more_than else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes (each 1..capacity).

    Each container is filled greedily with the largest item that fits; then, while room is left, its
    smallest item is exchanged for the two unpacked items that together fill the widened gap most."""
    stock = _Stock(sizes, capacity)
    out = []
    while stock.left:
        bin_, gap = [], capacity
        while s := stock.at_most(gap):
            bin_.append((s, stock.take(s)))
            gap -= s
        while gap:
            small, i = bin_[-1]
            two = stock.best_two(small, gap + small)
            if two is None:
                break
            bin_.pop()
            bin_ += [(s, stock.take(s)) for s in two]
            bin_.sort(key=lambda x: -x[0])
            stock.back(small, i)
            gap += small - sum(two)
        out.append([i for _, i in bin_])
    return out


def packed(df: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(profile, doc_id, part, start_token, tokens, container_id): where each text goes.

    Method: best-two-fit.  Sizes are counted once on whole texts.  A text larger than the capacity is
    divided into parts of the capacity, which fill containers alone, and a rest; no other text is
    divided.  Items are dealt by a hash to groups of about GROUP_ITEMS, each packed in its own
    task, so at most a few containers of each group stay partly filled; only sizes are shuffled.
    Null and empty texts have no tokens and are placed nowhere, nor are rows with a null id;
    repeated rows are items each, dealt out like any others; an empty table or no profile gives no rows; a capacity that is
    null or not positive gives none for that profile; other columns are ignored.
    """
    sizes = C.cut(token_counts(df, id_col, text).where("tokens > 0 and id is not null"))
    groups = max(1, -(-sizes.count() // GROUP_ITEMS))
    caps = profiles.select(F.col("profile").cast("string").alias("profile"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0")
    items = sizes.join(F.broadcast(caps), F.lit(True))
    items = items.select("profile", "capacity", "id", F.explode(F.expr("sequence(0L, cast((tokens - 1) div capacity as bigint))")).alias("part"), "tokens")
    items = items.select("profile", "capacity", "id", "part", (F.col("part") * F.col("capacity")).alias("start"), F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")).alias("size"))
    # a number among equal rows, so that a row is placed alike however the table is split and whatever is computed again
    items = items.groupBy("profile", "capacity", "id", "part", "start", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    full = items.where("size = capacity").select("profile", "id", "part", "start", "size", F.concat_ws("-", F.lit("full"), F.col("id").cast("string"), F.col("part").cast("string"), F.col("no").cast("string")).alias("container_id"))
    rest = items.where("size < capacity").withColumn("g", F.pmod(F.xxhash64("id", "part", "no"), F.lit(groups)))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"], kind="stable")
        name = np.empty(len(pdf), dtype=object)
        for n, bin_ in enumerate(best_two_fit(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]))):
            name[bin_] = f"g{key[1]}-{n}"
        return pdf.assign(container_id=name)[["profile", "id", "part", "start", "size", "container_id"]]

    small = rest.groupBy("profile", "g").applyInPandas(pack, "profile string, id long, part long, start long, size long, container_id string")
    out = full.unionByName(small)
    return out.select("profile", F.col("id").alias("doc_id"), "part", F.col("start").alias("start_token"), F.col("size").alias("tokens"), "container_id")


def fill_report(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, capacity, containers, items, tokens, fill): how full the containers are."""
    p = packed(df, profiles).groupBy("profile").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    caps = profiles.select("profile", F.col("capacity_tokens").cast("long").alias("capacity"))
    return p.join(caps, "profile").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 5))
