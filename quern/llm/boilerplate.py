"""Problem 6: lines repeated across one source's documents."""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: A chunk ends after a window of WINDOW characters whose rolling hash has its CUT_BITS low bits zero.
WINDOW, CUT_BITS = 3, 3
#: Bits of the map of repeated chunks (4 MB), and parts over which the places of one line are spread.
MAP_BITS, SALT = 1 << 25, 16
_CHUNK = pa.schema([("src", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64())])
_LINE = pa.schema([("src", pa.int64()), ("line", pa.int64()), ("page", pa.int64()), ("at", pa.int64())])


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: length and place of its compatibility form, the forms, characters kept, marks."""
    size = np.ones(0x110000, dtype=np.int32)
    place = np.zeros(0x110000, dtype=np.int64)
    flat = np.arange(0x110000, dtype=np.uint32)
    place[:] = np.arange(0x110000)
    extra: list[int] = []
    marks = np.zeros(0x110000, dtype=bool)
    keep = np.ones(0x110000, dtype=bool)
    for o in range(0x110000):
        if 0xD800 <= o < 0xE000 or 0xAC00 <= o < 0xD7A4 or 0x3400 <= o < 0x9FFF or 0x20000 <= o < 0x2F800 or o >= 0x2FA20:
            continue
        ch = chr(o)
        kind = U.category(ch)
        if kind[0] == "M" or 0x1100 <= o < 0x1200:
            marks[o] = True
        if kind == "Nd" or ch.isdigit() or ch.isspace() or kind == "Zs":
            keep[o] = False
        form = U.normalize("NFKC", ch)
        if form != ch:
            size[o], place[o] = len(form), 0x110000 + len(extra)
            extra.extend(map(ord, form))
    return size, place, np.append(flat, np.array(extra, dtype=np.uint32)), keep, marks


def _lines(col: pa.Array):
    """Kept characters of all lines: (characters, line of each, rows of the lines, line numbers, n lines)."""
    size, place, flat, keep, marks = _tables()
    cp, starts = K.codepoints(col)
    if marks[cp].any():  # characters that may compose with their neighbours: such texts go through NFKC whole
        texts = col.to_pylist()
        odd = np.unique(K.rows_of(starts)[marks[cp]])
        for i in odd.tolist():
            texts[i] = "\n".join(U.normalize("NFKC", x) for x in texts[i].split("\n"))
        cp, starts = K.codepoints(pa.array(texts, type=pa.large_string()))
    row = K.rows_of(starts)
    feed = cp == 10
    number = np.cumsum(feed) - feed  # line feeds before each character
    per_row = np.bincount(row[feed], minlength=len(starts) - 1)
    first = np.append(0, np.cumsum(per_row + 1))  # global number of each row's first line
    line = number + row  # every row adds one line of its own
    use = ~feed
    cp, line = cp[use], line[use]
    n = size[cp]
    if (n != 1).any():
        line = np.repeat(line, n)
        begin = np.repeat(place[cp], n)
        step = np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
        cp = flat[begin + step]
    else:
        cp = flat[place[cp]]
    use = keep[cp]
    total = int(first[-1])
    rows = np.repeat(np.arange(len(per_row)), per_row + 1)
    return cp[use], line[use], rows, np.arange(total) - first[rows] + 1, total


def _chunks(b: pa.RecordBatch, least: int):
    """Lines of a batch and the chunks that testify for them: (row, number and hash of each line, whether it
    has enough letters, (source, chunk) key and line of each chunk).

    A page is cut as one stream; line feeds do not count, so chunks may span them.  A chunk belongs to a
    line if the line alone makes it: it lies within, and so does the window that ended the one before.
    A line that makes no chunk is one itself."""
    cp, line, rows, number, total = _lines(b.column("text"))
    size = np.bincount(line, minlength=total)
    ok = np.bincount(line, weights=K.letter_table()[cp], minlength=total) >= least
    starts = np.append(0, np.cumsum(size))
    pre = K.prefix_hash(cp)
    whole = K.segment_hash(pre, starts[:-1], starts[1:])
    roll = K.window_hash(pre, WINDOW)
    end = np.flatnonzero((roll & np.uint64((1 << CUT_BITS) - 1)) == 0) + WINDOW
    begin, stop = end[:-1], end[1:]
    of = line[begin - WINDOW] if len(begin) else np.zeros(0, dtype=np.int64)
    within = (of == line[stop - 1]) & ok[of] if len(begin) else np.zeros(0, dtype=bool)
    begin, stop, of = begin[within], stop[within], of[within]
    bare = np.flatnonzero(ok & (np.bincount(of, minlength=total) == 0))
    chunk = np.concatenate([K.segment_hash(pre, begin, stop), whole[bare]])
    of = np.concatenate([of, bare])
    src = b.column("src").to_numpy()[rows].view(np.uint64)
    return rows, number, whole, ok, K.mix(chunk + K.mix(src[of])), of


def repeated_lines(df: DataFrame, id_col: str = "page_id", source: str = "pdf_name", text: str = "text", min_rows: int = 4, min_share: float = 0.20, least: int = 6) -> DataFrame:
    """(page, at, src, line): places of lines that stand on many rows of their source; line is a hash of
    what makes lines the same.

    Method: every page, in compatibility form without blanks and digits, is cut into content-defined
    chunks at places that a rolling hash chooses, instead of at line feeds.  Distinct rows are counted
    per source and chunk, combined per batch before the shuffle; repeated chunks go into a bit map of
    fixed size, which every task gets.  A line is cut out if all chunks that testify for it are
    repeated; as the result is asked by line, its exact number of distinct rows is counted last, over
    these few lines only (the map may let others pass, never lose one).  Keys are (source, chunk) and
    (source, line), the latter salted, so a source holding a third of all rows is spread.
    Null sources are one source; null texts have no lines; rows with a null id are left out; repeated
    rows count once; an empty table gives no rows; other columns are ignored.
    """
    base = df.select(C.column(df, id_col, "long").alias("page"), F.xxhash64(F.coalesce(C.column(df, source, "string"), F.lit("\x00"))).alias("src"), C.column(df, text, "string").alias("text")).where("page is not null")
    base = C.spread(base)
    rows = base.groupBy("src").agg(F.greatest(F.ceil(F.count_distinct("page") * F.lit(min_share) - F.lit(1e-9)), F.lit(min_rows)).alias("need"))
    filled = base.where("text is not null")

    def count(b: pa.RecordBatch):
        row, _, _, _, key, of = _chunks(b, least)
        page = b.column("page").to_numpy()[row[of]].view(np.uint64)
        _, once = np.unique(K.mix(key ^ K.mix(page)), return_index=True)
        key, of = key[once], of[once]
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        yield K.table(_CHUNK, b.column("src").to_numpy()[row[of[at]]], K.signed(key[at]), n.astype(np.int64))

    chunks = C.map_rows(filled, ["text"], count, _CHUNK).groupBy("src", "chunk").agg(F.sum("n").alias("n")).where(f"n >= {min_rows}")
    place = F.pmod("chunk", F.lit(MAP_BITS))
    often = chunks.join(rows, "src").where("n >= need").select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(32767).alias("bit"))
    bits = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in often.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # MAP_BITS / 32768 rows at most
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    known = df.sparkSession.sparkContext.broadcast(bits)

    def cut(b: pa.RecordBatch):
        row, number, whole, ok, key, of = _chunks(b, least)
        at = np.mod(K.signed(key), MAP_BITS)
        seen = (known.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        keep = np.flatnonzero(ok & (np.bincount(of, weights=1 - seen, minlength=len(ok)) == 0))
        r = row[keep]
        yield K.table(_LINE, b.column("src").to_numpy()[r], K.signed(whole[keep]), b.column("page").to_numpy()[r], number[keep].astype(np.int64))

    lines = C.cut(C.map_rows(filled, ["text"], cut, _LINE))
    whole = lines.groupBy("src", "line").agg(F.countDistinct("page").alias("n")).join(rows, "src").where("n >= need").select("src", "line", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALT)).cast("int"))
    return dealt.join(whole, ["src", "line", "salt"], "left_semi").select("page", "at", "src", "line")


def found(df: DataFrame) -> DataFrame:
    """(page_id, line_no): every place of a repeated line."""
    return repeated_lines(df).select(F.col("page").alias("page_id"), F.col("at").alias("line_no")).distinct()


def lines_by_source(df: DataFrame, id_col: str = "page_id", source: str = "pdf_name", text: str = "text") -> DataFrame:
    """(source, line, n_rows, places): each repeated line of each source, in one of its stored forms."""
    at = repeated_lines(df, id_col=id_col, source=source, text=text)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    per = at.groupBy("page").agg(F.collect_set(F.struct("at", "line")).alias("ats"))
    each = rows.join(per, "page").select("page", "source", F.split("text", "\n", -1).alias("ls"), F.explode("ats").alias("x"))
    each = each.select("page", "source", F.col("x.line").alias("h"), F.element_at("ls", F.col("x.at").cast("int")).alias("line"))
    return each.groupBy("source", "h").agg(F.min("line").alias("line"), F.countDistinct("page").alias("n_rows"), F.count(F.lit(1)).alias("places")).drop("h")


def cleaned(df: DataFrame, id_col: str = "page_id", text: str = "text") -> DataFrame:
    """(page_id, n_removed, text): pages without the repeated lines; other lines stay as stored."""
    gone = repeated_lines(df, id_col=id_col, text=text).groupBy("page").agg(F.collect_set("at").alias("gone"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{text}`").cast("string").alias("text"))
    lines = F.expr("array_join(transform(filter(transform(split(text, '\\n', -1), (x, i) -> struct(x, i + 1L as i)), s -> not array_contains(gone, s.i)), s -> s.x), '\\n')")
    return rows.join(gone, "page", "left").select(F.col("page").alias("page_id"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(lines).alias("text"))
