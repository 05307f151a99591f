"""Problem 5: cutting oversized items at natural boundaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Separators from the strongest to the weakest: each match ends a part.
SEPARATORS = (
    re.compile(r"\n[ \t　]*(?:\r?\n[ \t　]*)+|\n(?=#{1,6} |第[一二三四五六七八九十百千\d]+[章节篇回])"),  # sections
    re.compile(r"\n"),  # paragraphs
    re.compile(r"[。！？!?…]+[”’」』）)\"']*|\.(?=\s)[”’)\"']*"),  # sentences
    re.compile(r"[，,；;：:、]"),  # clauses
    re.compile(r"\s+"),  # words
)


def _units(text: str, lo: int, hi: int, limit: int, level: int, out: list[int]) -> None:
    """Append the ends of parts of text[lo:hi] none of which is longer than limit."""
    if hi - lo <= limit:
        out.append(hi)
    elif level == len(SEPARATORS):
        out.extend(range(lo + limit, hi, limit))
        out.append(hi)
    else:
        at = lo
        for m in SEPARATORS[level].finditer(text, lo, hi):
            if m.end() > at:
                _units(text, at, m.end(), limit, level + 1, out)
                at = m.end()
        if at < hi:
            _units(text, at, hi, limit, level + 1, out)


def split(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece: text[start:end] has at most max_chars code points, and
    text[start:fresh] repeats the last ``overlap`` of the piece before.  The fresh parts, one after
    the other, are the text."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= max_chars:
        return [(0, 0, len(text))] if text else []
    ends: list[int] = []
    _units(text, 0, len(text), max_chars - overlap, 0, ends)
    out, fresh, last = [], 0, 0
    for end in ends:
        start = max(0, fresh - overlap) if out else 0
        if end - start > max_chars:
            out.append((start, fresh, last))
            fresh = last
        last = end
    out.append((max(0, fresh - overlap) if out else 0, fresh, last))
    return out


def oversized_pieces(df: DataFrame, id_col: str, field: str, limits: DataFrame, table_name: str) -> DataFrame:
    """(table_name, row_key, piece_no, start_char, overlap_chars, piece) of texts over their limit.

    Method: a recursive hierarchy of separators (section, paragraph, sentence, clause, word, and
    last the code point) cuts a text into parts under the limit, packed greedily into pieces that
    begin with the end of the piece before.  The work is per row, without a shuffle; limits has a
    few rows (table_name, field_name, max_chars, overlap_chars) and reaches the rows by a join on
    the table's name; two different limits for one field are an error.  Null and short texts and fields without a limit give no piece; repeated rows
    give their pieces each; other columns are ignored.
    """
    lim = limits.where((F.col("table_name") == table_name) & (F.col("field_name") == field)).select(F.col("max_chars").cast("int").alias("most"), F.col("overlap_chars").cast("int").alias("overlap")).distinct()
    if lim.limit(2).count() > 1:
        raise ValueError(f"several limits for {table_name}.{field}")
    base = df.select(C.column(df, id_col, "long").alias("row_key"), C.column(df, field, "string").alias("text"))
    rows = base.join(F.broadcast(lim), F.length("text") > F.col("most"))
    schema = pa.schema([("row_key", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("overlap_chars", pa.int64()), ("piece", pa.string())])

    def cut(b: pa.RecordBatch):
        d = b.to_pydict()
        cols: list[list] = [[], [], [], [], []]
        for key, text, most, overlap in zip(d["row_key"], d["text"], d["most"], d["overlap"]):
            for n, (start, fresh, end) in enumerate(split(text, most, overlap or 0)):
                for c, v in zip(cols, (key, n, start, fresh - start, text[start:end])):
                    c.append(v)
        yield K.table(schema, *cols)

    return C.map_rows(rows, ["text"], cut, schema).select(F.lit(table_name).alias("table_name"), "*")


def all_pieces(sft: DataFrame, chapters: DataFrame, limits: DataFrame) -> DataFrame:
    return oversized_pieces(sft, "sample_id", "output", limits, "sft_samples").unionByName(oversized_pieces(chapters, "chapter_id", "content", limits, "chapters"))


def found(sft: DataFrame, chapters: DataFrame, limits: DataFrame) -> DataFrame:
    """(table_name, row_key) of the rows that were cut: each has exactly one piece number 0."""
    return all_pieces(sft, chapters, limits).where("piece_no = 0 and row_key is not null").select("table_name", "row_key")
