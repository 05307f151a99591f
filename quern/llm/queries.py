"""The pN_ queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, canonical, defects, mixing, neardup, overlap, packing, pieces, scans, spans

_CANON = {"clauses": ("clause_id", "original_text"), "pages": ("page_id", "text")}



def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _t(s, d, "sft_samples"), _t(s, d, "chapters"), _t(s, d, "size_limits")


def _canonical_texts(s: SparkSession, d: str) -> DataFrame:
    forms = canonical.canonical_texts([(_t(s, d, t), *c) for t, c in _CANON.items()])
    return forms.select(F.array(*[F.lit(t) for t in _CANON])[F.col("tab")].alias("table_name"), F.col("key").alias("row_key"), "canonical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: overlap.found(_t(s, d, "sft_samples")),
        "p1_records": lambda s, d: overlap.records(_t(s, d, "sft_samples")),
        "p1_report": lambda s, d: overlap.report(_t(s, d, "sft_samples")),
        "p2_found": lambda s, d: neardup.found(_t(s, d, "sft_samples")),
        "p2_groups": lambda s, d: neardup.groups(_t(s, d, "sft_samples")),
        "p3_found": lambda s, d: canonical.found({t: (_t(s, d, t), *c) for t, c in _CANON.items()}),
        "p3_texts": _canonical_texts,
        "p4_found": lambda s, d: defects.found(_t(s, d, "sft_samples"), _t(s, d, "eval_rigor_results_v1_pre_guard")),
        "p4_counts": lambda s, d: defects.found(_t(s, d, "sft_samples"), _t(s, d, "eval_rigor_results_v1_pre_guard")).groupBy("table_name", "defect").agg(F.count(F.lit(1)).alias("n")),
        "p5_found": lambda s, d: pieces.found(*_sized(s, d)),
        "p5_pieces": lambda s, d: pieces.all_pieces(*_sized(s, d)),
        "p6_found": lambda s, d: boilerplate.found(_t(s, d, "pages")),
        "p6_lines": lambda s, d: boilerplate.lines_by_source(_t(s, d, "pages")),
        "p6_pages": lambda s, d: boilerplate.cleaned(_t(s, d, "pages")),
        "p7_found": lambda s, d: scans.found({"pages": (_t(s, d, "pages"), "page_id", "text"), "chapters": (_t(s, d, "chapters"), "chapter_id", "content")}),
        "p7_pages": lambda s, d: scans.repaired(_t(s, d, "pages"), "page_id", "text"),
        "p7_chapters": lambda s, d: scans.repaired(_t(s, d, "chapters"), "chapter_id", "content"),
        "p8_containers": lambda s, d: packing.packed(_t(s, d, "documents"), _t(s, d, "container_sizes")),
        "p8_fill": lambda s, d: packing.fill_report(_t(s, d, "documents"), _t(s, d, "container_sizes")),
        "p9_selection": lambda s, d: mixing.mixed(_t(s, d, "documents"), _t(s, d, "mix_targets"))[0],
        "p9_shares": lambda s, d: mixing.mixed(_t(s, d, "documents"), _t(s, d, "mix_targets"))[1],
        "p9_whole_selection": lambda s, d: mixing.mixed(_t(s, d, "documents"), _t(s, d, "mix_targets"), of_all=1.0)[0],
        "p9_whole_shares": lambda s, d: mixing.mixed(_t(s, d, "documents"), _t(s, d, "mix_targets"), of_all=1.0)[1],
        "p10_found": lambda s, d: spans.found(_t(s, d, "documents")),
        "p10_spans": lambda s, d: spans.passages(_t(s, d, "documents")),
        "p10_coverage": lambda s, d: spans.coverage(_t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": "SELECT 'sft_samples' AS table_name, sample_id AS row_key FROM sft_samples, size_limits l WHERE l.table_name = 'sft_samples' AND length(output) > l.max_chars UNION ALL SELECT 'chapters', chapter_id FROM chapters, size_limits l WHERE l.table_name = 'chapters' AND length(content) > l.max_chars",
    }
