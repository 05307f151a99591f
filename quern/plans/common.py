"""Helpers of the catalog: reading tables and writing the same pattern for both engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    """A Java pattern of the common subset as a quoted RE2 one."""
    return lit(p.replace("(?md)", "(?m)").replace("(?U)", ""))


def replaced(expr: str, patterns: Sequence[str], by: str = "") -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, {rx(p)}, {lit(by)}, 'g')"
    return expr


def cut_words(expr: str, words: Sequence[str]) -> str:
    for w in words:
        expr = f"replace({expr}, {lit(w)}, '')"
    return expr


BLANK = r"[\s\x0b\x{85}\pZ]"


def stripped(expr: str) -> str:
    return f"regexp_replace({expr}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words(ws: Sequence[str]) -> str:
    return "[" + ", ".join(lit(w) for w in ws) + "]"
