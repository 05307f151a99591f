"""Citations and streams of whole answers, not of their first code points."""

import re

import pytest

from quern.plans import catalog

Q = catalog.queries()
REF = re.compile(r"[【\[]\s*第\s*(\d+)\s*条\s*[】\]]|第\s*(\d+)\s*条")


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("answers"))
    long = "说明" * 30 + "【第12条】又见第999条。\n\"完\"" + "尾" * 25
    rows = [(1, long, [12], 1.5), (2, long, [], 2.25), (3, "", [3], 0.5), (4, None, [4], 1.0), (5, "正好十个字正好十个字", [5], 3.0)]
    spark.createDataFrame(rows, "id bigint, answer string, retrieved_ids array<bigint>, wall double").write.parquet(f"{d}/eval_rigor_results_v1_pre_guard.parquet")
    return d, rows


def test_citations_of_whole_answers(spark, answers):
    d, rows = answers
    got = {r["id"]: r["answer"] for r in Q["citation_check"](spark, d).collect()}
    for i, a, ids, _ in rows:
        full = f"{a or ''}【第{i % 7}条】见第{i % 600}条。"
        assert got[i] == (REF.sub(lambda m: m[0] if int(m[1] or m[2]) in ids else "", full) if ids else full)


def test_streams_of_whole_answers(spark, answers):
    d, rows = answers
    got = {r["id"]: (r["answer"], r["latency"]) for r in Q["sse_parse"](spark, d).collect()}
    assert got == {i: (a, w) for i, a, _, w in rows if a is not None}
