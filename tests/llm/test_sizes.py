"""Packing containers and mixing sources."""

import numpy as np
import pytest

from quern.llm import mixing, packing

DOCS = "doc_id bigint, text string, source string, tokens string, size string"


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(5, 200))
    sizes = rng.integers(1, cap + 1, int(rng.integers(0, 400)))
    bins = packing.best_two_fit(sizes, cap)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= cap for b in bins)
    assert len(bins) <= 11 / 9 * max(1, -(-sizes.sum() // cap)) + 4 or (sizes > cap / 2).sum() >= len(bins) - 4


def test_best_two_replaces_the_smallest():
    assert sorted(sorted([7, 3, 2, 2][i] for i in b) for b in packing.best_two_fit(np.array([7, 3, 2, 2]), 11)) == [[2, 2, 7], [3]]


def test_packed(spark):
    rows = [(i, "字" * n, "s", "x", "y") for i, n in enumerate([1, 5, 30, 30, 600, 2, 9, 9, 9])] + [(50, None, "s", "x", "y"), (51, "", "s", "x", "y"), (None, "字", "s", "x", "y"), (0, "字", "s", "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    caps = spark.createDataFrame([("a", 16), ("b", 1000), ("none", None)], "profile string, capacity_tokens int")
    got = packing.packed(df, caps).collect()
    total = {p: sum(r["tokens"] for r in got if r["profile"] == p) for p in "ab"}
    assert total["a"] == total["b"] > 0
    for p, cap in (("a", 16), ("b", 1000)):
        used: dict = {}
        for r in got:
            if r["profile"] == p:
                used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
                assert r["start_token"] == r["part"] * cap
        assert max(used.values()) <= cap
    assert not {50, 51, None} & {r["doc_id"] for r in got}
    whole = {r["doc_id"] for r in got if r["profile"] == "b"}
    assert all(sum(r["doc_id"] == i and r["profile"] == "b" for r in got) == (2 if i == 0 else 1) for i in whole)
    assert packing.packed(df.limit(0), caps).count() == 0 and packing.packed(df, caps.limit(0)).count() == 0


def test_water_fill():
    t = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)]
    have = {"a": 100, "b": 1000, "c": 1000}
    assert mixing.water_fill(t, have) == pytest.approx({"a": 100, "b": 60, "c": 40})
    got = mixing.water_fill(t, have, 1000)
    assert got == pytest.approx({"a": 100, "b": 540, "c": 360})
    assert mixing.water_fill(t, {}) == {} and mixing.water_fill([], have) == {}
    assert sum(mixing.water_fill(t, have, 10**9).values()) == 100 + 2000 + 1000


def test_mixed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "字药" * int(rng.integers(1, 40)), ["a", "b", "c", None][i % 4], "x", "y") for i in range(800)] + [(9000, None, "a", "x", "y"), (9001, "", "b", "x", "y"), (None, "字" * 5, "a", "x", "y"), (0, "字" * 9, "a", "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    t = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("none", 0.1, 5), (None, 0.1, 1), ("c", None, 1)], "source string, target_share double, max_repeats int")
    sel, shares = mixing.mixed(df, t)
    s = {r["source"]: r for r in shares.collect()}
    assert s["a"]["actual_share"] == pytest.approx(0.6 / 0.9, abs=0.01) and s["b"]["actual_share"] == pytest.approx(0.3 / 0.9, abs=0.01) and s["none"]["tokens"] == 0
    got = sel.collect()
    assert {r["source"] for r in got} == {"a", "b"} and all(1 <= r["repeats"] <= {"a": 3, "b": 1}[r["source"]] for r in got)
    assert sum(r["tokens"] * r["repeats"] for r in got if r["source"] == "a") == s["a"]["tokens"]
    again = mixing.mixed(df, t)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mixed(df.limit(0), t)[0].count() == 0 and mixing.mixed(df, t.limit(0))[1].count() == 0


def test_mixed_with_a_binding_total(spark):
    """As many tokens as all sources hold: the small source is clamped, its weight goes to the others."""
    rng = np.random.default_rng(2)
    rows = [(i, "字药" * int(rng.integers(1, 40)), "a" if i % 10 == 0 else "bc"[i % 2], "x", "y") for i in range(1000)]
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    sel, shares = mixing.mixed(spark.createDataFrame(rows, DOCS), t, of_all=1.0)
    s = {r["source"]: r for r in shares.collect()}
    total = sum(r["source_tokens"] for r in s.values())
    assert s["a"]["tokens"] == 2 * s["a"]["source_tokens"] and {r["repeats"] for r in sel.where("source = 'a'").collect()} == {2}
    rest = total - s["a"]["tokens"]
    assert abs(s["b"]["tokens"] - rest * 0.6) < 60 and abs(s["c"]["tokens"] - rest * 0.4) < 60
    assert s["a"]["actual_share"] == pytest.approx(s["a"]["tokens"] / sum(r["tokens"] for r in s.values()), abs=1e-5)
