"""Overlap, near-duplicates and shared spans against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import common, kernels, neardup, overlap, spans

SFT = "sample_id bigint, instruction string, output string, split string, source string, id string, node string, text string"


def likeness(a, b):
    x, y = kernels.shingle_sets(a), kernels.shingle_sets(b)
    return len(x & y) / max(1, len(x | y))


def letters(t):
    return "".join(filter(str.isalnum, t or ""))


def text(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))


def edited(rng, t, times):
    for _ in range(times):
        i = rng.randrange(len(t))
        t = rng.choice([t[:i] + text(rng, 1) + t[i:], t[:i] + t[i + 1 :], t[:i] + text(rng, 1) + t[i + 1 :]])
    return t


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    rows, seeds = [], [text(rng, rng.randrange(60, 500)) for _ in range(40)]
    for t in seeds:
        for _ in range(rng.randrange(1, 5)):
            rows.append((rng.choice(["问甲", "问乙丙丁"]), rng.choice([t, edited(rng, t, rng.randrange(1, 9)), t + text(rng, 20), t[len(t) // 2 :] + "，" + t[: len(t) // 2]])))
    rows += [("问", None), ("问", ""), (None, seeds[0]), ("问", "短"), ("问", "　，。"), (None, None), ("问", text(rng, 20_000))]
    rows += [("问甲", seeds[1])] * 6
    return [(i, q, t, rng.choice(["train", "train", "val", "test", None]), "s", "x", "y", "z") for i, (q, t) in enumerate(rows)] + [(None, "问甲", seeds[1], "train", "s", "x", "y", "z"), (3, *rows[3], "train", "s", "x", "y", "z")]


def test_overlap(spark, records):
    df = spark.createDataFrame(records, SFT)
    got = {tuple(r) for r in overlap.found(df).collect()}
    ok = [r for r in records if r[0] is not None and r[3] and len(letters(r[2])) >= 60]
    want = set()
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if (a[3] == "train") != (b[3] == "train") and a[0] != b[0] and likeness((a[1] or "") + a[2], (b[1] or "") + b[2]) >= 0.70:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert len(want) > 10 and got == want


def test_overlap_report(spark, records):
    df = spark.createDataFrame(records, SFT)
    rows = {r["split"]: r for r in overlap.report(df).collect()}
    assert set(rows) == {"val", "test"}
    assert sum(r["pairs"] for r in rows.values()) >= len({tuple(r) for r in overlap.found(df).collect()})
    assert all(0 < r["mean_coverage"] <= 1 for r in rows.values())


def test_near_duplicates(spark, records):
    df = spark.createDataFrame(records, SFT)
    got = {tuple(r) for r in neardup.found(df).collect()}
    ok = [r for r in records if r[0] is not None and len(letters(r[2])) >= 60]
    root = {r[0]: r[0] for r in ok}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if likeness(a[2], b[2]) >= 0.60:
                root[find(a[0])] = find(b[0])
    ids = sorted(root)
    want = {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}
    assert len(want) > 20 and got == want
    groups = neardup.groups(df).collect()
    assert len({r["group_id"] for r in groups}) == len({find(x) for x in ids})


def test_shared_spans(spark):
    rng = random.Random(7)
    quote = [text(rng, 100), text(rng, 99), text(rng, 300), "甲" * 150]
    rows = [(i, text(rng, rng.randrange(50, 400)) + q + text(rng, rng.randrange(50, 400))) for i, q in enumerate(quote * 4)]
    rows += [(90, None), (91, ""), (92, "一"), (93, quote[0]), (94, quote[0]), (95, quote[1]), (None, quote[0]), (93, quote[0]), (96, quote[2][50:260] + "\n" + quote[0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, node string, id string")
    got = {tuple(r) for r in spans.found(df).collect()}
    wins = {i: {t[k : k + 100] for k in range(len(t) - 99)} for i, t in rows if t and i is not None}
    want = {(a, b) for a in wins for b in wins if a < b and wins[a] & wins[b]}
    assert len(want) > 15 and got == want
    cover = {r["id"]: r for r in spans.coverage(df).collect()}
    assert cover[93]["shared_chars"] == 100 and cover[95]["shared_chars"] == 0 and cover[90]["n_chars"] == 0
    assert cover[96]["shared_chars"] == 310
    long = {(r["start"], r["length"]) for r in spans.passages(df).where("id = 96").collect()}
    assert long == {(0, 210), (211, 100)}


@pytest.mark.parametrize("f,schema,cols", [(overlap.found, SFT, 2), (neardup.found, SFT, 2), (spans.found, "doc_id bigint, text string", 2)])
def test_empty(spark, f, schema, cols):
    df = f(spark.createDataFrame([], schema))
    assert df.count() == 0 and len(df.columns) == cols


def linker(rows, **over):
    rows = sorted(rows)
    old = {k: getattr(common, k) for k in over}
    for k, v in over.items():
        setattr(common, k, v)
    try:
        size = 3
        batches = (pa.record_batch([pa.array([r[0] for r in rows[i : i + size]], pa.int64()), pa.array([r[1] for r in rows[i : i + size]], pa.int64())], names=["label", "node"]) for i in range(0, len(rows), size))
        real = common.merged_batches
        common.merged_batches = lambda b: real(b, 4)
        try:
            out = [t for b in common.Linker((8, 16, 64), 4, True)(batches) for t in zip(*(b.column(i).to_pylist() for i in range(3)))]
        finally:
            common.merged_batches = real
    finally:
        for k, v in old.items():
            setattr(common, k, v)
    return out


@pytest.mark.parametrize("held,pairs", [(10**6, 10**6), (5, 10**6), (5, 2), (10**6, 2)])
def test_linker_loses_nothing_to_hot_groups(held, pairs):
    """Whatever a task may hold, pairs made and pairs of hot rows are those of the deepest depth at least."""
    rng = np.random.default_rng(3)
    rows = [(int(l), int(n)) for l, n in zip(rng.choice([5 << 56, (5 << 56) | 7, 6 << 56, (6 << 56) | (1 << 50)], 60), rng.integers(0, 40, 60))]
    out = linker(rows, HELD_ROWS=held, HELD_PAIRS=pairs)
    made = {(a, b) for a, b, hot in out if not hot}
    hot: dict[int, set] = {}
    for a, b, h in out:
        if h:
            hot.setdefault(a, set()).add(b)
    for s in hot.values():
        made |= {(min(a, b), max(a, b)) for a in s for b in s if (a ^ b) & 1}
    by: dict[int, set] = {}
    for label, n in rows:
        by.setdefault(label, set()).add(n)
    want = {(min(a, b), max(a, b)) for s in by.values() for a in s for b in s if (a ^ b) & 1}
    assert want <= made


def test_hot_pairs(spark):
    rows = [(1, n) for n in range(40)] + [(2, n) for n in range(3)]
    hot = spark.createDataFrame(rows, "p bigint, node bigint")
    got = {(r["a"], r["b"]) for r in common.hot_pairs(hot, True).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a, 40) if (a ^ b) & 1}
    plain = common.hot_pairs(hot, False)
    assert plain.count() == 40 * 39 // 2


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 102), (102, 100)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want: dict = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            s = want[a] | want[b]
            for x in s:
                want[x] = s
    assert got == {x: min(s) for x, s in want.items()}


def test_anchors_cover_shared_runs():
    rng = random.Random(1)
    shared = text(rng, 31)
    col = pa.array([text(rng, 200) + shared + text(rng, 100), shared, text(rng, 5) + shared])
    cp, starts = kernels.letters(col)
    h = kernels.window_hash(kernels.prefix_hash(cp), 16)
    at = kernels.anchors(h, starts, 16, 16)
    seen = [set(h[at[(at >= starts[i]) & (at < starts[i + 1])]].tolist()) for i in range(3)]
    assert seen[0] & seen[1] & seen[2]


def test_codepoints_slices_and_nulls():
    col = pa.array(["x", None, "甲😊", ""]).slice(1)
    cp, starts = kernels.codepoints(col)
    assert [chr(c) for c in cp] == ["甲", "😊"] and starts.tolist() == [0, 0, 2, 2]


def test_depth_is_shortened_to_the_recall():
    assert neardup.depth_for(0.6) == 4 and neardup.depth_for(0.9) == 6 and neardup.depth_for(0.1) == 1


@pytest.fixture
def hot(monkeypatch):
    """Groups count as hot at once, as in a table a third of whose rows are near copies."""
    monkeypatch.setattr(common, "HOT_SEEN", 10)
    monkeypatch.setattr(common, "SAMPLED", 1.0)


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(11)
    seed = text(rng, 150)
    rows = []
    for i in range(450):
        t = text(rng, 150)
        if i % 3 == 0:
            t = edited(rng, seed, rng.randrange(0, 4))
        rows.append((i, "问", t, "val" if i % 15 == 0 else "train", "s", "x", "y", "z"))
    return rows


def test_hot_near_duplicates(spark, hot, crowd):
    got = {r["id"]: r["group_id"] for r in neardup.groups(spark.createDataFrame(crowd, SFT)).collect()}
    assert {got[i] for i in range(0, 450, 3)} == {0} and len(set(got.values())) == 301


def test_hot_overlap(spark, hot, crowd):
    got = {tuple(r) for r in overlap.found(spark.createDataFrame(crowd, SFT)).collect()}
    a = [r for r in crowd if r[0] % 3 == 0]
    want = {tuple(sorted((x[0], y[0]))) for x in a for y in a if x[3] == "val" and y[3] == "train" and likeness(x[1] + x[2], y[1] + y[2]) >= 0.7}
    assert len(want) > 3000 and got == want


def test_hot_spans(spark, hot):
    rng = random.Random(13)
    quote = text(rng, 120)
    rows = [(i, text(rng, 60) + (quote if i % 3 == 0 else text(rng, 120)) + text(rng, 60)) for i in range(300)]
    got = {tuple(r) for r in spans.found(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    ids = range(0, 300, 3)
    assert got == {(a, b) for a in ids for b in ids if a < b}


def test_hot_labels(spark, hot):
    rows = spark.createDataFrame([(5 << 40, i) for i in range(50)] + [(i << 41, i) for i in range(1, 400)], "label bigint, node bigint")
    assert common.hot_labels(rows, 24) == [5] and common.hot_labels(rows.limit(0), 24) == []


def test_overlap_of_a_crowded_family(spark):
    """Seventy short edited copies: their groups hold far more pairs than a few, and no long run is shared by all."""
    rng = random.Random(17)
    rows = []
    for _ in range(2):
        seed = text(rng, 100)
        rows += [(len(rows) + i, "", edited(rng, seed, 2), "val" if i < 24 else "train", "s", "x", "y", "z") for i in range(70)]
    got = {tuple(r) for r in overlap.found(spark.createDataFrame(rows, SFT)).collect()}
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[3] == "val" and b[3] == "train" and likeness(a[2], b[2]) >= 0.7}
    assert len(want) > 500 and got == want


@pytest.mark.parametrize("held,pairs", [(10**6, 10**6), (5, 10**6), (5, 2), (10**6, 2)])
def test_crossing_keeps_all_groups_with_both_sides(monkeypatch, held, pairs):
    monkeypatch.setattr(common, "HELD_ROWS", held)
    monkeypatch.setattr(common, "HELD_PAIRS", pairs)
    real = common.merged_batches
    monkeypatch.setattr(common, "merged_batches", lambda b: real(b, 4))
    rng = np.random.default_rng(3)
    rows = sorted({(int(l), int(n)) for l, n in zip(rng.choice([-9, 1, 2, 3], 90), rng.integers(0, 40, 90))} | {(7, n) for n in range(0, 20, 2)})
    batches = (pa.record_batch([pa.array([r[0] for r in rows[i : i + 3]], pa.int64()), pa.array([r[1] for r in rows[i : i + 3]], pa.int64())], names=["label", "node"]) for i in range(0, len(rows), 3))
    out = [t for b in overlap._crossing(batches) for t in zip(*(b.column(i).to_pylist() for i in range(3)))]
    assert {r for r in rows if r[0] != 7} <= {t[:2] for t in out} <= set(rows) and len(out) == len(set(out))


def test_near_duplicates_compare_whole_buckets(spark):
    """A family in which few pairs are alike: another member stands between them in their bucket."""
    rng = random.Random(19)
    seed = text(rng, 200)
    rows = [(i, "", edited(rng, seed, 7), "train", "s", "x", "y", "z") for i in range(150)]
    got = {r["id"]: r["links"] for r in neardup.groups(spark.createDataFrame(rows, SFT)).collect()}
    want = {a[0]: sum(likeness(a[2], b[2]) >= 0.6 for b in rows if b is not a) for a in rows}
    assert sum(want.values()) > 1000
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.97 * sum(want.values())


def test_linker_pairs_small_middle_groups_of_a_large_one():
    rows = [((5 << 56) | (m << 48) | x, 2 * m + x) for m in range(1, 20) for x in (0, 1)]
    made = {(a, b) for a, b, hot in linker(rows, HELD_ROWS=5) if not hot}
    assert made >= {(2 * m, 2 * m + 1) for m in range(1, 20)}


def cross_split(rows):
    return {tuple(sorted((a[0], b[0]))) for a in rows if a[3] != "train" for b in rows if b[3] == "train" and likeness((a[1] or "") + a[2], (b[1] or "") + b[2]) >= 0.7}


@pytest.mark.parametrize("run", [29, 34, 40])
def test_overlap_of_form_letters(spark, run):
    """Letters identical but for one letter after every run: each run stands in all of them."""
    rng = random.Random(run)
    runs = [text(rng, run) for _ in range(400 // run)]
    rows = [(i, "", "".join(r + text(rng, 1) for r in runs), "val" if i < 30 else "train", "s", "x", "y", "z") for i in range(150)]
    got = {tuple(r) for r in overlap.found(spark.createDataFrame(rows, SFT)).collect()}
    want = cross_split(rows)
    assert len(want) == 3600 and got == want


def test_overlap_of_short_records(spark):
    """Isolated pairs of 62 letters with one or two edits: few and short shared runs."""
    rng = random.Random(23)
    rows, want = [], set()
    for i in range(400):
        one = text(rng, 62)
        two = edited(rng, one, 1 + i % 2)
        rows += [(2 * i, "", one, "test", "s", "x", "y", "z"), (2 * i + 1, None, two, "train", "s", "x", "y", "z")]
        if likeness(one, two) >= 0.7 and len(two) >= 60:
            want.add((2 * i, 2 * i + 1))
    got = {tuple(r) for r in overlap.found(spark.createDataFrame(rows, SFT)).collect()}
    assert len(want) > 350 and got <= want and len(got) >= 0.99 * len(want)


def test_overlap_behind_a_phrase_of_all_records(spark):
    """A long opening that every record has does not hide what pairs share besides."""
    rng = random.Random(29)
    opening, rows = text(rng, 120), []
    for i in range(120):
        own = text(rng, 120)
        rows += [(2 * i, opening, own, "val", "s", "x", "y", "z"), (2 * i + 1, opening, edited(rng, own, 3), "train", "s", "x", "y", "z")]
    got = {tuple(r) for r in overlap.found(spark.createDataFrame(rows, SFT)).collect()}
    assert got == cross_split(rows) and len(got) >= 120


def test_overlap_merges_spans_of_all_partners(spark):
    rng = random.Random(31)
    one, two, own = text(rng, 300), text(rng, 300), text(rng, 60)
    rows = [(1, "", one + two + own, "val", "s", "x", "y", "z"), (2, "", one + two[:250], "train", "s", "x", "y", "z"), (3, "", one[50:] + two, "train", "s", "x", "y", "z"), (4, "", text(rng, 90), "test", "s", "x", "y", "z")]
    got = {r["id"]: r for r in overlap.records(spark.createDataFrame(rows, SFT)).collect()}
    assert got[1]["copies"] == 2 and abs(got[1]["coverage"] - 600 / 660) < 1e-9 and got[4]["coverage"] is None


def test_near_duplicates_among_boilerplate(spark):
    """Pairs just above the threshold, all of whose texts share a long notice, are told from the others."""
    rng = random.Random(37)
    notice, rows = text(rng, 300), []
    for i in range(120):
        own = text(rng, 124)
        rows += [(2 * i, "", notice + own, "train", "s", "x", "y", "z"), (2 * i + 1, "", notice + own[:29] + text(rng, 95), "train", "s", "x", "y", "z")]
    assert 0.60 < likeness(rows[0][2], rows[1][2]) < 0.65 and likeness(rows[0][2], rows[2][2]) < 0.60
    got = {tuple(r) for r in neardup.found(spark.createDataFrame(rows, SFT)).collect()}
    want = {(2 * i, 2 * i + 1) for i in range(120)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_a_quotation_of_all_documents_stays_linear(spark):
    """Coverage and passages hold one row per text and repeat, however many texts share it, and no pairs."""
    rng = random.Random(41)
    quote = text(rng, 110)
    own = [chr(0x4E00 + i) for i in range(6000)]  # what stands beside the quotation differs
    rows = [(i, text(rng, 29) + c + quote + c + text(rng, 29)) for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs, _ = spans.shared_spans(df)
    assert runs.count() <= 10 * len(rows)  # one for each of the few suffixes that begin in the quotation
    got = spans.coverage(df).groupBy("shared_chars", "most_texts").count().collect()
    assert [tuple(r) for r in got] == [(110, 5999, 6000)]
    assert {tuple(r)[1:] for r in spans.passages(df).limit(50).collect()} == {(30, 110, 5999)}


def test_nested_repeats(spark):
    """A repeat of three texts inside a longer one of two."""
    rng = random.Random(43)
    inner, left, right = text(rng, 150), text(rng, 120), text(rng, 120)
    rows = [(1, left + inner + right), (2, text(rng, 20) + left + inner + right), (3, text(rng, 50) + inner + text(rng, 40)), (4, inner[:99])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in spans.found(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    cover = {r["id"]: (r["shared_chars"], r["most_texts"]) for r in spans.coverage(df).collect()}
    assert cover == {1: (390, 2), 2: (390, 2), 3: (150, 2), 4: (0, 0)}
    assert (3, 50, 150, 2) in {tuple(r) for r in spans.passages(df).collect()}


@pytest.mark.parametrize("held,size", [(10**6, 7), (5, 3), (1, 1), (5, 40)])
def test_runs_are_whole_or_marked(monkeypatch, held, size):
    monkeypatch.setattr(common, "HELD_ROWS", held)
    rng = np.random.default_rng(5)
    keys = np.sort(rng.choice([-5, 1, 2, 3, 9], 120)).tolist()
    batches = [pa.record_batch([pa.array(keys[i : i + size]), pa.array(range(i, min(i + size, 120)))], names=["k", "v"]) for i in range(0, 120, size)]
    seen, whole = [], {}
    for t, large in common.runs(iter(batches), size):
        seen += t.column("v").to_pylist()
        for k in set(t.column("k").to_pylist()):
            assert large or k not in whole
            whole[k] = large
            if not large:
                assert t.column("k").to_pylist().count(k) == keys.count(k)
    assert seen == list(range(120))
