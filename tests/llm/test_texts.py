"""Canonical text, defects, pieces, repeated lines and scanned pages."""

import random
import unicodedata as U

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import boilerplate, canonical, defects, pieces, scans

SAME = [
    ("七钱，８ mg。", "七钱,8 mg。"), ("⼤⽓", "大气"), ("⻩芩⻛", "黄芩风"), ("不力", "不力"), ("méі уún", "méi yún"), ("é", "é"), ("甲​乙⁠︀\U000e0100", "甲乙"), ("a　b c\xa0d\te", "a b c d e"),
    ("㎎℃Ⅱ", "mg°CII"), ("ＢＭІ", "BMI"), ("line\r\nnext", "line\nnext"), ("dai‐gan", "dai-gan"), ("ё", "ë"), ("привет", "привeт"), ("ﬁ", "fi"),
]
OTHER = [("末", "未"), ("己", "已"), ("甲", "甲乙"), ("a b", "ab"), ("x²", "x2"), ("l", "1"), ("O", "0"), ("①", "1"), ("甲\n乙", "甲 乙")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_print(a, b):
    assert canonical.canonical(a) == canonical.canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_print(a, b):
    assert canonical.canonical(a) != canonical.canonical(b)


def test_radicals_are_pairs():
    assert all(0x2E80 <= ord(k) <= 0x2EF3 and "CJK UNIFIED" in U.name(v) for k, v in canonical.RADICALS.items()) and len(canonical.RADICALS) >= 90


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_canonical_is_a_fixed_point(t):
    c = canonical.canonical(t)
    assert canonical.canonical(c) == c


def test_vocabulary_changes_spelling_never_equality():
    trie = canonical.Trie([("BMI", 5), ("mg", 3), ("cok", 1)])
    for a, b in SAME:
        assert canonical.canonical(a, trie) == canonical.canonical(b, trie)
    assert trie.spelling("ΒМ​І") == "BMI" and trie.spelling("BMX") is None


def test_trie_weighs_edits():
    words = [("сахар", 5), ("ginger", 3), ("ginseng", 9)]
    assert canonical.Trie(words).spelling("сaхap") == "сахар" and canonical.Trie(words).spelling("gínger") is None
    near = canonical.Trie(words, limit=1)
    assert near.spelling("gimger") == near.spelling("gnger") == near.spelling("ginnger") == "ginger" and near.spelling("ｇｉｎ​ｇｅｒ") == "ginger" and near.spelling("gingko") is None


def test_the_vocabulary_chooses_the_spelling(spark):
    """Letters all of which have Latin twins: the table would write Latin, the corpus writes Cyrillic."""
    rows = [(i, "сахар и рис") for i in range(6)] + [(10, "сaхар и рис"), (11, "caxap и рис"), (12, "мёд"), (13, None), (14, "ﬁn BМI"), (15, "BMI"), (16, "BMI")]
    df = spark.createDataFrame(rows, "k bigint, t string")
    got = {r["key"]: r["canonical"] for r in canonical.canonical_texts([(df, "k", "t")]).collect()}
    assert got[10] == got[11] == got[0] == "сахар и рис" and canonical.canonical("сaхар") == "caxap"
    assert got[13] is None and got[14] == "fin BMI" and got[12] == "мёд"
    assert {tuple(r)[1:] for r in canonical.found({"a": (df, "k", "t")}).collect()} == {(i, j) for i in range(6) for j in (10, 11)} | {(10, 11)}


def test_canonical_found(spark):
    rows = [(1, "七钱，8"), (2, "七钱,8"), (3, "七钱,8"), (4, None), (5, ""), (6, "​"), (7, "别的"), (None, "七钱，８"), (8, "x" * 50_000), (9, "ｘ" * 50_000), (2, "七钱,8")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "k bigint, t string, canonical string")
    got = {tuple(r) for r in canonical.found({"a": (df, "k", "t"), "b": (df.limit(0), "k", "t")}).collect()}
    assert got == {("a", 1, 2), ("a", 1, 3), ("a", 5, 6), ("a", 8, 9)}
    assert df.count() == canonical.canonical_texts([(df, "k", "t")]).count()


Q = "请讲解樟霰散的组成和用法。"
CASES = [
    (None, "empty"), ("", "empty"), ("　\n", "empty"), ("……", "empty"), ("N/A", "empty"), ("（空）", "empty"), ("回答：\n", "empty"), ("​", "empty"), (Q, "copy"), ("问题：" + Q, "copy"), (Q + "\n" + Q, "copy"), (Q[:-1] + "？？", "copy"),
    ("抱歉，我无法回答这个问题，请咨询医师。", "refusal"), ("作为语言模型，我没有办法判断！", "refusal"), ("关于“" + Q + "”，该内容不予回答。", "refusal"), ("As an AI model I cannot give such advice.", "refusal"), ("您来信说：" + Q + "\n恕我不能作答。", "refusal"),
    ("他一上来就说“我无法回答”，我笑一笑，继续讲。桂枝三两配生姜四钱，一升一降，肝就通了。", None), (Q + "\n桂枝三两配生姜四钱，一升一降，肝就通了，各位自己体会。再把脉看舌头，不要弄反。", None),
    ("In spring the tired baker drank the powder and his knees eased.", "other_language"), ("腰がむくむうえに腰が痛むときは、湯を九日のみます。", "other_language"), ("桂枝三两配生姜四钱，一升一降，因为", "truncated"), ("共有三种情形：\n1. 发干\n2.", "truncated"),
    ("共有三种情形：\n1. 发干。\n2. 发凉。", "truncated"), ("共有两种情形：\n1. 发干。\n2. 发凉。", None), ("方子是（桂枝三两、", "truncated"), ("他说：“胃津液干。”", None), ("就这样讲完了。记住了吧？😊", None), ("桂枝主治太阳病。【完】", None), ("```\nx = 1。", "truncated"),
]


@pytest.mark.parametrize("answer,kind", CASES)
def test_defect(answer, kind):
    assert defects.defect(Q, answer) == kind


def test_asked_language_is_no_defect():
    assert defects.defect(Q + "（请用英文回答）", "In spring the tired baker drank the powder and his knees eased.") is None
    assert defects.defect("How does it act on the knees?", "In spring the tired baker drank the powder and his knees eased.") is None


def test_defects_table(spark):
    rows = [(i, Q, a) for i, (a, _) in enumerate(CASES)] + [(None, None, None), (99, None, "甲。"), (98, Q, "长句，" * 30_000 + "完。"), (97, "", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "n bigint, q string, a string, defect string")
    got = {r["row_key"]: r["defect"] for r in defects.defects(df, "n", "q", "a", "t").collect()}
    assert got == {i: k for i, (_, k) in enumerate(CASES) if k} | {None: "empty", 97: "empty"}
    assert defects.defects(df.limit(0), "n", "q", "a", "t").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="甲乙。，\n a", max_size=400), st.integers(2, 40), st.integers(0, 20))
def test_pieces_round_trip(t, most, overlap):
    overlap = min(overlap, most - 1)
    got = pieces.split(t, most, overlap)
    assert "".join(t[f:e] for _, f, e in got) == t
    assert all(0 < e - s <= most for s, _, e in got)
    assert all(f - s == min(overlap, f) for s, f, _ in got[1:])


def test_pieces_end_where_the_text_pauses():
    t = ("甲" * 30 + "。") * 40
    assert all(t[e - 1] == "。" for _, _, e in pieces.split(t, 200, 20))
    with pytest.raises(ValueError):
        pieces.split(t, 10, 10)


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, "甲" * 11, "p"), (2, "甲" * 10, "p"), (3, None, "p"), (4, "", "p"), (None, "乙" * 30, "p"), (1, "甲" * 11, "p"), (5, "😊" * 11, "p")], "id bigint, t string, piece string")
    lim = spark.createDataFrame([("x", "t", 10, 2), ("y", "t", 1, 0)], "table_name string, field_name string, max_chars int, overlap_chars int")
    rows = pieces.oversized_pieces(df, "id", "t", lim, "x").collect()
    assert sorted(r["row_key"] or 0 for r in rows if r["piece_no"] == 0) == [0, 1, 1, 5] and max(len(r["piece"]) for r in rows) == 10
    assert pieces.oversized_pieces(df, "id", "t", lim, "none").count() == 0


def brute_lines(rows):
    seen, at, size = {}, {}, {}
    for pid, src, t in rows:
        if pid is None:
            continue
        size[src] = size.get(src, 0) + 1
        for n, line in enumerate((t or "").split("\n"), 1):
            k = "".join(c for c in U.normalize("NFKC", line) if not c.isspace() and not c.isdigit())
            if sum(map(str.isalnum, k)) >= 6:
                seen.setdefault((src, k), set()).add(pid)
                at.setdefault((src, k), []).append((pid, n))
    return {x for k, s in seen.items() if len(s) >= 4 and len(s) >= 0.2 * size[k[0]] for x in at[k]}


def test_repeated_lines(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(n))
    notes = [word(12), "ＡＢＣdef一二 " + word(5), word(5), "cafés " + word(6), word(70)]
    rows = []
    for i in range(120):
        ls = [word(30) for _ in range(4)] + [n + " " + str(rng.randrange(99)) for n in notes if rng.random() < 0.4] + [""]
        rng.shuffle(ls)
        rows.append((i, rng.choice(["p1", "p2", None, "p3"]), "\n".join(ls).replace("\n", "\r\n", 1)))
    rows += [(500, "p1", None), (501, "p1", ""), (502, "small", notes[0]), (None, "p1", notes[0]), (503, "p2", "\n".join([notes[0]] * 3))]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, pdf_name string, text string, line int")
    want = brute_lines(rows)
    assert len(want) > 50 and {tuple(r) for r in boilerplate.found(df).collect()} == want
    clean = {r["page_id"]: r for r in boilerplate.cleaned(df).collect()}
    assert all(clean[i]["text"] == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want) for i, _, t in rows if t and i is not None)
    lines = boilerplate.lines_by_source(df).collect()
    assert sum(r["places"] for r in lines) == len(want) and all(r["n_rows"] <= r["places"] for r in lines)
    assert boilerplate.found(df.limit(0)).count() == 0


def test_line_marks():
    t = "灯下辨证卷六·识表里\n正文hyp-\nertension。\n— 12 —\n第 3 页\n[27]\n12 /300\n18 味药\np. 9"
    assert [(k, n) for k, n, _ in scans.line_marks(t)] == [("broken_word", 2), ("header", 1), ("page_number", 4), ("page_number", 5), ("page_number", 6), ("page_number", 7), ("page_number", 9)]


def test_scans(spark):
    good = [f"各位自己体会，如果舌苔白，这时候{x}才有用武之地，已经拖了{n}天，hypertension这个词。" for n, x in enumerate("甲乙丙丁戊己庚辛壬癸" * 3)]
    bad = {100: "各位自已体会，如果舌苔白。", 101: "各位自己体会，如杲舌苔白，己经拖了三天。", 102: "舌苔白，hyperte-\nnsi0n这个词。", 103: "荷塘针语卷二·说汗下\n各位自己体会，如果\n舌苔白。\n12", 104: "荷塘针语卷三·说汗下\n各位自己体会。"}
    rows = [*enumerate(good), *bad.items(), (200, None), (201, ""), (None, "如杲舌苔白"), (202, "今日的卷子·没有别的")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "id bigint, t string, noise string")
    got = {(r["row_key"], r["noise"]) for r in scans.found({"a": (df, "id", "t"), "b": (df.limit(0), "id", "t")}).collect()}
    assert got == {(100, "misread"), (101, "misread"), (102, "misread"), (102, "broken_word"), (103, "header"), (103, "page_number"), (104, "header")}
    done = {r["row_key"]: r["text"] for r in scans.repaired(df, "id", "t").collect()}
    assert done[101] == "各位自己体会，如果舌苔白，已经拖了三天。" and done[102] == "舌苔白，hypertension这个词。" and done[103] == "各位自己体会，如果舌苔白。"
    assert done[200] is None and done[201] == "" and len(done) == len({r[0] for r in rows})


def test_empty_scans(spark):
    df = spark.createDataFrame([], "id bigint, t string")
    assert scans.found({"a": (df, "id", "t")}).count() == 0 and scans.repaired(df, "id", "t").count() == 0


def test_marks_centred_with_many_blanks():
    from quern.llm.scans import line_marks

    assert line_marks("甲\n" + " " * 80 + "- 12 -") == [("page_number", 2, None)]
    assert line_marks("甲\n" + "　" * 70 + "伤寒论 卷三 · 太阳病") == [("header", 2, "伤寒论")] and line_marks("甲\n" + "字" * 70 + "12") == []


def test_defects_of_any_length():
    from quern.llm import defects

    filler = min((f for f in defects.FILLERS if f), key=len)
    assert defects.defect("问", filler + "." * 200) == "empty"
    assert defects.defect("什么是桂枝汤", "抱歉，我无法回答这个问题。" * 60) == "refusal"


def test_other_shapes_of_marks():
    kinds = lambda t: [k for k, _, _ in scans.line_marks(t)]
    assert kinds("Chapter 3 | Fever") == ["header"] and kinds("The Pulse, Vol. IV: Fevers") == ["header"]
    assert kinds("xii") == kinds("十二") == kinds("— iv —") == ["page_number"]
    assert kinds("civic") == kinds("i") == kinds("第三讲") == kinds("18 味药") == []


def test_glyphs_are_learned_from_the_corpus(spark):
    """A pair that no table holds: the misread letter stands only where another one usually does."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(n))
    places = [(word(4), word(4)) for _ in range(12)]
    rows = [(i, f"{word(5)}，{places[i % 12][0]}鑫{places[i % 12][1]}。", "z") for i in range(240)]
    rows += [(1000 + i, f"{word(5)}，{places[i % 12][0]}淼{places[i % 12][1]}。", "z") for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, t string, noise string")
    base = scans._base([(df, "id", "t")])
    assert scans.learned(base) == ("鑫淼",) and scans.learned(base.limit(0)) == ()
    got = {(r["row_key"], r["noise"]) for r in scans.found({"a": (df, "id", "t")}).collect()}
    assert got == {(1000 + i, "misread") for i in range(12)}


def test_glyphs_are_learned_from_all_rows(spark):
    """Six misread letters in a corpus of 100,000 rows, and a misreading of a letter that shares another one's places."""
    places = [("天地玄黄", "宇宙洪荒"), ("日月盈昃", "辰宿列张"), ("寒来暑往", "秋收冬藏")]
    rows = [(i, f"甲，{a}{x}{b}。", "z") for i, (x, (a, b)) in enumerate([("鑫", p) for p in places * 20] + [("淼", p) for p in places * 2])]
    rows += [(1000 + i, f"甲，{a}大{x}{b}。", "z") for i, (x, (a, b)) in enumerate([(x, p) for p in places for x in "黄" * 40 + "枣" * 4 + "束" * 2])]
    rows += [(1200 + i, "甲，闰余成枣岁律吕。", "z") for i in range(20)]
    more = spark.range(2000, 102_000, numPartitions=8).selectExpr("id", "'乙' as t", "'z' as noise")
    df = spark.createDataFrame(rows, "id bigint, t string, noise string").unionByName(more)
    assert scans.learned(scans._base([(df, "id", "t")])) == ("鑫淼",)
    got = {(r["row_key"], r["noise"]) for r in scans.found({"a": (df, "id", "t")}).collect()}
    assert got >= {(60 + i, "misread") for i in range(6)} and all(60 <= k < 66 or k >= 1000 for k, _ in got)


def test_packed_counts_of_glyphs_are_whole(monkeypatch):
    """However the letters fall to batches, tasks and ranges, every one with its surroundings is counted once."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("天地玄黄 a\n") for _ in range(rng.randrange(40))) for _ in range(300)] + ["天地玄黄天地玄" * 9] * 40
    want: dict = {}
    for t in texts:
        t = "".join(t.split())
        for i in range(3, len(t) - 3):
            if t[i] >= "一":
                here = want.setdefault((t[i - 3 : i], t[i + 1 : i + 4]), {})
                here[t[i]] = here.get(t[i], 0) + 1
    sums: dict = {}
    for here in want.values():
        n, top = max((n, x) for x, n in here.items())
        if sum(here.values()) >= scans.FREQUENT and n >= sum(here.values()) * scans.LEADS:
            for x, n in here.items():
                a, b = sums.get((ord(top), ord(x)), (0, 0))
                sums[ord(top), ord(x)] = a + n, b + 1
    monkeypatch.setattr(scans, "HELD_LETTERS", 500)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 37])], ["text"]) for i in range(0, len(texts), 37)]
    packed = sorted((r for b in scans._counted(iter(batches)) for r in b.to_pylist()), key=lambda r: r["range"])
    got: dict = {}
    for b in scans._led(iter([pa.RecordBatch.from_pylist(packed[i : i + 50], scans._PACKED) for i in range(0, len(packed), 50)])):
        for r in b.to_pylist():
            a, c = got.get((r["right"], r["read"]), (0, 0))
            got[r["right"], r["read"]] = a + r["n"], c + r["places"]
    assert got == sums and len(sums) > 4


@pytest.mark.parametrize("answer,kind", [
    ("<div><p>桂枝三两，一升一降。", "truncated"), ("<div><p>桂枝三两，一升一降。</p></div>", None), ("<!-- 桂枝三两，一升一降。", "truncated"), ("桂枝**三两，一升一降。", "truncated"), ("桂枝**三两**，一升一降。", None), ("他说\"桂枝三两，一升一降。", "truncated"),
    ("他说\"桂枝三两\"，一升一降。", None), ("~~~\nx = 1\n~~~", None), ("先看代码：\n```\nx = (1\n```", None), ("用`桂枝三两。", "truncated"), ("桂枝三两，一升一降。<di", "truncated"), ("（一）桂枝三两。\n（二）一升一降。", None), ("1) 桂枝三两。\n2) 一升一降。", None),
    ("El cansado panadero bebió el polvo en la primavera y sus rodillas se aliviaron.", "other_language"), ("Весной усталый пекарь выпил порошок, и его колени отпустило.", "other_language"), ("봄에 지친 제빵사가 가루를 마시고 무릎이 편해졌습니다.", "other_language"),
    ("略" + " " * 70, "empty"), (Q * 60, "copy"), ("抱歉，我无法回答这个问题，请咨询医师。" * 20, "refusal"), (("关于“" + Q + "”，恕我无法作答。") * 9, "refusal"),
])
def test_defect_by_the_parsers(answer, kind):
    assert defects.defect(Q, answer) == kind


def test_uncovered_counts_what_no_run_holds():
    rng = random.Random(7)
    for _ in range(300):
        q, body = ("".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        least = min(5, len(q))
        held = [any(body[s : s + least] in q for s in range(max(0, i - least + 1), i + 1) if s + least <= len(body)) for i in range(len(body))]
        assert defects.uncovered(body, q, least, 99) == held.count(False)
