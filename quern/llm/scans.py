"""Problem 7: noise in text from scanned pages."""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K
from .canonical import canonical

# Glyphs of similar shape, the right one first and its misreading second.
GLYPHS = (
    "有冇 候侯 己已 已己 己巳 道遒 出岀 果杲 心芯 上土 因囚 常當 体休 记汜 子孑 复夏 气汽 天夭 苔笞 以似 走赱 便使 凉谅 归旧 粥弼 泻泄 黄簧 母毋 枣束 石右 胃胄 "
    "柴紫 膝滕 嗓噪 生主 早旱 怕伯 杏否 甘廿 茯获 芩苓 半羊 日曰 末未 未末 干千 午牛 刀力 目且 田由 失矢 治冶 沙抄 脉咏 麻床 芍药 薄簿 桂挂 枝技 附咐 贝见 平乎 朴扑 枳织 术木 来耒 "
    "火灭 手毛 皮彼 耳茸 舌古 喉猴 背肯 腰耍 低底 指脂 人入 大太 陈阵 萄葡 侧测 没汉 冷泠 晴睛 清请 情清 微徵 折拆 拆折 鸟乌 析折 酸唆 痛疝 热垫 寒塞 湿显 肺沛 肾贤 脾牌 胆担 附咐 仲伸 厚原 续读 断渐 枸构 杞祀 草革 姜羌 归扫 龙尤 骨滑 细绌 辛幸 热垫 温湿 眼眠 顶项 尖尘 根很"
)
# Latin letters and what they are misread as.
LATIN = (("e", "c"), ("m", "rn"), ("h", "li"), ("d", "cl"), ("l", "1"), ("i", "1"), ("o", "0"))
#: A reading is wrong where its contexts together make another one of its glyph class so many times likelier, one of
#: them at least so many times, having seen the other so often.
ODDS, TIMES, SEEN = 10, 3, 4
#: A reading stands where one of its contexts has it so often, and no other one as often.  One that contexts speak
#: against so often, and so many times as often as it stands, is taken as wrong wherever it does not stand.
STANDS, ENOUGH, MOSTLY = 3, 5, 20
#: Learning glyphs: letters looked at on either side, occurrences of such surroundings and the share one letter must
#: have there, surroundings in which the other is met, and how much oftener there than as the leading one.
REACH, FREQUENT, LEADS, PLACES, MISREAD_ODDS = 3, 5, 0.75, 3, 4

_HYPHENS = "-‐‑¬­"
_BROKEN = re.compile(rf"[A-Za-zÀ-ɏ01][{_HYPHENS}][ \t]*\r?(?:\n|$)")
_HAN_NUMERAL = "[一二三四五六七八九十百〇零]"
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = re.compile(
    rf"^\W*(?:(?:第|p{{1,2}}|page|no)\W*)?(?:\d{{1,6}}|{_HAN_NUMERAL}{{1,5}}|(?=\w\w|\W*[-—·\[(])\W*{_ROMAN})\W*(?:页\W*)?(?:(?:共|of|/)\W*(?:\d{{1,6}}|{_HAN_NUMERAL}{{1,5}})\W*(?:页)?)?\W*$",
    re.I,
)
_MAY_MARK = re.compile(r"[\d卷册编集部辑第]")
_BARE = re.compile(rf"\W*(?:{_HAN_NUMERAL}+|[ivxlc]+)\W*$", re.I)
_PARTS = ("chapter", "vol", "part", "book")
_PART = rf"(?:{_HAN_NUMERAL}|\d){{1,5}}"
_HEADER = re.compile(
    rf"^\W*(?:(?P<han>[一-鿿]{{2,10}})\W*(?:卷|册|编|集|部|辑|第)\W*{_PART}\W*(?:卷|册|编|篇|章|回|讲|节)?\W*[·•・:：|｜\-—]\W*[一-鿿]{{2,10}}"
    rf"|(?P<latin>[A-Za-zÀ-ɏ]{{0,40}}?)\W*(?:chapter|volume|vol|part|book)\W*(?:\d{{1,4}}|{_ROMAN})\W*[·•:|｜\-—]\W*[A-Za-zÀ-ɏ]{{2,40}})\W*$",
    re.I,
)
#: Letters that a line of any of these forms holds at most.
MOST_LETTERS = 100


@lru_cache(maxsize=4)
def _classes(pairs: tuple[str, ...] = tuple(GLYPHS.split())) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: class of similar glyphs (0: none), form used in contexts, and whether it is a misreading."""
    group: dict[str, str] = {}

    def root(x: str) -> str:
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    wrong = np.zeros(0x110000, dtype=bool)
    for right, bad in pairs:
        group[root(bad)] = root(right)
        wrong[ord(bad)] = True
    cls = np.zeros(0x110000, dtype=np.uint32)
    form = np.arange(0x110000, dtype=np.uint32)
    for x in list(group):
        cls[ord(x)] = form[ord(x)] = ord(root(x))
    for a, z, to in ((65, 91, 97), (0xFF21, 0xFF3B, 97), (0xFF41, 0xFF5B, 97)):
        form[a:z] = np.arange(to, to + z - a)
    form[ord("1")], form[ord("0")] = ord("l"), ord("o")
    return cls, form, wrong


#: A place is written as position * TABLES + table.
TABLES = 64
_SPOT = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("var", pa.int64()), ("key", pa.int64())])
_COUNT = pa.schema([("key", pa.int64()), ("var", pa.int64()), ("n", pa.int64())])
_LAT = {v: i for i, v in enumerate(["e", "c", "m", "rn", "h", "li", "d", "cl", "l", "i", "1", "o", "0"])}
_LAT_CLASS = {"e": 1, "c": 1, "m": 2, "rn": 2, "h": 3, "li": 3, "d": 4, "cl": 4, "l": 5, "i": 5, "1": 5, "o": 6, "0": 6}
_LAT_WRONG = {"c", "rn", "li", "cl", "1", "0"}


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isspace() or U.category(chr(i)) in ("Cf", "Mn") for i in range(0x110000)), dtype=bool)


def _contexts(col: pa.Array, pairs: tuple[str, ...]):
    """Every place where a glyph has look-alikes: (row, position, reading, may be wrong, three context keys).

    Blanks and line breaks (with the hyphen of a broken word) are bridged; contexts are written in
    class forms, so a second misreading nearby does not hide the first."""
    cp, starts = K.codepoints(col)
    cls, form, wrong = _classes(pairs)
    space = _spaces()[cp]
    low = form[cp]
    letter = (low >= 97) & (low < 123)
    nxt = np.append(space[1:], True)
    prev = np.append(False, letter[:-1])
    hyphen = np.isin(cp, np.array([ord(c) for c in _HYPHENS], dtype=np.uint32)) & nxt & prev
    keep = ~(space | hyphen)
    at = np.flatnonzero(keep)
    row = K.rows_of(starts)[at]
    pad = 3
    where = np.arange(len(at)) + pad * (row + 1)
    size = len(at) + pad * (len(starts) + 1)
    x = np.zeros(size, dtype=np.uint64)
    x[where] = low[at]
    raw = np.zeros(size, dtype=np.uint32)
    raw[where] = cp[at]
    src = np.zeros(size, dtype=np.int64)
    src[where] = at - starts[row]
    rows = np.zeros(size, dtype=np.int64)
    rows[where] = row
    out = []

    def keys(i, n, cl, kinds):
        for kind, (before, after) in enumerate(kinds):
            h = np.full(len(i), kind + 1, dtype=np.uint64) * np.uint64(0x1F123BB5) + cl
            for b in range(1, before + 1):
                h = K.mix(h * np.uint64(31) + x[i - b] + np.uint64(7))
            for a in range(after):
                h = K.mix(h * np.uint64(37) + x[i + n + a] + np.uint64(11))
            yield K.signed(h)

    i = np.flatnonzero(cls[raw] > 0)
    if len(i):
        out.append((rows[i], src[i], raw[i].astype(np.int64), wrong[raw[i]], list(keys(i, 1, cls[raw[i]].astype(np.uint64), ((2, 0), (0, 2), (1, 1))))))
    roman = (x >= 97) & (x < 123)
    word = roman | ((raw == 48) | (raw == 49))
    for v, code in _LAT.items():
        if v in "10":
            ok = raw == ord(v)
            side = np.zeros(size, dtype=bool)
            side[1:] |= roman[:-1] & ~((raw[:-1] == 48) | (raw[:-1] == 49))
            side[:-1] |= roman[1:] & ~((raw[1:] == 48) | (raw[1:] == 49))
            digit = (raw >= 48) & (raw < 58)
            near = np.zeros(size, dtype=bool)
            near[1:] |= digit[:-1]
            near[:-1] |= digit[1:]
            i = np.flatnonzero(ok & side & ~near)
        elif len(v) == 1:
            i = np.flatnonzero((x == ord(v)) & (raw != 48) & (raw != 49))
        else:
            i = np.flatnonzero((x[:-1] == ord(v[0])) & (x[1:] == ord(v[1])) & (raw[:-1] != 49) & (raw[1:] != 49))
        i = i[(i >= pad) & (i + len(v) + pad <= size)]
        i = i[word[i - 1] | word[i + len(v)]]
        if len(i):
            cl = np.full(len(i), _LAT_CLASS[v], dtype=np.uint64)
            out.append((rows[i], src[i], np.full(len(i), -1 - code), np.full(len(i), v in _LAT_WRONG), list(keys(i, len(v), cl, ((2, 2), (3, 1), (1, 3))))))
    return out


def _readings(b: pa.RecordBatch, pairs: tuple[str, ...]):
    key, var = [], []
    for _, _, v, _, ks in _contexts(b.column("text"), pairs):
        for k in ks:
            key.append(k)
            var.append(v)
    if not key:
        return
    key, var = np.concatenate(key), np.concatenate(var)
    _, first, n = np.unique(key ^ K.signed(K.mix(var.astype(np.uint64))), return_index=True, return_counts=True)
    yield K.table(_COUNT, key[first], var[first], n.astype(np.int64))


def _spots(b: pa.RecordBatch, pairs: tuple[str, ...]):
    tab, rid = b.column("tab").to_numpy(), b.column("row").to_numpy()
    for row, pos, var, bad, ks in _contexts(b.column("text"), pairs):
        if bad.any():
            r = row[bad]
            for k in ks:
                yield K.table(_SPOT, rid[r], pos[bad] * TABLES + tab[r], var[bad], k[bad])


_LINE = pa.schema([("tab", pa.int32()), ("row", pa.int64()), ("noise", pa.string()), ("line_no", pa.int64()), ("title", pa.string())])


def line_marks(text: str) -> list[tuple[str, int, str | None]]:
    """(noise, line number, title) of the marks that a line shows by itself.  A header is named by
    its title with numbers masked, to be confirmed by other pages."""
    out = []
    if m := _BROKEN.search(text):
        n = 1 + text.count("\n", 0, m.start())
        out.append(("broken_word", n, None))
        at = m.end()
        while m := _BROKEN.search(text, at):
            n = 1 + text.count("\n", 0, m.start())
            out.append(("broken_word", n, None))
            at = m.end()
    for n, line in enumerate(text.split("\n"), 1):
        if not (_MAY_MARK.search(line) or _BARE.match(line)):
            low = line.lower()
            if not any(w in low for w in _PARTS):
                continue
        flat = " ".join(U.normalize("NFKC", line).split())
        if len(flat) > MOST_LETTERS and sum(map(str.isalnum, flat)) > MOST_LETTERS:
            continue
        if _NUMBER.match(flat):
            out.append(("page_number", n, None))
            continue
        m = _HEADER.match("".join(c for c in flat if not c.isspace() and U.category(c) not in ("Cf", "Mn")))
        if m:
            out.append(("header", n, m["han"] or "chapter " + m["latin"].lower()))
    return out


def _lines(b: pa.RecordBatch):
    tab, rid, text = (b.column(c).to_pylist() for c in ("tab", "row", "text"))
    cols: list[list] = [[], [], [], [], []]
    for t, r, x in zip(tab, rid, text):
        for noise, n, title in line_marks(x):
            for c, v in zip(cols, (t, r, noise, n, title)):
                c.append(v)
    yield K.table(_LINE, *cols)


def _base(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    parts = [df.select(F.lit(i).cast("int").alias("tab"), C.column(df, key, "long").alias("row"), C.column(df, text, "string").alias("text")).where("row is not null and text is not null") for i, (df, key, text) in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return C.spread(out)


#: Surroundings are counted in ranges of their hash, by a task for so many letters at once.
RANGE_BITS, HELD_LETTERS = 10, 4_000_000
#: The first ideograph, and the bits that tell it from the others.
_HAN, _HAN_BITS = 0x4E00, np.uint64(15)
_ONE_OF = np.uint64((1 << 15) - 1)
_PACKED = pa.schema([("range", pa.int32()), ("word", pa.binary()), ("n", pa.binary())])
_LED = pa.schema([("right", pa.int64()), ("read", pa.int64()), ("n", pa.int64()), ("places", pa.int64())])


def _around(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every ideograph with three letters before and three after it: (hash of these, number of the ideograph)."""
    cp, starts = K.codepoints(col)
    cp, starts = K.only(cp, starts, ~_spaces()[cp])
    pre, row, n = K.prefix_hash(cp), K.rows_of(starts), REACH
    i = np.flatnonzero((cp >= _HAN) & (cp < 0xA000))
    i = i[(i >= n) & (i + n < len(cp))]
    i = i[(row[i - n] == row[i]) & (row[i + n] == row[i])]
    key = K.mix(K.segment_hash(pre, i - n, i) * np.uint64(3) + K.segment_hash(pre, i + 1, i + 1 + n))
    return key, (cp[i] - _HAN).astype(np.uint16)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their bytes, all first ones first, as the shuffle's compression wants them."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(planes: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(key: np.ndarray, letter: np.ndarray) -> pa.RecordBatch:
    """Counts of (surroundings, ideograph), one row per range: words of 49 bits of the hash, beside those of
    the range, and the ideograph in order, and how often each was met."""
    part = (key >> np.uint64(64 - RANGE_BITS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    word = (((key << np.uint64(RANGE_BITS)) & ~_ONE_OF) | letter)[order]
    bound = np.append(0, np.cumsum(np.bincount(part, minlength=1 << RANGE_BITS)))
    for a, z in zip(bound[:-1], bound[1:]):
        word[a:z].sort()
    first = np.append(True, word[1:] != word[:-1])
    first[bound[:-1][bound[:-1] < bound[1:]]] = True
    at = np.flatnonzero(first)
    n, word = np.diff(np.append(at, len(word))).astype(np.uint32), word[at]
    cuts = np.searchsorted(at, bound)
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return K.table(_PACKED, some, [_planes(word[cuts[r] : cuts[r + 1]]) for r in some], [_planes(n[cuts[r] : cuts[r + 1]]) for r in some])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for part in K.slices(b, ["text"]) if b.num_rows else ():
            held.append(_around(part.column("text")))
            size += len(held[-1][0])
            if size >= HELD_LETTERS:
                yield _packed(*map(np.concatenate, zip(*held)))
                held, size = [], 0
    if size:
        yield _packed(*map(np.concatenate, zip(*held)))


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all counts of a range, ranges one after another: how often each ideograph was read, and in how
    many frequent surroundings, where one (itself or another) leads."""
    rows = ((r, w, n) for b in batches for r, w, n in zip(b.column("range").to_pylist(), b.column("word"), b.column("n")))
    for _, group in groupby(rows, key=lambda x: x[0]):
        words, counts = zip(*((_numbers(w, np.uint64), _numbers(n, np.uint32)) for _, w, n in group))
        word, n = np.concatenate(words), np.concatenate(counts).astype(np.uint64)
        order = np.argsort(word)
        word, n = word[order], n[order]
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        word, n = word[at], np.add.reduceat(n, at)
        key, letter = word >> _HAN_BITS, word & _ONE_OF
        new = np.append(True, key[1:] != key[:-1])
        at, of = np.flatnonzero(new), np.cumsum(new) - 1
        every, top = np.add.reduceat(n, at), np.maximum.reduceat(n << _HAN_BITS | letter, at)
        use = ((every >= FREQUENT) & ((top >> _HAN_BITS) >= every * LEADS))[of]
        pair, where = np.unique((top & _ONE_OF)[of[use]] << _HAN_BITS | letter[use], return_inverse=True)
        if len(pair):
            total = np.zeros(len(pair), dtype=np.uint64)
            np.add.at(total, where, n[use])
            yield K.table(_LED, (pair >> _HAN_BITS).astype(np.int64) + _HAN, (pair & _ONE_OF).astype(np.int64) + _HAN, total.astype(np.int64), np.bincount(where))


def learned(base: DataFrame) -> tuple[str, ...]:
    """Pairs of glyphs (right, misread) that the corpus itself shows, besides GLYPHS.

    Words are grouped by what stands around one of their letters.  A letter that hardly ever stands
    where its surroundings are frequent, but in several of them takes the place of one and the same
    other letter that all other copies have, is a misreading of that one; unless it is better known
    as a misreading of a third one that stands there, too, and as often.  All letters of all rows
    are counted, packed by range of their surroundings' hash, so that each is shuffled once and a
    range is counted in one task; only pairs of letters come to the driver."""
    packed = base.select("text").mapInArrow(_counted, C.ddl(_PACKED))
    led = packed.repartition("range").sortWithinPartitions("range").mapInArrow(_led, C.ddl(_LED))
    sums = C.cut(led.groupBy("right", "read").agg(F.sum("n").alias("n"), F.sum("places").alias("places")))
    leads = F.when(F.expr("right = read"), F.col("n"))
    each = sums.withColumn("own", F.sum(leads).over(W.partitionBy("read"))).withColumn("leads", F.sum(leads).over(W.partitionBy("right")))
    found = each.where(f"right != read and n >= {ENOUGH} and places >= {PLACES} and n >= coalesce(own, 0) * {MISREAD_ODDS}")
    found = {(r["right"], r["read"]): (r["n"], r["n"] / r["leads"]) for r in found.orderBy(F.desc("n"), "right", "read").collect()}
    # what each is a misreading of, and of how large a part of it; of all that the table knows, before any other
    share: dict[int, dict[int, float]] = {}
    for (right, read), (_, part) in found.items():
        share.setdefault(read, {})[right] = part
    for right, read in GLYPHS.split():
        share.setdefault(ord(read), {})[ord(right)] = 1.0
    third = {p: [x for x, part in share[p[1]].items() if x != p[0] and part > found[p][1]] for p in found}
    asked = [(right << 21) + x for (right, _), most in third.items() for x in most]
    there = {(r["right"], r["read"]): r["n"] for r in sums.where(((F.col("right") * (1 << 21)) + F.col("read")).isin(asked)).collect()} if asked else {}
    pairs = [chr(p[0]) + chr(p[1]) for p, (n, _) in found.items() if not any(there.get((p[0], x), 0) >= n for x in third[p])]
    known = set(GLYPHS.split())
    return tuple(p for p in pairs if p not in known and canonical(p[0]) != canonical(p[1]) and not set(p) & set("一二三四五六七八九十百千万两〇零"))


def misread(base: DataFrame) -> DataFrame:
    """(tab, row, pos, var, best): readings that their contexts speak against, and the supported one.

    Readings are counted per context over the whole corpus, combined per batch before the shuffle; a
    context's row holds at most the few readings of one class.  The contexts of a place (what stands
    before it, after it, and on both sides) add up as log odds between its reading and the best other
    one of its class.  Places in contexts seen nowhere else follow what the reading is elsewhere."""
    pairs = (*GLYPHS.split(), *learned(base))
    counts = C.cut(C.map_rows(base, ["text"], lambda b: _readings(b, pairs), _COUNT).groupBy("key", "var").agg(F.sum("n").alias("n")))
    wrong = [ord(p[1]) for p in pairs] + [-1 - _LAT[v] for v in sorted(_LAT_WRONG)]
    other = counts.select("key", F.struct("n", "var").alias("o"))
    two = other.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("o"), asc=False), 1, 2).alias("two"))  # a class has few readings
    asked = counts.where(F.col("var").isin(wrong)).join(two, "key")
    best = F.when(F.col("two")[0]["var"] != F.col("var"), F.col("two")[0]).when(F.size("two") > 1, F.try_element_at("two", F.lit(2)))
    asked = asked.select("key", "var", "n", best.alias("b"))
    odds = F.log((F.coalesce(F.col("b.n"), F.lit(0)) + 0.5) / (F.col("n") + 0.5))
    clear = (F.col("b.n") >= F.col("n") * TIMES) & (F.col("b.n") >= SEEN)
    stands = (F.col("n") >= STANDS) & (F.coalesce(F.col("b.n"), F.lit(0)) < F.col("n"))
    # what a context says, in fixed-width numbers: flags (1 against, 2 stands), and odds with the other reading below
    says = F.when(clear, 1).otherwise(0).bitwiseOR(F.when(stands, 2).otherwise(0))
    by = F.when(F.col("b.var").isNotNull(), F.shiftleft(F.round((odds + 100) * 1000).cast("long"), 22) + F.col("b.var") + len(_LAT) + 1)
    verdict = asked.select("key", "var", odds.alias("odds"), F.coalesce(says, F.lit(0)).cast("long").alias("says"), by.alias("by"))
    spots = C.map_rows(base, ["text"], lambda b: _spots(b, pairs), _SPOT)
    seen = spots.join(verdict, ["key", "var"]).groupBy("row", "at", "var").agg(F.sum("odds").alias("odds"), F.bit_or("says").alias("says"), F.max("by").alias("by"))
    wrong = (F.col("says").bitwiseAND(1) == 1) & (F.col("odds") >= F.lit(float(np.log(ODDS))))
    best = F.col("by").bitwiseAND((1 << 22) - 1) - (len(_LAT) + 1)
    seen = C.cut(seen.select((F.col("at") % TABLES).cast("int").alias("tab"), "row", F.floor(F.col("at") / TABLES).alias("pos"), "var", wrong.alias("wrong"), (F.col("says").bitwiseAND(2) == 2).alias("stands"), best.alias("best")))
    # a reading that its contexts contradict nearly wherever they tell is wrong where they do not tell, too;
    # one row per reading of the fixed glyph classes
    told = seen.where("wrong or stands").groupBy("var").agg(F.count_if("wrong").alias("against"), F.count_if(~F.col("wrong")).alias("for"))
    usual = seen.where("wrong").groupBy("var", "best").agg(F.count(F.lit(1)).alias("n")).groupBy("var").agg(F.max_by("best", F.struct("n", "best")).alias("usual"))
    never = told.where(f"against >= {ENOUGH} and against >= for * {MOSTLY}").join(usual, "var").select("var", "usual")
    both = seen.join(F.broadcast(never), "var", "left")
    return both.where("wrong or (usual is not null and not coalesce(stands, false))").select("tab", "row", "pos", "var", F.when(F.col("wrong"), F.col("best")).otherwise(F.col("usual")).alias("best"))


def marks(tables: list[tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(lines, readings): marks of printing per line, and misread letters, of several tables.

    Method: glyphs are grouped into classes of similar shape, those of a fixed table and those that
    the corpus shows (see learned), contexts written in class forms, and in
    each context the frequent reading is chosen; headers are found by masking their numbers and
    counting what is left over all pages; page numbers and broken words by the line's form.
    Null texts and ids are left out; empty texts have no marks; repeated rows are marked once; an
    empty table gives no rows; other columns are ignored; texts are read whole.
    """
    base = _base(tables)
    lines = C.cut(C.map_rows(base, ["text"], _lines, _LINE))
    titles = lines.where("noise = 'header'").groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("title")
    sure = lines.where("noise != 'header'").unionByName(lines.where("noise = 'header'").join(titles, "title", "left_semi"))
    return sure.select("tab", "row", "noise", "line_no"), misread(base)


def found(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(table_name, row_key, noise): one row per kind of mark a row has."""
    lines, readings = marks(list(tables.values()))
    name = F.element_at(F.array(*[F.lit(t) for t in tables]), F.col("tab") + 1)
    both = lines.select("tab", "row", "noise").unionByName(readings.select("tab", "row", F.lit("misread").alias("noise"))).distinct()
    return both.select(name.alias("table_name"), F.col("row").alias("row_key"), "noise")


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, text): continuous paragraphs in the right letters.

    Misread letters are put right at their places; headers and page numbers go; then a window over
    the lines of each row decides where a paragraph begins (after a blank line, or where the line
    before ends a sentence well short of the row's usual width), and lines are joined, without the
    hyphen and blank of a broken word, with a blank only between Latin words.  Rows without marks
    are reflowed alike; null texts stay null; a row with only marks becomes an empty text."""
    base = _base([(df, key, text)]).select("row", "text").distinct()
    lines, readings = marks([(df, key, text)])
    gone = lines.where("noise in ('header', 'page_number')").groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    fixes = readings.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("pos", "var", "best"))).alias("fixes"))
    rows = base.join(gone, "row", "left").join(fixes, "row", "left")
    rows = rows.select("row", "text", F.col("gone").cast("array<bigint>").alias("gone"), F.transform("fixes", lambda f: f["pos"]).alias("p"), F.transform("fixes", lambda f: f["var"]).alias("v"), F.transform("fixes", lambda f: f["best"]).alias("w"))
    schema = pa.schema([("row", pa.int64()), ("text", pa.string())])

    def fix(b: pa.RecordBatch):
        d = b.to_pydict()
        out = []
        for t, g, p, v, w in zip(d["text"], d["gone"], d["p"], d["v"], d["w"]):
            if p:
                t = put_right(t, list(zip(p, v, w)))
            if g:
                t = "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in g)
            out.append(t)
        yield K.table(schema, d["row"], out)

    right = C.map_rows(rows, ["text"], fix, schema)
    # lines of one row are numbered and compared by windows partitioned by row
    each = right.select("row", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n", -1)).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|[ \t]+$", ""))
    w = W.partitionBy("row")
    o = w.orderBy("n")
    wide = F.max(F.length("line")).over(w)
    before = F.lag("line").over(o)
    ends = before.rlike("[。！？!?.”」）)]$") & (F.length(before) < wide * 0.7)
    new = before.isNull() | (before == "") | ends
    para = each.withColumn("p", F.sum(new.cast("int")).over(o)).where("line != ''")
    glue = F.when(F.lag("line").over(W.partitionBy("row", "p").orderBy("n")).isNull(), F.lit(""))
    last = F.lag("line").over(W.partitionBy("row", "p").orderBy("n"))
    glue = glue.when(last.rlike(rf"[A-Za-zÀ-ɏ][{_HYPHENS}]$"), F.lit("")).when(last.rlike(r"[A-Za-z0-9À-ɏ,.;:)\]]$") & F.col("line").rlike(r"^[A-Za-z0-9À-ɏ(\[]"), F.lit(" ")).otherwise(F.lit(""))
    body = F.when(F.lead("line").over(W.partitionBy("row", "p").orderBy("n")).isNotNull(), F.regexp_replace("line", rf"(?<=[A-Za-zÀ-ɏ])[{_HYPHENS}]$", "")).otherwise(F.col("line"))
    joined = para.select("row", "p", "n", F.concat(glue, body).alias("s")).groupBy("row", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "").alias("s"))
    whole = joined.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), "\n\n").alias("done"))
    keys = df.select(C.column(df, key, "long").alias("row"), C.column(df, text, "string").alias("old"))
    return keys.join(whole, "row", "left").select(F.col("row").alias("row_key"), F.when(F.col("old").isNull(), F.lit(None)).otherwise(F.coalesce("done", F.lit(""))).alias("text"))


_LAT_BACK = {-1 - i: v for v, i in _LAT.items()}


def put_right(text: str, fixes: list[tuple[int, int, int]]) -> str:
    """Replace the readings at their places, the last first, so that places stay right."""
    chars = list(text)
    for pos, var, best in sorted(fixes, reverse=True):
        if var > 0:
            chars[pos] = chr(best)
            continue
        old, new = _LAT_BACK[var], _LAT_BACK[best]
        end = pos
        for ch in old:
            while end < len(chars) and chars[end].lower() != ch:
                end += 1
            end += 1
        if end - pos == len(old):
            chars[pos:end] = [new.upper() if chars[pos].isupper() and len(new) == 1 else new]
    return "".join(chars)
