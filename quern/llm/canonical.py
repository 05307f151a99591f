"""Problem 3: one form for text that looks the same in different characters."""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

# Letters of other scripts that share a glyph with a Latin letter.
LOOK_ALIKES = {
    **dict(zip("АВЕКМНОРСТУХІЈЅҮԚԜ", "ABEKMHOPCTYXIJSYQW")),  # Cyrillic capitals
    **dict(zip("аеорсухіјѕһԁԛԝ", "aeopcyxijshdqw")),  # Cyrillic small letters
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),  # Greek capitals
    **dict(zip("ον", "ov")),  # Greek small letters
    **dict(zip("‐‑‧∙⋅", "--···")),  # signs
}
# Radicals (2E80..2EF3) and the ideograph of the same glyph.
RADICALS = dict(zip(
    "⺁⺅⺆⺈⺉⺊⺎⺏⺐⺒⺓⺔⺕⺖⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺦⺧⺨⺩⺪⺬⺭⺮⺯⺰⺱⺲⺶⺹⺺⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳",
    "厂亻冂刀刂卜兀尣尢巳幺彑彐忄扌攵旡日月歺母民氵氺灬爫丬牛犭王疋示礻竹糹纟罓罒羊耂肀聿肉臼艹虎衤覀西见角讠贝足车辶钅長镸长门阜阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟",
))
#: Kinds of compatibility mapping that keep the print; super- and subscripts, circles and fractions do not.
_SAME_PRINT = ("<wide>", "<narrow>", "<compat>", "<square>", "<noBreak>", "<vertical>")
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}


def ignorable(ch: str) -> bool:
    o = ord(ch)
    return o in _FILLERS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F or (U.category(ch) in ("Cf", "Cc") and ch not in "\n\t\v\f\x85")


def _spread(ch: str) -> str:
    """One character in decomposed form, without look-alike letters being replaced."""
    if ch in ("\n", "\x85", "\u2028", "\u2029"):
        return "\n"
    if ch in "\t\v\f" or U.category(ch) == "Zs":
        return " "
    if ignorable(ch):
        return ""
    if ch in RADICALS:
        return RADICALS[ch]
    d = U.decomposition(ch)
    if d:
        kind, *rest = d.split() if d[0] == "<" else ("", *d.split())
        if not kind or kind in _SAME_PRINT:
            return "".join(_spread(chr(int(x, 16))) for x in rest)
    return U.normalize("NFD", ch)


class _Spread(dict):
    def __missing__(self, o: int) -> str:
        self[o] = s = _spread(chr(o))
        return s


_TABLE = _Spread()
_BACK = {"CYRILLIC": {}, "GREEK": {}}
for _k, _v in LOOK_ALIKES.items():
    if _v.isalpha():
        _BACK[U.name(_k).split()[0]].setdefault(_v, _k)
_LATIN = str.maketrans(LOOK_ALIKES)
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
_WORD = re.compile("[A-Za-zÀ-ɏ̀-ͯͰ-ϿЀ-ԯḀ-ỿ]+")


def by_table(word: str) -> str:
    """A word of one look-alike class in one spelling: Latin where every letter has a Latin twin,
    else in the script of the letters that have none."""
    folded = word.translate(_LATIN)
    for script, back in _BACK.items():
        if any(U.name(c, "").startswith(script) for c in folded if ord(c) > 0x36F):
            return folded.translate(str.maketrans(back))
    return folded


class Trie:
    """Vocabulary trie walked by a weighted edit automaton.

    A state is a place in the trie with the cost of reaching it.  A stored character is first spread
    to its print (width, composition, ligatures; nothing for an ignorable); a letter leads along the
    edges of its look-alike class at no cost, and by substitution, insertion or omission at one each,
    as far as ``limit`` allows.  The limit is 0 where only what looks the same may be joined.  Of
    several words reached, the cheapest and then the most frequent one is the spelling."""

    def __init__(self, words: list[tuple[str, int]], limit: int = 0):
        self.root: dict = {}
        self.limit = limit
        for word, n in words:
            node = self.root
            for ch in U.normalize("NFD", word):
                node = node.setdefault(ch, {})
            node[""] = max(node.get("", (0, "")), (n, word))

    def _closed(self, states: dict[int, tuple[dict, int]]) -> dict[int, tuple[dict, int]]:
        """States reached by omitting letters of the word, too."""
        todo = list(states.values())
        while todo:
            node, cost = todo.pop()
            for ch, to in node.items():
                if ch and cost < self.limit and cost + 1 < states.get(id(to), (to, self.limit + 1))[1]:
                    states[id(to)] = (to, cost + 1)
                    todo.append((to, cost + 1))
        return states

    def spelling(self, word: str) -> str | None:
        states = self._closed({id(self.root): (self.root, 0)})
        for stored in word:
            for ch in _TABLE[ord(stored)]:
                new: dict[int, tuple[dict, int]] = {}
                same = _SAME.get(ch, (ch,))
                for node, cost in states.values():
                    if cost < self.limit and cost + 1 < new.get(id(node), (node, self.limit + 1))[1]:
                        new[id(node)] = (node, cost + 1)
                    for c, to in node.items() if self.limit else ((c, node[c]) for c in same if c in node):
                        much = cost + (c not in same)
                        if c and much <= self.limit and much < new.get(id(to), (to, self.limit + 1))[1]:
                            new[id(to)] = (to, much)
                states = self._closed(new)
                if not states:
                    return None
        ends = [(-cost, *node[""]) for node, cost in states.values() if "" in node]
        return max(ends)[2] if ends else None


_SAME: dict[str, list[str]] = {}
for _k, _v in LOOK_ALIKES.items():
    _SAME.setdefault(_v, [_v]).append(_k)
for _all in list(_SAME.values()):
    for _k in _all:
        _SAME[_k] = _all
#: A word as stored: letters that may have look-alikes, in any width, with marks and ignorables among them.
_STORED = re.compile("[A-Za-zªºÀ-ɏ̀-ͯͰ-ϿЀ-ԯḀ-ỿἀ-῿\u2126\u212a\u212bＡ-Ｚａ-ｚﬀ-ﬆµ\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0100-\U000e01ef]+")


def skeleton(word: str) -> str:
    """What all words that look like this one share."""
    return word.translate(_TABLE).translate(_LATIN)


def _has_twin(word: str) -> bool:
    """It holds a letter of a look-alike class."""
    return not _SAME.keys().isdisjoint(word.translate(_TABLE))


def canonical(text: str | None, trie: Trie | None = None) -> str | None:
    """The one form of a text: width, invisible characters, kind of blank, composition and
    look-alike letters make no difference to it.  Words that the trie reaches get its spelling, all
    else is normalised by table.  Null stays null."""
    if text is None:
        return None
    if trie is None:
        return U.normalize("NFC", _tabled(text).translate(_SIGNS))
    out, at = [], 0
    for m in _STORED.finditer(text):
        known = trie.spelling(m[0])
        if known is not None:
            out += [_tabled(text[at : m.start()]).translate(_SIGNS), known]
            at = m.end()
    return U.normalize("NFC", "".join(out) + _tabled(text[at:]).translate(_SIGNS))


def _tabled(text: str) -> str:
    t = text.translate(_TABLE)
    return _WORD.sub(lambda m: by_table(m[0]), t) if _FOREIGN.search(t) else t


_SIGNS = {ord(k): v for k, v in LOOK_ALIKES.items() if not v.isalpha()}


@lru_cache(maxsize=1)
def foreign_class() -> str:
    """A regular expression's class that holds all characters whose print has a Greek or Cyrillic letter.

    A few wide ranges, so that it is quick; that it holds others, too, costs some joins and changes nothing."""
    own = [o for o in range(0x80, 0x30000) if not 0xAC00 <= o < 0xE000 and (0x36F < o < 0x530 or U.decomposition(chr(o))) and _FOREIGN.search(_TABLE[o])]
    ranges: list[list[int]] = []
    for o in own:
        if ranges and o - ranges[-1][1] <= 256:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


_SPELLED = pa.schema([("skeleton", pa.string()), ("spelling", pa.string()), ("latin", pa.bool_()), ("n", pa.int64())])
_ASKED = pa.schema([("text_id", pa.int64()), ("skeleton", pa.string())])
_FORM = pa.schema([("tab", pa.int32()), ("key", pa.int64()), ("text", pa.string()), ("canonical", pa.string())])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(skeleton, spelling, n): of all words that look the same but are spelled in several ways, the
    spelling in one script that most copies have, Latin letters in a tie.  Words that are only spelled
    in mixed scripts are left to the table.

    Words are counted in every text, combined per batch before the shuffle; nothing comes to the driver."""

    def count(b: pa.RecordBatch):
        stored = Counter()
        for t in b.column("text").to_pylist():
            if t:
                stored.update(_STORED.findall(t))
        c: Counter = Counter()
        for w, n in stored.items():
            if _has_twin(w):
                c[U.normalize("NFC", w.translate(_TABLE))] += n
        pure = [w for w in c if not (_FOREIGN.search(w) and _LATIN_LETTER.search(w))]
        mixed = [w for w in c if _FOREIGN.search(w) and _LATIN_LETTER.search(w)]
        yield K.table(_SPELLED, [skeleton(w) for w in pure + mixed], pure + [None] * len(mixed), [not _FOREIGN.search(w) for w in pure] + [False] * len(mixed), [c[w] for w in pure + mixed])

    spelled = C.map_rows(texts.select("text"), ["text"], count, _SPELLED).groupBy("skeleton", "spelling", "latin").agg(F.sum("n").alias("n"))
    one = F.when(F.col("spelling").isNotNull(), F.struct("n", "latin", "spelling"))
    return spelled.groupBy("skeleton").agg(F.max(one).alias("best"), F.count(F.lit(1)).alias("ways")).where("ways > 1 and best is not null").select("skeleton", "best.spelling", "best.n")


def canonical_texts(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(tab, key, text, canonical): every text of several tables (frame, key, text) in its one form; tab is the
    table's place in the list.

    Method: words that look the same are grouped by their skeletons over all tables, and where they are
    spelled in several ways the most frequent spelling is kept.  A text that may need one gets the
    spellings of its words by a join, builds their trie and walks it with a weighted edit automaton
    to which look-alikes and ignorables cost nothing; words the trie does not reach, and all other
    characters, are normalised by table.  The vocabulary depends on skeletons alone, so texts that look
    the same come out equal.  Null texts stay null, empty ones empty; rows and repeats are kept; other
    columns are ignored; nothing is capped, cut or collected.
    """
    parts = [df.select(F.lit(i).cast("int").alias("tab"), C.column(df, key, "long").alias("key"), C.column(df, text, "string").alias("text")) for i, (df, key, text) in enumerate(tables)]
    base = C.spread(reduce(DataFrame.unionByName, parts))
    known = C.cut(vocabulary(base.where("text is not null")))
    # words in Latin letters only need the vocabulary where another script has won
    wide = not known.where(F.col("spelling").rlike(foreign_class())).isEmpty()
    odd = F.coalesce(F.col("text").rlike(foreign_class() if not wide else f"{foreign_class()}|[A-Za-zＡ-Ｚａ-ｚ]"), F.lit(False))

    def ask(b: pa.RecordBatch):
        ids, names = [], []
        for i, t in zip(b.column("text_id").to_pylist(), b.column("text").to_pylist()):
            for w in {skeleton(w) for w in set(_STORED.findall(t)) if _has_twin(w)}:
                ids.append(i)
                names.append(w)
        yield K.table(_ASKED, ids, names)

    some = base.where(odd).withColumn("text_id", F.xxhash64("text"))
    asked = C.map_rows(some.select("text_id", "text"), ["text"], ask, _ASKED).distinct()
    words = asked.join(known, "skeleton").groupBy("text_id").agg(F.collect_list(F.struct("spelling", "n")).alias("words"))

    def form(b: pa.RecordBatch):
        words = b.column("words").to_pylist() if "words" in b.schema.names else [None] * b.num_rows
        done = [canonical(t, Trie([(w["spelling"], w["n"]) for w in ws]) if ws else None) for t, ws in zip(b.column("text").to_pylist(), words)]
        yield K.table(_FORM, b.column("tab"), b.column("key"), b.column("text"), done)

    plain = C.map_rows(base.where(~odd), ["text"], form, _FORM)
    return plain.unionByName(C.map_rows(some.join(words, "text_id", "left").select("tab", "key", "text", "words"), ["text"], form, _FORM))


def found(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(table_name, key_a, key_b), smaller first: rows of a table that look the same, stored otherwise.

    Only hashes are shuffled; classes with a single stored form are dropped before rows are paired."""
    names = F.array(*[F.lit(t) for t in tables])
    c = canonical_texts([(df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{key}`").isNotNull()), key, text) for df, key, text in tables.values()])
    rows = c.select(names[F.col("tab")].alias("table_name"), "key", F.xxhash64("canonical").alias("c"), F.xxhash64("text").alias("s"))
    rows = C.cut(rows)
    mixed = rows.groupBy("table_name", "c").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < hi").select("table_name", "c")
    some = rows.join(mixed, ["table_name", "c"], "left_semi")
    a = some.select("table_name", "c", F.col("key").alias("key_a"), F.col("s").alias("sa"))
    b = some.select("table_name", "c", F.col("key").alias("key_b"), F.col("s").alias("sb"))
    return a.join(b, ["table_name", "c"]).where("key_a < key_b and sa != sb").select("table_name", "key_a", "key_b").distinct()
