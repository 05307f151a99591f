"""Problem 4: defective prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata as U

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

# Answers that hold nothing, as letters only and in small letters.
FILLERS = frozenset("答 回答 答案 答复 解答 回复 略 无 空 空白 待补充 待补 待定 待填 待续 暂无 没有 同上 见上 未填 无答案 暂缺 na none null nil nan tbd todo empty blank answer a response noanswer undefined keine aucun なし 未定".split())
#: Letters of the longest filler; compatibility forms only make it longer.
MOST_FILLER = max(map(len, FILLERS))
#: Words that may stand before a question that is only repeated.
_PREFACE = re.compile(r"^(?:(?:问题|您问的是|你问的是|您来信说|来信说|您的问题是|问|题目|原题|关于|question|q|frage)+)", re.I)

_APOLOGY = r"(?:很|十分|非常|实在|真的)?(?:抱歉|对不起|不好意思|遗憾|您好|你好|亲|谢谢您?的?(?:提问|来信)|感谢您?的?(?:提问|来信))"
_SELF = r"(?:作为(?:一个|一名|一款)?(?:人工智能|AI|ai|大?语言)?(?:模型|助手|系统|程序)?|我(?:只)?是(?:一个|一名)?(?:人工智能|AI|语言模型).{0,8})"
_REFUSE = (
    r"(?:我|本人|我们|本助手|这里|目前|暂时|恕我?)*(?:无法|不能|没有办法|没办法|不便|不方便|难以|拒绝|不可以|帮不上|给不了|不予|不会|未能)[^，。！？,.!?；;]{0,24}"
    r"|(?:这个|该|此|您的|你的)?(?:问题|内容|请求|话题)?(?:已经)?(?:超出了?|不在)[^，。！？,.!?；;]{0,20}(?:范围|能力)(?:之内|之外|内)?"
    r"|(?:该|这个|此|这类)(?:内容|问题|请求)(?:不予|无法|不能|不便)[^，。！？,.!?；;]{0,12}"
)
_CLOSING = r"(?:请|敬请|还请|望|烦请|建议|您可以|你可以)[^，。！？,.!?；;]{0,24}|换个?(?:一个|个)?(?:问题|话题)吧?|谢谢(?:理解|谅解)?"
_OTHER = (
    r"(?:i\s?[’']?\s?a?m|we are)?\s*(?:very |so |truly |really )?sorry|(?:i )?apologi[sz]e|unfortunately|but"
    r"|as an? (?:ai|artificial|language)[\w\s-]{0,30}|(?:as an? [\w\s-]{0,24})?(?:but )?(?:i|we) (?:can\s?not|can[’']?t|am (?:un|not )able|am not allowed|won[’']?t|will not|do not|don[’']?t)[^.!?;]{0,80}"
    r"|(?:this|that|the) (?:question|request|topic)[^.!?;]{0,20}(?:beyond|outside)[^.!?;]{0,40}|please[^.!?;]{0,60}"
    r"|je (?:suis )?(?:d[ée]sol[ée]e?|regrette)|d[ée]sol[ée]e?|(?:mais )?je ne (?:peux|puis|suis)[^.!?;]{0,80}|veuillez[^.!?;]{0,60}"
    r"|(?:es )?tut mir leid|leider|(?:aber )?(?:das |leider )?kann ich[^.!?;]{0,80}|ich kann[^.!?;]{0,80}|bitte[^.!?;]{0,60}"
    r"|申し訳[^。]{0,20}|(?:その|この)?(?:質問|ご質問)?[^。]{0,30}(?:できません|お答えできません|かねます)"
)
_CLAUSE = re.compile(rf"(?:{_APOLOGY}|{_SELF})?(?:但是?|可是?|不过)?(?:(?P<no>{_REFUSE})|{_CLOSING})?|(?P<no2>{_OTHER})", re.I)
_NEGATES = re.compile(r"无法|不能|没有办法|没办法|不便|不方便|难以|拒绝|帮不上|给不了|不予|超出|不在|未能|can\s?not|can[’']?t|unable|not able|not allowed|won[’']?t|will not|don[’']?t|do not|beyond|outside|ne (?:peux|puis|suis)|kann ich|ich kann|できません|かねます", re.I)
_BREAK = re.compile(r"[，。！？!?；;、,\n：:…~～]+|\.(?=\s|$)|[“”\"「」『』（）()\[\]【】]")

_ASKS = {
    "en": re.compile(r"英文|英语|英譯|英译|\bin english\b|auf englisch|en anglais|英語", re.I),
    "fr": re.compile(r"法文|法语|\bin french\b|auf französisch|en français|フランス語", re.I),
    "de": re.compile(r"德文|德语|\bin german\b|auf deutsch|en allemand|ドイツ語", re.I),
    "ja": re.compile(r"日文|日语|\bin japanese\b|auf japanisch|en japonais|日本語", re.I),
    "zh": re.compile(r"中文|汉语|\bin chinese\b|auf chinesisch|en chinois|中国語", re.I),
    "es": re.compile(r"西班牙文|西班牙语|西文|\bin spanish\b|auf spanisch|en espagnol|スペイン語", re.I),
    "it": re.compile(r"意大利文|意大利语|\bin italian\b|auf italienisch|en italien|イタリア語", re.I),
    "pt": re.compile(r"葡萄牙文|葡萄牙语|葡语|\bin portuguese\b|auf portugiesisch|en portugais|ポルトガル語", re.I),
    "ru": re.compile(r"俄文|俄语|\bin russian\b|auf russisch|en russe|ロシア語", re.I),
    "ko": re.compile(r"韩文|韩语|朝鲜语|\bin korean\b|auf koreanisch|en coréen|韓国語", re.I),
    "ar": re.compile(r"阿拉伯文|阿拉伯语|\bin arabic\b|auf arabisch|en arabe|アラビア語", re.I),
    "el": re.compile(r"希腊文|希腊语|\bin greek\b|auf griechisch|en grec|ギリシャ語", re.I),
    "he": re.compile(r"希伯来文|希伯来语|\bin hebrew\b|auf hebräisch|en hébreu|ヘブライ語", re.I),
    "th": re.compile(r"泰文|泰语|\bin thai\b|auf thai|en thaï|タイ語", re.I),
    "hi": re.compile(r"印地文|印地语|\bin hindi\b|auf hindi|en hindi|ヒンディー語", re.I),
}
_STOP = {
    "en": frozenset("the and of to in is was with for how does what why on that it as are his her which should when by a an only than".split()),
    "fr": frozenset("le la les et des du un une dans avec est pour que qui sur au aux après entre puis on plus il elle pas".split()),
    "de": frozenset("der die das und ein eine mit nach von zu im ist man bei nimmt den dem nicht waren wenn auf für sich als".split()),
    "es": frozenset("el los las y una por con para del es se lo como más pero sus al está son muy sin sobre también".split()),
    "it": frozenset("il lo gli e di che è per con una della dei nel alla sono non si come più anche questo".split()),
    "pt": frozenset("o os as e uma do da dos das em no na por com para não é se mais como ao são também".split()),
}
_HAN, _KANA, _ROMAN, _LETTERS = re.compile("[一-鿿]"), re.compile("[぀-ヿ]"), re.compile("[A-Za-zÀ-ɏ]"), re.compile(r"[A-Za-zÀ-ɏ]+")
_OTHERS = {"el": "Ͱ-Ͽ", "ru": "Ѐ-ӿ", "he": "֐-׿", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "th": "฀-๿", "ko": "가-힣"}
_ANY_OTHER = re.compile(f"[{''.join(_OTHERS.values())}]")
_OTHERS = {k: re.compile(f"[{v}]") for k, v in _OTHERS.items()}

_PAIRS = {")": "(", "）": "（", "]": "[", "】": "【", "”": "“", "’": "‘", "」": "「", "』": "『", "》": "《", "〉": "〈", "}": "{"}
_OPEN = frozenset(_PAIRS.values()) - {"‘"}
# Elements that need no end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd tr td th option".split())
_TOKEN = re.compile(
    r"(?P<fence>^[ \t]*(?:`{3,}|~{3,})|```)|(?P<comment><!--|-->)|</(?P<end>[A-Za-z][\w-]*)\s*>|<(?P<tag>[A-Za-z][\w-]*)(?:\s[^<>]*?)?(?P<self>/?)>|(?P<cut><[A-Za-z/][^<>]*$)"
    r"|(?P<mark>(?<!\*)\*\*(?!\*)|(?<![\w~])~~(?=\S)|(?<=\S)~~(?![\w~])|(?<!\w)__(?=\w)|(?<=\w)__(?!\w))|(?P<code>(?<!`)`(?!`))|(?P<straight>\")|(?P<sign>[()（）\[\]【】“”‘’「」『』《》〈〉{}])",
    re.M,
)
_MARKUP_END = re.compile(r"(?:</[A-Za-z][\w-]*\s*>|^[ \t]*(?:`{3,}|~{3,})|```|\|)\s*$", re.M)
_CLOSERS = "”’」』）)】]》〉}\"'*_~`"
_END = frozenset("。！？!?.．…～~︕︖;；")
_MARKER = re.compile(r"^\s*(?:[(（]?\d{1,3}[.．、)）:：]|[(（]?[一二三四五六七八九十]{1,3}[、.．)）]|[-*•·]|[①-⑳])\s*$")
_ITEM = re.compile(r"^\s*(?:[(（]?(\d{1,3})[.．、)）]|[(（]?([一二三四五六七八九十]{1,3})[、.．)）])\s*\S", re.M)
_NUMBER = {c: i for i, c in enumerate("一二三四五六七八九十", 1)} | {"两": 2}
_ANNOUNCED = re.compile(r"(?:共|分|有|以下|如下)[^。！？\n]{0,4}?([两二三四五六七八九十]|\d{1,2})[种个点条项步类方][^。！？\n]{0,6}[：:]\s*\n")


def letters(t: str) -> str:
    return "".join(filter(str.isalnum, t))


def tiles(text: str, pattern: str, least: int) -> list[tuple[int, int]]:
    """Greedy string tiling: places of text covered by longest common runs with pattern, each taken
    from what is still free, until none of ``least`` characters is left."""
    out: list[tuple[int, int]] = []

    def walk(lo: int, hi: int) -> None:
        if hi - lo < least:
            return
        best, at = 0, 0
        seeds: dict[str, list[int]] = {}
        for j in range(len(pattern) - least + 1):
            seeds.setdefault(pattern[j : j + least], []).append(j)
        i = lo
        while i <= hi - least:
            for j in seeds.get(text[i : i + least], ()):
                n = least
                while i + n < hi and j + n < len(pattern) and text[i + n] == pattern[j + n]:
                    n += 1
                if n > best:
                    best, at = n, i
            i += 1
            if best >= hi - i:
                break
        if best:
            out.append((at, at + best))
            walk(lo, at)
            walk(at + best, hi)

    walk(0, len(text))
    return sorted(out)


def language(t: str) -> str | None:
    """Language of a text by script, and by function words within the Latin script; None if unclear."""
    han, kana, roman = len(_HAN.findall(t)), len(_KANA.findall(t)), len(_ROMAN.findall(t))
    if kana >= 3 and kana * 5 > han:
        return "ja"
    if _ANY_OTHER.search(t):
        n, best = max((len(x.findall(t)), k) for k, x in _OTHERS.items())
        if n >= 4 and n > han and n > roman:
            return best
    if han * 2 >= roman and han:
        return "zh"
    if roman < 4:
        return None
    words = [w.lower() for w in _LETTERS.findall(t)]
    score = {k: sum(w in s for w in words) for k, s in _STOP.items()}
    best = max(score, key=score.get)
    return best if score[best] else None


def uncovered(body: str, q: str, least: int, most: int) -> int:
    """Characters of body that lie in no run of ``least`` that q holds; counting ends beyond ``most``."""
    there = {q[i : i + least] for i in range(len(q) - least + 1)}
    done = bare = 0
    for i in range(len(body) - least + 1):
        if body[i : i + least] in there:
            done = i + least
        elif i >= done:
            bare += 1
            if bare > most:
                return bare
    return bare + max(0, len(body) - max(done, len(body) - least + 1))


def is_copy(q: str, a: str) -> bool:
    """Nothing but the question, once or several times: prefaces aside, tiles of it cover the answer."""
    if not q:
        return False
    body = a
    while m := _PREFACE.match(body):
        if body.startswith(q):
            break
        body = body[m.end() :]
    if not body or len(body) < 0.7 * len(q):
        return False
    least = min(5, len(q))
    most = int(0.08 * len(body))
    if uncovered(body, q, least, most) > most:  # no tiling can cover more
        return False
    return sum(e - s for s, e in tiles(body, q, least)) >= 0.92 * len(body)


def is_refusal(question: str, answer: str) -> bool:
    """Every clause, a repeated question aside, apologises, declines or sends elsewhere, and one declines."""
    if question and question in answer:
        answer = answer.replace(question, "，")
    elif question:
        la, lq = letters(answer), letters(question)
        inside = set()
        if any(lq[i : i + 8] in la for i in range(len(lq) - 7)):
            for s, e in tiles(la, lq, 8):
                inside.update(range(s, e))
        keep, at = [], 0
        for ch in answer if inside else ():
            if not ch.isalnum():
                keep.append(ch)
                continue
            if at not in inside:
                keep.append(ch)
            at += 1
        answer = "".join(keep) if inside else answer
    no = False
    for part in _BREAK.split(answer):
        part = part.strip()
        part = _PREFACE.sub("", part)
        if not letters(part):
            continue
        m = _CLAUSE.fullmatch(part)
        if not m:
            return False
        no = no or bool(_NEGATES.search(part))
    return no


def left_open(t: str) -> bool:
    """A pushdown parse of fences, code, comments, tags, emphasis, quotations and brackets: whether
    something is open at the end.  A closing sign without its opening one is passed over."""
    stack: list[str] = []
    for m in _TOKEN.finditer(t):
        kind = m.lastgroup if m.lastgroup != "self" else "tag"
        top = stack[-1] if stack else ""
        if top == "fence":  # within, only its end counts
            if kind == "fence":
                stack.pop()
        elif kind == "fence":
            stack = [x for x in stack if x != "code"] + ["fence"]
        elif top == "comment" or kind == "comment":
            if m[0] == "<!--":
                stack.append("comment")
            elif top == "comment" and m[0] == "-->":
                stack.pop()
        elif kind == "code":
            stack.pop() if top == "code" else stack.append("code")
        elif top == "code":
            continue
        elif kind == "cut":
            return True
        elif kind == "end":
            name = "<" + m["end"].lower()
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif kind == "tag":
            if not m["self"] and m["tag"].lower() not in _VOID:
                stack.append("<" + m["tag"].lower())
        elif kind in ("mark", "straight"):
            sign = m[0]
            if sign in stack:
                del stack[len(stack) - 1 - stack[::-1].index(sign) :]
            else:
                stack.append(sign)
        elif m[0] in _OPEN:
            stack.append(m[0])
        elif m[0] in _PAIRS and top == _PAIRS[m[0]]:
            stack.pop()
    return bool(stack)


def is_truncated(a: str) -> bool:
    """Something open at the end, a list that lacks announced items or ends with a bare marker, or an end
    that is no end of a sentence."""
    t = a.rstrip()
    while t and (U.category(t[-1]) in ("So", "Cf", "Mn", "Sk") and t[-1] != "`" or t[-1] in "​️"):
        t = t[:-1].rstrip()
    if not t:
        return False
    lines = t.split("\n")
    if _MARKER.match(lines[-1]) and len(lines) > 1:
        return True
    if left_open(t):
        return True
    m = None
    for m in _ANNOUNCED.finditer(t):
        pass
    if m:
        want = int(m[1]) if m[1].isdigit() else _NUMBER[m[1]]
        if 0 < len(_ITEM.findall(t, m.end() - 1)) < want:
            return True
    if _MARKUP_END.search(t) and not _MARKER.match(lines[-1]):
        return False
    end = t.rstrip(_CLOSERS)
    if not end:
        return False
    if len(end) < len(t):
        return end[-1] in "，,、：:；;"
    if end[-1] in _END:
        return end[-1] in ";；" or bool(_MARKER.match(lines[-1]))
    if _ITEM.match(lines[-1]) and len(lines) > 2 and _ITEM.match(lines[-2]):
        return end[-1] in "，,、：:"
    return True


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, or None: empty, refusal, copy, other_language or truncated, the first that holds."""
    if answer is None:
        return "empty"
    if len(letters(answer)) <= MOST_FILLER:
        la = letters(U.normalize("NFKC", answer)).lower()
        if not la or la in FILLERS:
            return "empty"
    q = question or ""
    if _NEGATES.search(answer) and is_refusal(q, answer):
        return "refusal"
    if is_copy(letters(q), letters(answer)):
        return "copy"
    lq, la = language(q), language(answer)
    if lq and la and lq != la and not (la in _ASKS and _ASKS[la].search(q)):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def defects(df: DataFrame, id_col: str, question: str, answer: str, table_name: str) -> DataFrame:
    """(table_name, row_key, defect): one row per defective pair.

    Method: a pushdown parser for truncation, greedy string tiling against the question for copies,
    script and function-word checks for the language, and a clause grammar for refusals.  Pairs are
    judged on their own, so there is no shuffle and no skew.  A null answer is empty; a null question
    counts as an empty one, of no language; null ids and repeated rows are kept as they are; an empty
    table gives no rows; other columns are ignored; texts are parsed whatever their length.
    """
    base = df.select(C.column(df, id_col, "long").alias("row_key"), C.column(df, question, "string").alias("q"), C.column(df, answer, "string").alias("a"))
    base = C.spread(base)
    schema = pa.schema([("row_key", pa.int64()), ("defect", pa.string())])

    def judge(b: pa.RecordBatch):
        kinds = [defect(q, a) for q, a in zip(b.column("q").to_pylist(), b.column("a").to_pylist())]
        at = [i for i, k in enumerate(kinds) if k]
        yield K.table(schema, b.column("row_key").take(pa.array(at, type=pa.int64())), [kinds[i] for i in at])

    return C.map_rows(base, ["q", "a"], judge, schema).select(F.lit(table_name).alias("table_name"), "row_key", "defect")


def found(sft: DataFrame, evals: DataFrame) -> DataFrame:
    return defects(sft, "sample_id", "instruction", "output", "sft_samples").unionByName(defects(evals, "id", "question", "answer", "eval_rigor_results_v1_pre_guard"))
