"""Sentence boundaries across languages, scripts and layouts.

Scripts with blanks between words: a paragraph is a lattice of its terminators, quotation marks and brackets. Evidence for
and against each terminator (what stands before it: abbreviation, initial, ordinal, decimal; and after it: case, number,
opening sign) is the cost of passing it over or of cutting there; a quotation or bracket that opens hides the terminators
up to its close, and costs something if it is never closed or is taken for none. The path of least cost through all of it
gives the sentences. Scripts without blanks: the text between gaps is read as a lattice of dictionary words; a gap is a
boundary if the clause before it is complete by its words or final particle, and what follows opens a new one.
Before that, the layout is resolved: caption, headings, page headers and signature are units of their own, and a page
header that stands inside a sentence is taken out of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from prismlake.llm import cjk, thai

# Abbreviations that never end a sentence, by language.
NEVER = {
    "en": "v vs cf no nos s ss ex fig figs para paras p pp ch art vol approx capt dr mr mrs ms prof st sr jr rev hon gen col lt sgt cr al e.g i.e eg ie viz re",
    "de": "s abs rn z b i v m d h ca nr art anl anm kpt dr prof hr fr vgl urt komm co str bzw gem ggf bd hrsg sog u a o ä aufl gez",
    "fr": "p pp m mm c ex aff cf cap bull mar env art al dr mme mlle st n vol éd chap fig",
    "es": "núm págs pág art cap doc c f j d dra dr sr sra srta p v ej rep t ud uds avda fig vol ed",
    "ru": "ст п с см кап вып вестн гав прил ок е т стр рис гл ред им ул д-р проф напр",
    "hi": "डॉ श्री पृ सं",
    "ar": "د أ ص ج ق",
    "th": "",
}
# Abbreviations that may also end a sentence; what follows decides.
MAYBE = {
    "en": "ltd inc co corp plc llc jj j a.m p.m etc",
    "de": "usw etc f ff kg uhr",
    "fr": "s.a s.a.r.l etc h ha",
    "es": "s.l s.a etc h ha",
    "ru": "г гр д ч га руб коп",
    "hi": "",
    "ar": "",
    "th": "",
}
NEVER = {k: frozenset(v.split()) for k, v in NEVER.items()}
MAYBE = {k: frozenset(v.split()) for k, v in MAYBE.items()}
# Very common words, by language.
COMMON = {
    "en": (" the ", " of ", " was ", " and ", " to ", " it ", " that "),
    "de": (" der ", " die ", " und ", " das ", " ist ", " wird ", " nach ", " nicht ", " am ", " im "),
    "fr": (" le ", " les ", " des ", " du ", " est ", " la ", " une ", " il "),
    "es": (" el ", " los ", " del ", " que ", " por ", " la ", " una ", " se "),
}
EVERY = tuple(dict.fromkeys(w for words in COMMON.values() for w in words))
#: So many very common words tell a paragraph's language.
TELLING = 5
# Months, and words before an ordinal number, in German.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
BEFORE_ORDINAL = frozenset("im am vom zum beim der die das dem den des ein eine einem einen einer und bis ab seit nach vor".split())
# Headings, first words of signature lines, words for a page.
HEADINGS = frozenset("REASONS|Headnote|GRÜNDE|Leitsätze|MOTIFS|Sommaire|FUNDAMENTOS|Sumario|МОТИВЫ|Тезисы|理由|要旨|裁判要旨|कारण|सारांश|الأسباب|ملخص|เหตุผล|หัวเรื่อง".split("|"))
SIGNED = re.compile(r"(?:Signed|Firmado|Подпись|हस्ताक्षर|التوقيع|Signé)\s?:|gez\.\s|署名\s|签名\s|ลงชื่อ\s")
PAGE = re.compile(
    r"(?:.{0,60}?(?:[—–|]\s*))?(?:(?:Page|Seite|Pág\.|Стр\.|หน้า|पृष्ठ|صفحة)\s*\d+\s*(?:of|von|sur|de|из|จาก|من|/)\s*\d+|第\s*\d+\s*页\s*共\s*\d+\s*页|\d+/\d+頁)|[-–—]\s*\d+\s*[-–—]"
)
NUMBER = re.compile(r"(?:(\d{1,4})([.)])|\((\d{1,4})\)|\[(\d{1,4})\])\s+(?=\S)")
TOKEN = re.compile(r"[“”„«»「」『』\"()\[\]（）]|[.!?…。！？।؟]+")
GAP = re.compile(r"[ \t\n]+")
CLOSERS = "”“»」』\")]）’"
OPENER = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"'}
CASED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-žЀ-ӿ]")
THAI = re.compile(r"[฀-๿]")
KANA = re.compile(r"[぀-ヿ]")
OTHER = re.compile(r"[Ѐ-鿿]")
SCRIPTS = [("th", re.compile(r"[฀-๿]+")), ("hi", re.compile(r"[ऀ-ॿ]+")), ("ar", re.compile(r"[؀-ۿ]+")), ("ru", re.compile(r"[Ѐ-ӿ]+")), ("zh", re.compile(r"[぀-鿿]+"))]

# Thai: a word begins neither at a sign that is written on the letter before, nor at a silent letter, nor ends at a vowel written first.
TH_INSIDE = re.compile(r"[ะ-ฺๅ็-๎]|[ก-ฮ][ิุ]?์")
TH_FIRST = frozenset("เแโใไ")


def script(text: str) -> str | None:
    """The rules of the script other than Latin that has most letters of a text, if they are more than a fifth of it."""
    if text.isascii() or not OTHER.search(text):
        return None
    count = {name: sum(map(len, letters.findall(text))) for name, letters in SCRIPTS}
    most = max(count, key=count.get)
    return most if count[most] > len(text) * 0.2 else None


def occurrences(text: str) -> dict[str, int]:
    """How often each very common word occurs in a text in Latin letters."""
    low = f" {text.lower()} "
    return {w: low.count(w) for w in EVERY}


def commonest(count: dict[str, int]) -> dict[str, int]:
    """The same by language."""
    return {name: sum([count[w] for w in words]) for name, words in COMMON.items()}


def latin(text: str) -> str:
    """The rules of a text in Latin letters, from its commonest words."""
    by = commonest(occurrences(text))
    return max(by, key=by.get)


def language(text: str) -> tuple[str, bool]:
    """Which rules a text goes by, from the scripts and commonest words of all of it, and whether paragraphs may differ.

    They may if words of a second language that aren't the first one's too are common enough to tell a paragraph by.
    """
    other = script(text)
    if other:
        return other, False
    count = occurrences(text)
    by = commonest(count)
    lang = max(by, key=by.get)
    return lang, any(sum([count[w] for w in words if w not in COMMON[lang]]) >= TELLING for words in COMMON.values())


def paragraph_language(part: str, lang: str, mixed: bool = True) -> str:
    """Which rules a paragraph goes by in a text of rules lang: its own if it is plainly of another script or language.

    mixed: whether the text has enough common words of a second language for a paragraph of it.
    """
    if lang in COMMON:
        other = script(part)
        if other:
            return other
        if not mixed:
            return lang
        count = commonest(occurrences(part))
        own = max(count, key=count.get)
        return own if count[own] >= TELLING and count[own] > 3 * count[lang] else lang
    if part.isascii():
        return latin(part) if CASED.search(part) else lang
    own = dict(SCRIPTS)[lang]
    return lang if own.search(part) else script(part) or latin(part)


@lru_cache(1 << 14)
def thai_words(chunk: str) -> tuple[str, ...]:
    """The likeliest words of a chunk: the path of least cost through the lattice of dictionary words and unknown letters."""
    n = len(chunk)
    edge = [i == n or not (TH_INSIDE.match(chunk, i) or i and chunk[i - 1] in TH_FIRST) for i in range(n + 1)]
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    word = [False] * (n + 1)
    for i in range(n):
        if cost[i] + 1.3 < cost[i + 1]:
            cost[i + 1], back[i + 1], word[i + 1] = cost[i] + 1.3, i, False
        for k in range(1, min(thai.LONGEST, n - i) + 1) if edge[i] else ():
            if edge[i + k] and cost[i] + 1 < cost[i + k] and chunk[i : i + k] in thai.WORDS:
                cost[i + k], back[i + k], word[i + k] = cost[i] + 1, i, True
    out, at, unknown = [], n, n
    while at > 0:
        start = back[at]
        if word[at]:
            if unknown > at:
                out.append(chunk[at:unknown])
            out.append(chunk[start:at])
            unknown = start
        at = start
    if unknown > 0:
        out.append(chunk[:unknown])
    return tuple(reversed(out))


def thai_starts(text: str, start: int, end: int) -> list[int]:
    """Starts of the sentences after the first in a Thai paragraph."""
    out, clause, last, at = [], [], "", start
    # Gaps since the clause began with a word that makes it wait for its main clause.
    waits = False
    for gap in GAP.finditer(text, start, end):
        chunk = text[at : gap.start()]
        at = gap.end()
        if at >= end:
            break
        words = thai_words(chunk) if THAI.search(chunk) else (chunk,)
        if not clause:
            waits = bool(words) and words[0] in thai.SUBORDINATE
        clause += words
        last = words[-1] if words else ""
        ahead = thai_ahead(text, at, end)
        if not ahead:
            continue
        complete = last in thai.FINAL or thai.predicate(clause)
        opening = ahead[0] in thai.OPEN or thai.predicate(ahead)
        title = max((i for i, w in enumerate(words) if w in thai.TITLE), default=len(words))
        named = 0 < sum(map(len, words[title + 1 :])) <= thai.NAME
        if last in thai.EXPECT or named or thai_goes_on(last, ahead, opening) or not complete:
            continue
        if waits:
            waits = not thai.predicate(clause)
            continue
        # A foreign or masked name may open a clause after a complete one, a number may not.
        if opening and not text[at].isdigit():
            out.append(at)
            clause = []
    return out


def thai_ahead(text: str, at: int, end: int) -> tuple[str, ...]:
    """The words of the chunk at a place, with the next chunk where a sign of repetition stands between."""
    gap = GAP.search(text, at, end)
    follows = text[at : gap.start() if gap else end]
    words = thai_words(follows) if THAI.search(follows) else (follows,) if follows else ()
    if gap and text[gap.end() : gap.end() + 1] == "ๆ" and (next_ := GAP.search(text, gap.end(), end)) and next_.end() < end:
        return words + ("ๆ",) + thai_ahead(text, next_.end(), end)
    return words


def thai_goes_on(last: str, ahead: tuple[str, ...], opening: bool) -> bool:
    """Whether what follows a gap belongs to the clause before it."""
    first = ahead[0]
    if first in thai.CLASSIFIER and (last[-1:].isdigit() or last in thai.CLASSIFIER or len(ahead) == 1):
        return True
    return first in thai.GO_ON or first.startswith("ๆ") or (first in thai.PREPOSITION and not opening)


def opens(text: str, at: int, end: int) -> bool:
    """Whether a sentence could start here, as far as its first sign tells."""
    c = text[at]
    if c.islower():
        return text[at + 1 : at + 2] == "-" and text[at + 2 : at + 3].isupper()
    return c not in ",;:.)]}»”%/&=+"


#: Evidence in nats: a terminator as such, a strong one, reasons against that outweigh it, and those that outweigh even strong ones.
STOP, STRONG, AGAINST, NEVER_SO = 3.0, 3.0, -9.0, -20.0
#: What it costs to take an opening sign for none, and to leave one open at the end of a paragraph.
IGNORED, UNCLOSED = 4.0, 6.0


def evidence(text: str, start: int, p: int, q: int, at: int, end: int, lang: str) -> float:
    """How much speaks for a boundary after the terminator text[p:q]; at: the next sign that isn't a blank or a closing sign."""
    mark = text[q - 1]
    if mark in "。！？।؟":
        return STOP + STRONG + (NEVER_SO if text[at] in ",;:，、；：)）" else 0.0)
    if not opens(text, at, end):
        return NEVER_SO
    if mark in "!?":
        return STOP + STRONG
    if lang in ("zh", "hi") and not (at < end and text[at].isascii() and text[at].isalpha() and text[p - 1].isascii() and text[p - 1].islower()):
        return STOP + NEVER_SO
    if q - p > 1 or mark == "…":
        return STOP + (AGAINST if text[p - 1 : p] == "[" else 0.0)
    i = p
    while i > start and not text[i - 1].isspace() and text[i - 1] not in "([“„«\"'’/":
        i -= 1
    word = text[i:p]
    if not word:
        return STOP
    low, found = word.lower(), STOP
    after_digit = text[at].isdigit() or (text[at] in "([" and text[at + 1 : at + 2].isdigit())
    if at == q and (text[at].isdigit() or (len(word.rpartition(".")[2]) == 1 and text[at + 1 : at + 2] == ".")):
        return found + NEVER_SO
    if low in NEVER[lang]:
        return found + AGAINST
    if low in MAYBE[lang] and (len(word) > 1 or word == low):
        return found + (AGAINST if after_digit else 0.0)
    if len(word) == 1 and word.isalpha():
        return found + (0.0 if word == "X" and lang not in ("ar", "th") and not after_digit else AGAINST)
    if re.fullmatch(r"(?:\w\.)+\w", word) and word[0].isalpha():
        return found + (0.0 if lang not in ("ar", "th") and not after_digit else AGAINST)
    if word[-1].isdigit():
        if lang == "de" and word.isdigit():
            following = re.match(r"\w+", text[at:end])
            j = i
            while j > start and text[j - 1].isspace():
                j -= 1
            k = j
            while k > start and text[k - 1].isalpha():
                k -= 1
            if (following and following.group().lower() in MONTHS) or text[k:j].lower() in BEFORE_ORDINAL:
                found += AGAINST
        return found + (AGAINST if text[at].isdigit() else 0.0)
    return found


def closing(text: str, p: int, at: int, end: int, lang: str) -> float:
    """How much speaks for a boundary after the closing sign text[p] of a quotation that stands in no bracket."""
    if lang in ("zh", "hi", "ar"):
        return AGAINST
    inside = text[p - 1 : p]
    if inside not in ".!?…" and not (inside == " " and text[p - 2 : p - 1] in ".!?…"):
        return AGAINST
    return STOP if at < end and opens(text, at, end) else AGAINST


def paragraph_starts(text: str, start: int, end: int, lang: str) -> list[int]:
    """Starts of the sentences after the first in a paragraph text[start:end]: the path of least cost through its lattice."""
    if lang == "th":
        return thai_starts(text, start, end)
    # A state is the closing sign that is waited for, and the depth of brackets; it keeps its cost and its boundaries.
    # While nothing is open there is but one, whose cost doesn't matter.
    path: tuple | None = None
    states: dict[tuple[str, int], tuple[float, tuple | None]] = {}
    for m in TOKEN.finditer(text, start, end):
        p, q = m.span()
        c = text[p]
        if not states:
            if c in OPENER:
                states = {(OPENER[c], 0): (0.0, path), ("", 0): (IGNORED, path)}
            elif c in "([（":
                states = {("", 1): (0.0, path), ("", 0): (IGNORED, path)}
            elif c not in "”»」』)]）":
                at, found = _node(text, start, p, q, end, lang)
                if found > 0:
                    path = (at, path)
            continue
        states = _step(states, text, start, p, q, end, lang)
        if len(states) == 1 and ("", 0) in states:
            path, states = states["", 0][1], {}
    if states:
        path = min(((cost + UNCLOSED * (bool(close) + depth), own) for (close, depth), (cost, own) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    out.reverse()
    return sorted({*out, *cjk_starts(text, start, end)}) if lang == "zh" else out


def _node(text: str, start: int, p: int, q: int, end: int, lang: str) -> tuple[int, float]:
    """Where a sentence would begin after the terminator text[p:q], and how much speaks for it."""
    at = q
    while at < end and (text[at].isspace() or (text[at] in CLOSERS and at == q and text[at] not in "“\"")):
        at += 1
    return at, evidence(text, start, p, q, at, end, lang) if at < end else AGAINST


def _step(states: dict, text: str, start: int, p: int, q: int, end: int, lang: str) -> dict:
    """The states after one more sign: a node is cut or passed, whichever costs less; evidence that is ignored is what costs."""
    c, node, after = text[p], None, {}

    def reach(state: tuple[str, int], cost: float, path: tuple | None, cut: tuple[int, float] | None = None) -> None:
        if cut is not None and cut[1] > 0:
            path = (cut[0], path)
        if state not in after or cost < after[state][0]:
            after[state] = (cost, path)

    for (close, depth), (cost, path) in states.items():
        if close and c != close:
            reach((close, depth), cost, path)
        elif close and depth:
            reach(("", depth), cost, path)
        elif close:
            at = q
            while at < end and (text[at].isspace() or text[at] in CLOSERS and text[at] != "“"):
                at += 1
            reach(("", 0), cost, path, (at, closing(text, p, at, end, lang)))
        elif c in OPENER:
            reach((OPENER[c], depth), cost, path)
            reach(("", depth), cost + IGNORED, path)
        elif c in "([（":
            reach(("", depth + 1), cost, path)
            reach(("", depth), cost + IGNORED, path)
        elif c in ")]）":
            reach(("", max(0, depth - 1)), cost, path)
        elif c in "”»」』" or depth:
            reach(("", depth), cost, path)
        else:
            node = node or _node(text, start, p, q, end, lang)
            reach(("", 0), cost, path, node)
    return after if len(after) <= BEAM else dict(sorted(after.items(), key=lambda x: x[1][0])[:BEAM])


#: States of a paragraph that are followed at once; more than this would need as many signs open within each other.
BEAM = 64
CJK_GAP = re.compile(r"[ \t\u3000]+")


def cjk_starts(text: str, start: int, end: int) -> list[int]:
    """Starts after gaps of a Chinese or Japanese paragraph that no terminator marks.

    A blank (never a line end) is a boundary if the words before it end in a final particle, those after it begin with an
    opening word, and none of them joins the two sides.
    """
    out = []
    for gap in CJK_GAP.finditer(text, start, end):
        a, b = gap.span()
        if a <= start or b >= end or text[a - 1] in "。！？!?.…\n，、,;；:：（(「『“" or text[b] == "\n":
            continue
        lang = "ja" if KANA.search(text, max(start, a - 40), min(end, b + 40)) else "zh"
        before = cjk.lattice(text[max(start, a - 8) : a].split("\n")[-1].rsplit(" ")[-1], lang)
        after = cjk.lattice(text[b : min(end, b + 8)], lang)
        if before and after and before[-1][1] == "final" and after[0][1] == "open":
            out.append(b)
    return out


def is_caption(block: list[str], after: list[str]) -> bool:
    """Whether the lines before the first empty line are a caption; after: the lines that follow.

    A few short lines are. More or longer ones are if a heading or two empty lines follow and they don't read like one
    wrapped paragraph, whose lines go on in lower case or close with a stop.
    """
    if len(block) <= 8 and all(len(line) <= 120 for line in block):
        return True
    follows = next((line for line in after if line), "")
    parted = after[:2] == ["", ""] or follows in HEADINGS
    prose = sum(line[0].islower() or line[-1] in ".!?。！？।؟" for line in block)
    return parted and prose * 4 <= len(block)


def starts(text: str) -> list[int]:
    """0-based offset of the first character of every sentence unit of a text."""
    lang, mixed = language(text)
    units, lines, at = set(), [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line.strip()))
        at += len(line) + 1
    first = lambda a, b: a + len(text[a:b]) - len(text[a:b].lstrip())

    n, i = len(lines), 0
    while i < n and not lines[i][2]:
        i += 1
    # The caption: up to the first empty line or heading.
    caption = i
    while i < n and lines[i][2] and lines[i][2] not in HEADINGS and not NUMBER.match(lines[i][2] + " x"):
        i += 1
    if i == n or not is_caption([line for _, _, line in lines[caption:i]], [line for _, _, line in lines[i : i + 4]]):
        i = caption  # no caption but a plain text
    units.update(first(a, b) for a, b, _ in lines[caption:i])

    # Paragraphs as runs of lines; a page header leaves the run open.
    runs: list[list[tuple[int, int]]] = []
    open_, expected, style = False, 1, ""
    last = max((j for j in range(n) if lines[j][2]), default=-1)
    for k in range(i, n):
        a, b, line = lines[k]
        if not line:
            if open_ != "header":
                open_ = False
            elif k + 1 < n and lines[k + 1][2]:
                # After a header, empty lines end the paragraph unless it plainly goes on.
                open_ = bool(runs) and "header" if lines[k + 1][2][0].islower() and text[runs[-1][-1][1] - 1] not in ".!?。！？।؟”»" else False
            continue
        if PAGE.fullmatch(line):
            units.add(first(a, b))
            open_ = "header" if open_ else False
            continue
        if line in HEADINGS or k == last and SIGNED.match(line):
            units.add(first(a, b))
            open_ = False
            continue
        m = NUMBER.match(line + " x")
        if m:
            number = int(m[1] or m[3] or m[4])
            kind = m[2] or line[0]
            before = text[runs[-1][-1][0] : runs[-1][-1][1]].rstrip() if runs and open_ else ""
            whole = not before or lang == "th" or before[-1] in "!?。！？।؟”»“" or before[-1] == "." and _ends(before, lang)
            if number == expected and (not style or style == kind) and whole:
                open_, expected, style = False, number + 1, kind
        if open_:
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
        open_ = True
    for run in runs:
        # The run by itself, with line ends where a header or an empty line parts it; offsets are those from its begin.
        a, gaps = run[0][0], [y[0] - x[1] for x, y in zip(run, run[1:], strict=False)]
        body = "".join(text[x:y] + "\n" * gap for (x, y), gap in zip(run, [*gaps, 0], strict=True))
        start = first(a, run[0][1]) - a
        end = len(body)
        while end > start and body[end - 1].isspace():
            end -= 1
        units.add(a + start)
        m = NUMBER.match(body, start)
        inner = m.end() if m and m.end() < end and body[start : m.end()].strip() else start
        units.update(a + s for s in paragraph_starts(body, inner, end, paragraph_language(body[start:end], lang, mixed)) if s < end)
    return sorted(units)


def _ends(line: str, lang: str) -> bool:
    """Whether a line's last stop would end a sentence if a new one followed."""
    p = len(line) - 1
    return evidence(line + " Xx", 0, p, p + 1, p + 2, p + 4, lang) > 0


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, length) of every sentence unit of documents(doc_id, text), by code points.

    A unit reaches to the next one's start. Null, empty and blank texts have no units; texts are read whole, whatever
    their length; each row of a repeated document gives its units again. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, size = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = starts(text)
                docs += [doc] * len(found)
                at += found
                size += [b - a for a, b in zip(found, [*found[1:], len(text)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "start_pos", "length"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, start_pos bigint, length bigint")
