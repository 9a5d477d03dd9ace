"""Sentence ends across languages and scripts (problem 10).

The boundary rules are compiled into a finite transducer. A scanner turns a
text into symbols at places: what opens and closes a stretch whose marks don't
count (brackets, embedded quotations, headings and list items), marks that end
a sentence outside of these, and breaks that always do. The transducer's state
is the depth of such stretches. The symbols of many texts are cut into chunks
of equal length; every chunk becomes a function from state to state, the
functions are composed by a parallel prefix scan, and then each chunk is run
from the state it starts in. So one very long text is no longer a chain than
many short ones.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, SOFT, HARD, START = range(5)
DEPTHS = 16  # more than there are kinds of stretches, which are not nested in their own kind
CHUNK = 64

#: Abbreviations that a name, a number or a further word follows, whatever its case.
NEVER = frozenset(
    "ex dr dra mr mrs ms prof sr sra no nr nos vol vols pp cf vs approx art al abs abb fig figs sec ch ca bzw bzgl ggf vgl mio mrd tel hrsg st. mme mlle me mgr núm pág págs ej "
    "см рис стр табл т е н напр им ул кв гг г-н e.g i.e z.b d.h u.a o.ä p.ex p.ej د أ م डॉ श्री ดร พ.ศ ค.ศ z d h u a p m b s c o n gen col sgt capt rev hon sen rep ed eds trans est ave blvd"
    .split()
)
#: Abbreviations that may also be the last word of a sentence.
MAYBE = frozenset("etc usw usf inc ltd corp co bros st min max sec hrs hr ff jh jr bc ad a.m p.m u.k u.s u.s.a d.c ph.d km cm mm kg м г км др пр руб тыс млн sté cía".split())
#: Months after an ordinal number.
MONTHS = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner|Jh\b|Jahrhundert|Mal\b|Auflage|Band|Kapitel)")
ORDINAL_BEFORE = re.compile(r"(?:^|[\s(])(?:[Aa]m|[Vv]om|[Zz]um|[Bb]is|[Dd]e[rmns]|[Dd]ie|[Dd]as|[Ii]m|[Ss]eit|[Aa]b)\s+$")
#: Who says it, after a quotation, where no letter case tells.
SAYS = re.compile(
    r"[^。！？!?\n]{0,24}?(?:问道|说道|答道|喊道|叫道|问|说|道|喊|補充|补充)|(?:と|って)|[^।!?\n]{0,40}?(?:पूछा|कहा|बोल|बताया)|(?:سأل|قال|أجاب|صاح|تساءل)|[^\n]{0,30}?(?:ถาม|กล่าว|พูด)"
)
#: A name and who says it, where letter case tells.
NAMED = re.compile(r"(?:[^\W\d_][\w’'-]*\s+){1,4}?(?:asked|said|cried|shouted|replied|answered|wondered|added|whispered|called|sagte|fragte|rief|antwortete|dijo|preguntó|respondió|exclamó|gritó|dit|demanda|répondit|cria|disse|perguntou|respondeu|спросил\w*|сказал\w*|ответил\w*|крикнул\w*)\b(?!\s*:)")

_BLANK = r"[^\S\r\n]"
_GAP = re.compile(rf"(?:\r\n|\n|\r){_BLANK}*(?:\r\n|\n|\r)\s*")
_ITEM = re.compile(rf"(?:^|(?<=[\n\r])){_BLANK}*(#{{1,6}}{_BLANK}|[-*+•‣◦·▪–]{_BLANK}+|\d{{1,3}}[.)]{_BLANK}+|[（(]\d{{1,2}}[)）]|\d{{1,2}}、)")


def _within(left: str, right: str, never: str, least: str = "") -> str:
    """A stretch from ``left`` to ``right`` without signs of ``never``, of any length, that no blank line parts."""
    n = re.escape(never)
    return rf"{re.escape(left)}{least}[^{n}\n]*+(?:\n(?!{_BLANK}*[\r\n])[^{n}\n]*+)*+[{re.escape(right)}]"


_PAIR = re.compile("|".join(_within(*x) for x in (("“", "”", "“”"), ("„", "“”", "„“”"), ("«", "»", "«»"), ("「", "」", "「」"), ("『", "』", "『』"), ("《", "》", "《》"))) + r"|\"[^\"\n]+\"|‘[^‘’]+(?<=[.!?…])’")
_BRACKET = re.compile("|".join(_within(*x) for x in (("(", ")", "()"), ("（", "）", "（）"), ("[", "]", "[]"), ("【", "】", "【】"))))
_MARK = re.compile(r"([.!?…。！？؟।॥｡]+)((?:[   ]?»|[”’\"」』)\]）】›]|(?<=[.!?…])“)*)")
_THAI = re.compile(r"(?<=[ก-๎])[  ]+(?=[ก-๎])")
_WORD = re.compile(r"[^\s(（\[“„«»\"‘’'—–/,;:]*$")
_INNER = re.compile(r"^(?:\w{1,2}\.)+\w{1,2}$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_OPENERS = "“„«「『\"(（[¿¡‘"
_QUOTES = set("”’\"」』»›“")

_NEXT = np.zeros((5, DEPTHS), np.int8)
_NEXT[OPEN] = np.minimum(np.arange(DEPTHS) + 1, DEPTHS - 1)
_NEXT[CLOSE] = np.maximum(np.arange(DEPTHS) - 1, 0)
_NEXT[SOFT] = np.arange(DEPTHS)
# HARD and START lead to depth 0 from everywhere.


def _goes_on(text: str, at: int, quoted: bool) -> bool:
    """Whether what stands at ``at`` continues the sentence of the quotation that ended before."""
    n = len(text)
    spaced = at
    while spaced < n and text[spaced].isspace():
        spaced += 1
    if spaced >= n:
        return False
    c = text[spaced]
    if c in ",，、;；:：":
        return True
    if c in "—–-":
        k = spaced + 1
        while k < n and text[k].isspace():
            k += 1
        return k < n and text[k].islower()
    if c.islower():
        return True
    if quoted and c.isupper():
        return NAMED.match(text, spaced) is not None
    if quoted and not c.isupper() and c.isalpha():
        return SAYS.match(text, spaced) is not None
    return False


def _ends(text: str, s: int, m: int, e: int) -> bool:
    """Whether the marks text[s:m] with closing marks to ``e`` end a sentence."""
    n, marks = len(text), text[s:m]
    nxt = text[e] if e < n else ""
    if m < e:
        last = text[e - 1]
        if last in _QUOTES:
            return not _goes_on(text, e, True)
        k = e
        while k < n and text[k].isspace():
            k += 1
        return k > e and k < n and text[k].isupper()  # a sentence in brackets, before another one
    k = e
    while k < n and text[k].isspace():
        k += 1
    c = text[k] if k < n else ""
    if not c:
        return True
    if all(x in ".…" for x in marks) and (len(marks) > 1 or marks == "…"):
        return k > e and (c.isupper() or c in "¿¡")
    if marks != ".":
        if k == e:
            if nxt in ",，、;；:：)）]":
                return False
            return not ("a" <= nxt <= "z" or nxt.isdigit() or nxt in "/=&_#") or marks[-1] in "。！？؟।॥｡"
        if c in "—–" or c in ",，、;；":
            return not _goes_on(text, e, False)
        return True
    word = _WORD.search(text, max(0, s - 24), s).group()
    if k == e:  # no blank after the full stop
        if nxt in _OPENERS:
            return len(word) > 1 and word[-1].isalpha()
        if not nxt.isalpha() or len(word) < 2 or not word.isalpha():
            return False
        before = word[-1]
        if "a" <= nxt <= "z" or nxt.islower():
            return False
        if before.islower() and nxt.isupper():
            return e + 1 >= n or not text[e + 1].isupper() and text[e + 1] != "."
        return not before.isupper() and not nxt.isupper() and not before.isascii() and word not in NEVER
    word = unicodedata.normalize("NFC", word)
    low = word.lower()
    if low in NEVER and not (len(word) == 1 and c.isupper() and word.islower() and word.isascii() and word not in "zdhupmbscon"):
        return False
    if len(word) == 1 and word.isalpha() and (word.isupper() or not word.isascii()) and low not in MAYBE:
        return False  # an initial
    if low in MAYBE or _INNER.match(low):
        return c.isupper() or c in "¿¡“„«\"#"
    if word.isdigit() and len(word) <= 2 and (MONTHS.match(text, k) or c.isalpha() and ORDINAL_BEFORE.search(text, max(0, s - len(word) - 12), s - len(word))):
        return False
    return True


def scan(text: str) -> list[tuple[int, int, int]]:
    """(place, order, symbol) of a text's events; the place of a break is the end of the sentence."""
    out: list[tuple[int, int, int]] = []
    stripped = len(text.rstrip())
    gaps = [(m.start(), m.end()) for m in _GAP.finditer(text)]
    for s, _ in gaps:
        out.append((len(text[:s].rstrip()) if text[s - 1 : s].isspace() else s, 3, HARD))
    out.append((stripped, 3, HARD))
    marks_at, item_before = set(), -2
    after_gap = {e for _, e in gaps}
    for m in _ITEM.finditer(text):
        mark, line = m.group(1), m.start()
        if mark[0].isdigit() and mark[-1].isspace():
            # A number that begins a line of wrapped prose is none of a list.
            fresh = line == 0 or not text[:line].strip() or any(g in after_gap for g in (line, m.start(1))) or item_before == text.rfind("\n", 0, max(0, line - 1)) + 1
            if not fresh:
                continue
        item_before = line
        s = line
        while s > 0 and text[s - 1].isspace():
            s -= 1
        if s:
            out.append((s, 3, HARD))
        out.append((m.start(1), 4, OPEN))
        marks_at.add(m.end(1))
        if mark[0] == "#":
            e = m.end()
            while e < len(text) and text[e] not in "\r\n":
                e += 1
            while e > 0 and text[e - 1].isspace():
                e -= 1
            out.append((e, 3, HARD))
    if any(q in text for q in "“„«「『\"《‘"):
        for m in _PAIR.finditer(text):
            s, e = m.span()
            if _GAP.search(text, s, e):
                continue
            k = s
            while k > 0 and text[k - 1].isspace():
                k -= 1
            started = k == 0 or text[k - 1] in ".!?…。！？؟।॥”»」』" or "\n" in text[k:s] and _GAP.search(text, k, s) is not None
            if started and not _goes_on(text, e, True):
                continue  # stands for itself
            out += [(s + 1, 1, OPEN), (e, 1, CLOSE)]
    if any(b in text for b in "(（[【"):
        for m in _BRACKET.finditer(text):
            out += [(m.start() + 1, 1, OPEN), (m.end(), 1, CLOSE)]
    for m in _MARK.finditer(text):
        s, e = m.span()
        if _ends(text, s, m.end(1), e):
            out.append((e, 2, SOFT))
    for m in _THAI.finditer(text):
        out.append((m.start(), 2, SOFT))
    out.sort()
    return out


def transduce(symbols: np.ndarray) -> np.ndarray:
    """The state each symbol meets, by chunks run as functions and a prefix scan over these."""
    n = len(symbols)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, SOFT, np.int8)  # SOFT keeps the state
    grid[:n] = symbols
    grid = grid.reshape(chunks, CHUNK)
    f = np.tile(np.arange(DEPTHS, dtype=np.int8), (chunks, 1))
    for j in range(CHUNK):
        f = _NEXT[grid[:, j][:, None], f]
    step = 1
    while step < chunks:  # f[i] becomes the composition of all chunks up to i
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.zeros(chunks, np.int8)
    state[1:] = f[:-1, 0]
    met = np.empty((chunks, CHUNK), np.int8)
    for j in range(CHUNK):
        met[:, j] = state
        state = _NEXT[grid[:, j], state]
    return met.ravel()[:n]


def ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, end of the sentence), in order."""
    own, place, symbol = [], [], []
    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        events = scan(text)
        own += [i] * (len(events) + 1)
        place.append(0)
        symbol.append(START)
        place += [p for p, _, _ in events]
        symbol += [s for _, _, s in events]
    if not own:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own, place, symbol = np.array(own), np.array(place), np.array(symbol, np.int8)
    met = transduce(symbol)
    cut = ((symbol == SOFT) & (met == 0) | (symbol == HARD)) & (place > 0)
    own, place = own[cut], place[cut]
    new = np.r_[True, (own[1:] != own[:-1]) | (place[1:] > place[:-1])] if len(own) else np.empty(0, bool)
    return own[new], place[new]


def sentence_ends(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_end: a row per sentence; null, empty and blank texts have none.

    Repeated rows come out as often as they came; other columns stay behind.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own, place = ends(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(place.astype(np.int32))], names=[key, "sent_end"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, sent_end int")
