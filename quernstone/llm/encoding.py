"""Text decoded with the wrong encoding (problem 2).

A hidden Markov model labels the characters of a line: one clean state, one
state per pair of encodings (the one the text was read in, the one it was
written in), and one for what no inverse brings back. A state emits characters:
the clean one those that stand there, a pair's those its inverse transform
makes of them. How likely a character is comes from the share of pages that
have it and from its neighbours: signs of other scripts, and signs that are no
letters, are not expected within a word. Both are shares, with a fixed floor,
so the model does not drift with the size of the table. Each labelled span gets
its state's inverse transform.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (read as, written in). "latin" is cp1252 with the unassigned bytes as they are.
PAIRS = [
    ("latin", "utf-8"), ("gbk", "utf-8"), ("cp932", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("big5", "utf-8"), ("mac_roman", "utf-8"), ("mac_roman", "latin"),
    ("latin", "gbk"), ("latin", "cp932"), ("latin", "euc_jp"), ("latin", "big5"), ("latin", "cp1251"), ("latin", "koi8_r"),
    ("gbk", "cp932"), ("gbk", "euc_jp"), ("gbk", "big5"), ("gbk", "cp1251"), ("gbk", "koi8_r"), ("gbk", "latin"), ("big5", "gbk"), ("cp932", "gbk"), ("cp932", "latin"),
    ("cp437", "latin"), ("cp850", "latin"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "latin"),
]
#: The state of what is lost.
GONE = len(PAIRS)
#: Log probability of changing the state, and of a byte no character comes of.
SWITCH, BROKEN = -6.0, -18.0
#: The same change for pairs written in UTF-8, whose sequences are no chance, and for signs of loss.
SWITCH_STRICT = -3.5
#: A pair that is found elsewhere on the page costs so much of it.
FAVOUR = 0.5
#: Share of pages a character is taken to be on at least.
FLOOR = 1e-5
#: A character on a smaller share of the pages makes its line worth a look.
RARE = 0.01

_LATIN = re.compile("[\u0080-\u009f�]|[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]|[¡-ÿ]{3}|[а-яё][А-ЯЁ]|锟斤拷|烫烫|屯屯屯")
#: What is left where a decoder gave up.
_LOST = re.compile("[\u0080-\u0084\u0086-\u009f�]|锟斤拷|锟届|烫烫烫|屯屯屯屯")
#: A sample named as a text's subject stands in marks of quotation or alone between blanks.
_QUOTED = re.compile("[“\"‘'«「『„](\\S{1,24}?)[”\"’'»」』“]")
_RUN = re.compile("[^\x00-\x7f]{4}")
#: Of these pairs whole words are garbled: accents by themselves are none of theirs.
_WHOLE = {p for p in PAIRS if p[0] in ("latin", "gbk") and p[1] not in ("utf-8", "cp932", "euc_jp", "latin")} | {("latin", "cp932"), ("latin", "euc_jp")}

# Classes of characters, and what their neighbours say of them ----------------

_NEUTRAL, _LOWER, _UPPER, _ACCENTED_UPPER, _SIGN, _GREEK, _CYRILLIC, _EAST, _MARK = range(9)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each character of the basic plane."""
    out = np.zeros(65536, np.int8)
    for c in range(0x250):
        s = chr(c)
        if s.isalpha() and s not in "ªºµ":
            out[c] = _LOWER if s.islower() else _UPPER if c < 128 else _ACCENTED_UPPER
    # Signs that stand in no word, those at the end of a name or number aside.
    for c in "¢£¤¥¦§¨¬¯±´¶¸¼½¾×÷‰€ﬁﬂ◊⁄⌐⌠⌡ⁿ₧■":
        out[ord(c)] = _SIGN
    for c in "„‚“”‹›«»¿¡†‡•™®©ªº°²³¹":
        out[ord(c)] = _MARK
    for a, b in ((0x2B0, 0x300), (0x2200, 0x2300), (0x2500, 0x25A0)):
        out[a:b] = _SIGN
    out[0x370:0x400], out[0x400:0x530] = _GREEK, _CYRILLIC
    for a, b in ((0x3041, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0xFF66, 0xFFA0)):
        out[a:b] = _EAST
    return out


@lru_cache(1)
def neighbourhood() -> np.ndarray:
    """[before, class, after]: log probability of a class between two others, as against anywhere."""
    out = np.zeros((9, 9, 9))
    latin = (_LOWER, _UPPER, _ACCENTED_UPPER)
    for c in (_SIGN, _GREEK, _CYRILLIC):
        for x in latin:
            for y in latin:
                out[x, c, y] = -12
            out[x, c, _NEUTRAL] = out[x, c, c] = -7
            out[_NEUTRAL, c, x] = out[c, c, x] = -3 if c == _GREEK else -5  # a unit may begin with a Greek letter
    out[_NEUTRAL, _SIGN, _NEUTRAL] = -2.5
    out[_LOWER, _MARK, _LOWER] = -9
    out[_LOWER, _ACCENTED_UPPER, _LOWER], out[_LOWER, _ACCENTED_UPPER, _NEUTRAL], out[_UPPER, _ACCENTED_UPPER, _LOWER] = -10, -10, -7
    out[_LOWER, _EAST, _LOWER], out[_LOWER, _EAST, _NEUTRAL], out[_NEUTRAL, _EAST, _LOWER] = -9, -4, -2
    for x in (_LOWER, _ACCENTED_UPPER):
        out[_CYRILLIC, x, _CYRILLIC] = -8
    return out


def unexpected(o: np.ndarray) -> np.ndarray:
    """What its neighbours say of each character of a line."""
    k = classes()[np.minimum(o, 65535)]
    around = np.zeros(len(k) + 2, np.int8)
    around[1:-1] = k
    return neighbourhood()[around[:-2], k, around[2:]]


# Encodings as tables -----------------------------------------------------------


def _decode(b: bytes, written_in: str) -> str:
    if written_in == "latin":
        return "".join(bytes([x]).decode("cp1252") if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(x) for x in b)
    return b.decode(written_in)


@lru_cache(None)
def _encoded(read_as: str) -> np.ndarray:
    """The byte or two of each character, -1 where it has none."""
    out = np.full(65536, -1, np.int32)
    if read_as == "latin":
        for i, c in enumerate(_decode(bytes(range(256)), "latin")):
            out[ord(c)] = i
        out[0x80:0xA0] = range(0x80, 0xA0)
        return out
    for o in range(65536):
        if 0xD800 <= o < 0xE000:
            continue
        try:
            b = chr(o).encode(read_as)
        except UnicodeEncodeError:
            if 0x7F < o < 0xA0:
                out[o] = o
            continue
        out[o] = b[0] if len(b) == 1 else b[0] << 8 | b[1]
    return out


@lru_cache(None)
def _single(written_in: str) -> np.ndarray | None:
    """The character of each byte of an encoding of one byte."""
    if written_in not in ("latin", "cp1251", "koi8_r"):
        return None
    return np.array([ord(_decode(bytes([b]), written_in)) if written_in == "latin" else ord(bytes([b]).decode(written_in, "replace")) for b in range(256)], np.uint32)


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sizes(o: np.ndarray, written_in: str) -> np.ndarray:
    """How many bytes each decoded character had; bytes no character came of have one each."""
    if written_in == "utf-8":
        size = 1 + (o >= 0x80) + (o >= 0x800) + (o >= 0x10000)
    elif written_in == "euc_jp":
        size = 1 + (o >= 0x80).astype(np.int64)
        size[_three()[np.minimum(o, 65535)]] = 3
    else:
        size = 1 + ((o >= 0x80) & ~((o >= 0xFF61) & (o < 0xFFA0) & (written_in == "cp932"))).astype(np.int64)
    return np.where((o >= 0xDC80) & (o < 0xDD00), 1, size)


@lru_cache(1)
def _three() -> np.ndarray:
    out = np.zeros(65536, bool)
    for o in range(128, 65536):
        if not 0xD800 <= o < 0xE000:
            try:
                out[o] = len(chr(o).encode("euc_jp")) == 3
            except UnicodeEncodeError:
                pass
    return out


def _bytes_of(o: np.ndarray, read_as: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, the character each is of, characters without bytes)."""
    code = np.where(o < 65536, _encoded(read_as)[np.minimum(o, 65535)], -1)
    none = code < 0
    code = np.where(none, 10, code)
    two = code > 255
    if not two.any():
        return code.astype(np.uint8), np.arange(len(o)), none
    owner = np.repeat(np.arange(len(o)), 1 + two)
    data = (code[owner] & 255).astype(np.uint8)
    first = np.flatnonzero(two) + np.arange(two.sum())
    data[first] = code[two] >> 8
    return data, owner, none


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_EAST_READ = ("gbk", "big5", "cp932")


#: The pairs of each encoding a text was read in.
_READ = {r: [k for k, p in enumerate(PAIRS) if p[0] == r] for r in dict.fromkeys(p[0] for p in PAIRS)}


def _read(o: np.ndarray, read_as: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    data, owner, none = _bytes_of(o, read_as)
    return data, owner, none, data.tobytes()


class Model:
    """The labels of a line. ``share``: on which share of the pages each character of the basic plane is."""

    def __init__(self, share: np.ndarray):
        held = share + FLOOR
        self.logp = np.log(held / max(1.0, float(held.sum())))
        self.logp[0x80:0xA0] = BROKEN
        self.logp[0xD800:0xE000] = BROKEN
        self.logp[0xFFFD] = BROKEN
        self.unknown = float(np.log(FLOOR / max(1.0, float(held.sum()))))

    def p(self, o: np.ndarray) -> np.ndarray:
        """Log probability of each character, by itself and between its neighbours."""
        return np.where(o < 65536, self.logp[np.minimum(o, 65535)], self.unknown) + unexpected(o)

    def emissions(self, o: np.ndarray, k: int, read: tuple | None = None) -> np.ndarray | None:
        """What pair ``k`` gives for each character; None where it restores nothing. ``read``: the bytes of ``o``, where they are known."""
        read_as, written_in = PAIRS[k]
        data, owner, none, raw = read or _read(o, read_as)
        table = _single(written_in)
        if table is not None:
            got = table[data]
            e = self.p(got)
        else:
            if written_in == "utf-8" and not _UTF8.search(raw):
                return None
            got = _points(raw.decode(written_in, "surrogateescape"))
            size = _sizes(got, written_in)
            if size.sum() != len(data) or not ((got >= 0x80) & ((got < 0xDC80) | (got > 0xDCFF))).any():
                return None
            e = np.repeat(self.p(got) / size, size)
        out = np.bincount(owner, weights=e, minlength=len(o))
        out[none] = 2 * BROKEN
        return out

    def gone(self, line: str, n: int) -> np.ndarray | None:
        """What the state of lost signs gives for each character."""
        out = None
        for m in _LOST.finditer(line):
            if out is None:
                out = np.full(n, BROKEN)
            out[m.start() : m.end()] = 0.0
        return out

    def candidates(self, o: np.ndarray):
        """(pair, bytes of the line) of the pairs that can make something of the line's characters."""
        high = o[(o > 127) & (o < 65536)]
        east = (classes()[high] == _EAST) | (high >= 0x3000) & (high < 0x3100) | (high >= 0xFF00)
        high = {True: np.unique(high[east]), False: np.unique(high[~east])}
        for read_as, pairs in _READ.items():
            mine = high[read_as in _EAST_READ]
            if len(mine) and (_encoded(read_as)[mine] > 127).any():
                read = _read(o, read_as)
                for k in pairs:
                    yield k, read

    def labels(self, line: str, favoured: frozenset[int] = frozenset()) -> list[int]:
        """The state of each character: -1 clean, else the number of the pair, or GONE."""
        o = _points(line)
        n = len(o)
        clean = self.p(o)
        states, emitted, cost = [-1], [np.zeros(n)], [0.0]
        tried = [(k, self.emissions(o, k, read)) for k, read in self.candidates(o)]
        if (lost := self.gone(line, n)) is not None:
            tried.append((GONE, lost))
        for k, e in tried:
            if e is None:
                continue
            gain, pay = e - clean, _cost(k) * (FAVOUR if k in favoured else 1)
            # A pair can only win where it is ahead over some stretch.
            run = np.cumsum(gain)
            low = np.minimum(np.minimum.accumulate(run), 0.0)
            if max(run[0], (run[1:] - low[:-1]).max(initial=0.0)) > -2 * pay:
                states.append(k)
                emitted.append(gain)
                cost.append(pay)
        if len(states) == 1:
            return [-1] * n
        # Where no state gains or loses, no label changes: only the other places count.
        e = np.array(emitted)
        at = np.flatnonzero(np.abs(e).max(axis=0) > 1e-12)
        path = _best_path(e[:, at].T.tolist(), cost)
        out = np.full(n, -1)
        where = np.searchsorted(at, np.arange(n), "right") - 1
        full = np.array(path)[np.maximum(where, 0)]
        full[where < 0] = path[0]
        inside = full == np.array(path)[np.minimum(where + 1, len(path) - 1)]
        own = np.zeros(n, bool)
        own[at] = True
        good = own | inside & (where >= 0) & (where < len(path) - 1)
        out[good] = np.array(states)[full[good]]
        return out.tolist()

    def spans(self, line: str, favoured: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
        """(from, to, pair) of each labelled stretch that holds a sign beyond ASCII."""
        labels, out, at = self.labels(line, favoured), [], 0
        for i in range(1, len(line) + 1):
            if i == len(line) or labels[i] != labels[at]:
                k = labels[at]
                if k >= 0 and not line[at:i].isascii() and (k == GONE or PAIRS[k] not in _WHOLE or _RUN.search(line[at:i])):
                    out.append((at, i, k))
                at = i
        return out

    def judge(self, line: str, favoured: frozenset[int] = frozenset()) -> tuple[frozenset[int], str]:
        """The states found in the line, none where it is clean, and the line restored.

        Some texts were decoded wrongly more than once: what is restored is
        judged again as long as it becomes likelier.
        """
        fixed, found = line, set()
        while True:
            new, again = fixed, False
            for s, e, k in reversed(self.spans(fixed, favoured)):
                if _sample(fixed, s, e):
                    continue
                found.add(k)
                if k != GONE:
                    new = new[:s] + self.restore(fixed[s:e], k) + new[e:]
                    again = True
            if not again or new == fixed or fixed is not line and self.p(_points(new)).mean() <= self.p(_points(fixed)).mean():
                return frozenset(found), new if fixed is line else fixed
            fixed = new
            if not _LATIN.search(fixed):
                return frozenset(found), fixed

    def restore(self, span: str, k: int) -> str:
        read_as, written_in = PAIRS[k]
        data, _, none = _bytes_of(_points(span), read_as)
        if none.any():
            data = data.copy()
            data[data == 10] = ord("?")
        return _decode(data.tobytes(), "latin") if written_in == "latin" else data.tobytes().decode(written_in, "replace")


def _best_path(gains: list[list[float]], cost: list[float]) -> list[int]:
    """The number of the state at each place on the likeliest way."""
    size, back = range(len(cost)), []
    score = [c + g for c, g in zip(cost, gains[0])]
    for row in gains[1:]:
        best = max(size, key=score.__getitem__)
        top, came, nxt = score[best] + cost[best], [], []
        for s in size:
            other = top + cost[s]
            if s == best or score[s] >= other:
                came.append(s)
                nxt.append(score[s] + row[s])
            else:
                came.append(best)
                nxt.append(other + row[s])
        back.append(came)
        score = nxt
    s = max(size, key=lambda j: score[j] + cost[j])
    path = [s]
    for came in reversed(back):
        s = came[s]
        path.append(s)
    return path[::-1]


def _cost(k: int) -> float:
    return SWITCH_STRICT if k == GONE or PAIRS[k][1] == "utf-8" else SWITCH


def _sample(line: str, s: int, e: int) -> bool:
    """Whether the passage is quoted as a sample in a clean line: a word within marks, or a token by itself in ASCII prose."""
    for m in _QUOTED.finditer(line):
        if m.start() < s + 1 and e - 1 < m.end() and (line[: m.start()] + line[m.end() :]).strip():
            rest = line[: m.start()] + line[m.end() :]
            return not _LOST.search(rest) and len(rest) > 30
    alone = (s == 0 or line[s - 1] == " ") and (e == len(line) or line[e] in " ,.;:")
    words = line.split()
    return alone and line[s:e].strip() == "锟斤拷" and len(words) > 6 and (line[:s] + line[e:]).isascii()


def page_counts(pages: DataFrame) -> np.ndarray:
    """On how many pages each character of the basic plane is, with the number of pages last: a table of fixed size."""

    def run(batches):
        total = np.zeros(65537, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    o = np.unique(_points(text))
                    total[o[o < 65536]] += 1
                    total[65536] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    table = np.zeros(65537, np.int64)
    for r in pages.select("content").mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r.c] = r.n
    return table


class Fields:
    """Looks at the fields of a page, line by line; lines seen before are not judged again."""

    def __init__(self, counts: np.ndarray):
        share = counts[:65536] / max(1, counts[65536])
        self.model = Model(share)
        self.rare = (share < RARE) & (np.arange(65536) > 127)
        self.seen: dict[tuple, tuple[frozenset[int], str]] = {}

    def look(self, text: str, favoured: frozenset[int] = frozenset()) -> tuple[frozenset[int], str]:
        """The states found in the text, and the text restored.

        A line is looked at if a character of it is rare, or not expected
        between its neighbours, or stands as in texts decoded wrongly.
        """
        if text.isascii():
            return frozenset(), text
        o = _points(text)
        odd = self.rare[np.minimum(o, 65535)] | (unexpected(o) < 0)
        at = np.flatnonzero(odd).tolist() + [m.start() for m in _LATIN.finditer(text)]
        if not at:
            return frozenset(), text
        ends = np.flatnonzero(o == 10)
        lines, found = text.split("\n"), frozenset()
        for n in np.unique(np.searchsorted(ends, at)).tolist():
            key = (lines[n], favoured)
            if key not in self.seen:
                if len(self.seen) > 50_000:
                    self.seen.clear()
                self.seen[key] = self.model.judge(lines[n], favoured)
            states, lines[n] = self.seen[key]
            found |= states
        return found, "\n".join(lines)

    def page(self, content: str | None, title: str | None):
        """(field, restored) of each affected field; a pair found in one field is likelier in the other."""
        got = {"content": self.look(content) if content else (frozenset(), ""), "title": self.look(title) if title else (frozenset(), "")}
        for field, other, text in (("title", "content", title), ("content", "title", content)):
            if text and not got[field][0] and (hint := got[other][0] - {GONE}):
                got[field] = self.look(text, hint)
        return [(f, text) for f, (found, text) in got.items() if found]


def repair(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, field, restored of every affected field; field is content or title.

    Restored holds what the spans' inverse transforms give; signs that were
    lost stay as they are. Null and empty fields are no cases, rows that come
    twice count once.
    """
    held = pages.sparkSession.sparkContext.broadcast(page_counts(pages))

    def run(batches):
        fields = Fields(held.value)
        for batch in batches:
            rows = [(k, f, x) for k, content, title in zip(*(c.to_pylist() for c in batch.columns)) for f, x in fields.page(content, title)]
            keys, names, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["page_id", "field", "restored"])

    bare = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), "content", "title")
    return bare.mapInArrow(run, "page_id bigint, field string, restored string").dropDuplicates(["page_id", "field"])
