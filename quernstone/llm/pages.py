"""Main content of web pages (problem 1) and pages without sentences (problem 6).

Template deduction. The tokens of a page are its lines, with the site's name
and numbers masked. Lines of a host that occur on the same pages have the same
occurrence vector and form an equivalence class. A class with enough support
among the host's articles is valid if its lines keep their order; the best
supported one is the host's root, and the others are nested in the slot of the
root they always fall into. Hosts with few pages deduce little by themselves:
over all hosts, lines, and how lines begin and end, form the template of sites
at large where they are on a share of the hosts, under many articles, and are
no titles. What such a token is for is read off what follows it: headings of
lists to other stories are followed by short lines, those of remarks have
speakers around them. What is left are the slots; the one that begins at the
page's headline holds the article.

Spam. Phrases of all pages are exploded and the distinct hosts of each counted.
A page is a case if its own text is for the most part outside of sentences and
stitched from phrases replicated on other hosts, or is lists of links.

No word list of any language is used.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.tables import cut

#: Share of a host's pages, and articles at least, a line of its template is on.
HOST_SHARE, HOST_ARTICLES = 0.02, 3
#: A class that is not nested in a slot of the root needs this share.
FREE_SHARE = 0.05
#: Share of all hosts, and hosts at least, a token of sites at large is on.
WIDE_SHARE, WIDE_HOSTS = 0.0015, 6
#: Pages whose title begins or ends so, for each line that does, make a token a title's.
TITLE_SHARE = 0.02
#: Share of a token's places followed by a short line, from which it heads a list; with a speaker around, from which it marks remarks.
HEADS, TALKS = 0.95, 0.3
#: Roles of tokens.
DROP, MORE, TALK = 1, 2, 3
#: Share of the hosts, and hosts at least, a replicated phrase is on.
SPREAD_SHARE, SPREAD_HOSTS = 0.0005, 3
#: A page is a case from these shares: of its own text, outside of sentences; of that, words in replicated phrases, or
#: lines that are links, or lines that have the same word.
OUTSIDE, COPIED, LINKED, REPEATED = 0.55, 0.3, 0.4, 0.6
#: Lines or bytes that a page's own text has at least, to be judged.
LEAST_LINES, LEAST_BYTES = 5, 300
#: Lines of a list to other stories, at most.
TEASERS = 6
#: Bits of the table of replicated phrases: its size is fixed.
TABLE_BITS = 26

_END = re.compile(r"[.!?。！？؟।][”\"’»」』)）\]]*$")
_LINK = re.compile(r"https?://|www\.|→ ?[\w-]+\.\w+|\b[\w-]+\.[a-z]{2,8}/")
_ITEM = re.compile(r"^\s*(?:[-*•–»]|\d+[.)]|\[\d+\])\s")
#: Structure that stands in articles: items, captions and references in brackets, quotations.
_MARK = re.compile(r"^(?:[-*•–»\[“„«「『\"]|\d+[.)])")
#: What bytes of other encodings are shown as.
_AS_BYTES = {ord(bytes([x]).decode("cp1252")): x for x in range(128, 160) if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_BYTES = re.compile("[\x80-\xff]")
_MARKS = re.compile(r"[.!?](?:\s|$)|[。！？؟।]")
_EAST = re.compile("[぀-ヿ㐀-鿿]")
_HEAD = re.compile(r"[^:：|｜·–—\d#]{1,24}[:：|｜·–—]")
_VALUE = re.compile(r"[:：] ?[\d.,]+|\|")
_TERMS = re.compile(r"[^\W_]{2,}")


# Lines as numbers -----------------------------------------------------------------

BODY, TITLED, TITLE, LOOSE, LINK, ITEM, END, CUT, BRACKET, QUOTE, VALUE, SAYING, AGO = (1 << i for i in range(13))
_DIGITS = re.compile(r"\d+")
#: Lists of numbers are binary columns: only Python reads them.
_KINDS = {"name": np.int64, "line": np.int32, "flags": np.int32, "size": np.int32, "who": np.int32, "token": np.int64, "edges": np.int64, "n_words": np.int32, "words": np.int32}
_FEATURES = "page_id bigint, h bigint, m bigint, " + ", ".join(f"{x} binary" for x in _KINDS)


def masked(low: str, site: str) -> str:
    """A line in lower case without the site's name and numbers."""
    return _DIGITS.sub("#", low.replace(site, "@") if site else low)


def is_prose(x: str) -> bool:
    """Whether a line ends as a sentence and is long enough to be one."""
    return (len(x) >= 45 or len(x) >= 15 and len(x.encode()) >= 45) and bool(_END.search(x[-12:])) and not _LINK.search(x[:12])


def is_body(x: str) -> bool:
    """Prose, or a line as long as a paragraph, whose end may be garbled."""
    return is_prose(x) or len(x) >= 150 and not _LINK.search(x)


def restored(s: str) -> str:
    """A line of a script of several bytes a sign that was decoded as one of others; else as it is. Lost bytes stay lost."""
    if len(s) < 45 or s.isascii():
        return s
    raw = s.translate(_AS_BYTES).encode("latin-1", "ignore")
    pairs = [(raw, "utf-8"), (raw, "gb18030")] if 2 * len(raw) > len(s) and _BYTES.search(s) else [(s.encode("gb18030", "ignore"), "utf-8")]
    for data, kind in pairs:
        out = data.decode(kind, "ignore")
        if len(out) < 0.75 * len(s) and len(out.encode(kind, "ignore")) > 0.8 * len(data):
            return out
    return s


def is_loose(s: str, prose: bool) -> bool:
    """Whether a line is no sentence: too short or without an end, or a long one that strings or repeats words."""
    if not prose:
        return True
    if s.isascii() or s.count(" ") * 12 > len(s):
        if len(s) < 60:
            return False
        w = s.lower().split()
        if len(w) < 24 or len(set(w)) > 0.62 * len(w):
            return False
        pairs = set(zip(w, w[1:]))
        return len(pairs) < 0.6 * (len(w) - 1) or len(set(w)) < 0.35 * len(w)
    if len(s) < 60 or len(set(s)) > 0.45 * len(s) or not _EAST.search(s):
        return False
    g = [s[i : i + 3] for i in range(len(s) - 2)]
    return len(set(g)) < 0.6 * len(g)


def speaker(s: str) -> tuple[str, bool, bool] | None:
    """(name, whether words on saying follow, whether a number is among these) of who a line gives the words of.

    A name of at most three words, then at most four small ones, then a colon.
    """
    head = s[:48]
    if (at := head.find(":")) < 0 and (at := head.find("：")) < 0 or _ITEM.match(s):
        return None
    if 0 <= (wide := head.find("：")) < at:
        at = wide
    said = head[:at].strip()
    words = said.split()
    names = next((n for n, w in enumerate(words) if w[0].islower() or w[0].isdigit()), len(words))
    after = words[names:]
    plain = len(after) <= 4 and all(w[0].islower() or w[0].isdigit() for w in after) and (not after or len(s) - len(said) >= 12)
    good = 1 <= names <= 3 and plain and not re.search(r"[.!?。！？]", said) and not any(c.isdigit() for w in words[:names] for c in w)
    ago = any(w[0].isdigit() for w in after) and any(not w.isdigit() for w in after)
    return (" ".join(words[:names]), bool(after), ago) if good and 2 <= len(said) <= 40 and len(s) > len(said) + 2 else None


def _site(host: str | None) -> str:
    return (host or "").lower().removeprefix("www.").split(".")[0]


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


def _edges(key: str) -> tuple[int, int, int]:
    """How a masked line begins (up to a mark or its first words, and its first word) and ends, as tokens."""
    if m := _HEAD.match(key):
        head = m.group(0)
    elif _EAST.match(key):
        head = key[:3]
    else:
        head = " ".join(key.split()[:2])
    tail = key[-3:] if _EAST.search(key[-2:]) else " ".join(key.split()[-2:])
    return _hash("H" + head), _hash("T" + tail), _hash("1" + (key.split() or [""])[0])


def words(s: str) -> list[int]:
    """Hashes of the words of a line; of a script without blanks, of every two signs that follow one another."""
    out = []
    for x in _TERMS.findall(s.lower()):
        out += [x[i : i + 2] for i in range(max(1, len(x) - 1))] if _EAST.match(x) else [x]
    return [xxhash.xxh32_intdigest(x) >> 1 for x in out]


def _look(s: str) -> tuple:
    """(lower case, flags, bytes, speaker, words, masked line, its token, tokens of its edges) of a line by itself."""
    low = s.lower()
    key = _DIGITS.sub("#", low)
    prose = is_prose(s)
    body = prose or len(s) >= 150 and not _LINK.search(s)
    f, w = BODY if body else 0, ()
    # The end of a garbled paragraph may be lost; one with marks within is taken as sentences, unless it repeats itself.
    text = s if prose else restored(s)
    if is_loose(text, prose or text is not s and bool(_MARKS.search(text))):
        w = words(s)
        f |= LOOSE | (LINK if _LINK.search(s) else 0)
    f |= (ITEM if _ITEM.match(s) else 0) | (END if _END.search(s[-12:]) else 0) | (BRACKET if s[0] == "[" else 0) | (QUOTE if s[0] in "“「«„" else 0)
    if s[-1] == "…" or s.endswith("...") and not is_body(s[:-2]):
        f |= CUT
    if not body and _VALUE.search(s):
        f |= VALUE
    who = 0
    if speaks := speaker(s):
        f |= (SAYING if speaks[1] else 0) | (AGO if speaks[2] else 0)
        who = (xxhash.xxh32_intdigest(speaks[0]) >> 1) | 1
    ends = None if body or _MARK.match(s) else _edges(key)
    return low, f, len(s.encode()), who, w, key, _hash("L" + key), ends


def _packed(values: list[int], counts: list[int], kind: type) -> pa.Array:
    """A list of numbers a page, as bytes."""
    data = np.array(values, kind)
    ends = np.r_[0, np.cumsum(counts, dtype=np.int64)] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def features(pages: DataFrame) -> DataFrame:
    """What the lines of each page are, as numbers; nothing after this reads the texts.

    name: tokens of the title; line: numbers of the lines that are not blank;
    flags, size in bytes; who: hash of the speaker; token: of the whole line;
    edges: three a line, 0 where it has none; words: of the lines outside of sentences.
    """

    def run(batches):
        seen: dict[str, tuple] = {}  # lines of templates come again and again
        for batch in batches:
            ids, hosts, articles, names, name_n = [], [], [], [], []
            number, flags, size, who, token, edges, n_words, terms, lines_n, terms_n = ([] for _ in range(10))
            for page, host, title, content in zip(*(c.to_pylist() for c in batch.columns)):
                if not content or not content.strip():
                    continue
                site, title = _site(host), (title or "").strip()
                name = masked(title.lower(), site) if title else None
                longest, lines, held = "", 0, len(terms)
                for i, s in enumerate(content.split("\n")):
                    s = s.strip()
                    if not s:
                        continue
                    lines += 1
                    if len(s) > len(longest):
                        longest = s
                    if (known := seen.get(s)) is None:
                        known = _look(s)
                        if len(s) < 200:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen[s] = known
                    low, f, bytes_, speaker_, w, key, line, ends = known
                    if site and site in low:
                        key = masked(low, site)
                        line, ends = _hash("L" + key), ends and _edges(key)
                    if key == name or name and key.lstrip("*•-– ") == name:
                        f |= TITLED | (TITLE if s == title else 0)
                        ends = None
                    terms += w
                    n_words.append(len(w))
                    number.append(i)
                    flags.append(f)
                    size.append(bytes_)
                    who.append(speaker_)
                    token.append(line)
                    edges += ends or (0, 0, 0)
                ids.append(page)
                hosts.append(_hash(host or ""))
                articles.append(1 << (_hash(longest) % 63))
                lines_n.append(lines)
                terms_n.append(len(terms) - held)
                names += _edges(name) if name else ()
                name_n.append(3 if name else 0)

            counts = {"name": name_n, "edges": [3 * x for x in lines_n], "words": terms_n}
            lists = dict(zip(_KINDS, (names, number, flags, size, who, token, edges, n_words, terms)))
            packed = [_packed(x, counts.get(name, lines_n), _KINDS[name]) for name, x in lists.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hosts, articles)] + packed, names=["page_id", "h", "m", *_KINDS])

    return pages.select(F.col("page_id").cast("bigint"), "host", "title", "content").mapInArrow(run, _FEATURES)


#: Where flags hold the role of a line among sites at large, and whether it begins or ends as theirs.
ROLE, EDGE = 20, 22


def with_roles(found: DataFrame, keys: np.ndarray, roles: np.ndarray) -> DataFrame:
    """The features with the roles of tokens of sites at large (sorted ``keys``) in the flags, without tokens."""
    held = found.sparkSession.sparkContext.broadcast((keys, roles))
    names = ["page_id", "h", "line", "flags", "size", "who", "n_words", "words"]

    def run(batches):
        keys, roles = held.value

        def find(k: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(k), np.int32)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return np.where(keys[at] == k, roles[at], 0)

        for batch in batches:
            b = _Batch(batch)
            ends = (find(b.flat("edges")).reshape(-1, 3) > 0).any(axis=1)
            b.c["flags"] = _packed(b.flags | find(b.flat("token")) << ROLE | ends.astype(np.int32) << EDGE, np.diff(b.start), np.int32)
            yield pa.RecordBatch.from_arrays([b.c[x] for x in names], names=names)

    shape = "page_id bigint, h bigint, " + ", ".join(f"{x} binary" for x in names[2:])
    return found.select(*names, "token", "edges").mapInArrow(run, shape)


class _Batch:
    """The pages of a batch, line by line: ``page`` is the place of each line's page."""

    def __init__(self, batch: pa.RecordBatch):
        self.c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.pages = batch.num_rows
        self.line = self.flat("line")
        self.start = self.offsets("line")
        self.page = np.repeat(np.arange(self.pages), np.diff(self.start))
        self.flags = self.flat("flags")

    def flat(self, name: str) -> np.ndarray:
        """The lists of all pages, one after the other."""
        c = self.c[name]
        if name not in _KINDS:
            return c.flatten().to_numpy(zero_copy_only=False)
        if not len(c):
            return np.empty(0, _KINDS[name])
        at = self.ends(c)
        return np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(_KINDS[name])

    @staticmethod
    def ends(c: pa.Array) -> np.ndarray:
        return np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]

    def offsets(self, name: str) -> np.ndarray:
        c = self.c[name]
        if not len(c):
            return np.zeros(1, np.int64)
        if name not in _KINDS:
            at = c.offsets.to_numpy()
            return at - at[0]
        at = self.ends(c).astype(np.int64)
        return (at - at[0]) // np.dtype(_KINDS[name]).itemsize

    def roles(self, edges: bool) -> np.ndarray:
        """What the lines of the template are for, 0 where they are not of it; with ``edges``, also of lines that only begin or end as those of sites do."""
        out = self.flags >> ROLE & 3
        counts = np.diff(self.offsets("template"))
        own = np.repeat(np.arange(self.pages), counts).astype(np.int64) << 32 | self.flat("template").astype(np.int64)
        out[(out == 0) & np.isin(self.page.astype(np.int64) << 32 | self.line, own)] = DROP
        if edges:
            out[(out == 0) & (self.flags >> EDGE & 1 > 0)] = DROP
        out[self.flags & TITLED > 0] = 0
        return out

    def own(self, roles: np.ndarray) -> np.ndarray:
        """Which lines a page holds besides its template, its headline and short lists to other stories."""
        plain = (roles == 0) & (self.flags & TITLE == 0)
        out = plain & (self.flags & CUT == 0)
        short = plain & (self.flags & (BODY | LINK) == 0)
        for at in np.flatnonzero(roles == MORE).tolist():
            end, last = at + 1, self.start[self.page[at] + 1]
            while end < last and short[end]:
                end += 1
            if end - at - 1 <= TEASERS:  # no list to other stories is longer
                out[at + 1 : end] = False
        return out


def _phrases(b: _Batch, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, word) of each word of the chosen lines, and (phrase, whether the line goes on) of the pair it begins.

    Phrases are pairs of words that follow one another; a word by itself is one.
    """
    n = b.flat("n_words").astype(np.int64)
    line = np.repeat(np.arange(len(n)), n)
    keep = chosen[line]
    line, w = line[keep], b.flat("words").astype(np.uint64)[keep]
    inside = np.r_[line[1:] == line[:-1], False] if len(line) else np.empty(0, bool)
    after = np.where(inside, np.r_[w[1:], w[:1]], np.uint64(0)) if len(line) else w
    g = (w * np.uint64(0x9E3779B97F4A7C15) ^ (after + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)
    return line, w.astype(np.int64), g.astype(np.int64), inside


#: Marks of a token's place: it is a whole line, equal to the title, followed by a short line, by a speaker, after one; or it is a title's.
WHOLE, NAMED, SHORT, NEXT, LAST, OF_TITLE = (1 << i for i in range(6))


def tokens_of(found: DataFrame) -> DataFrame:
    """page_id, h (host), i, k (token), m (a bit of the page's article), marks (sum of the above): a row per token of a page.

    A token counts once a page; rows of titles are no places of it.
    """

    def run(batches):
        for batch in batches:
            b = _Batch(batch)
            ids, hosts, arts = (b.c[x].to_numpy() for x in ("page_id", "h", "m"))
            who, body = b.flat("who") > 0, b.flags & BODY > 0
            last = np.r_[b.page[1:] != b.page[:-1], True] if len(b.page) else np.empty(0, bool)
            first = np.r_[True, last[:-1]] if len(b.page) else last
            short = ~last & ~np.roll(body | who, -1)
            spoken = (~last & np.roll(who, -1)) + 2 * (~first & np.roll(who, 1))
            k = np.c_[b.flat("token"), b.flat("edges").reshape(-1, 3)]
            page, i = np.repeat(b.page, 4), np.repeat(b.line, 4)
            kind = np.tile(np.arange(4), len(b.line))
            k = k.ravel()
            there = k != 0
            order = np.flatnonzero(there)
            order = order[np.lexsort((order, k[order], page[order]))]
            once = order[np.r_[True, (k[order][1:] != k[order][:-1]) | (page[order][1:] != page[order][:-1])]] if len(order) else order
            row = once // 4
            named = b.flags[row] & TITLED > 0
            t, of = b.flat("name"), np.repeat(np.arange(b.pages), np.diff(b.offsets("name")))
            z = np.zeros(len(t), np.int32)
            p = np.r_[page[once], of]
            marks = (kind[once] == 0) * 1 + named * NAMED + short[row] * SHORT + spoken[row] * NEXT
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[p], hosts[p], np.r_[i[once], z - 1].astype(np.int32), np.r_[k[once], t], np.r_[arts[page[once]], z.astype(np.int64)], np.r_[marks, z + OF_TITLE].astype(np.int32))],
                names=["page_id", "h", "i", "k", "m", "marks"],
            )

    shape = "page_id bigint, h bigint, i int, k bigint, m bigint, marks int"
    return found.select("page_id", "h", "m", "name", "line", "flags", "who", "token", "edges").mapInArrow(run, shape)


def by_host(tokens: DataFrame) -> DataFrame:
    """h, k and what its places on the host come to; v: the occurrence vector, as the sum of hashes of its pages."""
    there = F.col("marks") < OF_TITLE
    count = lambda mark: F.sum((F.col("marks").bitwiseAND(mark) > 0).cast("long"))
    return tokens.groupBy("h", "k").agg(
        F.sum(there.cast("long")).alias("n"), F.bit_or("m").alias("m"), (count(WHOLE) > 0).alias("line"), count(NAMED).alias("named"), count(OF_TITLE).alias("titles"),
        count(SHORT).alias("short"), count(NEXT).alias("next"), count(LAST).alias("last"), F.sum(F.when(there, F.xxhash64("page_id") % 1_000_000_007).otherwise(0)).alias("v"),
    )


def wide_tokens(own: DataFrame, hosts: int) -> dict[int, int]:
    """The tokens of sites at large and their roles.

    At most (tokens of a host, on average) / WIDE_SHARE, whatever the number of hosts.
    """
    least = max(WIDE_HOSTS, WIDE_SHARE * hosts)
    sums = [F.sum(c).alias(c) for c in ("n", "named", "titles", "short", "next", "last")]
    at = own.groupBy("k").agg(F.count_if(F.col("n") > 0).alias("hosts"), F.bit_or("m").alias("m"), F.max("line").alias("line"), *sums)
    good = (F.col("hosts") >= least) & (F.bit_count("m") >= WIDE_HOSTS) & (F.col("named") < TITLE_SHARE * F.col("n")) & (F.col("titles") < TITLE_SHARE * F.col("n"))
    role = F.when(F.col("line") & (F.greatest("next", "last") >= TALKS * F.col("n")), TALK).when(F.col("line") & (F.col("short") >= HEADS * F.col("n")), MORE).otherwise(DROP)
    got = at.where(good).select("k", role.alias("role")).toArrow()
    return dict(zip(got["k"].to_pylist(), got["role"].to_pylist()))


def host_template(tokens: DataFrame, own: DataFrame) -> DataFrame:
    """page_id, template (numbers of its lines that are in valid classes of its host)."""
    lines = tokens.where(F.col("marks").bitwiseAND(WHOLE) > 0).select("page_id", "h", "i", "k")
    pages = lines.groupBy("h").agg(F.count_distinct("page_id").alias("pages"))
    likely = own.where("line").where(F.col("named") < TITLE_SHARE * F.col("n")).where(F.bit_count("m") >= HOST_ARTICLES).join(pages, "h").where(F.col("n") >= HOST_SHARE * F.col("pages"))
    likely = likely.select("h", "k", "n", "pages", F.xxhash64("h", "v", "n").alias("class"))
    classes = likely.groupBy("h", "class").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.first("pages").alias("pages"))
    root = classes.groupBy("h").agg(F.max_by("class", F.struct("n", "size", "class")).alias("root"))
    at = cut(lines.join(likely.select("h", "k", "class"), ["h", "k"]).join(root, "h").select("page_id", "i", "k", "class", "root").distinct())

    def look(batches):
        """class, order (of its lines on a page), slot (lines of the root before its first one)."""
        for batch in batches:
            out = []
            for places in batch.column(0).to_pylist():
                before, orders, slots = 0, {}, {}
                for p in places:
                    c = p["class"]
                    slots.setdefault(c, before)
                    orders.setdefault(c, []).append(p["k"])
                    before += c == p["root"]
                out += [(c, xxhash.xxh3_64_intdigest(repr(ks)) >> 1, slots[c]) for c, ks in orders.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["class", "order", "slot"])

    seen = at.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", "k", "class", "root"))).alias("places")).select("places").mapInArrow(look, "class bigint, order bigint, slot bigint")
    kept = seen.groupBy("class").agg((F.min("order") == F.max("order")).alias("ordered"), (F.min("slot") == F.max("slot")).alias("nested"))
    valid = classes.join(kept, "class").join(root, "h").where(F.col("ordered") & ((F.col("class") == F.col("root")) | F.col("nested") | (F.col("n") >= FREE_SHARE * F.col("pages"))))
    return at.join(valid.select("class"), "class", "left_semi").groupBy("page_id").agg(F.collect_set("i").alias("template"))


def deduced(pages: DataFrame) -> tuple[DataFrame, int]:
    """(features, roles and template of every page with content, number of hosts)."""
    found = cut(features(pages.where("page_id is not null and content is not null")))
    tokens = cut(tokens_of(found))
    own = cut(by_host(tokens))
    hosts = own.select("h").distinct().count()
    wide = sorted(wide_tokens(own, hosts).items())
    found = with_roles(found, np.array([k for k, _ in wide], np.int64), np.array([r for _, r in wide], np.int32))
    template = F.coalesce("template", F.array().cast("array<int>")).alias("template")
    return found.join(host_template(tokens, own), "page_id", "left").select(*found.columns, template), hosts


def kept(line: list[int], flags: list[int], who: list[int], roles: list[int]) -> list[int]:
    """The numbers of the lines of a page's article; none where there is no article."""
    n = len(line)
    first = next((i for i in range(n) if not roles[i] and flags[i] & BODY), n)
    at = -1
    spots = [i for i in range(n) if flags[i] & TITLE]
    if spots:
        before = [i for i in spots if i < first]
        at = before[-1] if before else spots[0]
    elif first < n:
        k = first - 1
        while k >= 0 and roles[k]:
            k -= 1
        at = k if k >= 0 and not flags[k] & (ITEM | END) else first
    if at < 0:
        return []
    out, more, remarks = [at], False, False
    said = Counter(w for w in who if w)
    talk = {line[i] for i in range(n) if roles[i] == TALK}
    for i in range(at + 1, n):
        f = flags[i]
        if roles[i]:
            if roles[i] != DROP:
                remarks, more = roles[i] == TALK, roles[i] == MORE
            continue
        if f & CUT:
            continue
        if who[i]:
            near = f & AGO or any(j in talk for j in range(line[i] - 2, line[i] + 3))
            others = not f & SAYING and said[who[i]] < 2 and any(0 <= j < n and who[j] and who[j] != who[i] and abs(line[j] - line[i]) == 1 for j in (i - 1, i + 1))
            if near or remarks or others:
                continue
        elif remarks and not f & BODY:
            continue
        if more and not f & (BODY | BRACKET | QUOTE):
            continue
        more = False
        out.append(i)
    body = [i for i in out if flags[i] & BODY]
    if not body:
        return []
    # After the last paragraph, only items, references and rows of values are the article's.
    last = max([body[-1], *(i for i in out if i > body[-1] and flags[i] & (ITEM | BRACKET | VALUE))])
    return [line[i] for i in out if i <= last]


# Pages without sentences ---------------------------------------------------------


def replicated(found: DataFrame, hosts: int) -> np.ndarray:
    """Bits of the phrases that are, outside of sentences, on a share of the hosts: a table of fixed size.

    What is collected are at most (phrases of a host, on average) / SPREAD_SHARE places of it.
    """
    size = 1 << TABLE_BITS

    def run(batches):
        for batch in batches:
            b = _Batch(batch)
            line, _, g, inside = _phrases(b, b.own(b.roles(False)) & (b.flags & LOOSE > 0))
            alone = np.r_[True, line[1:] != line[:-1]] & ~inside if len(line) else inside
            keep = inside | alone
            h = b.c["h"].to_numpy()[b.page[line[keep]]]
            pairs = np.unique(np.c_[g[keep], h], axis=0) if keep.any() else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["g", "h"])

    spread = found.select("h", "line", "flags", "n_words", "words", "template").mapInArrow(run, "g bigint, h bigint").distinct().groupBy("g").count()
    many = spread.where(F.col("count") >= max(SPREAD_HOSTS, SPREAD_SHARE * hosts)).select(F.col("g").bitwiseAND(F.lit(size - 1)).cast("int").alias("at"))
    bits = np.zeros(size, bool)
    bits[many.toArrow()["at"].to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def evidence(b: _Batch, bits: np.ndarray) -> np.ndarray:
    """Of each page's own text: share outside of sentences; of that, words in replicated phrases, lines that are links, lines that have the commonest word; lines outside; bytes."""
    own = b.own(b.roles(False))
    # What stands in articles outside of sentences is no evidence: items, captions, numbered references, quotations. Other links are, whatever their mark.
    f = b.flags & (ITEM | BRACKET | LINK)
    marked = (f == ITEM) | (f == BRACKET) | (f & (ITEM | BRACKET) == ITEM | BRACKET) | (b.flags & QUOTE > 0)
    loose = own & (b.flags & LOOSE > 0) & ~marked
    size = b.flat("size").astype(np.float64)
    line, w, g, inside = _phrases(b, loose)
    at = g & ((1 << TABLE_BITS) - 1)
    hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    alone = np.r_[True, line[1:] != line[:-1]] & ~inside if len(line) else inside
    hit &= inside | alone
    covered = hit | np.r_[False, (hit & inside)[:-1]] if len(hit) else hit
    n = np.bincount(line, minlength=len(size))
    share = np.bincount(line, weights=covered, minlength=len(size)) / np.maximum(n, 1)
    whole = np.bincount(b.page, weights=size * own, minlength=b.pages)
    outside = np.bincount(b.page, weights=size * loose, minlength=b.pages)
    lines = np.bincount(b.page, weights=loose, minlength=b.pages)
    links = np.bincount(b.page, weights=loose & (b.flags & LINK > 0), minlength=b.pages)
    copied = np.bincount(b.page, weights=size * loose * share, minlength=b.pages)
    once = np.unique(line << 31 | w) if len(line) else line
    of, count = np.unique(b.page[once >> 31] << 31 | once & ((1 << 31) - 1), return_counts=True) if len(once) else (once, once)
    top = np.zeros(b.pages)
    np.maximum.at(top, of >> 31, count)
    return np.c_[outside / np.maximum(whole, 1), copied / np.maximum(outside, 1), links / np.maximum(lines, 1), top / np.maximum(lines, 1), lines, whole]


def is_spam(e: np.ndarray) -> np.ndarray:
    outside, copied, links, top, n, size = e.T
    return (outside >= OUTSIDE) & ((n >= LEAST_LINES) | (size >= LEAST_BYTES)) & ((copied >= COPIED) | (links >= LINKED) | (top >= REPEATED))


def _judged(pages: DataFrame):
    """(features of every page, bits of replicated phrases as a broadcast)."""
    found, hosts = deduced(pages)
    found = cut(found)
    return found, found.sparkSession.sparkContext.broadcast(replicated(found, hosts))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, line_no of every line of every article. Null, empty and blank contents, spam and notices have none; rows that come twice count once."""
    found, bits = _judged(pages)

    def run(batches):
        for batch in batches:
            b, ids, numbers = _Batch(batch), [], []
            spam = is_spam(evidence(b, bits.value))
            pages_, line, flags, who, roles = b.c["page_id"].to_pylist(), b.line.tolist(), b.flags.tolist(), b.flat("who").tolist(), b.roles(True).tolist()
            for p in np.flatnonzero(~spam).tolist():
                s, e = b.start[p], b.start[p + 1]
                got = kept(line[s:e], flags[s:e], who[s:e], roles[s:e])
                ids += [pages_[p]] * len(got)
                numbers += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])

    return found.mapInArrow(run, "page_id bigint, line_no int").distinct()


def spam_pages(pages: DataFrame) -> DataFrame:
    """page_id of the pages of repeated keywords, lists of links or titles, product rows or tags."""
    found, bits = _judged(pages)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(is_spam(evidence(_Batch(batch), bits.value))))], names=["page_id"])

    return found.select("page_id", "line", "flags", "size", "n_words", "words", "template").mapInArrow(run, "page_id bigint").distinct()
