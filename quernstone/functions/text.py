"""Column functions on text: lengths, cleaning, hashes, tokens, set measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own.
STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 吗 呢 吧 啊 哦 嗯 把 被 让 给 从 向 往 对 比 跟 那 哪 什么 怎么 为什么 谁 怎样 如何 可以 能 可能 应该 需要 已经 正在 还是 但是 而且 因为 所以 如果 虽然 然后 或者 "
    "the a an and or but in on at to for of with by from is are was were be been it its this that these those they we he she his her our your their has have had do does"
).split()
#: What counts as blank: the ASCII blanks and the Unicode ones.
BLANK = r"[\s\x0B   -     　﻿]"


def js_len(text: Column) -> Column:
    """Length in UTF-16 units: a sign beyond the basic plane counts twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def normalise_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def strip_image_noise(text: Column) -> Column:
    """Without inlined images, image marks and tags, and lines that only name an image."""
    kinds = "(?:jpg|jpeg|png|gif|webp|svg|bmp|ico)"
    return js_trim(
        replaced(
            text,
            [
                (r"(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+", ""),
                (r"!\[.*?\]\(.*?\)", ""),
                (r"(?i)<img[^>]*/?>", ""),
                *[(rf"(?i)<{t}[\s\S]*?</{t}>", "") for t in ("figure", "figcaption", "picture")],
                (rf"(?im)^https?://[^\s]+\.{kinds}(?:\?[^\s]*)?$", ""),
                (rf"(?im)^[\w-]+\.{kinds}\s*$", ""),
                (r"(?im)^图(?:片)?\s*$", ""),
                (r"\n{3,}", "\n\n"),
            ],
        )
    )


def strip_markup(text: Column) -> Column:
    """Without code, tags, addresses, marks of links and counters of social sites."""
    return replaced(
        text,
        [
            (r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (r"<[^>]+>", " "), (r"https?://\S+", " "), (r"!\[([^\]]*)\]\([^)]+\)", "$1 "),
            (r"\[([^\]]*)\]\([^)]+\)", "$1 "), (r"&\w+;", " "), (r"(?:阅读|阅读数|点赞|在看|转发|收藏)\s*\d+", " "), (r"🎧\s*\d+人", " "),
        ],
    )


def strip_frontmatter(text: Column, loose: bool = False) -> Column:
    return F.regexp_replace(text, r"^---[\s\S]*?---\n*" if loose else r"^---\s*\n[\s\S]*?\n---\s*(?:\n|$)", "")


def title_of(text: Column, stem: Column) -> Column:
    """The title a note names itself, else its first heading, else its first line, else the file's stem."""
    front = F.regexp_extract(F.regexp_extract(text, r"^---\s*\n([\s\S]*?)\n---", 1), r"(?m)^title:[ \t]*[\"']?(.+?)[\"']?[ \t]*$", 1)
    body = strip_frontmatter(text)
    heading = F.regexp_extract(body, r"(?m)^# +(.+)$", 1)
    line = F.regexp_extract(body, r"(?m)^[ \t\r]*(\S.*)$", 1)
    whole = lambda c: F.when(js_trim(c) != "", js_trim(c))
    return F.coalesce(whole(front), whole(heading), whole(line), stem)


def hash32(text: Column) -> Column:
    """The 32-bit content hash, as eight hexadecimal signs.

    Each step takes its 32 bits as a signed number, and rounds the product to a
    double before it is cut to 32 bits.
    """
    units = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)))
    two32 = F.lit(4294967296.0)

    def step(h: Column, u: Column) -> Column:
        x = h.bitwiseXOR(u.cast("bigint"))
        product = (x - F.when(x >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0))).cast("double") * F.lit(16777619.0)
        return (product - F.floor(product / two32).cast("double") * two32).cast("bigint")

    folded = F.aggregate(F.filter(units, lambda u: u > 0), F.lit(2166136261).cast("bigint"), step)
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def latin_tokens(text: Column) -> Column:
    """Tokens of the parts without CJK signs, in order, with repeats: two signs at least, no stop words."""
    runs = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s一-鿿]", " "), r"\s+")
    return F.filter(runs, lambda w: (F.length(w) > 1) & ~w.rlike("[一-鿿]") & ~w.isin(STOP_WORDS))


def tokens(text: Column, n: int = 3) -> Column:
    """Tokens in order, with repeats: words as they are, runs with CJK signs as all pieces of ``n`` signs.

    A run shorter than ``n`` gives its pieces of two.
    """
    runs = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s一-鿿]", " "), r"\s+"), lambda w: F.length(w) > 1)

    def pieces(w: Column) -> Column:
        size = F.when(F.length(w) < n, F.lit(2)).otherwise(F.lit(n))
        return F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, size))

    return F.flatten(F.transform(runs, lambda w: F.when(w.rlike("[一-鿿]"), pieces(w)).when(w.isin(STOP_WORDS), F.array().cast("array<string>")).otherwise(F.array(w))))


def jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def edit_similarity(x: Column, y: Column) -> Column:
    most = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / most)


def in_folder(path: Column, folder: str) -> Column:
    """Whether the path is the folder or within it; no path is within an empty folder."""
    bare = folder.rstrip("/")
    return F.lit(False) if not bare else (path == bare) | path.startswith(bare + "/")


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def safe_file_name(title: Column, most: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|#^\[\]]', "-"), r"\s+", " ")), 1, most)


def yaml_value(value: Column) -> Column:
    quoted = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    lined = F.regexp_replace(F.regexp_replace(quoted, "\n", r"\\n"), "\r", r"\\r")
    return F.when(value.rlike(r"[\n\r]"), F.concat(F.lit('"'), lined, F.lit('"'))).when(value.rlike(r"[:\[\]{}#&*!|>'\"%@`,?\\]"), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(value)
