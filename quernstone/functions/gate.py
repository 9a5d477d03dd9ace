"""Quality rules as columns: each gives ok, warn or block for a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import js_len

#: Words of advertising and of headlines that overpromise.
SPAM = ["点击这里", "立即购买", "限时优惠", "抢购", "广告", "推广", "赞助", "点击链接", "buy now", "click here", "limited offer", "special offer", "order now", "shop now", "save big", "best price", "free trial", "sign up now", "subscribe now", "100% free", "no credit card", "act now"]
BAIT = ["你绝对想不到", "惊呆了", "炸裂", "you won't believe", "shocking", "amazing trick", "this one weird trick", "doctors hate", "they don't want you to know"]
AD_PATTERNS = [r"限[时期限].{0,3}[优特惠抢]", r"点击.{0,3}(?:这里|链接|进入)", r"(?:🔥|💰|🎁|👉).{0,5}(?:优惠|抢购|福利|免费)", r"(?i)(?:100%|FREE|LIMITED).{0,10}(?:trial|offer|time)"]
#: Markup left in a text, and signs of wrong decoding.
MARKUP = [r"(?i)<[a-z][a-z0-9]*\s[^>]*>", r"(?i)</[a-z][a-z0-9]*>", r"(?i)<(?:script|style|iframe|object|embed)[^>]*>", r"(?i)&[a-z]{2,8};", r"&#[0-9]{2,5};"]
GARBLED = ["锟斤拷", "烫烫烫", "屯屯屯", "(?:[ÂÃÄÅÆÇÈÉÊËÌÍÎÏ]){3,}", "�{3,}"]
LINKS = [r"https?://\S+", r"www\.\S+\.\S+"]
NAVIGATION = r"\s*[|·•»›▸→]\s*"
#: The signs that are no noise, as a class.
PLAIN = r"\x20-\xffĀ-ɏЀ-ӿͰ-Ͽ؀-ۿऀ-ॿ฀-๿一-鿿㐀-䶿\x{20000}-\x{2a6df}぀-ヿ가-힯\t\n\r -⁯　-〿＀-￯\x{1f300}-\x{1f9ff}\x{1fa00}-\x{1fa6f}\x{1f1e6}-\x{1f1ff}∀-⋿─-╿︀-️"

#: Thresholds by profile.
PROFILES = {
    "dense": {"length": (50, 150, 100000, 50000), "quality": (2, 1), "html": (5, 2), "mojibake": (3, 1), "link": (0.55, 1.5, 1.0), "stuffing": (5, 3, 300, 8, 8), "density": (0.15, 0.5), "noise": (0.75, 0.45)},
    "balanced": {"length": (80, 300, 50000, 20000), "quality": (3, 1), "html": (5, 2), "mojibake": (3, 1), "link": (0.40, 1.0, 0.5), "stuffing": (3, 1.5, 200, 5, 5), "density": (0.15, 0.5), "noise": (0.70, 0.40)},
    "sparse": {"length": (30, 100, 20000, 10000), "quality": (5, 2), "html": (5, 2), "mojibake": (3, 1), "link": (0.35, 0.8, 0.4), "stuffing": (2, 1, 150, 3, 5), "density": (0.15, 0.5), "noise": (0.65, 0.35)},
}


def length_factor(text: Column) -> Column:
    return F.greatest(F.lit(1.0), F.log10(js_len(text) + 10))


def _status(block: Column, warn: Column) -> Column:
    return F.when(block, "block").when(warn, "warn").otherwise("ok")


def count_all(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))


def length_status(text: Column, rules: dict, selection: Column | None = None) -> Column:
    """A selection needs six tenths of the length, 20 and 40 signs at least."""
    least, few, most, many = rules["length"]
    low, high = F.lit(least), F.lit(few)
    if selection is not None:
        low = F.when(selection, max(20, int(least * 0.6))).otherwise(least)
        high = F.when(selection, max(40, int(few * 0.6))).otherwise(few)
    n = js_len(text)
    return F.when(n < low, "block").when(F.lit(most > 0) & (n > most), "block").when(n < high, "warn").when(n > many, "warn").otherwise("ok")


def spam_signals(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in SPAM + BAIT), F.lit(0)) + count_all(text, AD_PATTERNS)


def scaled(hits: Column, factor: Column, most: tuple, by: tuple[float, float]) -> Column:
    """Blocked and warned by thresholds that grow with the length."""
    block, warn = (F.greatest(F.lit(t), F.floor(F.lit(t * b) * factor)) for t, b in zip(most, by))
    return _status(hits >= block, hits >= warn)


def quality_status(text: Column, rules: dict) -> Column:
    return scaled(spam_signals(text), length_factor(text), rules["quality"], (0.6, 0.5))


def html_status(text: Column, rules: dict) -> Column:
    return scaled(count_all(text, MARKUP), length_factor(text), rules["html"], (0.7, 0.6))


def mojibake_status(text: Column, rules: dict) -> Column:
    return scaled(count_all(text, GARBLED), length_factor(text), rules["mojibake"], (0.7, 0.6))


def link_status(text: Column, rules: dict) -> Column:
    ratio, density, few = rules["link"]
    n = js_len(text)
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in LINKS])
    count, signs = F.size(found), F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
    warn = F.greatest(F.lit(0.3), F.lit(few) * F.least(F.lit(1.5), 1 + (length_factor(text) - 1) * 0.3))
    per = count / (n / 100)
    return F.when(n < 100, "ok").when((signs / n > ratio) & (count >= 5) & (per > density), "block").when(F.regexp_count(text, F.lit(NAVIGATION)) >= 5, "warn").when((per > warn) & (count >= 5), "warn").otherwise("ok")


def stuffing_status(n: Column, factor: Column, distinct: Column, top: Column, rules: dict) -> Column:
    """``top``: the greatest frequencies. Uses a hundred signs that block or warn grow with the length."""
    block, warn, least, few, most = rules["stuffing"]
    scale = F.least(F.lit(2.0), 1 + (factor - 1) * 0.5)
    rates = F.transform(F.filter(F.slice(top, 1, most), lambda x: x >= few), lambda x: x / (F.greatest(n, F.lit(1)) / 100))
    high = F.array_max(rates)
    status = F.when(high >= block * scale, "block").when(high >= warn * scale, "warn").otherwise("ok")
    return F.when((n < least) | (distinct < 10), "ok").otherwise(status)


def density_status(total: Column, distinct: Column, rules: dict) -> Column:
    least, few = rules["density"]
    by = 1 / F.sqrt(F.log10(total + 10))
    share = distinct / total
    return F.when(total < 20, "ok").when(share < least * F.greatest(F.lit(0.3), by), "block").when(share < few * F.greatest(F.lit(0.5), by), "warn").otherwise("ok")


def noise_status(text: Column, rules: dict) -> Column:
    most, few = rules["noise"]
    share = F.length(F.regexp_replace(text, f"[{PLAIN}]", "")) / js_len(text)
    return F.when(js_len(text) < 50, "ok").when(share > most, "block").when(share > few, "warn").otherwise("ok")


#: The rules in their order: cheap ones always run, the others only where none of these blocks.
CHEAP = ["length", "quality", "html", "mojibake", "link"]
DEAR = ["stuffing", "density", "noise"]


def by_profile(profile: Column, status) -> Column:
    """``status(rules)`` by the profile of each row; unknown and null profiles are balanced."""
    out = status(PROFILES["balanced"])
    for name in ("dense", "sparse"):
        out = F.when(profile == name, status(PROFILES[name])).otherwise(out)
    return out


def cheap_statuses(text: Column, profile: Column, selection: Column) -> list[Column]:
    rules = [lambda r: length_status(text, r, selection), lambda r: quality_status(text, r), lambda r: html_status(text, r), lambda r: mojibake_status(text, r), lambda r: link_status(text, r)]
    return [by_profile(profile, r) for r in rules]


def most_warnings(text: Column) -> Column:
    """Warnings from which a text is stopped: more of a long text."""
    return F.least(F.lit(6), F.greatest(F.lit(3), F.floor(1.8 * length_factor(text))))


def verdict(statuses: Column, most: Column) -> Column:
    """passed, blocks, warnings, summary by ``statuses`` (an array in the order of CHEAP and DEAR).

    Enough warnings without a block count as the block "total". The summary is
    the first block, with the number of others.
    """
    names = F.array(*[F.lit(x) for x in CHEAP + DEAR])
    of = lambda s: F.transform(F.filter(F.arrays_zip(names.alias("rule"), statuses.alias("status")), lambda r: r["status"] == s), lambda r: r["rule"])
    warned = of("warn")
    blocks = F.when((F.size(of("block")) == 0) & (F.size(warned) >= most), F.array(F.lit("total"))).otherwise(of("block"))
    others = F.when(F.size(blocks) > 1, F.concat(F.lit(" +"), (F.size(blocks) - 1).cast("string"))).otherwise("")
    return F.struct(
        (F.size(blocks) == 0).alias("passed"), F.array_join(blocks, ",").alias("blocks"), F.array_join(warned, ",").alias("warnings"),
        F.when(F.size(blocks) == 0, "").otherwise(F.concat(F.get(blocks, F.lit(0)), others)).alias("summary"),
    )
