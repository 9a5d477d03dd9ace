"""The operators on texts for training, against references and written cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe, encoding, mixing, pages, sentences

RANKS = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")

TEXTS = ["Hello world, it's 3.14!", "  leading\tand\r\n\r\nblank  ", "机器学习とカタカナ処理、한국어", "👩‍🔬🏗️ emoji é é", "<|endoftext|> is text", "x" * 5000, "हिन्दी عربي ไทย", " ", "\n\n", "a b　c"]


@needs_tokenizer
def test_encoder_is_the_tokenizer(spark):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x250), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x3040, 0x30FF)])) for _ in range(80)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "twice"), (902, "twice")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string")
    got = bpe.encode(df).collect()
    assert len(got) == len(rows)
    want = {i: ref.encode_ordinary(t) if t else [] for i, t in rows}
    assert all(r.ids == want[r.doc_id] for r in got)
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in want.items()}
    assert bpe.encode(df.where("false")).count() == 0


@needs_tokenizer
def test_perfect_hash_is_minimal():
    ranks = bpe.read_ranks(RANKS)
    table = bpe.PerfectHash(ranks)
    assert len(table.keys) == len(ranks) and all(table.find(k) == v for k, v in ranks.items())
    assert table.find(b"\x00never there\x00") == -1


@needs_tokenizer
def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 60)), ["big", "Small ", "mid", None, "other"][min(4, rng.choice([0] * 8 + [1] + [2] * 3 + [3, 4]))]) for i in range(3000)]
    rows += [(5000, None, "big"), (5001, "", "big"), rows[0]]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, source string, copies double")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("MID", 0.3, 2), ("none", 0.0, 2), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(docs, targets)
    got = {r.source: r for r in shares.collect()}
    assert got["absent"].drawn_tokens == 0 and got["big"].most_repeats <= 1 and got["small"].most_repeats <= 3
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    whole = sum(r.tokens for r in got.values())
    for r in got.values():  # the target, or what the cap leaves of it, up to one document
        assert abs(r.drawn_tokens - min(r.max_repeats * r.tokens, r.target_share / 1.1 * whole)) <= 120
        assert abs(r.shortfall - max(0, r.target_share / 1.1 * whole - r.drawn_tokens)) < 1e-6
    exact = {r.source: r for r in mixing.mix(docs, targets, keep_targets=True)[1].collect()}
    for name, share in (("big", 0.5), ("small", 0.2), ("mid", 0.3)):  # all that have documents keep their shares
        assert abs(exact[name].actual_share - share) < 0.002 and exact[name].shortfall <= 60
    again = {r.doc_id: r.repeats for r in mixing.mix(docs.repartition(7), targets)[0].collect()}
    assert again == {r.doc_id: r.repeats for r in drawn.collect()}  # the draw doesn't hang on partitions
    assert mixing.mix(docs.where("false"), targets)[0].count() == 0


def test_pivot_keeps_tokens():
    rng = random.Random(2)
    size = [rng.randint(1, 500) for _ in range(999)]
    part = [rng.random() for _ in size]
    x, left = mixing.pivot(list(range(999)), size, part, 7)
    assert sum(0 < v < 1 for v in x) <= 1
    assert sum(a * b for a, b in zip(x, size)) == pytest.approx(sum(a * b for a, b in zip(part, size)))


CASES = [
    "Dr. Smith met Mrs. Jones at No. 5 Main St. near the mill.|It was 7 p.m.|Nobody knew.",
    "“Did it hold?” asked Tom before leaving.|Yes.",
    "He said: “It is old. It leaks.”|Then he left.",
    "The file a.v2.md costs 3.5 percent, i.e. more than v7.7.1 had said.|See https://a.example/b.c/index.html now.",
    "Wait... the mill runs.|Wait...|The mill stopped.",
    "# A title. With a stop\n|\nText one.|Text two",
    "- first item\n|- second item.\n|\nAfter the list.",
    "这座桥撑得住吗？|是的。",
    "“这座桥真的撑得住吗？”白石问道。|后来，他走了。",
    "等一下……桥不是早就废弃了吗？！|没有。",
    "「温室は大丈夫ですか。」と菊は尋ねた。|速くなった（丹調べ。）とのことだ。",
    "«Где мост?» — спросил Иван.|Без неё он не смог бы.",
    "Am 7. Mai 1975 kam Dr. Bau, d. h. die Leitung.|„Hält sie?“, fragte Eva.",
    "« La digue tient-elle ? » demanda Luc.|L’art. 9 al. 7 vise la pompe.",
    "डॉ. राम ने 10.4 प्रतिशत बताया।|“बाग कहाँ है?” उसने पूछा।",
    "قال د. كريم إن النسبة بلغت 5.2 في المئة.|وصل زائر!",
    "เขาขายบ้านหลังใหญ่ที่เมืองนี้|เขาจ่าย 192 บาทเพื่อซ่อมบ้าน",
    "Prof. May (b. 1951) left it to the U.K. trust… or so it seemed.|Done.",
    "The box holds nails, twine, etc.|The log ends.",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    parts = case.split("|")
    text, want, at = "", [], 0
    for p in parts:
        sep = "" if not text or text[-1].isspace() or ord(text[-1]) in (0x3002, 0xFF1F, 0xFF01) else " "
        text += sep + p
        want.append(len(text.rstrip()))
    own, got = sentences.ends([text])
    assert list(got) == want, [text[a:b] for a, b in zip([0, *got], got)]


def test_sentences_of_tables(spark):
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, " \n "), (5, "x. " * 40_000), (1, "One. Two.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, sent_end int")
    got = {r.doc_id: r["count"] for r in sentences.sentence_ends(df).groupBy("doc_id").count().collect()}
    assert set(got) == {1, 5} and got[1] == 4
    assert sentences.sentence_ends(df.where("false")).count() == 0


def test_transducer_in_chunks_is_the_sequential_one():
    import numpy as np

    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 5, 5000).astype(np.int8)
    state, want = 0, []
    for s in symbols:
        want.append(state)
        state = int(sentences._NEXT[s, state])
    assert (sentences.transduce(symbols) == np.array(want)).all()


def test_encoding_repair(spark):
    zh = ["据说真正决定未来的不是博物馆，而是磨坊。", "第二座栈桥由工匠重漆，每天能输送水。", "没有图书馆就无法修复桥梁与档案。"]
    fr = ["La forge légère a été prêtée à l’école — déjà réparée.", "Où étaient les élèves près de la fenêtre ?"]
    ja = ["新しい図書館がなければ、織機は修理できなかった。", "古い倉庫の目録は本当に重要だという。"]
    rows = [(i, (zh + fr + ja)[i % 7], None) for i in range(140)]
    bad = {
        1001: zh[0].encode("utf-8").decode("gbk", "replace"), 1002: zh[1].encode("gbk").decode("latin-1"), 1003: fr[0].encode("utf-8").decode("cp1252", "replace"),
        1004: ja[0].encode("cp932").decode("gbk", "replace"), 1005: fr[1].encode("latin-1").decode("utf-8", "replace"), 1006: "clean line\n" + fr[1].encode("utf-8").decode("latin-1"),
    }
    rows += [(k, v, None) for k, v in bad.items()]
    rows += [(2001, "Old exports show “cafÃ©” where the menu said café, and Tom keeps one page of such samples.", None), (2002, None, None), (2003, "", ""), (2004, "fine", zh[2].encode("utf-8").decode("gbk", "replace")), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, content string, title string, field string")
    got = {(r.page_id, r.field): r.restored for r in encoding.repair(df).collect()}
    assert {k for k, f in got if f == "content"} == set(bad)
    assert [k for k, f in got if f == "title"] == [2004]
    assert got[1002, "content"] == zh[1] and got[1004, "content"] == ja[0] and fr[1] in got[1006, "content"]
    assert encoding.repair(df.where("false")).count() == 0


def test_short_titles_are_found_at_every_size(spark):
    words = ["Bücherei", "Küferei", "Gießerei", "señal", "quesería", "destilería", "écluse", "fenêtre", "Böschung", "Sägerei"]
    through = [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("gbk", "utf-8")]
    planted, spoilt = [], 0
    for i, w in enumerate(words):
        for j, (read, written) in enumerate(through):
            try:
                planted.append((10_000 + 10 * i + j, "plain text", f"The {w} of Nor{i}".encode(written).decode(read)))
            except UnicodeDecodeError:
                spoilt += 1
    assert len(planted) > 25
    found = {}
    for size in (400, 4000):
        clean = [(i, f"Die {words[i % 10]} von Ort {i} — la {words[i * 7 % 10]} número {i} wurde geprüft.", f"Über {words[i % 10]}") for i in range(size)]
        df = spark.createDataFrame(clean + planted * (size // 400), "page_id bigint, content string, title string")
        got = {(r.page_id, r.field) for r in encoding.repair(df).collect()}
        assert all(p >= 10_000 for p, _ in got)
        found[size] = {p for p, _ in got}
    assert found[400] == found[4000] and len(found[400]) >= 0.95 * len(planted)


ARTICLE = ["The mill of Ardel", "When the council opened the mill, the loom inside had already been moved to the harbour.", "Each loom costs about 71 crowns, while a copper boiler from Tormab is sold for 330.", "The old pump", "Critics say that the pump should be cleaned before the winter comes again."]


def test_pages(spark):
    rows = []
    for i in range(6):
        word = ["amber", "birch", "cedar", "dune", "elm", "fjord"][i]
        body = [f"{ARTICLE[0]} {word}", "Published May 7, 2011 · 4 min read"] + [f"{s[:-1]} of {word}." if s.endswith(".") else f"{s} {word}" for s in ARTICLE[1:]]
        content = "\n".join(["Home | News | Contact | Search", "", *body, "Popular this week", "How the depot was lent", "© 2010 Stagor Media. All rights reserved.", "Back to top ↑"])
        rows.append((i, "stagor.example", body[0], content))
    spam = "\n".join(f"cheap kettle {w} order {i}" for i, w in enumerate(["boiler", "mill", "loom", "pump", "press", "canal", "dyke", "depot", "ferry", "jetty"]))
    cloud = " ".join(f"#{w} {w} order" for w in ["boiler", "mill", "loom", "pump", "press", "canal", "dyke", "depot"] * 3)
    rows += [(54, "cloud.example", "tags", cloud)]
    rows += [(50, "spam.example", "kettle best cheap", spam), (51, "n.example", "T", "Home | News\n© 2001 N\nBack to top ↑"), (52, "e.example", None, None), (53, "e.example", None, ""), rows[0]]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id bigint, host string, title string, content string, line_no int")
    assert {r.page_id for r in pages.spam_pages(df).collect()} == {50, 54}
    got = {}
    for r in pages.articles(df).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    assert set(got) == set(range(6)) and all(sorted(v) == [2, 4, 5, 6, 7] for v in got.values())
    assert pages.articles(df.where("false")).count() == 0


def test_what_stands_in_articles_is_no_spam(spark):
    """Captions, items, references and garbled paragraphs count for nothing; links do, whatever their mark."""
    names = ["mill", "kiln", "dock", "loom", "weir", "pump", "tram", "quay"]
    word = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731 - numbers are masked
    name = lambda n: f"{names[n % 8]} and {names[n // 8 % 8]}"
    rows = []
    for i in range(24):
        links = [f"{'-»'[j % 2]} https://{word(i)}{word(j)}.example/{word(i * j)}" for j in range(20)]
        body = f"The {names[i % 8]} of {word(i)}q was rebuilt in the end, as its owner said to visitors."
        lines = [f"[Photo] Notes from {word(i)}s: {name(i)}", *(f"- How the {name(i + j)} was cleaned in {word(i)}u{word(j)}" for j in range(7)), *(f"[{j}] Why the {name(3 * i + j)} was closed in {word(i)}t{word(j)}, https://{word(i)}.example/{word(j)}" for j in range(1, 6))]
        garbled = ["".join(chr(0x4E00 + (7 * i + 31 * j + 97 * k) % 4000) for k in range(40)) + "。" + "水车磨坊" * 2 for j in range(6)]
        rows += [(3 * i, f"h{i}.test", f"r{word(i)}", "\n".join([f"r{word(i)}", body, *lines])), (3 * i + 1, f"h{i}.test", f"s{word(i)}", "\n".join([f"s{word(i)}", *links])), (3 * i + 2, f"h{i}.test", f"g{word(i)}", "\n".join(x.encode().decode("latin-1") for x in garbled))]
    df = spark.createDataFrame(rows, "page_id bigint, host string, title string, content string")
    assert {r.page_id for r in pages.spam_pages(df).collect()} == {3 * i + 1 for i in range(24)}
