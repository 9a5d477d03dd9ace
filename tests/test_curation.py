"""Operators of the curation library on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import claims as C
from quernstone.functions import gate as G
from quernstone.functions import review as R
from quernstone.functions import text as T
from quernstone.functions.model_output import parse_notes
from quernstone.functions.segment import Segmenter, bags
from quernstone.operators import corpus as O
from quernstone.plans.curation import QUERIES, SQL
from quernstone.sources.chunks import chunked, cut_places
from quernstone.sources.html import extract, read_html
from quernstone.streaming.feeds import KeptTable, debounced, document_counts, expired, merged, renames


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "a😀b", T.js_len) == 4
    for text, h in (("", "811c9dc5"), ("a", "e40c292c"), ("abc", "1a47e90c"), ("hello world", "cad44818")):
        assert one(spark, text, T.hash32) == h
    assert one(spark, "x\n![a](b.png)\nhttps://e.org/a.jpg\n图\n\n\n\ny", T.strip_image_noise) == "x\n\ny"
    assert one(spark, '---\ntitle: "Mine"\n---\n# Other\n', lambda c: T.title_of(c, F.lit("s"))) == "Mine"
    assert one(spark, "file/name:test*file", T.safe_file_name) == "file-name-test-file"
    assert one(spark, 'a: "b"', T.yaml_value) == '"a: \\"b\\""'
    assert one(spark, None, T.js_len) is None


def test_tokens(spark):
    assert one(spark, "the machine is learning", T.tokens) == ["machine", "learning"]
    assert one(spark, "机器学习算法", T.tokens) == ["机器学", "器学习", "学习算", "习算法"]
    assert one(spark, "测试", T.tokens) == ["测试"]
    assert one(spark, "für é x9 学", T.tokens) == ["x9"]
    assert one(spark, "", T.tokens) == []


def test_segmenter(spark):
    seg = Segmenter({"数据": 100, "分析": 100, "挖掘": 50, "与": 500, "数": 10})
    assert seg.words("数据分析与数据挖掘") == ["数据", "分析", "与", "数据", "挖掘"]
    assert seg.bag("数据分析与数据挖掘")["W:数据"] == 2
    df = spark.createDataFrame([(1, "数据 ab"), (2, None), (3, "")], "id int, t string")
    assert {(r.id, r.token) for r in bags(df, "id", "t", {"数据": 5}).collect()} == {(1, "W:数据"), (1, "数据"), (1, "ab")}


def test_gate(spark):
    rules = G.PROFILES["balanced"]
    assert one(spark, "hi", lambda c: G.length_status(c, rules)) == "block"
    assert one(spark, "锟斤拷" * 4, lambda c: G.mojibake_status(c, rules)) == "block"
    assert one(spark, "buy now click here free trial", lambda c: G.quality_status(c, rules)) == "block"
    assert one(spark, ("see https://a.org/x1 " * 10), lambda c: G.link_status(c, rules)) == "block"
    assert one(spark, "a" * 30 + "\x01" * 500, lambda c: G.noise_status(c, rules)) == "block"
    assert one(spark, "∑∀ 数学 😀 text " * 10, lambda c: G.noise_status(c, rules)) == "ok"


def test_claims(spark):
    found = one(spark, "市场份额占比约30%，同比增长23%。营收150亿元。", C.claims)
    assert [c.anchor for c in found] == ["约30%", "23%", "150亿元"]
    rows = [("102万元", "numeric", "去年。共100万元，增长！后文"), ("999万元", "numeric", "共100万元"), ("清华大学计算机系", "entity", "清华大学计算科学中心"), ("30%", "numeric", None), ("100万元", "numeric", "前文。共100万元。"), ("0.5个", "numeric", "0 and 0.51 and 0.5000")]
    df = spark.createDataFrame(rows, "a string, k string, s string")
    got = [tuple(r[0]) for r in df.select(C.traced(F.col("a"), F.col("k"), F.col("s"))).collect()]
    assert got[0] == ("traced", "共100万元，增长！", "100") and got[1] == ("out of scope", None, None)
    assert got[2] == ("compare", "清华大学计算科学中心", "清华大学计") and got[3][0] == "out of scope"
    assert got[4] == ("traced", "共100万元。", None) and got[5][0] == "traced" and got[5][2] == "0.51"  # the first that is near


def test_second_look_at_claims(spark):
    c = spark.createDataFrame([("n", 1, "traced", "s", None, "the mill stood"), ("n", 2, "out of scope", None, None, "the mill stood"), ("n", 3, "out of scope", None, None, "the mill stood"), ("m", 1, "out of scope", None, None, "x")], "note_id string, pos int, status string, sentence string, differs string, text string")
    said = 'Well: [{"index":0,"status":"compare","source_text":"the  mill"},{"index":1,"status":"traced","source_text":"no such words"}] so'
    answers = spark.createDataFrame([("n", said), ("m", "nothing [ to read")], "note_id string, answer string")
    got = {(r.note_id, r.pos): r.status for r in C.compared(c, answers).collect()}
    assert got == {("n", 1): "traced", ("n", 2): "compare", ("n", 3): "out of scope", ("m", 1): "out of scope"}
    assert C.compared(c.where("false"), answers).count() == 0


def test_review(spark):
    notes = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "batch_no int, pos int")
    said = '[{"index":1,"insight_score":9,"knowledge_score":1},{"index":1,"insight_score":2,"knowledge_score":2},{"index":2,"insight_score":2.5,"final_score":9.5},{"index":9,"insight_score":5}]'
    answers = spark.createDataFrame([(1, "ok " + said), (2, "no")], "batch_no int, answer string")
    got = {(r.batch_no, r.pos): (r.insight, r.knowledge, r.final, r.kept, r.place) for r in R.reviewed(notes, answers).collect()}
    assert got == {(1, 0): (2, 2, 4, False, None), (1, 1): (3, 3, 10, True, 1), (1, 2): (3, 3, 6, True, 2), (1, 3): (3, 3, 6, True, 3), (2, 0): (3, 3, 6, True, 1)}
    assert {r.batch_no: (r.kept, r.dropped) for r in R.stats(R.reviewed(notes, answers)).collect()} == {1: (3, 1), 2: (1, 0)}
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.7,), (None,)], "s double").select(R.band(F.col("s"))).collect()] == ["high", "mid", "plain"]


def test_corpus_matches(spark):
    text = "the old mill beside the river was rebuilt by two brothers in autumn and sold again later"
    new = spark.createDataFrame([("a", "the old mill", text), ("b", None, "nothing of that kind is here at all today"), ("c", "t", None), ("d", "", "")], "key string, title string, content string")
    bags = O.bag_lists(new.where("key = 'a'"), "key", "content")
    fp = O.simhash(bags, "key", "bag").first().fp
    bag = bags.first().bag
    rows = [("p/near", bag, [], [x.token for x in bag[:5]], len(text), 5, fp), ("p/long", bag, [], [x.token for x in bag[:5]], 3 * len(text), 5, fp), ("p/none", None, None, None, None, 5, 0)]
    held = spark.createDataFrame(rows, "path string, tokens array<struct<token:string,freq:int>>, title_tokens array<struct<token:string,freq:int>>, top_tokens array<string>, content_length int, title_len int, fp bigint")
    got = {r.key: r for r in O.corpus_matches(new, held).collect()}
    assert set(got) == {"a"} and got["a"].path == "p/near" and got["a"].similarity > 0.6
    meaning = spark.createDataFrame([("a", 0.1, "x"), ("b", 0.7, "y")], "key string, similarity double, path string")
    merged_ = {r.key: (r.path, r.semantic) for r in O.with_meaning(O.corpus_matches(new, held), meaning).collect()}
    assert merged_ == {"a": ("p/near", 0.1), "b": ("y", 0.7)}


def test_batch_duplicates(spark):
    base = "the climate report lists many reasons for change in the northern harbour towns and their old lighthouses near canals"
    rows = [(1, 1, "A", base + " again"), (1, 2, "B", "a wholly different note on cooking with lentils and fresh garden herbs in a copper pot tonight with friends"), (1, 3, "A", base + " again"), (2, 1, "A", base), (1, 4, None, None), (1, 5, "s", "tiny text"), (1, 6, "s", "tiny texts")]
    edges = O.batch_edges(spark.createDataFrame(rows, "batch_no int, doc_pos int, title string, content string"))
    assert {(r.batch_no, r.i, r.j) for r in edges.collect()} == {(1, 1, 3), (1, 5, 6)}


def test_greedy_survivors(spark):
    rng = random.Random(4)
    edges = {(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.04} | {(100, 101), (101, 102)}
    kept, want = [], {}
    for v in sorted({x for e in edges for x in e}):
        hit = [k for k in kept if (k, v) in edges]
        if hit:
            want[v] = min(hit)
        else:
            kept.append(v)
    got = O.greedy_survivors(spark.createDataFrame([(1, *e) for e in edges], "batch_no int, i int, j int"))
    assert {r.j: r.i for r in got.collect()} == want


def test_simhash_and_fingerprints(spark):
    df = spark.createDataFrame([(1, [("dominant", 10000), ("noise", 1)]), (2, [("dominant", 10000)]), (3, []), (4, None)], "id int, b array<struct<token:string,freq:int>>")
    fp = {r.id: r.fp for r in O.simhash(df, "id", "b").collect()}
    assert bin((fp[1] ^ fp[2]) & (2**64 - 1)).count("1") <= 1 and fp[3] == fp[4] == 0
    rng = random.Random(6)
    fps = [(i, rng.getrandbits(64) - 2**63) for i in range(100)]
    fps += [(i + 1000, f ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for i, f in fps[:40]]
    d = spark.createDataFrame(fps, "id bigint, fp bigint")
    want = {(a, b) for a, x in fps for b, y in fps if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= 2}
    assert {(r.id_x, r.id_y) for r in O.near_fingerprints(d, d).where("id_x < id_y").collect()} == want


def test_best_matches_in_blocks(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    assert {tuple(r) for r in O.best_matches(df, df, 0.5, block=4).collect()} == {tuple(r) for r in O.best_matches(df, df, 0.5).collect()}
    assert O.best_matches(df.where("false"), df).count() == 0


def test_mmr(spark):
    c = [("q", "a", 0.9, ["x", "y"]), ("q", "b", 0.89, ["x", "y"]), ("q", "c", 0.5, ["z"])]
    got = O.mmr(spark.createDataFrame(c, "query string, path string, similarity double, keywords array<string>"), 3).orderBy("rank").collect()
    assert [r.path for r in got] == ["a", "c", "b"]


def test_html(spark):
    body = "This is the body of the article. " * 6
    html = f"<html><head><title>T</title><meta name='date' content='2024-05-01'></head><body><nav>menu</nav><article><h1>Head</h1><div class='header'>kept</div><div class='ad-banner'>no</div><p aria-hidden='true'>no</p><p>{body}</p><img alt='pic'></article></body></html>"
    got = read_html(html)
    assert got["title"] == "Head" and "kept" in got["content"] and "menu" not in got["content"] and " no " not in got["content"] and got["content"].endswith("[图] pic") and got["publish_date"] == "2024-05-01"
    df = spark.createDataFrame([(1, html), (2, None), (3, '<meta http-equiv="Refresh" content="0;url=http://x.org">'), (4, "<p>short</p>")], "page_id int, html string")
    assert {r.page_id: r.error_code for r in extract(df, "page_id", "html").collect()} == {1: None, 2: "EMPTY_HTML", 3: "META_REFRESH", 4: "REQUIRES_JS"}
    deep = "<div>" * 5000 + body + "</div>" * 5000
    assert read_html(deep)["success"]


def test_chunks(spark):
    text = ("Sentence one is here. " * 30 + "\n\n") * 40
    places = cut_places(text, 3000)
    assert places[0][0] == 0 and places[-1][1] == len(text) and all(b[0] < a[1] for a, b in zip(places, places[1:]))
    assert cut_places("short", 1000) == [(0, 5)]
    got = chunked(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t", 3000).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: len(places), 3: 1}


def test_parse_notes():
    assert [n["title"] for n in parse_notes('{"notes":[{"title":"a","content":"b","tags":"x, y"}]}')] == ["a"]
    assert parse_notes('```json\n[{"title":"a } ","content":"b"}]\n```')[0]["title"] == "a }"
    assert parse_notes('{"notes": []}') == [] and parse_notes("无法提炼") == [] and parse_notes(None) == []
    assert parse_notes("---\ntitle: A\ntags: [x, y]\n---\nbody")[0] == {"title": "A", "content": "body", "tags": ["x", "y"], "source": None}
    assert [n["title"] for n in parse_notes("1. **One**\ntext\n2. **Two**\nmore")] == ["One", "Two"]


def test_feeds(spark):
    rows = [("p", 1, "a"), ("p", 3, "c"), ("q", 1, "x"), ("p", 2, "late")]
    df = spark.createDataFrame(rows, "path string, v bigint, c string")
    assert {tuple(r) for r in merged(None, df, "path", "v").collect()} == {("p", 3, "c"), ("q", 1, "x")}
    again = merged(merged(None, df, "path", "v"), df, "path", "v")
    assert again.count() == 2
    times = spark.createDataFrame([("p", "2024-01-01 00:00:00", 1), ("p", "2024-01-01 00:00:00.4", 2), ("p", "2024-01-01 00:00:05", 3)], "path string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n, r.changes) for r in debounced(times).collect()) == [(2, 2), (3, 1)]
    counts = document_counts(None, spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id int, token string"), spark.createDataFrame([(2, "b")], "id int, token string"))
    assert {tuple(r) for r in counts.collect()} == {("a", 2)}


def test_deletes_renames_and_replays(spark, tmp_path):
    shape = "path string, v bigint, op string, c string, old_path string"
    first = spark.createDataFrame([("a", 1, "create", "x", None), ("b", 1, "create", "y", None), ("d", 1, None, "z", None)], shape)
    second = spark.createDataFrame([("c", 2, "rename", "x", "a"), ("b", 3, "delete", None, None), ("b", 2, "modify", "late", None)], shape)
    rows = lambda t: {(r.path, r.c) for r in t.read().collect()}
    table = KeptTable(spark, "path", "v", str(tmp_path / "kept"), "op", buckets=4)
    table.apply(renames(first), 0)
    assert rows(table) == {("a", "x"), ("b", "y"), ("d", "z")}
    # Another session, and a batch that is run twice.
    again = KeptTable(spark, "path", "v", str(tmp_path / "kept"), "op", buckets=4)
    again.apply(renames(second), 1)
    again.apply(renames(second), 1)
    assert rows(again) == {("c", "x"), ("d", "z")} == rows(table)
    again.apply(renames(spark.createDataFrame([("b", 2, "modify", "later still", None)], shape)), 2)
    assert rows(again) == {("c", "x"), ("d", "z")}
    written = {p.name for p in (tmp_path / "kept" / "v2").glob("bucket=*")}
    assert len(written) == 1  # only the bucket that was touched
    # A version that was not finished doesn't count.
    (tmp_path / "kept" / "v1" / "_SUCCESS").unlink()
    assert ("a", "x") in rows(KeptTable(spark, "path", "v", str(tmp_path / "kept"), "op", buckets=4))


def test_streamed_table_goes_on_after_a_restart(spark, tmp_path):
    shape = "path string, v bigint, c string"
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], shape).coalesce(1).write.parquet(str(source))
    follow = lambda: KeptTable(spark, "path", "v", str(tmp_path / "kept")).follow(spark.readStream.schema(shape).parquet(str(source)))
    follow()
    spark.createDataFrame([("b", 2, "z")], shape).coalesce(1).write.mode("append").parquet(str(source))
    follow()
    assert {tuple(r) for r in KeptTable(spark, "path", "v", str(tmp_path / "kept")).read().select("path", "v", "c").collect()} == {("a", 1, "x"), ("b", 2, "z")}


def test_expired(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:50:00"), ("c", None)], "k string, t string").select("k", F.col("t").cast("timestamp").alias("cached_at"))
    assert {r.k for r in expired(df, "2024-01-01 01:00:00").collect()} == {"a", "c"}


def test_gate_as_a_whole(spark):
    stuffed = ("water " * 9 + "a quiet mill stands by some river near old houses with gardens and trees ") * 4
    fine = "The mill of the village was built by two brothers in autumn, and its wheel turned for a hundred years before anyone thought of selling the old house beside the weir to strangers from the coast. " * 2
    spam = "buy now! click here! limited offer, special offer. " * 3
    rows = [(1, stuffed, None), (2, fine, None), (3, spam + "�" * 60, None), (4, "short text " * 5, "selection"), (5, "short text " * 5, None), (6, None, None), (7, "", None)]
    df = spark.createDataFrame(rows, "id int, text string, hint string")
    got = {r.id: r for r in O.gated(df, "id", "text", "hint").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    assert got[1].blocks == "stuffing" and not got[1].passed and got[1].summary == "stuffing"
    assert got[2].passed and got[2].blocks == "" and got[2].summary == ""
    assert got[3].blocks.startswith("quality") and "noise" not in got[3].blocks + got[3].warnings
    assert got[4].passed and got[5].blocks == "length" and got[7].blocks == "length"
    sparse = df.withColumn("p", F.lit("sparse"))
    assert {r.id: r.blocks for r in O.gated(sparse, "id", "text", None, "p").collect()}[5] == ""
    assert O.gated(df.where("false"), "id", "text").count() == 0


def test_edit_similarity_of_titles(spark, tmp_path):
    from quernstone.plans.curation import o34_edit_similarity

    titles = ["Über den Fluss", "Uber den Fluss", "机器学习入门", "机器学习入门一", "", None, "x", "Über den Fluss!"]
    rows = [(i * 50, f"n{i}", t) for i, t in enumerate(titles)]
    spark.createDataFrame(rows + rows[:1], "doc_pos int, note_id string, title string").write.parquet(str(tmp_path / "notes.parquet"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = {(x, y) for p, x, a in rows for _, y, b in rows if a and b and x != y and p % 100 == 0 and 1 - edits(a, b) / max(len(a), len(b)) >= 0.7}
    assert {(r.x, r.y) for r in o34_edit_similarity(spark, str(tmp_path)).collect()} == want and len(want) == 3


def test_injected_calls(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id int, t string")
    assert O.run_injected(df, lambda xs: [x.upper() for x in xs], "t", "u", "string").where("u = upper(t)").count() == 40
    assert O.run_injected(df, lambda xs: 1 / 0, "t", "u", "string").where("u is null").count() == 40


def test_traced_sentence_starts_on_its_own_line(spark):
    df = spark.createDataFrame([("42%", "numeric", "the mill\n42% of them stood.\nEnd"), ("50%", "numeric", "a line\n49% \x85 left"), ("x", None, "x")], "a string, k string, s string")
    got = [tuple(r[0]) for r in df.select(C.traced(F.col("a"), F.col("k"), F.col("s"))).collect()]
    assert got[0] == ("traced", "42% of them stood.", None) and got[1] == ("traced", "49% \x85 left", "49")


def test_traced_runs_once_a_claim(spark):
    df = spark.createDataFrame([("42%", "numeric", "42%")], "a string, k string, s string").select(C.traced(F.col("a"), F.col("k"), F.col("s")).alias("t")).select("t.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("traced(") == 1


def test_related_pairs_are_not_shuffled(spark):
    draw = random.Random(5)
    rows = [(f"p{i}", draw.sample("abcdefghijklmnop", draw.randrange(0, 6))) for i in range(300)] + [("lone", None)]
    df = spark.createDataFrame(rows, "path string, keywords array<string>")
    asked = F.col("path").rlike("7$")
    want = {(q, p, len(set(a) & set(b)) / len(set(a) | set(b))) for q, a in rows for p, b in rows if q.endswith("7") and p != q and b and set(a) & set(b)}
    for block in (4, 16_384):
        got = O.related(df, asked, block)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert O.related(df, F.lit(False)).count() == 0


def test_recommended_rounds_are_made_where_a_query_lies(spark):
    """Picks are those of mmr over all related records, and no pair of records is written or shuffled."""
    draw = random.Random(8)
    rows = [(f"p{i}", draw.sample("abcdefghijklmnop", draw.randrange(0, 6)) + [f"own{i}"] * draw.randrange(2)) for i in range(300)] + [("lone", ["x"]), ("none", None), ("p1 copy", ["a", "b"]), ("p2 copy", ["a", "b"])]
    df = spark.createDataFrame(rows, "path string, keywords array<string>")
    for asked in (F.col("path").rlike("7$|copy"), F.lit(True)):
        got = O.recommended(df, asked, 6)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and "Union" not in got._jdf.queryExecution().executedPlan().toString()
        near = O.related(df, asked).join(df, "path")
        want = {(r.query, r.rank, r.path, round(r.similarity, 9)) for r in O.mmr(near, 6).collect()}
        assert {(r.query, r.rank, r.path, round(r.similarity, 9)) for r in got.collect()} == want and len(want) > 100
    few = lambda most: {tuple(r) for r in O.recommended(df, F.col("path") == "p7", 6, most=most).collect()}
    assert few(0) == few(1 << 24)  # as tables, where the keywords are too many to be sent
    assert O.recommended(df, F.lit(False)).count() == 0 and O.recommended(df.where("false"), F.lit(True)).count() == 0


def test_near_titles_turn_down_before_edits_are_counted(spark):
    draw = random.Random(7)
    words = ["river", "mill", "Klyvis", "turbine", "kiln", "机器学习", "入门", "of", "a", "é"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 7))) for _ in range(150)] + ["x", "xy", "ab", "aaaaaaaaaa", "aaaaaaaaab"]
    texts += ["".join(draw.choice("ab é") if draw.random() < 0.15 else c for c in t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    similar = T.edit_similarity(F.col("s"), F.col("t")) >= 0.7
    x, y = df.select(F.col("id").alias("x"), F.col("text").alias("s")), df.select(F.col("id").alias("y"), F.col("text").alias("t"))
    want = {(r.x, r.y) for r in x.join(y).where(similar).collect()}
    for block in (50, 16_384):
        met = O.near_titles(df, df, block=block)
        assert {(r.x, r.y) for r in met.where(similar).collect()} == want and met.count() < len(texts) ** 2 / 4
    assert O.near_titles(df.where("false"), df).count() == 0


def test_claims_of_a_note_lie_in_one_row(spark, tmp_path):
    """Claims are found, traced and looked at again by one call a note each; rows are as by SQL."""
    duckdb = pytest.importorskip("duckdb")
    notes = [(f"n{i}", f"s{i % 3}", f"Mill {i} gained {40 + i}% in 2021. Old Mill Trust said {i} km. It is so.", i) for i in range(9)] + [("n0", "s0", "It stood. So it was. Another 99% there. And 7 km off.", 50), ("n1", "s1", "Mill 1 gained 41% in 2021. Old Mill Trust said 1 km. It is so.", 60), ("x", "s1", "no", 70), ("y", None, "50% of it.", 80), ("z", "s9", None, 90)]
    spark.createDataFrame(notes, "note_id string, source string, content string, saved_at bigint").write.parquet(str(tmp_path / "notes.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view notes as from '{tmp_path}/notes.parquet/*.parquet'")
    for name, calls in (("c5_compared", 3), ("c4_verified", 3), ("c6_verified_only", 3), ("o64_labels", 3), ("o61_counts", 3), ("c2_trace", 2), ("c1_claims", 1)):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert sum(plan.count(f"{f}(") for f in ("note_claims", "traced_notes", "_looked")) == calls, name
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        want = duck.sql(SQL[name]).fetchall()
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
