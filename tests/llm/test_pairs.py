"""The operators on pairs against brute force on small tables, and their edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import history, near_notes, neighbours, set_pairs
from quernstone.llm.buckets import bucket_pairs, components

WORDS = [f"w{i:03d}" for i in range(150)]


def shingles(s):
    return {s[i : i + 5] for i in range(len(s) - 4)}


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


def closure(pairs, keys):
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        up[top(a)] = top(b)
    groups = {}
    for k in keys:
        groups.setdefault(top(k), []).append(k)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


NOTES = "note_id string, title string, content string, id bigint, label string"


def test_near_notes_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for g in range(25):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)]
        for k in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(40)] = rng.choice(WORDS)
            rows.append((f"n{g}_{k}", None if g % 5 == 0 else "Title!", " ".join(words), 7, "x"))
    rows += rows[:5]  # repeated rows
    rows += [("same1", "A", "One two three, four five.", 1, "x"), ("same2", "a", "one TWO three four five", 1, "x"), ("nul", "t", None, 1, "x"), ("blank", "t", "  ", 1, "x"), ("tiny1", None, "abc", 1, "x"), ("tiny2", None, "abc", 1, "x")]
    df = spark.createDataFrame(rows, NOTES)
    text = {k: shingles("".join(c for c in ((t or "") + c).lower() if c.isalnum())) for k, t, c, _, _ in rows if c and c.strip()}
    alike = [(a, b) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.7]
    want = {p for p in closure(alike, text) if "tiny" not in p[0]}
    assert {tuple(r) for r in near_notes.found(df).collect()} == want
    assert ("same1", "same2") in want


def test_near_notes_star_family(spark):
    """Variants of a base that are alike to the base only: all of them are found."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    base = [rng.choice(letters) for _ in range(1000)]
    texts = ["".join(base)]
    for _ in range(300):
        signs = list(base)
        for at in rng.sample(range(1000), 28):
            signs[at] = rng.choice(letters)
        texts.append("".join(signs))
    sets = [shingles(t) for t in texts]
    with_base = {i for i, s in enumerate(sets) if jaccard(s, sets[0]) >= 0.7}
    assert len(with_base) > 295 and max(jaccard(sets[i], sets[j]) for i in range(1, 40) for j in range(1, i)) < 0.7
    df = spark.createDataFrame([(f"n{i}", None, t, 1, "x") for i, t in enumerate(texts)], NOTES)
    got = near_notes.groups(df).collect()
    assert {int(r.key[1:]) for r in got} >= with_base and len({r.label for r in got}) == 1


def test_near_notes_empty_and_long(spark):
    empty = spark.createDataFrame([], NOTES)
    assert near_notes.found(empty).count() == 0
    long = "lorem ipsum dolor " * 20_000
    df = spark.createDataFrame([("a", "t", long, 1, ""), ("b", "t", long + "x", 1, "")], NOTES)
    assert near_notes.found(df).count() == 1


def test_near_notes_values_are_counted_in_all_texts(spark):
    """Each of 41 000 texts counts: of so many a sample was taken before."""
    texts = spark.range(41_000).selectExpr("id", "concat('mill', lpad(id, 5, '0')) as text")  # 5 runs of five signs each
    assert near_notes.value_counts(texts).sum() == 41_000 * 5


def test_large_group_is_linked_without_all_pairs(spark):
    """A bucket far beyond the bound: every member is linked to some other one."""
    rows = spark.range(3000).selectExpr("id", "10 as n", "true as q", "1 as w", "5L as k1", "6L as k2")
    got = bucket_pairs(rows, 2, 20, 0.5)
    assert got.count() < 3000 * 12
    assert components(got.select("a", "b").distinct()).select("label").distinct().count() == 1


def test_buckets_give_all_pairs_and_split_by_finer_keys(spark):
    rows = [(i, 10, i % 2 == 0, 1, i % 7 + 1, i % 70 + 1) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, n int, q boolean, w int, k1 bigint, k2 bigint").repartition(3)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[5] == b[5] and (a[2] or b[2])}
    got = [(r.a, r.b) for r in bucket_pairs(df, 2, 20, 0.9).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


INDEX = "path string, title string, keywords array<string>, updated_at bigint, id bigint, v string"


def test_set_pairs_match_brute_force(spark):
    rng = random.Random(2)
    common = ["note", "Archive", "#water", " reading "]
    index, notes = [], []
    for i in range(220):
        s = [rng.choice(common) for _ in range(rng.randint(0, 4))] + [rng.choice(WORDS[: 20 + i // 3]) for _ in range(rng.randint(0, 6))] + [None, " "]
        (index if i % 2 else notes).append(s)
    irows = [(f"p{i}", "t", s, 5, 1, "") for i, s in enumerate(index)] + [("p0", "t", ["old", "gone"], 1, 1, ""), ("pn", "t", None, 9, 1, ""), ("pn", "t", ["x"], 3, 1, "")]
    nrows = [(f"q{i}", s) for i, s in enumerate(notes)] * 2

    def clean(s):
        return frozenset(x for x in (v.strip().lstrip("#").strip().lower() for v in s if v is not None) if x)

    sets = {f"p{i}": clean(s) for i, s in enumerate(index)} | {f"q{i}": clean(s) for i, s in enumerate(notes)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.6}
    got = {tuple(r) for r in set_pairs.found(spark.createDataFrame(irows, INDEX), spark.createDataFrame(nrows, "note_id string, tags array<string>")).collect()}
    assert got == want


def test_set_pairs_of_a_family_in_many_sets(spark):
    """A family whose core is hot in all trees but in few of all sets: every pair is found."""
    family = [(i, list(range(1, 9)) + [100 + i]) for i in range(1, 101)]
    others = spark.range(1000, 241_000).selectExpr("id", "array(id) as vals")
    sets = others.unionByName(spark.createDataFrame(family, "id bigint, vals array<bigint>"))
    assert set_pairs.links(sets, 0.6).distinct().count() == 4950


def test_set_pairs_empty(spark):
    assert set_pairs.found(spark.createDataFrame([], INDEX), spark.createDataFrame([], "note_id string, tags array<string>")).count() == 0


def test_history_matches_brute_force(spark):
    rng = random.Random(3)
    text = lambda: [rng.choice(WORDS) for _ in range(rng.randint(3, 80))]
    old = [text() for _ in range(60)]
    feats = [(f"p{i}", 5, [(t, 1) for t in dict.fromkeys(o)]) for i, o in enumerate(old)] + [("p0", 1, [("zzz", 1)]), ("none", 1, None)]
    rows = []
    for i in range(90):
        words = list(rng.choice(old)) if i % 3 == 0 else text() if i % 3 == 1 or not rows else rng.choice(rows)[2].split()
        for _ in range(rng.randint(0, len(words) // 3 + 1)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((f"n{i}", i % 4, " ".join(words)))
    rows += [("nul", 1, None), ("empty", 1, ""), ("signs", 2, "!! ? a"), rows[0]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "note_id string, batch_no int, content string, id bigint, b string")
    sets = {k: (b, frozenset(c.split())) for k, b, c in rows if c and k not in ("signs",)}
    want = set()
    for k, (b, s) in sets.items():
        if any(jaccard(s, frozenset(o)) >= 0.6 for o in old) or any(b2 < b and jaccard(s, s2) >= 0.6 for b2, s2 in sets.values()):
            want.add(k)
    f = spark.createDataFrame(feats, "path string, mtime bigint, tokens array<struct<token:string,freq:int>>")
    got = {r.note_id for r in history.found(f, df).collect()}
    assert got <= want and len(want - got) <= 0.03 * len(want)


def test_history_batch_by_batch_is_one_go(spark, tmp_path):
    """Eight calls find what one finds, and a call writes chunks of its own batch only."""
    rng = random.Random(4)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(5, 60))] for _ in range(40)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base)) if i % 2 else [rng.choice(WORDS) for _ in range(30)]
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((f"n{i}", i % 8, " ".join(words)))
    notes = spark.createDataFrame(rows, "note_id string, b int, content string").select("note_id", "b", history.hashed(history.tokens("content")).alias("vals"))
    features = spark.createDataFrame([(f"p{i}", 5, [(t, 1) for t in dict.fromkeys(x)]) for i, x in enumerate(base[:20])], "path string, mtime bigint, tokens array<struct<token:string,freq:int>>")
    old = history.accepted(features).selectExpr("vals", f"cast({history.ACCEPTED} as int) as b", "xxhash64(vals) as id", "size(vals) as n")

    def kept(path):
        return {f for f in (tmp_path / path).rglob("*.parquet")}

    whole = history.ChunkTable(spark, str(tmp_path / "whole"))
    whole.append(old)
    once = {r.note_id for r in whole.judge(notes).collect()}
    history.ChunkTable(spark, str(tmp_path / "steps")).append(old)
    stepwise, before = set(), kept("steps")
    for b in range(8):
        table = history.ChunkTable(spark, str(tmp_path / "steps"))  # another session: all it knows is in the files
        stepwise |= {r.note_id for r in table.judge(notes.where(f"b = {b}")).collect()}
        assert kept("steps") >= before  # nothing kept is written again
        before = kept("steps")
    assert stepwise == once and len(once) > 40
    # A call that failed leaves no trace: its folder is written anew.
    (tmp_path / "steps" / "done" / f"a{table.number - 1}").unlink()
    again = history.ChunkTable(spark, str(tmp_path / "steps"))
    assert {r.note_id for r in again.judge(notes.where("b = 7")).collect()} == {n for n in once if int(n[1:]) % 8 == 7}
    ids = again.records().select("id")
    assert ids.count() == ids.distinct().count() and again.number == table.number


def test_history_of_a_family_of_common_tokens(spark):
    """Variants of a base that a part of all records share: each is found by its one changed token or none."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    feats = [("p", 1, [(t, 1) for t in base])] + [(f"o{i}", 1, [(f"x{i}_{j}", 1) for j in range(20)]) for i in range(300)]
    rows = []
    for i in range(200):
        words = [w for w in base if rng.random() > 0.05] + [f"own{i}"]
        rows.append((f"n{i}", 1 + i % 2, " ".join(words)))
    f = spark.createDataFrame(feats, "path string, mtime bigint, tokens array<struct<token:string,freq:int>>")
    df = spark.createDataFrame(rows, "note_id string, batch_no int, content string")
    assert history.found(f, df).count() == 200


def test_history_of_chunks_in_many_records(spark):
    """Records alike whose shared tokens are all in far more than 64 records, in no common order: none is lost."""
    rng = random.Random(6)
    hot = [f"h{i}" for i in range(44)]
    old = [rng.sample(hot, 22) for _ in range(700)]
    new = [rng.sample(hot, 22) for _ in range(400)]
    f = spark.createDataFrame([(f"p{i}", 1, [(t, 1) for t in o]) for i, o in enumerate(old)], "path string, mtime bigint, tokens array<struct<token:string,freq:int>>")
    df = spark.createDataFrame([(f"n{i}", 1, " ".join(o)) for i, o in enumerate(new)], "note_id string, batch_no int, content string")
    want = {f"n{i}" for i, o in enumerate(new) if any(jaccard(set(o), set(x)) >= 0.6 for x in old)}
    assert {r.note_id for r in history.found(f, df).collect()} == want and 40 < len(want) < 400


def test_history_keeps_tokens_once_and_asks_in_blocks(spark, tmp_path, monkeypatch):
    """No table of chunks lies beside the records, and blocks of any size find what all pairs tell."""
    rng = random.Random(8)
    old = [rng.sample(WORDS, rng.randint(5, 60)) for _ in range(400)]
    new = [[w for w in rng.choice(old) if rng.random() > 0.25] + [f"own{i}"] for i in range(200)]
    shape = "vals array<string>"
    sets = lambda rows, b: spark.createDataFrame([(r,) for r in rows], shape).select(history.hashed(F.col("vals")).alias("vals")).selectExpr("xxhash64(vals) as id", "size(vals) as n", f"cast({b} as int) as b", "vals")
    notes = sets(new, 1).selectExpr("cast(id as string) as note_id", "b", "vals")
    ids = {frozenset(r.vals): r.note_id for r in notes.collect()}
    olds = [frozenset(r.vals) for r in sets(old, 0).collect()]
    want = {i for v, i in ids.items() if any(jaccard(v, o) >= 0.6 for o in olds)}
    for block in (1 << 22, 500):
        monkeypatch.setattr(history, "BLOCK", block)
        table = history.ChunkTable(spark, str(tmp_path / f"t{block}"))
        table.append(sets(old, 0))
        size = sum(f.stat().st_size for f in (tmp_path / f"t{block}").rglob("*.parquet") if "order" not in f.parts)
        assert size < 12 * sum(map(len, olds)) + 4000 * 20
        assert {r.note_id for r in table.judge(notes).collect()} == want and 40 < len(want) < 190


def test_history_tokens(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("Für 机器学习 ab C x_1 测试 学",)], "t string").select(history.tokens(F.col("t"))).first()[0]
    assert got == ["机器学", "器学习", "ab", "x_1", "测试"]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 64))
    x = np.repeat(centres, 12, axis=0) + 0.3 * rng.standard_normal((720, 64))
    x[50] = x[51]
    rows = [(i, f"p{i}", 5, v.tolist()) for i, v in enumerate(x)] + [(9001, "p0", 1, [1.0] * 64), (9002, "z", 1, [0.0] * 64), (9003, "s", 1, [1.0]), (9004, "n", 1, None), (9005, "f", 1, [-99999.0] * 64)]
    rows += rows[:3]
    got = {tuple(r) for r in neighbours.found(spark.createDataFrame(rows, "vec_id bigint, path string, m bigint, v array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).round(9)
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(x)):
        for j in np.lexsort((np.arange(len(x)), -s[i]))[:5]:
            if s[i, j] >= 0.8:
                want.add((min(i, int(j)), max(i, int(j))))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert (50, 51) in got


def test_neighbours_are_the_same_however_indexes_are_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    rows = [(i, (base[i % 60] + 0.45 * rng.standard_normal(64)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = []
    for most in (1 << 18, 110):  # whole, and in eight parts or more
        monkeypatch.setattr(neighbours, "CHUNK", most)
        got.append({(r.a, r.b, round(r.s, 9)) for r in neighbours.partners(df, 1000, 0.7).collect()})
    assert got[0] == got[1] and len(got[0]) > 5000


def test_neighbours_of_copies_and_none(spark):
    shape = "vec_id bigint, path string, m bigint, v array<double>"
    v = [float(i % 7 + 1) for i in range(64)]
    got = {tuple(r) for r in neighbours.found(spark.createDataFrame([(i, f"p{i}", 1, v) for i in range(9)], shape)).collect()}
    want = {(min(i, j), max(i, j)) for i in range(9) for j in [k for k in range(9) if k != i][:5]}
    assert got == want  # ties go to the smaller id
    assert neighbours.found(spark.createDataFrame([], shape)).count() == 0
