"""All similar pairs of set-valued records by sorted sketch forests (problem 4).

In each tree every distinct set is written as its values in the order of that
tree's hash, the least first: a minhash signature. Sets with a common prefix
are neighbours; where too many share a prefix, the prefix is taken longer. Two
sets of similarity s begin alike in a tree with chance s, so as long as no
prefix is taken longer, WHOLE trees miss a pair at the threshold of 0.6 with a
chance of 0.4 ** WHOLE. Sets that have fewer such trees fall short of that
target: they meet in an exact index by prefix filtering, where no value is too
common. Exact similarity decides on every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.buckets import bucket_pairs, jaccard
from quernstone.tables import cut

TREES = 14
#: Trees in which a set must not have been taken apart: a pair at the threshold is missed by 0.4 % then.
WHOLE = 6
CAP = 48
#: Sets of one value, size and place that meet in one task.
SALTED = 5000


def clean(values: Column) -> Column:
    """Trimmed, without leading '#', in lower case, each once; null and blank values don't count."""
    blank = r"[\s\p{Z}]"
    bare = F.transform(values, lambda v: F.lower(F.regexp_replace(F.regexp_replace(v, rf"^(?:{blank}|#)+", ""), rf"{blank}+$", "")))
    return F.array_distinct(F.filter(bare, lambda v: v.isNotNull() & (v != "")))


def records(index: DataFrame, notes: DataFrame) -> DataFrame:
    """(key, vals): paths with their newest keywords and notes with their tags.

    Values are hashed to 64 bits. Of equal newest times the greater array counts.
    """
    newest = index.where("path is not null").groupBy(F.col("path").alias("key")).agg(F.max_by("keywords", F.struct("updated_at", "keywords")).alias("v"))
    tagged = notes.where("note_id is not null and tags is not null").dropDuplicates(["note_id"]).select(F.col("note_id").alias("key"), F.col("tags").alias("v"))
    both = newest.unionByName(tagged).withColumn("v", clean(F.col("v"))).where(F.size("v") > 0)
    return both.select("key", F.array_sort(F.transform("v", lambda x: F.xxhash64(x))).alias("vals"))


def forest(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of neighbours in some tree, ids of the sets that were taken apart in too many)."""
    tree = sets.select("id", "vals", F.explode(F.sequence(F.lit(1), F.lit(TREES))).alias("t"))
    signed = F.slice(F.array_sort(F.transform("vals", lambda v: F.struct(F.xxhash64(v, F.col("t")).alias("h"), v.alias("v")))), 1, 3).getField("v")
    at = tree.select("id", F.size("vals").alias("n"), "t", signed.alias("s"))
    prefix = [F.xxhash64("t", F.slice("s", 1, d)) for d in (1, 2, 3)]
    # Finer keys only split a bucket: 32 bits of them do. A set of fewer values has the same key for all it lacks.
    keys = [p if d == 0 else F.shiftright(p, 32) for d, p in enumerate(prefix)]
    rows = at.select("id", "n", F.lit(True).alias("q"), F.lit(1).alias("w"), *[k.alias(f"k{d + 1}") for d, k in enumerate(keys)])
    split: list[DataFrame] = []
    pairs = bucket_pairs(rows, 3, CAP, threshold, near=4, split=split)
    rest = split[0].groupBy("id").count().where(F.col("count") > TREES - WHOLE).select("id")
    return pairs, rest


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets that share a value in their prefixes, the rarest values first.

    Two similar sets share a value among the first n - ceil(threshold * n) + 1
    of each. A key holds the value, and the size and place of both sides, so
    that sides which can't reach the threshold never meet; hot keys are salted.
    """
    need = lambda x, y: F.ceil(F.lit(threshold / (1 + threshold)) * (x + y) - 1e-9)
    flat = sets.select("id", F.size("vals").alias("n"), F.explode("vals").alias("v"))
    flat = flat.join(flat.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "v")
    shared = flat.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("l"))
    # Values of one set only come first in the order.
    place = shared.select("id", "n", (F.col("n") - F.size("l")).alias("own"), F.posexplode("l").alias("j", "e"))
    place = place.select("id", "n", (F.col("own") + F.col("j")).alias("i"), F.col("e.v").alias("v"))
    place = place.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))
    place = cut(place.withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("v", "n", "i")) / F.lit(SALTED)).cast("int")))
    kinds = place.select("v", "n", "i", "parts").distinct()
    # Of each value, the kinds of sets that can be similar: a few sizes and places.
    x, y = kinds.select("v", F.col("n").alias("n1"), F.col("i").alias("i1")), kinds.select("v", F.col("n").alias("n2"), F.col("i").alias("i2"), "parts")
    reach = F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2")) + F.least("i1", "i2")
    fits = x.join(y, "v").where((F.least("n1", "n2") >= threshold * F.greatest("n1", "n2") - 1e-9) & (reach >= need(F.col("n1"), F.col("n2"))))
    fits = fits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left = place.hint("merge").select(F.col("id").alias("x"), "v", F.col("n").alias("n1"), F.col("i").alias("i1")).join(fits, ["v", "n1", "i1"])
    right = place.select(F.col("id").alias("y"), "v", F.col("n").alias("n2"), F.col("i").alias("i2"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    both = left.hint("merge").join(right.hint("merge"), ["v", "n2", "i2", "part"])
    return both.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def set_classes(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, id), (id, vals)): records with equal sets are one class."""
    held = cut(recs.withColumn("id", F.xxhash64("vals")))
    return held.select("key", "id"), cut(held.groupBy("id").agg(F.first("vals").alias("vals")))


def links(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different sets that reach the threshold, as a written table."""
    pairs, rest = forest(sets, threshold)
    near = pairs.select("a", "b").unionByName(prefix_pairs(cut(sets.join(rest, "id", "left_semi")), threshold)).distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("vals").alias("x")), sets.select(F.col("id").alias("b"), F.col("vals").alias("y"))
    return cut(near.join(x, "a").join(y, "b").where(jaccard("x", "y") >= threshold - 1e-12).select("a", "b"))


def found(index: DataFrame, notes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """key_a < key_b of every pair of records that reaches the threshold, equal sets too.

    Null keys, null and empty sets have no pairs; repeated rows count once.
    """
    own, sets = set_classes(records(index, notes))
    pairs = links(sets, threshold)
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    many = own.groupBy("id").count().where("count > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    x, y = own.select(F.col("key").alias("key_a"), F.col("id").alias("a")), own.select(F.col("key").alias("key_b"), F.col("id").alias("b"))
    return pairs.unionByName(many).join(x, "a").join(y, "b").where("key_a < key_b").select("key_a", "key_b").distinct()
