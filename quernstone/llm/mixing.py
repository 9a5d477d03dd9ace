"""A mix of sources in target shares (problem 9), by pivotal dependent rounding.

Each wanted source has a target number of tokens, its share of the budget, held
to max_repeats copies of all its documents. Every document of a source starts
with the same expected number of copies; the whole part is given at once, and
the fraction is rounded by pairs: tokens pass between two documents until one
of them has a whole number, with the chances that keep each expectation. What
no pair within a bucket can settle, one document at most, meets the rest of the
other buckets in a tree of fixed fan-in, up to one document a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.bpe import count_tokens
from quernstone.tables import cut

#: Documents in one bucket of the first rounding, about.
BUCKET_ROWS = 20_000
#: Buckets whose rests meet in one node of the tree.
FAN_IN = 64
SEED = 20_240_607


def clean_source(c):
    """Sources compare trimmed and in lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def pivot(doc: list[int], size: list[int], part: list[float], seed: int) -> tuple[list[float], int]:
    """The rounded fractions, and the place of the one left over or -1.

    Tokens are passed on, not copies: size * fraction of the pair stays the
    same, and of the two ways to end, each is taken with the chance that keeps
    the expected copies of both.
    """
    x, open_ = list(part), -1
    rng = np.random.default_rng([seed, len(doc), doc[0] & (2**63 - 1) if doc else 0])
    draws = rng.random(len(doc)) if doc else []
    for i in range(len(doc)):
        if x[i] <= 1e-12 or x[i] >= 1 - 1e-12:
            x[i] = float(round(x[i]))
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        a, b = size[j], size[i]
        up = min((1 - x[j]) * a, x[i] * b)  # tokens that may pass from i to j
        down = min(x[j] * a, (1 - x[i]) * b)  # and from j to i
        moved = up if draws[i] * (up + down) < down else -down
        x[j] += moved / a
        x[i] -= moved / b
        for k in (i, j):
            if abs(x[k] - round(x[k])) < 1e-9:
                x[k] = float(round(x[k]))
        left = [k for k in (j, i) if 0 < x[k] < 1]
        open_ = left[0] if left else -1
    return x, open_


def _rounder(last: bool):
    return lambda table: _round(table, last)


def _round(table: pa.Table, last: bool) -> pa.Table:
    """One bucket or node: the rows with whole copies, and one row at most with a rest.

    In the last node the rest itself is drawn.
    """
    # The longest first: what is left over in the end is one of the shortest.
    table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
    doc, size, part = (table.column(c).to_pylist() for c in ("doc_id", "n_tokens", "part"))
    x, left = pivot(doc, size, part, SEED)
    if last and left >= 0:
        draw = np.random.default_rng([SEED, 1, doc[left] & (2**63 - 1)]).random()
        x[left] = 1.0 if draw < x[left] else 0.0
    return table.set_column(table.schema.get_field_index("part"), "part", pa.array(x, pa.float64()))


def plan(sizes: DataFrame, targets: DataFrame, budget: int | None = None, keep_targets: bool = False) -> DataFrame:
    """A row per wanted source: tokens there, tokens wanted, copies of each document.

    Without a budget the mix is as large as all documents of the wanted sources.
    With ``keep_targets`` it is made as small as the scarcest source that has
    documents asks, so that all these keep their shares of one another.
    """
    wanted = (
        targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    both = wanted.join(there, "source", "left").na.fill(0, ["tokens", "docs"])
    every = Window.partitionBy()  # a row per source: as many as there are targets
    total = F.lit(float(budget)) if budget is not None else F.sum("tokens").over(every)
    if keep_targets:
        share = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every)
        scarcest = F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).over(every)
        goal = F.when(F.col("tokens") > 0, F.col("target_share") * F.least(scarcest, total / share)).otherwise(0.0)
    else:
        goal = F.col("target_share") / F.sum("target_share").over(every) * total
    return both.withColumn("goal_tokens", goal).withColumn(
        "copies", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("goal_tokens") / F.col("tokens"))).otherwise(F.lit(0.0))
    )


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", keep_targets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, shares).

    Drawn: doc_id, source, n_tokens, repeats of every document taken at least
    once. Shares: a row per wanted source, with tokens drawn, actual share and
    shortfall (tokens wanted and not drawn: what the cap withholds, and less
    than one document); a source without documents has 0. Documents with a null or unwanted source
    or without tokens are not drawn; a doc_id that comes twice counts once.
    """
    spark = documents.sparkSession
    names = targets.select(clean_source(F.col("source")).alias("source")).distinct()
    docs = documents.select(F.col(key).alias("doc_id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    docs = docs.join(F.broadcast(names), "source", "left_semi")  # as many as there are targets
    sizes = cut(count_tokens(docs.select("doc_id", "source", "text")).where("n_tokens > 0 and doc_id is not null").dropDuplicates(["doc_id"]))
    goals = cut(plan(sizes, targets, budget, keep_targets))
    rows = sizes.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    given = sizes.join(F.broadcast(goals.select("source", "copies")), "source")
    given = given.withColumn("whole", F.floor("copies").cast("int")).withColumn("part", F.col("copies") - F.floor("copies"))
    shape = "doc_id bigint, source string, n_tokens bigint, whole int, part double, node bigint"
    node = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    at, settled = given.select("doc_id", "source", "n_tokens", "whole", "part", node.alias("node")), None
    while True:
        last = buckets == 1
        done = at.groupBy("source", "node").applyInArrow(_rounder(last), shape)
        if last:
            settled = done if settled is None else settled.unionByName(done)
            break
        done = cut(done)
        own = done.where("part = 0 or part = 1")
        settled = own if settled is None else settled.unionByName(own)
        buckets = -(-buckets // FAN_IN)
        at = done.where("part > 0 and part < 1").withColumn("node", F.floor(F.col("node") / FAN_IN))
    drawn = settled.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("part").cast("int")).alias("repeats")).where("repeats > 0")
    drawn = cut(drawn)
    sums = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("drawn_docs"), F.max("repeats").alias("most_repeats"))
    shares = goals.join(F.broadcast(sums), "source", "left").na.fill(0, ["drawn_tokens", "drawn_docs", "most_repeats"])
    mixed = F.sum("drawn_tokens").over(Window.partitionBy())
    shares = shares.select(
        "source", "target_share", "max_repeats", "tokens", "docs", "drawn_docs", "drawn_tokens", "most_repeats",
        F.when(mixed > 0, F.col("drawn_tokens") / mixed).otherwise(F.lit(0.0)).alias("actual_share"),
        F.greatest(F.lit(0.0), F.col("goal_tokens") - F.col("drawn_tokens")).alias("shortfall"),
    )
    return drawn, shares
