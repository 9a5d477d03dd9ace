"""What the operators on pairs share: buckets that deepen, exact checks, groups.

A bucket holds the records that share a key. Small buckets give all their
pairs, whose number grows with the rows only; a bucket beyond the bound is
split by the next, longer key of its records; what is still beyond it after
the last key is linked in order, each record to its nearest neighbours. So no
bucket, however hot, gives all its pairs, and none is cut off.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.tables import cut


class _Buckets:
    """The rows of one partition, sorted by key, bucket by bucket; at most cap + 1 rows of an open bucket are held."""

    def __init__(self, cap: int, ratio: float, near: int, deeper: list[str]):
        self.cap, self.ratio, self.near, self.deeper = cap, ratio, near, deeper
        self.hot, self.context = None, None  # the key of a bucket beyond the bound; the rows new ones of it link to

    def pairs(self, c: dict, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        n, m = c["n"][i], c["n"][j]
        good = (np.minimum(n, m) >= self.ratio * np.maximum(n, m) - 1e-9) & (c["q"][i] | c["q"][j]) & (c["id"][i] != c["id"][j])
        i, j = i[good], j[good]
        x, y = c["id"][i], c["id"][j]
        return [np.minimum(x, y), np.maximum(x, y), c["w"][i], np.maximum(c["n"][i], c["n"][j])]

    def small(self, c: dict, rows: np.ndarray, ends: np.ndarray) -> list[list[np.ndarray]]:
        """All pairs of the buckets these rows are in; ends: where the bucket of each row ends."""
        out, step = [], 1
        while len(rows):
            keep = rows + step < ends
            rows, ends = rows[keep], ends[keep]
            if len(rows):
                out.append(self.pairs(c, rows, rows + step))
            step += 1
        return out

    def chain(self, c: dict, key: int) -> list[list[np.ndarray]]:
        """The rows of a bucket no key splits, each with its neighbours and the first."""
        old = 0
        if self.context is not None and self.context[0] == key:
            old = len(self.context[1]["n"])
            c = {k: np.concatenate((self.context[1][k], c[k])) for k in c}
        at = np.arange(max(old, 1), len(c["n"]))
        out = [self.pairs(c, np.zeros_like(at), at)]
        for d in range(1, self.near + 1):
            i = at[at - d >= 1]
            out.append(self.pairs(c, i - d, i))
        last = np.r_[0, np.arange(max(1, len(c["n"]) - self.near), len(c["n"]))]
        self.context = (key, {k: v[last] for k, v in c.items()})
        return out

    def run(self, batches):
        names = ["id", "n", "q", "w", "k", *self.deeper]
        held = None
        for batch in chain_batches(batches):
            if batch is not None:
                c = {k: v.to_numpy(zero_copy_only=False) for k, v in zip(names, batch.columns)}
                if held is not None:
                    c = {k: np.concatenate((held[k], c[k])) for k in names}
            elif held is None:
                return
            else:
                c = held
            size = len(c["k"])
            if not size:
                continue
            starts = np.flatnonzero(np.r_[True, c["k"][1:] != c["k"][:-1]])
            ends = np.r_[starts[1:], size]
            upto, held = size, None
            if batch is not None and size - starts[-1] <= self.cap and c["k"][-1] != self.hot:
                upto = starts[-1]
                held = {k: v[upto:] for k, v in c.items()}
                starts, ends = starts[:-1], ends[:-1]
            many = (ends - starts > self.cap) | (c["k"][starts] == self.hot if self.hot is not None else False)
            if len(starts) and many[-1] and batch is not None and held is None:
                self.hot = c["k"][-1]
            length = ends - starts
            ok = np.repeat(~many, length)
            found = self.small(c, np.flatnonzero(ok), np.repeat(ends, length)[ok])
            big = np.flatnonzero(~ok)
            deep = {k: v[:0] for k, v in c.items()}
            if len(big) and self.deeper:
                deep = {k: v[big] for k, v in c.items()}
            elif len(big):
                for s, e in zip(starts[many], ends[many]):
                    found += self.chain({k: v[s:e] for k, v in c.items()}, c["k"][s])
            a, b, w, n = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(4))
            rows, extra = len(a), len(deep["id"])
            if not rows + extra:
                continue
            none = np.zeros(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[a, deep["id"]]), pa.array(np.r_[b, np.zeros(extra, np.int64)]), pa.array(np.r_[np.ones(rows, bool), np.zeros(extra, bool)]),
                    pa.array(np.r_[n, deep["n"]].astype(np.int32)), pa.array(np.r_[np.zeros(rows, bool), deep["q"]]), pa.array(np.r_[w, deep["w"]].astype(np.int32)),
                    *[pa.array(np.r_[none, deep[k]]) for k in self.deeper],
                ],
                names=["id", "b", "pair", "n", "q", "w", *self.deeper],
            )


def chain_batches(batches):
    yield from batches
    yield None


def bucket_pairs(rows: DataFrame, depth: int, cap: int, ratio: float, near: int = 8, order: tuple[str, ...] = ("n", "id"), split: list[DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of records in one bucket; a pair may come more than once.

    ``split``: a list that takes the rows (id) of all buckets beyond the cap,
    whose pairs need not all be here.

    ``rows``: id, n (size of the record), q (whether it asks; of a pair one at
    least does), w (weight of a shared key), k1 .. k<depth> (keys, each finer
    than the one before, null where a record has no such key). Sizes of a pair
    differ by ``ratio`` at most; w and the greater n come out with the pair.
    ``order``: of the links in a bucket that no key splits.
    """
    out, at = [], rows.withColumns({f"k{i}": F.coalesce(f"k{i}", F.lit(0)) for i in range(1, depth + 1)})  # 0: no key
    for d in range(1, depth + 1):
        deeper = [f"k{i}" for i in range(d + 1, depth + 1)]
        extra = [c for c in order if c not in ("id", "n")]
        at = at.where(f"k{d} <> 0").select("id", "n", "q", "w", F.col(f"k{d}").alias("k"), *deeper, *extra)
        at = at.repartition("k").sortWithinPartitions("k", *(order if d == depth else ()))
        shape = "id bigint, b bigint, pair boolean, n int, q boolean, w int" + "".join(f", {k} bigint" for k in [*deeper, *(extra if deeper else [])])
        work = _Buckets(cap, ratio, near, [*deeper, *extra] if deeper else [])
        names = ["id", "n", "q", "w", "k", *deeper, *extra]
        ran = at.select(*names).mapInArrow(work.run, shape)
        if not deeper:
            out.append(ran.select(F.col("id").alias("a"), "b", "w", "n"))
            break
        done = cut(ran)
        out.append(done.where("pair").select(F.col("id").alias("a"), "b", "w", "n"))
        at = done.where("not pair")
        if split is not None and d == 1:
            split.append(at.select("id"))
    return reduce(DataFrame.unionByName, out)


def jaccard(x: str, y: str) -> Column:
    """Common of all values of two arrays of distinct values; 0 where both are empty."""
    common = F.size(F.array_intersect(x, y))
    whole = F.size(x) + F.size(y) - common
    return F.when(whole > 0, common / whole).otherwise(F.lit(0.0))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs whose sets (``sets``: id, vals) reach the threshold."""
    both = (
        pairs.distinct()
        .join(sets.select(F.col("id").alias("a"), F.col("vals").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("vals").alias("y")), "b")
    )
    return both.where(jaccard("x", "y") >= threshold - 1e-12).select("a", "b")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, label): the least id each id is linked to, by hooking and jumping.

    ``edges`` (a, b) is read each round and should be a written table. The
    number of rounds is about the logarithm of the longest chain.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(seen, labels["id"] == seen["a"]).select("id", "label", F.least("label", "m").alias("m"))
        # The label of a label may be less by now: jump to it.
        over = hooked.join(labels.select(F.col("id").alias("m"), F.col("label").alias("mm")), "m", "left")
        nxt = cut(over.select("id", F.least("m", F.coalesce("mm", "m")).alias("label"), (F.least("m", F.coalesce("mm", "m")) < F.col("label")).alias("moved")))
        labels = nxt.select("id", "label")
        if nxt.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")
