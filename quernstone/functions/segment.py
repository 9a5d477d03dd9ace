"""Words of CJK runs by the most probable path through a dictionary."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.functions.text import STOP_WORDS

_RUN = re.compile(r"[a-z0-9_一-鿿]+")
_CJK = re.compile("[一-鿿]")


class Segmenter:
    """``freq``: words and how often they occur; the dictionary is a parameter, none is kept here."""

    def __init__(self, freq: dict[str, int]):
        self.total = math.log(sum(freq.values()) or 1)
        self.cost = {w: math.log(max(1, f)) - self.total for w, f in freq.items()}
        self.longest = max(map(len, freq), default=1)

    def words(self, run: str) -> list[str]:
        n = len(run)
        best, upto = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            best[i], upto[i] = self.cost.get(run[i], -self.total) + best[i + 1], i + 1
            for j in range(i + 2, min(n, i + self.longest) + 1):
                c = self.cost.get(run[i:j])
                if c is not None and c + best[j] > best[i]:
                    best[i], upto[i] = c + best[j], j
        out, i = [], 0
        while i < n:
            out.append(run[i : upto[i]])
            i = upto[i]
        return out

    def bag(self, text: str, n: int = 3) -> Counter:
        """Tokens and how often: words of the dictionary as W:word and pieces of CJK runs, other runs as they are."""
        bag, stop = Counter(), frozenset(STOP_WORDS)
        for run in _RUN.findall(text.lower()):
            if len(run) < 2:
                if _CJK.match(run):
                    continue
            elif _CJK.search(run):
                bag.update(f"W:{w}" for w in self.words(run) if len(w) > 1 and w not in stop)
                size = n if len(run) >= n else 2
                bag.update(run[i : i + size] for i in range(len(run) - size + 1))
            elif run not in stop:
                bag[run] += 1
        return bag


def bags(df: DataFrame, key: str, text: str, freq: dict[str, int], n: int = 3) -> DataFrame:
    """key, token, freq of every text; the dictionary goes out as a broadcast of its own, fixed size."""
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(freq)

    def run(batches):
        seg = Segmenter(held.value)
        for batch in batches:
            rows, words, counts = [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for w, c in seg.bag(x, n).items() if x else ():
                    rows.append(i)
                    words.append(w)
                    counts.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=[key, "token", "freq"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, token string, freq int")
