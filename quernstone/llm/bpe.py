"""Byte-pair encoding by a two-tier lookup (problem 8).

A text is cut into pre-tokens by the tokenizer's pattern. Tier one is a minimal
perfect hash over the vocabulary: a pre-token that is an entry is its own id.
Tier two merges what is left with a heap over linked bytes. Before tier two a
pre-token is cut where no vocabulary entry holds the two bytes around the cut:
no merge can span it, so the parts can be encoded alone and remembered.
"""

from __future__ import annotations

import base64
import os
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the public byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Words a worker remembers at most before it forgets all and starts again.
MEMO_WORDS = 300_000
#: Longer words are seldom met again and are not remembered whole.
MEMO_SIGNS = 24


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file, by their bytes."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys, n slots, by displacement."""

    def __init__(self, entries: dict[bytes, int]):
        n = len(entries)
        self.n, self.m = n, max(1, n // 2)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.m)]
        for key in entries:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.m].append((h, key))
        self.shift = [0] * self.m
        self.keys: list[bytes] = [b""] * n
        self.ids = [0] * n
        taken = np.zeros(n, dtype=bool)
        order = sorted(range(self.m), key=lambda i: -len(buckets[i]))
        singles = []
        for i in order:
            if len(buckets[i]) <= 1:
                singles += [i] * len(buckets[i])
                continue
            for d in range(1 << 30):
                slots = {self._slot(h, d) for h, _ in buckets[i]}
                if len(slots) == len(buckets[i]) and not any(taken[s] for s in slots):
                    break
            self.shift[i] = d
            for h, key in buckets[i]:
                self._put(self._slot(h, d), key, entries, taken)
        free = iter(np.flatnonzero(~taken).tolist())
        for i in singles:
            s = next(free)
            self.shift[i] = -s - 1
            self._put(s, buckets[i][0][1], entries, taken)

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def _put(self, slot: int, key: bytes, entries: dict[bytes, int], taken: np.ndarray) -> None:
        self.keys[slot], self.ids[slot], taken[slot] = key, entries[key], True

    def find(self, key: bytes) -> int:
        """The id of ``key``, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else -1


class Encoder:
    """Encodes texts as the tokenizer whose ranks it is given does."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = PerfectHash(ranks)
        # Bytes of two characters that stand side by side in some entry.
        self.joined = {(e[i], e[i + 1]) for e in ranks for i in range(len(e) - 1) if e[i + 1] >= 0xC0}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no entry: always the pair of least rank, the leftmost first."""
        find, n = self.table.find, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (r := find(piece[i : i + 2])) >= 0:
                heap.append((r, i, i + 2))
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or end[j] != e:
                continue  # one of the two has grown since
            end[i], after[i], alive[j] = e, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := find(piece[i : end[after[i]]])) >= 0:
                    heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := find(piece[p:e])) >= 0:
                heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(find(piece[i : end[i]]))
            i = after[i]
        return out

    def word(self, word: str, pieces: dict[bytes, list[int]]) -> list[int]:
        """The ids of one pre-token."""
        b = word.encode("utf-8", "replace")
        if (i := self.table.find(b)) >= 0:
            return [i]
        joined, out, start = self.joined, [], 0
        for k in range(1, len(b) + 1):
            if k == len(b) or b[k] >= 0xC0 and (b[k - 1], b[k]) not in joined:
                piece, start = b[start:k], k
                if (ids := pieces.get(piece)) is None:
                    i = self.table.find(piece)
                    ids = [i] if i >= 0 else self.merge(piece)
                    if len(piece) <= 4 * MEMO_SIGNS:
                        pieces[piece] = ids
                out += ids
        return out


class Memo(dict):
    """Words met so far and their ids; a word that is missing is encoded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.pieces = encoder, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.encoder.word(word, self.pieces)
        if len(word) <= MEMO_SIGNS:
            self[word] = ids
        return ids

    def trim(self) -> None:
        for d in (self, self.pieces):
            if len(d) > MEMO_WORDS:
                d.clear()


_WORKER: dict[str, Memo] = {}


def _memo(broadcast, name: str) -> Memo:
    if name not in _WORKER:
        _WORKER[name] = Memo(broadcast.value)
    return _WORKER[name]


def _encoder(spark, tokenizer: str, tokenizer_dir: str):
    """The encoder as a broadcast: of the size of the vocabulary, whatever the data."""
    held = getattr(spark.sparkContext, "_quernstone_bpe", None)
    if held is None:
        held = spark.sparkContext._quernstone_bpe = {}
    key = f"{tokenizer_dir}/{tokenizer}.tiktoken"
    if key not in held:
        held[key] = spark.sparkContext.broadcast(Encoder(read_ranks(key)))
    return key, held[key]


def _texts(column: pa.Array):
    for chunk in range(0, len(column), 256):
        yield from column.slice(chunk, 256).to_pylist()


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids`` of every row.

    A null or empty text has an empty list; strings of special tokens are
    ordinary text; repeated rows come out as often as they came; other columns
    are left behind, whatever their names; an empty table gives no rows.
    """
    name, held = _encoder(df.sparkSession, tokenizer, tokenizer_dir)

    def run(batches):
        import regex

        memo, split = _memo(held, name), regex.compile(PATTERN).findall
        for batch in batches:
            ends, flat = [0], []
            for x in _texts(batch.column(1)):
                if x:
                    flat.extend(chain.from_iterable(map(memo.__getitem__, split(x))))
                ends.append(len(flat))
            memo.trim()
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of it (0 for null and empty)."""
    name, held = _encoder(df.sparkSession, tokenizer, tokenizer_dir)
    rest = [c for c in df.columns if c != text]

    def run(batches):
        import regex

        memo, split = _memo(held, name), regex.compile(PATTERN).findall
        for batch in batches:
            ns = [sum(map(len, map(memo.__getitem__, split(x)))) if x else 0 for x in _texts(batch.column(len(rest)))]
            memo.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(ns, pa.int64())], names=[*rest, out])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]
    return df.select(*rest, F.col(text)).mapInArrow(run, ", ".join([*fields, f"`{out}` bigint"]))
