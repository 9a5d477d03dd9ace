"""Long texts in overlapping chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame


def cut_places(text: str, size: int, overlap: int = 500) -> list[tuple[int, int]]:
    """(from, to) of each chunk: up to the last paragraph end or else full stop past the middle, the next one begins ``overlap`` before."""
    n, at, out = len(text), 0, []
    while at < n:
        end = at + size
        if end >= n:
            out.append((at, n))
            break
        middle = at + size * 0.5
        stop = text.rfind("\n\n", 0, end + 2)
        if stop <= middle:
            stop = max(text.rfind("。", 0, end + 1), text.rfind(". ", 0, end + 2))
            stop = stop + 1 if stop > middle else end
        out.append((at, stop))
        back = stop - overlap
        at = back if back > at else stop
    return out or [(0, n)]


def chunked(df: DataFrame, key: str, text: str, size: int = 10_000, overlap: int = 500) -> DataFrame:
    """key, chunk_pos, start, chunk; a null text has none, an empty text one empty chunk. ``size`` is 1000 at least."""
    kind, size = df.schema[key].dataType.simpleString(), max(1000, size)

    def run(batches):
        for batch in batches:
            rows, pos, start, parts = [], [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for p, (a, b) in enumerate(cut_places(x, size, overlap) if x is not None else ()):
                    rows.append(i)
                    pos.append(p)
                    start.append(a)
                    parts.append(x[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(parts, pa.string())], names=[key, "chunk_pos", "start", "chunk"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_pos int, start int, chunk string")
