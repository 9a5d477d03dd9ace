"""Claims of a text that can be checked, and where a source has them."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quernstone.functions.text import BLANK

#: What makes a claim, in the order in which it is looked for.
NUMERIC = [
    r"(?:约|近|超|达|不足)?百分之[\d一二三四五六七八九十百千]+", r"(?:约|近|超|达|不足)?\d+(?:\.\d+)?%",
    r"\d+(?:\.\d+)?\s*(?:万亿|万|亿|千|百)?(?:美元|欧元|日元|英镑|人民币|元|美元|人|个|年|月|天|小时|kg|km|m|cm|mm)",
    r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}", r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{1,2}月\d{1,2}日", r"\d{4}[-/年]\d{1,2}", r"(?:第[一二三四五六七八九十\d]+|[一二三四五六七八九十]+倍|\d+倍|\d+番)",
]
ENTITY = [
    r"[一-鿿]{2,6}(?:公司|机构|大学|学院|集团|基金|协会|部门|委员会|平台|系统|框架|协议|标准|组织|银行|医院|研究所|实验室)",
    r"[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+",
]
CAUSAL = ["导致", "使得", "造成", "引起", "证明", "发现", "表明", "显示", "研究结果", "数据表明", "统计显示", "调查指出", "报告指出", "因此", "所以", "由此可见", "这说明了", "这意味着"]
CAUSAL_SIGNS, CAUSAL_KEY, MOST = 8, 30, 30


_SPLIT, _CAUSE = re.compile(r"[。！？\n.!?]+"), re.compile("|".join(CAUSAL))
#: What a sentence has at least if the patterns beside it match: most sentences are passed over.
_ANCHORS = [
    (re.compile(r"百分之|[第倍]|\d", re.ASCII), "numeric", [(i, re.compile(x, re.ASCII)) for i, x in enumerate(NUMERIC)]),
    (re.compile(r"[A-Z][a-z]|[一-鿿]{4}"), "entity", [(len(NUMERIC) + i, re.compile(x, re.ASCII)) for i, x in enumerate(ENTITY)]),
]


def _claims(text: str) -> list[tuple[tuple[int, int, int], str, str, str]]:
    """(place, claim, anchor, kind) of every claim of a text, in order; place: sentence, pattern, match."""
    out = []
    for at, s in enumerate(x for x in (x.strip(" ") for x in _SPLIT.split(text)) if len(x) >= 3):
        short = s[:80] + "..." if len(s) > 80 else s
        for least, kind, patterns in _ANCHORS:
            if least.search(s):
                out += [((at, i, n), short, a, kind) for i, pattern in patterns for n, a in enumerate(pattern.findall(s))]
        if len(s) >= CAUSAL_SIGNS and _CAUSE.search(s):
            out.append(((at, 99, 0), short, s[:CAUSAL_KEY], "causal"))
    return out


NUMBERS = ("pos", "row")  # fields that are numbers, other ones are texts


def _array(rows: list[list | None], names: list[str]) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    flat = [x for r in rows for x in r or ()]
    columns = [pa.array([x[i] for x in flat], pa.int32() if n in NUMBERS else pa.string()) for i, n in enumerate(names)]
    ends = np.cumsum([0, *(len(r or ()) for r in rows)])
    offsets = pa.array([None if k < len(rows) and rows[k] is None else e for k, e in enumerate(ends.tolist())], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=names))


def _shape(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, IntegerType() if n in NUMBERS else StringType()) for n in names]))


def _once(udf):
    """So that the planner copies no call into the filters it infers: each would be run again."""
    return udf.asNondeterministic()


@F.arrow_udf(_shape("claim", "anchor", "kind"))
def claims(text: pa.Array) -> pa.Array:
    """Array of (claim, anchor, kind): numbers, names, then causes of each sentence.

    Sentences end at every full stop, also that of a decimal.
    """
    return _array([None if t is None else [c[1:] for c in _claims(t)] for t in text.to_pylist()], ["claim", "anchor", "kind"])


@_once
@F.arrow_udf(_shape("pos", "anchor", "kind"))
def note_claims(contents: pa.Array) -> pa.Array:
    """(pos, anchor, kind) of the claims of a note, whose contents are an array: each anchor once, 30 at most."""
    out = []
    for texts in contents.to_pylist():
        first = {}
        for _, anchor, kind in sorted(((c[0], *c[2:]) for t in sorted(texts) for c in _claims(t)), key=lambda c: c[0]):
            first.setdefault(anchor, kind)
        out.append([(i, a, k) for i, (a, k) in enumerate(list(first.items())[:MOST], 1)])
    return _array(out, ["pos", "anchor", "kind"])


#: Ends of a sentence, and the length a sentence around an anchor is cut at.
_ENDS, CONTEXT = r"。！？\n.!?", 200
_END, _NUMBER = re.compile(rf"[{_ENDS}]"), re.compile(r"\d+(?:\.\d+)?", re.ASCII)
_EDGE = re.compile(rf"\A{BLANK}+|{BLANK}+\Z", re.ASCII)


def _context(source: str, at: int, length: int) -> str:
    """The sentence around the place ``at`` (from 0), its end included, cut at 200 signs."""
    end = _END.search(source, at + length)
    whole = _EDGE.sub("", source[max(source.rfind(x, 0, at) for x in "。！？\n.!?") + 1 : end.end() if end else len(source)])
    return whole[:CONTEXT] + "..." if len(whole) > CONTEXT else whole


def _trace(anchor: str, kind: str, source: str, numbers: list[tuple[str, float]]) -> tuple[str, str | None, str | None]:
    if (at := source.find(anchor)) >= 0:
        return "traced", _context(source, at, len(anchor)), None
    if kind == "numeric":
        if own := _NUMBER.search(anchor):
            n = float(own[0])
            for like, x in numbers:
                if x == n or abs(x - n) / (abs(n) or 1.0) < 0.05:
                    return "traced", _context(source, source.find(like), len(like)), None if x == n else like
        return "out of scope", None, None
    part = anchor[: max(2, math.ceil(len(anchor) * 0.6))]
    if (at := source.find(part)) >= 0:
        return "compare", _context(source, at, len(part)), part
    return "out of scope", None, None


@F.arrow_udf(StructType([StructField(x, StringType()) for x in ("status", "sentence", "differs")]))
def traced(anchor: pa.Array, kind: pa.Array, source: pa.Array) -> pa.Array:
    """(status, sentence, differs) of a claim: where the source has the anchor, else a number equal to it or
    within 5 % (the first such one), else, of names and causes, the first six tenths of the anchor.

    status is traced, compare or out of scope; differs holds what was found in
    place of the anchor. A null source has nothing. A source's numbers are read
    once for the claims on it that follow each other.
    """
    out, last, numbers = [], None, []
    for a, k, s in zip(anchor.to_pylist(), kind.to_pylist(), source.to_pylist()):
        if a is None or k is None or s is None:
            out.append(("out of scope", None, None))
            continue
        if k == "numeric" and s != last:
            last, numbers = s, [(x, float(x)) for x in _NUMBER.findall(s)]
        out.append(_trace(a, k, s, numbers))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["status", "sentence", "differs"])


@_once
@F.arrow_udf(_shape("pos", "row", "anchor", "kind", "status", "sentence", "differs"))
def traced_notes(found: pa.Array, texts: pa.Array) -> pa.Array:
    """The claims of a note (``note_claims``) in each of its sources' ``texts``, by place, then source (row, from 0)."""
    out = []
    for claims_, sources in zip(found.to_pylist(), texts.to_pylist()):
        numbers = [[(x, float(x)) for x in _NUMBER.findall(t)] if any(c["kind"] == "numeric" for c in claims_) else [] for t in sources]
        out.append([(c["pos"], i, c["anchor"], c["kind"], *_trace(c["anchor"], c["kind"], t, numbers[i])) for c in claims_ for i, t in enumerate(sources)])
    return _array(out, ["pos", "row", "anchor", "kind", "status", "sentence", "differs"])


_BLANKS = re.compile(r"\s+", re.ASCII)
LOOKED = ["pos", "status", "sentence", "differs"]


@_once
@F.arrow_udf(_shape(*LOOKED))
def _looked(found: pa.Array, texts: pa.Array, said: pa.Array) -> pa.Array:
    out = []
    for claims_, sources, answers in zip(found.to_pylist(), texts.to_pylist(), said.to_pylist()):
        flat, best, index, rows = [None if t is None else _BLANKS.sub("", t) for t in sources], {}, 0, []
        for a in answers or ():
            if a is not None:  # of several on one claim the greatest, nulls before all else
                key = tuple((x is not None, x or "") for x in (a["status"], a["source_text"]))
                best[a["index"]] = max(best.get(a["index"], key), key)
        for c in claims_:
            if c["status"] != "out of scope":
                rows.append(tuple(c[x] for x in LOOKED))
                continue
            (_, status), (_, quoted) = best.get(index, ((False, ""), (False, "")))
            index += 1
            bare, text = _BLANKS.sub("", quoted), flat[c["row"]]
            good = status in ("traced", "compare") and bare and text is not None and bare in text
            rows.append((c["pos"], status, quoted, None) if good else (c["pos"], "out of scope", None, None))
        out.append(rows)
    return _array(out, LOOKED)


def second_look(found: Column, texts: Column, answer: Column) -> Column:
    """Array of (pos, status, sentence, differs): the traced claims of a note after a model's ``answer`` on those out of scope.

    ``found``: an array with pos, row (which of ``texts`` is its source),
    status, sentence, differs, in order. An answer is a JSON array of index
    (from 0, among the note's claims out of scope in order), status and
    source_text. A status that is not known, a quotation that is not in the
    source but for its blanks, and a missing or broken answer leave the claim
    out of scope. A text loses its blanks once for all its claims.
    """
    shape = "array<struct<index:int,status:string,source_text:string>>"
    return _looked(found, texts, F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), shape))


def compared(claims_: DataFrame, answers: DataFrame) -> DataFrame:
    """What a second look at the claims out of scope found: ``answers`` (note_id, answer; one of each note) are texts of a model.

    ``claims_``: note_id, pos, status, sentence, differs, text (the source); see ``second_look``.
    """
    each = claims_.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("pos", "status", "sentence", "differs", "text"))).alias("c"))
    found = F.transform("c", lambda c, i: F.struct(c["pos"].alias("pos"), i.alias("row"), c["status"].alias("status"), c["sentence"].alias("sentence"), c["differs"].alias("differs")))
    looked = each.join(answers, "note_id", "left").select("note_id", second_look(found, F.col("c.text"), F.col("answer")).alias("l"))
    return looked.select("note_id", F.explode("l").alias("l")).select("note_id", "l.*")
