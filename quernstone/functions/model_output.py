"""Notes and scores out of what a model answers."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a model says that there is nothing to extract.
REFUSED = re.compile("无符合标准的原子笔记|无法提炼|没有符合标准")
_FENCE = re.compile(r"```[\w-]*\s*\n([\s\S]*?)\n?```")


def balanced(text: str, opening: str) -> str | None:
    """The first balanced object or array, brackets within strings aside."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening)
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[" and c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def as_json(text: str, opening: str):
    """The first fenced or bare object or array, parsed; None if there is none."""
    m = _FENCE.search(text)
    for t in ([m.group(1)] if m else []) + [text]:
        part = balanced(t, opening)
        if part:
            try:
                return json.loads(part)
            except ValueError:
                continue
    return None


def unquoted(s: str) -> str:
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


def tags_of(raw) -> list[str]:
    """Tags from a list or a string with commas, brackets and quotes."""
    parts = raw if isinstance(raw, list) else re.split("[,，]", re.sub(r"^\[|\]$", "", str(raw or "")))
    bare = (re.sub(r"^[\"']|[\"']$", "", re.sub(r"^\[|\]$", "", str(p).strip())) for p in parts)
    return [b for b in bare if b]


def _note(title="", content="", tags=None, source=None) -> dict:
    return {"title": str(title or "").strip(), "content": str(content or "").strip(), "tags": tags_of(tags), "source": unquoted(str(source).strip()) if source else None}


def _from_json(text: str) -> list[dict] | None:
    at, ar = text.find("{"), text.find("[")
    found = None
    if at >= 0 and (ar < 0 or at < ar):
        got = as_json(text, "{")
        found = got.get("notes") if isinstance(got, dict) and isinstance(got.get("notes"), list) else None
    if found is None and ar >= 0:
        got = as_json(text, "[")
        found = got if isinstance(got, list) and (not got or any(isinstance(x, dict) for x in got)) else None
    if found is None:
        return None
    return [_note(x.get("title"), x.get("content"), x.get("tags"), x.get("source")) for x in found if isinstance(x, dict) and (x.get("title") or x.get("content"))]


def _from_frontmatter(text: str) -> list[dict]:
    out = []
    parts = re.split(r"(?m)^---[ \t]*$", text)
    for head, body in zip(parts[1::2], parts[2::2]):
        fields = dict(re.findall(r"(?m)^(title|source|tags):[ \t]*(.+)$", head))
        note = _note(unquoted(fields.get("title", "").strip()), body, fields.get("tags"), fields.get("source"))
        if note["title"] or note["content"]:
            out.append(note)
    return out


def _from_list(text: str) -> list[dict]:
    out = []
    for part in re.split(r"\n(?=\d+[.、]\s|#{1,3}\s|\*\*)", text):
        lines = part.strip().split("\n")
        m = re.match(r"(?:\d+[.、]\s+\**([^*\n]+)\**|#{1,3}\s+(.+)|\*\*(.+?)\*\*)\s*$", lines[0].strip())
        title = next((g for g in m.groups() if g), "") if m else ""
        rest, tags, source = [], None, None
        for line in lines[1 if m else 0 :]:
            if t := re.match(r"\s*tags?:\s*(.+)", line):
                tags = t.group(1)
            elif s := re.match(r"\s*(?:source|来源)[:：]\s*(.+)", line):
                source = s.group(1)
            else:
                rest.append(line)
        note = _note(title, "\n".join(rest), tags, source)
        if note["content"]:
            out.append(note)
    return out


def parse_notes(text: str | None) -> list[dict]:
    """The notes of an answer: JSON, else blocks with frontmatter, else a list; none of a refusal."""
    bare = (text or "").strip()
    fence = _FENCE.search(bare)
    inner = fence.group(1).strip() if fence else bare
    if not bare or REFUSED.search(inner):
        return []
    found = _from_json(bare)
    if found is not None:
        return found
    return _from_frontmatter(inner) or _from_list(inner) or [_note("", inner)]


NOTE = "array<struct<title:string,content:string,tags:array<string>,source:string>>"


def parsed_notes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and the fields of each note of each answer; a null answer has none."""
    kind = df.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("title", pa.string()), ("content", pa.string()), ("tags", pa.list_(pa.string())), ("source", pa.string())]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_notes(x) for x in batch.column(1).to_pylist()], shape)], names=[key, "notes"])

    got = df.select(key, text).mapInArrow(run, f"`{key}` {kind}, notes {NOTE}")
    return got.select(key, F.posexplode("notes").alias("pos", "n")).select(key, "pos", "n.*")
