"""The Markdown sidecar of a digitised document: objects and regions in comment markers with a JSON payload."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OBJECT, REGION, END = "object", "region", "end"
TRANSIENT = ("queued", "running")
_marker = re.compile(r"<!--\s*(object|region|end)\s*:?\s*(\{.*?\})?\s*-->\n?", re.S)
REGION_FIELDS = "source string, object_no int, object_type string, region_no int, kind string, field string, page int, rect array<double>, rotation int, status string, payload string, text string"


def parse(source: str, text: str) -> list[tuple]:
    """Regions of a sidecar in order; states that don't outlast a session become pending."""
    rows, kind, number, open_, at = [], None, 0, None, 0
    for m in _marker.finditer(text):
        name, body = m[1], json.loads(m[2]) if m[2] else {}
        if open_ is not None:
            open_["text"] = text[at : m.start()].strip()
            rows.append(open_)
            open_ = None
        if name == OBJECT:
            number, kind = number + 1, body.get("type")
        elif name == REGION:
            status = body.get("status", "pending")
            open_ = {"object": number, "type": kind, **body, "status": "pending" if status in TRANSIENT else status}
        at = m.end()
    if open_ is not None:
        rows.append({**open_, "text": text[at:].strip()})
    counts: dict[int, int] = {}
    out = []
    for r in rows:
        counts[r["object"]] = counts.get(r["object"], 0) + 1
        rest = {k: v for k, v in r.items() if k not in ("object", "type", "text")}
        out.append((source, r["object"], r["type"], counts[r["object"]], r.get("kind"), r.get("field"), r.get("page"), [float(x) for x in r.get("rect", [])], r.get("rotation", 0), r["status"], json.dumps(rest, ensure_ascii=False, sort_keys=True), r["text"]))
    return out


def serialize(rows: list[tuple]) -> str:
    """The canonical sidecar of parse()'s rows."""
    out, seen = [], 0
    for _, number, kind, *_, payload, text in sorted(rows, key=lambda r: (r[1], r[3])):
        if number != seen:
            out.append(f"<!-- object: {json.dumps({'type': kind}, ensure_ascii=False)} -->")
            seen = number
        out += [f"<!-- region: {payload} -->", text, "<!-- end -->"]
    return "\n".join(out) + "\n"


def regions(files: DataFrame) -> DataFrame:
    """Regions of sidecars given as (source, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in REGION_FIELDS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([r for s, t in zip(frame["source"], frame["text"]) for r in parse(s, t)], columns=names)

    return files.select("source", "text").mapInPandas(run, REGION_FIELDS)


def render_prompt(template: str, values: dict[str, str]) -> str:
    """{name} replaced by values; an unknown name is an error."""
    def put(m: re.Match) -> str:
        if m[1] not in values:
            raise KeyError(f"unknown prompt variable: {m[1]}")
        return values[m[1]]

    return re.sub(r"\{(\w+)\}", put, template)
