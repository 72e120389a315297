"""Heading-aware chunks of bounded size: sequential by nature, so one Arrow batch function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import ids
from recollect.functions.text import token_estimate
from recollect.workers import SLICE_BYTES, ship, slices

_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")


def split_text(text: str, max_chars: int) -> Iterator[tuple[str, str | None]]:
    """Chunks of a text with the path of headings they stand under.

    A heading starts a chunk. A line that would make the chunk longer than the bound starts
    one too; a single line is never split, so a chunk may be longer than the bound.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    size, under = 0, None

    def ready() -> list[tuple[str, str | None]]:
        body = "\n".join(lines).strip()
        return [(body, under)] if body else []

    for line in text.split("\n") if text else ():
        if m := _HEADING.match(line):
            yield from ready()
            lines, size = [], 0
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, m[2].strip())]
            under = " > ".join(title for _, title in path)
        elif lines and size + len(line) > max_chars:
            yield from ready()
            lines, size = [], 0
        lines.append(line)
        size += len(line) + 1
    yield from ready()


def chunk(docs: DataFrame, text: str = "text", max_chars: int = 1200, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row for each chunk: the kept columns, chunk_index, heading_path, content, content_hash, token_count."""
    ship(docs)
    fields = [f for f in docs.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            row, index, heading, body, held = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(len(keep))), pa.array(index, pa.int32()), pa.array(heading, pa.string()), pa.array(body, pa.string())], [*keep, "chunk_index", "heading_path", "content"])

            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                for k, (content, under) in enumerate(split_text(t or "", max_chars)):
                    row.append(i)
                    index.append(k)
                    heading.append(under)
                    body.append(content)
                    held += len(content) + len(under or "")
                    if held >= SLICE_BYTES:  # paths of headings may be longer than the text
                        yield made()
                        row, index, heading, body, held = [], [], [], [], 0
            yield made()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", chunk_index int, heading_path string, content string"
    out = docs.select(*keep, F.col(text)).mapInArrow(run, schema)
    return out.withColumn("content_hash", ids.content_hash("content")).withColumn("token_count", token_estimate("content"))
