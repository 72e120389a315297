"""Manifests and the parser registry: small configuration, read on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from recollect.schemas import INDEXABLE_TYPES, PARSE_LATER_TYPES
from recollect.sources.files import document_records
from recollect.sources.sessions import session_records

Parser = Callable[..., DataFrame]
PARSERS: dict[str, Parser] = {}


def register(source_type: str) -> Callable[[Parser], Parser]:
    """Register a function (spark, path, project, source_tool, privacy_scope) -> records for a source type."""

    def put(f: Parser) -> Parser:
        PARSERS[source_type] = f
        return f

    return put


register("project_docs")(document_records)
register("agent_session")(session_records)


@dataclass(frozen=True)
class Source:
    source_type: str
    source_path: str
    source_tool: str = ""
    privacy_scope: str = "local_only"
    description: str = ""


@dataclass(frozen=True)
class Manifest:
    project: str
    sources: tuple[Source, ...]
    base: str = "."


def parse_manifest(data: dict, base: str = ".") -> Manifest:
    """A checked manifest; ValueError names what is wrong."""
    if data.get("manifest_version") != "1":
        raise ValueError("manifest_version must be '1'")
    project = data.get("project")
    if not isinstance(project, str) or not project.strip():
        raise ValueError("project must be a non-empty string")
    rows = data.get("sources")
    if not isinstance(rows, list) or not rows:
        raise ValueError("sources must be a non-empty list")
    sources = []
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            raise ValueError(f"sources[{i}] must be an object")
        kind, path = row.get("source_type"), row.get("source_path")
        if kind not in (*INDEXABLE_TYPES, *PARSE_LATER_TYPES):
            raise ValueError(f"sources[{i}]: unknown source_type {kind!r}")
        if not isinstance(path, str) or not path.strip():
            raise ValueError(f"sources[{i}]: source_path must be a non-empty string")
        sources.append(Source(kind, path, *(str(row.get(k) or d) for k, d in (("source_tool", ""), ("privacy_scope", "local_only"), ("description", "")))))
    return Manifest(project.strip(), tuple(sources), base)


def load_manifest(path: str) -> Manifest:
    with open(path, encoding="utf-8") as f:
        return parse_manifest(json.load(f), os.path.dirname(os.path.abspath(path)))


def located(path: str, manifest_dir: str, project_root: str) -> str:
    """An absolute path as it is; a relative one next to the manifest if it is there, else below the project root."""
    if os.path.isabs(path):
        return path
    near = os.path.join(manifest_dir, path)
    return near if os.path.exists(near) else os.path.join(project_root, path)


def ingest(spark: SparkSession, manifest: Manifest, project_root: str) -> tuple[DataFrame | None, list[dict[str, str]]]:
    """Records of all sources to index now, and what became of each source.

    One source's failure does not stop the others: it is reported as an error.
    """
    records, report = None, []
    for s in manifest.sources:
        path = located(s.source_path, manifest.base, project_root)
        row = {"source_type": s.source_type, "source_path": path}
        if s.source_type in PARSE_LATER_TYPES:
            report.append(row | {"bucket": "parse_later"})
        elif not os.path.exists(path):
            report.append(row | {"bucket": "skipped", "reason": "path not found"})
        elif s.source_type not in PARSERS:
            report.append(row | {"bucket": "skipped", "reason": "no parser"})
        else:
            try:
                found = PARSERS[s.source_type](spark, path, manifest.project, s.source_tool, s.privacy_scope)
            except (AnalysisException, OSError, ValueError) as e:
                report.append(row | {"bucket": "errors", "reason": str(e)[:200]})
                continue
            records = found if records is None else records.unionByName(found)
            report.append(row | {"bucket": "index_now"})
    return records, report
