"""A store of versioned Parquet tables: every change is a new version, named by one small file.

A table is a list of folders, each written by one job: <root>/<table>/v=<n>-<key>/. The version
file <root>/history/<n>.json names the folders of all tables. It is created last and never
replaced, so readers see all of a change or nothing. The greatest complete file is the version
in force. Paths go through Hadoop's file system, so the store can lie on any that Spark reads.

* Appended rows are a folder of their own, so an append writes its rows and one version file. It
  holds nothing that another change could contradict: if another version came first, the
  same folder goes into the next one. Every FAN folders of a level are merged into one of the next.
* Rows that a change replaces are looked up by key. The files that hold some are written anew
  without them and left out of their folders from then on; all other files stay.
* A change made from a state that is no longer in force fails with ConflictError. `change` makes
  it again from the new state.
* A change can carry the number of a stream's batch; a batch that is in already is passed by.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import ids
from recollect.operators.refresh import upsert
from recollect.schemas import KEYS, SCHEMA_VERSION, TABLES

#: Folders of one level that become one of the next.
FAN = 16


class ConflictError(RuntimeError):
    """Another writer has published a version meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, at: str) -> str | None:
        fs, p = self._fs(), self._path(at)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, at: str, text: str) -> None:
        """A new file; ConflictError if there is one already."""
        fs, to = self._fs(), self._path(at)
        if fs.exists(to):
            raise ConflictError(at)
        try:
            out = fs.create(to, False)
        except Exception as e:
            raise ConflictError(at) from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    # versions

    def _state(self, version: int) -> dict | None:
        """A version's tables, or None if its file is not there or was not written to its end."""
        text = self._read(f"{self.root}/history/{version:010d}.json")
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None

    def current(self) -> dict:
        for version in self._versions():
            if state := self._state(version):
                return state
        return {"n": 0, "tables": {}}

    def _versions(self) -> list[int]:
        fs, at = self._fs(), self._path(f"{self.root}/history")
        if not fs.exists(at):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(at))
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def init(self) -> None:
        """Create every table that is not there yet; safe to repeat."""
        self.change(lambda base: {t: [] for t in TABLES if t not in base["tables"]})

    def exists(self, table: str) -> bool:
        return table in self.current()["tables"]

    # folders

    @staticmethod
    def _folders(state: dict, table: str) -> list[dict]:
        """at, level and the names of files left out, of each folder; a plain name is a folder of an earlier store."""
        held = state["tables"].get(table, [])
        return [{"at": held, "level": 0, "without": []}] if isinstance(held, str) else held

    def _names(self, table: str, folder: dict) -> list[str]:
        found = self._fs().listStatus(self._path(f"{self.root}/{table}/v={folder['at']}"))
        names = (s.getPath().getName() for s in found)
        return [n for n in names if not n.startswith(("_", ".")) and n not in folder["without"]]

    def _rows(self, table: str, folders: list[dict]) -> DataFrame:
        paths = []
        for f in folders:
            at = f"{self.root}/{table}/v={f['at']}"
            paths += [f"{at}/{n}" for n in self._names(table, f)] if f["without"] else [at]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        """A table as it is now, or in a given state; an absent one is empty."""
        return self._rows(table, self._folders(state or self.current(), table))

    def write(self, table: str, rows: DataFrame, level: int = 0) -> dict:
        """A new folder with these rows; it is in no version yet."""
        at = f"{(self._versions() or [0])[0] + 1}-{uuid.uuid4().hex[:12]}"
        names = [f.strip().split(" ")[0] for f in _fields(TABLES[table])]
        rows.select(*names).write.parquet(f"{self.root}/{table}/v={at}")
        return {"at": at, "level": level, "without": []}

    def appended(self, base: dict, table: str, folder: dict) -> list[dict]:
        return [*self._folders(base, table), folder]

    def replaced(self, base: dict, table: str, keys: DataFrame, key: str, new: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """The table's folders after the rows of some keys (a column `key`) change.

        new gets the rows of the files that hold one of the keys, and returns what takes their place.
        """
        folders = self._folders(base, table)
        old = self._rows(table, folders)
        wanted = keys.select(F.col(key).alias("_key")).distinct()
        hit = old.withColumn("_file", F.col("_metadata.file_path")).join(wanted, F.col(key) == F.col("_key"), "left_semi").select("_file").distinct() if folders else None
        touched = {tuple(r["_file"].rsplit("/", 2)[-2:]) for r in hit.collect()} if folders else set()  # names of files
        left, out = [], []
        for f in folders:
            own = {name for folder, name in touched if folder == f"v={f['at']}"}
            if not own:
                out.append(f)
                continue
            left += [f"{self.root}/{table}/v={f['at']}/{n}" for n in sorted(own)]
            rest = f | {"without": sorted({*f["without"], *own})}
            if self._names(table, rest):
                out.append(rest)
        rows = self.spark.read.schema(TABLES[table]).parquet(*left) if left else self.spark.createDataFrame([], TABLES[table])
        return [*out, self.write(table, new(rows))]

    def _compacted(self, table: str, folders: list[dict]) -> list[dict]:
        """Every FAN folders of the lowest full level become one of the next."""
        for level in sorted({f["level"] for f in folders}):
            own = [f for f in folders if f["level"] == level]
            if len(own) >= FAN:
                return [*(f for f in folders if f["level"] != level), self.write(table, self._rows(table, own), level + 1)]
        return folders

    # changes

    def commit(self, base: dict, folders: dict[str, list[dict]], stream: tuple[str, int] | None = None) -> int:
        """The version after `base`, in which some tables have other folders; ConflictError if it is not the next one any more."""
        now = self.current()
        if now["n"] != base["n"]:
            raise ConflictError(f"version {now['n']} has come since {base['n']}")
        n = max([base["n"], *self._versions()[:1]]) + 1
        streams = base.get("streams", {}) | ({stream[0]: stream[1]} if stream else {})
        state = {"n": n, "schema_version": SCHEMA_VERSION, "tables": base["tables"] | folders, "streams": streams}
        self._create(f"{self.root}/history/{n:010d}.json", json.dumps(state))
        return n

    def change(self, make: Callable[[dict], dict[str, list[dict]]], stream: tuple[str, int] | None = None, attempts: int = 20) -> int:
        """Commit what `make` makes of the state in force; if another version comes first, make it again from that one."""
        for left in range(attempts, 0, -1):
            base = self.current()
            if stream and base.get("streams", {}).get(stream[0], -1) >= stream[1]:
                return base["n"]
            try:
                folders = make(base)
                return self.commit(base, folders, stream) if folders else base["n"]
            except ConflictError:
                if left == 1:
                    raise
        return 0

    def append(self, tables: dict[str, DataFrame]) -> int:
        """Add rows to tables, in one version. What is written grows with the rows, not with the tables."""
        new = {t: self.write(t, df) for t, df in tables.items()}
        n = self.change(lambda base: {t: self.appended(base, t, f) for t, f in new.items()})
        for t in tables:
            if max(Counter(f["level"] for f in self._folders(self.current(), t)).values(), default=0) >= FAN:
                self.change(lambda base, t=t: {t: self._compacted(t, self._folders(base, t))})
        return n

    def merge(self, table: str, new: DataFrame, key: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Rows replace those of their key, except for the time of creation. Only files that hold such rows are written anew."""
        key = key or KEYS[table]
        return self.change(lambda base: {table: self.replaced(base, table, new, key, lambda old: upsert(old, new, key))}, stream)

    def publish(self, tables: dict[str, DataFrame], base: dict | None = None) -> int:
        """New contents for whole tables, in one version.

        base: the state that the tables were made from (by default the present one); if another
        version has come since, ConflictError, and nothing changes.
        """
        base = base or self.current()
        if self.current()["n"] != base["n"]:
            raise ConflictError(f"version {self.current()['n']} has come since {base['n']}")
        return self.commit(base, {t: [self.write(t, df)] for t, df in tables.items()})

    def backups(self) -> list[int]:
        """Versions that can be restored, newest first."""
        return [v for v in self._versions() if self._state(v)]

    def restore(self, version: int) -> int:
        """Point at an earlier version's tables again; the present one stays restorable."""
        if version not in self.backups():
            raise LookupError(f"no version {version}")
        state = self._state(version) | {"n": max(self._versions()) + 1, "streams": self.current().get("streams", {})}
        self._create(f"{self.root}/history/{state['n']:010d}.json", json.dumps(state))
        return state["n"]

    def vacuum(self, keep: int = 10) -> int:
        """Delete version files but for the newest `keep`, and folders that no kept version names; how many folders went.

        Not for times at which others write: a folder is written before its version.
        """
        fs, kept = self._fs(), self.backups()[:keep]
        named = {(t, f["at"]) for v in kept for t in TABLES for f in self._folders(self._state(v), t)}
        for v in self._versions():
            if v not in kept and v < kept[0]:
                fs.delete(self._path(f"{self.root}/history/{v:010d}.json"), False)
        gone = 0
        for t in TABLES:
            at = self._path(f"{self.root}/{t}")
            for s in fs.listStatus(at) if fs.exists(at) else ():
                if (t, s.getPath().getName().removeprefix("v=")) not in named:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone

    # export

    def export(self, path: str, tables: tuple[str, ...] = tuple(TABLES)) -> None:
        """One row of JSON for each row of each table: {"version", "table", "row"}, partitioned by table."""
        for t in tables:
            df = self.read(t)
            df.select(F.lit("1").alias("version"), F.to_json(F.struct(*df.columns)).alias("row")).write.mode("overwrite").json(f"{path}/table={t}")

    def load_export(self, path: str) -> int:
        """Replace or add rows by key from an export; ValueError for another version or rows without a key."""
        fs, base = self._fs(), self.current()
        new = {}
        for t, schema in TABLES.items():
            at = f"{path}/table={t}"
            if not fs.exists(self._path(at)):
                continue
            raw = self.spark.read.schema("version string, row string").json(at)
            if not raw.where("version is null or version <> '1'").isEmpty():
                raise ValueError("unsupported export version")
            rows = raw.select(F.from_json("row", schema).alias("r")).select("r.*")
            if not rows.where(F.col(KEYS[t]).isNull()).isEmpty():
                raise ValueError(f"{t}: a row without {KEYS[t]}")
            old = self.read(t, base)
            new[t] = old.join(rows.select(F.col(KEYS[t]).alias("_k")), F.col(KEYS[t]) == F.col("_k"), "left_anti").unionByName(rows)
        return self.publish(new, base) if new else base["n"]


def _fields(schema: str) -> list[str]:
    """The fields of a DDL string, not cutting inside angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n and a digest of all rows that does not depend on their order or on the order of columns.

    Row digests are added up as four numbers of 64 bits modulo 2^64 each (as decimals), so nothing is gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts).cast("binary"), 256).alias("fingerprint"))


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns) and fingerprint(a).collect() == fingerprint(b).collect()


ENVELOPE = "schema_version string, exported_at string, metadata string, record string"


def envelope(records: DataFrame, exported_at: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Records of a memory export in an envelope, a line each (ENVELOPE columns, the record as JSON)."""
    record = F.to_json(F.struct(*records.columns))
    return records.select(F.lit("1").alias("schema_version"), F.lit(exported_at).alias("exported_at"), F.lit(json.dumps(metadata or {}, sort_keys=True)).alias("metadata"), record.alias("record"))


def open_envelope(lines: DataFrame, schema: str) -> DataFrame:
    """The records of an envelope. ValueError for another schema version, a missing time or a record that is no object."""
    bad = lines.where("schema_version is null or schema_version <> '1' or coalesce(trim(exported_at), '') = '' or coalesce(trim(record), '') not like '{%'")
    if not bad.isEmpty():
        raise ValueError("not a valid export envelope")
    return lines.select(F.from_json("record", schema).alias("r")).select("r.*")


def legacy_text(texts: DataFrame, text: str, metadata: dict | None, now) -> DataFrame:
    """A row for the plain text table: the text stripped, metadata as JSON with sorted keys, the next free id."""
    if not text.strip():
        raise ValueError("text cannot be empty")
    row = texts.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    return row.select("id", F.lit(text.strip()).alias("text"), F.lit(json.dumps(metadata or {}, sort_keys=True)).alias("metadata"), now.alias("created_at"))


def new_memory(spark: SparkSession, content: str, now, memory_type: str = "note", title: str | None = None, status: str = "active", source_kind: str = "manual", created_by: str = "user", project_id: str = "default") -> DataFrame:
    """One memory row, checked; its id follows from project, content and time."""
    from recollect.functions.text import first_line_title
    from recollect.schemas import MEMORY_STATUSES

    content = content.strip()
    if not content:
        raise ValueError("content cannot be empty")
    if status not in MEMORY_STATUSES:
        raise ValueError(f"status must be one of {', '.join(MEMORY_STATUSES)}")
    none = F.lit(None).cast("string")
    c = F.lit(content)
    key = F.substring(F.sha2(F.concat_ws("|", F.lit(project_id), c, now.cast("string")).cast("binary"), 256), 1, 32)
    return spark.range(1).select(
        F.concat(F.lit("mem_"), key).alias("id"), F.lit(project_id).alias("project_id"), F.lit(memory_type).alias("type"), (F.lit(title.strip()) if title and title.strip() else first_line_title(c)).alias("title"), c.alias("content"), F.lit(status).alias("status"), F.lit(source_kind).alias("source_kind"),
        none.alias("source_document_id"), none.alias("source_chunk_id"), none.alias("source_path"), ids.content_hash(c).alias("content_hash"), F.lit(created_by).alias("created_by"), none.alias("model_name"), F.lit(None).cast("double").alias("confidence"), now.alias("created_at"), now.alias("updated_at"),
    )
