"""Refresh that opens only what changed, pruned walks, isolated errors, counters, appends and merges, session logs in splits."""

import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect.engine import MemoryEngine
from recollect.operators import entries, vector_store
from recollect.schemas import CATALOG, TABLES
from recollect.scratch import Scratch
from recollect.sources import files, sessions, walk
from recollect.sources.store import FAN, ConflictError, Store
from recollect.streaming import streams

NOW = datetime(2026, 1, 2)


def _write(path, text, time=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    if time:
        os.utime(path, (time, time))


def _catalog(spark, rows):
    return spark.createDataFrame([(i, kind, path, None, ["x"], "confirmed", "local_only", 1.0, 1) for i, kind, path in rows], CATALOG)


def _tree(root):
    return sorted((os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(root) for n in names)


# --- refresh


def test_one_changed_file_of_a_thousand_is_opened(spark, tmp_path):
    root = tmp_path / "app"
    for i in range(1000):
        _write(str(root / f"d{i % 20}/f{i}.md"), f"# File {i:04d}\nSome words about it.\n", 1_700_000_000)
    catalog = _catalog(spark, [("app", "project_root", str(root))])
    e = MemoryEngine(spark, str(tmp_path / "store"), vectors=False)
    e.init()
    e.global_refresh(catalog, NOW, dry_run=False)
    assert (e.counters["files_opened"], e.counters["new"], e.counters["indexed_records"]) == (1000, 1000, 1000)
    # other contents of the same length and time: whoever opened such a file would see a change
    for i in range(1000):
        _write(str(root / f"d{i % 20}/f{i}.md"), f"# File {i:04d}\nOTHER words in it!!\n", 1_700_000_000)
    _write(str(root / "d7/f7.md"), "# File 7\nThis one has changed.\n", 1_700_000_100)
    before = _tree(tmp_path / "store")
    done = e.global_refresh(catalog, NOW + timedelta(days=1))
    assert {r["action"]: r["count"] for r in done.groupBy("action").count().collect()} == {"unchanged": 999, "modified": 1}
    assert (e.counters["files_opened"], e.counters["indexed_records"]) == (1, 0) and _tree(tmp_path / "store") == before
    e.global_refresh(catalog, NOW + timedelta(days=1), dry_run=False)
    assert e.counters["files_opened"] == 1 and e.counters["indexed_records"] == 1 and not os.path.exists(tmp_path / "store/runs")
    assert e._t("chunks").where("content like '%OTHER%'").count() == 0 and e._t("chunks").where("content like '%This one%'").count() == 1
    e.global_refresh(catalog, NOW + timedelta(days=2), dry_run=False)
    assert (e.counters["files_opened"], e.counters["unchanged"]) == (0, 1000)
    e.close()


def _picky():
    class Picky:
        """Fails on some texts, as a remote model may."""

        name, dimensions = "picky", 2

        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("cannot embed this")
            return [[float(len(t)), 1.0] for t in texts]

    return Picky()


def test_one_bad_record_is_one_error(spark, tmp_path):
    root, later = tmp_path / "app", NOW + timedelta(days=1)
    for i in range(60):
        _write(str(root / f"f{i}.md"), f"# File {i}\nSome words about it.\n", 1_700_000_000)
    _write(str(root / "odd.md"), b"# Odd\nbytes \xff\xfe that are no text, and words enough to keep it\n", 1_700_000_000)
    _write(str(root / "log.jsonl"), '{"type":"user","message":{"role":"user","content":"a first question"}}\n', 1_700_000_000)
    catalog = _catalog(spark, [("app", "project_root", str(root)), ("log", "agent_root", str(root)), ("none", "document", str(root / "none.md")), ("host", "server_alias", "h.example.com")])
    e = MemoryEngine(spark, str(tmp_path / "store"), embedder=_picky())
    e.init()
    e.global_refresh(catalog, NOW, dry_run=False)
    assert e.counters["new"] == 62 and "\ufffd" in e._t("chunks").where("content like '%Odd%'").first().content
    for i in (3, 4):
        _write(str(root / f"f{i}.md"), f"# File {i}\nNew words.\n" + ("Now with poison.\n" if i == 3 else ""), 1_700_000_100)
    _write(str(root / "new.md"), "# New\nA poisoned text from the start.\n", 1_700_000_100)
    os.remove(root / "f9.md")
    done = e.global_refresh(catalog, later, dry_run=False, auto_memory=True)
    ledger = {os.path.basename(r.source_path_or_alias): r for r in e._t("source_ledger").collect()}
    assert ledger["f3.md"].status == "error" and ledger["f3.md"].error_message == "cannot embed this" and int(ledger["f3.md"].last_modified_at.timestamp()) == 1_700_000_000
    assert ledger["f4.md"].status == "active" and ledger["new.md"].status == "error" and ledger["new.md"].chunk_count == 0 and ledger["f9.md"].status == "missing"
    texts = [r.content for r in e._t("chunks").where("content like '%File 3\n%' or content like '%File 4\n%' or content like '%poison%'").collect()]
    assert len(texts) == 2 and any("Some words" in t for t in texts) and any("New words" in t for t in texts)  # the old version of the failing one
    # counters: those of the action that wrote, against a count by another engine
    rows = done.select("action").toArrow()  # noqa: F841
    want = dict(duckdb.sql("select action, count(*) from rows group by action").fetchall())
    for name, action in (("new", "new"), ("modified", "modified"), ("unchanged", "unchanged"), ("skipped", "skipped"), ("missing", "missing"), ("errors", "error")):
        assert e.counters[name] == want.get(action, 0), name
    assert e.counters["errors"] == 2 and e.counters["indexed_records"] == 1 and e.counters["catalog_entries"] == 4 and e.counters["missing"] == 2
    auto = {k: v for k, v in e.counters.items() if k.startswith("auto_memory_")}
    assert len(auto) == 11 and auto["auto_memory_created"] == e._t("memory_nodes").count()
    # the failing one is opened again until it can be indexed
    _write(str(root / "f3.md"), "# File 3\nHealed words.\n", 1_700_000_200)
    e.global_refresh(catalog, later, dry_run=False)
    assert e._t("source_ledger").where("status = 'error'").count() == 1 and e._t("chunks").where("content like '%Healed%'").count() == 1
    e.close()


def test_files_that_cannot_be_read(spark, tmp_path):
    _write(str(tmp_path / "a.md"), "text")
    rows = spark.createDataFrame([(f"file:{tmp_path}/a.md", 4), (f"file:{tmp_path}/gone.md", 4), (f"file:{tmp_path}/a.md", walk.LONGEST + 1)], "path string, length long")
    found = sorted(((r.text, (r.error or "").split(":")[0]) for r in walk.read_texts(rows).collect()), key=str)
    assert found == [("text", ""), (None, "FileNotFoundError"), (None, "ValueError")]
    with pytest.raises(OSError):
        files.exists(spark, "hdfs://no-such-host.invalid:1/x")
    assert not files.exists(spark, "C:\\work") and not files.exists(spark, "strange://x/y")


# --- walks


def test_excluded_directories_are_never_listed(spark, tmp_path):
    r, made = random.Random(1), set()
    names = ["src", "docs", "node_modules", ".git", "venv3", "dist", "a b", "deep"]
    for i in range(300):
        at = "/".join(r.choice(names) for _ in range(r.randint(0, 5)))
        path = f"{at}/{r.choice(['x.md', 'y.py', 'z.bin', 'package.json', 'w.TXT'])}".lstrip("/")
        _write(str(tmp_path / path), f"words {i}")
        made.add(path)
    opened = []

    def entries_(path):
        opened.append(path)
        assert not {"node_modules", ".git", "venv3", "dist"} & set(path.split("/"))
        return walk._entries(path)

    rows = list(walk._visit([(0, f"file:{tmp_path}")], {0: files.DOCUMENTS}, entries_))
    good = lambda p: files.DOCUMENTS.lists(p.rsplit("/", 1)[-1]) and all(files.DOCUMENTS.enters(d) for d in p.split("/")[:-1])
    want = sorted(f"file:{tmp_path}/{p}" for p in made if good(p))
    assert sorted(x[1] for x in rows) == want and len(opened) == len(set(opened))
    # the same in rounds of tasks, with a bound that leaves directories to the next round
    run = Scratch(spark)
    assert sorted(x.path for x in walk.listing(spark, [(0, str(tmp_path))], {0: files.DOCUMENTS}, run).collect()) == want
    left = list(walk._visit([(0, f"file:{tmp_path}")], {0: files.DOCUMENTS}, most=3))
    assert Counter(x[2] for x in left)["dir"] > 0
    run.close()


def test_a_failing_directory_is_no_deletion(spark):
    def broken(path):
        if path.endswith("/bad"):
            raise PermissionError("no")
        return [("bad", path + "/bad", True, 0, 0), ("a.md", path + "/a.md", False, 1, 1)]

    rows = list(walk._visit([(0, "file:/r")], {0: files.DOCUMENTS}, broken))
    assert {(x[1], x[2]) for x in rows} == {("file:/r/a.md", "file"), ("file:/r/bad", "problem")}
    ledger = spark.createDataFrame([("1", "/r/bad/x.md"), ("2", "/r/badly/x.md"), ("3", "/r/b.md")], "source_id string, plain string")
    assert {x.source_id for x in entries.outside(ledger, spark.createDataFrame([("/r/bad",)], "dir string")).collect()} == {"2", "3"}


# --- store


def _rows(spark, low, high, text="t"):
    return spark.createDataFrame([(i, text, "{}", NOW) for i in range(low, high)], TABLES["memories"])


def test_an_append_writes_its_rows_only(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.init()
    s.append({"memories": _rows(spark, 0, 50_000, "x" * 50).withColumn("text", F.concat("text", F.uuid()))})
    before = _tree(tmp_path / "s")
    s.append({"memories": _rows(spark, 50_000, 50_001)})
    grown = sum(n for _, n in _tree(tmp_path / "s")) - sum(n for _, n in before)
    assert set(before) <= set(_tree(tmp_path / "s")) and grown < 20_000 and s.read("memories").count() == 50_001


def test_small_folders_are_merged_by_levels(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for i in range(2 * FAN + 1):
        s.append({"memories": _rows(spark, i, i + 1)})
    levels = Counter(f["level"] for f in s.current()["tables"]["memories"])
    assert levels == {1: 2, 0: 1} and sorted(r.id for r in s.read("memories").collect()) == list(range(2 * FAN + 1))
    assert s.vacuum(keep=1) == 2 * FAN and s.read("memories").count() == 2 * FAN + 1 and len(s.backups()) == 1


def test_a_merge_rewrites_touched_files_only(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append({"memories": _rows(spark, 0, 400).repartitionByRange(8, "id").sortWithinPartitions("id")})
    s.append({"memories": _rows(spark, 400, 410)})
    first = s.current()["n"]
    s.merge("memories", _rows(spark, 5, 6, "new"))
    folders = s.current()["tables"]["memories"]
    assert [len(f["without"]) for f in folders] == [1, 0, 0]  # one of eight files, and the second folder as it was
    s.merge("memories", _rows(spark, 5, 12, "newer").union(_rows(spark, 900, 901)))
    rows = {r.id: r.text for r in s.read("memories").collect()}
    assert len(rows) == 411 and s.read("memories").count() == 411 and {k for k, v in rows.items() if v == "newer"} == set(range(5, 12)) and rows[900] == "t"
    assert {r.text for r in s.read("memories", s._state(first)).collect()} == {"t"}


def test_every_change_survives_another_writer(spark, tmp_path):
    """Between a call's read and its commit, a second writer adds a row; both changes must be there."""
    e, other = (MemoryEngine(spark, str(tmp_path / "s"), vectors=False) for _ in range(2))
    e.init()
    kept = e.add("a first memory", at=NOW).first().id
    task = e.task_open("Fix it", "bugfix", at=NOW)
    e.store.append({"memory_nodes": spark.createDataFrame([("auto1", "default", "note", "t", "generated text", "unverified", "auto", None, None, "/p", "h1", "auto", None, None, NOW, NOW), ("auto2", "default", "note", "t", "other text", "unverified", "auto", None, None, "/p", "h2", "auto", None, None, NOW, NOW), ("auto3", "default", "note", "t", "third text", "obsolete", "auto", None, None, "/p", "h3", "auto", None, None, NOW, NOW)], TABLES["memory_nodes"])})
    e.store.append({"source_ledger": spark.createDataFrame([("s", "/r/x.md", None, "project_docs", "1", "h", NOW, NOW, "active", None, 1, NOW, NOW)], TABLES["source_ledger"])})
    records = spark.createDataFrame([("p", "project_docs", "/p/a.md", "some words here")], "project string, source_type string, source_path string, text string")
    none = _catalog(spark, [("x", "server_alias", "h.example.com")])
    calls = {
        "add": lambda: e.add("another memory", at=NOW), "set_status": lambda: e.set_status(kept, "obsolete", NOW), "index_records": lambda: e.index_records(records, NOW), "add_text": lambda: e.add_text("text", at=NOW), "search": lambda: e.search("memory words", at=NOW),
        "approve": lambda: e.approve("auto1", NOW), "reject": lambda: e.reject("auto2", NOW), "promote": lambda: e.promote("auto2", "Title", "curated words", at=NOW), "prune": lambda: e.prune(False, at=NOW), "step": lambda: e.task_step_add(task, tokens=5, at=NOW),
        "round": lambda: e.verifier_round_add(task, "style", True, at=NOW), "close": lambda: e.task_close(task, 1), "ledger": lambda: e.set_ledger_status("s", "error", "bad", NOW), "refresh": lambda: e.global_refresh(none, NOW, dry_run=False), "cleanup": lambda: e.cleanup(none, False, NOW), "auto": lambda: e.auto_run(False, NOW),
    }
    commit, n = e.store.commit, 0
    for name, call in calls.items():
        met = []

        def late(*args, met=met, name=name, **more):
            if not met:
                met.append(1)
                other.store.append({"memories": spark.createDataFrame([(1000 + n, name, "{}", NOW)], TABLES["memories"])})
            return commit(*args, **more)

        e.store.commit, n = late, n + 1
        call()
        e.store.commit = commit
        assert met, name
    assert {r.text for r in e._t("memories").collect()} == {*calls, "text"}
    memory = {r.id: r for r in e._t("memory_nodes").collect()}
    assert memory[kept].status == "obsolete" and memory["auto1"].status == "active" and memory["auto2"].status == "obsolete" and memory["auto3"].content != "third text" and len(memory) >= 5
    assert e._t("chunks").count() == 1 and e.logs().count() == 1 and e.task_show(task)["steps"].first().step_index == 0
    assert (e.task_list().first().status, e.ledger_row("s").first().error_message) != ("open", None)
    # two adders at once: neither is lost, without a conflict
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    folder, base = one.write("memories", _rows(spark, 5000, 5001)), one.current()
    two.append({"memories": _rows(spark, 5001, 5002)})
    with pytest.raises(ConflictError):
        one.commit(base, {"memories": one.appended(base, "memories", folder)})
    one.change(lambda now: {"memories": one.appended(now, "memories", folder)})
    assert {5000, 5001} <= {r.id for r in one.read("memories").collect()}


def test_status_calls_are_checked(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "s"), vectors=False)
    e.init()
    for bad in (lambda: e.list("nope"), lambda: e.set_ledger_status("s", "nope")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        e.set_ledger_status("s", "error")


# --- streams


def test_a_replayed_batch_makes_no_second_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.init()
    _rows(spark, 0, 5).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(TABLES["memories"]).parquet(str(tmp_path / "in"))
    streams.refresh_into(read(), s, "memories", str(tmp_path / "c1"), "feed").awaitTermination()
    n = s.current()["n"]
    assert s.read("memories").count() == 5 and s.current()["streams"] == {"feed": 0}
    # killed after the version and before the checkpoint: a new checkpoint sees the same batch again
    streams.refresh_into(read(), s, "memories", str(tmp_path / "c2"), "feed").awaitTermination()
    assert s.current()["n"] == n
    _rows(spark, 3, 8, "new").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.refresh_into(read(), s, "memories", str(tmp_path / "c2"), "feed").awaitTermination()
    assert {r.id: r.text for r in s.read("memories").collect()} == {i: "t" if i < 3 else "new" for i in range(8)} and s.current()["streams"] == {"feed": 1}


# --- session logs


def _exchanges(rows):
    out, user, answers = [], None, []
    for role, text in [*rows, ("user", "the end")]:
        text = text.strip()
        if role == "user" and len(text) >= 3:
            if user is not None:
                said = " ".join(answers).strip()
                left = 600 - len(user[:600])
                out.append(f"[User]: {user[:600]}" + (f"\n[Assistant]: {said[:left]}" if said and left > 20 else ""))
            user, answers = text, []
        elif role == "assistant" and user is not None:
            answers.append(text)
    return out


def test_exchanges_keep_bounded_state(spark):
    r = random.Random(4)
    rows = []
    for _ in range(3000):
        role = r.choice(["user", "assistant", "assistant", "assistant"])
        rows.append((role, r.choice(["", " ", "x" * r.randint(1, 700), "words " * r.randint(1, 300), f"short {r.random()} "])))
    df = spark.createDataFrame([("f", i, *x) for i, x in enumerate(rows)], "file string, line_no long, role string, text string")
    found = [x.text for x in sorted(sessions.exchanges(df).collect(), key=lambda x: x.exchange_index)]
    assert found == _exchanges(rows)
    # one turn with very many answers: what is gathered stays small
    long = spark.range(300_000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("message number "), F.col("id").cast("string")).alias("text"))
    only = sessions.exchanges(long).collect()
    assert len(only) == 1 and only[0].text == _exchanges([("user", "message number 0"), *(("assistant", f"message number {i}") for i in range(1, 100))])[0]


def test_large_logs_are_read_in_splits(spark, tmp_path):
    lines = []
    for i in range(4000):
        role = "user" if i % 3 == 0 else "assistant"
        lines.append(json.dumps({"type": role, "message": {"role": role, "content": f"{role} says {i} " + "é" * (i % 50)}}))
    for k in range(2):
        _write(str(tmp_path / f"s {k}.jsonl"), ("\r\n" if k else "\n").join(lines))
    whole = sorted(map(tuple, sessions.session_records(spark, str(tmp_path), "p").select("source_path", "exchange_index", "text").collect()))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        parts = sessions.log_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        split = sorted(map(tuple, sessions.session_records(spark, str(tmp_path), "p").select("source_path", "exchange_index", "text").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert parts > 8 and split == whole and len(whole) == 2 * 1334
    assert [x[2] for x in whole[:1]] == ["[User]: user says 0 \n[Assistant]: assistant says 1 é assistant says 2 éé".replace("0 \n", "0\n")]
    assert sessions.session_records(spark, [], "p").count() == 0


def test_checked_embedder(spark):
    embed = vector_store.register_checked(spark, _picky())
    rows = spark.createDataFrame([("ab",), ("poison",), (None,)], "t string").coalesce(1).select("t", embed("t").alias("e")).collect()
    assert {r.t: (r.e.vector, r.e.error) for r in rows} == {"ab": ([2.0, 1.0], None), "poison": (None, "cannot embed this"), None: ([0.0, 1.0], None)}
    assert vector_store.HashingEmbedder().embed(["", "a"])[0] == [0.0] * 384
