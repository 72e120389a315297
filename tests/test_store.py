import hashlib
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.engine import MemoryEngine
from recollect.operators import candidates, lifecycle, refresh, reports
from recollect.schemas import CATALOG, TABLES
from recollect.sources import files, history, manifest, sessions
from recollect.sources.store import ConflictError, Store, equivalent, fingerprint

NOW = datetime(2026, 1, 2)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    src = root / "project"
    _write(str(src / "README.md"), "# Sample\nA small project about storage.")
    _write(str(src / "docs/decisions.md"), "# Decisions\n## ADR-003: use a stdio transport\nThe transport for tools is stdio.\n")
    _write(str(src / "docs/notes.txt"), "Plain notes on ranking.")
    _write(str(src / ".git/config.md"), "hidden")
    e = MemoryEngine(spark, str(root / "store"))
    e.init()
    e.index(str(src), NOW)
    return e


def test_index_and_search(engine):
    assert engine._t("documents").count() == 3
    top = engine.search("stdio transport", at=NOW).first()
    assert top.heading_path == "Decisions > ADR-003: use a stdio transport"
    log = engine.logs().first()
    assert log["query"] == "stdio transport" and log["result_count"] == len(log["results"]) > 0
    n = engine.logs().count()
    engine.search("...", at=NOW)
    assert engine.logs().count() == n


def test_memory_calls(engine):
    engine.add("Remember the\nmilk", at=NOW)
    row = engine.list("active").first()
    assert row.title == "Remember the" and row.content_hash
    engine.set_status(row.id, "obsolete", NOW)
    assert engine.list("active").count() == 0
    with pytest.raises(LookupError):
        engine.set_status("none", "active")
    with pytest.raises(ValueError):
        engine.add("  ")


def test_tasks(engine):
    t = engine.task_open("Fix it", "bugfix", "p", at=NOW)
    assert [engine.task_step_add(t, tokens=a, seconds=s, judgment="ok", at=NOW) for a, s in ((50, 1.5), (80, 2.0))] == [0, 1]
    engine.verifier_round_add(t, "style", True, at=NOW)
    engine.task_close(t, 1, at=NOW)
    row = engine.task_list(project="p").first()
    assert (row.total_tokens, row.total_duration_s, row.status, row.human_outcome) == (130, 3.5, "closed", 1)
    c = engine.calibration("p")
    assert c["verifier"].first().acceptance_rate == 1.0 and c["judgments"].first().n == 2
    for bad in (lambda: engine.task_open("x", "nope"), lambda: engine.task_open(" ", "bugfix"), lambda: engine.task_close(t, 5)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        engine.task_step_add("none")


def test_export_restore(engine, spark, tmp_path):
    engine.store.export(str(tmp_path / "x"))
    other = Store(spark, str(tmp_path / "other"))
    other.init()
    other.load_export(str(tmp_path / "x"))
    for t in TABLES:
        assert equivalent(engine.store.read(t), other.read(t)), t
    n = other.current()["n"]
    other.publish({"documents": other.read("documents").limit(1)})
    assert other.read("documents").count() == 1
    other.restore(n)
    assert other.read("documents").count() == 3
    with pytest.raises(LookupError):
        other.restore(999)


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "t string, id int")
    assert fingerprint(a).collect() == fingerprint(b).collect()
    assert fingerprint(a).collect() != fingerprint(a.where("id = 1")).collect()


def test_classify(spark):
    old = NOW - timedelta(hours=1)
    listing = spark.createDataFrame([("n", "/n.md", "project_docs", "h", old), ("u", "/u.md", "project_docs", "h", old), ("m", "/m.md", "project_docs", "h2", old), ("e", "/e.md", "project_docs", "h", old), ("s", "/s.jsonl", "agent_session", "h2", NOW - timedelta(seconds=10))], "source_id string, source_path string, source_type string, content_hash string, modified timestamp")
    led = [("u", "/u.md", "active", "h"), ("m", "/m.md", "active", "h"), ("e", "/e.md", "error", "h"), ("s", "/s.jsonl", "active", "h"), ("g", "/g.md", "active", "h"), ("k", "/k.md", "skipped", "h")]
    ledger = spark.createDataFrame([(i, p, None, "x", "1", h, old, old, s, None, 1, old, old) for i, p, s, h in led], TABLES["source_ledger"])
    now = F.lit(NOW)
    done = refresh.classify(listing, ledger, now)
    assert {r.source_id: r.action for r in done.collect()} == {"n": "new", "u": "unchanged", "m": "modified", "e": "new", "s": "skipped", "g": "missing"}
    errors = spark.createDataFrame([("m", "bad")], "source_id string, error_message string")
    after = {r.source_id: (r.status, r.content_hash) for r in refresh.ledger_after(done, ledger, now, errors).collect()}
    assert after == {"n": ("active", "h"), "u": ("active", "h"), "m": ("error", "h"), "e": ("active", "h"), "s": ("active", "h"), "g": ("missing", "h"), "k": ("skipped", "h")}
    again = refresh.classify(listing.where("source_id <> 's'"), refresh.ledger_after(done, ledger, now), now).where("source_id not in ('g', 's')")
    assert {r.action for r in again.collect()} == {"unchanged"}


def _chunk_rows(spark, rows):
    docs = spark.createDataFrame([(f"d{i}", p) for i, (p, *_) in enumerate(rows)], "id string, path string")
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", i, None, t) for i, (_, _, t) in enumerate(rows)], "id string, document_id string, chunk_index int, heading_path string, content string")
    ledger = spark.createDataFrame(sorted({(p, k, "active") for p, k, _ in rows}), "source_path_or_alias string, source_type string, status string")
    return chunks, docs, ledger


def _none(spark):
    return candidates.blocklist(spark.createDataFrame([], TABLES["memory_nodes"]))


def test_candidates(spark):
    words = "one two three four five six seven eight nine"
    meta = 'INGESTION_METADATA {"created_at": "2026-03-04T00:00:00", "exchange_index": 2, "is_compaction": %s}\n\n'
    rows = [("/a.md", "project_docs", words), ("/b.py", "project_docs", words), ("/s.jsonl", "agent_session", "[User]: " + words), ("/t.jsonl", "agent_session", meta % "true" + words), ("/u.jsonl", "agent_session", meta % "false" + words), ("/c.md", "project_docs", "too short"), ("/d.md", "project_docs", '{"type": "x", ' + words)]
    found = {r.source_path: r for r in candidates.candidates(*_chunk_rows(spark, rows)).collect()}
    assert set(found) == {"/a.md", "/b.py", "/s.jsonl", "/t.jsonl", "/u.jsonl"}
    assert {p: r.verdict for p, r in found.items()} == {"/a.md": "candidate", "/b.py": "non_document", "/s.jsonl": "noisy", "/t.jsonl": "candidate", "/u.jsonl": "candidate"}
    assert found["/t.jsonl"].title == "Session Summary: 2026-03-04" and found["/t.jsonl"].confidence == 0.75
    assert found["/u.jsonl"].title == "Session Exchange #2: " + words[:60] and found["/u.jsonl"].confidence == 0.6


@pytest.mark.parametrize("limit,per_source", [(10, 2), (3, 0), (0, 1), (4, 3)])
def test_caps_against_a_loop(spark, limit, per_source):
    rows = [(f"/{p}.md", "project_docs", f"text number {i} of source {p} with several more words here") for p, n in (("a", 6), ("b", 1), ("c", 4)) for i in range(n)]
    found = candidates.candidates(*_chunk_rows(spark, rows))
    order = found.orderBy(*candidates.ranking()).collect()
    want, used, made = {}, {}, 0
    for r in order:
        if per_source and used.get(r.source_path, 0) >= per_source:
            want[r.source_chunk_id] = "source_limit"
        elif limit and made >= limit:
            want[r.source_chunk_id] = "limit"
        else:
            want[r.source_chunk_id], made = "created", made + 1
            used[r.source_path] = used.get(r.source_path, 0) + 1
    for f in (candidates.admit, candidates.admit_in_order):
        assert {r.source_chunk_id: r.state for r in f(found, _none(spark), 0.0, limit, per_source).collect()} == want, f


def test_in_order_blocks_within_the_run(spark):
    t = "the same words in two places of the corpus at once"
    found = candidates.candidates(*_chunk_rows(spark, [("/a.md", "project_docs", t), ("/b.md", "project_docs", t)]))
    assert sorted(r.state for r in candidates.admit(found, _none(spark)).collect()) == ["created", "created"]
    assert sorted(r.state for r in candidates.admit_in_order(found, _none(spark)).collect()) == ["created", "duplicate_unverified"]


@pytest.mark.parametrize(("limit", "per_source"), [(7, 2), (3, 3), (20, 1), (5, 0), (0, 2), (500, 2)])
def test_in_order_against_a_loop(spark, limit, per_source):
    """Contents that come again in and across sources, sources that fill up, and both caps."""
    texts = [f"fact number {i * i % 17} of the corpus with enough words to count" + " more" * (i * 7 % 5) for i in range(90)]
    found = candidates.candidates(*_chunk_rows(spark, [(f"/s{i * i % 11}.md", "agent_session" if i * i % 11 in (0, 3) else "project_docs", t) for i, t in enumerate(texts)])).cache()
    want, seen, used, made = {}, set(), {}, 0
    for r in found.where("verdict = 'candidate'").orderBy(*candidates.ranking()).collect():
        key = (r.source_chunk_id, r.source_path)
        if r.content_hash in seen:
            want[key] = "duplicate_unverified"
        elif per_source > 0 and used.get(r.source_path, 0) >= per_source:
            want[key] = "source_limit"
        elif limit > 0 and made >= limit:
            want[key] = "limit"
        else:
            want[key], made = "created", made + 1
            used[r.source_path] = used.get(r.source_path, 0) + 1
            seen.add(r.content_hash)
    got = candidates.admit_in_order(found.where("verdict = 'candidate'"), _none(spark), 0.0, limit, per_source)
    assert {(r.source_chunk_id, r.source_path): r.state for r in got.collect()} == want
    found.unpersist()


def test_rounds_of_adversarial_chains(spark):
    """A chain in which each row waits for the one before, and ties across sources: as a loop, in counted rounds, without a stage of one task."""
    rows = []
    for i in range(12):  # source i starts with the content that source i - 1 ends with
        rows += [(f"s{i:02d}", f"c{i}", 1000 - 10 * i), (f"s{i:02d}", f"c{i + 1}", 1000 - 10 * i - 5)]
    rows += [(None, "c3", 5), (None, "only", 4), (None, "more", 3), ("s00", "late", 2)]
    thin = spark.createDataFrame([(f"k{n:03d}", p, c, False, "project_docs", t, 0) for n, (p, c, t) in enumerate(rows)], "source_chunk_id string, source_path string, content_hash string, is_compaction boolean, source_type string, tokens int, chunk_index int")
    for per_source in (0, 1, 2):
        run = candidates.Scratch(spark)
        made, rounds = candidates._in_rounds(thin, per_source, run)
        want, seen, used = set(), set(), {}
        for r in thin.orderBy(*candidates.ranking()).collect():
            if r.content_hash not in seen and (not per_source or used.get(r.source_path, 0) < per_source):
                want.add(r.source_chunk_id)
                seen.add(r.content_hash)
                used[r.source_path] = used.get(r.source_path, 0) + 1
        assert {r.source_chunk_id for r in made.collect()} == want and 1 <= rounds <= 13
        run.close()


def test_noise(spark):
    bad = ["please Continue the conversation from where it left off", "x\n 2. All user messages:", " [User]: hi", "1. run `git log`\n2. check `ls`"]
    good = ["a plain fact", "1. run `git log`\n2. think\n3. write"]
    rows = spark.createDataFrame([(t, i < 4) for i, t in enumerate(bad + good)], "t string, want boolean")
    assert rows.where(candidates.noisy_transcript("t") != F.col("want")).count() == 0


def _memory(spark, rows):
    return spark.createDataFrame([(i, "default", "note", "t", c, s, k, None, None, "/p", h, b, None, None, NOW, NOW) for i, c, s, k, b, h in rows], TABLES["memory_nodes"])


def test_lifecycle(spark):
    m = _memory(spark, [("a", "x", "unverified", "auto", "auto", "h1"), ("b", "y", "unverified", "manual", "user", "h2"), ("c", "z", "obsolete", "auto", "auto", "h3")])
    now = F.lit(NOW)
    assert {r.id: r.status for r in lifecycle.approve(m, F.lit(True), now).collect()} == {"a": "active", "b": "unverified", "c": "obsolete"}
    p = lifecycle.promote(m, "a", "Title", "curated", now)
    assert sorted((r.status, r.source_kind) for r in p.collect()) == [("active", "curated_auto"), ("obsolete", "auto"), ("obsolete", "auto"), ("unverified", "manual")]
    assert lifecycle.promote(p, "a", "Title", "curated", now).count() == 4
    assert lifecycle.promote(m, "b", "Title", "curated", now).count() == 3
    r = lifecycle.prune(m, now)
    assert r.where(F.col("content") == lifecycle.TOMBSTONE).first().content_hash == "h3"
    assert lifecycle.prunable(r).count() == 0
    with pytest.raises(ValueError):
        lifecycle.promote(m, "a", " ", "c", now)


def test_cleanup_applies(spark):
    led = spark.createDataFrame([("s", "/r/x.md", None, "project_docs", "1", "h", NOW, NOW, "missing", "previously indexed source file no longer exists", 1, NOW, NOW), ("t", "/q/y.md", None, "project_docs", "1", "h", NOW, NOW, "error", None, 1, NOW, NOW)], TABLES["source_ledger"])
    cat = spark.createDataFrame([("i", "project_root", "/r", "r", ["x"], "confirmed", "l", 1.0, 1)], "id string, source_type string, path_or_alias string, project_name string, discovered_from array<string>, confirmation_status string, privacy_scope string, confidence double, evidence_count int")
    acts = reports.cleanup_actions(led, cat)
    assert {r.source_id: r.reason.split()[0] for r in acts.collect()} == {"s": "removed", "t": "stale"}
    out = {r.source_id: r.error_message for r in reports.apply_cleanup(led, acts, F.lit(NOW)).where("status = 'skipped'").collect()}
    assert out == {"s": "removed local source: no active local content", "t": "stale ledger: no confirmed catalog source"}


DIALECTS = {
    "nested": ['{"type":"user","message":{"role":"user","content":"first question"}}', '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"an answer"},{"type":"tool_use","text":"hidden"}]}}', "not json", "[1]", '{"type":"user","message":{"role":"user","content":"second question"}}', '{"type":"compaction","message":{"content":"what happened"}}'],
    "envelope": ['{"type":"session_meta","payload":{"id":"sess-1","timestamp":1770887989262}}', '{"type":"response_item","payload":{"type":"message","role":"developer","content":"no"}}', '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"ask this"}]}}', '{"type":"event_msg","payload":{"type":"agent_message","message":"say that"}}', '{"type":"compacted","payload":{"summary":"short"}}'],
}


def test_sessions(spark, tmp_path):
    for k, lines in DIALECTS.items():
        _write(str(tmp_path / f"{k}.jsonl"), "\n".join(lines))
    rows = sessions.session_records(spark, str(tmp_path), "p").collect()
    by = {(os.path.basename(r.source_path), r.exchange_index): r for r in rows}
    assert by["nested.jsonl", 0].text == "[User]: first question\n[Assistant]: an answer"
    assert by["nested.jsonl", 1].text == "[User]: second question"
    assert by["nested.jsonl", 2].is_compaction and by["nested.jsonl", 2].text == "## Compaction Summaries\n\nwhat happened"
    assert by["envelope.jsonl", 0].text == "[User]: ask this\n[Assistant]: say that" and by["envelope.jsonl", 0].session_id == "sess-1"
    assert by["envelope.jsonl", 1].text.endswith("short") and by["envelope.jsonl", 0].created_at.startswith("2026-02-12T")
    assert by["nested.jsonl", 0].session_id == "session:nested" and len(rows) == 5


def test_epochs(spark):
    rows = spark.createDataFrame([(1767225600.0,), (1770887989262.0,), (1e30,)], "x double")
    assert [r[0] for r in rows.select(sessions.epoch_to_iso("x")).collect()] == ["2026-01-01T00:00:00+00:00", "2026-02-12T09:19:49.262000+00:00", None]


def test_manifest(spark, tmp_path):
    _write(str(tmp_path / "docs/a.md"), "hello world")
    good = {"manifest_version": "1", "project": "p", "sources": [{"source_type": "project_docs", "source_path": "docs"}, {"source_type": "operations_note", "source_path": "x"}, {"source_type": "agent_session", "source_path": "gone"}]}
    _write(str(tmp_path / "m.json"), json.dumps(good))
    records, report = manifest.ingest(spark, manifest.load_manifest(str(tmp_path / "m.json")), str(tmp_path))
    assert [r["bucket"] for r in report] == ["index_now", "parse_later", "skipped"] and records.count() == 1
    for bad in ({"manifest_version": "2"}, {"project": " "}, {"sources": []}, {"sources": [{"source_type": "?", "source_path": "x"}]}, {"sources": [{"source_type": "project_docs", "source_path": ""}]}):
        with pytest.raises(ValueError):
            manifest.parse_manifest(good | bad)


def test_files(spark, tmp_path):
    for p in ("a.md", "node_modules/b.md", "package.json", "c.bin", "deep/venv2/d.md", "deep/e.txt"):
        _write(str(tmp_path / p), "some words")
    _write(str(tmp_path / "digits.md"), "1234567890 a")
    assert {os.path.basename(r.path) for r in files.scan_documents(spark, str(tmp_path)).collect()} == {"a.md", "e.txt"}


def test_history(spark):
    lines = [
        '{"role":"system","text":"x"}', '{"payload":{"cwd":"/w"},"text":"t","tool_use":{"text":"no"}}', '{"message":{"role":"user","content":[{"type":"tool_result","text":"no"},{"text":"yes"}]}}', "{", "[1]",
        '{"a":{"path":"p","deep":[{"text":"q"},"r"]},"other":"s"}', '{"message":{"role":"developer","content":"hidden"}}', '{"type":"event_msg","payload":{"type":"user_message","message":" hi ","text":"no"}}',
    ]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    got = {}
    for r in sorted(history.line_rows(df).collect(), key=lambda r: (r.line_no, r.k)):
        got.setdefault(r.line_no, []).append(r.text)
    assert got == {1: ["/w", "/w", "t"], 2: ["yes"], 5: ["p", "q"], 7: ["hi"]}


def test_history_files(spark, tmp_path):
    _write(str(tmp_path / "skills/a/SKILL.md"), "Deploy from /srv/app/docs/run.md")
    _write(str(tmp_path / "skills/b.bin"), "no")
    _write(str(tmp_path / "skills/log.jsonl"), "".join(json.dumps({"text": f"line {i}"}) + "\n" for i in range(700)))
    rows = history.history_texts(spark, str(tmp_path / "skills"), "claude-skills").collect()
    logs = [r.text for r in sorted((r for r in rows if r.file.endswith("jsonl")), key=lambda r: r.position)]
    assert logs == [f"line {i}" for i in range(500)] and {r.text for r in rows if r.file.endswith("md")} == {"Deploy from /srv/app/docs/run.md"}
    found = history.skill_documents(history.history_texts(spark, str(tmp_path / "skills"), "claude-skills")).collect()
    assert {os.path.basename(r.path) for r in found} == {"SKILL.md", "log.jsonl"} and {r.confidence for r in found} == {1.0}


def _catalog(spark, rows):
    return spark.createDataFrame([(i, kind, path, None, ["codex-sessions"], status, "local_only", 1.0, 1) for i, kind, path, status in rows], CATALOG)


def test_global_refresh(spark, tmp_path):
    """New, unchanged, touched, edited, deleted and broken sources, and entries that are not walked."""
    root, later = tmp_path / "app", NOW + timedelta(days=1)
    for name in ("a", "b", "c"):
        _write(str(root / f"{name}.md"), f"# Title {name}\nSome text about the {name} part of this project.\n")
        os.utime(root / f"{name}.md", (1_700_000_000, 1_700_000_000))
    catalog = _catalog(spark, [("app", "project_root", str(root), "confirmed"), ("host", "server_alias", "h.example.com", "confirmed"), ("odd", "strange", "x", "confirmed"), ("gone", "document", str(tmp_path / "no.md"), "confirmed"), ("win", "project_root", "C:\\work", "confirmed"), ("idle", "project_root", "/x", "pending")])
    e = MemoryEngine(spark, str(tmp_path / "store"), vectors=False)
    e.init()
    assert e.global_refresh(catalog, NOW).where("action = 'new'").count() == 3 and e._t("source_ledger").count() == 0
    version = e.store.current()["n"]
    done = {r.source_path.rsplit("/", 1)[-1]: (r.action, r.reason) for r in e.global_refresh(catalog, NOW, dry_run=False).collect()}
    assert e.store.current()["n"] == version + 1  # one version for documents, chunks and ledger
    assert {k: v[0] for k, v in done.items()} == {"a.md": "new", "b.md": "new", "c.md": "new", "h.example.com": "skipped", "x": "skipped", "no.md": "missing", "C:\\work": "skipped"}
    ledger = {r.source_path_or_alias.rsplit("/", 1)[-1]: r for r in e._t("source_ledger").collect()}
    a = ledger["a.md"]
    assert (a.status, a.project_name, a.source_type, a.parser_version, a.chunk_count, a.error_message, a.last_indexed_at, a.created_at, a.updated_at) == ("active", "app", "project_docs", "1", 2, None, NOW, NOW, NOW)
    assert a.content_hash == hashlib.sha256((root / "a.md").read_bytes()).hexdigest() and int(a.last_modified_at.timestamp()) == 1_700_000_000
    assert ledger["h.example.com"].error_message == "server_alias: no network/SSH indexing" and ledger["no.md"].status == "missing" and ledger["C:\\work"].status == "skipped"
    text = e._t("chunks").where("chunk_index = 0").first().content
    assert text.startswith("INGESTION_METADATA {") and json.loads(text.split("\n")[0].split(" ", 1)[1])["project"] == "app"
    os.utime(root / "a.md", (1_700_000_500, 1_700_000_500))
    _write(str(root / "b.md"), "# Title b\nQuite another text.\n")
    os.remove(root / "c.md")
    broken = catalog.where("id = 'app'").unionByName(_catalog(spark, [("bad", "agent_root", str(root), "confirmed")]))
    real = manifest.PARSERS["agent_session"]
    manifest.PARSERS["agent_session"] = lambda *a: (_ for _ in ()).throw(ValueError("broken"))
    try:
        done = {r.source_path.rsplit("/", 1)[-1]: (r.action, r.reason) for r in e.global_refresh(broken, later, dry_run=False).collect()}
    finally:
        manifest.PARSERS["agent_session"] = real
    assert done == {"a.md": ("unchanged", None), "b.md": ("modified", None), "c.md": ("missing", refresh.GONE), "app": ("error", "ValueError: broken")}
    ledger = {r.source_path_or_alias.rsplit("/", 1)[-1]: r for r in e._t("source_ledger").collect()}
    assert int(ledger["a.md"].last_modified_at.timestamp()) == 1_700_000_500 and ledger["a.md"].updated_at == NOW
    assert ledger["b.md"].last_indexed_at == later and ledger["c.md"].status == "missing" and ledger["app"].status == "error" and ledger["h.example.com"].status == "skipped"
    assert e._t("chunks").where("content like '%Quite another%'").count() == 1 and e._t("documents").count() == 3
    assert e.refresh_report(e.global_refresh(broken, later)).first().n_unchanged == 2


def test_two_writers_and_a_crash(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.init()
    base = two.current()
    row = spark.createDataFrame([(1, "t", "{}", NOW)], TABLES["memories"])
    one.publish({"memories": row})
    with pytest.raises(ConflictError):
        two.publish({"memories": row.union(row)}, base)
    assert two.read("memories").count() == 1
    # tables written but no version file, and a file cut short: readers stay at the last complete version
    row.union(row).write.parquet(str(tmp_path / "s/memories/v=9-crash"))
    with open(tmp_path / "s/history/0000000009.json", "w") as f:
        f.write('{"n": 9, "tab')
    assert one.read("memories").count() == 1 and one.backups()[0] == 2
    assert one.publish({"memories": row.union(row)}) == 10 and two.read("memories").count() == 2 and one.restore(2) == 11 and two.read("memories").count() == 1


def test_vectors_embedders_and_texts(spark, tmp_path):
    from recollect.operators import vector_store
    from recollect.sources import store

    points = spark.createDataFrame([("a", [1.0, 0.0, 0.0], "x"), ("b", [0.0, 1.0, 0.0], None), ("z", [0.0, 0.0, 0.0], None), ("n", None, None), (None, [1.0, 0.0, 0.0], None), ("c", [-1.0, 0.0, 0.0], None)], vector_store.FrameVectorStore.SCHEMA)
    v = vector_store.FrameVectorStore(spark)
    v.upsert(points)
    assert [r.id for r in v.search([0.9, 0.1, 0.0]).collect()] == ["a", "b"] and v.count() == 5
    v.upsert(spark.createDataFrame([("b", [0.9, 0.1, 0.0], "new")], vector_store.FrameVectorStore.SCHEMA))
    v.delete(["a"])
    v.rounded = False
    assert [r.id for r in v.search([0.9, 0.1, 0.0]).collect()] == ["b", "c"] and v.count() == 4

    class Lengths:
        name, dimensions = "lengths", 2

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    vector_store.register(spark, Lengths(), "lengths")
    assert [r.e for r in spark.sql("select lengths(t) as e from values ('ab'), (null) as x(t)").collect()] == [[2.0, 1.0], [0.0, 1.0]]
    e = MemoryEngine(spark, str(tmp_path / "e"), embedder=Lengths())
    e.init()
    e.index_records(spark.createDataFrame([("p", "project_docs", "/p/a.md", "some words here")], "project string, source_type string, source_path string, text string"), NOW)
    assert e._t("chunks").first().embedding_model == "lengths" and e.search("words", at=NOW, log=False).count() == 1
    assert [e.add_text(t, {"b": 1, "a": 2}, NOW).first().id for t in (" one ", "two")] == [1, 2] and e._t("memories").orderBy("id").first().metadata == '{"a": 2, "b": 1}'
    with pytest.raises(ValueError):
        e.add_text("  ")
    e.add("same words", at=NOW)
    assert e.memory_by_hash("same words").count() == 1 and e.memory_by_hash("none").count() == 0
    wrapped = store.envelope(e._t("memories"), "2026-01-01", {"k": "v"})
    assert store.open_envelope(wrapped, TABLES["memories"]).count() == 2
    with pytest.raises(ValueError):
        store.open_envelope(wrapped.withColumn("schema_version", F.lit("2")), TABLES["memories"])
