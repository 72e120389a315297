import json

from recollect import cli


def _run(spark, capsys, *args):
    cli.run(spark, cli.parser().parse_args(list(args)))
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if not x.startswith("#")]


def test_commands(spark, tmp_path, capsys):
    store = ("--store", str(tmp_path / "s"), "--catalog", str(tmp_path / "c.json"))
    (tmp_path / "c.json").write_text(json.dumps({"version": "1", "entries": [{"id": "r", "source_type": "project_root", "path_or_alias": "/w/a", "project_name": "a", "discovered_from": ["x"], "confirmation_status": "confirmed"}]}))
    _run(spark, capsys, *store, "init")
    row = _run(spark, capsys, *store, "add", "Use tabs in makefiles")[0]
    assert [r["id"] for r in _run(spark, capsys, *store, "list")] == [row["id"]]
    assert _run(spark, capsys, *store, "search", "makefiles")[0]["id"] == row["id"]
    assert _run(spark, capsys, *store, "global-search", "tabs", "--kind", "memory")[0]["score"] == 10.0
    task = _run(spark, capsys, *store, "task-open", "t", "query")[0]["result"]
    _run(spark, capsys, *store, "task-step", task, "--tokens", "5")
    _run(spark, capsys, *store, "task-close", task, "--outcome", "1")
    assert _run(spark, capsys, *store, "task-list")[0]["total_tokens"] == 5
    assert [r["id"] for r in _run(spark, capsys, *store, "context", "a")][:1] == ["r"]
    assert any(r.get("ready") is False for r in _run(spark, capsys, *store, "auto-status"))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Plan\nShip the parser before the summer holidays begin.\n")
    assert _run(spark, capsys, *store, "sources-add", "project_root", str(tmp_path / "docs"))[0]["result"] == 2
    assert {r["action"] for r in _run(spark, capsys, *store, "global-refresh", "--apply")} == {"new", "missing"}
    assert {r["action"] for r in _run(spark, capsys, *store, "global-refresh")} == {"unchanged", "missing"}
    assert _run(spark, capsys, *store, "global-search", "summer holidays")[0]["score"] > 0
    assert _run(spark, capsys, *store, "sources-confirm", "r", "--status", "pending")[0]["result"] == 2
    assert _run(spark, capsys, *store, "sources-cleanup") and _run(spark, capsys, *store, "doctor")[0]["result"]["missing"] == []
    assert _run(spark, capsys, *store, "migrate")[0]["result"]["missing"] == [] and _run(spark, capsys, *store, "version")[0]["result"]
    assert _run(spark, capsys, *store, "sources", "--include", "/w")[0]["id"] == "r"


def test_discover(spark, tmp_path, capsys):
    log = tmp_path / ".claude" / "projects" / "x.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text(json.dumps({"type": "user", "message": {"role": "user", "content": "look at /home/me/proj/src/a.py and docs/plan.md then ssh web-1.example.com"}}))
    skill = tmp_path / ".claude" / "skills" / "deploy" / "SKILL.md"
    skill.parent.mkdir(parents=True)
    skill.write_text("How to deploy")
    rows = {(r["section"], r["path"]) for r in _run(spark, capsys, "discover", str(tmp_path))}
    assert ("project_root", "/home/me/proj") in rows and ("document", "docs/plan.md") in rows and ("server_alias", "web-1.example.com") in rows and ("document", str(skill)) in rows
