from pyspark.sql import functions as F

from recollect.operators import catalog, context, discovery
from recollect.plans import registry
from recollect.streaming import streams


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_paths(spark):
    t = F.lit('see /home/me/proj/src/a.py, and C:\\Users\\me\\Documents\\App\\x.txt "/etc/x/y"')
    assert _one(spark, discovery.paths(t)) == ["C:\\Users\\me\\Documents\\App\\x.txt", "/home/me/proj/src/a.py"]
    roots = {"/home/me/proj/src/a.py": "/home/me/proj", "C:\\Users\\me\\Documents\\App\\x.txt": "C:\\Users\\me\\Documents\\App", "D:/software/tool/src/x": "D:\\software\\tool", "/opt/app/node_modules/x": "/opt/app", "/var/www/site/x": "/var/www/site", "/home/me/.claude/x": None, "/etc/x": None, "E:/software/x": None, "C:/work/src/x": "C:\\work", "/mnt/c/w/p/q": "/mnt/c/w/p"}
    for p, want in roots.items():
        assert _one(spark, discovery.project_root(F.lit(p))) == want, p


def test_docs_and_hosts(spark):
    assert _one(spark, discovery.doc_paths(F.lit("docs/a.md README.md notes.txt https://x.y/z.md (/abs/b.yaml). x/.codex/skills/s.md"))) == ["docs/a.md", "README.md", "/abs/b.yaml"]
    assert _one(spark, discovery.hosts(F.lit("ssh web-1 then ssh root@10.0.0.5; ssh to ssh me@db.example.com ssh bare"))) == ["web-1", "10.0.0.5", "db.example.com"]


def test_merge_keeps_first_spelling_and_order(spark):
    rows = spark.createDataFrame([("B", "l2", 3), ("b", "l1", 1), ("B", "l1", 2), ("c", "l1", 4)], "v string, label string, at int")
    got = {r.key: (r.v, r.discovered_from) for r in discovery.merge_sources(rows, "v", "label", "at").collect()}
    assert got == {"b": ("b", ["l1", "l2"]), "c": ("c", ["l1"])}


def _roots(spark):
    return spark.createDataFrame([("1", "alpha", "/w/alpha"), ("2", "beta", "/w/alpha-two"), ("3", None, "/w/gamma/")], "id string, project_name string, path_or_alias string")


def test_resolution_phases(spark):
    get = lambda q: [(r.id, r.method, r.ambiguous) for r in context.resolve(_roots(spark), q).orderBy("id").collect()]
    assert get(" ALPHA ") == [("1", "exact_name", False)]
    assert get("/W/alpha-two/") == [("2", "path_alias", False)]
    assert get("gamma") == [("3", "basename", False)]
    assert get("alph") == [("1", "substring", True), ("2", "substring", True)]
    assert get("zzz") == []


def test_containment_is_sibling_safe(spark):
    docs = spark.createDataFrame([("a", "/w/alpha/x.md"), ("b", "/w/alpha-two/x.md"), ("c", "/w/alpha"), ("d", None)], "id string, path string")
    assert {r.id for r in context.inside_any(docs, "path", "id", _roots(spark).where("id = '1'")).collect()} == {"a", "c"}


def test_catalog(spark):
    rows = spark.createDataFrame([("1", "document", "/a", None, ["x"], "pending"), ("2", "document", "/b", None, ["y"], "confirmed")], "id string, source_type string, path_or_alias string, project_name string, discovered_from array<string>, confirmation_status string")
    assert {r.id for r in catalog.select_entries(rows, ("/A", " "), ()).collect()} == {"1"}
    assert {r.id for r in catalog.select_entries(rows, (), ("y",)).collect()} == {"1"}
    assert catalog.confirmed(catalog.confirm(rows, ["1"])).count() == 2
    assert catalog.upsert(rows, rows.where("id = '1'").withColumn("path_or_alias", F.lit("/c"))).where("path_or_alias = '/c'").count() == 1


def test_quiet_sessions_batch(spark):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:01:00"), (1, "2026-01-01 00:10:00")], "user_id int, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in streams.quiet_sessions(rows).collect()) == [1, 2]


def test_every_query_has_a_stable_schema(spark):
    for name in ("bm25_topk", "refresh_classify", "task_rollup", "extract_paths"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").schema.fields
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_no_cross_product_in_containment(spark):
    docs = spark.createDataFrame([("a", "/w/alpha/x.md")], "id string, path string")
    plan = context.inside_any(docs, "path", "id", _roots(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_document_paths_of_long_runs_take_linear_time(spark):
    """The pattern is tried where a run begins only; what it finds is what every start would give."""
    import time

    old = discovery.DOC_PATH.replace("""(?<![^\\s"'<>|])""", "")
    assert old != discovery.DOC_PATH
    texts = ["a.md", "x/a.md.txt y", "'b.json'|c.tomlx>d.YAML.z", "a.mdb.md b.m d.yml.", ".md", "a..txt.txtt\ta.mD", "no end.", "p/q.md,r.json;s"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~discovery._found("t", discovery.DOC_PATH).eqNullSafe(discovery._found("t", old))).count() == 0
    began = time.time()
    assert spark.range(1).select(F.size(discovery.doc_paths(F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), 100_000)))).first()[0] == 0
    assert time.time() - began < 10
