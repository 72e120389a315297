import random

from pyspark.sql import functions as F

from recollect.operators import context, names


def _frames(spark, texts, sought):
    return spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in sought], "name string")


def test_pairs_against_a_loop(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abß/ ") for _ in range(n))
    texts = [word(rng.randint(0, 40)) for _ in range(120)] + ["", None, "x" * 30_000 + "needle-in-hay", "ab" * 9, "ab" * 9, "😀abc"]
    sought = [word(rng.randint(0, 12)) for _ in range(60)] + ["", None, "needle-in-hay", "ab", "ab", "x", "😀a", "absent-name"]
    got = sorted((r.text, r.name) for r in names.pairs(*_frames(spark, texts, sought)).collect())
    assert got == sorted((t, n) for t in set(texts) - {None, ""} for n in set(sought) - {None, ""} if n in t)


def test_no_names_or_no_texts(spark):
    assert names.pairs(*_frames(spark, [], ["a"])).collect() == []
    assert names.pairs(*_frames(spark, ["a"], [])).collect() == []
    assert names.pairs(*_frames(spark, ["a"], ["", None])).collect() == []


def test_repeated_rows_stay(spark):
    rows = spark.createDataFrame([("k", "at src5", 1), ("k", "at src5", 1), ("m", None, 2), ("n", "at src6", 3)], "id string, t string, text int")
    found = names.holding(rows, "t", spark.createDataFrame([("src5",), ("src",)], "name string").where("name = 'src5'"))
    assert [(r.id, r.text) for r in found.collect()] == [("k", 1), ("k", 1)]


def test_related_servers_join_by_key(spark):
    catalog = spark.createDataFrame([(f"h{i}", "server_alias", [f"seen in Proj{i % 7}x", "log"]) for i in range(200)] + [("none", "server_alias", None), ("d", "document", ["proj1x"])], "id string, source_type string, discovered_from array<string>")
    roots = spark.createDataFrame([(" Proj1X ", None), (None, "/srv/none"), ("", ""), ("proj3x", "/srv/p")], "project_name string, path_or_alias string")
    got = context.related_servers(catalog, roots)
    assert sorted(r.id for r in got.collect()) == sorted(f"h{i}" for i in range(200) if i % 7 in (1, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the one nested loop reads a single row of lengths
    loops = [line for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line]
    assert all("LeftSemi" not in line for line in loops)
    assert got.groupBy().agg(F.count("*")).first()[0] == got.count()
