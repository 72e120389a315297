import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import chunking, embedding, postings, retrieval


def _corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


def test_bm25_matches_the_formula(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices("a bb ccc dd e_f é 12 zz".split(), k=r.randint(0, 40))) for _ in range(60)]
    terms = ["a", "ccc", "é"]
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    want = {}
    for i, d in enumerate(docs):
        s = 0.0
        for t in terms:
            tf, df = d.count(t), sum(t in x for x in docs)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s > 0:
            want[i] = s
    got = {r.id: r.raw_score for r in retrieval.bm25(_corpus(spark, texts), terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_bm25_facts(spark):
    rows = {r.id: r.raw_score for r in retrieval.bm25(_corpus(spark, ["sqlite store", "nothing here", "sqlite sqlite"]), ["sqlite"]).collect()}
    assert set(rows) == {0, 2} and rows[2] > rows[0] > 0
    assert retrieval.bm25(_corpus(spark, []), ["x"]).count() == 0


def _scanned(spark, rows, terms, k):
    df = spark.createDataFrame(rows, "id string, content string")
    return [(r.id, round(r.raw_score, 9)) for r in retrieval.bm25(df, sorted(terms)).orderBy(F.desc("raw_score"), "id").limit(k).collect()]


def test_postings_give_the_same_ranking(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["common"] * 30
    rows = {f"c{i:05d}": " ".join(r.choices(words, k=r.randint(1, 60))) + (" rare" if i % 700 == 3 else "") for i in range(4000)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, content string")
    index = postings.Postings(spark, str(tmp_path))
    index.update(None, frame(rows))
    for terms in (["rare", "common"], ["w1"], ["w1", "w2", "common"], ["absent"], ["absent", "rare"]):
        assert [(x.id, round(x.raw_score, 9)) for x in index.search(terms, 5).collect()] == _scanned(spark, list(rows.items()), terms, 5), terms
    index.search(["rare", "common"], 5).collect()
    assert index.blocks > 25 and index.read <= 8  # one block of the rare term, those with its chunks of the frequent one
    # one changed, one removed and one new chunk: one small segment, the same ranking as anew
    before = {p: p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()}
    old = {k: rows[k] for k in ("c00003", "c00010")}
    rows |= {"c00003": "rare rare common words", "d": "a rare new one"}
    del rows["c00010"]
    index.update(frame(old), frame({k: rows[k] for k in ("c00003", "d")}))
    after = {p: p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()}
    assert all(after[p] == n for p, n in before.items()) and sum(after.values()) - sum(before.values()) < 60_000
    for terms in (["rare", "common"], ["rare", "new", "w3"]):
        assert [(x.id, round(x.raw_score, 9)) for x in index.search(terms, 5).collect()] == _scanned(spark, list(rows.items()), terms, 5), terms


def test_segments_are_merged_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FAN", 3)
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, content string")
    index, rows = postings.Postings(spark, str(tmp_path)), {}
    for i in range(4):
        old = {k: v for k, v in rows.items() if k == f"c{i - 1}"}
        new = {f"c{i}": f"red fox number {i}", **({f"c{i - 1}": f"blue fox {i}"} if i else {})}
        index.update(frame(old) if old else None, frame(new))
        rows |= new
    assert [s["level"] for s in index._segments()] == [1, 0]
    assert [(x.id, round(x.raw_score, 9)) for x in index.search(["red", "fox"], 10).collect()] == _scanned(spark, list(rows.items()), ["fox", "red"], 10)
    assert index.search([], 3).count() == 0 and postings.Postings(spark, str(tmp_path / "none")).search(["a"], 3).count() == 0


def test_boosts(spark):
    rows = spark.createDataFrame([("project_docs",), ("agent_session",), ("x",), (None,)], "s string")
    assert [r[0] for r in rows.select(retrieval.source_boost("s")).collect()] == [1.0, 0.75, 0.85, 0.85]


def _store(spark):
    docs = spark.createDataFrame([("d1", "/a.md", None), ("d2", "/b.md", None), ("d3", "/c.md", None)], "id string, path string, filename string")
    chunks = spark.createDataFrame([("c1", "d1", None, "alpha beta", "project_docs", [1.0, 0.0]), ("c2", "d2", "H", "alpha", None, [0.6, 0.8]), ("c3", "d3", None, "alpha gamma", None, None)], "id string, document_id string, heading_path string, content string, source_type string, embedding array<double>")
    ledger = spark.createDataFrame([("/b.md", "skipped"), ("/c.md", "error")], "source_path_or_alias string, status string")
    memory = spark.createDataFrame([("m1", "note", "alpha", "delta", "active", "manual", None, None, None, 1.0), ("m2", "note", "alpha", "x", "obsolete", "manual", None, None, None, None)], "id string, type string, title string, content string, status string, source_kind string, source_path string, source_document_id string, source_chunk_id string, confidence double")
    return chunks, docs, ledger, memory


def test_gate_and_fan_out(spark):
    chunks, docs, ledger, _ = _store(spark)
    assert {r.id for r in retrieval.gated_chunks(chunks, docs, ledger).collect()} == {"c1", "c3"}
    twice = ledger.union(spark.createDataFrame([("/a.md", "active"), ("/a.md", "pending")], ledger.schema))
    assert retrieval.gated_chunks(chunks, docs, twice).where("id = 'c1'").count() == 2
    assert retrieval.gated_chunks(chunks, docs, twice, semi=True).where("id = 'c1'").count() == 1
    assert retrieval.gated_chunks(chunks, docs, None).count() == 3


def test_project_search_semantic_first(spark):
    s = _store(spark)
    hits = retrieval.project_search(*s, "alpha", 5, [1.0, 0.0]).collect()
    assert [(h.id, h.score) for h in hits] == [("c1", 1.0)]
    hits = retrieval.project_search(*s, "alpha", 5, [0.0, -1.0]).collect()
    assert {h.id for h in hits} == {"m1", "c1", "c3"}
    assert retrieval.project_search(*s, "...", 5, [1.0, 0.0]).count() == 0
    with pytest.raises(ValueError):
        retrieval.project_search(*s, "alpha", 0)


def test_global_search_kinds(spark):
    s = _store(spark)
    assert {h.id for h in retrieval.global_search(*s, "alpha", kind="memory").collect()} == {"m1"}
    assert {h.id for h in retrieval.global_search(*s, "alpha", kind="chunks").collect()} == {"c1", "c3"}
    top = retrieval.global_search(*s, "alpha").first()
    assert (top.id, top.score) == ("m1", 10.0)
    for bad in ({"top_k": 0}, {"excerpt_chars": 10}, {"kind": "x"}):
        with pytest.raises(ValueError):
            retrieval.global_search(*s, "alpha", **bad)


def test_vector_search(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0])], "point_id string, vector array<double>")
    assert [r.point_id for r in retrieval.vector_search(points, [0.9, 0.1, 0.0], 5).collect()] == ["a", "b"]


def test_chunker_facts():
    parts = list(chunking.split_text("# A\r\nintro\n## B\nbody\n# C\n" + "x" * 30, 20))
    assert parts == [("# A\nintro", "A"), ("## B\nbody", "A > B"), ("# C", "C"), ("x" * 30, "C")]
    assert list(chunking.split_text(" \n ", 10)) == []
    assert list(chunking.split_text("a\nb\nc", 4)) == [("a\nb", None), ("c", None)]


def test_chunk_frame(spark):
    docs = spark.createDataFrame([("d", "# T\none two"), ("e", None)], "id string, text string")
    r = chunking.chunk(docs).collect()
    assert [(x.id, x.chunk_index, x.heading_path, x.token_count, len(x.content_hash)) for x in r] == [("d", 0, "T", 4, 64)]


def test_embedding_matches_the_formula(spark):
    texts = ["Red fox, red FOX!", "été 12", "...", "a b c d e f g"]
    rows = embedding.embed(_corpus(spark, texts)).collect()
    got = {r.id: r.embedding for r in rows}
    for i, t in enumerate(texts):
        assert len(got[i]) == 384 and all(abs(x - y) < 1e-12 for x, y in zip(got[i], embedding.embed_text(t), strict=True))
    with pytest.raises(ValueError):
        embedding.embed_text("  ")


def test_sha2_embedding_matches_plain_code(spark):
    texts = ["Red fox, red FOX!", "", "...", None, "a b c d e f g a b a " * 50]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    got = {r.id: r.embedding for r in embedding.embed_sha2(docs).collect()}
    for i, t in enumerate(texts):
        want = [0.0] * 384
        for w in re.findall(r"\w+", (t or "").lower()):
            h = hashlib.sha256(w.encode()).hexdigest()
            want[int(h[:7], 16) % 384] += 1 if int(h[7], 16) % 2 == 0 else -1
        n = sum(x * x for x in want) ** 0.5 or 1.0
        assert all(abs(x - y / n) < 1e-12 for x, y in zip(got[str(i)], want, strict=True)), t
    assert embedding.embed(docs).where("id = '3'").first().embedding == [0.0] * 384


def test_embedding_shuffles_nothing(spark):
    docs = spark.createDataFrame([("a", "b")], "id string, content string")
    for f in (embedding.embed, embedding.embed_sha2):
        assert "Exchange" not in f(docs)._jdf.queryExecution().executedPlan().toString()


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.strip(F.lit("\u00a0\t a b \u2003\n"))) == "a b"
    assert one(T.excerpt(F.lit("a  b\n" + "c" * 90), 20)) == "a b " + "c" * 13 + "..."
    assert one(T.first_line_title(F.lit("  first line \nrest"))) == "first line"
    assert one(T.first_line_title(F.lit("  "))) == "Untitled memory"
    assert one(T.suffix(F.lit("/a/b.tar.GZ"))) == ".gz" and one(T.suffix(F.lit("/a/.bashrc"))) == ""
    assert one(T.path_inside(F.lit("C:\\A\\b"), F.lit("c:/a/"))) and not one(T.path_inside(F.lit("/ab"), F.lit("/a")))
    assert one(T.round_half_even(F.lit(0.33335), 4)) == 0.3333
    assert one(T.strip_preamble_context(F.lit("INGESTION_METADATA {}\n\none\n\ntwo\n\nthree"))) == "two\n\nthree"
    assert one(T.strip_preamble_search(F.lit("INGESTION_METADATA {}\r\n\r\nbody"))) == "body"
    assert one(T.strip_preamble_candidate(F.lit("INGESTION_METADATA {}"))) == ""
    assert one(T.strip_preamble_search(F.lit("INGESTION_METADATA {}"))) == "INGESTION_METADATA {}"


def test_no_text_or_vector_is_shuffled(spark, tmp_path):
    """With broadcasts off, no exchange of a search plan carries contents or embeddings."""
    import re

    from recollect.plans import fixtures as fx
    from recollect.plans import search_queries as Q

    d, tables = "/root/testdata/sf0.001", {}
    for name, df in (("chunks", Q._vector_chunks(spark, d)), ("documents", fx.documents(spark, d)), ("ledger", fx.ledger(spark, d))):
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    args = (tables["chunks"], tables["documents"], tables["ledger"])
    vector = tables["chunks"].first().embedding
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        for df in (retrieval.search_chunks(*args, "storage of texts").orderBy("score").limit(5), retrieval.semantic_hits(*args, vector, 5)):
            moved = re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", df._jdf.queryExecution().explainString(mode))
            assert moved and not any(re.search(r"\b(content|body|text|embedding)#", x) for x in moved), moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _worker(monkeypatch, df, operator):
    """The batch function that an operator hands to Spark."""
    held = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: held.append(fn) or self)
    operator()
    monkeypatch.undo()
    return held[0]


def test_vectors_come_in_bounded_parts(spark, monkeypatch):
    """A worker holds the vectors of a slice, not of all rows that Spark sends at once."""
    docs = spark.createDataFrame([], "id long, content string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([[f"a{i}", "b"] for i in range(5000)])], ["id", "tokens"])
    for f in (embedding.embed, embedding.embed_sha2):
        parts = list(_worker(monkeypatch, docs, lambda: f(docs))(iter([batch])))
        assert max(p.num_rows for p in parts) <= 1000 and [i for p in parts for i in p["id"].to_pylist()] == list(range(5000))


def test_chunks_come_in_bounded_parts(spark, monkeypatch):
    """Paths of headings repeat their titles in each chunk; a batch of chunks stays bounded all the same."""
    text = "# " + "t" * 20_000 + "\n" + "\n".join(f"line {i} " + "x" * 100 for i in range(1000))
    docs = spark.range(0, 3, 1, 1).select("id", F.lit(text).alias("text"))
    rows = chunking.chunk(docs, "text", 100).select("id", "chunk_index", F.length("heading_path").alias("n"))
    want = [(i, k, u and len(u)) for i in range(3) for k, (_, u) in enumerate(chunking.split_text(text, 100))]
    assert sorted(map(tuple, rows.collect())) == want
    named = spark.createDataFrame([], "id long, content string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([text] * 3)], ["id", "content"])
    assert max(p.nbytes for p in _worker(monkeypatch, named, lambda: chunking.chunk(named, "content", 100, ("id",)))(iter([batch]))) < 8 << 20


def test_postings_are_counted_without_a_shuffle(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path))
    new = spark.createDataFrame([("a", "x y x"), ("a", "y x z"), ("b", ""), ("c", None), ("d", "é É y")], "id string, content string")
    posts = index._counted(new, "content")
    assert "Exchange" not in posts._jdf.queryExecution().toString() and ("d", "é", 2, 3) in {(r.id, r.term, r.tf, r.dl) for r in posts.collect()}
    index.update(None, new)
    at = index._segments()[0]["at"]
    stats = {r["term"]: (r["df"], r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/stats/{at}").collect()}
    assert stats == {None: (0, 5, 9), "x": (1, 0, 0), "y": (2, 0, 0), "z": (1, 0, 0), "é": (1, 0, 0)}
