"""Operators 11 to 13 against DuckDB or brute force, on odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import divergence, importance, voronoi


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(map(tuple, con.execute(sql).fetchall()), key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


BENCH = ["the quick brown fox", None, "", "lazy dog café ÉTÉ 日本語 the The"]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)], "item_id long, text string")


# --- 11


def _runs(words, n):
    return [" ".join(words[i:j]).encode() for j in range(1, len(words) + 1) for i in range(max(0, j - n), j)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ring_is_the_crc_of_every_run(n, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 16)
    r = random.Random(n)
    for _ in range(60):
        text = "".join(r.choice(" abC1,é日_\n") for _ in range(r.randint(0, 200)))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower).split(" ")
        words = [w for w in words if w]
        ring, found = importance.CrcRing(n), []
        for block in importance.blocks(text.encode()):
            found += ring.feed(block)
        assert found == [zlib.crc32(x) for x in _runs(words, n)]
        n_words, ids, counts = importance.histogram(text.encode(), importance.Draw(n=n, buckets=7))
        want = np.bincount(np.array([zlib.crc32(x) % 7 for x in _runs(words, n)], np.int64), minlength=7)
        assert n_words == len(words) and (want[ids] == counts).all() and want.sum() == counts.sum()


def test_resampling_equals_sql(spark, odd, bench):
    docs = odd.union(odd.where("doc_id between 6 and 9")).unionByName(
        spark.range(100, 400).selectExpr("id as doc_id", "repeat(concat('the w', id % 9, ' dog '), cast(5 + id % 7 as int)) as text"), allowMissingColumns=True
    )
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    found = _rows(importance.resample(docs, bench).select(columns))
    assert found == _sql(f"select {', '.join(columns)} from ({importance.ORACLE_SQL})", documents=docs.select("doc_id", "text"), benchmark=bench)
    ranks = sorted(r[4] for r in found if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20


def test_resampling_of_nothing(none, odd, bench):
    assert importance.resample(none, bench).count() == 0
    assert importance.resample(odd, bench.where("false")).count() == odd.count()


# --- 12

VECTORS = "vec_id long, embedding array<double>, rank int, score string"


def _brute(rows, k, every):
    fine = sorted({(i, tuple(float(np.floor(64 * x)) for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(64 * x) for x in v)})
    out = []
    for q, v in fine:
        if q % every == 0:
            scores = [(max(1 - 2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w, strict=True)))), i) for i, w in fine if i != q and len(w) == len(v)]
            out += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("c", [voronoi.Cells(), voronoi.Cells(wanted=20, pivots=40, ring=8, block=4, rings=2)])
def test_top_k_equals_brute_force(spark, c):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) * 0.2 + (i % 4)).tolist(), 1, "x") for i in range(400)]
    rows += [(1000 + i, rows[20][1], 1, "x") for i in range(90)]  # one vector many times
    rows += [(2000 + i, [0.0] * 5 + [0.01 * (i % 3)], None, None) for i in range(60)]  # ties
    rows += [rows[40], rows[41], (3000, [1.0, 2.0], 1, "x"), (3001, [2.0, 1.0], 1, "x"), (3020, [5.0], 1, "x"), (None, [1.0] * 6, 1, "x")]
    rows += [(4000 + i, v, 1, "x") for i, v in enumerate([None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1e308] * 6])]
    found = _rows(voronoi.top_k(spark.createDataFrame(rows, VECTORS), 5, 20, c))
    assert found == _brute(rows, 5, 20)


def test_top_k_of_large_values_is_exact(spark):
    rows = [(i, [float(2**28 + i), float(2**29 - 3 * i), -1.5], 1, "x") for i in range(45)] + [(60 + i, [1e30, -1e30, float(i)], 1, "x") for i in range(3)]
    assert _rows(voronoi.top_k(spark.createDataFrame(rows, VECTORS), 4, 20)) == _brute(rows, 4, 20)


def test_rings_are_left_out_without_loss(spark):
    """Tight clusters: bounds rule most pairs of blocks and rings out, and results stay those of brute force."""
    r = np.random.default_rng(5)
    centres = np.eye(8) * 20
    rows = [(i, (centres[i % 8] + r.normal(size=8) * 0.01).tolist(), 1, "x") for i in range(800)]
    pivots = voronoi.Pivots([x[1] for x in rows[:160]], 8)
    _, need = voronoi.bounds(np.array([rows[0][1]]), pivots, 6)
    assert (need[0] > 1).sum() == 7
    c = voronoi.Cells(wanted=100, pivots=160, ring=25, block=8)
    assert _rows(voronoi.top_k(spark.createDataFrame(rows, VECTORS), 5, 20, c)) == _brute(rows, 5, 20)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 1, "x")], VECTORS)
    assert voronoi.top_k(none).collect() == [] and voronoi.top_k(none.where("false")).columns == ["query_id", "rank", "vec_id", "score"]
    assert voronoi.top_k(spark.createDataFrame([(20, [1.0], 1, "x")], VECTORS)).collect() == []


# --- 13


def test_divergence_equals_sql(spark, odd):
    docs = odd.union(odd.where("doc_id between 6 and 9")).unionByName(
        spark.range(100, 500).selectExpr("id as doc_id", "concat('Alpha é', char(97 + id % 11), ' beta beta', id % 5, ' ', repeat(char(98 + id % 17), 3), ' ', repeat('gamma ', cast(id % 3 as int))) as text", "if(id % 3 = 0, 'en', 'de') as lang", "concat('s', id % 6) as source"), allowMissingColumns=True
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    found = _rows(divergence.audit(docs).select(columns))
    assert found == _sql(f"select {', '.join(columns)} from ({divergence.ORACLE_SQL})", documents=docs.select("doc_id", "text", "lang", "source"))
    assert {r[2] for r in found} == {"pair", "term"}


def test_divergence_of_nothing(none, odd):
    assert divergence.audit(none).count() == 0
    few = divergence.audit(odd.limit(3))  # no term is kept
    assert {(r["part"], r["value"]) for r in few.collect()} <= {("pair", 0)}


def test_radix_selects_what_sorting_does(spark):
    r = random.Random(2)
    rows = [(f"g{r.randint(0, 5)}", r.choice([0, 1, 7, 2**16, 2**40 + r.randint(0, 3)]), "prefix-that-ties-" * r.randint(0, 1) + f"é{i}") for i in range(3000)] + [("one", 5, "x")]
    df = spark.createDataFrame(rows, "g string, value long, item string")
    found = {tuple(x) for x in divergence.radix_top(df, ["g"], "value", "item", 7).collect()}
    want = set()
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:7]
        want |= {(*x, n) for n, x in enumerate(own, 1)}
    assert found == want


def test_tiles_of_many_sources(spark):
    """More sources than a tile, and one term that more have than are taken at once."""
    r = np.random.default_rng(1)
    n = 8 * divergence.TILE + 40
    base = r.integers(1, 50, n)
    terms = [sorted(r.choice(n, 200, replace=False)), list(range(n)), [5], [3, n - 1]]
    shares = [[(int(i), int(base[i] + r.integers(1, 1000)), int(base[i])) for i in own] for own in terms]
    df = spark.createDataFrame([("en", x) for x in shares], "lang string, of array<struct<i:int,p:long,base:long>>")
    want = np.zeros((n, n), np.int64)
    for own in shares:
        i, p, b = np.array(own).T
        f = divergence.f
        want[np.ix_(i, i)] += f(p[:, None], p[None]) - f(p[:, None], b[None]) - f(b[:, None], p[None]) + f(b[:, None], b[None])
    got = np.zeros((n, n), np.int64)
    rows = divergence._tiles(df).toPandas()
    got[rows["a"], rows["b"]] = rows["both"]
    assert (np.triu(want, 1) == got).all()


def test_shares_of_large_counts_are_exact(spark):
    n, total, terms = 9 * 10**17, 10**18, 10**6
    df = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"))
    assert df.head()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
