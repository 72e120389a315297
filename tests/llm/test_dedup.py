import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import line_dedup, near_dup
from recollect.llm.components import components
from recollect.llm.near_dup import Plan


def _plain(rows, plan):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(zip(*(w[k:] for k in range(plan.width)))) if len(w) >= plan.width else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and plan.den * len(x & y) >= plan.num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}


def _family(r, words, n, i0):
    """Copies of a text with more and more words replaced."""
    base = [r.choice(words) for _ in range(60)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(60)] = r.choice(words)
        out.append((i0 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, width):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows = [x for f in range(8) for x in _family(r, words, 2 + 5 * f, 1000 * f)]
    rows += [(9000 + i, " ".join(r.choices(words, k=40))) for i in range(60)] + [(9900, rows[0][1]), (9901, rows[0][1].upper()), (9902, None), (9903, "one"), (9904, "One")]
    plan = Plan(width=width)
    got = {x.doc_id: x for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plan).collect()}
    want = _plain(rows, plan)
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_large_bucket_of_near_copies(spark):
    """Hundreds of copies that differ in one word each are one group."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[41:])) for i in range(300)]
    assert {x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Plan(width=2)).collect()} == {0}


def test_pairs_within_a_family_below_the_threshold(spark):
    """600 documents of one template at 0.789; 40 pairs in the middle of the ids share one word more (0.817)."""
    def text(i):
        w = [f"w{k}" for k in range(120)]
        for k in range(7):
            w[10 + 15 * k] = f"p{i // 2}" if k == 0 and 200 <= i < 280 else f"x{i}s{k}"
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs, Plan(width=2)).collect()}
    assert got == {i: i - i % 2 if 200 <= i < 280 else i for i in range(600)}


def test_crossing_pairs_hold_all_similar_ones(spark):
    r = random.Random(8)
    sets = []
    for i in range(150):
        s = set(range(60)) - set(r.sample(range(60), 4)) | {r.randrange(60, 500) for _ in range(r.randint(0, 12))}
        sets.append((i, i % 7, sorted(s)))
    plan = Plan()
    got = {(x.a, x.b) for x in near_dup.crossing(spark.createDataFrame(sets, "id long, c long, s array<long>").repartition(3), plan).collect()}
    want = {(a, b) for a, c, s in sets for b, d, t in sets if a < b and c != d and 100 * len({*s} & {*t}) >= 80 * len({*s} | {*t})}
    assert want and want <= got and all(a % 7 != b % 7 for a, b in got)


def test_short_keys_are_minhashes():
    plan = Plan(side=2, rows=2)
    a, b = np.arange(100, dtype=np.uint64) * np.uint64(7919), np.arange(100, dtype=np.uint64) * np.uint64(7919)
    assert (near_dup.short_keys([a], plan) == near_dup.short_keys([b[::-1].copy()], plan)).all()
    assert near_dup.short_keys([a, b + np.uint64(1)], plan).shape == (2, 4)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_components_of_a_long_chain_take_few_steps(spark, monkeypatch, shuffled):
    """100,000 nodes in a row: the number of tables written grows with the logarithm."""
    from recollect.llm import components as module

    names, n = [], 100_000
    monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: names.append(name) or f(df, name))
    ids = list(range(n))
    if shuffled:
        random.Random(2).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").repartition(4)
    assert components(links).groupBy().agg(F.min("component"), F.max("component"), F.count("*")).collect() == [(0, 0, n)]
    assert names.count("least") <= (1 if not shuffled else 17) and names.count("up") <= 20 + 4 * names.count("least")


def test_parity_bitmaps_differ_in_no_more_bits_than_sets():
    r = np.random.default_rng(4)
    for n in (0, 1, 30, 500, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 9], r.integers(0, 2**63, n // 7).astype(np.uint64)]))
        x, y = near_dup.parity([a, b])
        assert sum(int(v).bit_count() for v in x ^ y) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_odd_near_duplicates(odd, none):
    rows = near_dup.near_duplicates(odd, Plan(width=2)).collect()
    assert len(rows) == odd.count() and near_dup.near_duplicates(none, Plan()).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[7][0].component_id == 6 and not by[7][0].kept and len(by[6]) == 4 and all(r.kept for r in by[6])
    assert by[None][0].component_id is None and by[None][0].kept is False
    assert all(r.n_shingles == 0 and r.kept for i in (0, 1, 2, 3) for r in by[i])
    left = near_dup.drop_near_duplicates(odd, Plan(width=2))
    assert left.columns == odd.columns and left.where("doc_id = 7").count() == 0 and left.where("doc_id is null").count() == 1


def _lines(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            seen.setdefault(k, set()).add(i)
    gone = {k for k, v in seen.items() if len(v) >= least}
    return {i: "\n".join(x for x in (t or "").split("\n") if key(x) not in gone) for i, t in rows}


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (9, 3)])
def test_lines_against_plain_code(spark, batches, fan):
    import hashlib

    r = random.Random(6)
    pool = ["Common Line", " common line\t", "ÉTÉ", "été", "", " ", "rare"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 8)))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in line_dedup.line_dedup(docs, 10, batches, fan).collect()}
    want = _lines(rows, 10)
    assert {i: x.kept_sha256 for i, x in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert all(x.n_lines == len((t or "").split("\n")) for (i, t) in rows for x in [got[i]])
    texts = {x.doc_id: x.text for x in line_dedup.drop_lines(docs, 10, batches, fan).collect()}
    assert all((texts[i] or "") == want[i] for i in want)


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(2)
    for i in range(5):
        runs.add(spark.createDataFrame([(k, -k, 1) for k in range(i, i + 3)], "h1 long, h2 long, n long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = {r.h1: r.n for r in runs._union(runs.runs()).groupBy("h1").agg(F.sum("n").alias("n")).collect()}
    assert total == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2, 6: 1}
    assert {r.h1 for r in runs.unseen(spark.createDataFrame([(3, -3, 1), (9, -9, 1)], "h1 long, h2 long, n long")).collect()} == {9}


def test_lines_use_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_lines(odd, none):
    rows = line_dedup.line_dedup(odd, 2).collect()
    assert len(rows) == odd.count() and line_dedup.line_dedup(none).count() == 0
    assert all(r.n_lines == 1 and r.n_dropped == 0 for r in rows if r.doc_id in (0, 1))
    out = line_dedup.drop_lines(odd, 2)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("doc_id = 0 and text is null").count() == 1


def test_line_oracle(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.sql(line_dedup.ORACLE_SQL).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op5_line_dedup(spark, d).collect()}
    assert got == want


def test_an_id_with_several_texts_is_one_node(spark):
    a, b, c = ("one two three four five six seven", "red blue green grey black white pink", "up down left right here there now")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (12, c), (20, "something else"), (20, ""), (21, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, near_dup.OP4).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (12, 3, False), (20, 20, True), (20, 20, True), (21, 21, True), (None, None, False)], key=str)
