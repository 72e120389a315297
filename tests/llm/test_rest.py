import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import ann, packing, pieces

WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
STRANGE = ["It's I'M don't ÀÉ ÇA ŒUVRE ß ẞ ǅ Σίσυφος ΟΔΟΣ <|endoftext|> a", "a\x1cb \x85c d e", "é a ́b 12ab34 !?.. hello!!WORLD ﬁ ½ ² 　中文 🙂🙂x İI", "naïve.\n\ntab\tx", "", "a​b", "ÿŸ×÷", "l'été s'il 'sth 'LL a_b x<| |> Å Ω K", "foo&&& bar%%% baz'&& q!'s", "▁▁▁  x", "   ", "a\r\n};\r\n", "<s> hi </s> <0x41>"]


def _mixed(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(" ab\ncthe.}\r;)é日🙂1▁'AÉ") for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_word_ids_are_the_tokenizers():
    ours, theirs = packing.WordTokenizer(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    for t in STRANGE + _mixed(1500):
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


def _place(histogram, cap):
    """Every piece of a plan with its bin and offset."""
    out = []
    for size, a, b, first, each, offset in packing.plan(histogram, cap):
        out += [(size, r, first + (r - a) // each, offset + size * ((r - a) % each)) for r in range(a, b)]
    return out


@pytest.mark.parametrize("cap", [packing.Capacity(64), packing.Capacity(64, documents=3), packing.Capacity(64, attention=2500), packing.Capacity(64, 5, 3000, rule="dot")])
def test_plan_keeps_every_constraint(cap):
    r = random.Random(7)
    tokens, documents, attention = cap.limits()
    for _ in range(40):
        most = int(min(tokens, attention**0.5))
        histogram = {s: r.randint(1, 30) for s in r.sample(range(1, most + 1), 12)}
        placed = _place(histogram, cap)
        assert sorted((s, k) for s, k, _, _ in placed) == sorted((s, k) for s, n in histogram.items() for k in range(n))
        bins = {}
        for s, _, b, o in placed:
            bins.setdefault(b, []).append((o, s))
        for rows in bins.values():
            rows.sort()
            assert rows[0][0] == 0 and all(o + s == p for (o, s), (p, _) in zip(rows, rows[1:], strict=False))
            assert sum(s for _, s in rows) <= tokens and len(rows) <= documents and sum(s * s for _, s in rows) <= attention


def test_plan_is_close_to_the_bound():
    r = random.Random(8)
    histogram = {s: r.randint(1, 400) for s in range(1, 513)}
    n = len({b for _, _, b, _ in _place(histogram, packing.Capacity(1024))})
    assert n <= 1.01 * sum(s * k for s, k in histogram.items()) / 1024 + 1


def test_pieces_are_exact(spark, odd, none):
    theirs = Tokenizer.from_file(WORD_FILE)
    rows = packing.pack(odd).collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    for i, t in ((0, None), (1, ""), (9, odd.where("doc_id = 9").first().text), (12, odd.where("doc_id = 12").first().text)):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted((x.piece, x.start, x.length, x.ids_crc32) for x in by[i])
        assert got == [(k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    used = {}
    for x in rows:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in used.values():
        v.sort()
        assert v[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(v, v[1:], strict=False)) and v[-1][0] + v[-1][1] <= 4096
    assert packing.pack(none).count() == 0


def test_encode_is_the_librarys(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    texts = STRANGE + _mixed(400, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 50, 1 << 18):
        rows = pieces.encode(docs, most=most, keep_ids=True).collect()
        assert all(r.ids == sp.encode(texts[r.doc_id]) for r in rows), most
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, keep_ids=True)).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_lattice_is_the_workers_fold(spark):
    table = pieces.piece_table(PIECE_FILE)
    words = sorted({w for t in STRANGE + _mixed(200, 3) for w in pieces._WORD.findall(pieces.marked(t)) if len(w) <= pieces.MAX_CHARS})
    rows = pieces.word_ids(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()
    assert len(rows) == len(words) and all(list(r.ids) == np.frombuffer(table.ids(r.word), "<u4").tolist() for r in rows)
    assert all(table.ids(w) == table._long(w) for w in words)


def test_odd_pieces(odd, none):
    rows = pieces.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows) and pieces.encode(none).count() == 0
    assert all(r.n_pieces == 0 for r in rows if r.doc_id in (0, 1))


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = [(-float(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), j) for j, w in ok if j != i]
            out[i] = [(j, -c) for c, j in sorted(s)[:k]]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)], 0) for i in range(120)]
    rows += [(200 + i, [1.0] * 8, 0) for i in range(12)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] * 8, 0), (304, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    got = {}
    for x in ann.nearest(_vectors(spark, rows), 5, 10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = _brute([r for r in rows if r[1] is None or len(r[1]) == 8], 5, 10)
    assert got.keys() == want.keys()
    for q, v in got.items():
        v.sort()
        assert [a for a, _, _ in v] == [1, 2, 3, 4, 5][: len(want[q])]
        assert [round(c, 6) for _, _, c in v] == [round(c, 6) for _, c in want[q]]
    assert [b for _, b, _ in sorted(got[200])] == [201, 202, 203, 204, 205]


def test_recall_over_shards(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 24))
    x = centres[r.integers(40, size=4000)] + 0.6 * r.normal(size=(4000, 24))
    rows = [(i, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(x)]
    got = {}
    for y in ann.nearest(_vectors(spark, rows), 5, 50, ann.Graph(shard=1500)).collect():
        got.setdefault(y.query_id, set()).add(y.vec_id)
    want = _brute(rows, 5, 50)
    assert np.mean([len(got[q] & {j for j, _ in v}) / 5 for q, v in want.items()]) > 0.95


def test_ties_and_repeats_are_exact(spark):
    """One direction in 40 lengths, neighbours a millionth apart, one row seven times, more ties than a search keeps, and clashing names."""
    r = np.random.default_rng(8)
    rows = [(50 + i, [2.0**i, 2.0**i], 0) for i in range(40)]  # all cosines are exactly 1
    rows += [(101 + i, [1.0, -1.0 + 1e-6 * i], 0) for i in range(39)] + [(100, [1.0, -1.0], 0)]
    rows += [(7, [1.0, 0.0], 0)] * 7 + [(i, [1.0, 0.0], 0) for i in (8, 9, 11, 12)] + [(200, [1.0, 0.0], 0), (201, [1.0, 0.125], 0)]
    for some, graph in ((rows, ann.Graph()), (rows, ann.Graph(search=8, shard=30))):
        df = _vectors(spark, some).withColumns({"score": F.lit(1.0), "rank": F.lit("x"), "query_id": F.lit(None).cast("int")})
        got = sorted((x.query_id, x.rank, x.vec_id) for x in ann.nearest(df, 5, 50, graph).collect())
        distinct = list({(i, tuple(v)): (i, v, 0) for i, v, _ in some}.values())
        want = []
        for q, v, _ in distinct:
            if q % 50 == 0:
                a = np.array([v])
                scores = sorted((-ann.cosine(a, np.array([w]))[0], i) for i, w, _ in distinct if i != q)
                want += [(q, n, i) for n, (_, i) in enumerate(scores[:5], 1)]
        assert got == sorted(want)
    many = [(i, [float(x) for x in np.array([1.0, 2.0]) * 2.0 ** r.integers(-60, 60)], 0) for i in range(600)]
    got = sorted((x.query_id, x.rank, x.vec_id) for x in ann.nearest(_vectors(spark, many), 5, 300).collect())
    assert [x[2] for x in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_recall_of_the_given_table(spark):
    """The production parameters on sf0.1, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for y in ann.nearest(df).collect():
        got.setdefault(y.query_id, set()).add(y.vec_id)
    want = _brute([(x.vec_id, [float(a) for a in x.embedding], 0) for x in df.collect()], 5, 50)
    assert got.keys() == want.keys() and np.mean([len(got[q] & {j for j, _ in v}) / 5 for q, v in want.items()]) > 0.9


def test_no_or_few_vectors(spark):
    assert ann.nearest(_vectors(spark, [])).count() == 0
    assert ann.nearest(_vectors(spark, [(0, [1.0, 0.0], 0)])).count() == 0
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(_vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)])).collect()] == [(0, 1, 1)]


def test_pipeline_on_a_small_table(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = corpus_pipeline.run(spark, d)
    n = rows.select("doc_id").distinct().count()
    assert 0 < n < docs.count() and [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, d)
    assert first.columns == docs.columns
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_on_odd_rows(spark, odd, none, labels, tmp_path):
    """Null ids and texts, repeated rows and clashing columns go through every stage; an empty table stays empty."""
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    prose = "seven grey herons stood beside a cold river while two old friends spoke of boats and nets and the price of salt"
    more = odd.where("doc_id = 12").withColumn("text", F.lit(prose + " last mail a@b.org"))
    for docs, full in ((odd.unionByName(more), True), (none, False)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, columns = docs.count(), docs.columns
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{full}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{full}{k}"))
            if name != "packing":
                assert docs.columns == columns and docs.count() <= before and (docs.count() > 0) == full
            if name in ("line_dedup", "pii"):
                assert docs.count() == before and docs.where("n_chars <> length(text)").count() == 0
            if full and name == "quality_rules":
                assert docs.where("text is null or doc_id = 4").count() == 0 and docs.where("doc_id is null").count() == 1
            if full and name == "pii":
                assert docs.where("text like '%<email>%'").count() == 1
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and (docs.count() > 0) == full
