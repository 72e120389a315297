import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import language_id, quality_model, quality_rules
from recollect.llm.common import held_out, table, word_hashes

SF = "/root/testdata/sf0.01"


def test_quality_scores_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality_model.quality_scores(docs, quality_model.learn(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_pairs_recover_an_order():
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 14))
    y = (v[:, 0] - 2 * v[:, 3] > 0).astype(int)
    s = quality_model.BradleyTerry().fit(v[:300], y[:300]).score(v[300:])
    good, bad = s[y[300:] == 1], s[y[300:] == 0]
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = language_id.languages(docs, language_id.learn(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_batch_scores_are_those_of_single_texts(monkeypatch):
    r = np.random.default_rng(3)
    model = language_id.NaiveBayes(["a", "b", "c"], r.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), np.log([0.5, 0.25, 0.25]))
    texts = ["a", "ab", "İstanbul", "x" * 70, "abc déf", "日本語 text", "q", "long " * 40]
    plain = [model.prior + sum(model.logs[g].sum(0, dtype=np.float64) for g in language_id.grams(t)) for t in texts]
    for piece in (1 << 16, 64, 8):
        monkeypatch.setattr(language_id, "_PIECE", piece)
        assert np.allclose(model.sums(texts), plain, atol=1e-3)


def test_bayes_training_against_a_plain_count(spark):
    """Counts, log probabilities and priors of a small table; held-out rows and null languages are not learnt from."""
    import zlib
    from collections import Counter

    rows = [(i, ["xx", "yy", None][i % 3], f"Text {i} abc " * (i % 4 + 1)) for i in range(40)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    used = [(lang, t) for i, lang, t in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    docs = Counter(lang for lang, _ in used)
    assert model.langs == ["xx", "yy"] and np.allclose(model.prior, np.log([docs[x] / len(used) for x in model.langs]))
    for k, lang in enumerate(model.langs):
        n = np.full(language_id.BUCKETS, 0.5)
        for other, t in used:
            for g in language_id.grams(t) if other == lang else ():
                np.add.at(n, g, 1)
        assert np.allclose(model.logs[:-1, k], np.log(n / n.sum()), atol=1e-4)


def test_bayes_against_a_plain_count():
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(language_id.BUCKETS), 2).T.astype(np.float64)).astype(np.float32)
    model = language_id.NaiveBayes(["a", "b"], logs, np.log([0.5, 0.5]))
    text = "Hello été"
    s = [sum(float(logs[i, k]) for g in language_id.grams(text) for i in g) for k in range(2)]
    (lang, score), *rest = model.predict([text, "12 !", None])
    assert lang == "ab"[int(s[1] > s[0])] and abs(score - 1 / (1 + math.exp(-abs(s[0] - s[1])))) < 1e-6
    assert rest == [("und", 0.0)] * 2


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = "".join(random.Random(2).choices("abcdé 日", k=1000))
    count = lambda: sum(np.bincount(g, minlength=language_id.BUCKETS) for g in language_id.grams(text))
    whole = count()
    monkeypatch.setattr(language_id, "_PIECE", 64)
    assert (count() == whole).all() and whole.sum() == 3 * len(text) - 3


def test_odd_scores(odd, none, labels):
    m = quality_model.learn(odd, labels)
    rows = quality_model.quality_scores(odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and quality_model.quality_scores(none, m).count() == 0
    assert {r.score for r in quality_model.quality_scores(odd, quality_model.learn(odd, labels.where("false"))).collect()} == {0.5}
    n = language_id.learn(odd)
    rows = language_id.languages(odd, n).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 2, 3))
    assert {r.lang_pred for r in language_id.languages(odd, language_id.learn(none)).collect()} == {"und"}


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def _plain_counts(text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words, w = [], ""
    for c in text + " ":
        if c in spaces:
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}
    lines, dup = [], 0
    for x in text.split("\n"):
        if x.strip(spaces):
            dup += x in lines
            lines.append(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_against_plain_code():
    r = random.Random(4)
    for _ in range(300):
        t = "".join(r.choice(["a", "bb", " ", "\n", "\t", "é", "#", "a b c d e f g h ", "\x0b", " "]) for _ in range(r.randint(0, 80)))
        assert quality_rules.counts(t, word_hashes())[:5] == _plain_counts(t), repr(t)


def test_upper_bound_is_exact():
    for k, n in ((0, 50), (3, 80), (10, 20)):
        p = quality_rules.upper_bound(k, n, 0.05)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.05) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_are_certified():
    r = random.Random(0)
    rows = [("en", 1, i % 2 == 0, (r.random() * 0.01, 0.0, 0.0, 0.0, 0.0)) for i in range(9000)] + [("en", 0, i % 2 == 0, (0.2 + r.random(), 0.0, 0.0, 0.0, 0.0)) for i in range(400)] + [("de", i % 2, True, (0.1,) * 5) for i in range(20)]
    cuts = quality_rules.certify(rows)
    assert 0.01 < cuts["en"][0] < 0.3 and cuts["en"][1:] == [math.inf] * 4 and cuts["de"] == [math.inf] * 5


def test_small_strata_are_certified_by_one_rule():
    """300 good holdouts carry one rule at the whole error, 100 none; a rule that adds nothing takes no share."""
    def rows(part, n):
        good = [(part, 1, i % 3 == 0, (0.0, 0.0, 0.0, 0.0, 0.0)) for i in range(n)]
        return good + [(part, 0, i % 3 == 0, (0.1 + i / 1000, 0.0, 0.0, 0.0, 0.05)) for i in range(60)]

    cuts = quality_rules.certify(rows("de", 450) + rows("es", 150))
    assert 0 < cuts["de"][0] < 0.1 and cuts["de"][1:] == [math.inf] * 4 and cuts["es"] == [math.inf] * 5


def test_false_rejections_stay_within_alpha():
    """Where good and bad rows overlap, good rows not seen before are rejected at most at the rate alpha."""
    r = random.Random(3)
    for _ in range(10):
        rows = [("en", int(i % 4 > 0), i % 3 == 0, (r.gauss(1 if i % 4 else 3, 1), 0.0, 0.0, 0.0, r.gauss(1 if i % 4 else 3, 1))) for i in range(12_000)]
        cut = quality_rules.certify(rows)["en"]
        fresh = [(r.gauss(1, 1), r.gauss(1, 1)) for _ in range(20_000)]
        assert sum(a > cut[0] or b > cut[4] for a, b in fresh) <= 0.025 * len(fresh) and min(cut[0], cut[4]) < 5


def test_all_labels_count(spark):
    """A language with 2,600 good labels among 60,000 is certified; a common sample of 40,000 rows leaves it too few."""
    rare, bad = F.col("doc_id") % 20 == 0, F.col("doc_id") % 300 < 40
    good = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("doc_id")) for k in range(22)))
    docs = spark.range(60_000).withColumnRenamed("id", "doc_id").select("doc_id", F.when(rare, "xx").otherwise("en").alias("lang"), F.when(bad, F.concat(good, F.expr("repeat(' ####', 1 + cast(doc_id % 7 as int))"))).otherwise(good).alias("text"))
    cuts = quality_rules.learn(docs, docs.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality")))
    assert 0 < cuts["en"][0] < 0.2 and 0 < cuts["xx"][0] < 0.2


def test_cutoffs_from_tables_and_rows_agree(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r.part, r.q, r.tune, tuple(r.m)) for r in quality_rules._labelled(docs, labels, "lang").collect()]
    assert rows and quality_rules.learn(docs, labels, alpha=0.9, grid=2000) == quality_rules.certify(rows, alpha=0.9, grid=2000)


def test_odd_rules(odd, none, labels):
    cuts = quality_rules.learn(odd, labels)
    rows = quality_rules.quality_rules(odd, cuts).collect()
    assert len(rows) == odd.count() and quality_rules.quality_rules(none, cuts).count() == 0
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    kept = quality_rules.filter_quality(odd, cuts)
    assert kept.columns == odd.columns and kept.where("doc_id = 6 and text like 'the quick%'").count() == 3
    assert quality_rules.learn(odd, labels.where("false")) == {}


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 30])
def test_repeats_of_short_texts(n):
    text = " ".join(["w"] * n)
    assert quality_rules.counts(text, word_hashes())[4] == (n if n > 8 else 0)
