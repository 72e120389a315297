"""Quality rules (operator 9): fixed base rules, then cutoffs whose false rejections are bounded.

A rule rejects a document whose metric lies above a cutoff. All labelled rows that the base
rules pass are dealt by a hash of their id: a third tunes, two thirds are the holdout. The
tuning part proposes cutoffs that reject at most a tenth of `alpha` of its good rows, and picks
for each stratum the rules that share its error: greedily by the bad rows that no earlier pick
rejects, as long as they are worth it and the holdout is large enough to certify one more. The
holdout certifies: per stratum and picked rule, cutoffs are tried from the laxest to the
strictest, each by the exact (Clopper-Pearson) upper bound of its rate of false rejections, and
the first that fails ends the sequence. A fixed sequence needs no correction within itself;
strata and their picked rules share the error by Bonferroni's correction. The share of good
documents (of those that the base rules pass) that all rules together reject wrongly in a
stratum is thus at most `alpha`, with probability 1 - `delta` over all strata. Picks look at
tuning rows and at the size of the holdout alone, so the bounds hold after them. A stratum
without enough labels gets no cutoffs, so only the base rules apply there.

Edge cases: a null text has no words and so fails the base rules; a null stratum is a stratum of
its own; duplicate labels of a document count once (the lowest); null labels are not used; an
empty table gives an empty result; without labels only the base rules apply; columns of the
input with clashing names are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import SPACES, over_batches, release, stored, table, word_hashes

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Metrics that rules cut off, as functions of the counts.
RULES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "shout_rate")
#: The share of alpha that proposals take up on the tuning part, and the least gain of a further rule, as a share of the first one's.
AIM, WORTH = 0.1, 0.05
_WINDOW = 8
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(_WINDOW)], np.uint64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words that stand in an 8-word window found twice or more in the text, the first included."""
    n = len(hashes) - _WINDOW + 1
    if n < 2:
        return 0
    w = np.zeros(n, np.uint64)
    for k in range(_WINDOW):
        w += (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29))) * _ODD[k]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(w, twice)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + _WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: str | None, hashes) -> tuple[int, ...]:
    """BASE, then the number of lines with a word, of capital letters A-Z and of exclamation marks."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else [text]
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64)) if len(words) > _WINDOW else 0,
        len(lines), int(np.count_nonzero(np.frombuffer(data, np.uint8) - np.uint8(65) < 26)), text.count("!"),
    )


def base_failed(c: tuple[int, ...]) -> bool:
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def metrics(c: tuple[int, ...]) -> tuple[float, ...]:
    words, chars, lines = max(1, c[0]), max(1, c[1]), max(1, c[5])
    return c[2] / chars, c[4] / words, c[3] / lines, c[6] / chars, c[7] / words


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact upper confidence bound of a rate of which k of n were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        if math.fsum(map(math.exp, logs)) > level:
            low = p
        else:
            high = p
    return high


def within(k: int, n: int, most: float, level: float) -> bool:
    """Whether the upper bound of k of n is at most `most`: the chance of k or fewer at that rate is no more than `level`."""
    if k >= n * most:
        return False
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(most) + (n - i) * math.log1p(-most) for i in range(k + 1))
    return math.fsum(map(math.exp, logs)) <= level


def _pick(good: dict[str | None, int], masks: dict[str | None, dict[int, int]], alpha: float, delta: float) -> tuple[dict[str | None, list[int]], int]:
    """The rules of each stratum that share its error, and how many strata share delta. good: good holdouts; masks: bad tuning rows by the rules (bits) that reject them."""
    useful = sorted((s for s, rows in masks.items() if any(mask and n for mask, n in rows.items())), key=lambda s: (-good.get(s, 0), str(s)))
    shared = max((k for k in range(1, len(useful) + 1) if within(0, good.get(useful[k - 1], 0), alpha, delta / k)), default=0)
    picks = {}
    for stratum in useful[:shared]:
        picked, rest = [], dict(masks[stratum])
        first = 0
        while len(picked) < len(RULES):
            gain = [sum(n for mask, n in rest.items() if mask >> j & 1) for j in range(len(RULES))]
            j = max(range(len(RULES)), key=gain.__getitem__)
            first = first or gain[j]
            m = len(picked) + 1
            if not gain[j] or gain[j] < WORTH * first or not within(0, good[stratum], alpha / m, delta / (shared * m)):
                break
            picked.append(j)
            rest = {mask: n for mask, n in rest.items() if not mask >> j & 1}
        picks[stratum] = picked
    return picks, shared


def _settle(strata: list[str | None], picks: dict, shared: int, cuts: dict, good: dict, above: Callable[[str | None, int, int], int], alpha: float, delta: float) -> dict[str | None, list[float]]:
    """Fixed sequences from the laxest cutoff. cuts: by stratum and rule, rising; good: good holdouts; above: those above a cutoff, by its place."""
    out = {}
    for stratum in strata:
        out[stratum] = [math.inf] * len(RULES)
        picked = picks.get(stratum, [])
        for j in picked:
            for i, cut in reversed(list(enumerate(cuts.get((stratum, j), [])))):
                if not within(above(stratum, j, i), good.get(stratum, 0), alpha / len(picked), delta / (shared * len(picked))):
                    break
                out[stratum][j] = cut
    return out


def certify(rows: list[tuple[str | None, int, bool, tuple[float, ...]]], alpha: float = 0.025, delta: float = 0.05, grid: int = 24) -> dict[str | None, list[float]]:
    """Cutoffs for each stratum (infinite where none is certified), from rows in memory: stratum, label, tuning part, metrics."""
    strata = sorted({r[0] for r in rows}, key=str)
    cuts, masks, held = {}, {}, {s: [r[3] for r in rows if r[0] == s and not r[2] and r[1] == 1] for s in strata}
    for stratum in strata:
        fine = [r[3] for r in rows if r[0] == stratum and r[2] and r[1] == 1]
        bad = [r[3] for r in rows if r[0] == stratum and r[2] and r[1] == 0]
        if not fine or not bad:
            continue
        limit = [sorted(m[j] for m in fine)[max(1, math.ceil((1 - AIM * alpha) * len(fine))) - 1] for j in range(len(RULES))]
        masks[stratum] = Counter(sum((m[j] > limit[j]) << j for j in range(len(RULES))) for m in bad)
        for j in range(len(RULES)):
            # proposals lie between the values of bad rows and above what good rows show
            top = [*sorted({m[j] for m in bad if m[j] > limit[j]}, reverse=True), limit[j]]
            cuts[stratum, j] = [(a + b) / 2 for a, b in zip(top, top[1:], strict=False)][:: max(1, len(top) // grid)][::-1]
    good = {s: len(x) for s, x in held.items()}
    return _settle(strata, *_pick(good, masks, alpha, delta), cuts, good, lambda s, j, i: sum(g[j] > cuts[s, j][i] for g in held[s]), alpha, delta)


def _labelled(docs: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """part, q, tune and metrics m of all labelled rows that the base rules pass. Metrics come first, so that no text is shuffled and no id broadcast."""
    ids = labels.select(F.col("doc_id").alias("label_id"), "quality").dropna().groupBy("label_id").agg(F.min("quality").alias("label_quality"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = word_hashes()
        found = [counts(t, hashes) for t in b.column(2).to_pylist()]
        m = [None if base_failed(c) else metrics(c) for c in found]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(m, pa.list_(pa.float64()))], ["id", "part", "m"])

    inputs = docs.where("doc_id is not null").select("doc_id", F.col(stratum).cast("string").alias("part"), F.col("text").alias("body"))
    rows = over_batches(inputs, batch, "id long, part string, m array<double>").where("m is not null").join(ids, F.col("id") == F.col("label_id"))
    return rows.select("part", F.col("label_quality").cast("int").alias("q"), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) == 0).alias("tune"), "m")


def _placed(values: DataFrame, edges: dict[tuple[str | None, int], list[float]], inside: bool) -> DataFrame:
    """Values with `at`, how many of their stratum's and rule's edges lie below (or, with `inside`, not above) them."""
    rows = [(part, j, e) for (part, j), e in edges.items()]
    small = values.sparkSession.createDataFrame(rows, "edge_part string, edge_j int, edges array<double>")
    both = values.join(F.broadcast(small), F.col("part").eqNullSafe(F.col("edge_part")) & (F.col("j") == F.col("edge_j")))
    return both.withColumn("at", F.expr(f"size(filter(edges, e -> e {'<=' if inside else '<'} v))"))


def _caught(rows: DataFrame, limits: dict[tuple[str | None, int], float]) -> DataFrame:
    """part and mask of rows: a bit for each rule whose limit the metric exceeds. Strata without limits have no rows."""
    parts = [(part, [limits[part, j] for j in range(len(RULES))]) for part in {part for part, _ in limits}]
    small = rows.sparkSession.createDataFrame(parts, "limit_part string, limits array<double>")
    both = rows.join(F.broadcast(small), F.col("part").eqNullSafe(F.col("limit_part")))
    bits = (F.when(F.col("m")[j] > F.col("limits")[j], 1 << j).otherwise(0) for j in range(len(RULES)))
    return both.select("part", sum(bits, F.lit(0)).alias("mask"))


def learn(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.025, delta: float = 0.05, grid: int = 48) -> dict[str | None, list[float]]:
    """Cutoffs certified on all labelled rows. The driver gets, for each stratum and rule, `grid` proposals and counts at most."""
    rows = stored(_labelled(docs, labels, stratum), "labelled")
    total = {r["part"]: r["good"] for r in rows.groupBy("part").agg(F.expr("count_if(q = 1 and not tune)").alias("good")).collect()}
    strata = sorted(total, key=str)
    values = rows.select("part", "q", "tune", F.posexplode("m").alias("j", "v"))
    quantile = F.percentile_approx("v", 1 - AIM * alpha, 100_000)
    limits = {(r["part"], r["j"]): r["v"] for r in values.where("q = 1 and tune").groupBy("part", "j").agg(quantile.alias("v")).collect()}
    masks: dict[str | None, dict[int, int]] = {}
    for r in _caught(rows.where("q = 0 and tune"), limits).groupBy("part", "mask").count().collect():
        masks.setdefault(r["part"], {})[r["mask"]] = r["count"]
    picks, shared = _pick(total, masks, alpha, delta)
    ends = {(s, j): [limits[s, j]] for s, picked in picks.items() for j in picked}
    bad = _placed(values.where("q = 0 and tune"), ends, False).where("at = 1").select("part", "j", "v").distinct()
    shares = [k / grid for k in range(1, grid + 1)]
    tops = {(r["part"], r["j"]): sorted(set(r["tops"])) for r in bad.groupBy("part", "j").agg(F.percentile_approx("v", shares, 100_000).alias("tops")).collect()}
    # a proposal lies between a value of bad rows and the next lower one, or what good rows show
    lower = {(r["part"], r["j"], r["at"]): r["v"] for r in _placed(bad, tops, True).groupBy("part", "j", "at").agg(F.max("v").alias("v")).collect()}
    cuts = {(s, j): [(v + lower.get((s, j, i), limits[s, j])) / 2 for i, v in enumerate(top)] for (s, j), top in tops.items()}
    held = _placed(values.where("q = 1 and not tune"), cuts, False).groupBy("part", "j", "at").count().collect()
    count = {(r["part"], r["j"], r["at"]): r["count"] for r in held}
    release(rows)
    return _settle(strata, picks, shared, cuts, total, lambda s, j, i: sum(count.get((s, j, at), 0) for at in range(i + 1, len(cuts[s, j]) + 1)), alpha, delta)


def _verdict(stratum: str | None, c: tuple[int, ...], cuts: dict[str | None, list[float]]) -> bool:
    own = cuts.get(stratum)
    return not base_failed(c) and not (own and any(m > cut for m, cut in zip(metrics(c), own, strict=True)))


def quality_rules(docs: DataFrame, cuts: dict[str | None, list[float]], stratum: str = "lang") -> DataFrame:
    """One row per document with its counts and the verdict; one pass, no shuffle."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = word_hashes()
        found = [counts(t, hashes) for t in b.column(1).to_pylist()]
        cols = [pa.array([c[j] for c in found], pa.int64()) for j in range(5)]
        kept = [_verdict(s, c, cuts) for s, c in zip(b.column(2).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols, pa.array([base_failed(c) for c in found]), pa.array(kept, pa.bool_())], ["doc_id", *BASE, "base_failed", "kept"])

    return over_batches(docs.select("doc_id", "text", F.col(stratum).cast("string")), batch, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, cuts: dict[str | None, list[float]], stratum: str = "lang") -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    at, by, schema = docs.columns.index("text"), docs.columns.index(stratum), docs.schema
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = word_hashes()
        strata = b.column(by).cast(pa.string()).to_pylist()
        return b.filter(pa.array([_verdict(s, counts(t, hashes), cuts) for s, t in zip(strata, b.column(at).to_pylist(), strict=True)], pa.bool_()))

    return over_batches(docs, batch, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, learn(docs, table(spark, sf_dir, "labels")))
