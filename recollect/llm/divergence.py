"""Source divergence audit (operator 13): how far sources of a language differ in their words.

Each language keeps the terms of enough of its documents. Each (language, source) group and each
language gives each kept term a smoothed share p in billionths, and two of them differ in a term by
f(p, q) = floor((p - q)^2 / (p + q)).

Pairs of sources. Most terms are absent from most sources, where p is the source's base value b.
So a pair's sum is V * f(b1, b2), corrected where a term is present: by f(p1, b2) - f(b1, b2) for
each term of the first source, which depends on its count alone and is summed over the source's
counts of counts; likewise for the second; and by f(p1, p2) - f(p1, b2) - f(b1, p2) + f(b1, b2) for
terms of both. The last sums gather in tasks, in tiles of sources: a task adds terms into one matrix
a pair of tiles, so the number of rows sent does not depend on how many sources share a term.

Terms of a group. The k-th highest value is selected by radix: a histogram of the values' highest
bits by group gives the digit in which the k-th lies, what lies above is chosen, and the digit's rows
go to the next round. Ties at the last value are refined in the same way by the bytes of the term.
Only what is chosen is ordered.

All arithmetic is in whole numbers.

Edge cases: a null text, language or source counts as empty; a document without terms, or a language
without kept terms, still makes a group, with pairs of value 0 if no term is kept; document frequency
counts rows, repeated rows and rows without an id included; a text of any length is read whole; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import SLICE, release, stored, table
from recollect.workers import ship

#: A-Z become a-z; all other ASCII bytes but a-z separate terms; bytes from 0x80 are parts of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEPARATOR = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
BLOCK = 1 << 20
#: Terms that a task counts before it sends them on.
HELD = 300_000
#: Sources of a tile, and pairs of a matrix that are worked out at once.
TILE, AT_ONCE = 128, 1 << 20
SCALE = 1_000_000_000


def term_blocks(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_FOLD).split()
        at = end


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs, pre-aggregated in each task: one pass over the texts, no shuffle."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs_) in held.items():
                n = len(times)
                terms = list(times)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(terms, pa.binary()), pa.array(list(times.values()), pa.int64()), pa.array([docs_[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for whole in batches:
            rows = max(1, whole.num_rows * SLICE // max(1, whole.nbytes))
            for b in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    pair = held.get((lang, source))
                    if pair is None:
                        pair = held[lang, source] = Counter(), Counter()
                    before, seen = len(pair[0]), set()
                    for terms in term_blocks(text):
                        pair[0].update(terms)
                        seen.update(terms)
                    pair[1].update(seen)
                    size += len(pair[0]) - before
                    if size > HELD:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    flat = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return flat.mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count; decimals, so that no product overflows."""
    wide = lambda c, to: F.coalesce(c, F.lit(0)).cast(f"decimal({to},0)")
    return F.call_function("div", wide(n + 2, 19) * F.lit(SCALE).cast("decimal(10,0)"), wide(total, 19) + wide(terms, 18) * 2).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """f; p and q are at most a billion and one, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tiles(shared: DataFrame) -> DataFrame:
    """lang, a, b (a < b) and the sum of corrections of terms that both have. shared: lang and of, a term's array of (i, p, base) by source number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def add(lang: str, x: np.ndarray) -> None:
            """x: rows of one length m of (i, p, base), sorted by i. Every pair of places is one column."""
            a, b = np.triu_indices(x.shape[1], 1)
            step = max(1, AT_ONCE // max(1, len(a)))
            for at in range(0, len(x), step):
                u, v = x[at : at + step, a].reshape(-1, 3), x[at : at + step, b].reshape(-1, 3)
                extra = f(u[:, 1], v[:, 1]) - f(u[:, 1], v[:, 2]) - f(u[:, 2], v[:, 1]) + f(u[:, 2], v[:, 2])
                key = (u[:, 0] // TILE) << 32 | v[:, 0] // TILE
                for k in np.unique(key):
                    own = key == k
                    tile = sums.setdefault((lang, int(k) >> 32, int(k) & 0xFFFFFFFF), np.zeros(TILE * TILE, np.int64))
                    np.add.at(tile, u[own, 0] % TILE * TILE + v[own, 0] % TILE, extra[own])

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, ta, tb), tile in sums.items():
                at = np.flatnonzero(tile)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(ta * TILE + at // TILE), pa.array(tb * TILE + at % TILE), pa.array(tile[at])], ["lang", "a", "b", "both"])

        for b in batches:
            langs, lists = b.column(0).to_pylist(), b.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            x = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            by: dict[tuple[str, int], list[int]] = {}
            for lang, start, end in zip(langs, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if end - start > 1:
                    by.setdefault((lang, end - start), []).append(start)
            for (lang, m), starts in by.items():
                # a term of very many sources is taken by pairs of tiles of places
                for lo in range(0, m, 8 * TILE):
                    for hi in range(lo, m, 8 * TILE):
                        _crossed(add, lang, x, np.array(starts), (lo, min(m, lo + 8 * TILE)), (hi, min(m, hi + 8 * TILE)), m)
                if len(sums) > 256:
                    yield from out()
                    sums.clear()
        yield from out()

    def _crossed(add, lang, x, starts, left, right, m) -> None:
        places = np.arange(*left) if left == right else np.concatenate([np.arange(*left), np.arange(*right)])
        rows = x[starts[:, None] + places]
        if left == right:
            add(lang, rows)
            return
        n = left[1] - left[0]  # only pairs across: those within each side are another call's
        for i in range(n):
            for j in range(n, rows.shape[1], TILE):
                one = np.repeat(rows[:, i : i + 1], min(TILE, rows.shape[1] - j), 1).reshape(-1, 1, 3)
                add(lang, np.concatenate([one, rows[:, j : j + TILE].reshape(-1, 1, 3)], 1))

    return shared.mapInArrow(run, "lang string, a long, b long, both long").groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))


def radix_top(rows: DataFrame, by: list[str], value: str, item: str, k: int, bits: int = 16, item_rounds: int = 3) -> DataFrame:
    """The rows of each group (columns `by`) with the k highest values (longs from 0), ties to the lesser item by UTF-8 bytes; a column rank.

    Each round is a histogram by group and digit, summed in the tasks first, and a join with one row
    a group. What still ties after `item_rounds` rounds of four bytes each is left to the ordering
    of chosen rows, whose limit acts in the tasks.
    """
    top = rows.agg(F.max(value)).head()[0]
    left, chosen = rows, []
    shift = max(0, ((top or 0).bit_length() - 1) // bits * bits)
    digits = [F.shiftrightunsigned(value, s).bitwiseAND((1 << bits) - 1) for s in range(shift, -1, -bits)]
    # four bytes as a number, from the end of the scale down, so that a lesser term has a higher digit; absent bytes are least
    for j in range(item_rounds):
        part = F.rpad(F.hex(F.substring(F.col(item).cast("binary"), 4 * j + 1, 4)), 8, "0")
        digits.append(F.lit(0xFFFFFFFF) - F.conv(part, 16, 10).cast("long"))
    wanted: DataFrame | None = None
    for digit in digits:
        now = left.withColumn("_digit", digit)
        counted = now.groupBy(*by, "_digit").agg(F.count("*").alias("_n"))
        down = Window.partitionBy(*by).orderBy(F.desc("_digit"))
        above = counted.withColumn("_above", F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, "_above")
        if wanted is None:
            above = above.withColumn("_k", F.lit(k).cast("long"))
        else:
            above = above.join(wanted, by)
        # the digit in which the k-th lies, and how many are still wanted of it; a group of fewer rows is taken whole
        at = above.groupBy(*by).agg(F.max(F.when(F.col("_above") < F.col("_k"), F.struct((-F.col("_digit")).alias("d"), (F.col("_k") - F.col("_above")).alias("_left")))).alias("_at"))
        at = stored(at.select(*(F.col(c).alias(f"_{c}") for c in by), (-F.col("_at.d")).alias("_edge"), F.col("_at._left").alias("_left")), "edges")
        same = now.join(at, [F.col(c) == F.col(f"_{c}") for c in by])
        keep = [F.col(c) for c in rows.columns]
        chosen.append(same.where("_digit > _edge").select(*keep))
        left = stored(same.where("_digit = _edge").select(*keep), "left")
        wanted = at.select(*(F.col(f"_{c}").alias(c) for c in by), F.col("_left").alias("_k"))
        if left.join(wanted, by).groupBy(*by).agg((F.count("*") > F.max("_k")).alias("more")).where("more").isEmpty():
            break
    for part in chosen:
        left = left.union(part)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(item)))
    return left.withColumn("rank", rank).where(F.col("rank") <= k)


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank; least: documents of a kept term, top: ranks of the part `term`."""
    counted = stored(_counted(docs), "terms")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    kept = stored(kept.select(F.col("lang").alias("kept_lang"), F.col("term").alias("kept_term"), "all_n"), "kept")
    same = (F.col("lang") == F.col("kept_lang")) & (F.col("term") == F.col("kept_term"))
    own = stored(counted.join(kept, same).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.first("all_n").alias("all_n")), "counts")
    release(counted)
    # groups and languages with their totals: as many rows as the table has sources
    langs = kept.groupBy("kept_lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    sums = own.groupBy(F.col("lang").alias("own_lang"), F.col("source").alias("own_source")).agg(F.sum("n").alias("total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).groupBy("lang", "source").agg(F.lit(1).alias("one"))
    groups = groups.join(sums, (F.col("lang") == F.col("own_lang")) & (F.col("source") == F.col("own_source")), "left").join(langs, F.col("lang") == F.col("kept_lang"), "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", "terms", "total", "all_total").fillna(0).withColumn("i", number)
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    groups = stored(groups.withColumn("base", base), "groups")

    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "i", "base", "terms", "total", "all_total")
    shares = own.join(g, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    shares = stored(shares.select("lang", "source", "term", "i", "base", p.alias("p"), q.alias("q")), "shares")
    release(own)
    release(kept)

    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = radix_top(stored(terms, "values"), ["lang", "source"], "value", "item", top).withColumn("part", F.lit("term"))

    both = _tiles(shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("i", "p", "base"))).alias("of")).select("lang", "of"))
    times = shares.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "p").agg(F.count("*").alias("times"))
    counts = times.groupBy("t_lang", "t_source").agg(F.collect_list(F.struct("p", "times")).alias("counts"))
    one = groups.join(counts, (F.col("lang") == F.col("t_lang")) & (F.col("source") == F.col("t_source")), "left")
    one = stored(one.select("lang", "source", "i", "base", "terms", F.coalesce("counts", F.array().cast("array<struct<p:bigint,times:bigint>>")).alias("counts")), "counts")
    # the result itself has a row for each two sources of a language
    a = one.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(16)))
    b = groups.select(F.col("lang").alias("b_lang"), F.col("source").alias("item"), F.col("i").alias("b_i"), F.col("base").alias("b_base"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("b_salt"))
    zero_f = apart(F.col("base"), F.col("b_base"))
    side = F.expr("aggregate(counts, 0L, (s, c) -> s + c.times * ((c.p - b_base) * (c.p - b_base) div (c.p + b_base) - zero_f))")
    pairs = a.join(b, (F.col("lang") == F.col("b_lang")) & (F.col("salt") == F.col("b_salt")) & (F.col("i") != F.col("b_i")))
    sided = pairs.withColumn("zero_f", zero_f).select("lang", "source", "item", F.least("i", "b_i").cast("long").alias("lo"), F.greatest("i", "b_i").cast("long").alias("hi"), (F.col("terms") * F.col("zero_f")).alias("plain"), side.alias("side"))
    # a pair's two directions hold the corrections of one side each
    whole = sided.groupBy("lang", "lo", "hi").agg(F.first("plain").alias("plain"), F.sum("side").alias("sides"), F.collect_list(F.struct("source", "item")).alias("ways"))
    t = both.select(F.col("lang").alias("x_lang"), "a", "b", "both")
    summed = whole.join(t, (F.col("lang") == F.col("x_lang")) & (F.col("lo") == F.col("a")) & (F.col("hi") == F.col("b")), "left")
    value = F.col("plain") + F.col("sides") + F.coalesce("both", F.lit(0).cast("long"))
    out = summed.select("lang", value.alias("value"), F.explode("ways").alias("way")).select("lang", "way.source", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = out.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return out.select(columns).union(best.select(columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), words as (
    select row, lang, source, unnest(w) as term from docs
), kept as (
    select lang, term, count(*) as n from words group by lang, term having count(distinct row) >= 10
), groups as (
    select distinct lang, source from docs
), lang_total as (
    select lang, count(*) as v, sum(n) as total from kept group by lang
), counts as (
    select lang, source, term, count(*) as n from words group by all
), every_term as (
    select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n, t.v, t.total as lang_total
    from groups g join kept k using (lang) join lang_total t using (lang) left join counts c using (lang, source, term)
), totals as (
    select *, sum(n) over (partition by lang, source) as total from every_term
), shares as (
    select lang, source, term, n, (1 + 1000000000 * (n + 2)::hugeint // (total + 2 * v))::bigint as p,
        (1 + 1000000000 * (lang_n + 2)::hugeint // (lang_total + 2 * v))::bigint as q from totals
), pairs as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pair_part as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
), term_part as (
    select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from shares where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair_part union all select * from term_part)
)
select * from ranked where part = 'pair' or rank <= 10
"""
