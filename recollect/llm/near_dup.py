"""Near-duplicates (operator 4): MinHash with tensored banding, links confirmed on full shingle sets.

Instead of L * k minhashes for L tables of k values, two collections of `side` short keys of
`rows` values each are computed, and every pair of a key from the first and one from the second
makes a table: side^2 tables of 2 * rows values from 2 * side * rows minhashes. With side = 10
and rows = 3, a pair of similarity 0.8 shares no table with probability 0.0015, one of 0.85 with
0.0002, one of 0.9 with 0.000004; within a group of several copies other links make up for one.

Documents with equal sets form a class and are represented by their least id, so exact copies
never meet in a table. Candidates are then looked for in three steps, each with components known
so far, so that a large group of near copies is one node before its inner pairs would count:

1. In the `side` tables of equally numbered keys, members of a bucket meet its least and greatest
   member, which finds most links at two pairs a member.
2. In all tables, only buckets that still hold several components are of interest. In those of up
   to `small` members, all pairs across components meet; in larger ones, members outside the most
   frequent component meet two delegates of it, picked by a mix of id and bucket.
3. Members of larger buckets that then still hold several components go through an exact join by
   prefixes of their full sets, across components: values stand in an order of rising counts, and
   two similar sets share a value among their first ones.

So every pair across components that shares a bucket is looked at; a link is lost only if its two
documents share no table and are not linked by way of others. Before full sets are read, pairs are
sieved by sizes and by a parity bitmap of 512 bits: the bits in which two bitmaps differ are at
most as many as the values in which the sets differ, so no link is lost there.
Every link is confirmed by the exact condition on the full sets. Components come from a
distributed algorithm; no links, components or fingerprints reach the driver.

Edge cases: a null text or one without words has an empty set and is linked with nothing; a
text of fewer words than a shingle has one shingle, the whole sequence; a null doc_id takes no
part and gets a null component, not kept; rows that share an id are one node with several sets;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import over_batches, release, stored, table, word_hashes
from recollect.llm.components import components

_CHUNK = 1 << 15
#: Counts of shingles are kept in so many slots. They only order the values; any order is exact.
_SLOTS = 1 << 20
#: Longs of a parity bitmap.
_BITS = 8
#: So many ids or keys (16 bytes each at most) may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Plan:
    """Words of a shingle, the least similarity as num / den, keys on a side, minhashes of a key, and the small bucket, in which all pairs meet at once."""

    width: int = 5
    num: int = 80
    den: int = 100
    side: int = 10
    rows: int = 3
    small: int = 24

    def constants(self) -> tuple[np.ndarray, np.ndarray]:
        n = 2 * self.side * self.rows
        return tuple(np.array([xxhash.xxh64_intdigest(b"%d" % i, seed) for i in range(n)], np.uint64) for seed in (1, 2))


def shingles(text: str | None, width: int, hashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; words are cut at six white space characters, A-Z in lower case."""
    w = np.frombuffer(b"".join(map(hashes.__getitem__, (text or "").encode("utf-8", "surrogatepass").lower().split())), np.uint64)
    if not len(w):
        return w
    if len(w) < width:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), len(w))], np.uint64)
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def short_keys(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """2 * side keys for each non-empty set, from 2 * side * rows minhashes."""
    mult, flip = plan.constants()
    mult = mult | np.uint64(1)
    least = np.full((len(sets), len(mult)), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        for at in range(0, len(s), _CHUNK):
            h = (s[None, at : at + _CHUNK] ^ flip[:, None]) * mult[:, None]
            h ^= h >> np.uint64(32)
            np.minimum(least[i], h.min(1), out=least[i])
    keys = np.zeros((len(sets), 2 * plan.side), np.uint64)
    for r in range(plan.rows):
        keys = (keys ^ least[:, r :: plan.rows]) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(29)
    return keys


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """A row of `_BITS` longs for each set: bit k is set if an odd number of values fall on k."""
    out = np.zeros((len(sets), 8 * _BITS), np.uint8)
    for i, s in enumerate(sets):
        at = ((s >> np.uint64(20)) & np.uint64(64 * _BITS - 1)).astype(np.int64)
        out[i] = np.packbits((np.bincount(at, minlength=64 * _BITS) & 1).astype(np.uint8))
    return out.view(np.uint64)


def _rows(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], _signed(np.ascontiguousarray(a).reshape(-1)))


def _sieve(plan: Plan, n1: str, bits1: str, n2: str, bits2: str) -> str:
    """SQL: whether sizes and bitmaps leave it open that two sets are similar."""
    apart = " + ".join(f"bit_count({bits1}[{i}] ^ {bits2}[{i}])" for i in range(_BITS))
    return f"{plan.den} * least({n1}, {n2}) >= {plan.num} * greatest({n1}, {n2}) and {plan.num + plan.den} * ({apart}) <= {plan.den - plan.num} * ({n1} + {n2})"


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, the size of its set, a 128-bit name of the set, its short keys and its parity bitmap."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = word_hashes()
        sets = [shingles(t, plan.width, hashes) for t in b.column(1).to_pylist()]
        name = np.array([[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (3, 4)] for s in sets], np.uint64).reshape(-1, 2)
        columns = [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _signed(name[:, 0].copy()), _signed(name[:, 1].copy()), _rows(short_keys(sets, plan)), _rows(parity(sets))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "keys", "bits"])

    return over_batches(docs.select("doc_id", "text"), batch, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, bits array<long>")


def table_keys(classes: DataFrame, plan: Plan, diagonal: bool, *more: str) -> DataFrame:
    """key, rep: every pair of a short key of the first side and one of the second, or only those of equal number."""
    tables = [i * plan.side + j for i in range(plan.side) for j in range(plan.side) if i == j or not diagonal]
    at = classes.select("rep", "keys", *more, F.explode(F.array(*(F.lit(t) for t in tables))).alias("t"))
    first, second = F.element_at("keys", F.expr(f"t div {plan.side} + 1").cast("int")), F.element_at("keys", (F.col("t") % plan.side + plan.side + 1).cast("int"))
    return at.select(F.xxhash64("t", first, second).alias("key"), "rep", *more)


class _Links:
    """Sieves candidate pairs by `thin` (rep, n, bits), confirms them on full sets, and keeps the links found so far."""

    def __init__(self, docs: DataFrame, thin: DataFrame, plan: Plan):
        self.docs, self.thin, self.plan = docs, thin, plan
        self.sets: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def all_sets(self) -> DataFrame:
        return _union(self.sets)

    def load(self, ids: DataFrame) -> None:
        """Full sets of the documents in column `wanted` that are not there yet; nobody else's are needed."""
        plan = self.plan

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            hashes = word_hashes()
            sets = [shingles(t, plan.width, hashes) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, _signed(np.concatenate(sets)) if ends[-1] else pa.array([], pa.int64()))
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), lists], ["id", "s"])

        wanted = ids.select("wanted").distinct()
        if self.sets:
            wanted = wanted.join(self.all_sets().select("id"), F.col("wanted") == F.col("id"), "left_anti")
        wanted = stored(wanted, "wanted")
        chosen = self.docs.select("doc_id", "text").join(_bounded(wanted), F.col("doc_id") == F.col("wanted"), "left_semi")
        self.sets.append(stored(over_batches(chosen, batch, "id long, s array<long>"), "sets"))
        release(wanted)

    def test(self, pairs: DataFrame) -> bool:
        """Confirm pairs a < b; True if that gave a link."""
        plan = self.plan
        one, two = (self.thin.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x)) for x in "ab")
        close = pairs.distinct().join(one, "a").join(two, "b").where(_sieve(plan, "na", "bitsa", "nb", "bitsb")).select("a", "b")
        close = stored(close.distinct(), "close")
        self.load(close.select(F.explode(F.array("a", "b")).alias("wanted")))
        one, two = (self.all_sets().select(F.col("id").alias(x), F.col("s").alias("s" + x)) for x in "ab")
        sized = close.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
        links = stored(sized.where(plan.den * F.col("common") >= plan.num * (F.col("total") - F.col("common"))).select("a", "b").distinct(), "links")
        release(close)
        self.found.append(links)
        return not links.isEmpty()

    def components(self) -> DataFrame:
        return components(_union(self.found))

    def drop(self) -> None:
        for done in (*self.sets, *self.found):
            release(done)


def _bounded(rows: DataFrame) -> DataFrame:
    """A stored table of one or two longs a row, marked for broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _ordered(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _values(lists: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """For each slot, in how many of the sets (column s) its values stand."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.bincount((_values(b.column(0)) & np.uint64(_SLOTS - 1)).astype(np.int64), minlength=_SLOTS)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    found = over_batches(sets.select("s"), batch, "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(_SLOTS, np.int32)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def crossing(sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs a < b of different components among `sets` (id, c, s) that hold all similar ones.

    A set of n values that is similar to one at least as large shares at least 2 n num / (num + den)
    values with it, to one at most as large n num / den; so the two have a value in common among
    the first n - that + 1 of each, in any order that is the same for all sets.
    """
    num, den = plan.num, plan.den
    counts = _slot_counts(sets)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        values, sizes = _values(b.column(2)), pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        first, inner = sizes + 1 + (-num * sizes) // den, sizes + 1 + (-2 * num * sizes) // (num + den)
        first[sizes == 0] = 0
        chosen = []
        for end, n, k in zip(ends, sizes, first, strict=True):
            s = values[end - n : end]
            chosen.append(s[np.argsort(counts[s & np.uint64(_SLOTS - 1)], kind="stable")[:k]])
        maps = parity([values[end - n : end] for end, n in zip(ends, sizes, strict=True)])
        row = np.repeat(np.arange(len(sizes)), first)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first)
        ids, c = (pa.compute.take(b.column(i), pa.array(row)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([_signed(np.concatenate([np.zeros(0, np.uint64), *chosen])), ids, c, pa.array(sizes[row], pa.int64()), pa.array(pos, pa.int64()), pa.array(pos < inner[row]), _rows(maps[row])], ["v", "id", "c", "n", "pos", "inner", "bits"])

    firsts = stored(over_batches(sets.select("id", "c", "s"), batch, "v long, id long, c long, n long, pos long, inner boolean, bits array<long>"), "firsts")
    # of each value, rows outside its most frequent component meet all: few pairs within a component are looked at
    top = firsts.groupBy("v", "c").agg(F.count("*").alias("k")).groupBy("v").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts"))
    top = top.where("parts > 1").select("v", F.col("top.c").alias("top"))
    shared = stored(firsts.join(top, "v"), "shared")
    release(firsts)
    one, two = (shared.select("v", "top", *(F.col(x).alias(x + side) for x in ("id", "c", "n", "pos", "inner", "bits"))) for side in "12")
    near = f"c1 <> c2 and (c2 = top or id1 < id2) and {num + den} * least(n1 - pos1, n2 - pos2) >= {num} * (n1 + n2) and {_sieve(plan, 'n1', 'bits1', 'n2', 'bits2')}"
    small = "if(n1 < n2 or (n1 = n2 and id1 < id2), inner1, inner2)"
    pairs = stored(one.where("c1 <> top").join(two.drop("top"), "v").where(f"{near} and {small}").select(*_ordered("id1", "id2")).distinct(), "crossing")
    release(shared)
    return pairs


def near_duplicates(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    sketch = stored(sketches(docs, plan), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "classes")
    links = _Links(docs, classes.select("rep", "n", "bits"), plan)
    # an id whose rows have several sets is one node all the same: it links their classes
    several = full.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("s_id"))
    owned = full.select("doc_id", "h1", "h2").join(several, F.col("doc_id") == F.col("s_id"), "left_semi").distinct()
    links.found.append(stored(owned.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(*_ordered("doc_id", "rep")).distinct(), "links"))

    def placed(part: DataFrame, *more: str) -> DataFrame:
        """Classes with the component that they are in so far."""
        return classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("rep", *more, F.coalesce("component", "rep").alias("c"))

    # 1: a class has a table's key once, so a bucket holds two if its least and greatest differ
    keys = table_keys(classes, plan, True)
    buckets = stored(keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi"), "buckets")
    ends = keys.join(buckets, "key").select("rep", F.explode(F.array("lo", "hi")).alias("hub")).where("rep <> hub")
    links.test(ends.select(*_ordered("rep", "hub")))
    part = links.components()
    # 2: all tables, buckets of several components
    own = stored(placed(part, "n", "keys"), "placed")
    rest = table_keys(own, plan, False, "n", "c")
    mixed = stored(rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size"), "mixed")
    members = stored(rest.join(_bounded(mixed), "key"), "members")
    few, large = members.where(F.col("size") <= plan.small), members.where(F.col("size") > plan.small)
    few = stored(few.select("key", "rep", "c").join(links.thin, "rep"), "few")
    other = few.select("key", *(F.col(x).alias(x + "2") for x in ("rep", "c", "n", "bits")))
    pairs = few.join(other, "key").where(f"rep < rep2 and c <> c2 and {_sieve(plan, 'n', 'bits', 'n2', 'bits2')}").select(*_ordered("rep", "rep2"))
    chance = F.struct(F.xxhash64("rep", "key").alias("h"), "rep")
    each = large.groupBy("key", "c").agg(F.count("*").alias("k"), F.min(chance).alias("lo"), F.max(chance).alias("hi"))
    sent = stored(each.groupBy("key").agg(F.max(F.struct("k", "c", "lo", "hi")).alias("top")).select("key", F.col("top.c").alias("top"), F.array("top.lo.rep", "top.hi.rep").alias("hubs")), "sent")
    met = large.join(sent, "key").where("c <> top").select("rep", F.explode("hubs").alias("hub"))
    if links.test(pairs.union(met.select(*_ordered("rep", "hub")))):
        part = links.components()
    # 3: what is left of larger buckets, by full sets
    now = large.select("key", "rep").join(placed(part), "rep")
    open_ = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = stored(now.join(open_, "key").select(F.col("rep").alias("id"), "c").distinct(), "left")
    if not left.isEmpty():
        links.load(left.select(F.col("id").alias("wanted")))
        pairs = crossing(links.all_sets().join(left, "id"), plan)
        if links.test(pairs):
            part = links.components()
        release(pairs)
    whole = stored(classes.select("h1", "h2", "rep").join(part.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("found")), "whole")
    links.drop()
    for done in (classes, buckets, own, mixed, members, few, sent, left):
        release(done)
    joined = sketch.select("doc_id", "n_shingles", "h1", "h2").join(whole, ["h1", "h2"], "left")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("found")), "doc_id"))
    return joined.select("doc_id", "n_shingles", of.alias("component_id"), F.coalesce(F.col("doc_id") == of, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, plan: Plan) -> DataFrame:
    """`docs` without the rows that are not the least document of their group; all columns stay.

    Rows with a null id, and all rows of an id that is kept, stay.
    """
    gone = near_duplicates(docs, plan).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


#: The contract's shingles have two words; everywhere else they have five.
OP4 = Plan(width=2)


def op4_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), OP4)
