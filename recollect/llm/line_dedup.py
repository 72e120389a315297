"""Line dedup (operator 5): levelled sorted runs of line hashes, with DataFrame functions only.

A store of runs keeps, for each line key, in how many documents it was found. Documents arrive
in batches. A batch's own counts are merge-joined with the runs: keys that no run has (an
anti join) go into a new run of level 0, keys that one has are added to it as a run of counts.
When a level holds `fan` runs, they are compacted into one sorted run of the next level, so a
key lies in at most `fan` runs of each of a logarithmic number of levels. Keys found in enough
documents, over all runs, lose all their lines in every document.

A line's key is the line without the six white space characters at both ends, A-Z in lower
case; runs hold its 128-bit hash. Texts are not shuffled until the lines to drop are known.

Edge cases: a null or empty text is one empty line; the empty key is never dropped; a null
doc_id keeps its row, and rows of one text without an id count as one document, apart from any
with an id; repeated rows of an id count as one document for a key when both have it; an empty table gives an empty result; columns of the
input with clashing names are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import fresh, release, stored, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRIM = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_TRIM)), _UPPER, _LOWER)


def key_hash(line: Column) -> Column:
    """A 128-bit hash of the key as a struct of two longs; null for an empty key."""
    key = line_key(line)
    return F.when(F.length(key) >= 1, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


class LineRuns:
    """The levelled runs. Each run is a table in the shared folder, sorted by hash within its partitions."""

    def __init__(self, fan: int = 4):
        self.fan, self.levels = fan, [[]]  # type: int, list[list[DataFrame]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(rows.sortWithinPartitions("h1", "h2"), f"run{level}"))

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.union(r)
        return out

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's keys (h1, h2, ...) that no run has: a merge anti join with the runs."""
        return batch.join(self._union(self.runs()).hint("merge"), ["h1", "h2"], "left_anti") if self.runs() else batch

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of columns h1, h2, n: new keys and further counts of known ones, as one sorted run."""
        known = self._union(self.runs()).select("h1", "h2").distinct() if self.runs() else None
        if known is not None:
            new = self.unseen(batch).withColumn("fresh", F.lit(True))
            old = batch.join(known.hint("merge"), ["h1", "h2"], "left_semi").withColumn("fresh", F.lit(False))
            batch = new.union(old)
        else:
            batch = batch.withColumn("fresh", F.lit(True))
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        old = self.levels[level]
        self.levels[level] = []
        self._write(self._union(old).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh")), level + 1)
        for r in old:
            release(r)

    def frequent(self, least: int) -> DataFrame:
        return self._union(self.runs()).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h1", "h2")

    def drop(self) -> None:
        for r in self.runs():
            release(r)
        self.levels = [[]]


def _keys(docs: DataFrame, rest: list[str]) -> DataFrame:
    """One row for each non-empty line of a document, with the hash of its key.

    Keys are exploded before they are hashed: inside a lambda a key would be worked out for each use.
    """
    lines = docs.select(*rest, F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    keys = lines.select(*rest, line_key(F.col("line")).alias("k")).where(F.length("k") >= 1)
    return keys.select(*rest, F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))


def _owner(docs: DataFrame) -> list[Column]:
    """What tells documents apart: the id and 0, or for rows without an id a hash of the text and 1."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.when(F.col("doc_id").isNull(), 1).otherwise(0)]


def mark(docs: DataFrame, least: int = 10, batches: int = 4, fan: int = 4) -> tuple[DataFrame, str]:
    """`docs` with a column of the hashes of its lines to drop (null: none), and that column's name."""
    own, hit = _owner(docs), fresh(docs, "gone")
    # a document's lines fall into one batch; its id alone decides which
    names = docs.select("text", own[0].alias("line_owner"), own[1].alias("line_nameless"))
    item = ["line_owner", "line_nameless"]
    seen = stored(_keys(names, item).distinct().withColumn("batch", F.pmod(F.xxhash64(*item), F.lit(batches)).cast("int")), "keys")
    runs = LineRuns(fan)
    for i in range(batches):
        runs.add(seen.where(F.col("batch") == i).groupBy("h1", "h2").agg(F.count("*").alias("n")))
    gone = stored(runs.frequent(least), "frequent")
    runs.drop()
    drops = seen.join(gone, ["h1", "h2"], "left_semi").groupBy(*item).agg(F.collect_set(F.struct("h1", "h2")).alias(hit))
    drops = stored(drops.select(*(F.col(c).alias(fresh(docs, c)) for c in item), hit), "drops")
    release(seen)
    release(gone)
    key = [drops[fresh(docs, c)] for c in item]
    # always dealt out by document: how much is dropped, and so whether it could be broadcast, depends on the corpus
    return docs.join(drops.hint("merge"), (own[0] == key[0]) & (own[1] == key[1]), "left").drop(*key), hit


def _kept_lines(hit: str) -> Column:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return F.when(F.col(hit).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(hit, key_hash(x)), F.lit(False))))


def line_dedup(docs: DataFrame, least: int = 10, batches: int = 4, fan: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of every document."""
    marked, hit = mark(docs.select("doc_id", "text"), least, batches, fan)
    kept = marked.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), _kept_lines(hit).alias("kept"))
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, least: int = 10, batches: int = 4, fan: int = 4) -> DataFrame:
    """`docs` with the frequent lines taken out of their texts; all columns and rows stay, null texts stay null."""
    marked, hit = mark(docs, least, batches, fan)
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(hit), "\n"))
    return marked.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with lines as (
  select doc_id, u.i as pos, l[u.i] as line,
         translate(trim(l[u.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents) d, unnest(range(1, len(l) + 1)) as u(i)
), frequent as (
  select k from lines where length(k) >= 1 group by k having count(distinct doc_id) >= 10
), flagged as (
  select doc_id, pos, line, k in (select k from frequent) as gone from lines
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from flagged group by doc_id
"""
