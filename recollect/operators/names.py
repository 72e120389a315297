"""Many names sought in many texts: an equi-join on the rarest part of each name, then a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the parts that names and texts are joined on; a name takes the longest it can fill.
SIZES = (1, 2, 4, 8)


def _parts(text: str, size: Column) -> Column:
    """The distinct parts of `size` characters of a text, at every place."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(text), i, size))))


def pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text and name wherever a name stands in a text, each pair once. texts: text; names: name.

    Nothing is broadcast but a row of part lengths, and no text meets a name that it shares no
    part with: of a name's parts the one that the fewest texts hold is its key. Names with the same
    key are all compared with the texts that hold it. Null and empty texts and names are in no pair.
    """
    t = texts.select("text").where("text <> ''").distinct().withColumn("t_id", F.xxhash64("text"))
    size = F.greatest(*(F.when(F.length("name") >= s, F.lit(s)).otherwise(F.lit(0)) for s in SIZES))
    n = names.select("name").where("name <> ''").distinct().withColumn("size", size)
    sizes = n.agg(F.collect_set("size").alias("sizes"))  # one row of at most four lengths
    held = t.join(F.broadcast(sizes)).select("t_id", "text", F.explode("sizes").alias("size")).select("t_id", F.explode(_parts("text", F.col("size"))).alias("part"))
    own = n.select("name", F.explode(_parts("name", F.col("size"))).alias("part"))
    # parts of no name go before anything is counted
    asked = own.select(F.col("part").alias("a_part")).distinct()
    held = held.join(asked, F.col("part") == F.col("a_part"), "left_semi")
    counts = held.groupBy(F.col("part").alias("c_part")).agg(F.count("*").alias("texts"))
    # a part that no text holds rules its name out
    rated = own.join(counts, F.col("part") == F.col("c_part"), "left")
    keys = rated.groupBy("name").agg(F.min_by("part", F.struct(F.coalesce("texts", F.lit(0)), "part")).alias("k_part"))
    likely = held.join(keys, F.col("part") == F.col("k_part")).groupBy(F.col("t_id").alias("l_id")).agg(F.collect_set("name").alias("sought"))
    # texts that share a hash are checked one by one, so it loses nothing
    both = t.join(likely, F.col("t_id") == F.col("l_id")).select("text", F.explode("sought").alias("name"))
    return both.where(F.instr(F.col("text"), F.col("name")) > 0)


def holding(rows: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """The rows whose text holds any of the names; repeated rows stay, each once."""
    found = pairs(rows.select(F.col(text).alias("text")), names).select(F.col("text").alias("_held")).distinct()
    return rows.join(found, F.col(text) == F.col("_held"), "left_semi")
