"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, personal data, packing.

Every stage gets the documents that its predecessor kept, written as Parquet and read again.
Stages that change texts set n_chars anew.

In all stages, repeated rows are rows of their own, ties are settled by the operators' fixed
orders, an empty table gives an empty one, and columns beside those of documents stay, whatever
their names, but for the last stage, which returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import line_dedup, near_dup, packing, pii, quality_rules
from recollect.llm.common import stored, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules pass; cutoffs are certified on the labels.

    A null or empty text has no words and goes; a null id is judged like any other; a null language
    is a stratum of its own; a text of any length is read whole.
    """
    return quality_rules.filter_quality(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share.

    No row goes, even if no line is left; a null text stays null and counts as one empty line;
    rows of one text without an id count as one document.
    """
    return _counted(line_dedup.drop_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of similarity 0.8 or more on five-word shingles.

    Rows with a null id or without words stay; rows of an id that is kept all stay.
    """
    return near_dup.drop_near_duplicates(docs, near_dup.Plan())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked by its kind. A null text stays null, no row goes."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in token sequences.

    A null or empty text is one piece, the end id alone; a text longer than a sequence gives
    several pieces; a null id stays null.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: The stages learn models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
