"""Corpus preparation in five stages, each one of the text operators.

Each stage takes the documents that the one before it kept, and returns documents with the same
columns; the last adds _copy and _order. run() applies them one after the other, each result written
to the shared folder and read again; what was written before it is removed then.

Any column may be null, texts may be empty or very long, rows may be repeated, the table may be empty,
and there may be further columns of any name, which come through as they are. What that means for a
stage's decision is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociq.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from lociq.llm.common import folders, read_table, release, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.5 or more; learnt from the labelled ones among them.

    Null and empty texts have no toxic word and stay. Repeated texts have one score and stay or go
    together. Rows with a null id or no label aren't learnt from, but judged. Without labels all stay."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null, empty and blank texts are one group. The longest text stays, then the smallest id (null last);
    of rows that repeat id and text, one stays."""
    return exact_dedup.deduplicated(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more).

    The smallest id stays; null ids only where a group has no other. Texts without words all stay. Rows
    that repeat id and text stay or go together."""
    return ngram_join.near_deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs.

    Null and empty texts stay, whatever the items; items without words hit nothing. Ids play no part."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated so that all sources weigh the same, in a global random order.

    Null is a source like others. Null ids share one hash; repeated ids are repeated alike. Columns _copy
    and _order are replaced if there are any."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), folders()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
        made = [f for f in folders() if f not in before]
        release(spark, made[:-1])  # all but the stage's result, which was written last
    return STAGES[-1][1](spark, docs, sf_dir)
