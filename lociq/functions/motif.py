"""Position-specific scoring: counts to scores, and scores of sequence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(c: Column) -> Column:
    """Upper case; letters other than A, C, G, T stay, in upper case."""
    return F.reverse(F.translate(F.upper(c), "ACGT", "TGCA"))


def log_risk(share: Column, background: Column | float = 0.25) -> Column:
    """log2(share / background); null for a share of 0 ("can't occur")."""
    background = background if isinstance(background, Column) else F.lit(background)
    return F.log2(F.when(share > 0, share / background))


def log_odds(count: Column, total: Column) -> Column:
    """log2(count / (total - count)) - log2(1 / 3); null for a count of 0 or all of the total."""
    return F.log2(F.when((count > 0) & (count < total), count / (total - count))) + F.log2(F.lit(3.0))


def normalised(counts: DataFrame) -> DataFrame:
    """(motif_id, pos, base, value) to the share of each base and its score at its position; a
    position without counts has shares of 0."""
    total = F.sum("value").over(Window.partitionBy("motif_id", "pos"))
    return counts.withColumn("total", total).withColumn("share", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("total").cast("double")), F.lit(0.0))).withColumn("score", log_risk(F.col("share")))


def weights(matrix: DataFrame) -> DataFrame:
    """(motif_id, pos, base, score), positions from 0, to a row for each motif: length and w, an array by
    position of maps from base to score; a base that can't occur is missing."""
    by_pos = matrix.groupBy("motif_id", "pos").agg(F.map_from_entries(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("base", "score")))).alias("m"))
    return by_pos.groupBy("motif_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m")), lambda x, y: x["pos"] - y["pos"]), lambda x: x["m"]).alias("w")).withColumn("length", F.size("w"))


def window_score(window: Column, w: Column, skip_n: bool = True) -> Column:
    """Sum of the scores of a short text's letters; null if one can't occur. N: null, or counted as 0."""
    one = lambda base, m: F.when(F.lit(not skip_n) & (base == "N"), F.lit(0.0)).otherwise(F.try_element_at(m, base))
    return F.aggregate(F.zip_with(F.split(window, ""), w, one), F.lit(0.0), lambda acc, x: acc + x)
