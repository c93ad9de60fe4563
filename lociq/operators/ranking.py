"""Top rows, first rows and cumulative sums with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def extremes(rows: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n largest and n smallest rows, marked top and bottom; both are top-k reports, without a sort
    of the whole."""
    top = rows.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    bottom = rows.orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def with_interest(rows: DataFrame, value: str, name: str, n: int, pattern: str) -> DataFrame:
    """The extremes, and between them the rows whose name matches a pattern and that aren't extreme."""
    ends = extremes(rows, value, name, n)
    between = rows.where(F.col(name).rlike(pattern)).join(ends.select(name), name, "left_anti").withColumn("side", F.lit("interest"))
    return ends.unionByName(between.select(*ends.columns))


def first_per(rows: DataFrame, by: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The place of each row within its group. Rows are dealt out by ranges of the order and stored, so that each
    range numbers its rows of a group by itself, after those of the ranges before: a group of any size is ranked by
    many tasks. Rows that are equal in all of `order` have any order."""
    parts = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    keys = [f"_k{i}" for i in range(len(by))]
    sizes = parts.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("_part").alias("_at")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_at", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = parts.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = [F.col("_part") == F.col("_at"), *(F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys))]
    return inside.join(starts, same).withColumn("rank", (F.col("_start") + F.col("_inside")).cast("int")).select(*rows.columns, "rank")


def ranked_overall(rows: DataFrame, value: str, ties: list[str], *, slices: int = 64) -> DataFrame:
    """The place of each row among all, from the largest number on; equal ones by `ties`; null comes last.

    Rows are cut into slices at approximate quantiles (found at once, so that they stay as they are); each
    slice is ordered by itself and begins after the rows of those above it."""
    cuts = sorted(set(rows.approxQuantile(value, [i / slices for i in range(1, slices)], 0.002))) if slices > 1 else []
    piece = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(value))))
    rows = rows.withColumn("_piece", piece)
    sizes = rows.groupBy(F.col("_piece").alias("_at")).agg(F.count("*").alias("_rows")).withColumn("_all", F.lit(0))
    above = Window.partitionBy("_all").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_at", F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(F.desc(value), *ties))
    return rows.withColumn("_inside", inside).join(F.broadcast(starts), F.col("_piece") == F.col("_at")).withColumn("rank", (F.col("_start") + F.col("_inside")).cast("int")).drop("_piece", "_inside", "_at", "_start")


def cumulative_from_top(rows: DataFrame, by: str, level: str, value: str) -> DataFrame:
    return rows.withColumn("at_least", F.sum(value).over(Window.partitionBy(by).orderBy(F.desc(level))))


def neighbours_in_range(rows: DataFrame, by: list[str], position: str, distance: int, *, width: int | None = None) -> DataFrame:
    """How many rows of the same group lie within the distance, by a range frame. A group is cut into bins of
    `width`; a row also stands, as a neighbour only, in the bins that its frame reaches into, so that a
    group of any size is framed by many tasks. A null position has no neighbours."""
    width = max(width or 8 * distance, 1)
    bin_of = lambda p: F.floor(p / width).cast("long")
    at = F.col(position)
    rows = rows.withColumn("_bin", F.explode(F.when(at.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bin_of(at - distance), bin_of(at + distance)))))
    near = Window.partitionBy(*by, "_bin").orderBy(position).rangeBetween(-distance, distance)
    own = at.isNull() | (F.col("_bin") == bin_of(at))
    return rows.withColumn("n_near", F.when(at.isNull(), F.lit(0).cast("long")).otherwise(F.count(position).over(near))).where(own).drop("_bin")
