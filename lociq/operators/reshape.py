"""Set operations, and long and wide forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_union(parts: dict[str, DataFrame], name: str = "part") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn(name, F.lit(k)) for k, df in parts.items()))


def melted(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return rows.unpivot(ids, values, "variable", "value")


def side_by_side(rows: DataFrame, key: str, column: str, values: list[str], value: str, fill: float) -> DataFrame:
    """One column for each of some values, with `fill` where there is none."""
    return rows.groupBy(key).pivot(column, values).agg(F.first(value)).fillna(fill, values)


def split_by_sets(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """rows with a set column, once for each set that their key is in."""
    return rows.join(members.select(key, "set_name").distinct(), key)


def selective(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that only the one set has many of, marked only_a and only_b."""
    only_a = (F.col(b) == 0) & (F.col(a) >= 7)
    only_b = (F.col(b) >= 2) & (F.col(a) <= 1)
    return counts.withColumn("side", F.when(only_a, "only_a").when(only_b, "only_b")).where("side IS NOT NULL")


def joined_regions(one: DataFrame, two: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Two regions of a key as one: smallest start, largest end, sums of columns."""
    a, b = one.alias("a"), two.alias("b")
    return a.join(b, key).select(key, F.least("a.start", "b.start").alias("start"), F.greatest("a.end", "b.end").alias("end"), *((F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in sums))


def bound(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The columns of two tables of the same rows side by side, by their key and never by position. An error
    unless both have each key once, and the same keys."""
    other = two.withColumnRenamed(key, "_key")
    once = [df.groupBy(c).count().where("count > 1").isEmpty() for df, c in ((one, key), (other, "_key"))]
    same = F.col(key).eqNullSafe(F.col("_key"))
    if not (all(once) and one.join(other, same, "left_anti").isEmpty() and other.join(one, same, "left_anti").isEmpty()):
        raise ValueError("the tables don't have the same rows")
    return one.join(other, same).drop("_key")
