"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source that has the share p of the corpus and is to have the share w of the mix gets the mean
repetition rate w / p (times the size of the mix). Each document's number of copies is the inverse of
a Poisson distribution with that mean at a uniform number drawn from a hash of its id, so that it is
the same in every run and on every executor. Documents are exploded by their counts, and the copies
are dealt to partitions and ordered by another hash: a global shuffle.

A mean above STEP is split into equal parts, each with a hash of its own; a sum of Poisson numbers is
one too. That keeps the table of probabilities short for any mean: nothing is cut off, since the
table reaches beyond the largest uniform number that 52 bits of hash can give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: The largest mean that is inverted at once, and terms of its table: P(Poisson(8) > 60) < 2 ** -64.
STEP, TERMS = 8.0, 61
#: Sources whose rates are broadcast; with more, rates are joined by a salted shuffle.
MAX_SENT_SOURCES = 200_000
SALTS = 64


def uniform(seed: str, *parts: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of an md5 hash of the parts' texts."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(count <= k) for k from 0 to TERMS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add, lambda acc: acc["sums"])


def repetition_rates(docs: DataFrame, weights: DataFrame | None, source_col: str, scale: float) -> DataFrame:
    """source, rate, parts and table of each source that is in docs. weights: (source, weight); a source
    without a weight isn't wanted, weights of a repeated source are added up; weights None: the same
    weight for each source."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        wanted = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sizes = sizes.join(wanted, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    rows, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    rates = sizes.select("source", F.coalesce(F.try_divide(F.col("weight") * F.lit(float(rows or 0)) * F.lit(float(scale)), F.col("size") * F.lit(float(weight or 0))), F.lit(0.0)).alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / STEP).cast("int"), F.lit(1))
    return rates.select("source", "rate", parts.alias("parts"), poisson_table(F.col("rate") / parts).alias("table"))


def copies(table: Column, parts: Column, seed: str, *key: Column) -> Column:
    """The inverse of the distribution at hashes of the key, added up over all parts: how many sums lie
    below each hash."""
    drawn = F.transform(F.sequence(F.lit(1), parts), lambda part: uniform(seed, part, *key))
    return F.aggregate(drawn, F.lit(0), lambda total, u: total + F.size(F.filter(table, lambda p: p < u)))


def mixed(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, scale: float = 1.0, seed: str = "mix") -> DataFrame:
    """All columns of docs, then _copy (0, 1, ...) and _order (a hash): each document as often as its
    source's rate and its hash say, in a global random order.

    Shares are counted in documents; the mix has about scale * (documents in docs) rows. weights: a
    table (source, weight), None for equal weights. Null is a source like others; weights of a repeated
    source are added up. A source with no weight, or one of 0 or less, gives no rows; if no weight is above 0 there are none at all.
    A row's hash is of its id and text (the id alone if there is no such column), null like the empty text, so that
    rows without an id, or of one id, are drawn each by itself; rows that repeat both are repeated alike. An empty
    table gives no rows. If docs has columns _copy or _order already, they are replaced.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c not in ("_copy", "_order")]
    plain = docs.select(*names).toDF(*(f"c{i}" for i in range(len(names))))
    key, source = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(source_col)}")
    text = F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit("")) if text_col in names else F.lit("")
    columns, plain = plain.columns, plain.withColumn("_key", F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(text)))
    key = F.col("_key")
    rates = repetition_rates(docs, weights, source_col, scale)
    few = docs.select(F.col(source_col)).distinct().limit(MAX_SENT_SOURCES + 1).count() <= MAX_SENT_SOURCES
    if few:
        joined = plain.join(F.broadcast(rates), source.eqNullSafe(F.col("source")))
    else:  # a source with a third of all rows is spread over SALTS tasks
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = plain.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, source.eqNullSafe(F.col("source")) & (F.col("_salt") == F.col("salt")))
    counted = joined.withColumn("_n", copies(F.col("table"), F.col("parts"), seed, key)).where("_n > 0")
    out = counted.select(*plain.columns, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    out = out.withColumn("_order", uniform(seed + "-order", key, F.col("_copy")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.select(*columns, "_copy", "_order").repartition(partitions, "_order").sortWithinPartitions("_order").toDF(*names, "_copy", "_order")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))


def _sql_uniform(seed: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def mixing_sql(table: str, seed: str = "mix") -> str:
    """mixed() with equal weights."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS size FROM {table} GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE * 1.0 / (size * (SELECT count(*) FROM sizes))::DOUBLE AS rate FROM sizes),
parted AS (SELECT source, greatest(CAST(ceil(rate / {STEP}) AS INTEGER), 1) AS parts, rate / greatest(ceil(rate / {STEP}), 1) AS mean FROM rates),
terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS total FROM parted
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM terms WHERE k < {TERMS - 1}
),
d AS (SELECT row_number() OVER () AS row_no, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS key, * FROM {table}),
u AS (SELECT row_no, source, {_sql_uniform(seed, "part", "key")} AS u FROM (SELECT d.row_no, d.key, d.source, unnest(range(1, parts + 1)) AS part FROM d JOIN parted ON d.source IS NOT DISTINCT FROM parted.source)),
n AS (SELECT row_no, CAST(sum((SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM u.source AND t.total < u.u)) AS BIGINT) AS n FROM u GROUP BY row_no),
c AS (SELECT d.* EXCLUDE (row_no), CAST(unnest(range(0, n)) AS INTEGER) AS _copy FROM d JOIN n USING (row_no))
SELECT * EXCLUDE (key), {_sql_uniform(seed + "-order", "key", "_copy")} AS _order FROM c
"""


QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLES = {"op3_source_mixing": mixing_sql("documents")}
