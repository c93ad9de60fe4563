"""Views of the given tables as sites, genes and context rows, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sites: a user is a chromosome, a second a base, an event type a motif."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    pos = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"), pos.alias("pos"))
    strand = F.when(F.col("k") % 2 == 0, "+").otherwise("-")
    return rows.select(F.col("event_id").alias("site_id"), F.col("user_id").cast("string").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 600).alias("end"), F.col("event_type").alias("name"), F.col("value").alias("score"), strand.alias("strand"), "k")


SITES = """sites AS (
  SELECT event_id AS site_id, CAST(user_id AS VARCHAR) AS chrom, pos AS s, pos + 600 AS e, event_type AS name, value AS score, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, k
  FROM (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k, date_diff('second', TIMESTAMP '2024-01-01', ts) AS pos FROM events)
)"""


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on 24 chromosomes of a million bases."""
    rows = sites(spark, sf_dir)
    start = F.col("start") % 1_000_000
    return rows.select("site_id", (F.col("chrom").cast("long") % 24).cast("string").alias("chrom"), start.alias("start"), (start + 18).alias("end"), "name", "score", "strand", "k")


LOCI = SITES + """, loci AS (SELECT site_id, CAST(CAST(chrom AS BIGINT) % 24 AS VARCHAR) AS chrom, s % 1000000 AS s, s % 1000000 + 18 AS e, name, score, strand, k FROM sites)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcripts: a customer is a gene."""
    start = (F.col("o_orderkey") * 37) % 1_000_000
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("gene"),
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("transcript"),
        F.col("o_orderkey").alias("line"),
        (F.col("o_custkey") % 24).cast("string").alias("chrom"),
        start.alias("start"),
        (start + 200 + F.floor(F.col("o_totalprice") / 100).cast("long")).alias("end"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("o_orderpriority").alias("set_name"),
    )


GENES = """genes AS (
  SELECT 'G' || o_custkey AS gene, 'T' || o_orderkey AS transcript, o_orderkey AS line, CAST(o_custkey % 24 AS VARCHAR) AS chrom, o_orderkey * 37 % 1000000 AS s,
    o_orderkey * 37 % 1000000 + 200 + CAST(floor(o_totalprice / 100) AS BIGINT) AS e, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderpriority AS set_name
  FROM orders
)"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of a long context table with signals."""
    i = lambda c: F.col(c).cast("int")
    rows = table(spark, sf_dir, "lineitem")
    n = i("l_quantity") % 4
    return rows.select(
        F.concat(F.lit("M"), (F.col("l_partkey") % 20).cast("string")).alias("motif"),
        (F.col("l_suppkey") % 24).cast("string").alias("chrom"),
        n.alias("num_in_window"),
        F.when(n > 0, (F.col("l_orderkey") % 201 - 100).cast("int")).alias("shift"),
        (F.col("l_extendedprice") / 10000).alias("score"),
        F.round(F.col("l_discount") * 100).cast("int").alias("tp73_skmel29_2_DN"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tp73_skmel29_2_TA"),
        i("l_linenumber").alias("tp73_skmel29_2_GFP"),
        (i("l_quantity") % 7).alias("pos_skmel29_2_DN"),
        (F.col("l_partkey") % 5).cast("int").alias("pos_skmel29_2_TA"),
        (F.col("l_suppkey") % 3).cast("int").alias("pos_skmel29_2_GFP"),
        (F.col("l_returnflag") == "A").alias("in_promoter"),
        F.col("l_orderkey").alias("row_key"),
    )


CONTEXT = """context AS (
  SELECT 'M' || (l_partkey % 20) AS motif, CAST(l_suppkey % 24 AS VARCHAR) AS chrom, CAST(l_quantity AS INTEGER) % 4 AS n,
    CASE WHEN CAST(l_quantity AS INTEGER) % 4 > 0 THEN CAST(l_orderkey % 201 - 100 AS INTEGER) END AS shift, l_extendedprice / 10000 AS score,
    CAST(round(l_discount * 100) AS INTEGER) AS dn, CAST(round(l_tax * 100) AS INTEGER) AS ta, CAST(l_linenumber AS INTEGER) AS gfp,
    CAST(l_quantity AS INTEGER) % 7 AS pdn, CAST(l_partkey % 5 AS INTEGER) AS pta, CAST(l_suppkey % 3 AS INTEGER) AS pgfp, l_returnflag = 'A' AS prom, l_orderkey AS row_key
  FROM lineitem
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare."""
    return df.withColumns({c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double"})
