"""Stream-stream interval join: the bounded window of a scan over sorted sites, in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_events(sites: DataFrame, hits: DataFrame, *, within: str = "6 hours", late: str = "1 hour", by: str = "chrom") -> DataFrame:
    """Pairs of a site and a hit of one key whose times differ by `within` at most. sites: (by, ts, site_id);
    hits: (by, ts, ...). Works on batches and on streams: there, rows later than `late` are dropped and
    state is kept only as long as a row of the other side may still match."""
    a = sites.withWatermark("ts", late).select(F.col(by).alias("a_by"), F.col("ts").alias("site_ts"), "site_id")
    b = hits.withWatermark("ts", late).withColumnRenamed("ts", "hit_ts").withColumnRenamed(by, "b_by")
    near = F.col("hit_ts").between(F.col("site_ts") - F.expr(f"INTERVAL {within}"), F.col("site_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("a_by") == F.col("b_by")) & near)
