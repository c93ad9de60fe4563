"""Queries that run as streams over the given tables, written as files in order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import shared_dir
from ..streaming.best_hits import OUT, rocksdb, stream_best_hits
from .intervals import NEAR, ORACLES as BATCH
from .registry import registry
from .stand_ins import sites

query, QUERIES, ORACLES = registry()
SLICES = 3


@query(BATCH["j1_best_hit_annotation"])
def st1_best_hits_of_a_stream(spark, sf_dir):
    """Events arrive in slices of time, and with the last one a marker that flushes the last sites. Each slice is one
    micro-batch, however many files it has: the stream is started again for it where it had stopped."""
    rows = sites(spark, sf_dir).select("site_id", "chrom", "start", "end", "name", "score", "strand")
    folder = shared_dir(spark, "stream")
    cuts = rows.approxQuantile("start", [i / SLICES for i in range(1, SLICES)], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    last = rows.agg(F.max("end").alias("end")).select(F.lit(-1).cast("long").alias("site_id"), F.lit("~").alias("chrom"), (F.col("end") + 10 * NEAR).alias("start"), (F.col("end") + 10 * NEAR + 1).alias("end"), F.lit("purchase").alias("name"), F.lit(0.0).alias("score"), F.lit("+").alias("strand"))
    names = [r[0] for r in rows.select("name").distinct().collect()]  # a few event types
    with rocksdb(spark):
        for low, high in zip(bounds, bounds[1:]):
            part = rows.where((F.col("start") >= low) & (F.col("start") < high))
            (part.unionByName(last) if high == bounds[-1] else part).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            main = stream.where("name = 'purchase'").select("site_id", "chrom", "start", "end", "strand")
            hits = stream.select(F.col("site_id").alias("hit_id"), "chrom", "start", "end", F.col("name").alias("motif"), "score", "strand")
            best = stream_best_hits(main, hits, names, NEAR, late=NEAR)
            best.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out").where("site_id >= 0")
