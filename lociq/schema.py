"""Table shapes and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

SITE = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("strand", T.StringType()),
    ]
)
HIT = T.StructType([*SITE.fields, T.StructField("match", T.StringType())])
SIGNAL = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
#: Long form of a context table: one row for each site and motif that has a hit.
CONTEXT = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("motif", T.StringType()),
        T.StructField("shift", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("strand_equal", T.IntegerType()),
        T.StructField("num_in_window", T.LongType()),
    ]
)
# The twelve signal columns, in file order.
TARGETS = ["pos", "tp73"]
CELL_LINES = ["saos2", "skmel29_2"]
ISOFORMS = ["DN", "GFP", "TA"]
SIGNALS = [f"{t}_{c}_{i}" for t in TARGETS for c in CELL_LINES for i in ISOFORMS]
