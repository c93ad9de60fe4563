"""Counts of hashed features by class over a whole table, as one small matrix.

Each task counts its rows into a matrix classes x buckets; blocks of these matrices are shuffled,
added up and brought to the driver, where they take 8 bytes for each class and bucket, however many
documents there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, release_memory, slices, text_bytes

BLOCK = 8192
#: Bytes of labelled ids that are sent to all tasks.
SENT_BYTES = 64 << 20
#: features(data, offsets) -> (ids, first): a row of bucket numbers for each place in the texts, and
#: the number of places before each text (one entry more than texts).
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals À-Þ in lower case; no byte moves."""
    out = ASCII_LOWER[data]
    if len(out) > 1:
        second = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def class_counts(docs: DataFrame, classes: int, buckets: int, features: Features) -> np.ndarray:
    """docs: (cls int, text string); rows with a null class are left out. Returns classes x buckets."""
    blocks = -(-buckets // BLOCK)
    if not classes:
        return np.zeros((0, buckets), np.int64)

    def count(batches):
        local = np.zeros((classes, blocks * BLOCK), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                cls = part.column("cls").to_numpy(zero_copy_only=False)
                ids, first = features(*text_bytes(part.column("text")))
                which = np.repeat(cls, np.diff(first))
                for c in np.unique(cls):
                    local[c] += np.bincount(ids[which == c].ravel(), minlength=local.shape[1])
        cut = local.reshape(classes, blocks, BLOCK)
        at = np.argwhere(cut.any(2))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([cut[c, b].tobytes() for c, b in at], pa.binary())], names=["cls", "block", "counts"])
        del local, cut
        release_memory()

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, b, raw in zip(*(column.to_pylist() for column in batch.columns)):
                counts = np.frombuffer(raw, np.int64)
                sums[c, b] = sums[c, b] + counts if (c, b) in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["cls", "block", "counts"])

    schema = "cls int, block int, counts binary"
    source = docs.where("cls IS NOT NULL AND text IS NOT NULL").select(F.col("cls").cast("int").alias("cls"), "text")
    parts = bounded_batches(source).mapInArrow(count, schema).repartition(min(classes * blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cls", "block")
    total = np.zeros((classes, blocks, BLOCK), np.int64)
    for c, b, raw in zip(*(column.to_pylist() for column in parts.mapInArrow(add, schema).toArrow().columns)):
        total[c, b] += np.frombuffer(raw, np.int64)
    return total.reshape(classes, -1)[:, :buckets]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """docs (with its column id) joined to a sample of at most about `most` labelled ids, so that the
    labels can be broadcast (up to SENT_BYTES; longer ids are joined by a shuffle); the sample is by a hash
    of the id. Labels of a repeated id count as the
    largest."""
    ids = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id IS NOT NULL AND label IS NOT NULL")
    n, letters = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("l_id").cast("string"))), F.lit(0))).first()
    part = min(1.0, most / max(1, n))
    if part < 1:
        ids = ids.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 40)) < int(part * (1 << 40)))
    ids = ids.groupBy("l_id").agg(F.max("label").alias("label"))
    small = part * (letters + 32 * n) <= SENT_BYTES
    return docs.join(F.broadcast(ids) if small else ids, F.col("id") == F.col("l_id")).drop("l_id")
