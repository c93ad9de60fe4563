"""Quality by importance resampling (hashed n-grams, Gumbel top-k).

Two generative models over hashed word n-grams are counted, one of the target texts and one of all
texts. A document's log importance weight is the mean of log p_target / p_raw over its n-grams, times a
fixed effective length: the ratio of a passage of that length. The plain sum over a whole text makes the
sample one of short texts, since each n-gram that a small target sample happens to lack counts against
a text (README has figures). Adding Gumbel noise from a hash of the id and taking the k largest draws k
documents without replacement in proportion to their weights.

The k-th largest value is found without a global sort: counts by leading bits of the value, then
counts by the next bits of those that share the bits found so far, until all 64 are known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_flags, id_mod, mix64, read_table, slices, span_hashes, stored, text_bytes
from .counts import class_counts, labelled, lower_latin

BITS = 18
PRIOR = 5.0
EFFECTIVE_LENGTH = 40.0
#: Share of the documents that the query draws.
KEPT_SHARE = 0.8
MAX_LABELS = 500_000
_WORD = byte_flags([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_SPACE = byte_flags([(0x09, 0x0D), (0x20, 0x20)])


def features(data: np.ndarray, offsets: np.ndarray):
    """Buckets of each token: the token and its pair with the one before. Tokens are words, in lower
    case and marked if they were all capitals, and runs of other characters; a word that repeats the
    last one is a token of its own kind."""
    kind = np.where(_WORD[data] == 1, 1, np.where(_SPACE[data] == 1, 0, 2)).astype(np.int8)
    n = len(data)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    first = np.searchsorted(starts, offsets)
    lower = lower_latin(data)
    hashes = span_hashes(lower, starts, ends)
    before = np.concatenate([[0], np.cumsum(lower != data)])
    shout = (before[ends] - before[starts] == ends - starts) & (ends - starts > 1)
    hashes = mix64(hashes + shout.astype(np.uint64))
    opens = np.zeros(len(starts) + 1, bool)
    opens[first] = True
    opens = opens[: len(starts)]
    previous = np.concatenate([[0], hashes[:-1]]).astype(np.uint64)
    previous[opens] = 1
    hashes = np.where(hashes == previous, np.uint64(0x5EED), hashes)
    pairs = mix64(previous * np.uint64(0x9E3779B97F4A7C15) + hashes)
    return (np.stack([mix64(hashes), pairs], 1) >> np.uint64(64 - BITS)).astype(np.int64), first


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each bucket; counts: rows raw without target, target. The target's
    model is smoothed towards the raw one by PRIOR counts a bucket's mean."""
    raw = counts.sum(0).astype(float)
    share = (raw + 1e-3) / (raw.sum() + 1e-3 * len(raw))
    target = counts[1] + PRIOR * share * len(raw)
    return np.log(target / target.sum() / share).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_labels: int = MAX_LABELS) -> np.ndarray:
    """Weights of all buckets. Target texts are those labelled 1 whose crc32(id) mod 5 isn't 0; raw
    texts are all. Null texts aren't learnt from. Without target texts all weights are 0."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    target = labelled(source.where(id_mod("id", 5) != 0), labels.where(F.col(label_col) == 1), id_col, label_col, max_labels)
    raw = class_counts(source.select(F.lit(0).alias("cls"), "text"), 1, 1 << BITS, features)[0]
    good = class_counts(target.select(F.lit(0).alias("cls"), "text"), 1, 1 << BITS, features)[0]
    if not good.sum():
        return np.zeros(1 << BITS, np.float32)
    return log_ratios(np.stack([np.maximum(raw - good, 0), good]))


def importance(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and log_weight (a text without tokens: 0 and the lowest weight) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = features(*text_bytes(part.column("text")))
                sums = np.concatenate([[0], np.cumsum(sent.value[ids].mean(1, dtype=np.float64))])
                n = np.diff(first)
                mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
                weight = np.where(n > 0, EFFECTIVE_LENGTH * mean, -1000.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int64)), pa.array(weight)], names=[id_col, "n_tokens", "log_weight"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return bounded_batches(source).mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, n_tokens long, log_weight double")


def gumbel(key: Column, seed: str) -> Column:
    """Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, value: str, k: int, digit: int = 13) -> int | None:
    """The k-th largest of a long column, by counts of `digit` bits at a time; None if there are
    fewer than k rows. Each round brings at most 2 ** digit counts to the driver."""
    flipped = F.col(value).bitwiseXOR(F.lit(-(1 << 63)))  # so that the order is that of unsigned numbers
    found, known = 0, 0
    while known < 64:
        take = min(digit, 64 - known)
        same = rows.where(F.shiftrightunsigned(flipped, 64 - known) == found) if known else rows
        counts = same.groupBy(F.shiftrightunsigned(flipped, 64 - known - take).bitwiseAND(F.lit((1 << take) - 1)).alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if n >= k:
                found, known = found << take | d, known + take
                break
            k -= n
        else:
            return None
    return found - (1 << 63)


def ordered_bits(c: Column) -> Column:
    """A long in the order of a double column's values, rounded to 2 ** -32 (values up to 2 ** 30)."""
    return F.round(c * float(1 << 32)).cast("long")


def resampled(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, share: float = KEPT_SHARE, seed: str = "resample") -> DataFrame:
    """id, n_tokens, log_weight, noisy_weight and selected of each row of docs; about share * rows are
    selected, those with the largest noisy weight.

    Of rows with the noisy weight of the last one selected, those with the smaller ids are; rows that
    repeat an id with the same text are selected together, so that there may be a few more. Null and
    empty texts have the lowest weight; a null id is hashed like any value. Other columns are left out.
    """
    noisy = F.col("log_weight") + gumbel(F.col(id_col), seed)
    scored = stored(importance(docs, weights, id_col, text_col).withColumn("noisy_weight", noisy).withColumn("bits", ordered_bits(F.col("noisy_weight"))), "resample")
    rows = scored.count()
    k = int(round(share * rows))
    threshold = kth_largest(scored, "bits", k) if k else None
    if threshold is None:
        return scored.drop("bits").withColumn("selected", F.lit(k > 0))
    above = F.col("bits") > F.lit(threshold)
    ties = scored.where(F.col("bits") == threshold).withColumn("rank", F.coalesce(-F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(0)))
    left = k - scored.where(above).count()
    last = kth_largest(ties, "rank", left)
    at = (F.col("bits") == threshold) & (-F.xxhash64(F.lit(seed), F.col(id_col)) >= F.lit(last))
    return scored.withColumn("selected", above | at).drop("bits")


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return resampled(docs, fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_resampling": op7_quality_resampling}
ORACLES: dict[str, str] = {}
