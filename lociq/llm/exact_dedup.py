"""Exact deduplication over an extendible-hash index on shared files.

1. Each text is normalised and hashed (64 bits) by built-in functions; the index entries (id, key,
   code points, sha-256) are written to Parquet files in the shared folder. No text is moved.
2. The directory starts with one bucket of all keys. While a bucket has more entries than its
   capacity it is split on one more leading bit of the key; where that bucket already used all bits
   of the directory, the directory doubles. Only counts by key prefix are looked at for this.
   Neighbouring buckets, so ranges of keys, are dealt to owners of about equal size.
3. Tasks count the keys of their own entries and send them to the owners. An owner sorts its buckets
   by key, writes them to its file, and so finds the keys that occur twice or more.
4. Texts of these keys are chained and compared byte by byte: first among the rows of a task, so that
   thousands of copies leave it as one row, then by the key's owner, which reads its buckets sorted by
   key and so holds one key's chain at a time. Texts with one key and different bytes form
   different chains.
5. Entries meet their chain's head in a join on key and digest.

Every step reads tables on shared files, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, is_small, may_be_in, read_table, sent_if_small, shared_dir, slices, stored, without_rows

DROPPED = b" \t\n\x0b\x0c\r"
#: Entries in a bucket before it is split, and the most bits that the directory uses. Buckets that
#: are still larger then overflow: their owner has more to do, the result is the same.
CAPACITY = 8_192
MAX_DEPTH = 16
#: Entries that an owner has, unless one bucket has more.
OWNED = 2_000_000
#: Bytes of a table that is sent to all tasks; a larger one is joined by a shuffle.
SENT_BYTES = 48 << 20
#: Bytes of distinct texts that a task chains before it hands them on.
FLUSH_BYTES = 48_000_000


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, DROPPED)


def key_of(text: bytes) -> int:
    """The index key, signed: what Spark's xxhash64 gives for the normalised text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def normalised_column(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in DROPPED.decode():
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def key_column(text: Column) -> Column:
    """key_of(normalised(text)) as a column."""
    return F.xxhash64(normalised_column(text))


def directory(counts: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int]]:
    """Extendible hashing: (depth, bucket of each key prefix of that many bits). counts: entries by
    prefix of `bits` bits."""
    have = np.zeros(1 << bits, np.int64)
    for prefix, n in counts.items():
        have[prefix] = n
    sums = np.concatenate([[0], np.cumsum(have)])
    depth, buckets, todo = 0, [], [(0, 0)]  # (local depth, prefix of that many bits)
    while todo:
        local, prefix = todo.pop()
        width = bits - local
        if sums[(prefix + 1) << width] - sums[prefix << width] > capacity and local < bits:
            depth = max(depth, local + 1)  # the directory doubles when no entry has that many bits yet
            todo += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append((local, prefix))
    table = np.zeros(1 << depth, np.int64)
    for number, (local, prefix) in enumerate(buckets):
        table[prefix << (depth - local) : (prefix + 1) << (depth - local)] = number
    return depth, table.tolist()


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def owners_of(counts: dict[int, int], bits: int, depth: int, table: list[int], most: int) -> np.ndarray:
    """The owner of each bucket: neighbours share one while they have at most `most` entries together."""
    sizes = np.zeros(max(table, default=0) + 1, np.int64)
    for prefix, n in counts.items():
        sizes[table[prefix >> (bits - depth)]] += n
    owners, owner, filled = np.zeros(len(sizes), np.int64), 0, 0
    for bucket, n in enumerate(sizes.tolist()):
        if filled and filled + n > most:
            owner, filled = owner + 1, 0
        owners[bucket], filled = owner, filled + n
    return owners


def _entries(source: DataFrame) -> DataFrame:
    text, norm = F.col("text"), normalised_column(F.col("text"))
    points = F.length(F.coalesce(text, F.lit(""))).cast("long")
    return source.select("id", F.xxhash64(norm).alias("key"), points.alias("points"), F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(text).alias("raw"), F.monotonically_increasing_id().alias("row"))


class Directory:
    """Depth, bucket of each key prefix and owner of each bucket, as the tasks get it."""

    def __init__(self, depth: int, table: list[int], owners: np.ndarray):
        self.depth, self.table, self.owners = depth, np.array(table, np.int64), owners

    def buckets(self, keys: np.ndarray) -> np.ndarray:
        return self.table[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int64)


def _counted_locally(entries: DataFrame, sent) -> DataFrame:
    """(owner, bucket, key, n): the keys of some thousand entries each, with how many have them."""

    def run(batches):
        for batch in batches:
            keys, n = np.unique(batch.column("key").to_numpy(), return_counts=True)
            buckets = sent.value.buckets(keys)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.owners[buckets].astype(np.int32)), pa.array(buckets), pa.array(keys), pa.array(n)], names=["owner", "bucket", "key", "n"])

    return bounded_batches(entries.select("key")).mapInArrow(run, "owner int, bucket long, key long, n long")


def _bucket_rows(counted: DataFrame) -> DataFrame:
    """The owners' first work: rows sorted by bucket and key become one row for each key."""

    def run(batches):
        last = (0, 0, 0)  # bucket, key and count of the key that may go on in the next batch
        for batch in batches:
            bucket, key, n = (batch.column(c).to_numpy() for c in ("bucket", "key", "n"))
            if last[2]:
                bucket, key, n = np.append(last[0], bucket), np.append(last[1], key), np.append(last[2], n)
            if not len(key):
                continue
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sums = np.add.reduceat(n, at)
            last = (int(bucket[at[-1]]), int(key[at[-1]]), int(sums[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array(key[at[:-1]]), pa.array(sums[:-1])], names=["bucket", "key", "n"])
        if last[2]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last], names=["bucket", "key", "n"])

    return counted.select("bucket", "key", "n").mapInArrow(run, "bucket long, key long, n long")


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id): the longer, then the smaller id, a null id last."""
    rank = lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1])
    return a if rank(a) <= rank(b) else b


class Chains:
    """Entries by key; a chain holds the distinct texts of a key, each with its best row and count."""

    def __init__(self):
        self.by_key: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, row: tuple, count: int) -> None:
        chain = self.by_key.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                entry[1], entry[2] = _better(entry[1], row), entry[2] + count
                return
        chain.append([text, row, count])
        self.bytes += len(text) + 200

    def rows(self):
        for key, chain in self.by_key.items():
            for text, (points, best), count in chain:
                yield key, text, points, best, count


def _chained_locally(texts: DataFrame, id_type: str, id_arrow: pa.DataType, sent) -> DataFrame:
    """Distinct texts among each task's rows, with their bucket and owner."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), id_arrow, pa.int64())

    def run(batches):
        def out(chains: Chains):
            rows = list(chains.rows())
            buckets = sent.value.buckets(np.array([r[0] for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.value.owners[buckets].astype(np.int32)), pa.array(buckets)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                names=["owner", "bucket", "key", "body", "points", "best", "n"],
            )

        chains = Chains()
        for batch in batches:
            for part in slices(batch, "text"):
                for i, t in zip(*(part.column(c).to_pylist() for c in ("id", "text"))):
                    text = normalised(t)
                    chains.add(key_of(text), text, (len(t or ""), i), 1)
                    if chains.bytes > FLUSH_BYTES:
                        yield from out(chains)
                        chains = Chains()
        yield from out(chains)

    return bounded_batches(texts).mapInArrow(run, f"owner int, bucket long, key long, body binary, points long, best {id_type}, n long")


def _owned(texts: DataFrame, id_type: str, id_arrow: pa.DataType) -> DataFrame:
    """The owners' work: rows sorted by bucket and key become one row per chain entry."""

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), id_arrow, pa.int64()))], names=["key", "digest", "most", "keep", "n"]
            )

        chains, now, done = Chains(), None, []
        for batch in batches:
            for part in slices(batch, "body"):
                for key, text, points, best, n in zip(*(part.column(c).to_pylist() for c in ("key", "body", "points", "best", "n"))):
                    if key != now:
                        done += [(k, hashlib.sha256(t).digest(), p, i, c) for k, t, p, i, c in chains.rows()]
                        chains, now = Chains(), key
                    chains.add(key, text, (points, best), n)
                if len(done) > 10_000:
                    yield out(done)
                    done = []
        done += [(k, hashlib.sha256(t).digest(), p, i, c) for k, t, p, i, c in chains.rows()]
        yield out(done)

    return texts.mapInArrow(run, f"key long, digest binary, most long, keep {id_type}, n long")


class ExactIndex:
    """The written index of a table: entries, buckets, chains of repeated texts, and rows that occur twice."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, capacity: int, sent_bytes: int):
        spark = docs.sparkSession
        source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        id_type = source.schema["id"].dataType.simpleString()
        id_arrow = spark.createDataFrame([], source.select("id").schema).toArrow().schema.field(0).type
        path = shared_dir(spark, "exact-index")
        self.sent_bytes = sent_bytes

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        self.entries = kept(_entries(source), "entries")
        total = self.entries.count()
        bits = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / capacity)) + 4))
        counts = {r[0]: r[1] for r in self.entries.groupBy(_prefix(F.col("key"), bits).alias("p")).count().collect()}
        depth, table = directory(counts, bits, capacity)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        owners = owners_of(counts, bits, depth, table, max(capacity, min(OWNED, total // tasks)))
        sent = spark.sparkContext.broadcast(Directory(depth, table, owners))
        dealt = lambda df: df.repartitionById(int(owners.max(initial=0)) + 1, "owner").sortWithinPartitions("bucket", "key")

        self.buckets = kept(_bucket_rows(dealt(_counted_locally(self.entries, sent))), "buckets")
        repeated = sent_if_small(self.buckets.where("n > 1").select("key"), sent_bytes)
        # Texts are found by the hash of the text as it is, so that they aren't normalised again to be found.
        twice = kept(self.entries.join(repeated, "key", "left_semi"), "twice")
        found = kept(twice.select("raw").distinct(), "found")
        if is_small(found, sent_bytes):
            texts = source.withColumn("raw", F.xxhash64("text")).join(F.broadcast(found), "raw", "left_semi").select("id", "text")
        else:  # a few texts that don't repeat pass too and become chains of one
            texts = source.where(may_be_in(found.select(F.col("raw").alias("k")), F.xxhash64("text")))
        self.chains = kept(_owned(dealt(_chained_locally(texts, id_type, id_arrow, sent)), id_type, id_arrow), "chains")
        same = ["key", "digest", "id", "points"]
        self.twins = kept(twice.groupBy(*same).agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "twins")
        self.has_twins = not self.twins.isEmpty()

    def groups(self) -> DataFrame:
        """id, key, points, keep, n, kept, digest of each row."""
        best = F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep"))
        entries = self.entries
        if self.has_twins:
            e, t = entries.alias("e"), self.twins.alias("t")
            same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("key", "digest", "id", "points")]
            entries = e.join(t, same, "left").select("e.*", "t.first")
            best &= F.col("first").isNull() | (F.col("first") == F.col("row"))
        best &= F.col("n").isNull() | (F.col("points") == F.col("most"))
        return entries.join(sent_if_small(self.chains, self.sent_bytes), ["key", "digest"], "left").select("id", "key", "points", "digest", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"), best.alias("kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """One row for each row of docs: id, keep_id (id of the row that stays of its group), group_size,
    kept, text_sha256 of the normalised text.

    Texts are equal when they are identical without space, tab, line and page breaks; null counts as
    empty, so null, empty and blank texts are one group. The row with the most code points stays,
    then the one with the smallest id (null last); of rows that are repeated with the same id and
    text, one stays. An empty table gives no rows. Other columns are left out.
    """
    groups = ExactIndex(docs, id_col, text_col, capacity, sent_bytes).groups()
    return groups.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs, all columns as they are, with one row of each group of equal texts; which one, and the
    special cases, as in exact_groups(). Rows to drop are broadcast up to `sent_bytes`; beyond that they are
    joined by a shuffle, with those rows of docs that a filter lets pass."""
    index = ExactIndex(docs, id_col, text_col, capacity, sent_bytes)
    names, marks = docs.columns, ("_drop_id", "_drop_key", "_drop_points")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    plain = plain.select("*", doc_id.alias("_id"), key_column(text).alias("_key"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_points"))

    same = [F.col("_key") == F.col("_drop_key"), F.col("_points") == F.col("_drop_points"), F.col("_id").eqNullSafe(F.col("_drop_id"))]

    of = lambda df: df.select(F.col("id").alias(marks[0]), F.col("key").alias(marks[1]), F.col("points").alias(marks[2]))
    groups, twins = index.groups(), of(index.twins)
    dropped = stored(of(groups.where("n > 1 AND NOT kept")), "exact-drop")
    if index.has_twins:  # a twin of a row that stays isn't dropped by its id and key, but as a repeated row
        stays = of(groups.where("n > 1 AND kept"))
        a, b = dropped.alias("a"), stays.alias("b")
        dropped = a.join(b, [F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")) for m in marks], "left_anti")
    left = lambda df, rows: without_rows(df, F.col("_key"), rows, F.col("_drop_key"), same, sent_bytes)
    rest = left(plain, dropped)
    if index.has_twins:
        two = rest if is_small(twins, sent_bytes) else rest.where(may_be_in(twins.select(F.col("_drop_key").alias("k")), F.col("_key")))
        rest = left(rest, twins).unionByName(two.join(sent_if_small(twins, sent_bytes), same, "left_semi").dropDuplicates(["_id", "_key", "_points"]))
    return rest.drop("_id", "_key", "_points").toDF(*names)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
