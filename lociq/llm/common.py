"""Small helpers that the text operators share: shared folders, Arrow text buffers, hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir as new_folder

#: Bytes of text that one numpy pass of an operator looks at; bounds its working memory.
CHUNK_BYTES = 1_000_000
#: Bytes of rows that are sent to a Python worker at once; in memory several times on their way.
BATCH_BYTES = 8 << 20
#: Bytes for each core (as Spark estimates them) below which a table is dealt to all cores before it is
#: looked at; a file of one row group would be one task.
SPREAD_BYTES = 4 << 20

_FOLDERS: list[str] = []

LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors share, until the driver's JVM ends or release() removes it."""
    path = new_folder(spark, purpose)
    _FOLDERS.append(path)
    return path


def folders() -> list[str]:
    """The folders made so far and not released."""
    return list(_FOLDERS)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders of shared_dir() that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        _FOLDERS.remove(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` bytes: 16 a row and column, and what texts have. For tables that are read
    from files; their rows are counted for this."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(16 * len(df.columns) + 16)
    for n in texts:
        size = size + n
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def sent_if_small(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to all tasks in a join if is_small()."""
    return F.broadcast(df) if is_small(df, most) else df


#: Words of 64 bits in a filter that tells which keys may be wanted (8 MB, whatever the number of keys), and the
#: bits that each key sets in it.
FILTER_WORDS, FILTER_BITS = 1 << 20, 3


def may_be_in(keys: DataFrame, key: Column) -> Column:
    """Whether `key` (a long) may be among keys (k): always true for those that are, and seldom for others (of a
    million keys, one in 10 000; of 20 million, one in five). So rows with long texts are picked out where they are
    read, by a filter of one size, and only these go on to a join."""
    places = lambda k: [F.pmod(F.xxhash64(k, F.lit(i)), F.lit(FILTER_WORDS * 64)) for i in range(FILTER_BITS)]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.explode(F.array(*places(F.col("k")))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(FILTER_WORDS).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = stored(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("table")), "filter").select("table").scalar()
    out = F.lit(True)
    for p in places(key):
        out &= F.call_function("shiftright", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out


def without_rows(df: DataFrame, key: Column, rows: DataFrame, row_key: Column, same: Column | list[Column], most: int) -> DataFrame:
    """df without what joins `rows` by the condition `same`; key and row_key are equal longs wherever it holds. Rows of
    up to `most` bytes are sent to all tasks. Of more, a filter is; only the rows of df that pass it are shuffled."""
    if is_small(rows, most):
        return df.join(F.broadcast(rows), same, "left_anti")
    may = may_be_in(rows.select(row_key.alias("k")), key)
    return df.where(~may).unionByName(df.where(may).join(rows, same, "left_anti"))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, to be sent to Python workers; from now on the session does so in batches of BATCH_BYTES at most (it
    is a setting of the session, looked at when the rows are read; a smaller one that is set stays). A table
    of less than SPREAD_BYTES for each core is dealt to all cores; any other stays as it is."""
    spark = df.sparkSession
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf
    now = conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < SPREAD_BYTES * cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, everything else as it is (whatever the locale)."""
    return F.translate(c, LETTERS_UPPER, LETTERS_LOWER)


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def release_memory() -> None:
    """Gives freed memory back to the machine: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Cut a batch into runs of rows whose texts hold about `limit` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    which = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
    release_memory()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and their len+1 offsets; null is empty."""
    if not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, "")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and _ODD ** -i modulo 2 ** 64 for i below n."""
    size = 1 << max(16, int(n - 1).bit_length())
    if not _POWERS or next(iter(_POWERS)) < size:
        up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.cumprod(up), np.cumprod(down))
    up, down = next(iter(_POWERS.values()))
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]: differences of polynomial prefix sums, scrambled.

    Equal spans have equal hashes wherever they stand. Spans are hashed in one vector pass.
    """
    n = len(values)
    up, down = _powers(max(n, 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[np.minimum(starts, max(n - 1, 0))]
    return mix64(raw ^ mix64((ends - starts).astype(np.uint64)))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes in each text, and first[i], the number of
    words before text i (len+1 entries). is_word: 256 flags by byte."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word[data]
    edge = np.diff(flags)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    cut = inner[(flags[inner] == 1) & (flags[inner + 1] == 1)]  # a run that crosses from text to text
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def byte_flags(ranges: list[tuple[int, int]]) -> np.ndarray:
    flags = np.zeros(256, np.int8)
    for a, b in ranges:
        flags[a : b + 1] = 1
    return flags


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
