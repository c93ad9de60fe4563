"""Benchmark decontamination: word windows of benchmark items, searched in training texts.

The windows of all items become a hash set that every executor gets; each task rolls over the word
windows of its texts as numpy vectors, looks their 64-bit hashes up, verifies every hit by its words
and marks the words hit. Texts are not shuffled.

A set is broadcast only if the items have at most BLOCK_BYTES of text. The windows of a larger benchmark are a table,
and what is broadcast is a bit for each of their hashes, FILTER_BITS bits at most. The texts are searched once,
however large the benchmark is: windows whose bit is set leave the task with their words, and a join with the table by
these words says which are hits. What was hit then meets the texts by their hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, byte_flags, is_small, may_be_in, mix64, read_table, sent_if_small, slices, span_hashes, stored, text_bytes, without_rows, word_spans

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text: digits, a-z and everything beyond ASCII.
WORD_BYTES = byte_flags([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
SIZE = 10
#: Bytes of item texts in one broadcast set. A set takes the words, 32 bytes for each window and SLOTS to
#: twice as many for its filter: about 60 bytes a window, 120 MB if all words had one letter.
BLOCK_BYTES, SLOTS = 4 << 20, 8
#: Windows of an item that are written at once, bits for each window in a large benchmark's filter and in all, and
#: bytes of a table that is sent to all tasks.
PIECE_WINDOWS, BITS_EACH, FILTER_BITS, SENT_BYTES = 2_000, 32, 29, 32 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    data = ASCII_LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), WORD_BYTES)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` consecutive word hashes."""
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * _STEP + words[i : i + len(total)]
    return mix64(total)


class WindowSet:
    """Windows of benchmark items by number of words and hash, with their words and items."""

    def __init__(self, items: list[tuple], size: int):
        self.items = [item for item, _ in items]
        parts = [b" ".join(words_of(text or "")) for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
        self.raw = b"".join(p + b" " for p in parts)
        data = np.frombuffer(self.raw, np.uint8)
        starts, ends, first = word_spans(data, offsets, WORD_BYTES)
        words = span_hashes(data, starts, ends)
        counts = np.diff(first)
        #: By number of words: hashes (sorted), filter, begin and end in raw, and where its items are in `owners`.
        self.windows: dict[int, tuple] = {}
        for n in np.unique(np.minimum(counts[counts > 0], size)).tolist():
            rolled = window_hashes(words, n)
            owner = np.repeat(np.arange(len(items)), counts)[: len(rolled)]
            at = np.flatnonzero((np.arange(len(rolled)) + n <= first[owner + 1]) & (np.minimum(counts[owner], size) == n))
            hashes, begin, end, owner = rolled[at], starts[at], ends[at + n - 1], owner[at].astype(np.int32)
            same = span_hashes(data, begin, end)  # tells windows of one hash apart
            order = np.lexsort((owner, same, hashes))
            hashes, begin, end, owner, same = (x[order] for x in (hashes, begin, end, owner, same))
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (same[1:] != same[:-1])
            twice = ~fresh
            twice[1:] &= owner[1:] == owner[:-1]
            fresh, owner = fresh[~twice], owner[~twice]
            begin, end, hashes = begin[~twice][fresh], end[~twice][fresh], hashes[~twice][fresh]
            bits = max(10, int(len(hashes) * SLOTS).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.windows[n] = (hashes, (np.uint64(64 - bits), seen), begin, end, np.append(np.flatnonzero(fresh), len(owner)), owner)

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """How many words each text has, {text: (hit words, items)} for those with verified hits, and
        where words start and end, which word is each text's first, where texts start."""
        data = ASCII_LOWER[data]
        starts, ends, first = word_spans(data, offsets, WORD_BYTES)
        hashes = span_hashes(data, starts, ends)
        raw = data.tobytes()
        cover = np.zeros(len(hashes) + 1, np.int32)
        found: dict[int, set] = {}
        for n, (known, (shift, seen), begin, end, lists, owners) in self.windows.items():
            if len(hashes) < n:
                continue
            rolled = window_hashes(hashes, n)
            at = np.flatnonzero(seen[rolled >> shift])
            place = np.searchsorted(known, rolled[at])
            hit = known[np.minimum(place, len(known) - 1)] == rolled[at]
            at, place = at[hit], place[hit]
            text = np.searchsorted(first, at, side="right") - 1
            inside = at + n <= first[text + 1]
            for i, p, t in zip(at[inside].tolist(), place[inside].tolist(), text[inside].tolist()):
                words = b" ".join([raw[a:b] for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist())])
                while p < len(known) and known[p] == rolled[i]:
                    if self.raw[begin[p] : end[p]] == words:
                        cover[i] += 1
                        cover[i + n] -= 1
                        found.setdefault(t, set()).update(owners[lists[p] : lists[p + 1]].tolist())
                    p += 1
        covered = np.cumsum(cover) > 0
        hits = {t: (np.flatnonzero(covered[first[t] : first[t + 1]]).tolist(), [self.items[o] for o in owners]) for t, owners in found.items()}
        return np.diff(first), hits, starts, ends, first, offsets


def _window_rows(items: DataFrame, size: int) -> DataFrame:
    """(n, hash, words, item): the windows of all items, PIECE_WINDOWS at a time."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text").to_pylist()):
                words = words_of(text)
                n = min(len(words), size)
                for k in range(0, len(words) - n + 1 if n else 0, PIECE_WINDOWS):
                    windows = list(dict.fromkeys(b" ".join(words[a : a + n]) for a in range(k, min(k + PIECE_WINDOWS, len(words) - n + 1))))
                    raw = np.frombuffer(b" ".join(windows), np.uint8)
                    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), WORD_BYTES)
                    rolled = window_hashes(span_hashes(raw, starts, ends), n)[::n]
                    arrays = [pa.array([n] * len(windows), pa.int32()), pa.array(rolled.view(np.int64)), pa.array(windows, pa.binary()), pa.array([item.as_py()] * len(windows), batch.schema.field("item").type)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["n", "hash", "words", "item"])

    return bounded_batches(items).mapInArrow(run, f"n int, hash long, words binary, item {items.schema['item'].dataType.simpleString()}")


def _filter(windows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of its places, as a power of two, and a bit for each place that a window's hash begins with."""
    bits = max(10, min(FILTER_BITS, int(windows.count() * BITS_EACH).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    word = windows.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return bits, out


def _hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(_hit, words, items): of each text that has hits, by its SHA-256, the words hit and the items."""
    spark = texts.sparkSession
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most `size`
    sent = spark.sparkContext.broadcast(_filter(windows))

    def search(batches):
        bits, table = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                data = ASCII_LOWER[data]
                starts, ends, first = word_spans(data, offsets, WORD_BYTES)
                hashes, raw = span_hashes(data, starts, ends), data.tobytes()
                keys: dict[int, bytes] = {}
                out: dict[tuple, bytes] = {}
                for n in lengths:
                    if len(hashes) < n:
                        continue
                    place = window_hashes(hashes, n) >> np.uint64(64 - bits)
                    at = np.flatnonzero(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    text = np.searchsorted(first, at, side="right") - 1
                    inside = at + n <= first[text + 1]
                    for i, t in zip(at[inside].tolist(), text[inside].tolist()):
                        if t not in keys:
                            keys[t] = hashlib.sha256(part.column("text")[t].as_py().encode()).digest()
                        out[keys[t], i - int(first[t]), n] = b" ".join([raw[a:b] for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist())])
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.binary()), pa.array([k[1] for k in out], pa.int32()), pa.array([k[2] for k in out], pa.int32()), pa.array(list(out.values()), pa.binary())], names=["key", "at", "n", "words"])

    seen = stored(bounded_batches(texts).mapInArrow(search, "key binary, at int, n int, words binary"), "leak-seen")
    sent.destroy()
    known = stored(windows.select(F.col("words").alias("w_words")).distinct(), "leak-known")
    hit = stored(seen.join(sent_if_small(known, SENT_BYTES), F.col("words") == F.col("w_words"), "left_semi").distinct(), "leak-hits")
    covered = hit.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("words"))
    lists = windows.where("item IS NOT NULL").select(F.col("words").alias("w_words"), "item").distinct()
    owners = hit.select("key", "words").distinct().join(lists, F.col("words") == F.col("w_words")).groupBy(F.col("key").alias("o_key")).agg(F.collect_set("item").alias("items"))
    none = F.array().cast(f"array<{windows.schema['item'].dataType.simpleString()}>")
    return stored(covered.join(owners, F.col("key") == F.col("o_key"), "left").select(F.col("key").alias("_hit"), "words", F.coalesce("items", none).alias("items")), "leak-texts")


def _cut(text: str, starts: np.ndarray, ends: np.ndarray, words: list[int]) -> str:
    """The text without the runs of hit words (byte positions)."""
    raw, kept, last = text.encode(), [], 0
    hit = np.array(words)
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    for run in runs:
        kept.append(raw[last : starts[run[0]]])
        last = ends[run[-1]]
    return b"".join([*kept, raw[last:]]).decode()


def _schema(schema, extra: str = "", without: str = "") -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != without), *([extra] if extra else [])])


def _searched(docs: DataFrame, text_at: int, benchmark: DataFrame, item_col: str, item_text_col: str, size: int, block_bytes: int, mode: str) -> DataFrame:
    """docs (columns c0, c1, ...) searched for the windows of the benchmark. mode "report": with n_words,
    words, items and without the text; "documents": rows without hits; "spans": texts without the hit runs."""
    spark, text = docs.sparkSession, f"c{text_at}"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes
    item_type = benchmark.schema[item_col].dataType.simpleString()
    item_arrow = spark.createDataFrame([], f"x array<{item_type}>").toArrow().schema.field(0).type
    found = f"words array<int>, items array<{item_type}>"
    report = _schema(docs.schema, f"n_words long, {found}", text)
    columns = docs.columns
    if small:
        sent = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()], size))

        def run(batches):
            for batch in batches:
                for part in slices(batch, text):
                    n_words, hits, starts, ends, begins, base = sent.value.search(*text_bytes(part.column(text)))
                    if mode == "documents":
                        yield part.filter(pa.array([i not in hits for i in range(len(part))], pa.bool_()))
                        continue
                    arrays = {c: part.column(c) for c in columns}
                    if mode == "spans":
                        texts = arrays[text].to_pylist()
                        for i, (words, _) in hits.items():
                            a, b = begins[i], begins[i + 1]
                            texts[i] = _cut(texts[i], starts[a:b] - base[i], ends[a:b] - base[i], words)
                        arrays[text] = pa.array(texts, arrays[text].type)
                    else:
                        del arrays[text]
                        rows = [hits.get(i, ([], [])) for i in range(len(part))]
                        arrays |= {"n_words": pa.array(n_words), "words": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "items": pa.array([r[1] for r in rows], item_arrow)}
                    yield pa.RecordBatch.from_arrays([*arrays.values()], names=[*arrays])

        return bounded_batches(docs).mapInArrow(run, report if mode == "report" else _schema(docs.schema))

    hits = _hits(docs.select(F.col(text).alias("text")), stored(_window_rows(items, size), "leak-windows"))
    keyed, same = docs.withColumn("_key", F.unhex(F.sha2(text, 256))), F.col("_key") == F.col("_hit")
    if mode == "documents":
        return without_rows(keyed, F.xxhash64("_key"), hits.select("_hit"), F.xxhash64("_hit"), same, SENT_BYTES).drop("_key")

    def counted(batches):
        for batch in batches:
            for part in slices(batch, text):
                _, _, first = word_spans(ASCII_LOWER[(raw := text_bytes(part.column(text)))[0]], raw[1], WORD_BYTES)
                arrays = {c: part.column(c) for c in part.schema.names if c != text} | {"n_words": pa.array(np.diff(first))}
                yield pa.RecordBatch.from_arrays([*arrays.values()], names=[*arrays])

    def without(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                for i, words in enumerate(part.column("words").to_pylist()):
                    if words:
                        data = np.frombuffer(texts[i].encode(), np.uint8)
                        starts, ends, _ = word_spans(ASCII_LOWER[data], np.array([0, len(data)]), WORD_BYTES)
                        texts[i] = _cut(texts[i], starts, ends, words)
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.column(c).type) if c == text else part.column(c) for c in columns], names=columns)

    if mode == "spans":
        found, rest = keyed, None
        if not is_small(hits, SENT_BYTES):  # only texts that a filter lets pass are shuffled
            may = F.coalesce(may_be_in(hits.select(F.xxhash64("_hit").alias("k")), F.xxhash64("_key")), F.lit(False))
            found, rest = keyed.where(may), keyed.where(~may).select(*columns)
        cut = found.join(sent_if_small(hits, SENT_BYTES), same, "left").select(*columns, "words").mapInArrow(without, _schema(docs.schema))
        return cut.unionByName(rest) if rest else cut
    counts = bounded_batches(keyed).mapInArrow(counted, _schema(keyed.schema, "n_words long", text))
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return counts.join(sent_if_small(hits, SENT_BYTES), same, "left").select(*(c for c in columns if c != text), "n_words", none("words"), none("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id, n_words, words (positions of hit words) and items (ids whose
    windows occur).

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is
    `size` consecutive words of an item, or all words of a shorter one. Null and empty texts have no
    words and no hits; items without words have no windows; an item with a null id hits, but isn't
    listed. Repeated rows and repeated items change nothing; without items nothing is hit. Texts are
    read whole.
    """
    source = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    found = _searched(source, 1, benchmark, item_col, item_text_col, size, block_bytes, "report")
    return found.select(F.col("c0").alias(id_col), "n_words", "words", F.array_compact("items").alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, mode: str = "documents", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns as they are, without contaminated documents (mode "documents") or with the
    runs of hit words cut out of their texts (mode "spans"). Cases as in contamination(). """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return _searched(plain, names.index(text_col), benchmark, item_col, item_text_col, size, block_bytes, mode).toDF(*names)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLES = {
    "op2_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
