"""Packing of tokenised documents into sequences, by column generation for the cutting-stock problem.

Documents are tokenised where they are read. What fills whole sequences is cut off first; the rests, shorter
than a sequence, are counted in a histogram of size classes. A linear program chooses how often each pattern (how many
rests of each class share a sequence) is used: its patterns are found one by one, each by a knapsack over the
classes' dual prices, until none is worth more than the sequence it costs. The patterns' counts are rounded,
the rests of each class are ranked (in order of the table), and the rank says which pattern, sequence and
place a rest gets. Histogram and patterns are all that the driver sees.

Sizes are rounded up to classes and counts rounded down, so that sequences have gaps and some rests, the last of each
class, have no place. These rests are laid end to end, the gaps too, and cut where a gap ends: they fill the
gaps, and what is left fills sequences of its own, the last of them powers of two long, which need no padding.
The counts are lowered just so far that these rests suffice. So no padding is left if only there are rests enough.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, release_memory, sent_if_small, slices, stored

SEQUENCE, END = 4096, 2
MODEL = "word_bpe_49k.json"
#: Tokens that sizes are rounded up to.
UNIT = 16
#: Patterns are looked for until the program's value is proven to be as near as this to the best, or for so many steps
#: (a few seconds): what a better solution would place, more rests are cut for then. Steps between fresh inverses.
NEAR, MOST_STEPS, FRESH = 2e-4, 1_500, 256
#: Words whose ids a worker keeps, and their bytes; beyond that it starts again from none.
MAX_WORDS, MAX_WORD_BYTES = 1_000_000, 24 << 20
#: Bytes of tables that are sent to all tasks.
SENT_BYTES = 32 << 20
CHUNK = 1_000_000
#: Where a tokenizer puts texts in lower case, capitals matter only in special strings and before combining marks.
KEEPS_CASE = (b"<|", b"\xcc", b"\xcd")
#: Western letters in lower case, and what may follow them in a word that is still split there.
STOPS = ".,;:!?"
LETTERS = re.compile(f"([a-zß-öø-ÿ]+)([{STOPS}]?)")
SAMPLE = ["word", "Élan", "straße,", "ÿa", "it's", "a.b", "déjà!", "l'été", "x", "the:", "ﬁn", "...", "été?", "naïve;"]
#: Other words that are encoded in one text.
TOGETHER = 500
#: Places in the stream of cut rests that share a bin; as a power of two, rows that are ordered together.
STREAM_BITS, ORDER_BITS = 13, 16


class WordIds:
    """The library's ids of texts whose words, between ASCII white space, don't depend on each other: each
    distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        BYTES = ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = '"Lowercase"' in self.tokenizer.to_str()
        # Words of Western letters go to the merges directly, without the patterns before them, if the tokenizer is of
        # that kind: a run of letters is one word, in lower case, its bytes written as letters.
        whole, self.letters = self.tokenizer.encode_batch_fast(SAMPLE, add_special_tokens=False), {}
        self.stops = {s: self.tokenizer.encode(s, add_special_tokens=False).ids if s else [] for s in ("", *STOPS)}
        self.letters = {c: "".join(x for x, _ in BYTES.pre_tokenize_str(chr(c))) for c in [*range(0x61, 0x7B), *range(0xDF, 0x100)]}
        if not self.lowers or self._ids([w.encode() for w in SAMPLE]) != [e.ids for e in whole]:
            self.letters = {}
        self.reset()

    def reset(self) -> None:
        self.places: dict[bytes, int] = {}
        self.size = self.n_ids = 0
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def _plain(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))]

    def _library(self, words: list[str]) -> list[list[int]]:
        """Many words in one text, with a mark between them that is a token of its own and in none of them."""
        if not words:
            return []
        mark = self.tokenizer.encode("\1", add_special_tokens=False).ids
        if len(mark) != 1 or any("\1" in w for w in words):
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        texts = [" \1 ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        out: list[list[int]] = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array([*e.ids, mark[0]])
            ends = np.flatnonzero(ids == mark[0])
            out += [ids[a:b].tolist() for a, b in zip([0, *(ends[:-1] + 1)], ends)]
        return out

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        for k, word in enumerate(w.decode("utf-8", "replace") for w in words):
            plain = LETTERS.fullmatch(word.lower()) if self.letters else None
            if plain:
                out[k] = self._plain(plain[1]) + self.stops[plain[2]]
            else:
                rest.append((k, word))
        for (k, _), ids in zip(rest, self._library([w for _, w in rest])):
            out[k] = ids
        return out

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            found = self._ids(part)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
            while self.n_ids + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while len(self.places) + len(part) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            n = len(self.places)
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.ends[n + 1 : n + 1 + len(part)] = self.n_ids + np.cumsum(sizes)
            self.n_ids += len(flat)
            self.places.update(zip(part, range(n, n + len(part))))
            self.size += sum(map(len, part))

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """Ids of each text, and `end` behind them."""
        if len(self.places) > MAX_WORDS or self.size > MAX_WORD_BYTES:
            self.reset()
        words: list[bytes] = []
        counts = []
        for text in texts:
            if self.lowers and not any(mark in text for mark in KEEPS_CASE):
                text = text.lower()  # of bytes: A to Z only
            own = text.split()  # of bytes: at ASCII white space only
            counts.append(len(own))
            words += own
        at = np.fromiter(map(self.places.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        if new:
            self._learn(list(dict.fromkeys(new)))
            at[at < 0] = np.fromiter(map(self.places.__getitem__, new), np.int64, len(new))
        sizes = self.ends[at + 1] - self.ends[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.ends[at] - before[:-1], sizes) + np.arange(before[-1])]
        edges = before[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return [np.append(flat[a:b], np.uint32(end)) for a, b in zip(edges, edges[1:])]


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    """A worker's, for all its tasks."""
    return WordIds(path)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, *, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """(uid, id, n, full, full_crcs, rest, rest_crc, rest_ids, cls): a row for each document. n counts all ids,
    full the whole sequences they fill, rest what is left; rest_ids are the ids of the rest."""

    def run(batches):
        known = word_ids(path)
        wide = known.tokenizer.get_vocab_size() > 1 << 16 or end >= 1 << 16
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                ids = known.encode([t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()], end)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                full, rest = n // length, n % length
                crc = lambda a: zlib.crc32(a.astype("<u4").tobytes())
                heads = [[crc(a[i * length : (i + 1) * length]) for i in range(f)] for a, f in zip(ids, full.tolist())]
                tails = [a[f * length :] for a, f in zip(ids, full.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("id"), pa.array(n), pa.array(full), pa.array(heads, pa.list_(pa.int64())), pa.array(rest), pa.array([crc(a) for a in tails], pa.int64()),
                     pa.array([a.astype("<u4" if wide else "<u2").tobytes() for a in tails], pa.binary()), pa.array((-(-rest // UNIT)).astype(np.int32))],
                    names=["uid", "id", "n", "full", "full_crcs", "rest", "rest_crc", "rest_ids", "cls"],
                )
        release_memory()

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = bounded_batches(source).select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    return source.mapInArrow(run, f"uid long, id {source.schema['id'].dataType.simpleString()}, n long, full long, full_crcs array<long>, rest long, rest_crc long, rest_ids binary, cls int")


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest content of a sequence, any number of each size: its price and the number of each."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(sizes, c, "right")
        if n:
            value = best[c - sizes[:n]] + prices[:n]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], choice[c] = value[i], i
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demands: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each, how many of each size) and how often each is used, fractional, such that all demands
    are met with the fewest sequences: a linear program by column generation. sizes ascend."""
    m = len(sizes)
    columns, cost = np.diag((capacity // sizes).astype(float)), np.ones(m)
    inverse, x = np.diag(1 / np.diag(columns)), demands / np.diag(columns)
    for step in range(MOST_STEPS):
        price = np.einsum("i,ij", cost, inverse)  # small: not worth several threads
        if price.min() < -1e-9:  # more than demanded of this size: let the rest go
            new, price_of = np.zeros(m), 0.0
            new[price.argmin()] = -1
        else:
            worth, new = knapsack(sizes, np.maximum(price, 0), capacity)
            # All prices divided by `worth` are valid ones, so that no solution is below this value's part.
            if worth <= 1 + NEAR:
                break
            price_of = 1.0
        d = np.einsum("ij,j", inverse, new)
        ratio = np.full(m, np.inf)
        np.divide(x, d, out=ratio, where=d > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out], cost[out] = new, price_of
        if step % FRESH == FRESH - 1:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
        x = np.maximum(np.einsum("ij,j", inverse, demands), 0)
    used = cost > 0
    return columns.T[used].astype(np.int64), x[used]


@dataclass
class Plan:
    """Patterns, how often each is used, and the first sequence of each."""

    patterns: np.ndarray
    times: np.ndarray
    first: np.ndarray
    classes: np.ndarray  # sizes in units
    placed: np.ndarray  # rests of each class that have a place

    @property
    def sequences(self) -> int:
        return int(self.times.sum())

    def places(self, cls: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a class: ranks from which on a pattern is filled, rests in each of its sequences, first sequence."""
        i = np.searchsorted(self.classes, cls)
        p = np.flatnonzero((self.patterns[:, i] > 0) & (self.times > 0))
        return np.concatenate([[0], np.cumsum(self.patterns[p, i] * self.times[p])]), self.patterns[p, i], self.first[p]


def rounded(patterns: np.ndarray, x: np.ndarray, demands: np.ndarray) -> np.ndarray:
    """Whole numbers of uses that never need more rests than there are: rounded down, and then one more of
    each, the largest fraction first, where rests are left for it."""
    left, times = demands.copy(), np.zeros(len(x), np.int64)

    def use(p: int, most: int) -> None:
        has = patterns[p] > 0
        n = min(most, int((left[has] // patterns[p][has]).min())) if has.any() else 0
        times[p] += n
        left[:] -= n * patterns[p]

    for p in np.argsort(-x, kind="stable"):
        use(p, int(x[p]))
    for p in np.argsort(np.floor(x) - x, kind="stable"):
        if x[p] > np.floor(x[p]):
            use(p, 1)
    return times


def planned(classes: np.ndarray, demands: np.ndarray, tokens: np.ndarray, length: int = SEQUENCE) -> Plan:
    """classes: sizes in units, ascending; demands: rests of each; tokens: their tokens together."""
    if not len(classes):
        return Plan(np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), classes, np.zeros(0, np.int64))
    patterns, x = cutting_stock(classes, demands.astype(float), length // UNIT)
    mean = tokens / demands

    def use(part: float) -> tuple[np.ndarray, np.ndarray, bool]:
        times = rounded(patterns, x * part, demands)
        placed = times @ patterns
        gaps = length * times.sum() - placed @ mean
        return times, placed, (demands - placed) @ mean >= 1.02 * gaps

    low, high = 0.0, 1.0
    best = use(1.0)
    if not best[2]:  # too few rests are left to fill the gaps: use all patterns a little less
        best = use(0.0)
        for _ in range(24):
            middle = (low + high) / 2
            tried = use(middle)
            if tried[2]:
                low, best = middle, tried
            else:
                high = middle
    times, placed, _ = best
    return Plan(patterns, times, np.cumsum(times) - times, classes, placed)


def sums_before(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows before each in its group. Rows are ordered in pieces of 2 **
    ORDER_BITS values of `order` (a long); pieces begin after the sums of those before, so that no group
    meets in one task."""
    rows = rows.withColumn("_piece", F.shiftright(order, ORDER_BITS))
    pieces = rows.groupBy(*(F.col(b).alias(f"_{b}") for b in by), F.col("_piece").alias("_at")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*(f"_{b}" for b in by) or [F.lit(0)]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sent_if_small(stored(pieces.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum"), "pack-sums"), SENT_BYTES)
    inside = Window.partitionBy(*by, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col("_piece") == F.col("_at"), *(F.col(b) == F.col(f"_{b}") for b in by)]
    return rows.join(pieces, same).withColumn(name, F.col("_start") + F.col("_inside")).drop("_piece", "_at", "_start", "_inside", *(f"_{b}" for b in by))


def with_places(rests: DataFrame, plan: Plan) -> DataFrame:
    """rests (with cls and rank) with sequence_id and place, the order within the sequence; both null without a
    place."""
    sent = rests.sparkSession.sparkContext.broadcast({int(c): plan.places(c) for c in plan.classes})

    def run(batches):
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, place, has = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64), np.zeros(len(cls), bool)
            for c in np.unique(cls):
                starts, each, first = sent.value[int(c)]
                own = np.flatnonzero((cls == c) & (rank < starts[-1]))
                if len(own):
                    p = np.searchsorted(starts, rank[own], "right") - 1
                    within = rank[own] - starts[p]
                    sequence[own], place[own], has[own] = first[p] + within // each[p], int(c) * (1 << 32) + within % each[p], True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, mask=~has), pa.array(place, mask=~has)], names=[*batch.schema.names, "sequence_id", "place"])

    return rests.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema) + ", sequence_id long, place long")


def _tail(begin: int, tokens: int, sequence: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence, begin, tokens) of sequences that need no padding: one for each power of two in `tokens`."""
    out = []
    for bit in range(length.bit_length() - 1, -1, -1):
        if tokens >> bit & 1:
            out.append((sequence + len(out), begin, 1 << bit))
            begin += 1 << bit
    return out


def cut_pieces(loose: DataFrame, placed: DataFrame, ids: DataFrame, first_free: int, length: int) -> tuple[DataFrame, int]:
    """The rests without a place, cut into what gaps and sequences of their own take: (uid, start, length,
    sequence_id, offset, ids_crc32), start within the rest. Also the first sequence that is free then."""
    spark = loose.sparkSession
    gaps = placed.groupBy("sequence_id").agg((F.lit(length) - F.sum("rest")).alias("size"), F.sum("rest").alias("filled")).where("size > 0")
    gaps = stored(sums_before(gaps, [], "sequence_id", "size", "begin"), "pack-gaps")
    stream = stored(sums_before(loose.select("uid", "rest"), [], "uid", "rest", "r_begin"), "pack-stream")
    in_gaps, total = (int(t.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]) for t, c in ((gaps, "size"), (stream, "rest")))
    over = max(0, total - in_gaps)
    whole = over // length
    new = spark.range(whole).select((F.col("id") + first_free).alias("sequence_id"), F.lit(length).cast("long").alias("size"), F.lit(0).cast("long").alias("filled"), (F.lit(in_gaps) + F.col("id") * length).alias("begin"))
    last = _tail(in_gaps + whole * length, over - whole * length, first_free + whole, length)
    ends = spark.createDataFrame([(s, n, 0, b) for s, b, n in last], "sequence_id long, size long, filled long, begin long")
    slots = gaps.select("sequence_id", "size", "filled", "begin").unionByName(new).unionByName(ends)
    bins = lambda begin, size: F.explode(F.sequence(F.shiftright(begin, STREAM_BITS), F.shiftright(F.col(begin) + F.col(size) - 1, STREAM_BITS)))
    slots, rests = slots.withColumn("bin", bins("begin", "size")), stream.withColumn("r_bin", bins("r_begin", "rest"))
    begin, end = F.greatest("begin", "r_begin"), F.least(F.col("begin") + F.col("size"), F.col("r_begin") + F.col("rest"))
    met = rests.join(slots, (F.col("bin") == F.col("r_bin")) & (begin < end) & (F.shiftright(begin, STREAM_BITS) == F.col("bin")))
    piece = F.struct((begin - F.col("r_begin")).alias("start"), (end - begin).alias("length"), "sequence_id", (F.col("filled") + begin - F.col("begin")).alias("offset"))
    cut = met.groupBy("uid").agg(F.collect_list(piece).alias("pieces")).withColumnRenamed("uid", "c_uid")  # at most `length` of a rest

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("uid", "start", "length", "sequence_id", "offset", "ids_crc32")}
            for uid, pieces, raw, n in zip(*(batch.column(c).to_pylist() for c in ("uid", "pieces", "rest_ids", "rest"))):
                own = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                for p in pieces:
                    out["uid"].append(uid)
                    for c in ("start", "length", "sequence_id", "offset"):
                        out[c].append(p[c])
                    out["ids_crc32"].append(zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    found = ids.join(sent_if_small(stored(cut, "pack-cuts"), SENT_BYTES), F.col("uid") == F.col("c_uid")).select("uid", "pieces", "rest_ids", "rest")
    return found.mapInArrow(run, "uid long, start long, length long, sequence_id long, offset long, ids_crc32 long"), first_free + whole + len(last)


OUT = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of all documents in sequences of `length` ids: id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset.

    Each document's ids are its text's by the tokenizer at `path` and then `end`; null and empty texts are `end`
    alone. Ids may be null or repeated: each row is a document of its own. A sequence shorter than `length` is
    to be padded, except at a power of two. Equal sizes are ranked in order of the table. Sequence ids are
    unique, from 0 on without gaps. An empty table has no pieces. Texts of any length are read whole; a rest has at
    most length - 1 ids. Other columns are left out.
    """
    table = stored(tokenised(docs, path, id_col, text_col, length=length, end=end), "pack-ids")
    counted = sorted(tuple(r) for r in table.where("rest > 0").groupBy("cls").agg(F.count("*"), F.sum("rest")).collect())  # at most length / UNIT rows
    plan = planned(*(np.array([r[i] for r in counted], np.int64) for i in range(3)), length)
    rests = table.where("rest > 0").select("uid", "id", "n", "full", "rest", "rest_crc", "cls", F.lit(1).alias("one"))
    ranked = sums_before(rests, ["cls"], "uid", "one", "rank").drop("one")
    places = stored(with_places(ranked, plan), "pack-places")
    placed, loose = places.where("sequence_id IS NOT NULL"), places.where("sequence_id IS NULL")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most `length` rows
    whole_rests = placed.select(
        "id", (F.col("full") * length).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("rest").over(before), F.lit(0).cast("long")).alias("offset")
    )
    # The rests without a place are the last of their class, so that a filter finds their ids.
    since = {r[0]: r[1] for r in loose.groupBy("cls").agg(F.min("uid")).collect()}
    bound = F.create_map(*(F.lit(v) for pair in since.items() for v in pair)) if since else F.lit(None).cast("map<int,bigint>")
    ids = table.where("rest > 0").where(F.col("uid") >= F.try_element_at(bound, F.col("cls"))).select("uid", "rest", "rest_ids")
    pieces, free = cut_pieces(loose, placed, ids, plan.sequences, length)
    of = loose.select(F.col("uid").alias("l_uid"), "id", "full", "n")
    cut = pieces.join(of, F.col("uid") == F.col("l_uid")).select("id", (F.col("full") * length + F.col("start")).alias("start"), "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    filled = sums_before(table.where("full > 0").select("uid", "id", "n", "full", "full_crcs"), [], "uid", "full", "filled")
    alone = filled.select("id", "n", "filled", F.posexplode("full_crcs").alias("i", "ids_crc32"))
    alone = alone.select("id", (F.col("i") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.lit(free) + F.col("filled") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole_rests.unionByName(cut).unionByName(alone).select(F.col("id").alias(id_col), *OUT)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
