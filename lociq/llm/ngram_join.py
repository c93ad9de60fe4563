"""N-gram Jaccard join with several global token orders.

The tokens of a document are its distinct word shingles. Two documents whose Jaccard similarity is t
or more share at least one token among the first |x| - ceil(t |x|) + 1 of each (the prefix), whatever
order of all tokens is used, as long as it is the same for both. Pairs must share a prefix token under
each of three orders; the filters are intersected before anything is verified. In all three, tokens
that many documents have come last, by their number, so that a common line or passage makes no
candidates among documents that have other text too.

1. One pass gives each document's set size and set hash; documents with equal sets are one class.
   Tokens that are common within a task are counted, and the commonest become the tail of the orders.
2. A second pass emits each class's prefix under the first order, somewhat longer than it must be:
   (token, class, size). Then two similar sets share several prefix tokens (see needed()), and so a
   class that shares fewer with all others together is out, and each class may leave out its most
   widely shared tokens, as long as two similar ones still share others.
3. A token of two to COLD classes makes candidate pairs of these; pairs are counted. A token of more
   classes is hot: no pairs are emitted for it, its classes are only joined to its smallest one, its
   centre. A token with more than SPLIT classes is dealt to several tasks.
4. Each class is compared with the centre that it shares most hot tokens with. These links make groups:
   families of near copies are one group each after it, in time linear in their size. A centre whose
   classes are all in one group has nothing left to find.
5. Candidate pairs of different groups and the classes of the other centres form cells. A cell larger
   than a task is cut by the other two orders: classes stay together only if shared prefix tokens under
   the second order connect them, and then under the third. Only then each class's set is sent to its
   cell, once. There, pairs of different groups that share enough prefix tokens under every order are
   verified by their full sets. A cell that is too large still is cut into blocks by size and hash, and
   each two blocks that may hold similar sizes are compared in one task of bounded size.
6. Links of different texts become components.

Tokens are 64-bit hashes of shingles; two different shingles of a pair of documents have one hash with a
probability below 2 ** -40 for texts of a million words. Classes are named by 128 bits; candidates are
found by the first 64 of these, which can add candidates but no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, byte_flags, is_small, may_be_in, mix64, read_table, release_memory, sent_if_small, slices, span_hashes, stored, text_bytes, without_rows, word_spans
from .decontaminate import window_hashes
from .graph import components

SHINGLE, PERCENT = 5, 80
#: [^\x20\x09-\x0D]+
WORD_BYTES = 1 - byte_flags([(0x20, 0x20), (0x09, 0x0D)])
ORDERS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1)
#: By how much of its size, in hundredths, a set's prefix under the first order is longer than it must
#: be, and how many of these tokens may be left out. (Two similar sets leave out less than both have
#: more: 3.2 * (n + m) <= 3.2 * 2.25 * min(n, m) < 8 * min(n, m) hundredths.)
LONGER, LEFT_OUT = 8, 3.2
#: Classes of a token that are paired; more are compared in cells.
COLD = 16
#: Tokens whose classes are counted together in a task, and the least count that leaves it.
COUNT_AT_ONCE, LOCAL_COUNT = 2_000_000, 2
#: Rows of one token that are looked at together.
LONG_RUN = 50_000
#: A token of so many classes is common; of them, at most MAX_COMMON commonest are broadcast (16 bytes
#: each). Which tokens are common decides what candidates cost, never which pairs are found.
COMMON, MAX_COMMON = 12, 2_000_000
#: Tokens in a block of a cell; a task compares up to three blocks at once.
BLOCK_TOKENS = 1_000_000
#: Tokens that are compared with one centre in a task; a centre with more stands in several places.
CENTRE_TOKENS = 100_000
#: A band holds sizes from BAND ** k up to BAND ** (k + 1).
BAND = 4
#: Classes of a token that one task looks at; a token that more have, as far as is counted, is dealt to
#: several tasks.
SPLIT = 100_000
#: Bytes of a table that is sent to all tasks; a larger one is joined by a shuffle.
SENT_BYTES = 48 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each text, one array each."""
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD_BYTES)
    words = span_hashes(data, starts, ends)
    rolled = window_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield rolled[:0]


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set: its class."""
    if not len(tokens):
        return 0, 0
    a = mix64(np.array([mix64(tokens + np.uint64(ORDERS[1])).sum() + np.uint64(len(tokens))], np.uint64))[0]
    return int(a.astype(np.int64)), int(mix64(tokens ^ np.uint64(ORDERS[2])).sum().astype(np.int64))


def class_name(key: tuple[int, int]) -> bytes:
    return np.array(key, np.int64).tobytes()


class Orders:
    """Global token orders: common tokens last, by their number of classes; others by a hash."""

    def __init__(self, common: np.ndarray, counts: np.ndarray):
        order = np.argsort(common)
        self.common = common[order]
        self.tasks = np.minimum(counts[order] // SPLIT, 1 << 20).astype(np.int32)  # 0: one task
        self.any_dealt = bool(self.tasks.any())
        rank = np.empty(len(common), np.uint64)
        rank[np.lexsort((common, counts))] = np.arange(len(common), dtype=np.uint64)
        self.rank = rank[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.common >> np.uint64(42)] = True

    def keys(self, tokens: np.ndarray, order: int) -> np.ndarray:
        keys = mix64(tokens ^ np.uint64(ORDERS[order])) >> np.uint64(1)
        maybe = np.flatnonzero(self.seen[tokens >> np.uint64(42)])
        if len(maybe) and len(self.common):
            at = np.minimum(np.searchsorted(self.common, tokens[maybe]), len(self.common) - 1)
            hit = self.common[at] == tokens[maybe]
            maybe, at = maybe[hit], at[hit]
            keys[maybe] = np.uint64(1 << 63) | self.rank[at] << np.uint64(41) | keys[maybe] >> np.uint64(23)
        return keys

    def salts(self, tokens: np.ndarray, name: int) -> np.ndarray:
        """For each token, in which of its tasks a class goes; -1 for a token that has one task only."""
        out = np.full(len(tokens), -1, np.int32)
        if self.any_dealt:
            at = np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)
            tasks = np.where(self.common[at] == tokens, self.tasks[at], 0)
            out[tasks > 0] = name % (tasks[tasks > 0].astype(np.int64) + 1)
        return out

    def prefix(self, tokens: np.ndarray, order: int, percent: int, longer: int = 0) -> np.ndarray:
        """The tokens of which a similar set must have one, and `longer` hundredths of the size more."""
        n = len(tokens)
        length = n - (percent * n + 99) // 100 + 1 + longer * n // 100
        if length >= n:
            return tokens
        return tokens[np.argpartition(self.keys(tokens, order), length - 1)[:length]]


def needed(n, m, percent: int, longer: int = 0):
    """How many prefix tokens two similar sets of n and m tokens share at least, under any order.

    They have o = ceil(t (n + m) / (1 + t)) common tokens or more. Of those, at most ceil(t n) - 1 (less
    what its prefix is longer) lie behind the prefix of the one, and so for the other; those within the
    prefixes come first in both.
    """
    common = -(-percent * (n + m) // (100 + percent))
    inside = lambda k: common + (-percent * k // 100) + 1 + longer * k // 100
    return np.maximum(1, np.minimum(inside(n), inside(m)))


def _first_pass(docs: DataFrame, id_type: str, size: int) -> DataFrame:
    """kind 0: a document's id, text key, set size, first half of the set key (s1) and class name (c);
    kind 1: a token (s1) and how many classes of a task have it (n)."""

    def run(batches):
        seen, pool, pooled = set(), [], 0

        def common():
            tokens = np.concatenate(pool)
            pool.clear()
            tokens.sort()
            tokens, counts = np.unique(tokens[1:][tokens[1:] == tokens[:-1]], return_counts=True)
            counts += 1
            keep = counts >= LOCAL_COUNT
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, id_arrow), pa.nulls(k, pa.int64()), pa.array(counts[keep]), pa.array(tokens[keep].view(np.int64)), pa.nulls(k, pa.binary())], names=names)

        names, id_arrow = ["kind", "id", "key", "n", "s1", "c"], None
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for part in slices(batch, "text"):
                keys, sizes = [], []
                for tokens in shingle_sets(*text_bytes(part.column("text")), size):
                    keys.append(set_key(tokens))
                    sizes.append(len(tokens))
                    if len(tokens) and keys[-1] not in seen:
                        seen.add(keys[-1])
                        pool.append(tokens)
                        pooled += len(tokens)
                if pooled > COUNT_AT_ONCE:
                    yield common()
                    pooled = 0
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), part.column("id"), part.column("key"), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([class_name(k) for k in keys], pa.binary())], names=names)
        if pool:
            yield common()
        release_memory()

    return bounded_batches(docs).mapInArrow(run, f"kind int, id {id_type}, key long, n long, s1 long, c binary")


def _index(docs: DataFrame, orders, size: int, percent: int) -> DataFrame:
    """(token, salt, c, n) of the first order's prefix, once for each class of a task. c is the first half of
    the class's name."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, salts, classes, sizes = [], [], [], []
                for s in shingle_sets(*text_bytes(part.column("text")), size):
                    key = set_key(s)
                    if len(s) and key not in seen:
                        seen.add(key)
                        tokens.append(orders.value.prefix(s, 0, percent, LONGER))
                        salts.append(orders.value.salts(tokens[-1], key[0]))
                        classes.append(key[0])
                        sizes.append(len(s))
                if tokens:
                    times = [len(t) for t in tokens]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.repeat(np.array(classes, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["token", "salt", "c", "n"])

    return docs.select("text").mapInArrow(run, "token long, salt int, c long, n int")


def _whole_runs(batches, names: list[str], key: str, most: int):
    """The columns of sorted batches as numpy arrays, cut so that rows of one key stay together; a run
    of more than `most` rows is cut nevertheless, with its last row held back."""
    kept = None
    for batch in batches:
        columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns)]
        keys = columns[names.index(key)]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if len(keys) - last > most:
            last = len(keys) - 1
        if last:
            yield [x[:last] for x in columns]
        kept = [x[last:] for x in columns]
    if kept is not None:
        yield kept


def _shared_tokens(index: DataFrame) -> DataFrame:
    """Rows sorted by token, salt and class to (token, salt, c, n, classes): without tokens of one class
    only. A token that is dealt to several tasks counts as one of SPLIT classes or more."""
    names = ["token", "salt", "c", "n"]

    def run(batches):
        before = None
        for token, salt, c, n in _whole_runs(batches, names, "token", LONG_RUN):
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
            token, salt, c, n = token[fresh], salt[fresh], c[fresh], n[fresh]
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(begins, len(token)))
            if before == token[0]:  # the rest of a run that was cut
                length[0] += LONG_RUN
            classes = np.repeat(length, np.diff(np.append(begins, len(token)))) + np.where(salt >= 0, SPLIT, 0)
            keep, before = classes > 1, token[-1]
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(salt[keep]), pa.array(c[keep]), pa.array(n[keep].astype(np.int64)), pa.array(classes[keep].astype(np.int64))], names=[*names, "classes"])
        release_memory()

    return index.mapInArrow(run, "token long, salt int, c long, n long, classes long")


def _fewer_tokens(shared: DataFrame, percent: int) -> DataFrame:
    """Without classes that share too few tokens, and without the most widely shared of the others."""
    n = F.col("n")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("classes"), "token"))
    has = F.count("*").over(Window.partitionBy("c"))
    rows = shared.withColumns({"rank": rank, "has": has})
    # What two similar sets share at least if they are as far apart in size as they can be.
    least = 1 + F.floor(n * F.lit(percent) / 100 * LONGER / 100)
    return rows.where((F.col("has") >= least) & (F.col("rank") > F.floor(n * LEFT_OUT / 100))).select("token", "salt", "c", "n")


def _runs(rows: DataFrame, percent: int) -> DataFrame:
    """Rows sorted by token, salt and class. kind 0: candidate pairs (a, b) with how many cold tokens they
    share here (n) and how many they need; kind 1: (a: centre, b: class) with how many hot tokens join them
    here (n); kind 2: the members (a: token, b: class) of tokens that are dealt to several tasks."""

    def run(batches):
        def out(kind, a, b, n, need):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, n, need))], names=["kind", "a", "b", "n", "need"])

        hot = centre = None
        for token, salt, c, n in _whole_runs(batches, ["token", "salt", "c", "n"], "token", LONG_RUN):
            dealt = salt >= 0
            if dealt.any():
                yield out(2, token[dealt], c[dealt], n[dealt], n[dealt])
                token, c, n = token[~dealt], c[~dealt], n[~dealt]
                if not len(token):
                    continue
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(begins, len(token)))
            first = c[begins].copy()
            goes_on = np.zeros(len(begins), bool)
            if hot == token[0]:  # the rest of a run that was cut
                goes_on[0], first[0] = True, centre
            is_hot = (length > COLD) | goes_on
            hot, centre = (token[-1], first[-1]) if is_hot[-1] else (None, None)
            if is_hot.any():
                members = np.repeat(is_hot, length)
                stars = np.stack([np.repeat(first, length)[members], c[members]], 1)
                stars, times = np.unique(stars[stars[:, 0] != stars[:, 1]], axis=0, return_counts=True)
                yield out(1, stars[:, 0], stars[:, 1], times, times)
            found = []
            for k in range(2, COLD + 1):
                at = begins[(length == k) & ~is_hot]
                if len(at):
                    i, j = np.triu_indices(k, 1)
                    x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                    near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                    x, y = x[near], y[near]
                    left_out = np.floor(n[x] * LEFT_OUT / 100) + np.floor(n[y] * LEFT_OUT / 100)
                    need = np.maximum(1, needed(n[x], n[y], percent, LONGER) - left_out.astype(np.int64))
                    found.append(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y]), need], 1))
            if found:
                pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
                yield out(0, pairs[:, 0], pairs[:, 1], times, pairs[:, 2])
        release_memory()

    return rows.mapInArrow(run, "kind int, a long, b long, n long, need long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(c, name, tokens) of the documents with wanted ids: class and set, once for each task."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for s in shingle_sets(*text_bytes(part.column("text")), size):
                    key = set_key(s)
                    if len(s) and key not in seen:
                        seen.add(key)
                        rows.append((key[0], class_name(key), s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["c", "name", "tokens"])

    if is_small(wanted, SENT_BYTES):
        chosen = docs.join(F.broadcast(wanted), docs["id"].eqNullSafe(wanted["w"]), "left_semi")
    else:  # a few sets that nothing asks for come too
        chosen = docs.where(may_be_in(wanted.select(F.xxhash64("w").alias("k")), F.xxhash64("id")))
    return chosen.select("text").mapInArrow(run, "c long, name binary, tokens binary")


class _Postings:
    """Of some sets: which have a token."""

    def __init__(self, sets: list[np.ndarray]):
        lengths = [len(s) for s in sets]
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.n = tokens[order], owner[order], len(sets)

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        a, b = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        n = b - a
        places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[places], minlength=self.n)


def forest_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between rows (name, group, tokens, p0, p1, p2) of two blocks (or one with itself), as a
    spanning forest: a pair that is connected already, or of one group, isn't verified."""
    parent: dict[bytes, bytes] = {x: x for r in [*left, *right] for x in r[:2]}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for name, group, *_ in [*left, *right]:
        parent[root(name)] = root(group)
    links = []
    filters = [_Postings([r[k] for r in right]) for k in (3, 4, 5)]
    full = _Postings([r[2] for r in right])
    sizes = np.array([len(r[2]) for r in right])
    for x in left:
        n = len(x[2])
        maybe = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
        need = needed(sizes, n, percent)
        for k, f in zip((3, 4, 5), filters):
            if maybe.any():
                maybe &= f.shared(x[k]) >= need
        at = [i for i in np.flatnonzero(maybe).tolist() if root(right[i][0]) != root(x[0])]
        if at:
            both = full.shared(x[2])
            for i in at:
                if 100 * both[i] >= percent * (n + sizes[i] - both[i]) and root(right[i][0]) != root(x[0]):
                    parent[root(right[i][0])] = root(x[0])
                    links.append((x[0], right[i][0]))
    return links


def _at_centres(best: DataFrame) -> DataFrame:
    """best: (m, c, n): a class's centre and size. Where each goes, as in _placed(): a centre
    with many classes stands in several places, of about CENTRE_TOKENS each."""
    places = stored(best.groupBy("m").agg(F.ceil(F.sum("n") / CENTRE_TOKENS).cast("int").alias("places")), "ngram-places")
    yes, no = F.lit(True), F.lit(False)
    at = lambda i: F.xxhash64("m", i).alias("place")
    twos = best.join(sent_if_small(places, SENT_BYTES), "m").select(at(F.pmod(F.xxhash64("c"), F.col("places")).cast("int")), "c", no.alias("is_one"), yes.alias("is_two"))
    ones = places.select("m", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i")).select(at(F.col("i")), F.col("m").alias("c"), yes.alias("is_one"), no.alias("is_two"))
    return twos.union(ones)


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """members: (cell, c, n). Where each class goes: (place, c, is_one, is_two); in a place, ones are
    compared with twos."""
    total = members.groupBy("cell").agg(F.sum("n").alias("total"))
    members = members.join(total, "cell")
    yes, no = F.lit(True), F.lit(False)
    small = members.where(F.col("total") <= BLOCK_TOKENS).select(F.xxhash64("cell").alias("place"), "c", yes.alias("is_one"), yes.alias("is_two"))

    # A large cell goes by bands of sizes. Similar sizes are in one band, or the larger is so near to the
    # lower bound of the next band that it is also an addition to the band below (with some margin).
    band = F.floor(F.log("n") / F.log(F.lit(float(BAND)))).cast("int")
    large = members.where(F.col("total") > BLOCK_TOKENS).withColumn("band", band).withColumn("added", no)
    near = F.col("n") <= F.pow(F.lit(float(BAND)), F.col("band")) * (100.1 / percent)
    large = large.union(large.where(near).withColumns({"band": F.col("band") - 1, "added": yes}))
    blocks = lambda added: F.ceil(F.sum(F.when(F.col("added") == F.lit(added), F.col("n")).otherwise(0)) / BLOCK_TOKENS).cast("int")
    counts = large.groupBy("cell", "band").agg(blocks(False).alias("own"), blocks(True).alias("more"))
    large = large.join(counts.where("own > 0"), ["cell", "band"])
    i, j = F.pmod(F.xxhash64("c"), F.col("own")).cast("int"), F.pmod(F.xxhash64("c"), F.greatest("more", F.lit(1))).cast("int")
    at = lambda one, two, is_one, is_two: F.struct(one.alias("i"), two.alias("j"), is_one.alias("is_one"), is_two.alias("is_two"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # Own blocks meet each other at (i, j), i <= j. Additions of one block are twos at each (i, i); more
    # of them stand in blocks of their own at (i, -1 - j).
    own = F.transform(upto(F.col("own")), lambda k: at(F.least(i, k), F.greatest(i, k), i <= k, i >= k))
    own = F.when(F.col("more") > 1, F.concat(own, F.transform(upto(F.col("more")), lambda k: at(i, -1 - k, yes, no)))).otherwise(own)
    added = F.transform(upto(F.col("own")), lambda k: at(k, F.when(F.col("more") > 1, -1 - j).otherwise(k), no, yes))
    large = large.select("cell", "band", "c", F.explode(F.when(F.col("added"), added).otherwise(own)).alias("p"))
    return small.union(large.select(F.xxhash64("cell", "band", "p.i", "p.j").alias("place"), "c", "p.is_one", "p.is_two"))


def _refined(cells: DataFrame, sets: DataFrame, orders, order: int, percent: int) -> DataFrame:
    """cells: (c, cell, n), large ones only. Classes stay in one cell if tokens of their prefixes under an
    order connect them; those that share none with others are in no cell."""

    def prefixes(batches):
        for batch in batches:
            rows = [orders.value.prefix(np.frombuffer(t, np.uint64), order, percent) for t in batch.column("tokens").to_pylist()]
            times = [len(r) for r in rows]
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), times))
            yield pa.RecordBatch.from_arrays([repeat("cell"), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)), repeat("c")], names=["cell", "token", "c"])

    def stars(batches):
        now = None  # cell, token and first class of the last row
        for batch in batches:
            cell, token, c = (batch.column(x).to_numpy() for x in ("cell", "token", "c"))
            if not len(c):
                continue
            begins = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
            first = c[begins].copy()
            if now is not None and now[:2] == (cell[0], token[0]):
                first[0] = now[2]
            now = (cell[-1], token[-1], first[-1])
            edges = np.stack([np.repeat(first, np.diff(np.append(begins, len(c)))), c], 1)
            edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded_batches(sets.join(cells, "c").select("cell", "c", "tokens")).mapInArrow(prefixes, "cell long, token long, c long")
    edges = rows.repartition(partitions, "cell", "token").sortWithinPartitions("cell", "token", "c").mapInArrow(stars, "a long, b long")
    parts = components(edges).select(F.col("node").alias("c"), F.col("component").alias("cell"))
    return stored(cells.select("c", "n").distinct().join(parts, "c").select("c", "cell", "n"), "ngram-cells")


def _cells(near: DataFrame, sizes: DataFrame, sets: DataFrame, orders, percent: int) -> DataFrame:
    """near: candidate edges (a, b). (cell, c, n) of the classes that they connect."""
    parts = components(near).select(F.col("node").alias("c"), F.col("component").alias("cell"))
    now, done = stored(sizes.join(parts, "c").select("c", "cell", "n"), "ngram-cells"), []
    for order in (1, 2):
        total = now.groupBy("cell").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_TOKENS)
        large = stored(total.select("cell"), "ngram-large")
        if large.isEmpty():
            break
        large = sent_if_small(large, SENT_BYTES)
        done.append(now.join(large, "cell", "left_anti").select("c", "cell", "n"))
        now = _refined(now.join(large, "cell", "left_semi").select("c", "cell", "n"), sets, orders, order, percent)
    for part in done:
        now = now.unionByName(part)
    return now


def _links(placed: DataFrame, sets: DataFrame, orders, percent: int) -> DataFrame:
    """placed: (place, c, is_one, is_two); sets: (c, name, grp, tokens). Links (a, b) of ones and twos of a
    place, as spanning forests."""

    def run(batches):
        def compared(side):
            links = forest_links(*side, percent) if side[0] and side[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

        side, now = ([], []), None
        for batch in batches:
            for place, name, group, tokens, one, two in zip(*(batch.column(k).to_pylist() for k in ("place", "name", "grp", "tokens", "is_one", "is_two"))):
                if place != now:
                    yield compared(side)
                    side, now = ([], []), place
                s = np.frombuffer(tokens, np.uint64)
                row = (name, group, s, *(orders.value.prefix(s, k, percent) for k in range(3)))
                for kept, wanted in zip(side, (one, two)):
                    if wanted:
                        kept.append(row)
        yield compared(side)
        side = ([], [])
        release_memory()

    rows = placed.join(sets, "c").select("place", "name", "grp", "tokens", "is_one", "is_two")
    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "place").sortWithinPartitions("place").mapInArrow(run, "a binary, b binary")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: id, key (xxhash64 of the text), n_shingles and component_id, the
    smallest id that links of `percent` / 100 or more lead to, itself included.

    Words are runs of characters other than space, tab, line and page breaks; A-Z is lower-cased. A
    text of fewer than `size` words has one shingle, all its words; a null, empty or blank one has none
    and is linked with nothing, so that its component is its own id. Documents with equal sets are
    linked, repeated rows and ids too. A null id is never the smallest unless a component has no other.
    An empty table gives no rows. Whole texts are read. Other columns are left out.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    id_type = source.schema["id"].dataType.simpleString()
    first = stored(_first_pass(source, id_type, size), "ngram-first")
    light = first.where("kind = 0")

    counted = stored(first.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "ngram-common")
    levels = sorted(((r[0], r[1]) for r in counted.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for level, n in levels:
        if (total := total + n) > MAX_COMMON:
            break
        least = level
    common = counted.where(F.floor(F.log2("n")) >= (least if least is not None else 64)).toArrow()
    orders = spark.sparkContext.broadcast(Orders(common.column("s1").to_numpy().view(np.uint64), common.column("n").to_numpy()))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_token = lambda df: df.repartition(partitions, "token", "salt").sortWithinPartitions("token", "salt", "c")
    shared = stored(_shared_tokens(by_token(_index(source, orders, size, percent))), "ngram-shared")
    runs = stored(_runs(by_token(_fewer_tokens(shared, percent)), percent), "ngram-runs")
    counted_pairs = runs.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    pairs = stored(counted_pairs.where("n >= need").select("a", "b"), "ngram-pairs")
    hot = runs.where("kind = 1").select("a", "b", "n")
    if orders.value.any_dealt:
        dealt = runs.where("kind = 2").select(F.col("a").alias("token"), "b")
        centres = sent_if_small(stored(dealt.groupBy("token").agg(F.min("b").alias("a")), "ngram-centres"), SENT_BYTES)
        hot = hot.union(dealt.join(centres, "token").where("a <> b").select("a", "b", F.lit(1).cast("long")))
    stars = stored(hot.groupBy("a", "b").agg(F.sum("n").alias("n")), "ngram-stars")

    near = pairs.union(stars.select("a", "b"))
    nodes = near.select(F.col("a").alias("s1")).union(near.select("b")).distinct()
    classes = light.where("n > 0").groupBy("c").agg(F.first("s1").alias("s1"), F.min("id").alias("w"), F.first("n").alias("n"))
    members = stored(classes.join(nodes, "s1"), "ngram-members")
    sizes = members.select(F.col("s1").alias("c"), "n")
    sets = stored(_sets(source, members.select("w"), size), "ngram-sets")

    # Each class against the centre that it shares most hot tokens with.
    best = stars.groupBy(F.col("b").alias("c")).agg(F.max_by("a", F.struct("n", "a")).alias("m")).join(sizes, "c")
    links = stored(_links(_at_centres(stored(best, "ngram-best")), sets.withColumn("grp", F.col("name")), orders, percent), "ngram-links")
    if not links.isEmpty():
        found = stored(components(links), "ngram-groups")
        sets = sets.join(sent_if_small(found, SENT_BYTES), F.col("name") == F.col("node"), "left").select("c", "name", F.coalesce("component", "name").alias("grp"), "tokens")
    else:
        sets = sets.withColumn("grp", F.col("name"))
    # What is left: pairs of different groups, and all classes of a centre that has several groups.
    groups = sent_if_small(stored(sets.groupBy("c").agg(F.min("grp").alias("low"), F.max("grp").alias("high")), "ngram-places"), SENT_BYTES)
    of = lambda side: groups.select(F.col("c").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}"))
    several = lambda edges: edges.join(of("a"), "a").join(of("b"), "b").where("low_a <> high_a OR low_b <> high_b OR low_a <> low_b").select("a", "b")
    open_centres = stored(several(stars).select("a").distinct(), "ngram-open")
    rest = stored(several(pairs).union(stars.join(sent_if_small(open_centres, SENT_BYTES), "a", "left_semi").select("a", "b")), "ngram-rest")
    if not rest.isEmpty():
        cells = stored(_cells(rest, sizes, sets, orders, percent).select("cell", "c", "n"), "ngram-placed")
        links = links.union(stored(_links(_placed(cells, percent), sets, orders, percent), "ngram-links"))
    groups = stored(components(links), "ngram-classes")
    named = light.join(sent_if_small(groups.withColumnRenamed("node", "c"), SENT_BYTES), "c", "left").withColumn("g", F.when(F.col("n") > 0, F.coalesce("component", "c")))
    keeper = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("keeper")
    shared = named.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("rows"), F.min("id").alias("least"), keeper).where("rows > 1").drop("rows")
    out = named.join(sent_if_small(stored(shared, "ngram-shared"), SENT_BYTES), "g", "left")
    first_of_all = F.col("keeper.id").eqNullSafe(F.col("id")) & F.col("keeper.key").eqNullSafe(F.col("key"))
    return out.select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), (F.col("keeper").isNull() | first_of_all).alias("keeps"))


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, all columns as they are, with one document of each component: the one with the smallest id
    (and text key). Rows that repeat both id and text stay or go together. Empty texts all stay. Cases
    as in similar_components()."""
    dropped = stored(similar_components(docs, id_col, text_col, size=size, percent=percent).where("NOT keeps").select(F.col(id_col).alias("_drop_id"), F.col("key").alias("_drop_key")).distinct(), "ngram-drop")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    plain = plain.withColumn("_key", F.xxhash64(f"c{names.index(text_col)}"))
    same = [F.col("_key") == F.col("_drop_key"), F.col(f"c{names.index(id_col)}").eqNullSafe(F.col("_drop_id"))]
    return without_rows(plain, F.col("_key"), dropped, F.col("_drop_key"), same, SENT_BYTES).drop("_key").toDF(*names)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
ORACLES = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
}
