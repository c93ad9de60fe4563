"""Correlations of thousands of motifs from the long context table, and their order by clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Motifs in a block, and shares that the sites of a pair of blocks are dealt into.
BLOCK, SHARES = 256, 16
#: Sites that are multiplied at once.
ROWS = 2_048


def _sums(batches, size: int):
    """Adds up, for each pair of blocks in turn, the products of the values that a site has in the one and in the
    other. Rows come ordered by pair, so that one matrix is held at a time."""
    now, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "sums"])

    def dense(batch, places, values):
        """The sites of a batch as rows of a matrix."""
        offsets, k, v = batch.column(places).offsets.to_numpy(), batch.column(places).flatten().to_numpy(), batch.column(values).flatten().to_numpy()
        x = np.zeros((len(batch), size))
        x[np.repeat(np.arange(len(batch)), np.diff(offsets)), k] = v
        return x

    for batch in batches:
        i, j = (batch.column(c).to_numpy() for c in ("i", "j"))
        cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(batch)]) if len(batch) else []:
            if (int(i[low]), int(j[low])) != now:
                if now:
                    yield out()
                now, total = (int(i[low]), int(j[low])), np.zeros((size, size))
            for at in range(low, high, ROWS):
                # Copied, so that offsets begin at 0; the row of a pair without sites has nulls.
                some = pa.Table.from_batches([batch.slice(at, min(ROWS, high - at))])
                some = some.filter(some["a"].is_valid()).combine_chunks()
                for part in some.to_batches():
                    total += dense(part, "a", "av").T @ dense(part, "b", "bv")
    if now:
        yield out()


def sparse_correlations(context: DataFrame, sites: int, *, site: str = "site_id", motif: str = "motif", value: str = "num_in_window") -> DataFrame:
    """Pearson's correlation of each two motifs over all `sites`, where a site has 0 of a motif without a row, as
    (a, b, n, r) with a before b; motifs that don't vary are left out. Several rows of a site and motif are added up.

    Only what is there is read: a site's values meet for each two blocks of motifs, in SHARES tasks for a pair, and
    are multiplied as matrices. Zeros are in the sums of each motif. The driver holds two sums for each motif."""
    spark = context.sparkSession
    values = stored(context.groupBy(F.col(site).alias("s"), F.col(motif).alias("m")).agg(F.sum(F.col(value).cast("double")).alias("v")).where("v <> 0 AND s IS NOT NULL AND m IS NOT NULL"), "cofactor-values")
    sums = {r["m"]: (r["x"], r["xx"]) for r in values.groupBy("m").agg(F.sum("v").alias("x"), F.sum(F.col("v") * F.col("v")).alias("xx")).collect()}
    names = sorted(m for m, (x, xx) in sums.items() if sites * xx - x * x > 1e-12 * sites * xx)
    blocks = -(-len(names) // BLOCK)
    out = "a string, b string, n long, r double"
    if len(names) < 2:
        return spark.createDataFrame([], out)
    x, xx = (np.array([sums[m][k] for m in names]) for k in (0, 1))
    places = spark.createDataFrame([(m, k // BLOCK, k % BLOCK) for k, m in enumerate(names)], "m string, block int, k int")
    mine = values.join(F.broadcast(places), "m").groupBy("s", "block").agg(F.collect_list(F.struct("k", "v")).alias("e"))
    of = mine.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("block", "e"))).alias("of"))  # at most one value for each motif
    first = of.select(F.col("s"), "of", F.explode(F.map_keys("of")).alias("i"))
    pair = first.select("s", "i", F.explode(F.filter(F.map_keys("of"), lambda b: b >= F.col("i"))).alias("j"), "of")
    part = lambda c, field: F.transform(F.element_at("of", F.col(c)), lambda e: e[field])
    rows = pair.select("i", "j", F.pmod(F.xxhash64("s"), F.lit(SHARES)).alias("share"), part("i", "k").alias("a"), part("i", "v").alias("av"), part("j", "k").alias("b"), part("j", "v").alias("bv"))
    # A row for each pair of blocks, so that those which no site has together have their zeros too.
    empty = spark.range(blocks).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))).alias("j"))
    empty = empty.select("i", "j", F.lit(0).cast("long").alias("share"), *(F.lit(None).cast(t).alias(c) for c, t in (("a", "array<int>"), ("av", "array<double>"), ("b", "array<int>"), ("bv", "array<double>"))))
    dealt = rows.unionByName(empty)
    if blocks > 1:  # else there is one pair: each task adds up what it has
        dealt = dealt.repartition("i", "j", "share").sortWithinPartitions("i", "j")
    size = min(BLOCK, len(names))
    parts = dealt.select("i", "j", "a", "av", "b", "bv").mapInArrow(lambda batches: _sums(batches, size), "i int, j int, sums binary")

    def finished(batches):
        now, total = None, None

        def out():
            i, j = now
            a, b = slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
            products = total[: len(x[a]), : len(x[b])]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = (sites * products - np.outer(x[a], x[b])) / np.sqrt(np.outer(sites * xx[a] - x[a] ** 2, sites * xx[b] - x[b] ** 2))
            p, q = np.nonzero(np.triu(np.ones_like(r), 1) if i == j else np.ones_like(r))
            return pa.RecordBatch.from_arrays([pa.array([names[a][k] for k in p], pa.string()), pa.array([names[b][k] for k in q], pa.string()), pa.array(np.full(len(p), sites, np.int64)), pa.array(r[p, q])], names=["a", "b", "n", "r"])

        for batch in batches:
            for i, j, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, j) != now:
                    if now:
                        yield out()
                    now, total = (i, j), np.zeros((size, size))
                total = total + np.frombuffer(raw).reshape(size, size)
        if now:
            yield out()

    return parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(finished, out)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """edges: (a, b, d). The edges of a minimum spanning forest, by Boruvka's rounds: each tree takes the shortest edge
    that leaves it (of equal ones the first by a and b), and trees that are joined are renamed by pointer jumping.
    The number of trees at least halves in a round."""
    edges = stored(edges.where("a <> b AND d IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"), "forest-edges")
    between = edges.select("a", "b", "d", F.col("a").alias("ta"), F.col("b").alias("tb"))
    taken = edges.where("false")
    while True:
        leaving = between.select(F.col("ta").alias("t"), F.col("tb").alias("to"), "d", "a", "b").union(between.select("tb", "ta", "d", "a", "b"))
        best = leaving.groupBy("t").agg(F.min(F.struct("d", "a", "b", "to")).alias("e"))
        best = stored(best.select("t", "e.*"), "forest-best")
        if best.isEmpty():
            return taken
        taken = stored(taken.unionByName(best.select("a", "b", "d")).distinct(), "forest-taken")
        # Each tree points where its edge leads; of two that point at each other the smaller is the root.
        back = best.select(F.col("t").alias("to"), F.col("to").alias("t"), F.lit(True).alias("mutual"))
        point = best.join(back, ["t", "to"], "left").select("t", F.when(F.col("mutual") & (F.col("t") < F.col("to")), F.col("t")).otherwise(F.col("to")).alias("r"))
        point = stored(point, "forest-trees")
        while True:
            on = point.select(F.col("t").alias("r"), F.col("r").alias("next"))
            moved = stored(point.join(on, "r").select("t", F.col("r").alias("before"), F.col("next").alias("r")), "forest-trees")
            point = moved.select("t", "r")
            if moved.where("before <> r").isEmpty():
                break
        name = lambda side: point.select(F.col("t").alias(side), F.col("r").alias(f"new_{side}"))
        between = between.join(name("ta"), "ta").join(name("tb"), "tb").where("new_ta <> new_tb").select("a", "b", "d", F.col("new_ta").alias("ta"), F.col("new_tb").alias("tb"))
        between = stored(between, "forest-between")


def clustering(correlations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single-linkage clustering of what correlations (a, b, r) join, at distance 1 - r: its merges (step, height, left,
    right, size), left and right named by their smallest member, and the leaves (place, name) in the order of its tree,
    in which each merge stands side by side, the cluster with the smaller name first.

    Merges are the edges of the minimum spanning forest by length; one for each motif, which the driver walks. Trees that
    aren't connected follow each other by name."""
    spark = correlations.sparkSession
    found = sorted(((r["d"], r["a"], r["b"]) for r in spanning_forest(correlations.select("a", "b", (1 - F.col("r")).alias("d"))).collect()))
    leaves = [r[0] for r in correlations.select(F.explode(F.array("a", "b")).alias("x")).distinct().orderBy("x").collect()]
    head, order, merges = {x: x for x in leaves}, {x: [x] for x in leaves}, []

    def of(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for step, (d, a, b) in enumerate(found, 1):
        left, right = sorted((of(a), of(b)))
        head[right] = left
        order[left] += order.pop(right)
        merges.append((step, float(d), left, right, len(order[left])))
    placed = [(i, x) for i, x in enumerate(x for k in sorted(order) for x in order[k])]
    return spark.createDataFrame(merges, "step int, height double, left string, right string, size int"), spark.createDataFrame(placed, "place int, name string")
