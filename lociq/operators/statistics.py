"""Exact statistics as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored

#: Pieces that the distinct values of a group are ordered in, where one has more than FEW_VALUES.
SLICES, FEW_VALUES = 64, 200_000
#: Cuts that are looked at together.
CHUNK = 8
#: Columns whose correlations are plain aggregates; with more, sums of products by blocks of columns.
FEW_COLUMNS, BLOCK = 16, 256


def ordered_counts(counts: DataFrame, by: list[str], value: str, *, slices: int = SLICES, few: int = FEW_VALUES) -> DataFrame:
    """counts: (by, value, _n), each value of a group once. Adds _below, the rows of its group with smaller
    values, and _total, those of its group. The counts are stored first, so that the rows are read once.

    A group's values are ordered in one task as long as no group has more than `few`. Otherwise the values of each
    group are cut into slices at its own approximate quantiles; each slice is ordered by itself and starts at the
    count of those below it, so that a group of any size is ordered by many tasks."""
    counts = stored(counts, "counts")
    if (counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= few:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        before = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumns({"_below": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(whole)})
    keys = [f"_k{i}" for i in range(len(by))]
    shares = [i / slices for i in range(1, slices)]
    cuts = counts.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys))).agg((F.percentile_approx(value, shares, 2_000) if shares else F.array()).alias("_cuts"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit((len(shares) - 1) // CHUNK), F.lit(0))), lambda i: F.slice("_cuts", i * CHUNK + 1, F.lit(CHUNK)))
    cuts = cuts.withColumn("_chunks", chunks).withColumn("_tops", F.transform("_chunks", lambda chunk: F.try_element_at(chunk, F.lit(-1)))).drop("_cuts")
    same = lambda: [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)] or [F.lit(True)]
    rows = counts.join(F.broadcast(cuts) if not by else cuts, same()).drop(*keys)
    # How many cuts lie below a value: those before its chunk of cuts, and those in it.
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    rows = rows.withColumn("_chunk", below(F.col("_tops"))).withColumn("_piece", F.col("_chunk") * CHUNK + F.coalesce(below(F.get("_chunks", F.col("_chunk"))), F.lit(0))).drop("_chunks", "_tops", "_chunk")
    pieces = rows.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("_piece").alias("_at")).agg(F.sum("_n").alias("_rows"))
    if not by:
        keys, pieces = ["_all"], pieces.withColumn("_all", F.lit(0))
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    pieces = pieces.withColumns({"_start": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_total": F.sum("_rows").over(whole)}).drop("_rows", "_all")
    inside = Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    rows = rows.join(pieces, [F.col("_piece") == F.col("_at"), *(same() if by else [])])
    return rows.select(*counts.columns, (F.col("_start") + F.col("_inside")).alias("_below"), "_total")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], *, slices: int = SLICES, few: int = FEW_VALUES) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each: q0, q1, ... A group without values has
    none; without groups, there is one row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = ordered_counts(counts, by, "_v", slices=slices, few=few)
    at = [F.lit(q) * (F.col("_total") - 1) for q in shares]
    holds = lambda place: F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_v")))
    aggs = [a for i, p in enumerate(at) for a in (holds(F.floor(p)).alias(f"_l{i}"), holds(F.ceil(p)).alias(f"_h{i}"))]
    out = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *aggs)
    part = lambda i: at[i] - F.floor(at[i])
    return out.select(*by, *((F.col(f"_l{i}") * (1 - part(i)) + F.col(f"_h{i}") * part(i)).alias(f"q{i}") for i in range(len(shares))))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, quartiles, mean, max and standard deviation."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.stddev_samp(value).alias("sd"))
    q = quantiles(rows, by, value, [0.25, 0.5, 0.75]).withColumnsRenamed({b: f"_k{i}" for i, b in enumerate(by)})
    joined = plain.join(q, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], "left")
    return joined.select(*by, "n", "least", F.col("q0").alias("q1"), F.col("q1").alias("median"), "mean", F.col("q2").alias("q3"), "most", "sd")


def pearson(a, b):
    """Correlation over the rows that have both; null where one of them doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's correlation of each two columns over the rows where both are present, as (a, b, n, r);
    columns that don't vary are left out."""
    if len(columns) > FEW_COLUMNS:
        return _block_correlations(rows, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = rows.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), pearson(F.col(a), F.col(b)).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return sums.select(F.explode(F.array(*(f"p{i}" for i in range(len(pairs))))).alias("p")).select("p.*").where("r IS NOT NULL")


def _block_correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """As correlations(), for thousands of columns: each task adds up the products of each two blocks of
    columns as matrices; the sums of a pair of blocks meet in one task. Values are taken less their column's
    mean, so that sums of squares don't cancel."""
    blocks = [columns[i : i + BLOCK] for i in range(0, len(columns), BLOCK)]
    means = rows.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns))).first()
    means = np.array([0.0 if m is None else m for m in means])
    wide = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))

    def sums(batches):
        # Of each two blocks: rows with both, sums of the one and of the other, of their squares, of products.
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1) - means
            has = ~np.isnan(x)
            x, has = np.where(has, x, 0.0), has.astype(float)
            cut = [slice(i * BLOCK, (i + 1) * BLOCK) for i in range(len(blocks))]
            for i, a in enumerate(cut):
                for j, b in enumerate(cut[i:], i):
                    part = np.stack([has[:, a].T @ has[:, b], x[:, a].T @ has[:, b], has[:, a].T @ x[:, b], (x[:, a] ** 2).T @ has[:, b], has[:, a].T @ x[:, b] ** 2, x[:, a].T @ x[:, b]])
                    total[i, j] = total[i, j] + part if (i, j) in total else part
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["i", "j", "sums"])

    def finished(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw).reshape(6, len(blocks[i]), len(blocks[j]))
                total[i, j] = total[i, j] + part if (i, j) in total else part
        for (i, j), (n, sa, sb, saa, sbb, sab) in total.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                va, vb = saa - sa * sa / n, sbb - sb * sb / n
                r = (sab - sa * sb / n) / np.sqrt(va * vb)
            good = np.isfinite(r) & (va > 1e-12 * saa) & (vb > 1e-12 * sbb)
            if i == j:
                good &= np.triu(np.ones_like(good), 1)
            a, b = np.nonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array([blocks[i][k] for k in a], pa.string()), pa.array([blocks[j][k] for k in b], pa.string()), pa.array(n[a, b].astype(np.int64)), pa.array(r[a, b])], names=["a", "b", "n", "r"])

    pairs = len(blocks) * (len(blocks) + 1) // 2
    return wide.mapInArrow(sums, "i int, j int, sums binary").repartition(pairs, "i", "j").mapInArrow(finished, "a string, b string, n long, r double")


def correlation_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """r of the one less r of the other, and scaled by the largest absolute difference."""
    d = one.select("a", "b", F.col("r").alias("r1")).join(two.select("a", "b", F.col("r").alias("r2")), ["a", "b"]).withColumn("difference", F.col("r1") - F.col("r2"))
    return d.withColumn("scaled", F.try_divide("difference", d.select(F.max(F.abs("difference"))).scalar()))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str, *, slices: int = SLICES, few: int = FEW_VALUES) -> DataFrame:
    """The rank of each row's value among those of its group, ties with their average rank; null for null.
    Ranks are made from the counts of distinct values, so that ties don't weigh."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = ordered_counts(counts, by, "_v", slices=slices, few=few).select(*(F.col(b).alias(f"_{b}") for b in by), "_v", _rank().alias(name))
    same = [F.col(value) == F.col("_v"), *(F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by)]
    return rows.join(ranked, same, "left").drop("_v", *(f"_{b}" for b in by))


def _rank():
    return F.col("_below") + (F.col("_n") + 1) / 2


@F.pandas_udf(T.DoubleType())
def student_tails(t: pd.Series, freedom: pd.Series) -> pd.Series:
    """P(|T| > |t|) of Student's distribution, by the continued fraction of the incomplete beta function."""

    def one(t: float, df: float) -> float:
        if not df > 0 or t != t:
            return math.nan
        x = df / (df + t * t)
        a, b = (df / 2, 0.5) if x < (df / 2 + 1) / (df / 2 + 2.5) else (0.5, df / 2)
        y = x if a == df / 2 else 1 - x
        if y <= 0:
            inside = 0.0
        else:
            c, d, h = math.inf, 1.0, 1.0
            for m in range(400):
                for k in ((-(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))) * y, ((m + 1) * (b - m - 1) / ((a + 2 * m + 1) * (a + 2 * m + 2))) * y):
                    d = 1 / (1 + k * d or 1e-300)
                    c = 1 + k / c or 1e-300
                    h *= c * d
                if abs(c * d - 1) < 1e-15:
                    break
            front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(y) + b * math.log1p(-y) if y < 1 else -math.inf
            inside = math.exp(front) / a * h if y < 1 else 1.0
        return inside if a == df / 2 else 1 - inside

    return pd.Series([math.nan if u is None or v is None else one(float(u), float(v)) for u, v in zip(t, freedom)])


def spearman(rows: DataFrame, by: list[str], a: str, b: str, *, slices: int = SLICES, few: int = FEW_VALUES) -> DataFrame:
    """Rank correlation of two columns over rows that have both, per group: n, rho, t and the two-sided p of
    the t approximation (null where a column doesn't vary or there are fewer than three rows). All comes
    from the counts of pairs of values, which are stored first."""
    given = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_pairs"))
    given = pairs = stored(given, "pairs")

    def ranks(value: str) -> DataFrame:
        counts = given.groupBy(*by, value).agg(F.sum("_pairs").alias("_n"))
        return ordered_counts(counts, by, value, slices=slices, few=few).select(*(F.col(x).alias(f"_k{i}") for i, x in enumerate(by)), F.col(value).alias("_x"), (_rank() - (F.col("_total") + 1) / 2).alias(f"{value}_rank"))

    for value in ("_a", "_b"):
        same = [F.col(value) == F.col("_x"), *(F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(by))]
        pairs = pairs.join(ranks(value), same).drop("_x", *(f"_k{i}" for i in range(len(by))))
    x, y, n = F.col("_a_rank"), F.col("_b_rank"), F.col("_pairs")
    out = pairs.groupBy(*by).agg(F.sum("_pairs").alias("n"), F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))).alias("rho"))
    out = out.withColumn("t", F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2.0), F.sqrt(1 - F.col("rho") * F.col("rho"))))
    return out.withColumn("p", F.when(F.col("n") > 2, F.nanvl(student_tails("t", F.col("n") - 2.0), F.lit(None).cast("double"))))


def wilcoxon(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Two-sided rank-sum test of rows with a true `group` against those with a false one, by the normal
    approximation with corrections for ties and continuity: n1, n2, w, z and p."""
    used = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    ranked = average_ranks(used, by, value, "rank")
    ties = used.groupBy(*by, value).count().groupBy(*by).agg(F.sum(F.pow(F.col("count").cast("double"), 3) - F.col("count")).alias("ties"))
    sums = ranked.groupBy(*by).agg(F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n2"), F.sum(F.when(F.col(group), F.col("rank"))).alias("rank_sum"))
    out = sums.join(ties, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    w = F.col("rank_sum") - n1 * (n1 + 1) / 2
    off = w - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - F.try_divide(F.col("ties"), (n1 + n2) * (n1 + n2 - 1))))
    z = F.try_divide(off - F.signum(off) * 0.5, sigma)
    return out.select(*by, "n1", "n2", w.alias("w"), z.alias("z")).withColumn("p", normal_tail(F.abs("z")) * 2)


def normal_tail(z):
    """P(N > z) for z >= 0, by a rational approximation of the error function (error below 1.5e-7)."""
    # The coefficients of that approximation.
    p, a = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    x = z / math.sqrt(2)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return poly * F.exp(-x * x) / 2


def density(rows: DataFrame, by: list[str], value: str, step: float, bandwidth: float) -> DataFrame:
    """Kernel density on a grid: a histogram of the given step, spread by a Gaussian over the 4
    bandwidths on either side."""
    bins = rows.where(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value) / step).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    reach = int(math.ceil(4 * bandwidth / step))
    spread = bins.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    weight = F.exp(-0.5 * F.pow(F.col("d") * step / bandwidth, 2)) / (bandwidth * math.sqrt(2 * math.pi))
    total = bins.groupBy(*by).agg(F.sum("n").alias("total"))
    grid = spread.groupBy(*by, (F.col("cell") + F.col("d")).alias("cell")).agg(F.sum(F.col("n") * weight).alias("mass"))
    joined = grid.join(total, by) if by else grid.withColumn("total", F.lit(bins.agg(F.sum("n")).first()[0]))
    return joined.select(*by, (F.col("cell") * step).alias("x"), (F.col("mass") / F.col("total")).alias("density"))


def bandwidths(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, least, most and bandwidth: Silverman's rule, 0.9 times the smaller of the standard deviation and the
    quartiles' distance / 1.34, over the fifth root of n. If that is 0, the deviation is taken, then the smallest
    value's size, then 1; a group of one value has none."""
    of = summary(rows, by, value)
    spread = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    scale = F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).when(F.col("least") != 0, F.abs("least")).otherwise(1.0)
    return of.select(*by, "n", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"), F.when(F.col("n") > 1, 0.9 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))


def density_grid(rows: DataFrame, by: list[str], value: str, *, points: int = 512, beyond: float = 3.0) -> DataFrame:
    """Kernel density with a bandwidth from the data, at `points` places from `beyond` bandwidths below the smallest
    value to as much above the largest: by, place, x, density. Groups without a bandwidth have none.

    Each value's mass is dealt to the two places beside it by nearness, so that a group becomes `points` masses
    whatever its size; these are convolved with the Gaussian at all distances between places."""
    keys = [f"_k{i}" for i in range(len(by))]
    band = bandwidths(rows, by, value).where("bandwidth IS NOT NULL").withColumnsRenamed(dict(zip(by, keys)))
    low = F.col("least") - beyond * F.col("bandwidth")
    band = band.select(*keys, "n", "bandwidth", low.alias("low"), ((F.col("most") + beyond * F.col("bandwidth") - low) / (points - 1)).alias("step"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)] or [F.lit(True)]
    at = (F.col("_v") - F.col("low")) / F.col("step")
    placed = counts.join(F.broadcast(band), same).withColumn("_i", F.least(F.floor(at), F.lit(points - 2)).cast("int")).withColumn("_w", at - F.col("_i"))
    sides = F.array(F.struct(F.col("_i").alias("i"), (F.col("_n") * (1 - F.col("_w"))).alias("m")), F.struct((F.col("_i") + 1).alias("i"), (F.col("_n") * F.col("_w")).alias("m")))
    masses = placed.select(*keys, "n", "bandwidth", "low", "step", F.explode(sides).alias("_s")).groupBy(*keys, "n", "bandwidth", "low", "step", F.col("_s.i").alias("i")).agg(F.sum("_s.m").alias("m"))
    whole = masses.groupBy(*keys, "n", "bandwidth", "low", "step").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("_of"))  # at most `points`
    places = F.sequence(F.lit(0), F.lit(points - 1))
    whole = whole.withColumn("_m", F.map_entries("_of"))
    kernel = F.transform(places, lambda k: F.exp(-0.5 * F.pow(k * F.col("step") / F.col("bandwidth"), 2)) / (F.col("bandwidth") * math.sqrt(2 * math.pi) * F.col("n")))
    whole = whole.withColumn("_kernel", kernel)
    total = lambda x: F.aggregate("_m", F.lit(0.0), lambda acc, e: acc + e["value"] * F.get("_kernel", F.abs(e["key"] - x)))
    grid = whole.select(*keys, "low", "step", F.posexplode(F.transform(places, total)).alias("place", "density"))
    return grid.select(*(F.col(k).alias(b) for b, k in zip(by, keys)), "place", (F.col("low") + F.col("place") * F.col("step")).alias("x"), "density")
