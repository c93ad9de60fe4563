"""Conditional counts, ratios and enrichment over the long context table.

Every function makes one pass: conditions become conditional aggregates of one groupBy, which Spark
adds up before it shuffles, so that a motif or chromosome with very many rows is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chromosome_sums(context: DataFrame, where: Column | None = None) -> DataFrame:
    """Per chromosome and motif: rows, sum and mean of num_in_window, of its presence too; with a row
    without chromosome for each motif's totals."""
    rows = context.where(where) if where is not None else context
    n, one = F.col("num_in_window"), (F.col("num_in_window") > 0).cast("int")
    out = rows.rollup("motif", "chrom").agg(F.count("*").alias("n_rows"), F.sum(n).alias("sum_n"), F.avg(n).alias("mean_n"), F.sum(one).alias("n_present"), F.avg(one).alias("mean_present"), F.grouping_id().alias("level"))
    return out.where("level < 3").drop("level")


def gated_sums(context: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Per motif: for each gate the sum of num_in_window and the number of rows that pass."""
    aggs = [a for name, gate in gates.items() for a in (F.sum(F.when(gate, F.col("num_in_window")).otherwise(0)).alias(f"sum_{name}"), F.count_if(gate).alias(f"n_{name}"))]
    return context.groupBy("motif").agg(*aggs)


def gated_ratios(context: DataFrame, gates: dict[str, tuple[Column, str]], bases: dict[str, Column]) -> DataFrame:
    """Per motif: mean num_in_window of the rows of each gate over that of the rows of its base, in one pass;
    gates: name to (condition, name of its base). Null where either has no rows or the base's mean is 0."""
    sums = gated_sums(context, {k: gate for k, (gate, _) in gates.items()} | {f"base_{k}": base for k, base in bases.items()})
    mean = lambda g: F.try_divide(F.col(f"sum_{g}").cast("double"), F.col(f"n_{g}").cast("double"))
    return sums.select("motif", *(F.try_divide(mean(g), mean(f"base_{base}")).alias(f"ratio_{g}") for g, (_, base) in gates.items()))


def exclusive_mean(context: DataFrame, high: Column, high_from: float, low: Column, low_to: float) -> DataFrame:
    """Per motif: mean num_in_window where one signal is high and the other low."""
    return context.groupBy("motif").agg(F.avg(F.when((high >= high_from) & (low <= low_to), F.col("num_in_window"))).alias("mean_n"))


def fractions(sites: DataFrame, by: str, conditions: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Percentages of rows; each condition with its own denominator (None: all rows)."""
    return sites.groupBy(by).agg(*(F.try_divide(100.0 * F.count_if(c if of is None else c & of), (F.count("*") if of is None else F.count_if(of)).cast("double")).alias(name) for name, (c, of) in conditions.items()))


def coverage(intervals: DataFrame) -> DataFrame:
    """Per chromosome: total length, last position, share; and a row without chromosome for all."""
    per = intervals.groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.max("end").alias("last"))
    total = per.agg(F.lit(None).cast("string").alias("chrom"), F.sum("covered").alias("covered"), F.sum("last").alias("last"))
    return per.unionByName(total).withColumn("share", F.try_divide(F.col("covered").cast("double"), F.col("last").cast("double")))


def score_bins(sites: DataFrame, score: str, width: float, shares: dict[str, Column]) -> DataFrame:
    """Per score bin [k * width, (k + 1) * width): count and shares; only bins that end at or below the
    last multiple of the width up to the largest score."""
    top = sites.agg(F.floor(F.max(score) / width)).first()[0] or 0
    bins = sites.where(F.col(score) >= 0).groupBy(F.floor(F.col(score) / width).alias("bin")).agg(F.count("*").alias("n"), *(F.avg(c.cast("int")).alias(k) for k, c in shares.items()))
    return bins.where(F.col("bin") < top)


def inside_outside_ratio(sites: DataFrame, by: str, gate: Column, inside: Column) -> DataFrame:
    """Gated rows inside over all inside, divided by the same outside; a count of 0 counts as 0.1."""
    share = lambda where: F.greatest(F.count_if(gate & where).cast("double"), F.lit(0.1)) / F.nullif(F.count_if(where), F.lit(0))
    return sites.groupBy(by).agg(F.try_divide(share(inside), share(~inside)).alias("ratio"))


def cofactor_counts(context: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Per motif: rows with a hit in the window under each condition."""
    return context.groupBy("motif").agg(*(F.count_if((F.col("num_in_window") > 0) & c).alias(k) for k, c in conditions.items()))


def site_counts(sites: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: sites under each condition, all in one pass."""
    return sites.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def condition_table(sites: DataFrame, elementary: list[Column], wanted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of many combinations of a few elementary conditions (null is false), from one scan of the sites.

    wanted: (name columns, all array<int>, any array<int>): rows that fulfil all conditions of the one list and, if
    the other isn't empty, at least one of it, by their places in `elementary`. Sites are counted by the pattern of the
    conditions that they fulfil, as bits; in the array of these counts, one pass for each bit adds what has the bit to
    what needn't have it. Then each place holds the sites that fulfil at least its bits, and `any` follows by
    inclusion and exclusion over the subsets of its list. Returns `by`, the name columns and n."""
    by, bits = by or [], len(elementary)
    pattern = F.lit(0)
    for i, c in enumerate(elementary):
        pattern = pattern + F.when(c, 1 << i).otherwise(0)
    counts = sites.groupBy(*by, pattern.alias("pattern")).agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "n"))).alias("of"))
    sums = F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda m: F.coalesce(F.try_element_at("of", m), F.lit(0).cast("long")))
    table = counts.select(*by, sums.alias("s0"))
    without = lambda i: lambda v, m: v + F.when(m.bitwiseAND(F.lit(1 << i)) == 0, F.get(f"s{i}", m + (1 << i))).otherwise(0)
    for i in range(bits):
        table = table.select(*by, F.transform(f"s{i}", without(i)).alias(f"s{i + 1}"))
    mask = lambda places: F.aggregate(places, F.lit(0), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), p)))
    # Subsets of `any` as (mask, sign); without any, the empty one alone counts.
    subsets = F.aggregate("any", F.array(F.struct(F.lit(0).alias("mask"), F.lit(-1).alias("sign"))), lambda acc, p: F.concat(acc, F.transform(acc, lambda s: F.struct(s["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1), p)).alias("mask"), (-s["sign"]).alias("sign")))))
    terms = F.when(F.size("any") == 0, F.array(F.struct(F.lit(0).alias("mask"), F.lit(1).alias("sign")))).otherwise(F.filter(subsets, lambda s: s["mask"] != 0))
    names = [c for c in wanted.columns if c not in ("all", "any")]
    asked = wanted.withColumns({"_all": mask(F.col("all")), "_terms": terms}).select(F.collect_list(F.struct(*names, "_all", "_terms"))).scalar()
    full = table.withColumn("_asked", asked).select(*by, f"s{bits}", F.explode("_asked").alias("_a"))
    n = F.aggregate("_a._terms", F.lit(0).cast("long"), lambda total, t: total + t["sign"] * F.get(f"s{bits}", t["mask"].bitwiseOR(F.col("_a._all"))))
    return full.select(*by, *(F.col(f"_a.{c}").alias(c) for c in names), n.alias("n"))


def isoform_table(sites: DataFrame, cell_lines: list[str], *, target: str = "tp73", least: int = 1, in_promoter: str = "in_promoter", by: list[str] | None = None) -> DataFrame:
    """cell_line, isoform (ignored, TA, DN, GFP, any, TAandDN, all), in_promoter (maybe, yes) and n: the sites
    whose signals are at least `least`."""
    isoforms = ("TA", "DN", "GFP")
    elementary = [F.col(f"{target}_{c}_{i}") >= least for c in cell_lines for i in isoforms] + [F.col(in_promoter)]
    rows = []
    for k, c in enumerate(cell_lines):
        ta, dn, gfp = range(3 * k, 3 * k + 3)
        kinds = {"ignored": ([], []), "TA": ([ta], []), "DN": ([dn], []), "GFP": ([gfp], []), "any": ([], [ta, dn, gfp]), "TAandDN": ([ta, dn], []), "all": ([ta, dn, gfp], [])}
        rows += [(c, kind, where, every + ([len(elementary) - 1] if where == "yes" else []), some) for kind, (every, some) in kinds.items() for where in ("maybe", "yes")]
    wanted = sites.sparkSession.createDataFrame(rows, "cell_line string, isoform string, in_promoter string, all array<int>, any array<int>")
    return condition_table(sites, elementary, wanted, by)


def enrichment(context: DataFrame, selected: Column) -> DataFrame:
    """Per motif: share of rows with a hit among the selected, among all, and log2 of their ratio."""
    one = (F.col("num_in_window") > 0).cast("int")
    means = context.groupBy("motif").agg(F.avg(F.when(selected, one)).alias("mean_selected"), F.avg(one).alias("mean_all"))
    return means.withColumn("log_enrichment", F.log2(F.nullif(F.try_divide(F.col("mean_selected"), F.col("mean_all")), F.lit(0.0))))


def compared_enrichment(context: DataFrame, one: Column, other: Column, most: float = 0.5) -> DataFrame:
    """enrichment() of two selections, and log_ratio: log2 of their means' ratio. An error where the mean
    log ratio of all motifs is off by more than `most`: then the selections can't be compared."""
    row = (F.col("num_in_window") > 0).cast("int")
    means = context.groupBy("motif").agg(F.avg(F.when(one, row)).alias("mean_one"), F.avg(F.when(other, row)).alias("mean_other"), F.avg(row).alias("mean_all"))
    log = lambda a, b: F.log2(F.nullif(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    out = means.withColumns({"log_one": log("mean_one", "mean_all"), "log_other": log("mean_other", "mean_all"), "log_ratio": log("mean_one", "mean_other")})
    off = out.agg(F.avg("log_ratio")).first()[0]
    if off is not None and abs(off) > most:
        raise ValueError(f"mean log ratio of all motifs is {off:.3f}")
    return out


def group_means(context: DataFrame, a: Column, b: Column) -> DataFrame:
    """Per motif: mean presence in two groups of rows and the ratio of the means."""
    one = (F.col("num_in_window") > 0).cast("int")
    means = context.groupBy("motif").agg(F.avg(F.when(a, one)).alias("mean_a"), F.avg(F.when(b, one)).alias("mean_b"))
    return means.withColumn("ratio", F.try_divide(F.col("mean_a"), F.col("mean_b")))


def signal_totals(sites: DataFrame, signals: list[str], offset: float = 0.01) -> DataFrame:
    total = F.lit(offset)
    for s in signals:
        total = total + F.col(s)
    return sites.withColumn("signal_total", total)


def shift_histogram(context: DataFrame, by: str, width: int = 2) -> DataFrame:
    """Per group: share of hits in each bin of the shift; rows without a hit are left out."""
    rows = context.where("shift IS NOT NULL").groupBy(by, (F.floor(F.col("shift") / width) * width).alias("bin")).agg(F.count("*").alias("n"))
    totals = rows.groupBy(by).agg(F.sum("n").alias("total"))
    return rows.join(totals, by).select(by, "bin", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))


def coverage_by_distance(rows: DataFrame, most: int = 100) -> DataFrame:
    """rows: (distance, coverage). Per distance: how many rows have a coverage of so much or more
    (coverage capped at `most`), and log2(1 + share of the level's largest count)."""
    from pyspark.sql import Window

    counts = rows.groupBy("distance", F.least("coverage", F.lit(most)).alias("level")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("distance").orderBy(F.desc("level")))
    out = counts.withColumn("at_least", above)
    return out.withColumn("scaled", F.log2(1 + F.col("at_least") / F.max("at_least").over(Window.partitionBy("level"))))
