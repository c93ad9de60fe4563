"""Genes, their regions and the sites that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regions import location, promoter
from .range_join import best_overlaps, overlap_join


def longest_transcripts(transcripts: DataFrame, line: str = "line") -> DataFrame:
    """Of the rows of a transcript on the chromosome that it is on first, the longest; of equals the
    last one."""
    first = Window.partitionBy("transcript").orderBy(line).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longest = Window.partitionBy("transcript").orderBy(F.desc(F.col("end") - F.col("start")), F.desc(line))
    same = transcripts.withColumn("_first", F.first("chrom").over(first)).where("chrom = _first")
    return same.withColumn("_rank", F.row_number().over(longest)).where("_rank = 1").drop("_first", "_rank")


def first_regions(regions: DataFrame, n: int) -> DataFrame:
    """At most n regions of each gene: the longest, then by chromosome, start and transcript."""
    order = Window.partitionBy("gene").orderBy(F.desc(F.col("end") - F.col("start")), "chrom", "start", "transcript")
    return regions.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def named_regions(genes: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions of each asked gene, and one row with nulls for a gene that has none."""
    return genes.select("gene").distinct().join(regions, "gene", "left")


def best_site_of_gene(genes: DataFrame, promoters: DataFrame, sites: DataFrame, rank: Column, columns: list[str]) -> DataFrame:
    """For each gene, `columns` of the site in one of its promoters (closed) that has the largest `rank` (a struct that
    ends in a unique field). Genes on several chromosomes and genes without a site get nulls."""
    one = promoters.groupBy("gene").agg(F.count_distinct("chrom").alias("_n")).where("_n = 1")
    best = F.struct(rank.alias("rank"), F.struct(*columns).alias("site"))
    found = best_overlaps(promoters.join(one, "gene", "left_semi"), sites, best, key="gene")
    return genes.select("gene").distinct().join(found.select("gene", "best.site.*"), "gene", "left")


def local_best(rows: DataFrame, activity: str, tie: str) -> DataFrame:
    """Each gene's row of the highest activity on its own strand, then the smallest `tie`."""
    order = Window.partitionBy("gene").orderBy(F.desc(activity), tie)
    return rows.where("same_strand").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def sites_of_genes(genes: DataFrame, regions: DataFrame, sites: DataFrame, before: int, inside: int | None, *, width: int = 10_000) -> DataFrame:
    """The sites within the promoter region of each asked gene (the whole gene where inside is None),
    with where in the gene they lie."""
    region = promoter(F.col("start"), F.col("end"), F.col("strand"), F.lit(before), F.lit(inside).cast("long"))
    wanted = regions.join(genes.select("gene").distinct(), "gene", "left_semi").select("gene", "chrom", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), region.alias("_r")).select("gene", "chrom", "gene_start", "gene_end", "_r.start", "_r.end")
    within = overlap_join(wanted, sites, kind="contained", width=width, suffix="_site")
    return within.withColumn("location", location(F.col("start_site"), F.col("end_site"), F.col("gene_start"), F.col("gene_end")))


def carried_names(lines: DataFrame, *, part: str, line: str = "line", name: str = "name", given: str = "given", span: int = 1 << 20) -> DataFrame:
    """Fills a missing name with the last one that was given at or before it, by line number within a part.

    A part is cut into pieces of `span` line numbers, each filled by itself; where a piece has none given yet,
    the last of the pieces before it counts."""
    rows = lines.withColumn("_piece", F.floor(F.col(line) / span))
    order = Window.partitionBy(part, "_piece").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.last(given, ignorenulls=True).over(order))
    last = rows.groupBy(F.col(part).alias("_part"), F.col("_piece").alias("_at")).agg(F.max_by(given, F.when(F.col(given).isNotNull(), F.col(line))).alias("_last"))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    joined = rows.join(last, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_piece") == F.col("_at")))
    return joined.withColumn(name, F.coalesce(name, "_here", "_before")).drop("_piece", "_here", "_part", "_at", "_before")
