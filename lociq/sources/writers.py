"""Writers of hits, regions, context tables and reports."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_safe, short_name, six_digits

#: What a context line says of a motif without a hit: no shift, score and strand, and none in the window.
NO_HIT = "\tNA\tNA\tNA\t0"


#: Bases whose rows are written by one task.
STRETCH = 1 << 24


def _stretch(position: str | None) -> list:
    """A further key, so that no task writes a whole motif or chromosome."""
    return [F.floor(F.col(position) / STRETCH)] if position else []


def write_hits(hits: DataFrame, path: str, *, with_match: bool = False) -> None:
    """Tab-separated, scores with three decimals, one folder for each motif and strand, with a file for each
    stretch of a chromosome or several of them."""
    columns = ["chrom", "start", "end", "name", F.format_string("%.3f", "score").alias("score"), "strand", *(["match"] if with_match else [])]
    rows = hits.withColumn("name", F.coalesce("motif_name", "motif_id") if "motif_name" in hits.columns else F.col("motif_id"))
    rows = rows.select(*columns, file_safe(F.col("motif_id")).alias("motif"), F.when(F.col("strand") == "-", "negative").otherwise("positive").alias("side"))
    rows.repartition("motif", "side", "chrom", *_stretch("start")).sortWithinPartitions("motif", "side", "chrom", "start").write.partitionBy("motif", "side").option("sep", "\t").option("header", True).csv(path)


def bed_lines(regions: DataFrame) -> DataFrame:
    """chrom, start, end, gene, 0, strand as one text."""
    return regions.select(F.concat_ws("\t", "chrom", "start", "end", "gene", F.lit("0"), "strand").alias("value"))


def write_bed(regions: DataFrame, path: str) -> None:
    bed_lines(regions).write.text(path)


def write_context_text(rows: DataFrame, path: str) -> None:
    """Tab-separated with NA for null."""
    rows.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def context_header(header: str, motifs: list[str]) -> str:
    """The header line of the sites with the four columns of each motif."""
    return header + "".join(f"\t{short_name(m)}_{c}" for m in motifs for c in ("Shift", "Score", "StrandEqual", "NumInWindow"))


def _in_order(lines: DataFrame, *parts: int) -> DataFrame:
    return lines.repartitionByRange(*parts, "chrom", "start", "site_id").sortWithinPartitions("chrom", "start", "site_id")


def context_lines(lines: DataFrame, context: DataFrame, motifs: list[str], *, ordered: bool = False) -> DataFrame:
    """lines (site_id, chrom, start, line) with `value`: the line as it was, then four fields for each motif in the
    order given, NA and 0 where the site has no row of it. context: the long table of best_hits().

    A site's hits are gathered in one array ordered by the motif's place; the gaps between them are filled with as
    many empty fields, so that thousands of columns are one text and the plan has no column for them. Hits of
    motifs that aren't asked for are left out. If `ordered`, rows are put in the order of write_context_lines() while
    they are still arrays, so that no wide text is shuffled or sorted."""
    places = context.sparkSession.createDataFrame([(m, i) for i, m in enumerate(motifs)], "_motif string, place int")
    fields = F.concat_ws("\t", F.coalesce(F.col("shift").cast("string"), F.lit("NA")), F.coalesce(six_digits(F.col("score")), F.lit("NA")), F.coalesce(F.col("strand_equal").cast("string"), F.lit("NA")), F.col("num_in_window").cast("string"))
    hits = context.join(F.broadcast(places), F.col("motif") == F.col("_motif")).groupBy(F.col("site_id").alias("_site")).agg(F.array_sort(F.collect_list(F.struct("place", fields.alias("fields")))).alias("hits"))
    none = F.lit(NO_HIT)
    last = lambda i: F.when(i > 0, F.get("hits", i - 1)["place"]).otherwise(-1)
    parts = F.transform("hits", lambda hit, i: F.concat(F.repeat(none, hit["place"] - last(i) - 1), F.lit("\t"), hit["fields"]))
    after = F.lit(len(motifs) - 1) - F.coalesce(F.try_element_at("hits", F.lit(-1))["place"], F.lit(-1))
    value = F.concat("line", F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ""), F.repeat(none, after))
    gathered = lines.join(hits, F.col("site_id") == F.col("_site"), "left").select(*lines.columns, "hits")
    parts = 4 * lines.sparkSession.sparkContext.defaultParallelism  # a fixed number: arrays are few bytes, their texts many
    return (_in_order(gathered, parts) if ordered else gathered).select(*lines.columns, value.alias("value"))


def write_context_lines(lines: DataFrame, path: str, header: str | None = None, *, compression: str = "gzip", ordered: bool = False) -> None:
    """The values of context_lines(), ordered by chromosome (as text), start and site, unless they are `ordered`. The
    files, one after the other by name, are one file with one header."""
    rows = (lines if ordered else _in_order(lines)).select("value")
    if header is not None:
        rows = lines.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value")).union(rows)
    rows.write.option("compression", compression).text(path)


def write_context(rows: DataFrame, path: str, by: str = "chrom") -> None:
    rows.write.partitionBy(by).parquet(path)


def write_report(rows: DataFrame, path: str, *, decimal_comma: bool = False) -> None:
    """A tidy table as text."""
    if decimal_comma:
        rows = rows.withColumns({c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",") for c, t in rows.dtypes if t in ("double", "float")})
    rows.write.option("sep", "\t").option("header", True).csv(path)


def write_by_chromosome(rows: DataFrame, path: str, chrom: str = "Chr", position: str | None = "start") -> None:
    """One folder for each chromosome, written in stretches where there is a position."""
    position = position if position in rows.columns else None
    rows.repartition(chrom, *_stretch(position)).write.partitionBy(chrom).option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def merged_strands(plus: DataFrame, minus: DataFrame) -> DataFrame:
    """Both strands' hits, sorted by chromosome (as text) and start within range partitions."""
    both = plus.unionByName(minus)
    return both.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not there yet."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def fingerprint(df: DataFrame) -> str:
    """Of what a table is made of: its plan (without the numbers of this session's columns; bodies of Python functions
    aren't in it) and the path, size and time of each file that it reads."""
    spark = df.sparkSession
    plan = re.sub(r"#\d+L?|\[?plan_id=\d+\]?", "", df._jdf.queryExecution().analyzed().toString())
    files, conf = [], spark._jsparkSession.sessionState().newHadoopConf()
    for name in sorted(df.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = where.getFileSystem(conf).getFileStatus(where)
        files.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([plan, *files]).encode()).hexdigest()[:32]


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored table, made and written only if it isn't there for these inputs and this plan.

    It is written to a new folder and put in place by one rename that never replaces anything: of two writers at once
    the first wins and the other takes its result; a failed writer leaves nothing in place. What was stored for other
    inputs stays beside it."""
    df = make()
    mark = fingerprint(df)
    target = f"{path}/{mark}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    where, conf = hadoop.Path(target), spark._jsparkSession.sessionState().newHadoopConf()
    files = where.getFileSystem(conf)
    if not files.exists(where):
        own = hadoop.Path(f"{path}/.{mark}-{uuid.uuid4().hex}")
        df.write.parquet(own.toString())
        try:
            hadoop.FileContext.getFileContext(where.toUri(), conf).rename(own, where, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError:
            files.delete(own, True)
            if not files.exists(where):
                raise
    return spark.read.schema(df.schema).parquet(target)
