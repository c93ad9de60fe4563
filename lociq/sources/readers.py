"""Readers of the text formats of the field. Compressed files are read by their extension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, gene_list, trim_blank, whole_number
from ..operators.genes import carried_names
from ..schema import SIGNAL, SIGNALS, SITE


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): line numbers follow the order in each file, and have gaps."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line"), F.rtrim(F.col("value"), F.lit("\r\n")).alias("value"))
    return lines


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Six columns, separated by tabs or blanks; header lines (Chr..., #...) anywhere are skipped, and
    so are lines without a start and an end. Score stays a double, strand a text. A last line without
    a line end counts."""
    parts = F.split(trim_blank(F.col("value")), r"\s+")
    get = lambda i: F.get(parts, F.lit(i))
    rows = read_lines(spark, path).where(~F.col("value").rlike("^(Chr|#)")).select("path", get(0).alias("chrom"), get(1).try_cast("long").alias("start"), get(2).try_cast("long").alias("end"), get(3).alias("name"), get(4).try_cast("double").alias("score"), get(5).alias("strand"))
    return rows.where("start IS NOT NULL AND end IS NOT NULL").select("path", *SITE.names)


def read_bed_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_bed() of one file, with site_id (in order of the file, with gaps) and the line as it is."""
    lines = read_lines(spark, path).where(~F.col("value").rlike("^(Chr|#)"))
    field = F.split(F.col("value"), r"\s+")
    rows = lines.select(F.col("line").alias("site_id"), F.get(field, 0).alias("chrom"), *(F.expr(f"try_cast(get(split(value, '\\\\s+'), {i}) AS {t})").alias(c) for i, c, t in ((1, "start", "bigint"), (2, "end", "bigint"))), F.get(field, 3).alias("name"), F.expr("try_cast(get(split(value, '\\\\s+'), 4) AS double)").alias("score"), F.get(field, 5).alias("strand"), F.col("value").alias("line"))
    return rows.where("start IS NOT NULL AND end IS NOT NULL AND score IS NOT NULL AND strand IS NOT NULL")


def read_numbered_lines(spark: SparkSession, path: str, *, together: bool = False) -> DataFrame:
    """(path, line_no, value) with line numbers from 1 in each file, counted by many tasks: each block of a
    file numbers its own lines, and begins after those of the blocks before it. together: the files of a folder,
    in order of their names, are the parts of one file, and path is the folder."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches):
        where, n = None, 0
        for batch in batches:
            numbers = []
            for place in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                where, n = (where, n + 1) if place == where else (place, 1)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["path", "block", "value", "n"])

    rows = lines.mapInArrow(run, "path string, block long, value string, n long")
    whole = F.regexp_replace("path", "/[^/]*$", "") if together else F.col("path")
    before = Window.partitionBy(whole).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("path", "block").agg(F.count("*").alias("rows")).select("path", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["path", "block"]).select(whole.alias("path"), (F.col("start") + F.col("n")).alias("line_no"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def first_and_last(lines: DataFrame, n: int) -> DataFrame:
    """The first n and the last n lines of each file, marked head and tail; a line may be both."""
    total = lines.groupBy("path").agg(F.max("line_no").alias("_lines"))
    rows = lines.join(total, "path")
    ends = F.array_compact(F.array(F.when(F.col("line_no") <= n, "head"), F.when(F.col("line_no") > F.col("_lines") - n, "tail")))
    return rows.select("path", "line_no", "value", F.explode(ends).alias("part"))


def file_name(path: Column) -> Column:
    """The name of a file or, for files that Spark has written, of the folder that they are in."""
    parts = F.split(path, "/")
    own = F.element_at(parts, -1)
    return F.when(own.startswith("part-"), F.element_at(parts, -2)).otherwise(own)


def read_bed_sets(spark: SparkSession, pattern: str) -> DataFrame:
    """All BED files of a pattern, with set_name: the file's name, or that of the folder of its parts."""
    return read_bed(spark, pattern).withColumn("set_name", file_name(F.col("path"))).drop("path")


def read_wide_bed(spark: SparkSession, pattern: str) -> DataFrame:
    """BED files with more than six columns and set_name; further columns are told by the name: twelve
    sorted signals (doubles) after `cutandrun`, then a whole num.tfbs after `tp73bs`, and texts V7, V8, ...
    for the rest. All files of the pattern have the same kind of name."""
    sample = spark.read.text(pattern).select(file_name(F.col("_metadata.file_path")).alias("set_name"), F.size(F.split("value", "\t")).alias("n")).where("n >= 6")
    name, width = sample.agg(F.max("set_name"), F.max("n")).first()
    kinds = ([(s, "double") for s in SIGNALS] if "cutandrun" in (name or "") else []) + ([("num_tfbs", "int")] if "tp73bs" in (name or "") else [])
    kinds += [(f"V{7 + i}", "string") for i in range(len(kinds), max(0, (width or 6) - 6))]
    parts = F.split("value", "\t")
    rows = spark.read.text(pattern).where(~F.col("value").rlike("^(Chr|#)")).select("*", file_name(F.col("_metadata.file_path")).alias("set_name"))
    get = lambda i, kind: F.get(parts, F.lit(i)).try_cast(kind)
    columns = [get(i, f.dataType.simpleString()).alias(f.name) for i, f in enumerate(SITE)] + [get(6 + i, kind).alias(c) for i, (c, kind) in enumerate(kinds)]
    return rows.select("set_name", *columns).where("start IS NOT NULL AND end IS NOT NULL")


def read_motif_hits(spark: SparkSession, directory: str, motif: str, chrom: str) -> DataFrame:
    """The one file (or folder of parts) <motif>_*bidirect_<chrom>.bed.gz; an error unless there is exactly one."""
    rows = read_bed(spark, f"{directory}/{motif}_*bidirect_{chrom}.bed.gz")
    n = rows.select(file_name(F.col("path"))).distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} file of {motif} for {chrom}")
    return rows.drop("path")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of chromosome, from, to, name; blank lines, a header and malformed lines are skipped."""
    parts = F.split(trim_blank(F.col("value")), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("start"), F.get(parts, F.lit(2)).try_cast("long").alias("end"), F.get(parts, F.lit(3)).alias("name"))
    return rows.where("start IS NOT NULL AND end IS NOT NULL AND name IS NOT NULL")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): the id runs to the first blank; lines are trimmed and joined. Of an id that comes
    twice in a file the later sequence counts. A record is a row and is read by one task: for chromosomes,
    use read_fasta_chunks()."""
    records = spark.read.option("lineSep", ">").text(path).select(F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^(\S*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    rows = records.select("line", head.alias("chrom"), body.alias("seq"))
    return rows.groupBy("chrom").agg(F.max_by("seq", "line").alias("seq"))


def _fasta_parts(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Runs of sequence lines, each of about `size` letters, read by many tasks: (path, block, rec, name,
    at, seq). rec counts the headers in a block of the file, 0 for what comes before its first; at is where
    the run begins among the letters of its record in this block. A header makes a run without letters."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches):
        names = ["path", "block", "rec", "name", "at", "seq"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        where, rec, name, at, held, n, done = None, 0, None, 0, [], 0, []

        def flush():
            nonlocal at, held, n
            if n:
                done.append((*where, rec, name, at, "".join(held)))
            at, held, n = at + n, [], 0

        for batch in batches:
            for path, block, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value"))):
                if (path, block) != where:
                    flush()
                    where, rec, name, at = (path, block), 0, None, 0
                if value.startswith(">"):
                    flush()
                    rec, name, at = rec + 1, (value[1:].split() or [""])[0], 0
                    done.append((*where, rec, name, 0, ""))
                else:
                    held.append("".join(value.split()))
                    n += len(held[-1])
                    if n >= size:
                        flush()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
                done = []
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

    return lines.mapInArrow(run, "path string, block long, rec int, name string, at long, seq string")


def read_fasta_chunks(spark: SparkSession, path: str, *, size: int = 1 << 18, overlap: int = 0) -> DataFrame:
    """(chrom, chunk_start, own, seq): sequences in pieces of `size` letters from 0-based chunk_start, each
    followed by `overlap` letters of the next one; the first `own` letters are the piece's own.

    A file is read in blocks by many tasks, however long its records are. What a block's first lines belong
    to, and how many letters of it came before, follows from the sums of the blocks before it. Of an id
    that comes twice the last record counts; lines before a header are left out."""
    parts = _fasta_parts(spark, path, size)
    by_record = parts.groupBy("path", "block", "rec").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("letters"))
    last = by_record.groupBy("path", "block").agg(F.max("rec").alias("rec"), F.max_by("name", "rec").alias("name"), F.max_by("letters", "rec").alias("letters"))
    order = Window.partitionBy("path").orderBy("block")
    last = last.withColumn("part", F.sum((F.col("rec") > 0).cast("int")).over(order))
    within = Window.partitionBy("path", "part").orderBy("block")
    told = last.withColumns({"so_far": F.sum("letters").over(within), "name": F.first("name").over(within), "head": F.first(F.struct("block", "rec")).over(within)})
    carried = told.select("path", "block", *(F.lag(c).over(order).alias(f"_{c}") for c in ("name", "so_far", "head")))
    mine = F.col("rec") > 0
    rows = parts.join(carried, ["path", "block"]).select(
        "path",
        F.when(mine, F.struct("block", "rec")).otherwise(F.col("_head")).alias("head"),
        F.when(mine, F.col("name")).otherwise(F.col("_name")).alias("chrom"),
        F.when(mine, F.col("at")).otherwise(F.col("at") + F.col("_so_far")).alias("at"),
        "seq",
    ).where("chrom IS NOT NULL")
    record = F.struct("path", "head")
    final = rows.where("seq = ''").groupBy(F.col("chrom").alias("_chrom")).agg(F.max(record).alias("_record"))
    rows = rows.where("seq <> ''").join(final, (F.col("chrom") == F.col("_chrom")) & (record == F.col("_record")), "left_semi")
    end = F.col("at") + F.length("seq")
    chunks = F.sequence(F.greatest(F.floor((F.col("at") - overlap) / size), F.lit(0)), F.floor((end - 1) / size))
    rows = rows.select("chrom", "at", "seq", F.explode(chunks).alias("k"))
    begin = F.greatest(F.col("at"), F.col("k") * size)
    stop = F.least(F.col("at") + F.length("seq"), (F.col("k") + 1) * size + overlap)
    rows = rows.select("chrom", "k", begin.alias("begin"), F.substring("seq", (begin - F.col("at") + 1).cast("int"), (stop - begin).cast("int")).alias("seq"))
    whole = rows.where("seq <> ''").groupBy("chrom", "k").agg(F.array_sort(F.collect_list(F.struct("begin", "seq"))).alias("runs"))
    return whole.select("chrom", (F.col("k") * size).alias("chunk_start"), F.array_join("runs.seq", "").alias("seq")).withColumn("own", F.least(F.length("seq"), F.lit(size)).cast("long"))


def read_motifs(spark: SparkSession, path: str, motif_id: str | None = None) -> DataFrame:
    """(motif_id, motif_name, pos, base, value) from >ID NAME records with a row for each base. The last
    record of an id counts; a last row without a line end does too."""
    records = spark.read.option("lineSep", ">").text(path).select(F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    head = F.split(F.trim(F.regexp_extract("value", r"^([^\n]*)", 1)), r"\s+")
    rows = records.select("line", head[0].alias("motif_id"), F.get(head, F.lit(1)).alias("motif_name"), F.explode(F.split("value", "\n")).alias("row")).where(F.col("row").rlike(r"^\s*[ACGTacgt]\s+\[?\s*[-0-9.]"))
    if motif_id is not None:
        rows = rows.where(F.col("motif_id") == motif_id)
    last = Window.partitionBy("motif_id")
    rows = rows.withColumn("_last", F.max("line").over(last)).where("line = _last")
    values = F.transform(F.filter(F.split(F.regexp_replace(F.regexp_replace("row", r"^\s*[A-Za-z]", ""), r"[\[\]]", " "), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    base = F.upper(F.regexp_extract("row", r"^\s*([A-Za-z])", 1))
    return rows.select("motif_id", "motif_name", base.alias("base"), F.posexplode(values).alias("pos", "value"))


# Biotypes whose genes and transcripts are left out.
SKIPPED_BIOTYPES = ["unprocessed_pseudogene", "processed_pseudogene", "TEC", "lncRNA", "misc_RNA"]


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts (line, chrom, start, end, strand, gene_id, gene, transcript) of a gene annotation.

    Only gene and transcript lines of chromosomes that don't begin with KI or GL; without the skipped
    biotypes (snoRNA at genes too). A transcript without gene name takes the name that a gene without
    one left before it in the file: its biotype and place."""
    parts = F.split("value", "\t")
    get = lambda i: F.get(parts, F.lit(i))
    rows = read_lines(spark, path).where(~F.col("value").startswith("#")).select("path", "line", get(0).alias("chrom"), get(2).alias("feature"), get(3).try_cast("long").alias("start"), get(4).try_cast("long").alias("end"), get(6).alias("strand"), get(8).alias("attributes"))
    rows = rows.where(F.col("feature").isin("gene", "transcript") & ~F.col("chrom").rlike("^(KI|GL)"))
    biotype = F.coalesce(attribute(F.col("attributes"), "gene_biotype"), attribute(F.col("attributes"), "gene_type"), F.lit(""))
    rows = rows.select("*", biotype.alias("biotype"), attribute(F.col("attributes"), "gene_id").alias("gene_id"), attribute(F.col("attributes"), "gene_name").alias("gene"), attribute(F.col("attributes"), "transcript_id").alias("transcript"))
    left = F.when((F.col("feature") == "gene") & F.col("gene").isNull() & (F.col("biotype") == "lncRNA"), F.concat_ws("_", F.lit("lncRNA"), "chrom", "start", "end"))
    rows = carried_names(rows.withColumn("left", left), part="path", name="gene", given="left")
    kept = ~F.col("biotype").isin(SKIPPED_BIOTYPES) & ~((F.col("feature") == "gene") & (F.col("biotype") == "snoRNA"))
    return rows.where(kept & (F.col("feature") == "transcript")).select("line", "chrom", "start", "end", "strand", "gene_id", "gene", "transcript")


def read_signal(spark: SparkSession, path: str, name: str = "cnr") -> DataFrame:
    """Chromosome, start, end, value; header lines are skipped and a leading chr is cut off."""
    parts = F.split(trim_blank(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").contains("hromosome"))
    return rows.select(F.regexp_replace(parts[0], "^chr", "").alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("start"), F.get(parts, F.lit(2)).try_cast("long").alias("end"), F.lit(name).alias("name"), F.get(parts, F.lit(3)).try_cast("double").alias("value")).where("start IS NOT NULL").select(*SIGNAL.names)


def read_gene_set(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, gene) from vertical key / value files: the distinct symbols of GENE_SYMBOLS."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(file_name(F.input_file_name()).alias("file"), parts[0].alias("key"), F.get(parts, F.lit(1)).alias("value"))
    return rows.where("key = 'GENE_SYMBOLS'").select(F.regexp_replace("file", r"\.tsv$|^set_name=", "").alias("set_name"), F.explode(gene_list(F.col("value"))).alias("gene")).distinct()


def read_expression(spark: SparkSession, path: str, names: tuple[str, ...] = ("Gene Symbol",)) -> DataFrame:
    """A table with a header: `names` stay texts, all other columns are numbers (null where they aren't)."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rows.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in rows.columns if c not in names})


def read_context(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """A context table written by write_context(); one chromosome is one partition."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("chrom") == chrom) if chrom is not None else rows


def cleaned_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as text rounded to whole ones; other text stays."""
    return rows.withColumns({c: F.coalesce(whole_number(F.col(c)).cast("string"), F.col(c)) for c in columns})
