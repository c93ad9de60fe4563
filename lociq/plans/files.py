"""Queries that write the given tables as files of the field, read them again and are compared with SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import motif as M
from ..operators.annotate import best_hits
from ..operators.scan import scan
from ..schema import SIGNALS
from ..shared import shared_dir
from ..sources import readers as R
from ..sources import writers as W
from ..sources.bed_source import read_beds, write_motif_files
from .intervals import _BEST, NEAR
from .registry import registry
from .sequences import SCAN, matrices, sequences
from .stand_ins import GENES, LOCI, SITES, genes, loci, rounded, sites, table

query, QUERIES, ORACLES = registry()


def _text(rows, spark, purpose):
    """Rows of one text column as files in the shared folder."""
    path = shared_dir(spark, purpose)
    rows.write.text(path)
    return path


def _tabs(*columns):
    return F.concat_ws("\t", *(c if not isinstance(c, str) else F.col(c).cast("string") for c in columns))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE NOT regexp_matches(value, '^(Chr|#)') AND len(regexp_split_to_array(trim(value), '\\s+')) >= 3 GROUP BY 1")
def src1_src6_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    lines = R.read_lines(spark, _text(rows.select(_tabs("doc_id", "value")), spark, "lines"))
    kept = lines.select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.regexp_replace("value", "^[^\t]*\t", "").alias("value"))
    kept = kept.where(~F.col("value").rlike("^(Chr|#)") & (F.size(F.split(F.trim("value"), r"\s+")) >= 3))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(SCAN.format(t=2.2))
def src2_fasta_scan(spark, sf_dir):
    """Sequences written as FASTA, read in pieces shorter than most of them, and scanned."""
    lines = F.concat(F.lit(">"), "chrom", F.lit(" a document\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    path = _text(sequences(spark, sf_dir).select(lines), spark, "fasta")
    return rounded(scan(R.read_fasta_chunks(spark, path, size=500, overlap=4), M.weights(M.normalised(matrices(spark))), 2.2))


_COUNTS = {"A": "p_partkey % 7", "C": "p_size % 5", "G": "p_partkey % 3 + 1", "T": "p_size % 11"}


@query(" UNION ALL ".join(f"SELECT 'M' || p_partkey AS motif_id, p_brand AS motif_name, '{b}' AS base, CAST({i} AS INTEGER) AS pos, CAST({c} + {i} AS DOUBLE) AS value FROM part" for b, c in _COUNTS.items() for i in range(3)))
def src3_matrices(spark, sf_dir):
    row = lambda b, c: F.concat(F.lit(f"{b}  [ "), F.concat_ws("  ", *(F.expr(f"cast({c} + {i} as string)") for i in range(3))), F.lit(" ]"))
    lines = F.concat_ws("\n", F.concat(F.lit(">M"), F.col("p_partkey").cast("string"), F.lit("\t"), F.col("p_brand")), *(row(b, c) for b, c in _COUNTS.items()))
    return R.read_motifs(spark, _text(table(spark, sf_dir, "part").select(lines), spark, "matrices"))


@query(f"WITH {GENES} SELECT chrom, s AS start, e AS \"end\", gene AS name FROM genes")
def src4_regions(spark, sf_dir):
    lines = F.concat_ws("\n", F.lit("Chromosome from to name"), F.concat_ws(" ", "chrom", "start", "end", "gene"), F.lit(""), F.concat(F.col("gene"), F.lit(" no numbers")))
    return R.read_regions(spark, _text(genes(spark, sf_dir).select(lines), spark, "regions"))


@query(f"""WITH {GENES} SELECT chrom, s AS start, e AS "end", strand, gene AS gene_id, CASE WHEN line % 5 <> 0 THEN 'N' || gene END AS gene, transcript FROM genes WHERE set_name <> '1-URGENT' AND chrom <> '7'""")
def src5_annotation(spark, sf_dir):
    """Orders as transcripts; urgent ones have a biotype that is left out, chromosome 7 a name that is."""
    g = genes(spark, sf_dir)
    name = F.when(F.col("line") % 5 != 0, F.concat(F.lit(' gene_name "N'), "gene", F.lit('";'))).otherwise(F.lit(""))
    kind = F.when(F.col("set_name") == "1-URGENT", "lncRNA").otherwise("protein_coding")
    notes = F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "'), "transcript", F.lit('";'), name, F.lit(' gene_biotype "'), kind, F.lit('";'))
    chrom = F.when(F.col("chrom") == "7", "KI270").otherwise(F.col("chrom"))
    line = lambda feature: _tabs(chrom, F.lit("x"), F.lit(feature), "start", "end", F.lit("."), "strand", F.lit("."), notes)
    path = _text(g.select(F.concat_ws("\n", F.lit("#comment"), line("transcript"), line("exon"))), spark, "annotation")
    return R.read_gtf(spark, path).drop("line")


_SITES = f"WITH {SITES} SELECT chrom, s AS start, e AS \"end\", name, score, strand"


@query(_SITES + " FROM sites")
def src6_bed(spark, sf_dir):
    path = shared_dir(spark, "bed")
    sites(spark, sf_dir).select(F.col("chrom").alias("Chr"), "start", "end", "name", "score", "strand").write.option("sep", "\t").option("header", True).csv(path)
    return R.read_bed(spark, path).drop("path")


@query(_SITES + ", 'name=' || name AS set_name FROM sites")
def src7_bed_directory(spark, sf_dir):
    path = shared_dir(spark, "beds")
    sites(spark, sf_dir).select("chrom", "start", "end", F.col("name").alias("what"), "score", "strand", "name").write.partitionBy("name").option("sep", "\t").csv(path)
    return R.read_bed_sets(spark, f"{path}/*/")


@query(_SITES + ", 'all.cutandrun.tp73bs' AS set_name, " + ", ".join(f"CAST(k + {i} AS DOUBLE) AS {c}" for i, c in enumerate(SIGNALS)) + ", k AS num_tfbs FROM sites")
def src7_wide_bed(spark, sf_dir):
    path = shared_dir(spark, "wide") + "/all.cutandrun.tp73bs"
    signals = [(F.col("k") + i).cast("double").alias(c) for i, c in enumerate(SIGNALS)]
    sites(spark, sf_dir).select("chrom", "start", "end", "name", "score", "strand", *signals, "k").write.option("sep", "\t").csv(path)
    return R.read_wide_bed(spark, path)


@query(f"WITH {LOCI} SELECT name, count(*) AS n, round(sum(score), 4) AS total FROM loci WHERE chrom = '3' GROUP BY name")
def src8_snk6_context_partition(spark, sf_dir):
    """A stored stage, one partition of it read."""
    path = shared_dir(spark, "context")
    W.write_context(W.stage(spark, f"{path}/stage", lambda: loci(spark, sf_dir)), f"{path}/context")
    rows = R.read_context(spark, f"{path}/context", "3")
    return rounded(rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("score").alias("total")), 4)


@query("""SELECT l_suppkey % 24 AS chrom, count(*) AS n FROM lineitem GROUP BY 1""")
def src8_chromosome_partitions(spark, sf_dir):
    """Line items stored by chromosome; the count reads the partitions' names only."""
    path = shared_dir(spark, "partitions")
    W.write_context(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 24).alias("chrom"), "l_orderkey").repartition("chrom"), path)
    return R.read_context(spark, path).groupBy(F.col("chrom").cast("long").alias("chrom")).agg(F.count("*").alias("n"))


@query("SELECT c_name AS gene, c_acctbal AS ta, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS DOUBLE) END AS dn FROM customer")
def src9_expression(spark, sf_dir):
    path = shared_dir(spark, "expression")
    dn = F.when(F.col("c_nationkey") == 3, "n/a").otherwise(F.col("c_nationkey").cast("string"))
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("Gene Symbol"), F.col("c_acctbal").alias("FC TA"), dn.alias("FC DN")).write.option("sep", "\t").option("header", True).csv(path)
    return R.read_expression(spark, path).toDF("gene", "ta", "dn")


@query(f"WITH {SITES} SELECT chrom, s AS start, e AS \"end\", 'cnr' AS name, score AS value FROM sites")
def src10_signal(spark, sf_dir):
    lines = F.concat_ws("\n", F.lit("Chromosome\tstart\tend\tvalue"), F.concat(F.lit("chr"), _tabs("chrom", "start", "end", "score")))
    return R.read_signal(spark, _text(sites(spark, sf_dir).select(lines), spark, "signal"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'n/a' ELSE CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) END AS balance FROM customer")
def src11_cleaned_numbers(spark, sf_dir):
    text = F.when(F.col("c_nationkey") == 3, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return R.cleaned_numbers(table(spark, sf_dir, "customer").select("c_custkey", text.alias("balance")), ["balance"])


@query("SELECT DISTINCT c_mktsegment AS set_name, 'G' || c_nationkey AS gene FROM customer UNION SELECT c_mktsegment, 'G1' FROM customer")
def src12_gene_sets(spark, sf_dir):
    """Symbols of each market segment, one of them named twice and after a blank, among other keys."""
    path = shared_dir(spark, "sets")
    sets = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("set_name"), F.concat(F.lit("G"), F.col("c_nationkey").cast("string")).alias("gene"))
    symbols = F.array_join(F.array_sort(F.collect_set("gene")), ",")
    lines = F.concat_ws("\n", F.concat(F.lit("STANDARD_NAME\t"), F.col("set_name")), F.concat(F.lit("GENE_SYMBOLS\t"), symbols, F.lit(", G1")), F.lit("PMID\t1"))
    sets.groupBy("set_name").agg(lines.alias("value")).write.partitionBy("set_name").text(path)
    return R.read_gene_set(spark, f"{path}/*/")


@query(f"WITH {LOCI} SELECT chrom, s AS start, e AS \"end\", name, score, strand FROM loci WHERE name = 'click' AND chrom = '5'")
def src14_file_of_a_motif(spark, sf_dir):
    path = shared_dir(spark, "motifs")
    rows = loci(spark, sf_dir).where("chrom = '5'").select("chrom", "start", "end", "name", "score", "strand")
    for motif in ("click", "view"):
        rows.where(F.col("name") == motif).write.option("sep", "\t").option("compression", "gzip").csv(f"{path}/{motif}_MA1_bidirect_5.bed.gz")
    return R.read_motif_hits(spark, path, "click", "5")


@query(f"WITH {LOCI} SELECT chrom, s AS start, e AS \"end\", name, printf('%.3f', score) AS score, strand, 'M-' || k || '-' AS motif, CASE strand WHEN '-' THEN 'negative' ELSE 'positive' END AS side FROM loci")
def snk1_hits(spark, sf_dir):
    path = shared_dir(spark, "hits")
    motif = F.concat(F.lit("M:"), F.col("k").cast("string"), F.lit("/"))
    W.write_hits(loci(spark, sf_dir).select("chrom", "start", "end", F.col("name").alias("motif_name"), motif.alias("motif_id"), "score", "strand"), path)
    schema = "chrom string, start long, end long, name string, score string, strand string, motif string, side string"
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


@query(f"WITH {LOCI} SELECT chrom, s AS start, e AS \"end\", round(score, 3) AS score, strand, name || '_' || (k % 4) AS motif FROM loci WHERE chrom IN ('3', '7') AND name = 'click'")
def snk1_src6_motif_files(spark, sf_dir):
    """Hits as files named by motif, strand and stretch, of which those of two chromosomes are opened again."""
    path = shared_dir(spark, "motif-files")
    rows = loci(spark, sf_dir).where("name IN ('click', 'view')")
    write_motif_files(rows.withColumn("motif_id", (F.col("k") % 4).cast("string")), path)
    return read_beds(spark, path).where("chrom IN ('3', '7') AND motif LIKE 'click%'").select("chrom", "start", "end", F.round("score", 3).alias("score"), "strand", "motif")


@query("SELECT event_id, format('{:d}\t{:d}', user_id, event_id) || chr(9) || event_id || chr(9) || event_type || chr(9) || '0' || chr(9) || '+' AS value FROM events")
def snk2_bed_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("chrom"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), F.col("event_type").alias("gene"), F.lit("+").alias("strand"))
    path = shared_dir(spark, "lines")
    W.write_bed(rows, path)
    return spark.read.text(path).select(F.split("value", "\t")[1].cast("long").alias("event_id"), "value")


@query("SELECT event_id, printf('%.3f', value) AS score, CASE WHEN event_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS side FROM events")
def snk1_snk2_written_lines(spark, sf_dir):
    """Hits of one motif over positions far apart, written in stretches by several tasks, and read as lines."""
    path = shared_dir(spark, "stretches")
    rows = table(spark, sf_dir, "events").select(F.lit("1").alias("chrom"), (F.col("event_id") * 100_003).alias("start"), (F.col("event_id") * 100_003 + 9).alias("end"), F.lit("MA0861.1").alias("motif_id"), F.lit("TP73").alias("motif_name"), F.col("value").alias("score"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    W.write_hits(rows, path)
    lines = spark.read.option("basePath", path).text(path).where("value NOT LIKE 'chrom%'")
    field = F.split("value", "\t")
    return lines.select((field[1].cast("long") / 100_003).cast("long").alias("event_id"), field[4].alias("score"), "side")


@query(f"WITH {LOCI} SELECT site_id, CASE WHEN k % 3 = 0 THEN 'NA' ELSE CAST(k AS VARCHAR) END AS shift, CASE WHEN name = 'view' THEN 'NA' ELSE name END AS name FROM loci")
def snk3_context_text(spark, sf_dir):
    path = shared_dir(spark, "text")
    W.write_context_text(loci(spark, sf_dir).select("site_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("shift"), F.when(F.col("name") != "view", F.col("name")).alias("name")), path)
    return spark.read.schema("site_id long, shift string, name string").option("header", True).option("sep", "\t").csv(path)


_MANY = 400
_LINE = "concat_ws(chr(9), m.chrom, m.s, m.e, 'S' || m.site_id, CAST(m.score AS VARCHAR), m.strand)"


@query(_BEST.format(gate=f"EXISTS (SELECT 1 FROM m WHERE m.chrom = h.chrom AND m.e + {NEAR} >= h.e AND m.s - {NEAR} <= h.s)", window="").replace("h.name AS motif", f"h.name || '_' || (h.site_id % {_MANY}) AS motif").replace("SELECT site_id, motif, shift", ", best AS (SELECT site_id, motif, shift") + f"""),
motifs AS (SELECT name || '_' || i AS motif, row_number() OVER (ORDER BY name, i) AS place FROM (SELECT DISTINCT name FROM sites), range({_MANY}) t(i)),
w AS (SELECT m.site_id, string_agg(CASE WHEN b.motif IS NULL THEN 'NA' || chr(9) || 'NA' || chr(9) || 'NA' || chr(9) || '0' ELSE concat_ws(chr(9), b.shift, printf('%g', b.score), b.strand_equal, b.num_in_window) END, chr(9) ORDER BY place) AS fields
  FROM m CROSS JOIN motifs LEFT JOIN best b ON b.site_id = m.site_id AND b.motif = motifs.motif GROUP BY m.site_id)
SELECT 'S' || site_id AS name, md5({_LINE} || chr(9) || fields) AS line, CAST(6 + 4 * (SELECT count(*) FROM motifs) AS BIGINT) AS n_fields FROM m JOIN w USING (site_id)
UNION ALL SELECT 'Name', md5('Chr' || chr(9) || 'Start' || chr(9) || 'End' || chr(9) || 'Name' || chr(9) || 'Score' || chr(9) || 'Strand' || string_agg(chr(9) || motif || '_Shift' || chr(9) || motif || '_Score' || chr(9) || motif || '_StrandEqual' || chr(9) || motif || '_NumInWindow', '' ORDER BY place)), CAST(6 + 4 * count(*) AS BIGINT) FROM motifs""")
def snk3_context_lines(spark, sf_dir):
    """BED lines annotated with 400 motifs of each event type, written in the wide form and read again."""
    everything = sites(spark, sf_dir)
    main = everything.where("name = 'purchase'")
    line = F.concat_ws("\t", "chrom", "start", "end", F.concat(F.lit("S"), "site_id"), "score", "strand")
    hits = everything.select(F.col("site_id").alias("hit_id"), "chrom", "start", "end", F.concat("name", F.lit("_"), F.col("site_id") % _MANY, F.lit("_bidirect")).alias("motif"), "score", "strand")
    names = sorted(r[0] for r in everything.select("name").distinct().collect())
    motifs = [f"{n}_{i}_bidirect" for n in names for i in range(_MANY)]
    path = shared_dir(spark, "context-lines")
    lines = W.context_lines(main.select("site_id", "chrom", "start", line.alias("line")), best_hits(main, hits, NEAR), motifs, ordered=True)
    W.write_context_lines(lines, path, W.context_header("Chr\tStart\tEnd\tName\tScore\tStrand", motifs), ordered=True)
    fields = F.arrow_udf(_fields, "long")
    name = F.substring_index(F.substring_index("value", "\t", 4), "\t", -1)
    return spark.read.text(path).select(name.alias("name"), F.md5("value").alias("line"), fields("value").alias("n_fields"))


def _fields(lines: pa.Array) -> pa.Array:
    """The number of fields of each line; thousands of them aren't cut out to be counted."""
    return pc.add(pc.cast(pc.count_substring(lines, "\t"), pa.int64()), 1)


@query("SELECT s_suppkey, replace(printf('%.2f', s_acctbal), '.', ',') AS balance FROM supplier")
def snk4_report(spark, sf_dir):
    """A report with decimal commas; the query writes the number with two decimals again."""
    path = shared_dir(spark, "report")
    W.write_report(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), path, decimal_comma=True)
    rows = spark.read.schema("s_suppkey long, balance string").option("header", True).option("sep", "\t").csv(path)
    number = F.regexp_replace("balance", ",", ".").cast("double")
    return rows.where(F.col("balance").contains(",")).select("s_suppkey", F.regexp_replace(F.format_string("%.2f", number), r"\.", ",").alias("balance"))


@query(f"WITH {LOCI} SELECT site_id, s AS start, name, chrom AS Chr FROM loci")
def snk7_by_chromosome(spark, sf_dir):
    path = shared_dir(spark, "chromosomes")
    W.write_by_chromosome(loci(spark, sf_dir).select("site_id", "start", "name", F.col("chrom").alias("Chr")), path)
    return spark.read.schema("site_id long, start long, name string, Chr string").option("header", True).option("sep", "\t").csv(path)


@query(f"WITH {LOCI} SELECT CAST(row_number() OVER (ORDER BY chrom, s) AS BIGINT) AS line_no, chrom, s AS start FROM loci")
def snk8_merged_strands(spark, sf_dir):
    """Both strands merged and written; the lines are in order over all files."""
    path = shared_dir(spark, "merged")
    rows = loci(spark, sf_dir).select("chrom", "start", "strand")
    W.merged_strands(rows.where("strand = '+'"), rows.where("strand = '-'")).select(_tabs("chrom", "start", "strand")).write.text(path)
    field = F.split("value", "\t")
    return R.read_numbered_lines(spark, path, together=True).select("line_no", field[0].alias("chrom"), field[1].cast("long").alias("start"))


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line_no, count(*) OVER () AS total FROM orders) SELECT line_no, o_orderkey, 'head' AS part FROM n WHERE line_no <= 50 UNION ALL SELECT line_no, o_orderkey, 'tail' FROM n WHERE line_no > total - 50")
def l5_first_and_last_lines(spark, sf_dir):
    """The sorted keys as the parts of one file."""
    path = shared_dir(spark, "ordered")
    table(spark, sf_dir, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return R.first_and_last(R.read_numbered_lines(spark, path, together=True), 50).select("line_no", F.col("value").cast("long").alias("o_orderkey"), "part")
