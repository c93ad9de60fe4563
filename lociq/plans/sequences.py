"""Queries on sequences, names and attribute texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import motif as M
from ..functions import text as X
from ..operators.scan import in_regions, scan
from .registry import registry
from .stand_ins import rounded, table

query, QUERIES, ORACLES = registry()

# Two small matrices of counts by position, for the queries.
COUNTS = {
    "M1": {"A": [8, 1, 0, 5], "C": [2, 6, 1, 5], "G": [4, 3, 9, 5], "T": [6, 10, 10, 5]},
    "M2": {"A": [9, 3, 1, 6, 2], "C": [3, 3, 4, 6, 8], "G": [3, 8, 10, 0, 5], "T": [5, 6, 5, 8, 5]},
}
ROWS = [(m, i, b, c) for m, by in COUNTS.items() for b, counts in by.items() for i, c in enumerate(counts)]


def matrices(spark):
    return spark.createDataFrame(ROWS, "motif_id string, pos int, base string, value int")


def sequences(spark, sf_dir):
    """Documents as sequences: their letters A, C, G, T, N, in upper case."""
    letters = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom"), letters.alias("seq"))


_COUNTS = "counts(motif_id, pos, base, value) AS (VALUES " + ", ".join(f"('{m}', {i}, '{b}', {c})" for m, i, b, c in ROWS) + ")"
_W = _COUNTS + """, shares AS (SELECT *, sum(value) OVER (PARTITION BY motif_id, pos) AS total FROM counts),
w AS (SELECT motif_id, pos, base, value / CAST(total AS DOUBLE) AS share, log2(nullif(value, 0) / CAST(total AS DOUBLE) / 0.25) AS score FROM shares)"""
_SEQ = "seqs AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents)"


@query(f"""WITH letters AS (SELECT lang, unnest(range(0, length(seq))) AS i, seq FROM (SELECT lang, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents)),
c AS (SELECT lang AS motif_id, CAST(i % 10 AS INTEGER) AS pos, substr(seq, i + 1, 1) AS base, count(*) AS value FROM letters WHERE substr(seq, i + 1, 1) <> 'N' GROUP BY ALL),
t AS (SELECT *, CAST(sum(value) OVER (PARTITION BY motif_id, pos) AS BIGINT) AS total FROM c)
SELECT *, round(value / CAST(total AS DOUBLE), 6) AS share, round(log2(value / CAST(total AS DOUBLE) / 0.25), 6) AS score FROM t""")
def f5_f8_f9_normalised_matrix(spark, sf_dir):
    """A matrix for each language, counted from the letters of all its documents by place modulo ten."""
    letters = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("motif_id"), F.posexplode(F.split(letters, "")).alias("i", "base"))
    counts = rows.where(F.col("base").isin(*M.BASES)).groupBy("motif_id", (F.col("i") % 10).alias("pos"), "base").agg(F.count("*").alias("value"))
    return rounded(M.normalised(counts))


@query("SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS q, count(*) AS n, round(log2(CASE WHEN l_quantity > 0 THEN l_quantity / 50 / 0.3 END), 6) AS risk, round(log2(CASE WHEN l_quantity > 0 AND l_quantity < 50 THEN l_quantity / (50 - l_quantity) END) + log2(3.0), 6) AS odds FROM lineitem GROUP BY ALL")
def f6_f7_log_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    return rounded(rows.withColumns({"risk": M.log_risk(F.col("q") / 50, 0.3), "odds": M.log_odds(F.col("q"), F.lit(50.0))}))


@query(f"WITH {_SEQ} SELECT chrom, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def f4_reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("chrom", M.reverse_complement(F.col("seq")).alias("rc"))


SCAN = f"""WITH {_W}, {_SEQ}, l AS (SELECT motif_id, max(pos) + 1 AS n FROM w GROUP BY motif_id),
s AS (SELECT chrom, '+' AS strand, seq FROM seqs UNION ALL SELECT chrom, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs),
k AS (SELECT chrom, strand, motif_id, n, length(seq) AS total, i, substr(seq, i + 1, n) AS match FROM (SELECT s.*, l.*, unnest(range(0, length(seq) - n + 1)) AS i FROM s, l WHERE length(seq) >= n)),
b AS (SELECT k.*, unnest(range(0, n)) AS pos FROM k),
h AS (SELECT b.chrom, b.strand, b.motif_id, b.n, b.total, b.i, b.match, sum(score) AS score, count(score) AS good FROM b JOIN w ON w.motif_id = b.motif_id AND w.pos = b.pos AND w.base = substr(match, b.pos + 1, 1) GROUP BY ALL)
SELECT motif_id, chrom, CASE WHEN strand = '+' THEN i + 1 ELSE total - i - n + 1 END AS start, CASE WHEN strand = '+' THEN i + 1 + n ELSE total - i + 1 END AS "end", round(score, 6) AS score, strand, match
FROM h WHERE good = n AND score >= {{t}}"""


def _hits(spark, sf_dir, threshold):
    return rounded(scan(sequences(spark, sf_dir), M.weights(M.normalised(matrices(spark))), threshold))


@query(SCAN.format(t=2.2))
def w1_f10_f11_motif_scan(spark, sf_dir):
    return _hits(spark, sf_dir, 2.2)


@query(f"""WITH hits AS ({SCAN.format(t=2.2)}) SELECT motif_id, chrom, start, strand FROM hits WHERE start >= 100 AND "end" <= 400""")
def src4_scan_in_regions(spark, sf_dir):
    regions = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom"), F.lit(100).cast("long").alias("start"), F.lit(400).cast("long").alias("end"))
    return in_regions(_hits(spark, sf_dir, 2.2), regions).select("motif_id", "chrom", "start", "strand")


_PATH = "'data/x\\y/' || p_name || '_' || p_brand || '_' || p_type || '.bed'"


@query(f"""WITH p AS (SELECT p_partkey, {_PATH} AS path, p_name FROM part), b AS (SELECT *, regexp_extract(path, '([^/\\\\]*)$', 1) AS base FROM p)
SELECT p_partkey, base, array_to_string(string_split(base, '_')[1:2], '_') AS short, trim('  ' || p_name || chr(9), ' ' || chr(9)) AS trimmed,
string_split(base, '_')[1] || ' (' || string_split(base, '_')[2] || ')' AS pretty, regexp_split_to_array(base, '[_ ]')[1] AS tf, translate('a/b:c(' || p_name || ')', '/:()', '----') AS safe FROM b""")
def f1_f2_f3_f16_f17_f28_names(spark, sf_dir):
    path = F.concat(F.lit("data/x\\y/"), "p_name", F.lit("_"), "p_brand", F.lit("_"), "p_type", F.lit(".bed"))
    base = X.basename(path)
    return table(spark, sf_dir, "part").select(
        "p_partkey", base.alias("base"), X.short_motif_name(path).alias("short"), X.trim_blank(F.concat(F.lit("  "), "p_name", F.lit("\t"))).alias("trimmed"), X.pretty_motif(base).alias("pretty"), X.tf_name(base).alias("tf"), X.file_safe(F.concat(F.lit("a/b:c("), "p_name", F.lit(")"))).alias("safe")
    )


@query("""SELECT p_partkey, coalesce(bool_or(t IN (SELECT DISTINCT string_split(p_name, ' ')[1] FROM part WHERE p_size = 7)), FALSE) AS human FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY p_partkey""")
def f18_human_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ids = part.where("p_size = 7").select(F.split("p_name", " ")[0].alias("token")).distinct()
    tokens = part.select("p_partkey", F.explode(X.name_tokens(F.col("p_name"))).alias("token"))
    hit = tokens.join(ids, "token", "left_semi").select("p_partkey").distinct().withColumn("human", F.lit(True))
    return part.select("p_partkey").join(hit, "p_partkey", "left").withColumn("human", F.coalesce("human", F.lit(False)))


@query("""SELECT event_id, CAST(regexp_extract('gene_id "' || user_id || '"; gene_name "' || event_type || '"', 'gene_name "([^"]*)"', 1) AS VARCHAR) AS gene, NULL::VARCHAR AS other, event_type || ' ' || user_id || ' 1-2 +' AS label, round_even(value, 0)::BIGINT AS whole, len(list_filter(regexp_split_to_array('a, ' || event_type || ',b c', '[,\\s]+'), lambda x: x <> '')) AS n_genes FROM events""")
def src5_src11_src13_f33_attributes(spark, sf_dir):
    text = F.concat(F.lit('gene_id "'), F.col("user_id").cast("string"), F.lit('"; gene_name "'), "event_type", F.lit('"'))
    return table(spark, sf_dir, "events").select(
        "event_id",
        X.attribute(text, "gene_name").alias("gene"),
        X.attribute(text, "transcript_id").alias("other"),
        X.region_label(F.col("event_type"), F.col("user_id").cast("string"), F.lit(1), F.lit(2), F.lit("+")).alias("label"),
        X.whole_number(F.col("value").cast("string")).alias("whole"),
        F.size(X.gene_list(F.concat(F.lit("a, "), "event_type", F.lit(",b c")))).cast("long").alias("n_genes"),
    )


@query("""SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def snk9_missing(spark, sf_dir):
    from ..sources.writers import missing

    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return missing(orders, orders.where("o_orderstatus = 'F'"), ["k"])
