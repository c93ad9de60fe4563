"""Queries on intervals: annotation, signal mapping, promoter membership, gene lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.regions import downstream, shifted, upstream
from ..operators import annotate, genes as gene_ops
from ..operators.range_join import has_overlap, overlap_join, window_join
from ..operators.ranking import neighbours_in_range
from .registry import registry
from .stand_ins import GENES, LOCI, SITES, genes, loci, rounded, sites, table

NEAR = 21_600
query, QUERIES, ORACLES = registry()


def _main_and_hits(spark, sf_dir):
    all_sites = sites(spark, sf_dir)
    return all_sites.where("name = 'purchase'"), all_sites.select(F.col("site_id").alias("hit_id"), "chrom", "start", "end", F.col("name").alias("motif"), "score", "strand")


_BEST = f"""WITH {SITES}, m AS (SELECT * FROM sites WHERE name = 'purchase'),
admitted AS (SELECT * FROM sites h WHERE {{gate}}),
p AS (SELECT m.site_id, h.name AS motif, h.s - m.s AS shift, h.score, CAST(h.strand = m.strand AS INTEGER) AS strand_equal, h.s AS hs, h.site_id AS hid, abs(h.s - m.s) <= {NEAR} AS may
  FROM m JOIN admitted h ON h.chrom = m.chrom AND h.e BETWEEN m.s - {NEAR} AND m.e + {NEAR} {{window}}),
r AS (SELECT *, count(*) OVER (PARTITION BY site_id, motif) AS n, row_number() OVER (PARTITION BY site_id, motif ORDER BY may DESC, score DESC, hs, hid) AS place FROM p)
SELECT site_id, motif, shift, score, strand_equal, n AS num_in_window FROM r WHERE place = 1 AND may"""


@query(_BEST.format(gate=f"EXISTS (SELECT 1 FROM m WHERE m.chrom = h.chrom AND m.e + {NEAR} >= h.e AND m.s - {NEAR} <= h.s)", window=""))
def j1_best_hit_annotation(spark, sf_dir):
    return annotate.best_hits(*_main_and_hits(spark, sf_dir), NEAR)


@query(_BEST.format(gate="TRUE", window=f"AND h.s >= m.s - {NEAR}"))
def j1_best_hit_window_count(spark, sf_dir):
    return annotate.best_hits(*_main_and_hits(spark, sf_dir), NEAR, count_mode="window")


@query(f"""WITH {SITES}, m AS (SELECT site_id, chrom, s, e FROM sites WHERE name = 'purchase')
SELECT m.site_id, coalesce(min(t.score) FILTER (WHERE t.name = 'click'), 0) AS click, coalesce(min(t.score) FILTER (WHERE t.name = 'view'), 0) AS view
FROM m LEFT JOIN sites t ON t.chrom = m.chrom AND m.s < t.s + 600 + t.k * 60 AND t.s < m.e AND t.name IN ('click', 'view') GROUP BY m.site_id""")
def j2_signal_min(spark, sf_dir):
    return _signals(spark, sf_dir, "min")


@query(ORACLES["j2_signal_min"].replace("min(", "max("))
def j3_signal_max(spark, sf_dir):
    return _signals(spark, sf_dir, "max")


def _signals(spark, sf_dir, how):
    all_sites = sites(spark, sf_dir)
    tracks = all_sites.select("chrom", "start", (F.col("end") + F.col("k") * 60).alias("end"), F.col("name").alias("track"), F.col("score").alias("value"))
    main = all_sites.where("name = 'purchase'").select("site_id", "chrom", "start", "end")
    return annotate.map_signals(main, tracks, ["click", "view"], how).select("site_id", "click", "view")


@query(f"""WITH {LOCI}, {GENES} SELECT transcript, site_id, least(g.e, l.e) - greatest(g.s, l.s) AS overlap FROM genes g JOIN loci l ON g.chrom = l.chrom AND g.s < l.e AND l.s < g.e""")
def j4_intersections(spark, sf_dir):
    return annotate.intersections(genes(spark, sf_dir), _places(spark, sf_dir)).select("transcript", "site_id", "overlap")


def _places(spark, sf_dir):
    return loci(spark, sf_dir).select("site_id", "chrom", "start", "end")


@query(f"""WITH {LOCI}, {GENES} SELECT DISTINCT site_id FROM loci l JOIN genes g ON g.chrom = l.chrom AND g.s <= l.e AND l.s <= g.e""")
def j5_overlapped_sites(spark, sf_dir):
    return has_overlap(loci(spark, sf_dir), genes(spark, sf_dir), key="site_id")


_UP = "CASE WHEN strand = '-' THEN e + 1 ELSE s - 500 END AS ps, CASE WHEN strand = '-' THEN e + 500 ELSE s - 1 END AS pe"


def _promoters(spark, sf_dir):
    region = upstream(F.col("start"), F.col("end"), F.col("strand"))
    return genes(spark, sf_dir).select("gene", "transcript", "chrom", "set_name", region.alias("r")).select("gene", "transcript", "chrom", "set_name", "r.start", "r.end")


@query(f"""WITH {LOCI}, {GENES}, p AS (SELECT gene, chrom, set_name, {_UP} FROM genes)
SELECT site_id, coalesce(bool_or(set_name = '1-URGENT'), FALSE) AS urgent, coalesce(bool_or(set_name = '5-LOW'), FALSE) AS low
FROM loci l LEFT JOIN p ON p.chrom = l.chrom AND p.ps <= l.e AND l.s <= p.pe GROUP BY site_id""")
def j6_promoter_flags(spark, sf_dir):
    flags = annotate.set_flags(loci(spark, sf_dir), _promoters(spark, sf_dir), ["1-URGENT", "5-LOW"])
    return flags.select("site_id", F.col("in_1-URGENT").alias("urgent"), F.col("in_5-LOW").alias("low"))


@query(f"""WITH {LOCI}, {GENES}, p AS (SELECT gene, chrom, {_UP} FROM genes),
c AS (SELECT p.gene, l.site_id, l.score, l.k, row_number() OVER (PARTITION BY p.gene ORDER BY l.k DESC, l.score DESC, l.site_id) AS place FROM p JOIN loci l ON p.chrom = l.chrom AND p.ps <= l.e AND l.s <= p.pe)
SELECT g.gene, c.site_id, c.score FROM (SELECT DISTINCT gene FROM genes) g LEFT JOIN c ON c.gene = g.gene AND c.place = 1""")
def j7_best_site_of_gene(spark, sf_dir):
    rank = F.struct("k", "score", -F.col("site_id"))
    return gene_ops.best_site_of_gene(genes(spark, sf_dir), _promoters(spark, sf_dir), loci(spark, sf_dir), rank, ["site_id", "score"])


@query(f"""WITH {SITES}, o AS (SELECT * FROM sites WHERE name = 'error')
SELECT site_id, EXISTS (SELECT 1 FROM o WHERE o.chrom = a.chrom AND a.s <= o.e + 100 AND o.s - 100 <= a.e) AS near FROM sites a WHERE name = 'view'""")
def j8_nearby_flag(spark, sf_dir):
    all_sites = sites(spark, sf_dir)
    return annotate.nearby(all_sites.where("name = 'view'"), all_sites.where("name = 'error'")).select("site_id", "near")


@query("""SELECT l_orderkey AS k, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_partkey % 24 = o_custkey % 24 WHERE l_quantity > 10 GROUP BY ALL""")
def j9_exact_coordinates(spark, sf_dir):
    a, b = table(spark, sf_dir, "lineitem").where("l_quantity > 10"), table(spark, sf_dir, "orders")
    same = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_partkey") % 24 == F.col("o_custkey") % 24)
    return a.join(b, same).groupBy(F.col("l_orderkey").alias("k"), "o_custkey").agg(F.count("*").alias("n"))


@query(f"""WITH {LOCI}, {GENES} SELECT transcript, site_id FROM genes g JOIN loci l ON g.chrom = l.chrom AND l.s >= g.s AND l.e <= g.e""")
def j10_contained_sites(spark, sf_dir):
    return overlap_join(genes(spark, sf_dir), _places(spark, sf_dir), kind="contained").select("transcript", "site_id")


@query(f"""WITH {LOCI}, {GENES} SELECT transcript, site_id FROM genes g JOIN loci l ON g.chrom = l.chrom AND g.s - 500 <= l.s AND g.e + 500 >= l.e""")
def j11_padded_transcripts(spark, sf_dir):
    padded = genes(spark, sf_dir).withColumns({"start": F.col("start") - 500, "end": F.col("end") + 500})
    return overlap_join(padded, _places(spark, sf_dir), kind="contained").select("transcript", "site_id")


@query(f"""WITH {GENES} SELECT transcript FROM genes WHERE gene IN (SELECT 'G' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j12_gene_set_members(spark, sf_dir):
    return genes(spark, sf_dir).join(_gene_set(spark, sf_dir, "BUILDING"), "gene", "left_semi").select("transcript")


@query(f"""WITH {GENES} SELECT transcript FROM genes WHERE gene NOT IN (SELECT 'G' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j13_not_members(spark, sf_dir):
    return genes(spark, sf_dir).join(_gene_set(spark, sf_dir, "BUILDING"), "gene", "left_anti").select("transcript")


def _gene_set(spark, sf_dir, segment):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == segment).select(F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("gene"))


@query(f"""WITH {GENES}, q AS (SELECT DISTINCT 'G' || c_custkey AS gene FROM customer) SELECT q.gene, transcript FROM q LEFT JOIN genes USING (gene)""")
def j14_regions_by_name(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("gene"))
    return gene_ops.named_regions(asked, genes(spark, sf_dir)).select("gene", "transcript")


@query(f"""WITH {GENES} SELECT transcript FROM genes WHERE chrom = '7'""")
def j16_chromosome_lookup(spark, sf_dir):
    return genes(spark, sf_dir).where("chrom = '7'").select("transcript")


@query(f"""WITH {LOCI}, {GENES}, q AS (SELECT gene, transcript, chrom, s, e, CASE WHEN strand = '-' THEN e - 100 ELSE s - 1000 END AS ps, CASE WHEN strand = '-' THEN e + 1000 ELSE s + 100 END AS pe FROM genes WHERE set_name = '2-HIGH')
SELECT gene, site_id, ps, CASE WHEN l.s >= q.s AND l.e <= q.e THEN 'Intragenic' ELSE 'Promoter' END AS location FROM q JOIN loci l ON l.chrom = q.chrom AND l.s >= ps AND l.e <= pe""")
def j17_sites_of_genes(spark, sf_dir):
    regions = genes(spark, sf_dir).where("set_name = '2-HIGH'")
    return gene_ops.sites_of_genes(regions, regions, loci(spark, sf_dir), 1000, 100).select("gene", "site_id", F.col("start").alias("ps"), "location")


@query(f"""WITH {SITES}, m AS (SELECT * FROM sites WHERE name = 'error') SELECT a.site_id, count(*) AS n_near FROM m a JOIN m b ON a.chrom = b.chrom AND abs(a.s - b.s) <= {NEAR} GROUP BY a.site_id""")
def w2_range_frame(spark, sf_dir):
    return neighbours_in_range(sites(spark, sf_dir).where("name = 'error'"), ["chrom"], "start", NEAR).select("site_id", "n_near")


@query(ORACLES["w2_range_frame"])
def w2_range_join(spark, sf_dir):
    errors = sites(spark, sf_dir).where("name = 'error'").select("site_id", "chrom", "start")
    others = errors.select("chrom", F.col("start").alias("other"))
    near = window_join(errors, others, F.col("start") - NEAR, F.col("start") + NEAR, "other", width=NEAR)
    return near.groupBy("site_id").agg(F.count("*").alias("n_near"))


@query(f"""WITH {GENES} SELECT transcript, {_UP}, CASE WHEN strand = '-' THEN e - 499 ELSE s END AS us, CASE WHEN strand = '-' THEN e ELSE s + 499 END AS ue,
  CASE WHEN strand = '-' THEN greatest(s - 500, 0) ELSE s + 500 END AS ms, CASE WHEN strand = '-' THEN greatest(e - 500, 0) ELSE e + 500 END AS me FROM genes""")
def f12_f13_f14_derived_regions(spark, sf_dir):
    args = (F.col("start"), F.col("end"), F.col("strand"))
    rows = genes(spark, sf_dir).select("transcript", upstream(*args).alias("p"), downstream(*args).alias("u"), shifted(*args).alias("m"))
    return rows.select("transcript", *(F.col(f"{a}.{b}").alias(f"{a}{b[0]}") for a in "pum" for b in ("start", "end")))


@query(f"""WITH {GENES}, r AS (SELECT *, first_value(chrom) OVER (PARTITION BY gene ORDER BY line) AS c1 FROM genes),
q AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY e - s DESC, line DESC) AS place FROM r WHERE chrom = c1) SELECT gene, line, e - s AS span FROM q WHERE place = 1""")
def a1_longest_transcript(spark, sf_dir):
    rows = genes(spark, sf_dir).drop("transcript").withColumn("transcript", F.col("gene"))
    return gene_ops.longest_transcripts(rows).select("gene", "line", (F.col("end") - F.col("start")).alias("span"))


@query(f"""WITH {GENES}, q AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY e - s DESC, chrom, s, transcript) AS place FROM genes) SELECT gene, transcript FROM q WHERE place <= 2""")
def l2_first_regions(spark, sf_dir):
    return gene_ops.first_regions(genes(spark, sf_dir), 2).select("gene", "transcript")


@query(f"""WITH {LOCI}, q AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY score DESC, site_id) AS place FROM loci WHERE strand = '+') SELECT chrom, site_id, score FROM q WHERE place = 1""")
def a22_local_best(spark, sf_dir):
    rows = loci(spark, sf_dir).withColumn("gene", F.col("chrom")).withColumn("same_strand", F.col("strand") == "+")
    return gene_ops.local_best(rows, "score", "site_id").select("chrom", "site_id", "score")


@query(f"""WITH {LOCI}, c AS (SELECT chrom, sum(e - s) AS covered, max(e) AS last FROM loci GROUP BY chrom),
a AS (SELECT chrom, covered, last FROM c UNION ALL SELECT NULL, sum(covered), sum(last) FROM c) SELECT chrom, CAST(covered AS BIGINT) AS covered, CAST(last AS BIGINT) AS last, round(CAST(covered AS DOUBLE) / last, 6) AS share FROM a""")
def a11_coverage(spark, sf_dir):
    from ..operators.enrichment import coverage

    return rounded(coverage(loci(spark, sf_dir)))


@query(f"""WITH {SITES}, l AS (SELECT *, CASE WHEN name = 'error' THEN 'E' || site_id END AS given, CASE WHEN name = 'view' THEN NULL ELSE name END AS own FROM sites)
SELECT site_id, coalesce(own, last_value(given IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY site_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS name FROM l""")
def w5_carried_names(spark, sf_dir):
    rows = sites(spark, sf_dir).select("site_id", "chrom", F.when(F.col("name") != "view", F.col("name")).alias("name"), F.when(F.col("name") == "error", F.concat(F.lit("E"), F.col("site_id").cast("string"))).alias("given"))
    return gene_ops.carried_names(rows, part="chrom", line="site_id").select("site_id", "name")


@query(f"""WITH {SITES} SELECT a.site_id, b.site_id AS hit_id FROM sites a JOIN sites b ON a.chrom = b.chrom AND a.name = 'purchase' AND b.name = 'error' AND abs(b.us - a.us) <= 3600000000""".replace("pos AS s,", "pos AS s, epoch_us(ts) AS us,"))
def st1_event_time_join(spark, sf_dir):
    from ..streaming.interval_join import near_events

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("chrom", F.col("user_id").cast("string"))
    a = e.where("event_type = 'purchase'").select("chrom", "ts", F.col("event_id").alias("site_id"))
    b = e.where("event_type = 'error'").select("chrom", "ts", F.col("event_id").alias("hit_id"))
    return near_events(a, b, within="1 hour").select("site_id", "hit_id")
