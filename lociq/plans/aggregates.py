"""Queries on the long context table: sums, gated ratios, fractions, enrichment, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import chosen, confirmed, confirmed_at_least, displayable, eligible, enriched, present, relevant, shows_enrichment
from ..functions.regions import promoter
from ..functions.text import log_difference, log_plus_one, log_ratio, significant, variation
from ..operators import cofactors
from ..operators import enrichment as E
from ..operators import statistics as S
from ..operators.ranking import cumulative_from_top, extremes, first_per, ranked, ranked_overall, with_interest
from ..operators.reshape import bound, joined_regions, labelled_union, melted, selective, side_by_side, split_by_sets
from ..shared import stored
from .registry import registry
from .stand_ins import CONTEXT, GENES, SITES, context, genes, rounded, sites, table

query, QUERIES, ORACLES = registry()
TA, DN, GFP = (f"tp73_skmel29_2_{i}" for i in ("TA", "DN", "GFP"))


LINE = "skmel29_2"


def any_confirmed():
    return confirmed({"tp73", "pos"}, "any", cell_line=LINE)


_ANY = "((ta > 0 OR dn > 0) AND (pta > 0 OR pdn > 0))"


@query(f"""WITH {CONTEXT} SELECT motif, chrom, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS sum_n, round(avg(n), 6) AS mean_n, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS n_present, round(avg(CAST(n > 0 AS INTEGER)), 6) AS mean_present
FROM context WHERE {_ANY} GROUP BY GROUPING SETS ((motif, chrom), (motif))""")
def a2_a3_chromosome_sums(spark, sf_dir):
    return rounded(E.chromosome_sums(context(spark, sf_dir), any_confirmed()))


@query(f"""WITH {CONTEXT} SELECT motif, CAST(sum(CASE WHEN ta >= 5 THEN n ELSE 0 END) AS BIGINT) AS sum_ta, count(*) FILTER (WHERE ta >= 5) AS n_ta, CAST(sum(CASE WHEN dn >= 8 THEN n ELSE 0 END) AS BIGINT) AS sum_dn, count(*) FILTER (WHERE dn >= 8) AS n_dn FROM context GROUP BY motif""")
def a4_gated_sums(spark, sf_dir):
    return E.gated_sums(context(spark, sf_dir), {"ta": F.col(TA) >= 5, "dn": F.col(DN) >= 8})


LEVELS = (50, 75, 90, 95, 99)
TRACKS = {"ta": TA, "dn": DN, "gfp": GFP}


def _thresholds(spark, sf_dir):
    """Quantiles of the signals over all rows, 0.5 at least."""
    long = context(spark, sf_dir).select(*(F.col(c).alias(n) for n, c in TRACKS.items())).unpivot([], list(TRACKS), "track", "value")
    rows = S.quantiles(long, ["track"], "value", [p / 100 for p in LEVELS]).collect()
    return {f"{r['track']}_{p}": max(r[f"q{i}"], 0.5) for r in rows for i, p in enumerate(LEVELS)}


_RATIOS = "round(((sum(n) FILTER (WHERE {c})) / CAST(nullif(count(*) FILTER (WHERE {c}), 0) AS DOUBLE)) / nullif((sum(n) FILTER (WHERE {b})) / CAST(nullif(count(*) FILTER (WHERE {b}), 0) AS DOUBLE), 0), 6)"
_Q = "q AS (SELECT " + ", ".join(f"greatest(quantile_cont({c}, {q / 100}), 0.5) AS {c}_{q}" for c in TRACKS for q in LEVELS) + " FROM context)"


@query(f"WITH {CONTEXT}, {_Q} SELECT motif, " + ", ".join(f"{_RATIOS.format(c=f'{c} >= {c}_{q}', b=f'{c} <= 1')} AS {c}_{q}" for c in TRACKS for q in LEVELS) + " FROM context, q GROUP BY motif")
def a5_gated_ratios(spark, sf_dir):
    q = _thresholds(spark, sf_dir)
    gates = {f"{n}_{p}": (F.col(c) >= q[f"{n}_{p}"], n) for n, c in TRACKS.items() for p in LEVELS}
    out = E.gated_ratios(context(spark, sf_dir), gates, {n: F.col(c) <= 1 for n, c in TRACKS.items()})
    return rounded(out.select("motif", *(F.col(x).alias(x.removeprefix("ratio_")) for x in out.columns if x != "motif")))


_AGAINST = [("ta", "dn"), ("ta", "gfp"), ("dn", "gfp")]


@query(f"""WITH r AS ({ORACLES["a5_gated_ratios"]}) SELECT motif, """ + ", ".join(f"round({a}_{p} / nullif({b}_{p}, 0), 4) AS {a}_{b}_{p}" for a, b in _AGAINST for p in LEVELS) + " FROM r")
def a6_ratio_of_ratios(spark, sf_dir):
    r = a5_gated_ratios(spark, sf_dir)
    return r.select("motif", *(F.round(F.try_divide(f"{a}_{p}", f"{b}_{p}"), 4).alias(f"{a}_{b}_{p}") for a, b in _AGAINST for p in LEVELS))


_TISSUE = "CASE WHEN row_key % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(f"""WITH {CONTEXT}, {_Q}, r AS (SELECT motif, {_TISSUE} AS tissue, """ + ", ".join(f"{_RATIOS.format(c=f'ta >= ta_{q}', b='ta <= 1')} AS ta_{q}" for q in LEVELS) + """ FROM context, q GROUP BY ALL)
SELECT x.motif, """ + ", ".join(f"round(x.ta_{q} / nullif(y.ta_{q}, 0), 4) AS ta_{q}" for q in LEVELS) + " FROM r x JOIN r y ON x.motif = y.motif AND x.tissue = 'even' AND y.tissue = 'odd'")
def a6_ratio_between_tissues(spark, sf_dir):
    """Ratios of ratios between two parts of the rows that stand for tissues."""
    q, rows = _thresholds(spark, sf_dir), context(spark, sf_dir)
    part = {"even": F.col("row_key") % 2 == 0, "odd": F.col("row_key") % 2 != 0}
    gates = {f"{t}_{p}": ((F.col(TA) >= q[f"ta_{p}"]) & mine, t) for t, mine in part.items() for p in LEVELS}
    r = rounded(E.gated_ratios(rows, gates, {t: (F.col(TA) <= 1) & mine for t, mine in part.items()}))
    return r.select("motif", *(F.round(F.try_divide(f"ratio_even_{p}", f"ratio_odd_{p}"), 4).alias(f"ta_{p}") for p in LEVELS))


@query(f"""WITH {CONTEXT}, {_Q} SELECT motif, round(avg(n) FILTER (WHERE dn >= dn_90 AND ta <= ta_50), 6) AS mean_n FROM context, q GROUP BY motif""")
def a7_exclusive_mean(spark, sf_dir):
    q = _thresholds(spark, sf_dir)
    return rounded(E.exclusive_mean(context(spark, sf_dir), F.col(DN), q["dn_90"], F.col(TA), q["ta_50"]))


@query(f"""WITH {CONTEXT} SELECT chrom, round(100.0 * count(*) FILTER (WHERE ta > 0) / count(*), 6) AS ta, round(100.0 * count(*) FILTER (WHERE dn > 0 AND prom) / nullif(count(*) FILTER (WHERE prom), 0), 6) AS dn_in_promoter,
round(100.0 * count(*) FILTER (WHERE ta > 0 AND dn > 0) / nullif(count(*) FILTER (WHERE dn > 0), 0), 6) AS ta_if_dn, round(100.0 * count(*) FILTER (WHERE ta > 0 AND dn = 0) / count(*), 6) AS only_ta FROM context GROUP BY chrom""")
def a8_fractions(spark, sf_dir):
    ta, dn, prom = F.col(TA) > 0, F.col(DN) > 0, F.col("in_promoter")
    return rounded(E.fractions(context(spark, sf_dir), "chrom", {"ta": (ta, None), "dn_in_promoter": (dn, prom), "ta_if_dn": (ta, dn), "only_ta": (ta & (F.col(DN) == 0), None)}))


@query(f"""WITH {CONTEXT} SELECT motif, count(score) AS n, round(min(score), 8) AS least, round(quantile_cont(score, 0.25), 8) AS q1, round(quantile_cont(score, 0.5), 8) AS median, round(avg(score), 8) AS mean, round(quantile_cont(score, 0.75), 8) AS q3, round(max(score), 8) AS most, round(stddev_samp(score), 8) AS sd FROM context GROUP BY motif""")
def a9_summary(spark, sf_dir):
    return rounded(S.summary(context(spark, sf_dir), ["motif"], "score"), 8)


@query("SELECT o_custkey AS gene, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY o_custkey")
def a10_mean_per_gene(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("gene")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean"))


@query(f"""WITH {CONTEXT} SELECT CAST(floor(score / 3) AS BIGINT) AS bin, count(*) AS n, round(avg(CAST(dn > 0 AS INTEGER)), 6) AS dn, round(avg(CAST(ta > 0 AS INTEGER)), 6) AS ta FROM context WHERE score >= 0 AND floor(score / 3) < (SELECT floor(max(score) / 3) FROM context) GROUP BY 1""")
def a12_score_bins(spark, sf_dir):
    return rounded(E.score_bins(context(spark, sf_dir), "score", 3.0, {"dn": F.col(DN) > 0, "ta": F.col(TA) > 0}))


@query(f"""WITH {CONTEXT} SELECT chrom, round((greatest(count(*) FILTER (WHERE (ta >= 7 OR dn >= 9) AND prom), 0.1) / CAST(count(*) FILTER (WHERE prom) AS DOUBLE)) / (greatest(count(*) FILTER (WHERE (ta >= 7 OR dn >= 9) AND NOT prom), 0.1) / CAST(count(*) FILTER (WHERE NOT prom) AS DOUBLE)), 6) AS ratio FROM context GROUP BY chrom""")
def a13_inside_outside(spark, sf_dir):
    return rounded(E.inside_outside_ratio(context(spark, sf_dir), "chrom", (F.col(TA) >= 7) | (F.col(DN) >= 9), F.col("in_promoter")))


_CASES = {"ta": ("ta >= 3 AND prom", ({"tp73", "promoter"}, "TA")), "pos_up": ("pta >= pgfp OR pdn >= pgfp OR pgfp >= pgfp", ({"pos-up"}, "any")), "both": ("ta >= 3 AND dn >= 3 AND pta >= 3 AND pdn >= 3", ({"tp73", "pos"}, "TAandDN"))}


def _conditions():
    return {k: confirmed_at_least(*args, cell_line=LINE, least=3) for k, (_, args) in _CASES.items()}


@query(f"WITH {CONTEXT} SELECT motif, " + ", ".join(f"count(*) FILTER (WHERE n > 0 AND ({c})) AS {k}" for k, (c, _) in _CASES.items()) + " FROM context GROUP BY motif")
def a14_f24_cofactor_counts(spark, sf_dir):
    return E.cofactor_counts(context(spark, sf_dir), _conditions())


@query(f"WITH {CONTEXT} SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, (c, _) in _CASES.items()) + " FROM context")
def a15_site_counts(spark, sf_dir):
    return E.site_counts(context(spark, sf_dir), _conditions())


_ISOFORM = {"ignored": "TRUE", "TA": "{ta} >= 2", "DN": "{dn} >= 2", "GFP": "{gfp} >= 2", "any": "({ta} >= 2 OR {dn} >= 2 OR {gfp} >= 2)", "TAandDN": "{ta} >= 2 AND {dn} >= 2", "all": "{ta} >= 2 AND {dn} >= 2 AND {gfp} >= 2"}
_LINES = {"skmel29_2": {"ta": "ta", "dn": "dn", "gfp": "gfp"}, "saos2": {"ta": "pta", "dn": "pdn", "gfp": "pgfp"}}


@query(f"WITH {CONTEXT} " + " UNION ALL ".join(f"SELECT chrom, '{c}' AS cell_line, '{i}' AS isoform, '{w}' AS in_promoter, count(*) FILTER (WHERE {t.format(**cols)}{' AND prom' if w == 'yes' else ''}) AS n FROM context GROUP BY chrom" for c, cols in _LINES.items() for i, t in _ISOFORM.items() for w in ("maybe", "yes")))
def a15_table_of_all_conditions(spark, sf_dir):
    """Two cell lines, seven isoforms, in the promoter or anywhere, for each chromosome: 28 counts from one scan."""
    rows = context(spark, sf_dir)
    rows = rows.withColumnsRenamed({f"pos_skmel29_2_{i}": f"tp73_saos2_{i}" for i in ("TA", "DN", "GFP")})
    return E.isoform_table(rows, ["skmel29_2", "saos2"], least=2, by=["chrom"])


@query(f"""WITH {CONTEXT}, m AS (SELECT motif, avg(CAST(n > 0 AS INTEGER)) FILTER (WHERE ta > 4 AND prom) AS a, avg(CAST(n > 0 AS INTEGER)) AS b FROM context GROUP BY motif) SELECT motif, round(a, 6) AS mean_selected, round(b, 6) AS mean_all, round(log2(nullif(a / nullif(b, 0), 0)), 6) AS log_enrichment FROM m""")
def a16_a17_enrichment(spark, sf_dir):
    return rounded(E.enrichment(context(spark, sf_dir), (F.col(TA) > 4) & F.col("in_promoter")))


@query(f"""WITH {CONTEXT}, m AS (SELECT motif, avg(CAST(n > 0 AS INTEGER)) FILTER (WHERE ta > dn) AS a, avg(CAST(n > 0 AS INTEGER)) FILTER (WHERE dn > ta) AS b FROM context GROUP BY motif) SELECT motif, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(a / nullif(b, 0), 6) AS ratio FROM m""")
def a18_group_means(spark, sf_dir):
    return rounded(E.group_means(context(spark, sf_dir), F.col(TA) > F.col(DN), F.col(DN) > F.col(TA)))


@query(f"""WITH {CONTEXT} SELECT motif, prom, count(shift) AS n FROM context GROUP BY ALL""")
def a19_hits_per_set(spark, sf_dir):
    return context(spark, sf_dir).groupBy("motif", F.col("in_promoter").alias("prom")).agg(F.count("shift").alias("n"))


@query(f"""WITH {CONTEXT}, c AS (SELECT shift AS distance, least(gfp + dn + ta, 15) AS level, count(*) AS n FROM context WHERE shift IS NOT NULL GROUP BY ALL),
a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY distance ORDER BY level DESC) AS BIGINT) AS at_least FROM c) SELECT *, round(log2(1 + at_least / CAST(max(at_least) OVER (PARTITION BY level) AS DOUBLE)), 6) AS scaled FROM a""")
def a20_w4_coverage_by_distance(spark, sf_dir):
    rows = context(spark, sf_dir).where("shift IS NOT NULL").select(F.col("shift").alias("distance"), (F.col(GFP) + F.col(DN) + F.col(TA)).alias("coverage"))
    return rounded(E.coverage_by_distance(rows, 15))


@query(f"""WITH {CONTEXT}, c AS (SELECT motif, CAST(floor(shift / 2.0) * 2 AS BIGINT) AS bin, count(*) AS n FROM context WHERE shift IS NOT NULL GROUP BY ALL) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY motif) AS DOUBLE), 6) AS share FROM c""")
def a21_shift_histogram(spark, sf_dir):
    return rounded(E.shift_histogram(context(spark, sf_dir), "motif"))


@query(f"""WITH {CONTEXT} SELECT motif, chrom, round(max(CAST(ta + dn + gfp AS DOUBLE) + 0.01), 6) AS most FROM context GROUP BY ALL HAVING most >= 23""")
def a23_a24_signal_totals(spark, sf_dir):
    totals = E.signal_totals(context(spark, sf_dir), [TA, DN, GFP])
    return rounded(totals.groupBy("motif", "chrom").agg(F.max("signal_total").alias("most")).where("round(most, 6) >= 23"))


@query(f"""WITH {CONTEXT}, p AS (SELECT DISTINCT motif, chrom FROM context WHERE n = 3 AND ta = 8 AND prom), a AS (SELECT 'motif' AS side, motif AS name, count(*) AS n FROM p GROUP BY motif), b AS (SELECT 'chrom' AS side, chrom AS name, count(*) AS n FROM p GROUP BY chrom) SELECT * FROM a UNION ALL SELECT * FROM b""")
def a25_a27_presence_sums(spark, sf_dir):
    pairs = context(spark, sf_dir).where((F.col("num_in_window") == 3) & (F.col(TA) == 8) & F.col("in_promoter")).select("motif", "chrom").distinct()
    return labelled_union({side: pairs.groupBy(F.col(side).alias("name")).agg(F.count("*").alias("n")) for side in ("motif", "chrom")}, "side")


@query(f"""WITH {CONTEXT}, r AS (SELECT unnest(['all', CASE WHEN {_ANY} THEN 'confirmed' END, CASE WHEN prom THEN 'promoter' END]) AS part, shift FROM context WHERE shift IS NOT NULL) SELECT part, shift, count(*) AS n FROM r WHERE part IS NOT NULL GROUP BY ALL""")
def a26_distance_groups(spark, sf_dir):
    rows = context(spark, sf_dir).where("shift IS NOT NULL")
    parts = F.explode(F.array_compact(F.array(F.lit("all"), F.when(any_confirmed(), "confirmed"), F.when(F.col("in_promoter"), "promoter"))))
    return rows.select(parts.alias("part"), "shift").groupBy("part", "shift").agg(F.count("*").alias("n"))


@query(f"""WITH {CONTEXT} SELECT chrom, count(*) FILTER (WHERE ta > 0 AND pta > 0) AS ta, count(*) FILTER (WHERE (ta > 0 AND dn > 0) AND prom) AS both_in_promoter, count(*) FILTER (WHERE {_ANY}) AS any_pos FROM context GROUP BY chrom""")
def f23_confirmations(spark, sf_dir):
    cases = {"ta": confirmed({"tp73", "pos"}, "TA", cell_line=LINE), "both_in_promoter": confirmed({"tp73", "promoter"}, "all", cell_line=LINE), "any_pos": any_confirmed()}
    return context(spark, sf_dir).groupBy("chrom").agg(*(F.count_if(c).alias(k) for k, c in cases.items()))


@query("""SELECT l_orderkey AS k, count(*) FILTER (WHERE l_quantity / 20 >= 1.5 AND l_tax * 20 <= 1.25) AS ta, count(*) FILTER (WHERE l_tax * 20 >= 1.5 AND l_quantity / 20 <= 1.25) AS dn FROM lineitem GROUP BY 1""")
def f25_enriched_genes(spark, sf_dir):
    a, b = F.col("l_quantity") / 20, F.col("l_tax") * 20
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(enriched(a, b)).alias("ta"), F.count_if(enriched(b, a)).alias("dn"))


@query(f"""WITH m AS ({ORACLES["a16_a17_enrichment"]}) SELECT motif, abs(log_enrichment) > 0.1 AND isfinite(log_enrichment) AND mean_selected > 0 AS eligible, (log_enrichment > 0.1 OR log_enrichment < -0.1) AND mean_selected > 0.05 AS shown, log_enrichment > 0.1 AND mean_selected > 0.05 AS relevant FROM m""")
def f26_f30_f31_thresholds(spark, sf_dir):
    m, yes = a16_a17_enrichment(spark, sf_dir), F.lit(True)
    log, share = F.col("log_enrichment"), F.col("mean_selected")
    return m.select("motif", eligible(share, share, log, log, yes).alias("eligible"), shows_enrichment(log, share, yes).alias("shown"), relevant(log, share).alias("relevant"))


@query("SELECT c_custkey, round(log2(nullif(1 + abs(c_acctbal), 0)), 6) AS l1, round(log2(1 + abs(c_acctbal)) - log2(1 + c_nationkey), 6) AS difference, round(CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN log2(c_acctbal / c_nationkey) END, 6) AS ratio FROM customer")
def f21_f34_logs(spark, sf_dir):
    a, b = F.abs("c_acctbal"), F.col("c_nationkey")
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", log_plus_one(a).alias("l1"), log_difference(a, b).alias("difference"), log_ratio(F.col("c_acctbal"), b).alias("ratio")))


@query("SELECT p_partkey, round_even(p_size / 8.0, 2) AS even, CASE WHEN p_size = 0 THEN 0.0 ELSE round_even(p_size * 1000 / pow(10, floor(log10(p_size * 1000)) - 1), 0) * pow(10, floor(log10(p_size * 1000)) - 1) END AS two_digits FROM part")
def f22_rounding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(F.col("p_size") / 8.0, 2).alias("even"), significant((F.col("p_size") * 1000).cast("double"), 2).alias("two_digits"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS q{i}" for i, q in enumerate((0, 0.05, 0.25, 0.5, 0.75, 0.95, 1))) + " FROM lineitem GROUP BY ALL")
def s1_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    return rounded(S.quantiles(rows, ["flag", "status"], "l_extendedprice", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]), 4)


@query("SELECT " + ", ".join(f"round(quantile_cont(l_quantity, {i / 20}), 6) AS q{i}" for i in range(21)) + " FROM lineitem")
def s3_quantile_grid(spark, sf_dir):
    return rounded(S.quantiles(table(spark, sf_dir, "lineitem"), [], "l_quantity", [i / 20 for i in range(21)]))


@query(f"""WITH {CONTEXT} SELECT motif, round(stddev_samp(shift), 6) AS sd, round(median(shift), 6) AS median, round(avg(shift), 6) AS mean, round(stddev_samp(score) / nullif(avg(score), 0), 6) AS cv FROM context GROUP BY motif""")
def s4_f29_shift_spread(spark, sf_dir):
    rows = context(spark, sf_dir)
    spread = rows.groupBy("motif").agg(F.stddev_samp("shift").alias("sd"), F.avg("shift").alias("mean"), variation(F.stddev_samp("score"), F.avg("score")).alias("cv"))
    return rounded(spread.join(S.quantiles(rows, ["motif"], "shift", [0.5]).withColumnRenamed("q0", "median"), "motif", "left"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def w6_rank_of_all_rows(spark, sf_dir):
    return ranked_overall(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "rank")


@query("SELECT o_orderstatus AS s, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rank FROM orders")
def o3_order_within_groups(spark, sf_dir):
    """Row order as a column, within groups."""
    rows = ranked(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return rows.select(F.col("o_orderstatus").alias("s"), "o_orderkey", "rank")


_ENRICHED = "m AS (SELECT motif, avg(CAST(n > 0 AS INTEGER)) FILTER (WHERE ta > 4) AS a, avg(CAST(n > 0 AS INTEGER)) FILTER (WHERE dn > 4) AS b, avg(CAST(n > 0 AS INTEGER)) AS c FROM context GROUP BY motif)"


@query(f"""WITH {CONTEXT}, {_ENRICHED} SELECT motif, round(a, 6) AS mean_one, round(b, 6) AS mean_other, round(c, 6) AS mean_all, round(log2(nullif(a / c, 0)), 6) AS log_one, round(log2(nullif(b / c, 0)), 6) AS log_other, round(log2(nullif(a / nullif(b, 0), 0)), 6) AS log_ratio FROM m""")
def a16_compared_enrichment(spark, sf_dir):
    return rounded(E.compared_enrichment(context(spark, sf_dir), F.col(TA) > 4, F.col(DN) > 4))


@query(f"""WITH {CONTEXT} SELECT motif, chrom, CAST(sum(n) AS BIGINT) AS total FROM context WHERE ta = 8 AND prom GROUP BY ALL HAVING sum(n) > 0""")
def a27_present_sums(spark, sf_dir):
    sums = context(spark, sf_dir).where((F.col(TA) == 8) & F.col("in_promoter")).groupBy("motif", "chrom").agg(F.sum("num_in_window").alias("total"))
    return sums.where("total > 0")


@query(f"""WITH m AS ({ORACLES["a18_group_means"]}), t AS (SELECT motif, ratio FROM m ORDER BY ratio DESC, motif LIMIT 5) SELECT * FROM t UNION SELECT motif, ratio FROM m WHERE motif IN ('M0', 'M3', 'M19')""")
def f30_chosen_rows(spark, sf_dir):
    m = a18_group_means(spark, sf_dir).select("motif", "ratio")
    return chosen(m, [F.desc("ratio"), F.asc("motif")], "motif", 5, ["M0", "M3", "M19"])


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 5) AS r FROM lineitem WHERE {{w}}" for a, b in _PAIRS)


@query(_CORR.format(w="TRUE"))
def s5_correlations(spark, sf_dir):
    return rounded(S.correlations(table(spark, sf_dir, "lineitem"), _COLUMNS), 5)


_WIDE = f"""WITH {CONTEXT}, v AS (SELECT row_key AS site, motif, sum(n)::DOUBLE AS v FROM context WHERE {{gate}} GROUP BY 1, 2 HAVING sum(n) <> 0), t AS (SELECT count(DISTINCT row_key)::DOUBLE AS sites FROM context WHERE {{gate}}),
m AS (SELECT motif, sum(v) AS x, sum(v * v) AS xx FROM v GROUP BY motif), p AS (SELECT a.motif AS a, b.motif AS b, sum(a.v * b.v) AS xy FROM v a JOIN v b ON a.site = b.site AND a.motif < b.motif GROUP BY 1, 2),
r AS (SELECT a.motif AS a, b.motif AS b, CAST(sites AS BIGINT) AS n, (sites * coalesce(xy, 0) - a.x * b.x) / sqrt((sites * a.xx - a.x * a.x) * (sites * b.xx - b.x * b.x)) AS r
  FROM m a JOIN m b ON a.motif < b.motif CROSS JOIN t LEFT JOIN p ON p.a = a.motif AND p.b = b.motif)"""


def _cofactors(spark, sf_dir, gate):
    rows = context(spark, sf_dir).where(gate)
    return cofactors.sparse_correlations(rows, rows.select("row_key").distinct().count(), site="row_key")


@query(_WIDE.format(gate="TRUE") + " SELECT a, b, n, round(r, 9) AS r FROM r")
def s5_cofactor_correlations(spark, sf_dir):
    """All motifs of the context table against each other, from its long form."""
    return rounded(_cofactors(spark, sf_dir, F.lit(True)), 9)


@query(f"""WITH one AS ({_WIDE.format(gate="ta > 4")} SELECT * FROM r), two AS ({_WIDE.format(gate="dn > 4")} SELECT * FROM r), d AS (SELECT a, b, one.r - two.r AS difference FROM one JOIN two USING (a, b))
SELECT a, b, round(difference, 9) AS difference, round(difference / (SELECT max(abs(difference)) FROM d), 9) AS scaled FROM d""")
def s9_cofactor_differences(spark, sf_dir):
    """The correlations at sites of the one isoform less those at sites of the other."""
    one, two = (stored(_cofactors(spark, sf_dir, F.col(c) > 4), "cofactors") for c in (TA, DN))
    return rounded(S.correlation_difference(one, two).select("a", "b", "difference", "scaled"), 9)


@query()
def s10_clustering_order(spark, sf_dir):
    """The motifs in the order of their clustering, with the height at which each joins what stands before it."""
    merges, leaves = cofactors.clustering(stored(_cofactors(spark, sf_dir, F.lit(True)), "cofactors"))
    return leaves.join(merges.select(F.col("right").alias("name"), F.round("height", 9).alias("height"), "step"), "name", "left")


@query(f"""WITH x AS ({_CORR.format(w="l_returnflag = 'A'")}), y AS ({_CORR.format(w="l_returnflag = 'N'")}), d AS (SELECT x.a, x.b, x.r - y.r AS d FROM x JOIN y USING (a, b)) SELECT a, b, round(d, 5) AS difference FROM d""")
def s9_correlation_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    one, two = (rounded(S.correlations(rows.where(F.col("l_returnflag") == f), _COLUMNS), 5) for f in ("A", "N"))
    return rounded(S.correlation_difference(one, two).select("a", "b", "difference"), 5)


_RANKS = "rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0"


@query(f"""WITH r AS (SELECT l_returnflag AS flag, {_RANKS.format(c="l_quantity")} AS a, {_RANKS.format(c="l_extendedprice")} AS b FROM lineitem) SELECT flag, count(*) AS n, round(corr(a, b), 5) AS rho FROM r GROUP BY flag""")
def s6_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rounded(S.spearman(rows, ["flag"], "l_quantity", "l_extendedprice").select("flag", "n", "rho"), 5)


@query(None)
def s6_spearman_p(spark, sf_dir):
    """Quantity against day of shipping: t and its p value (Student's distribution isn't in SQL)."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"flag": F.col("l_returnflag"), "day": F.dayofmonth("l_shipdate")})
    return S.spearman(rows, ["flag"], "l_quantity", "day")


@query(f"""WITH r AS (SELECT l_returnflag AS flag, l_linestatus = 'O' AS g, l_quantity, {_RANKS.format(c="l_quantity")} AS a FROM lineitem),
t AS (SELECT flag, sum(c * c * c - c) AS ties FROM (SELECT flag, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY flag, l_quantity) GROUP BY flag),
s AS (SELECT flag, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2, sum(a) FILTER (WHERE g) AS rs FROM r GROUP BY flag),
w AS (SELECT s.*, rs - n1 * (n1 + 1) / 2.0 AS w, ties FROM s JOIN t USING (flag))
SELECT flag, n1, n2, round(w, 5) AS w, round((w - n1 * n2 / 2.0 - sign(w - n1 * n2 / 2.0) * 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * CAST(n1 + n2 - 1 AS DOUBLE)))), 5) AS z FROM w""")
def s7_wilcoxon(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag").withColumn("g", F.col("l_linestatus") == "O")
    return rounded(S.wilcoxon(rows, ["flag"], "g", "l_quantity").drop("p"), 5)


@query(None)
def s7_wilcoxon_p(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag").withColumn("g", F.col("l_linestatus") == "O")
    return S.wilcoxon(rows, ["flag"], "g", "l_quantity")


@query(f"""WITH {CONTEXT}, b AS (SELECT prom, CAST(round(shift / 5.0) AS BIGINT) AS cell, count(*) AS n FROM context WHERE shift IS NOT NULL GROUP BY ALL), t AS (SELECT prom, sum(n) AS total FROM b GROUP BY prom),
g AS (SELECT prom, cell + d AS cell, sum(n * exp(-0.5 * pow(d * 5 / 10.0, 2)) / (10.0 * sqrt(2 * pi()))) AS mass FROM b, range(-8, 9) r(d) GROUP BY ALL) SELECT prom, CAST(cell * 5 AS DOUBLE) AS x, round(mass / total, 7) AS density FROM g JOIN t USING (prom)""")
def s8_density(spark, sf_dir):
    rows = context(spark, sf_dir).select(F.col("in_promoter").alias("prom"), "shift")
    return rounded(S.density(rows, ["prom"], "shift", 5.0, 10.0), 7)


_BAND = f"""WITH {CONTEXT}, q AS (SELECT prom, count(shift) AS n, min(shift)::DOUBLE AS lo, max(shift)::DOUBLE AS hi, stddev_samp(shift) AS sd, quantile_cont(shift, 0.25) AS q1, quantile_cont(shift, 0.75) AS q3 FROM context GROUP BY prom),
b AS (SELECT prom, n, lo, hi, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2) AS h FROM q), w AS (SELECT *, lo - 3 * h AS low, (hi - lo + 6 * h) / 511 AS step FROM b),
p AS (SELECT w.*, (shift - low) / step AS z FROM context JOIN w USING (prom) WHERE shift IS NOT NULL), f AS (SELECT *, least(floor(z), 510) AS i FROM p),
m AS (SELECT prom, h, n, low, step, i, sum(m) AS m FROM (SELECT prom, h, n, low, step, i, 1 - (z - i) AS m FROM f UNION ALL SELECT prom, h, n, low, step, i + 1, z - i FROM f) GROUP BY ALL)"""


@query(f"{_BAND} SELECT prom, n, round(h, 9) AS bandwidth FROM b")
def s8_bandwidth(spark, sf_dir):
    rows = context(spark, sf_dir).select(F.col("in_promoter").alias("prom"), "shift")
    return rounded(S.bandwidths(rows, ["prom"], "shift").select("prom", "n", "bandwidth"), 9)


@query(f"{_BAND} SELECT prom, CAST(t.k AS INTEGER) AS place, round(low + t.k * step, 6) AS x, round(sum(m * exp(-0.5 * pow((t.k - i) * step / h, 2)) / (h * sqrt(2 * pi()) * n)), 9) AS density FROM m, range(512) t(k) GROUP BY prom, low, step, t.k")
def s8_density_grid(spark, sf_dir):
    """Densities of the distances, with a bandwidth from the data, on 512 places."""
    rows = context(spark, sf_dir).select(F.col("in_promoter").alias("prom"), "shift")
    return S.density_grid(rows, ["prom"], "shift").select("prom", "place", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(f"""WITH {CONTEXT} SELECT CAST(floor(score) AS BIGINT) AS bin, round(avg(CAST(ta = 0 AS INTEGER)), 6) AS ta, round(avg(CAST(dn = 0 AS INTEGER)), 6) AS dn FROM context GROUP BY 1""")
def s11_s12_zero_shares(spark, sf_dir):
    rows = context(spark, sf_dir).groupBy(F.floor("score").alias("bin")).agg(F.avg((F.col(TA) == 0).cast("int")).alias("ta"), F.avg((F.col(DN) == 0).cast("int")).alias("dn"))
    return rounded(rows)


@query(f"""WITH m AS ({ORACLES["a18_group_means"]}), t AS (SELECT *, 'top' AS side FROM m ORDER BY ratio DESC, motif LIMIT 3), b AS (SELECT *, 'bottom' AS side FROM m ORDER BY ratio, motif LIMIT 3), e AS (SELECT * FROM t UNION ALL SELECT * FROM b)
SELECT * FROM e UNION ALL SELECT *, 'interest' FROM m WHERE regexp_matches(motif, '^M1') AND motif NOT IN (SELECT motif FROM e)""")
def l1_l4_extremes_and_interest(spark, sf_dir):
    return with_interest(a18_group_means(spark, sf_dir), "ratio", "motif", 3, "^M1")


@query("""WITH t AS (SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20), b AS (SELECT o_orderkey, o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20) SELECT * FROM t UNION ALL SELECT * FROM b""")
def l1_l3_top_and_bottom(spark, sf_dir):
    return extremes(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20)


@query(f"""WITH {GENES}, q AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY line) AS place FROM genes) SELECT gene, line FROM q WHERE place = 1""")
def l6_first_per_gene(spark, sf_dir):
    return first_per(genes(spark, sf_dir), "gene", [F.asc("line")]).select("gene", "line")


@query(f"""WITH m AS ({ORACLES["a18_group_means"]}) SELECT motif, CAST(row_number() OVER (ORDER BY ratio DESC, motif) AS INTEGER) AS rank FROM m""")
def w6_o2_ranks(spark, sf_dir):
    return ranked_overall(a18_group_means(spark, sf_dir), "ratio", ["motif"]).select("motif", "rank")


@query("""WITH c AS (SELECT o_orderstatus AS s, CAST(floor(o_totalprice / 50000) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY ALL) SELECT s, level, n, CAST(sum(n) OVER (PARTITION BY s ORDER BY level DESC) AS BIGINT) AS at_least FROM c""")
def w4_cumulative(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.floor(F.col("o_totalprice") / 50000).alias("level")).agg(F.count("*").alias("n"))
    return cumulative_from_top(counts, "s", "level", "n")


_SETS = "a AS (SELECT DISTINCT p_name AS x FROM part WHERE p_size > 25), b AS (SELECT DISTINCT p_name AS x FROM part WHERE p_type = 'SMALL')"


@query(f"WITH {_SETS} SELECT 'both' AS part, x FROM (SELECT x FROM a INTERSECT SELECT x FROM b) UNION ALL SELECT 'only_a', x FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT 'any', x FROM (SELECT x FROM a UNION SELECT x FROM b)")
def g2_g5_set_operations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a, b = (part.where(c).select(F.col("p_name").alias("x")).distinct() for c in (F.col("p_size") > 25, F.col("p_type") == "SMALL"))
    return labelled_union({"both": a.intersect(b), "only_a": a.subtract(b), "any": a.union(b).distinct()})


@query("SELECT s_suppkey, variable, value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier) UNPIVOT (value FOR variable IN (s_nationkey, s_acctbal))")
def g6_g7_melt(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double"))
    return melted(rows, ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query(f"""WITH {CONTEXT}, m AS (SELECT motif, chrom, avg(n) AS v FROM context WHERE ta = 8 AND prom GROUP BY ALL) SELECT motif, """ + ", ".join(f'round(coalesce(max(v) FILTER (WHERE chrom = \'{c}\'), 100), 6) AS "{c}"' for c in range(6)) + " FROM m GROUP BY motif")
def g8_side_by_side(spark, sf_dir):
    means = context(spark, sf_dir).where((F.col(TA) == 8) & F.col("in_promoter")).groupBy("motif", "chrom").agg(F.avg("num_in_window").alias("v"))
    return rounded(side_by_side(means, "motif", "chrom", [str(c) for c in range(6)], "v", 100.0))


@query(f"""WITH {GENES}, s AS (SELECT DISTINCT 'G' || c_custkey AS gene, c_mktsegment AS set_name FROM customer) SELECT s.set_name, count(*) AS n, count(DISTINCT gene) AS genes FROM genes g JOIN s USING (gene) GROUP BY s.set_name""")
def g9_split_by_sets(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("gene"), F.col("c_mktsegment").alias("set_name"))
    return split_by_sets(genes(spark, sf_dir).drop("set_name"), members, "gene").groupBy("set_name").agg(F.count("*").alias("n"), F.count_distinct("gene").alias("genes"))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'P') AS b FROM orders GROUP BY 1) SELECT k, a, b, CASE WHEN b = 0 AND a >= 7 THEN 'only_a' ELSE 'only_b' END AS side FROM c WHERE (b = 0 AND a >= 7) OR (b >= 2 AND a <= 1)""")
def g10_selective_sets(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("b"))
    return selective(counts, "a", "b")


@query(f"""WITH {GENES}, x AS (SELECT gene, min(s) AS s, max(e) AS e, count(*) AS n FROM genes WHERE strand = '+' GROUP BY 1), y AS (SELECT gene, min(s) AS s, max(e) AS e, count(*) AS n FROM genes WHERE strand = '-' GROUP BY 1) SELECT gene, least(x.s, y.s) AS start, greatest(x.e, y.e) AS "end", x.n + y.n AS n FROM x JOIN y USING (gene)""")
def g11_joined_regions(spark, sf_dir):
    side = lambda s: genes(spark, sf_dir).where(F.col("strand") == s).groupBy("gene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return joined_regions(side("+"), side("-"), "gene", ["n"])


@query(f"""WITH {CONTEXT} SELECT motif, count(*) AS n, round(avg(score), 6) AS mean, CAST(sum(n) AS BIGINT) AS total FROM context GROUP BY motif""")
def j15_bound_columns(spark, sf_dir):
    """Two tables of the same motifs side by side."""
    by = context(spark, sf_dir).groupBy("motif")
    return rounded(bound(by.agg(F.count("*").alias("n"), F.avg("score").alias("mean")), by.agg(F.sum("num_in_window").alias("total")), "motif"))


@query(f"""WITH {SITES} SELECT chrom, name, count(*) AS n, min(s) AS first FROM sites GROUP BY ALL""")
def g1_o1_all_chromosomes(spark, sf_dir):
    return sites(spark, sf_dir).groupBy("chrom", "name").agg(F.count("*").alias("n"), F.min("start").alias("first")).orderBy("chrom", "first", "name")


@query("""SELECT s_suppkey, s_acctbal > 5000 AS strong, count_signals AS n_signals FROM (SELECT *, CAST(s_nationkey % 4 > 0 AS INTEGER) + CAST(s_acctbal > 0 AS INTEGER) AS count_signals FROM supplier)""")
def f19_f27_column_group(spark, sf_dir):
    """Columns of a group are found by their names' ending."""
    rows = table(spark, sf_dir, "supplier").withColumns({"a_NumInWindow": F.col("s_nationkey") % 4, "b_NumInWindow": F.col("s_acctbal"), "b_Score": F.lit(1.0)})
    group = rows.select(rows.colRegex("`.*_NumInWindow$`")).columns
    n = F.lit(0)
    for c in group:
        n = n + present(F.col(c))
    return rows.select("s_suppkey", (F.col("s_acctbal") > 5000).alias("strong"), n.alias("n_signals"))


@query(f"""WITH m AS ({ORACLES["a18_group_means"]}) SELECT motif, ratio FROM m WHERE mean_a + mean_b > 0.0005 ORDER BY ratio DESC, motif LIMIT 7""")
def f32_l3_displayable(spark, sf_dir):
    m = a18_group_means(spark, sf_dir)
    return m.where(displayable(F.col("mean_a"), F.col("mean_b"))).orderBy(F.desc("ratio"), "motif").limit(7).select("motif", "ratio")


@query(f"""WITH {GENES} SELECT transcript, CASE WHEN strand = '-' THEN e - 50 ELSE s - 300 END AS ps, CASE WHEN strand = '-' THEN e + 300 ELSE s + 50 END AS pe, CASE WHEN strand = '-' THEN s ELSE s - 300 END AS ws, CASE WHEN strand = '-' THEN e + 300 ELSE e END AS we FROM genes""")
def f15_promoter_regions(spark, sf_dir):
    args = (F.col("start"), F.col("end"), F.col("strand"), F.lit(300))
    rows = genes(spark, sf_dir).select("transcript", promoter(*args, F.lit(50)).alias("p"), promoter(*args, F.lit(None).cast("long")).alias("w"))
    return rows.select("transcript", *(F.col(f"{a}.{b}").alias(f"{a}{b[0]}") for a in "pw" for b in ("start", "end")))
