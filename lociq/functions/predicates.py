"""Which sites count as confirmed. The two vocabularies use the same words with other meanings, so
they are two functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def confirmed(confirmation: set[str], isoform: str, *, cell_line: str, in_promoter: str = "in_promoter") -> Column:
    """confirmation: any of none, tp73, pos, promoter; isoform: TA, DN, all (TA and DN), any (TA or DN)."""
    if unknown := confirmation - {"none", "tp73", "pos", "promoter"}:
        raise ValueError(f"unknown confirmation {unknown}")

    def signal(target: str) -> Column:
        ta, dn = (F.col(f"{target}_{cell_line}_{i}") > 0 for i in ("TA", "DN"))
        return {"TA": ta, "DN": dn, "all": ta & dn, "any": ta | dn}[isoform]

    return _all([signal(t) for t in ("tp73", "pos") if t in confirmation] + ([F.col(in_promoter)] if "promoter" in confirmation else []))


def confirmed_at_least(confirmation: set[str], isoform: str, *, cell_line: str, least: int = 1, in_promoter: str = "in_promoter") -> Column:
    """As confirmed(), with signals of `least` or more, any and all including GFP, TAandDN, ignored, and
    pos-up: the pos signal is at least that of GFP."""
    if unknown := confirmation - {"none", "tp73", "pos", "pos-up", "promoter"}:
        raise ValueError(f"unknown confirmation {unknown}")

    def signal(test) -> Column:
        ta, dn, gfp = (test(i) for i in ("TA", "DN", "GFP"))
        return {"TA": ta, "DN": dn, "GFP": gfp, "any": ta | dn | gfp, "TAandDN": ta & dn, "all": ta & dn & gfp, "ignored": F.lit(True)}[isoform]

    out = [signal(lambda i, t=t: F.col(f"{t}_{cell_line}_{i}") >= least) for t in ("tp73", "pos") if t in confirmation]
    if "pos-up" in confirmation:
        out.append(signal(lambda i: F.col(f"pos_{cell_line}_{i}") >= F.col(f"pos_{cell_line}_GFP")))
    return _all(out + ([F.col(in_promoter)] if "promoter" in confirmation else []))


def enriched(mine: Column, other: Column) -> Column:
    """A gene's fold change is 1.5 or more under one isoform and 1.25 or less under the other."""
    return (mine >= 1.5) & (other <= 1.25)


def eligible(mean_a: Column, mean_b: Column, log_a: Column, log_b: Column, human: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.abs(c) > 0.1)
    return ((mean_a > 0) | (mean_b > 0)) & finite(log_a) & finite(log_b) & human


def shows_enrichment(log_enrichment: Column, frequency: Column, human: Column) -> Column:
    """Far enough from no enrichment, and frequent enough."""
    return human & ((log_enrichment > 0.1) | (log_enrichment < -0.1)) & (frequency > 0.05)


def relevant(log_enrichment: Column, frequency: Column) -> Column:
    return (log_enrichment > 0.1) & (frequency > 0.05)


def displayable(mean_a: Column, mean_b: Column) -> Column:
    return mean_a + mean_b > 0.0005


def present(n: Column) -> Column:
    return (n > 0).cast("int")


def chosen(rows: DataFrame, order: list[Column], name: str, first: int, always: list[str]) -> DataFrame:
    """The first n rows that have a name, in order, and all rows whose name is asked for always."""
    named = rows.where(F.col(name).isNotNull() & (F.col(name) != ""))
    top = named.orderBy(*order).limit(first)
    return top.unionByName(named.where(F.col(name).isin(always)).join(top.select(name), name, "left_anti").select(*top.columns))
