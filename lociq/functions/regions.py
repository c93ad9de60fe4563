"""Regions derived from a stranded interval, as (start, end) structs. Bounds are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _stranded(strand: Column, plus: Column, minus: Column) -> Column:
    return F.when(strand == "-", minus).otherwise(plus)


def upstream(start: Column, end: Column, strand: Column, nearest: int = 1, farthest: int = 500) -> Column:
    """The promoter: +: [start - farthest, start - nearest]; -: [end + nearest, end + farthest]. Null
    unless end > start."""
    return F.when(end > start, _stranded(strand, _pair(start - farthest, start - nearest), _pair(end + nearest, end + farthest)))


def downstream(start: Column, end: Column, strand: Column, nearest: int = 1, farthest: int = 500) -> Column:
    """The first bases of the transcript (utr)."""
    return F.when(end > start, _stranded(strand, _pair(start + (nearest - 1), start + (farthest - 1)), _pair(end - (farthest - 1), end - (nearest - 1))))


def promoter(start: Column, end: Column, strand: Column, before: Column, inside: Column) -> Column:
    """`before` bases upstream to `inside` bases into the gene; the whole gene where inside is null."""
    low, high = F.least(start, end), F.greatest(start, end)
    return _stranded(strand, _pair(low - before, F.coalesce(low + inside, high)), _pair(F.coalesce(high - inside, low), high + before))


def shifted(start: Column, end: Column, strand: Column, by: int = 500) -> Column:
    """Moved downstream; on - not below 0. A strand other than - counts as +."""
    return _stranded(strand, _pair(start + by, end + by), _pair(F.greatest(start - by, F.lit(0)), F.greatest(end - by, F.lit(0))))


def location(site_start: Column, site_end: Column, gene_start: Column, gene_end: Column) -> Column:
    return F.when((site_start >= gene_start) & (site_end <= gene_end), "Intragenic").otherwise("Promoter")
