"""Names, labels and numbers in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_blank(c: Column) -> Column:
    """Without spaces, tabs and line ends on both sides."""
    return F.trim(c, F.lit(" \t\r\n"))


def basename(c: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def short_motif_name(path: Column) -> Column:
    """The file name up to its second underscore; all of it if it has fewer."""
    return F.substring_index(basename(path), "_", 2)


def pretty_motif(c: Column) -> Column:
    """A_B... as A (B); a name without underscore stays."""
    parts = F.split(c, "_")
    return F.when(F.instr(c, "_") > 0, F.concat(parts[0], F.lit(" ("), parts[1], F.lit(")"))).otherwise(c)


def tf_name(c: Column) -> Column:
    """The first token before an underscore or space."""
    return F.split(c, "[_ ]")[0]


def name_tokens(c: Column) -> Column:
    """Tokens of a motif name, cut at space, underscore and parentheses; no empty ones."""
    return F.filter(F.split(c, "[ _()]"), lambda x: x != "")


def file_safe(c: Column) -> Column:
    """/ : ( ) become -."""
    return F.translate(c, "/:()", "----")


def region_label(name: Column, chrom: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.concat(name, F.lit(" "), chrom, F.lit(" "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" "), strand)


def whole_number(c: Column) -> Column:
    """Text that is a number, in digits, point, sign and exponent, as a whole number (half to even);
    null for other text."""
    return F.when(c.rlike(r"^[0-9.eE+-]+$"), F.rint(c.try_cast("double")).cast("long"))


def gene_list(c: Column) -> Column:
    """Names separated by commas and blanks."""
    return F.filter(F.split(c, r"[,\s]+"), lambda x: x != "")


def attribute(c: Column, key: str) -> Column:
    """The quoted value after a key in an attribute column; null if it isn't there."""
    found = F.regexp_extract(c, rf'(?:^|[;\s]){key} "([^"]*)"', 1)
    return F.when(found != "", found)


def log_ratio(a: Column, b: Column) -> Column:
    """log2(a / b); null where either isn't above 0."""
    return F.log2(F.when((a > 0) & (b > 0), a / b))


def log_plus_one(c: Column) -> Column:
    return F.log2(1 + c)


def log_difference(a: Column, b: Column) -> Column:
    return log_plus_one(a) - log_plus_one(b)


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant digits (half to even)."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.when(c != 0, c)))) - (digits - 1))
    return F.when(c == 0, c).otherwise(F.rint(c / scale) * scale)


def variation(deviation: Column, mean: Column) -> Column:
    """Coefficient of variation; null for a mean of 0."""
    return F.try_divide(deviation, mean)


def six_digits(c: Column) -> Column:
    """A number as C++ streams write it: six significant digits, without trailing zeros, with an exponent below
    1e-4 and from 1e6 on."""
    text = F.format_string("%.5e", F.abs(c))
    digits, exponent = F.concat(F.substring(text, 1, 1), F.substring(text, 3, 5)), F.substring_index(text, "e", -1)
    e = exponent.try_cast("int")
    shown = lambda whole, part: F.regexp_replace(F.concat(whole, F.lit("."), part), r"\.?0*$", "")
    plain = F.when(e < 0, shown(F.lit("0"), F.concat(F.repeat(F.lit("0"), -e - 1), digits))).otherwise(shown(F.substr(digits, F.lit(1), e + 1), F.substr(digits, e + 2)))
    scientific = F.concat(shown(F.substring(digits, 1, 1), F.substring(digits, 2, 5)), F.lit("e"), exponent)
    number = F.when(c == 0, "0").when((e < -4) | (e > 5), scientific).otherwise(plain)
    number = F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "inf").otherwise(number)
    return F.when(c < 0, F.concat(F.lit("-"), number)).otherwise(number)


def short_name(name: str) -> str:
    """Of a motif's file: up to the second underscore."""
    return "_".join(name.split("_")[:2])
