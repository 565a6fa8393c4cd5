"""Column builders for printed money.  Amounts stay strings; numbers are derived beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import blank_to_null, text, trim_ws


def format_cents(cents: Column) -> Column:
    """Whole cents as ``1.234,56``."""
    units = ((F.abs(cents) - F.abs(cents) % 100) / 100).cast("long").cast("string")
    grouped = F.regexp_replace(units, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ".")
    sign = F.when(cents < 0, "-").otherwise("")
    return F.concat(sign, grouped, F.lit(","), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def format_number(c: Column) -> Column:
    """A numeric column as ``1.234,56``; rounds half away from zero."""
    cents = (F.round(c.cast("string").cast("decimal(38,10)"), 2) * 100).cast("long")
    return F.coalesce(format_cents(cents), F.lit(""))


def is_zero(c: Column) -> Column:
    """Blank or one of the printed zeros."""
    return text(c).isin(vocab.ZERO_MONEY)


def parse_currency(c: Column) -> Column:
    """Digits, comma, dot and minus only; dots dropped; the first comma is the decimal mark."""
    kept = F.regexp_replace(F.regexp_replace(text(c), r"[^0-9,.\-]", ""), r"\.", "")
    number = F.regexp_replace(kept, "^([^,]*),", "$1.")
    strict = F.when(number.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("double"))
    return F.when(text(c) == "", F.lit(None)).when(number == "", F.lit(0.0)).otherwise(strict)


def parse_number(c: Column) -> Column:
    """Leading number of a printed amount, null when there is none."""
    bare = F.regexp_replace(F.regexp_replace(text(c), r"R\$\s?", ""), r"\.", "")
    number = trim_ws(F.regexp_replace(bare, "^([^,]*),", "$1."))
    lead = F.regexp_extract(number, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return blank_to_null(lead).try_cast("double")


def totals_consistent(additions: Column, deductions: Column, net: Column, tolerance: float = 0.02) -> Column:
    """Additions minus deductions equals the net value; false when one is missing."""
    a, d, n = parse_currency(additions), parse_currency(deductions), parse_currency(net)
    return F.coalesce(F.abs((a - d) - n) <= tolerance, F.lit(False))
