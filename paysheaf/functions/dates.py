"""Column builders for competencies (month/year), dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import lookup, text, trim_ws


def clean_month(c: Column) -> Column:
    """Placeholders become blank, one digit is padded."""
    return F.regexp_replace(F.regexp_replace(trim_ws(c), "(?i)^(?:MM|00)$", ""), "^(.)$", "0$1")


def clean_year(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), "(?i)^(?:YYYY|0000)$", "")


def pad_month(month: Column) -> Column:
    return F.regexp_replace(month, "^(.)$", "0$1")


def competency(month: Column, year: Column) -> Column:
    """``MM/YYYY`` or null when the month or the year is unknown."""
    m, y = trim_ws(month), trim_ws(year)
    return F.when((m != "") & (y != ""), F.concat(pad_month(m), F.lit("/"), y))


def is_readable(month: Column, year: Column) -> Column:
    return text(month).rlike("^(?:0[1-9]|1[0-2])$") & text(year).rlike("^[0-9]{4}$")


def month_number(month: Column, year: Column) -> Column:
    """Months since year 0 for a readable competency, null otherwise."""
    return F.when(is_readable(month, year), year.try_cast("int") * 12 + month.try_cast("int"))


def is_non_sequential(previous: Column, current: Column) -> Column:
    """True when both month numbers are known and ``current`` is not the next month."""
    return F.coalesce(current != previous + 1, F.lit(False))


def _month_of(prefix: Column) -> Column:
    return F.try_element_at(lookup(vocab.MONTHS), prefix)


def _full_year(year: Column) -> Column:
    return F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)


def parse_month_label(label: Column) -> Column:
    """``abr-17``, ``abril/2017`` ... as struct(month, year), null when unreadable."""
    pattern = r"(?iu)^([a-záéíóúâêîôûãõçàèìòùü]+)[\s/-]([0-9]{2,4})$"
    trimmed = trim_ws(label)
    month = _month_of(F.substring(F.lower(F.regexp_extract(trimmed, pattern, 1)), 1, 3))
    year = _full_year(F.regexp_extract(trimmed, pattern, 2))
    return F.when(month.isNotNull(), F.struct(month.alias("month"), year.alias("year")))


def audited_month(label: Column) -> Column:
    """``abr-17`` of an audited sheet; unknown months become blank, not null."""
    parts = F.split(F.lower(text(label)), "-")
    month = F.coalesce(_month_of(parts[0]), F.lit(""))
    year = _full_year(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    return F.when(text(label) == "", F.struct(F.lit("").alias("month"), F.lit("").alias("year"))).otherwise(
        F.struct(month.alias("month"), year.alias("year"))
    )


def infer_competency(page_text: Column) -> Column:
    """Competency printed on a page as struct(month, year), null when none is found."""
    found = []
    for pattern in vocab.COMPETENCY_PATTERNS:
        month = F.regexp_extract(text(page_text), pattern, 1)
        year = _full_year(F.regexp_extract(text(page_text), pattern, 2))
        found.append(F.when(month != "", F.struct(F.lpad(month, 2, "0").alias("month"), year.alias("year"))))
    return F.coalesce(*found)


def _leading_int(part: Column) -> Column:
    return F.regexp_extract(part, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")


def is_valid_date(c: Column) -> Column:
    """``DD/MM`` or ``DD/MM/YYYY`` (also ``.`` or ``-``) that exists in the calendar."""
    parts = F.split(trim_ws(c), "[/.-]")
    day, month = _leading_int(parts[0]), _leading_int(F.try_element_at(parts, F.lit(2)))
    third = F.try_element_at(parts, F.lit(3))
    year = F.when(F.coalesce(third, F.lit("")) == "", F.lit(2024)).otherwise(_leading_int(third))
    in_range = month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    last = F.day(F.last_day(F.make_date(F.when(in_range, year), F.when(in_range, month), F.lit(1))))
    known = (text(c) != "") & ~text(c).contains("?")
    return F.coalesce(known & in_range & (day <= last), F.lit(False))


def normalize_time(c: Column) -> Column:
    """``HH:MM``; unreadable digits (``?``) are kept, other input is returned unchanged."""
    kept = F.regexp_replace(trim_ws(c), "[^0-9:?]", "")
    parts = F.split(kept, ":")

    def two(part: Column) -> Column:
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    return (
        F.when(text(c) == "", "??:??")
        .when(kept.contains("?"), kept)
        .when(F.size(parts) == 2, F.concat_ws(":", two(parts[0]), two(F.try_element_at(parts, F.lit(2)))))
        .when(kept.rlike("^[0-9]{4}$"), F.concat_ws(":", F.substring(kept, 1, 2), F.substring(kept, 3, 2)))
        .otherwise(c)
    )


def mask_uncertain(c: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """Letters and digits become ``?`` below the confidence threshold."""
    return F.when(confidence < threshold, F.regexp_replace(text(c), "[a-zA-Z0-9]", "?")).otherwise(text(c))


def edit_competency(value: Column, month: Column, year: Column) -> Column:
    """An edited competency cell as struct(month, year); without ``/`` only the month changes."""
    parts = F.split(value, "/")
    return F.when(
        value.contains("/"), F.struct(parts[0].alias("month"), F.try_element_at(parts, F.lit(2)).alias("year"))
    ).otherwise(F.struct(value.alias("month"), year.alias("year")))


def progress_percent(done: Column, total: Column) -> Column:
    """10 to 95 percent while units complete; 10 before any unit is known."""
    share = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    return F.least(F.lit(95), F.floor(F.lit(10) + share * 85 + 0.5)).cast("int")
