"""Column builders for label text, codes and whitespace.

All functions take and return ``Column`` and stay inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .vocab import LETTER, MONEY, SUMMARY_HINT, WS, WS_CHARS  # noqa: F401

# Java's \s leaves out the no-break and typographic spaces that PDF text is full of.


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, then the bare combining marks.

    ``translate`` drops source characters beyond the end of the target string, so
    the combining marks are listed last and vanish.
    """
    source, target = [], []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFD", letter) if not 0x300 <= ord(c) <= 0x36F)
            if base != letter and len(base) == 1:
                source.append(letter)
                target.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


ACCENTED, PLAIN = _accent_table()


def constant_label_key(label: str) -> str:
    """``label_key`` of a fixed value, for tables that become constants of a plan."""
    base = label.translate(str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])).lower()
    key = re.sub("[^a-z0-9]+", " ", base).strip()
    return vocab.LABEL_ALIASES.get(key, key)


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


# the same characters one by one, for trim()
WS_LIST = "".join(chr(c) for c in [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])


def trim_ws(c: Column) -> Column:
    return F.trim(text(c), F.lit(WS_LIST))


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(text(c), f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(text(c)) for c in cols], F.lit(""))


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, for rules that read their input several times."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip_accents(c: Column) -> Column:
    """Base letters only."""
    return F.translate(c, ACCENTED, PLAIN)


def bare_label_key(label: Column) -> Column:
    """Lower-case, accent-free words separated by one space."""
    words = F.regexp_replace(F.lower(strip_accents(text(label))), "[^a-z0-9]+", " ")
    return F.trim(words)


def lookup(pairs: dict[str, str]) -> Column:
    """A constant map, parsed in one step."""
    quoted = ", ".join("'" + v.replace("'", "\\'") + "'" for pair in pairs.items() for v in pair)
    return F.expr(f"map({quoted})")


def preferred_key(bare: Column) -> Column:
    """The key that stands for all spellings of ``bare`` (reads ``bare`` twice)."""
    variants = {k: v for k, v in vocab.LABEL_ALIASES.items() if k != v}
    return F.coalesce(F.try_element_at(lookup(variants), bare), bare)


def label_key(label: Column) -> Column:
    """Comparable key of a label; known spelling variants share one key."""
    return let(bare_label_key(label), preferred_key)


def compact_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(text(label))), "[^a-z0-9]", "")


def code_key_of(code: Column) -> Column:
    """``code_key`` of a trimmed column (reads it several times)."""
    digits = F.ltrim(code, F.lit("0"))
    return (
        F.when(code == "", "")
        .when(code.rlike("^[0-9]+$"), F.when(digits == "", "0").otherwise(digits))
        .otherwise(label_key(code))
    )


def code_key(code: Column) -> Column:
    """Numeric codes lose leading zeros, other codes become label keys."""
    return let(trim_ws(code), code_key_of)


def clean_label(c: Column) -> Column:
    """A printed label without amounts, edge punctuation or repeated spaces."""
    bare = F.regexp_replace(text(c), MONEY, "")
    edged = F.regexp_replace(bare, rf"^{WS}*[:|\-]+|{WS}*[:|\-]+$", "")
    return collapse_ws(edged)


def lines_of(page_text: Column) -> Column:
    return F.split(text(page_text), "\n")


def first_rule_of(key: Column, rules: list[tuple[str, str]]) -> Column:
    """``first_rule`` of a plain column; most keys match nothing and stop at the first test."""
    chain = F.when(~key.rlike("|".join(pattern for _, pattern in rules)), F.lit(None))
    for value, pattern in rules:
        chain = chain.when(key.rlike(pattern), F.lit(value))
    return chain


def first_rule(key: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first (value, pattern) rule whose pattern is found in ``key``."""
    return let(key, lambda k: first_rule_of(k, rules))


def any_of(patterns: list[str]) -> str:
    """One case-insensitive alternation; letters fold with their accents."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns).replace(r"\s", WS)


def payroll_type_label(payroll_type: Column) -> Column:
    return F.coalesce(
        F.try_element_at(lookup(vocab.PAYROLL_TYPE_LABELS), text(payroll_type)),
        F.lit(vocab.PAYROLL_TYPE_LABELS["normal"]),
    )


def summary_label(line: Column) -> Column:
    """Printed name of the summary row on a text line, else its cleaned hint segment."""
    known = first_rule(compact_key(line), vocab.LINE_SUMMARIES)
    hinted = F.filter(F.split(line, r"\|"), lambda part: part.rlike(SUMMARY_HINT))
    return F.coalesce(known, clean_label(F.coalesce(F.try_element_at(hinted, F.lit(1)), line)))




def standard_payroll_type(page_text: Column) -> Column:
    """Payroll type of one page or region, from its words."""

    def choose(plain: Column) -> Column:
        return (
            F.when(plain.rlike(vocab.PAGE_SUPPLEMENT), "suplementar")
            .when(plain.rlike(vocab.PAGE_NORMAL), "normal")
            .when(plain.rlike(vocab.PAGE_PROFIT), "plr")
            .when(F.substring(plain, 1, vocab.TYPE_HEAD_CHARS).rlike(vocab.PAGE_13TH), "decimo_terceiro")
            .otherwise("normal")
        )

    return let(F.lower(strip_accents(text(page_text))), choose)


def block_payroll_type(block_text: Column) -> Column:
    """Payroll type of a month block; repeated 13th rows outrank single hints."""

    def choose(plain: Column) -> Column:
        rows_13 = F.regexp_count(plain, F.lit(vocab.BLOCK_13TH_ROW))
        net_rows = F.regexp_count(plain, F.lit(vocab.BLOCK_NET_ROW))
        return (
            F.when((rows_13 >= 3) | (net_rows >= 3), "historico_13")
            .when(plain.rlike(vocab.BLOCK_NORMAL), "normal")
            .when(plain.rlike(vocab.BLOCK_PROFIT), "plr")
            .when(plain.rlike(vocab.BLOCK_13TH), "decimo_terceiro")
            .otherwise("suplementar")
        )

    plain = F.regexp_replace(F.lower(strip_accents(text(block_text))), rf"[^a-z0-9{WS_CHARS}.]", "")
    return let(plain, choose)
