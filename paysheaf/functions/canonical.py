"""Canonical form of printed items.

``stage`` derives the trimmed texts and keys once; the other builders read those
columns, so that no rule is evaluated twice per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .text import (
    bare_label_key, code_key_of, compact_key, first_rule, first_rule_of, label_key, lookup, preferred_key, text, trim_ws,
)

STAGED = ["_label", "_code", "_ref", "_val", "_bare", "_compact", "_lkey", "_ckey", "_sid"]


SUMMARY_RULES = [(sid, pattern) for sid, _, pattern in vocab.SUMMARIES]


def summary_id(label: Column) -> Column:
    """Id of the summary row a label names, null for other labels."""
    return first_rule(compact_key(label), SUMMARY_RULES)


def summary_name(sid: Column) -> Column:
    return F.try_element_at(lookup({i: label for i, label, _ in vocab.SUMMARIES}), sid)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stage(df: DataFrame) -> DataFrame:
    """Trimmed texts and keys of code, label, reference and value."""
    return (
        df.withColumns(
            {
                "_label": trim_ws(F.col("label")),
                "_code": trim_ws(F.col("code")),
                "_ref": trim_ws(F.col("reference")),
                "_val": trim_ws(F.col("value")),
            }
        )
        .withColumn("_bare", bare_label_key(F.col("_label")))
        .withColumn("_compact", F.replace(F.col("_bare"), F.lit(" "), F.lit("")))
        .withColumns(
            {
                "_lkey": preferred_key(F.col("_bare")),
                "_ckey": code_key_of(F.col("_code")),
                "_sid": first_rule_of(F.col("_compact"), SUMMARY_RULES),
            }
        )
    )


def is_base_label() -> Column:
    return F.col("_lkey").rlike(vocab.BASE_LABEL_KEY)


def field_columns() -> dict[str, Column]:
    """Repaired and canonical columns of an earning or deduction.

    An amount that slipped into the reference column moves back when the value is blank.
    """
    shifted = F.col("_val") == ""
    return {
        "code": F.col("_code"),
        "label": F.col("_label"),
        "original_label": F.col("_label"),
        "reference": F.when(shifted, "").otherwise(F.col("_ref")),
        "value": F.when(shifted, F.col("_ref")).otherwise(F.col("_val")),
        "canonical_key": F.when(F.col("_ckey") != "", F.concat(F.lit("field:code:"), F.col("_ckey"))).when(
            F.col("_lkey") != "", F.concat(F.lit("field:label:"), F.col("_lkey"))
        ),
    }


def base_columns() -> dict[str, Column]:
    """Canonical columns of a base or total; composite or overlong labels get no key."""
    known = F.col("_sid").isNotNull()
    ambiguous = F.col("_label").contains("|") | (~known & (F.length("_label") > vocab.CLEAR_LABEL_CHARS))
    return {
        "code": F.lit(""),
        "label": F.when(known & ~ambiguous, summary_name(F.col("_sid"))).otherwise(F.col("_label")),
        "original_label": F.col("_label"),
        "reference": F.lit(""),
        "value": F.when(F.col("_val") == "", F.col("_ref")).otherwise(F.col("_val")),
        "canonical_key": F.when(ambiguous, F.lit(None))
        .when(known, F.concat(F.lit("base:"), F.col("_sid")))
        .when(F.col("_lkey") != "", F.concat(F.lit("base:label:"), F.col("_lkey"))),
    }


def needs_review(kind: Column, key: Column, original_label: Column, review: Column, conflict: Column) -> Column:
    """Flagged, conflicting, without a key, or (for fields) a composite label."""
    composite = (kind == "field") & text(original_label).contains("|")
    return flag(review) | flag(conflict) | key.isNull() | composite


def group_key(kind: Column, key: Column, label: Column) -> Column:
    """Canonical key, or a key made of the label for items that have none."""
    return F.coalesce(key, F.concat(kind, F.lit(":label:"), label_key(label)))

