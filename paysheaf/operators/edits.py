"""Cell edits of a reviewed document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, dates
from ..functions.text import text


def apply_cell_edits(items: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Set the value of an exported cell; a cell without an item becomes a new item.

    ``edits``: keys, kind, canonical_key, occurrence, header, code, new_value (one per cell). All other columns of the items stay.
    """
    on = [*keys, "kind", "canonical_key", "occurrence"]
    joined = items.join(edits.select(*on, "header", F.col("code").alias("edit_code"), "new_value"), on, "full")
    label = F.regexp_replace("header", " [0-9]+$", "")
    rest = [c for c in items.columns if c not in (*on, "label", "code", "value", "reference")]
    return joined.select(
        *on, *rest,
        F.coalesce("label", label).alias("label"),
        F.when(F.col("label").isNull(), text(F.col("edit_code"))).otherwise(F.col("code")).alias("code"),
        F.coalesce("new_value", "value").alias("value"),
        F.coalesce("reference", F.lit("")).alias("reference"),
        F.col("label").isNull().alias("is_new"),
        F.col("new_value").isNotNull().alias("edited"),
    )


def apply_label_edits(items: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Rename items: the new label gets its own canonical key and clears the review flag.

    ``edits``: keys, item_ord, new_label.
    """
    joined = items.join(edits.select(*keys, "item_ord", "new_label"), [*keys, "item_ord"], "left")
    renamed = joined.withColumns(
        {"original_label": F.coalesce("new_label", "original_label"), "label": F.coalesce("new_label", "label")}
    )
    staged = canonical.stage(renamed)
    field, base = canonical.field_columns(), canonical.base_columns()
    is_base, changed = F.col("kind") == "base", F.col("new_label").isNotNull()
    picked = {
        c: F.when(changed, F.when(is_base, base[c]).otherwise(field[c])).otherwise(F.col(c)) for c in ("label", "original_label", "canonical_key")
    }
    out = staged.withColumns(picked)
    review = canonical.needs_review(
        F.col("kind"), F.col("canonical_key"), F.col("original_label"), F.lit(False), F.col("conflict")
    )
    return out.withColumn("review_required", F.when(changed, review).otherwise(F.col("review_required"))).drop(
        *canonical.STAGED, "new_label"
    )


def apply_competency_edits(records: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edited competency cells (``MM/YYYY``, or only a month)."""
    joined = records.join(edits.select(*keys, "new_competency"), keys, "left")
    cell = dates.edit_competency(F.col("new_competency"), F.col("month"), F.col("year"))
    changed = F.col("new_competency").isNotNull()
    return joined.withColumn("_cell", F.when(changed, cell)).withColumns(
        {"month": F.coalesce("_cell.month", "month"), "year": F.coalesce("_cell.year", "year")}
    ).drop("_cell", "new_competency")
