"""Raw extracted items and records into their canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, dates, vocab
from ..functions.text import first_filled, text, trim_ws


def clean_records(records: DataFrame) -> DataFrame:
    """Cleaned month and year beside the printed ones (placeholders become blank)."""
    return records.withColumns(
        {"month": dates.clean_month(F.col("raw_month")), "year": dates.clean_year(F.col("raw_year"))}
    )


def canonical_items(raw: DataFrame) -> DataFrame:
    """Route every raw item to fields or bases and give it its canonical key.

    Input: code, label, reference, value, type, is_base, conflict, review_required,
    confidence, evidence_type and any key columns, which are passed through.
    """
    staged = canonical.stage(raw).where((F.col("_label") != "") | (F.col("_val") != ""))
    routed = staged.withColumn(
        "kind", F.when(canonical.flag(F.col("is_base")) | canonical.is_base_label(), "base").otherwise("field")
    )
    as_field, as_base = canonical.field_columns(), canonical.base_columns()
    is_base = F.col("kind") == "base"
    chosen = {name: F.when(is_base, as_base[name]).otherwise(as_field[name]) for name in as_field}
    typed = F.when(is_base, "").otherwise(first_filled(F.col("type"), F.lit("provento")))
    out = routed.withColumns(
        {**chosen, "type": typed, "evidence_type": first_filled(F.col("evidence_type"), F.lit("ai"))}
    )
    return out.withColumn(
        "review_required",
        canonical.needs_review(
            F.col("kind"), F.col("canonical_key"), F.col("original_label"), F.col("review_required"), F.col("conflict")
        ),
    ).drop("is_base", *canonical.STAGED)


def payroll_types(records: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Stated payroll type, else the one its items show."""
    code = text(F.col("code"))
    words = F.concat_ws(" ", code, text(F.col("label")))
    shown = items.where(F.col("kind") == "field").groupBy(*keys).agg(
        F.count_if(code.rlike(vocab.ITEM_13TH_CODE)).alias("_rows_13"),
        F.bool_or(words.rlike(vocab.ITEM_PROFIT)).alias("_profit"),
        F.bool_and(code.rlike(vocab.ITEM_PROFIT_CODE)).alias("_only_profit"),
        F.bool_or(words.rlike(vocab.ITEM_13TH_LABEL)).alias("_label_13"),
    )
    inferred = (
        F.when(F.col("_rows_13") >= 3, "historico_13")
        .when(F.col("_profit") & F.col("_only_profit"), "plr")
        .when(F.col("_label_13"), "decimo_terceiro")
        .otherwise("normal")
    )
    return records.join(shown, keys, "left").withColumn(
        "payroll_type", first_filled(F.col("payroll_type"), inferred)
    ).drop("_rows_13", "_profit", "_only_profit", "_label_13")


def review_records(records: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """A record needs review when it, or any of its items, is flagged or keyless."""
    open_items = items.groupBy(*keys).agg(
        F.bool_or(
            canonical.flag(F.col("review_required"))
            | canonical.flag(F.col("conflict"))
            | F.col("canonical_key").isNull()
        ).alias("_open")
    )
    return records.join(open_items, keys, "left").withColumn(
        "review_required", canonical.flag(F.col("review_required")) | canonical.flag(F.col("_open"))
    ).drop("_open")


def totals_as_bases(totals: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """The three totals of a record as base rows, unless a base with that key exists.

    ``totals`` holds keys, total_additions, total_deductions and net_value.
    """
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("total_ord"), F.lit(label).alias("label"), trim_ws(F.col(name)).alias("value"))
            for i, (label, name) in enumerate(
                zip(vocab.TOTAL_LABELS, ["total_additions", "total_deductions", "net_value"], strict=True)
            )
        ]
    )
    tall = totals.select(*keys, F.explode(rows).alias("t")).select(*keys, "t.*").where(F.col("value") != "")
    staged = canonical.stage(tall.withColumns({"code": F.lit(""), "reference": F.lit("")}))
    keyed = (
        staged.withColumns(canonical.base_columns())
        .withColumns({"kind": F.lit("base"), "confidence": F.lit(1.0), "evidence_type": F.lit("derived_total")})
        .drop(*canonical.STAGED)
    )
    return keyed.join(bases.select(*keys, "canonical_key"), [*keys, "canonical_key"], "left_anti")


def merge_stated_bases(found: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """Bases found among the items, then the stated ones that are not there yet.

    A stated base is a repeat when a base with the same key and value exists; keyless
    bases are never repeats.  Of equal stated bases the first is kept.
    """
    same = [*keys, "canonical_key", "value"]
    fresh = stated.where(trim_ws(F.col("label")) != "")
    keyless = fresh.where(F.col("canonical_key").isNull())
    keyed = fresh.where(F.col("canonical_key").isNotNull()).join(found.select(*same), same, "left_anti")
    first = keyed.groupBy(*same).agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in same]), "item_ord").alias("r"))
    unique = first.select(*same, "r.*").select(*fresh.columns)
    parts = [(found, 0), (unique, 1), (keyless, 1)]
    out = None
    for df, rank in parts:
        tagged = df.withColumn("src_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out

