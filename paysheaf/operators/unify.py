"""All pages of one competency as one record with numbered occurrences.

Order decides results here: the first item of a key takes in later items that
repeat or complete it, and every other item is kept beside it.  The first item
changes at most twice (its value and its reference can each be filled once), so
its whole history follows from a few ordered minima.  Those are ordinary
aggregates with partial aggregation, which keeps a key with very many items out
of a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, dates, money
from ..functions.text import blank_to_null, first_filled, label_key, text, trim_ws
from ..plans import segmented
from ..plans.reuse import shared

COMPETENCY = ["doc_id", "competency"]
GROUP = [*COMPETENCY, "group_key"]


def with_competency(df: DataFrame) -> DataFrame:
    return df.withColumn("competency", dates.competency(F.col("month"), F.col("year")))


def split_unknown(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with a competency, records without); the latter are kept as they are."""
    keyed = with_competency(records)
    return keyed.where(F.col("competency").isNotNull()), keyed.where(F.col("competency").isNull())


def _open_flag(df: DataFrame) -> Column:
    """The item still needs a decision: flagged, conflicting or without a key."""
    stated = [canonical.flag(F.col(c)) for c in ("review_required", "conflict") if c in df.columns]
    flagged = F.col("canonical_key").isNull()
    for s in stated:
        flagged = flagged | s
    return flagged


def _position() -> Column:
    return F.struct("page_ord", "item_ord")


def _first(condition: Column, *cols: str) -> Column:
    """Earliest row that meets ``condition`` as struct(pos, cols...)."""
    return F.min(F.when(condition, F.struct(_position().alias("pos"), *cols)))


def _states(fields: DataFrame) -> DataFrame:
    """Per key: the first item and the two moments at which it may be filled."""
    zero_value, zero_ref = money.is_zero(F.col("value")), money.is_zero(F.col("reference"))
    late = F.col("late") & F.col("canonical_key").isNotNull()
    heads = fields.groupBy(*GROUP).agg(
        _first(F.lit(True), "value", "reference").alias("head"),
        _first(late & zero_value & ~zero_ref, "reference").alias("ref_only"),
        _first(late & ~(zero_value & zero_ref), "value", "reference").alias("filled"),
    )
    v0, r0 = F.col("head.value"), F.col("head.reference")
    none_yet = money.is_zero(v0) & money.is_zero(r0)
    after = F.when(none_yet, F.col("filled"))
    heads = heads.withColumns(
        {
            # value and reference once the first moment has passed, for an item that starts empty
            "t1": F.when(none_yet, F.col("filled.pos")),
            "v1": F.when(money.is_zero(v0) & ~money.is_zero(after["value"]), after["value"]).otherwise(v0),
            "r1": F.when(money.is_zero(r0) & ~money.is_zero(after["reference"]), after["reference"]).otherwise(r0),
        }
    )
    # an item with a reference and no value waits for a value whose reference fits
    waiting = heads.where(money.is_zero(F.col("v1")) & ~money.is_zero(F.col("r1"))).select(
        *GROUP, F.col("r1").alias("fits")
    )
    values = (
        fields.where(late & ~zero_value)
        .join(waiting, GROUP)
        .where(zero_ref | (F.col("reference") == F.col("fits")))
        .groupBy(*GROUP)
        .agg(_first(F.lit(True), "value").alias("value_fit"))
    )
    heads = heads.join(values, GROUP, "left")
    fill_ref = ~money.is_zero(F.col("v1")) & money.is_zero(F.col("r1"))
    second = F.when(fill_ref, F.col("ref_only.pos")).otherwise(F.col("value_fit.pos"))
    return heads.select(
        *GROUP,
        F.col("head.pos").alias("p0"),
        v0.alias("v0"),
        r0.alias("r0"),
        "t1",
        "v1",
        "r1",
        second.alias("t2"),
        F.coalesce(F.col("value_fit.value"), F.col("v1")).alias("v2"),
        F.when(fill_ref, F.coalesce(F.col("ref_only.reference"), F.col("r1"))).otherwise(F.col("r1")).alias("r2"),
    )


def _takes_in(value: Column, reference: Column) -> Column:
    """The first item, in the given state, absorbs the current row."""
    v, r = F.col("value"), F.col("reference")
    same = (value == v) & (reference == r)
    fits_value = money.is_zero(value) | money.is_zero(v)
    fits_ref = money.is_zero(reference) | money.is_zero(r) | (reference == r)
    return same | (fits_value & fits_ref)


def _original(items: DataFrame) -> Column:
    """The label as it was read, where the items carry it."""
    return text(F.col("original_label") if "original_label" in items.columns else F.col("label"))


def _placed(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items of records with a competency, with its opening page and what both kinds need, made once for all branches."""
    known, _ = split_unknown(records)
    opening = known.groupBy(*COMPETENCY).agg(F.min("page_ord").alias("opening_page"))
    pages = known.select("doc_id", "page_ord", "competency").join(opening, COMPETENCY)
    own = items.withColumns({"open": _open_flag(items), "original_label": _original(items)})
    rest = ["item_ord", "canonical_key", "code", "label", "reference", "value", "type", "evidence_type", "confidence", "open", "original_label", "kind"]
    rows = own.select("doc_id", "page_ord", *[c for c in rest if c in own.columns]).join(pages, ["doc_id", "page_ord"])
    return shared(rows)


def unify_fields(items: DataFrame, records: DataFrame) -> DataFrame:
    """Fields of every (document, competency): merged, distinct and numbered.

    ``items``: doc_id, page_ord, item_ord, code, label, reference, value, type,
    canonical_key (kind ``field`` rows only); ``records``: doc_id, page_ord, month, year.
    """
    return _fields(_placed(items, records))


def _fields(placed: DataFrame) -> DataFrame:
    rows = (
        placed.withColumn("group_key", canonical.group_key(F.lit("field"), F.col("canonical_key"), F.col("label")))
        .withColumn("late", F.col("page_ord") > F.col("opening_page"))
        .withColumns({c: text(F.col(c)) for c in ("code", "label", "reference", "value", "type")})
        .select(
            *GROUP, "page_ord", "item_ord", "late", "canonical_key", "code", "label", "reference", "value", "type",
            "evidence_type", "confidence", "open", "original_label",
        )
    )
    placed = rows.join(_states(rows), GROUP)
    pos = _position()
    past1 = F.coalesce(pos > F.col("t1"), F.lit(False))
    past2 = F.coalesce(pos > F.col("t2"), F.lit(False))
    taken = F.when(past2, _takes_in(F.col("v2"), F.col("r2"))).when(past1, _takes_in(F.col("v1"), F.col("r1"))).otherwise(
        _takes_in(F.col("v0"), F.col("r0"))
    )
    is_head = pos == F.col("p0")
    absorbed = is_head | (F.col("late") & F.col("canonical_key").isNotNull() & taken)
    marked = placed.withColumn("absorbed", absorbed)

    # one row per (key, value, reference): the first of equals stays
    final_value = F.when(F.col("absorbed"), F.col("v2")).otherwise(F.col("value"))
    final_ref = F.when(F.col("absorbed"), F.col("r2")).otherwise(F.col("reference"))
    own = F.struct(pos.alias("pos"), "absorbed", "code", "label", "type", "canonical_key", "evidence_type", "confidence", "open", "original_label")
    order = F.struct("page_ord", "item_ord")
    kept = (
        marked.withColumns({"final_value": final_value, "final_ref": final_ref})
        .groupBy(*GROUP, F.col("final_value").alias("value"), F.col("final_ref").alias("reference"))
        .agg(
            F.min(own).alias("own"),
            F.min_by("code", F.when(F.col("absorbed") & (trim_ws(F.col("code")) != ""), order)).alias("head_code"),
            F.max_by(
                "label",
                F.when(
                    F.col("absorbed"),
                    F.struct(F.length("label"), -F.col("page_ord"), -F.col("item_ord")),
                ),
            ).alias("head_label"),
            F.min_by("type", F.when(F.col("absorbed") & (F.col("type") != ""), order)).alias("head_type"),
        )
    )
    head = F.col("own.absorbed")
    flat = kept.select(
        *GROUP,
        F.col("own.pos.page_ord").alias("page_ord"),
        F.col("own.pos.item_ord").alias("item_ord"),
        F.col("own.canonical_key").alias("canonical_key"),
        F.when(head, first_filled(F.col("own.code"), F.col("head_code"))).otherwise(F.col("own.code")).alias("code"),
        F.when(head, F.col("head_label")).otherwise(F.col("own.label")).alias("label"),
        F.when(head, first_filled(F.col("own.type"), F.col("head_type"))).otherwise(F.col("own.type")).alias("type"),
        "reference",
        "value",
        F.col("own.evidence_type").alias("evidence_type"),
        F.col("own.confidence").alias("confidence"),
        F.col("own.open").alias("open"),
        F.col("own.original_label").alias("original_label"),
    )
    return segmented.numbered(
        shared(flat), GROUP, ["page_ord", "item_ord"], segmented.page_segment(), out="occurrence"
    )


def unify_bases(items: DataFrame, records: DataFrame) -> DataFrame:
    """Bases and totals of every (document, competency): distinct by key and value, numbered."""
    return _bases(_placed(items, records))


def _bases(placed: DataFrame) -> DataFrame:
    rows = placed.withColumn("group_key", canonical.group_key(F.lit("base"), F.col("canonical_key"), F.col("label"))).withColumns(
        {c: text(F.col(c)) for c in ("label", "reference", "value")}
    )
    # a keyless base repeats the first base of the same label key even if that one has a key
    named = rows.withColumn("lk", label_key(F.col("label")))
    keyless = named.where(F.col("canonical_key").isNull()).select(*COMPETENCY, "lk")
    leaders = (
        named.join(keyless.distinct(), [*COMPETENCY, "lk"])
        .groupBy(*COMPETENCY, "lk")
        .agg(F.min(F.struct(_position().alias("pos"), "value")).alias("leader"))
    )
    repeat = (
        F.col("canonical_key").isNull()
        & (F.col("page_ord") > F.col("opening_page"))
        & (_position() > F.col("leader.pos"))
        & (F.col("value") == F.col("leader.value"))
    )
    fresh = named.join(leaders, [*COMPETENCY, "lk"], "left").where(~F.coalesce(repeat, F.lit(False)))
    first = fresh.groupBy(*GROUP, "value", "reference").agg(
        F.min(F.struct(_position().alias("pos"), "label", "canonical_key", "evidence_type", "confidence", "open", "original_label")).alias("own")
    )
    flat = first.select(
        *GROUP,
        F.col("own.pos.page_ord").alias("page_ord"),
        F.col("own.pos.item_ord").alias("item_ord"),
        F.col("own.canonical_key").alias("canonical_key"),
        F.col("own.label").alias("label"),
        "reference",
        "value",
        F.col("own.evidence_type").alias("evidence_type"),
        F.col("own.confidence").alias("confidence"),
        F.col("own.open").alias("open"),
        F.col("own.original_label").alias("original_label"),
    )
    return segmented.numbered(
        shared(flat), GROUP, ["page_ord", "item_ord"], segmented.page_segment(), out="occurrence"
    )


#: Header values that come from one page together: the first page that has any of them.
HEADER_GROUPS = (
    ("company", "cnpj"),
    ("employee", "cpf", "registration", "role", "department", "admission_date"),
    ("bank", "agency", "account"),
    ("payment_date",),
)


def unify_headers(records: DataFrame) -> DataFrame:
    """One header per (document, competency); type ``unified``, and the header values that the records carry.

    Company, employee and bank are taken whole from the first page that has one; block and warnings come from the first page.
    """
    known, _ = split_unknown(records)
    at = F.col("page_ord")
    taken, names = [], []
    for i, group in enumerate(HEADER_GROUPS):
        present = [c for c in group if c in records.columns]
        values = [blank_to_null(text(F.col(c))).alias(c) for c in present]
        if present:
            taken.append(F.min_by(F.struct(*values), F.when(F.coalesce(*values).isNotNull(), at)).alias(f"_{i}"))
            names += [F.col(f"_{i}.{c}").alias(c) for c in present]
    first = [c for c in ("block_index", "warnings") if c in records.columns]
    return (
        known.groupBy(*COMPETENCY)
        .agg(
            F.min("page_ord").alias("page_ord"),
            F.min_by("record_key", at).alias("record_key"),
            *taken,
            *[F.min_by(c, at).alias(c) for c in first],
            F.bool_or(canonical.flag(F.col("review_required"))).alias("review_required"),
            F.count("*").alias("pages"),
        )
        .select(*COMPETENCY, "page_ord", "record_key", *names, *first, "review_required", "pages", F.lit("unified").alias("payroll_type"))
    )


def source_types(records: DataFrame) -> DataFrame:
    """Payroll types of every competency in order of first appearance, one row each."""
    known, _ = split_unknown(records)
    return (
        known.withColumn("payroll_type", first_filled(F.col("payroll_type"), F.lit("normal")))
        .groupBy(*COMPETENCY, "payroll_type")
        .agg(F.min("page_ord").alias("first_page"), F.count("*").alias("pages"))
    )


def unified_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """Fields and bases of every unified record in one tall table."""
    placed = _placed(items, records)
    fields = _fields(placed.where(F.col("kind") == "field")).withColumn("kind", F.lit("field"))
    bases = _bases(placed.where(F.col("kind") == "base")).withColumn("kind", F.lit("base"))
    return fields.unionByName(bases, allowMissingColumns=True)


def provenance(records: DataFrame) -> DataFrame:
    """Every source record of a unified competency with its position, one row each."""
    known, _ = split_unknown(records)
    return known.select(*COMPETENCY, *[c for c in ("page_ord", "record_key", "page", "block_index") if c in known.columns])


def number_items(items: DataFrame, keys: list[str], segment: Column) -> DataFrame:
    """Items of single records: repeats of key, reference and value dropped, the rest numbered."""
    keyed = items.withColumn("group_key", canonical.group_key(F.col("kind"), F.col("canonical_key"), F.col("label")))
    group = [*keys, "kind", "group_key"]
    rest = ["item_ord", "canonical_key", "code", "label", "original_label", "type", "conflict", "review_required"]
    first = keyed.groupBy(*group, text(F.col("reference")).alias("reference"), text(F.col("value")).alias("value")).agg(
        F.min_by(F.struct(*rest), "item_ord").alias("r")
    )
    flat = first.select(*group, "reference", "value", "r.*")
    return segmented.numbered(flat, group, ["item_ord"], segment, out="occurrence")


def unknown_first(records: DataFrame, unified: DataFrame) -> DataFrame:
    """Unified records after the records without a competency, in document order.

    ``part`` 0 holds the unknown ones and 1 the unified ones.
    """
    _, unknown = split_unknown(records)
    cols = ["doc_id", "competency", "page_ord", "record_key", "payroll_type", "review_required"]
    return unknown.select(*cols, F.lit(0).alias("part")).unionByName(unified.select(*cols, F.lit(1).alias("part")))
