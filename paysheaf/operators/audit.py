"""Findings over all competencies of a document, and extraction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical, dates
from ..functions.text import first_filled, text, trim_ws


def _leading_int(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")


def flag_records(records: DataFrame) -> DataFrame:
    """Adds per record: missing, inferred, invalid (reason or null), competency of valid records."""
    month, year = trim_ws(F.col("month")), trim_ws(F.col("year"))
    df = records.withColumns({"_m": month, "_y": year}).withColumns({"_mn": _leading_int(F.col("_m")), "_yn": _leading_int(F.col("_y"))})
    missing = (F.col("_m") == "") | (F.col("_y") == "")
    bad_month = ~F.coalesce(F.col("_mn").between(1, 12), F.lit(False))
    bad_year = ~F.coalesce(F.col("_yn").between(1990, 2100), F.lit(False))
    unsure = F.col("_m").contains("?") | F.col("_y").contains("?")
    reason = (
        F.when(missing, F.lit(None)).when(bad_month, "Mês inválido").when(bad_year, "Ano inválido").when(unsure, "Formato ambíguo")
    )
    inferred = canonical.flag(F.col("is_inferred")) if "is_inferred" in records.columns else F.lit(False)
    return df.withColumns(
        {
            "missing": missing,
            "inferred": inferred & ~missing,
            "invalid": reason,
            "competency": F.when(~missing & reason.isNull(), F.concat(dates.pad_month(F.col("_m")), F.lit("/"), F.col("_y"))),
            "event_type": first_filled(F.col("payroll_type"), F.lit("normal")),
        }
    )


def _finding(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    return df.select(
        "doc_id",
        F.lit(kind).alias("finding"),
        *[cols.get(c, empty).cast("string").alias(c) for c in ("page", "competency", "payroll_type", "record_key", "detail")],
    )


def findings(records: DataFrame) -> DataFrame:
    """Every finding as a row: missing, inferred, invalid_format, duplicates, repeats, years.

    Duplicated events list one row per record, so no group is collected.
    """
    flagged = flag_records(records)
    page = F.col("page_ord")
    period = F.concat("_m", F.lit("/"), F.col("_y"))
    missing = _finding(flagged.where("missing"), "missing_evidence", page=page,
                       detail=F.concat(F.lit("Página "), page, F.lit(": Competência não evidenciada no documento.")))
    inferred = _finding(flagged.where("inferred"), "inferred", page=page, competency=period,
                        detail=F.concat(F.lit("Página "), page, F.lit(": Competência "), period, F.lit(" foi marcada como inferida.")))
    invalid = _finding(flagged.where(F.col("invalid").isNotNull()), "invalid_format", page=page, competency=period, detail=F.col("invalid"))

    valid = flagged.where(F.col("competency").isNotNull())
    events = valid.groupBy("doc_id", "competency", "event_type").agg(F.count("*").alias("n"))
    months = events.groupBy("doc_id", "competency").agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    plain = _finding(
        months.where((F.col("n") > 1) & (F.col("types") == 1)), "duplicate_competency", competency=F.col("competency"),
        detail=F.concat(F.lit("aparece duplicada ("), F.col("n"), F.lit(" vezes)")),
    )
    several = months.where(F.col("types") > 1).select("doc_id", "competency")
    legitimate = _finding(events.join(several, ["doc_id", "competency"]), "legitimate_repeat", competency=F.col("competency"), payroll_type=F.col("event_type"))
    repeated = events.where(F.col("n") > 1).select("doc_id", "competency", "event_type")
    event_rows = _finding(
        valid.join(repeated, ["doc_id", "competency", "event_type"]), "duplicate_event",
        page=page, competency=F.col("competency"), payroll_type=F.col("event_type"), record_key=F.col("record_key"),
    )
    years = valid.select("doc_id", "_yn").distinct()
    spread = years.groupBy("doc_id").agg(F.count("*").alias("years"), F.array_join(F.array_sort(F.collect_list("_yn")), ", ").alias("list"))
    year_rows = _finding(spread.where("years > 2"), "year_inconsistency", detail=F.col("list"))
    out = missing
    for part in (inferred, invalid, plain, legitimate, event_rows, year_rows):
        out = out.unionByName(part)
    return out


def document_status(records: DataFrame) -> DataFrame:
    """Counts per document and ``ok`` or ``review_required``."""
    flagged = flag_records(records)
    valid = F.col("competency").isNotNull()
    events = flagged.groupBy("doc_id", "competency", "event_type").agg(
        F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.count_if("inferred").alias("inferred"),
        F.count_if(F.col("invalid").isNotNull()).alias("invalid"),
    )
    months = events.groupBy("doc_id", "competency").agg(
        F.sum(F.when(valid, F.col("n"))).alias("n"), F.count_if(valid).alias("types"), F.count_if(valid & (F.col("n") > 1)).alias("repeats"),
        F.sum("missing").alias("missing"), F.sum("inferred").alias("inferred"), F.sum("invalid").alias("invalid"),
    )
    year = F.when(valid, F.substring("competency", 4, 4))
    per_year = months.groupBy("doc_id", year.alias("year")).agg(
        F.count_if(valid).alias("competencies"), F.count_if((F.col("n") > 1) & (F.col("types") == 1)).alias("plain"),
        F.count_if(F.col("types") > 1).alias("legitimate"), F.sum("repeats").alias("repeats"), F.sum("missing").alias("missing"),
        F.sum("inferred").alias("inferred"), F.sum("invalid").alias("invalid"),
    )
    docs = per_year.groupBy("doc_id").agg(
        F.sum("competencies").alias("competencies"), (F.sum("plain") + F.sum("repeats")).alias("duplicates"),
        F.sum("legitimate").alias("legitimate_repeats"), F.sum("invalid").alias("invalid_formats"),
        F.sum("missing").alias("missing_evidence"), F.sum("inferred").alias("inferred"), F.count("year").alias("years"),
    )
    bad = (F.col("duplicates") + F.col("invalid_formats") + F.col("missing_evidence") + F.col("inferred") > 0) | (F.col("years") > 2)
    return docs.withColumn("status", F.when(bad, "review_required").otherwise("ok"))


def normalize_metrics(metrics: DataFrame) -> DataFrame:
    """Extraction metrics with older column names folded in.

    Input columns (all nullable): deterministic_items, local_items, ai_recovered_items,
    ai_items, ai_validated_items, visible_items, expected_count, extracted_count,
    pending_items, planned_batches, planned_prompts, executed_prompts.
    """
    def pick(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names], F.lit(0)).cast("long")

    found = metrics.withColumns(
        {
            "_det": pick("deterministic_items", "local_items"), "_rec": pick("ai_recovered_items", "ai_items"),
            "_val": pick("ai_validated_items"), "_decl": pick("visible_items", "expected_count"), "_ext": pick("extracted_count"),
        }
    )
    visible = F.when(F.col("_decl") > 0, F.col("_decl")).otherwise(F.col("_det") + F.col("_rec"))
    found = found.withColumn("_vis", visible)
    covered = F.greatest(F.col("_ext"), F.col("_det") + F.col("_rec"))
    covered = F.when(F.col("_vis") > 0, F.least(F.col("_vis"), covered)).otherwise(covered)
    pending = F.coalesce(F.col("pending_items").cast("long"), F.greatest(F.lit(0).cast("long"), F.col("_vis") - covered))
    found = found.withColumn("_pend", pending)
    share = F.try_divide(F.col("_vis") - F.col("_pend"), F.col("_vis"))
    coverage = F.when(F.col("_vis") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(
        F.when(F.col("_pend") != 0, 0.0).otherwise(1.0)
    )
    keep = [c for c in metrics.columns if c in ("doc_id", "page_ord", "record_key", "strategy")]
    return found.select(
        *keep,
        F.col("_vis").alias("visible_items"), F.col("_det").alias("deterministic_items"), F.col("_rec").alias("ai_recovered_items"),
        F.col("_val").alias("ai_validated_items"), F.col("_pend").alias("pending_items"), coverage.alias("coverage"),
        pick("planned_batches", "planned_prompts").alias("planned_batches"), pick("executed_prompts").alias("executed_prompts"),
    )


def rollup_metrics(normalized: DataFrame) -> DataFrame:
    """Document totals of normalised metrics."""
    sums = ["visible_items", "deterministic_items", "ai_recovered_items", "ai_validated_items", "pending_items", "planned_batches", "executed_prompts"]
    docs = normalized.groupBy("doc_id").agg(F.count("*").alias("units"), *[F.sum(c).alias(c) for c in sums])
    rest = F.col("visible_items") - F.col("pending_items")
    return docs.withColumns(
        {
            "coverage": F.when(F.col("visible_items") != 0, F.try_divide(rest, F.col("visible_items"))).otherwise(1.0),
            "extracted_items": F.greatest(F.lit(0).cast("long"), rest),
        }
    )


def strategies(metrics: DataFrame) -> DataFrame:
    """Distinct extraction strategies of a document in order of first use."""
    named = metrics.where(text(F.col("strategy")) != "")
    return named.groupBy("doc_id", "strategy").agg(F.min("page_ord").alias("first_page"), F.count("*").alias("units"))


def review_warnings(records: DataFrame) -> DataFrame:
    """One distinct warning per competency and type that needs review."""
    m, y = text(F.col("month")), text(F.col("year"))
    where = F.when((m != "") & (y != ""), F.concat(m, F.lit("/"), y)).otherwise(
        F.concat(F.lit("página "), F.col("page_ord").cast("string"))
    )
    message = F.concat(
        where, F.lit(" ("), first_filled(F.col("payroll_type"), F.lit("normal")),
        F.lit("): itens ambíguos ou conflitantes exigem revisão."),
    )
    flagged = records.where(canonical.flag(F.col("review_required")))
    return flagged.select("doc_id", message.alias("warning"), "page_ord").groupBy("doc_id", "warning").agg(
        F.min("page_ord").alias("first_page")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column], limit: int) -> DataFrame:
    """First ``limit`` rows per key.

    The rank filter is applied per task before the shuffle, so a large group never
    reaches one task as a whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= limit)


def banner(warnings: DataFrame, shown: int = 3) -> DataFrame:
    """First warnings of a document and how many more there are."""
    totals = warnings.groupBy("doc_id").agg(F.count("*").alias("total"))
    heads = first_rows(warnings, ["doc_id"], ["first_page", "warning"], shown).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "warning"))), lambda h: h["warning"]), " ").alias("shown")
    )
    more = F.greatest(F.col("total") - shown, F.lit(0).cast("long"))
    return totals.join(heads, "doc_id").select("doc_id", "shown", more.alias("more"))
