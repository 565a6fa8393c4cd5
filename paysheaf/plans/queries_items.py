"""Queries over records and items: text keys, canonical items, unification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, dates, money, text
from ..operators import normalize, unify
from ..sources import testviews
from . import duck
from .catalogue import query


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.clean_records(testviews.records(spark, sf))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return testviews.raw_items(spark, sf)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.canonical_items(raw(spark, sf))


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where(F.col("kind") == "field")


def bases(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where(F.col("kind") == "base")


UNIFIED = ["doc_id", "competency", "canonical_key", "code", "label", "type", "reference", "value"]


@query(
    "label_keys",
    duck.with_views(
        ["v_raw"],
        f"""SELECT label, {duck.label_key('label')} AS label_key, {duck.compact('label')} AS compact_key,
            count(*) AS items FROM v_raw GROUP BY label""",
    ),
)
def label_keys(spark, sf):
    counted = raw(spark, sf).groupBy("label").agg(F.count("*").alias("items"))
    return counted.select(
        "label", text.label_key(F.col("label")).alias("label_key"), text.compact_key(F.col("label")).alias("compact_key"), "items"
    )


@query(
    "code_keys",
    duck.with_views(
        ["v_raw"], f"SELECT code, {duck.code_key('code')} AS code_key, count(*) AS items FROM v_raw GROUP BY code"
    ),
)
def code_keys(spark, sf):
    counted = raw(spark, sf).groupBy("code").agg(F.count("*").alias("items"))
    return counted.select("code", text.code_key(F.col("code")).alias("code_key"), "items")


@query(
    "money_format",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {duck.cents('CAST(round(l_extendedprice * 100) AS BIGINT)')} AS printed FROM lineitem""",
)
def money_format(spark, sf):
    line = testviews.table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.format_number(F.col("l_extendedprice")).alias("printed")
    )


@query(
    "money_parse",
    duck.with_views(
        ["v_raw"],
        """SELECT order_key, item_ord,
             CASE WHEN value = '' THEN NULL ELSE CAST(replace(replace(value, '.', ''), ',', '.') AS DOUBLE) END AS currency,
             CASE WHEN reference = '' THEN NULL
                  ELSE CAST(replace(replace(reference, '.', ''), ',', '.') AS DOUBLE) END AS number,
             value IN ('', '0,00') AS zero_value FROM v_raw""",
    ),
)
def money_parse(spark, sf):
    return raw(spark, sf).select(
        "order_key",
        "item_ord",
        money.parse_currency(F.col("value")).alias("currency"),
        money.parse_number(F.concat(F.lit("R$ "), F.col("reference"))).alias("number"),
        money.is_zero(F.col("value")).alias("zero_value"),
    )


@query(
    "competency_clean",
    duck.with_views(
        ["v_page"],
        """SELECT doc_id, page_ord, raw_month, raw_year, month, year, competency,
             regexp_full_match(month, '0[1-9]|1[0-2]') AND regexp_full_match(year, '[0-9]{4}') AS readable FROM v_page""",
    ),
)
def competency_clean(spark, sf):
    p = unify.with_competency(pages(spark, sf))
    return p.select(
        "doc_id", "page_ord", "raw_month", "raw_year", "month", "year", "competency",
        dates.is_readable(F.col("month"), F.col("year")).alias("readable"),
    )


@query(
    "items_canonical",
    duck.with_views(
        ["v_review"],
        """SELECT doc_id, page_ord, item_ord, kind, code, label, original_label, reference, value, type, canonical_key,
             evidence_type, review_required FROM v_review""",
    ),
)
def items_canonical(spark, sf):
    return items(spark, sf).select(
        "doc_id", "page_ord", "item_ord", "kind", "code", "label", "original_label", "reference", "value", "type",
        "canonical_key", "evidence_type", "review_required",
    )


@query(
    "payroll_type_items",
    duck.with_views(
        ["v_item", "v_page"],
        """SELECT p.doc_id, p.page_ord, coalesce(p.payroll_type,
             CASE WHEN count(*) FILTER (kind = 'field' AND code IN ('371', '374')) >= 3 THEN 'historico_13'
                  WHEN bool_or(kind = 'field' AND regexp_matches(code || ' ' || label, '(?i)13[âºo°]|13o\\.\\s*Sal'))
                  THEN 'decimo_terceiro' ELSE 'normal' END) AS payroll_type
           FROM v_page p LEFT JOIN v_item i ON i.doc_id = p.doc_id AND i.page_ord = p.page_ord
           GROUP BY p.doc_id, p.page_ord, p.payroll_type""",
    ),
)
def payroll_type_items(spark, sf):
    # one scan of the records serves both the headers and the items
    heads = pages(spark, sf)
    return normalize.payroll_types(heads, items(spark, sf), ["doc_id", "page_ord"]).select(
        "doc_id", "page_ord", "payroll_type"
    )


@query(
    "records_review",
    duck.with_views(
        ["v_review", "v_page"],
        """SELECT p.doc_id, p.page_ord, p.review_required OR coalesce(bool_or(i.page_ord IS NOT NULL
             AND (i.review_required OR i.conflict OR i.canonical_key IS NULL)), FALSE) AS review_required
           FROM v_page p LEFT JOIN v_review i ON i.doc_id = p.doc_id AND i.page_ord = p.page_ord
           GROUP BY p.doc_id, p.page_ord, p.review_required""",
    ),
)
def records_review(spark, sf):
    return normalize.review_records(pages(spark, sf), items(spark, sf), ["doc_id", "page_ord"]).select(
        "doc_id", "page_ord", "review_required"
    )


@query(
    "unify_fields",
    duck.with_views(
        ["v_unified"],
        """SELECT doc_id, competency, canonical_key, page_ord, item_ord, code, label, type, reference, value,
             CAST(occurrence AS BIGINT) AS occurrence FROM v_unified WHERE competency IS NOT NULL""",
    ),
)
def unify_fields(spark, sf):
    return unify.unify_fields(fields(spark, sf), pages(spark, sf)).select(
        *UNIFIED, "page_ord", "item_ord", F.col("occurrence").cast("long").alias("occurrence")
    )


@query(
    "unify_bases",
    duck.with_views(["v_ubase"], "SELECT * FROM v_ubase"),
)
def unify_bases(spark, sf):
    return unify.unify_bases(bases(spark, sf), pages(spark, sf)).select(
        "doc_id", "competency", "canonical_key", "page_ord", "item_ord", "label", "reference", "value",
        F.col("occurrence").cast("long").alias("occurrence"),
    )


@query(
    "unify_headers",
    duck.with_views(
        ["v_page"],
        """SELECT doc_id, competency, min(page_ord) AS page_ord, arg_min(record_key, page_ord) AS record_key,
             arg_min(company, page_ord) FILTER (company IS NOT NULL) AS company,
             arg_min(employee, page_ord) FILTER (employee IS NOT NULL) AS employee,
             arg_min(payment_date, page_ord) FILTER (payment_date IS NOT NULL) AS payment_date,
             bool_or(review_required) AS review_required, count(*) AS pages, 'unified' AS payroll_type
           FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2""",
    ),
)
def unify_headers(spark, sf):
    return unify.unify_headers(pages(spark, sf))


@query(
    "unify_provenance",
    duck.with_views(
        ["v_page"],
        """SELECT doc_id, competency, coalesce(payroll_type, 'normal') AS payroll_type, min(page_ord) AS first_page,
             count(*) AS pages FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2, 3""",
    ),
)
def unify_provenance(spark, sf):
    return unify.source_types(pages(spark, sf))


@query(
    "unify_unknown_first",
    duck.with_views(
        ["v_page"],
        """SELECT doc_id, competency, page_ord, record_key, payroll_type, review_required, 0 AS part FROM v_page
           WHERE competency IS NULL
           UNION ALL
           SELECT doc_id, competency, min(page_ord), arg_min(record_key, page_ord), 'unified', bool_or(review_required), 1
           FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2""",
    ),
)
def unify_unknown_first(spark, sf):
    p = pages(spark, sf)
    return unify.unknown_first(p, unify.unify_headers(p))
