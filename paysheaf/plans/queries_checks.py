"""Queries over single-value rules: dates, times, masks, evidence, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import reconcile, unify
from ..sources import testviews
from .catalogue import query
from .duck import with_views
from .queries_items import items, pages

_DATE = "CAST(o_orderkey % 33 AS VARCHAR) || '/' || CAST(o_custkey % 14 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 41 = 0 THEN '/20?0' ELSE '/' || CAST(1995 + o_custkey % 11 AS VARCHAR) END"
_TIME = """CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '0?:15' WHEN o_orderkey % 7 = 0 THEN lpad(CAST(o_custkey % 2400 AS VARCHAR), 4, '0')
  ELSE CAST(o_orderkey % 24 AS VARCHAR) || ':' || CAST(o_custkey % 60 AS VARCHAR) END"""


@query(
    "date_checks",
    f"""SELECT order_key, d AS printed_date, coalesce(NOT contains(d, '?') AND TRY_CAST(lpad(y, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) IS NOT NULL, FALSE) AS valid_date,
         CASE WHEN t = '' THEN '??:??' WHEN contains(t, '?') OR NOT (contains(t, ':') OR length(t) = 4) THEN t
              WHEN contains(t, ':') THEN lpad(split_part(t, ':', 1), 2, '0') || ':' || lpad(split_part(t, ':', 2), 2, '0') ELSE substr(t, 1, 2) || ':' || substr(t, 3, 2) END AS clock,
         CASE WHEN c < 0.7 THEN regexp_replace(o_clerk, '[a-zA-Z0-9]', '?', 'g') ELSE o_clerk END AS masked
       FROM (SELECT *, split_part(d, '/', 1) AS dd, split_part(d, '/', 2) AS m, coalesce(nullif(split_part(d, '/', 3), ''), '2024') AS y FROM (
         SELECT o_orderkey AS order_key, {_DATE} AS d, {_TIME} AS t, o_orderpriority AS o_clerk, (o_orderkey % 10) / 10.0 AS c FROM orders))""",
)
def date_checks(spark, sf):
    o = testviews.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.expr(_DATE.replace("VARCHAR", "STRING")).alias("d"), F.expr(_TIME.replace("VARCHAR", "STRING")).alias("t"),
        "o_orderpriority", ((F.col("o_orderkey") % 10) / 10).alias("c"),
    )
    return o.select(
        "order_key", F.col("d").alias("printed_date"), dates.is_valid_date(F.col("d")).alias("valid_date"), dates.normalize_time(F.col("t")).alias("clock"),
        dates.mask_uncertain(F.col("o_orderpriority"), F.col("c")).alias("masked"),
    )


@query(
    "item_evidence",
    with_views(
        ["v_item"],
        """SELECT doc_id, page_ord, item_ord, CASE WHEN page_ord % 3 = 0 THEN 99 ELSE page_ord END AS source_page, page_ord % 2 AS source_region,
             CASE WHEN evidence_type = 'ai' THEN 'local' ELSE evidence_type END AS evidence_type FROM v_item""",
    ),
)
def item_evidence(spark, sf):
    known = items(spark, sf).withColumns({
        "source_page": F.when(F.col("page_ord") % 3 == 0, F.lit(99).cast("bigint")), "source_region": F.lit(None).cast("bigint"),
        "evidence_type": F.when(F.col("evidence_type") != "ai", F.col("evidence_type")),
    })
    filled = reconcile.add_evidence(known, F.col("page_ord"), F.col("page_ord") % 2, "local")
    return filled.select("doc_id", "page_ord", "item_ord", "source_page", "source_region", "evidence_type")


@query("unified_sources", with_views(["v_page"], "SELECT doc_id, competency, page_ord, record_key FROM v_page WHERE competency IS NOT NULL"))
def unified_sources(spark, sf):
    return unify.provenance(pages(spark, sf)).select("doc_id", "competency", "page_ord", "record_key")
