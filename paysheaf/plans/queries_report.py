"""Queries that report on unified records: registry, export, sequence, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import audit, export, normalize, unify
from ..sources import testviews
from . import duck, segmented
from .catalogue import query
from .duck import view, with_views
from .queries_items import items, pages, raw
from .queries_pairs import PAGE, line_no
from .reuse import shared

KEYS = ["doc_id", "competency"]

view(
    "v_all",
    ["v_unified", "v_ubase", "v_review"],
    """
  SELECT u.doc_id, u.competency, 'field' AS kind, u.canonical_key, u.page_ord, u.item_ord, u.code, u.label, u.reference, u.value,
         u.occurrence, r.conflict OR r.review_required AS open, r.original_label
  FROM v_unified u JOIN v_review r ON r.doc_id = u.doc_id AND r.page_ord = u.page_ord AND r.item_ord = u.item_ord
  WHERE u.competency IS NOT NULL
  UNION ALL
  SELECT u.doc_id, u.competency, 'base', u.canonical_key, u.page_ord, u.item_ord, '', u.label, u.reference, u.value, u.occurrence,
         r.conflict OR r.review_required, r.original_label
  FROM v_ubase u JOIN v_review r ON r.doc_id = u.doc_id AND r.page_ord = u.page_ord AND r.item_ord = u.item_ord""",
)
view(
    "v_columns",
    ["v_all"],
    """
  SELECT doc_id, kind, canonical_key, occurrence, canonical_key || '#' || occurrence AS column_key, code, first_page, first_item,
         CASE WHEN occurrence = 1 THEN label ELSE label || ' ' || occurrence END AS header
  FROM (SELECT *, unnest(generate_series(1, n)) AS occurrence
        FROM (SELECT doc_id, kind, canonical_key, max(occurrence) AS n, arg_min(page_ord, (page_ord, item_ord)) AS first_page,
                     arg_min(item_ord, (page_ord, item_ord)) AS first_item, coalesce(arg_min(code, (page_ord, item_ord)) FILTER (code <> ''), '') AS code,
                     arg_max(label, (length(label), -page_ord, -item_ord)) AS label
              FROM v_all GROUP BY 1, 2, 3))""",
)
view(
    "v_final",
    ["v_page"],
    """
  SELECT doc_id, 0 AS part, page_ord, CAST(NULL AS VARCHAR) AS competency, month, year, payroll_type, review_required, company, employee FROM v_page
  WHERE competency IS NULL
  UNION ALL
  SELECT doc_id, 1, min(page_ord), competency, substr(competency, 1, 2), substr(competency, 4), 'unified', bool_or(review_required),
         arg_min(company, page_ord) FILTER (company IS NOT NULL), arg_min(employee, page_ord) FILTER (employee IS NOT NULL)
  FROM v_page WHERE competency IS NOT NULL GROUP BY doc_id, competency""",
)
_READ = "regexp_full_match(month, '0[1-9]|1[0-2]') AND regexp_full_match(year, '[0-9]{4}')"
view(
    "v_breaks",
    ["v_final"],
    f"""
  SELECT *, coalesce(month_no <> prior + 1, FALSE) AS non_sequential
  FROM (SELECT *, last_value(month_no IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY part, page_ord
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
        FROM (SELECT *, CASE WHEN {_READ} THEN CAST(year AS INTEGER) * 12 + CAST(month AS INTEGER) END AS month_no FROM v_final))""",
)


def unified(spark, sf):
    heads = shared(testviews.records(spark, sf))
    return unify.unified_items(normalize.canonical_items(testviews.raw_items(spark, sf, heads)), normalize.clean_records(heads))


def final_records(spark, sf, p=None, more=()):
    """Unknown records first, then one record per competency, with month and year (and ``more`` header columns)."""
    p = shared(unify.with_competency(pages(spark, sf))) if p is None else p
    head = unify.unify_headers(p).withColumns(
        {"month": F.substring("competency", 1, 2), "year": F.expr("substring(competency, 4)"), "part": F.lit(1)}
    )
    unknown = p.where(F.col("competency").isNull()).withColumn("part", F.lit(0))
    cols = ["doc_id", "part", "page_ord", "competency", "record_key", "month", "year", "payroll_type", "review_required", "company", "employee", "payment_date", *more]
    return unknown.select(*cols).unionByName(head.select(*cols))


@query(
    "column_registry",
    with_views(["v_columns"], "SELECT doc_id, kind, canonical_key, occurrence, column_key, header, code, first_page, first_item FROM v_columns"),
)
def column_registry(spark, sf):
    return export.column_registry(unified(spark, sf))


@query(
    "export_headers",
    with_views(
        ["v_columns"],
        f"""SELECT doc_id, column_key, 'value' AS property, header AS cell FROM v_columns
            UNION ALL SELECT doc_id, column_key, 'reference', header || {duck.q(vocab.REFERENCE_SUFFIX)} FROM v_columns WHERE kind = 'field'""",
    ),
)
def export_headers(spark, sf):
    return export.headers(export.column_registry(unified(spark, sf))).select("doc_id", "column_key", "property", "cell")


@query(
    "export_tall",
    with_views(
        ["v_all"],
        """SELECT doc_id, competency, canonical_key || '#' || occurrence AS column_key, 'value' AS property, value AS cell
           FROM v_all WHERE value <> ''
           UNION ALL SELECT doc_id, competency, canonical_key || '#' || occurrence, 'reference', reference
           FROM v_all WHERE kind = 'field' AND reference <> ''""",
    ),
)
def export_tall(spark, sf):
    return export.tall_cells(unified(spark, sf))


WIDE = [f"field:code:{n}#1" for n in range(17)] + ["base:base_inss#1", "base:fgts_mes#1", "base:valor_liquido#1"]


WIDE_CELLS = [(k, p) for k in WIDE for p in (("value", "reference") if k.startswith("field") else ("value",))]


@query(
    "export_wide",
    with_views(
        ["v_all"],
        "SELECT doc_id, competency, "
        + ", ".join(
            f"coalesce(max({p}) FILTER (canonical_key || '#' || occurrence = '{k}'"
            + f"), '') AS \"{k}_{p}\""
            for k, p in WIDE_CELLS
        )
        + """ FROM v_all GROUP BY 1, 2""",
    ),
)
def export_wide(spark, sf):
    merged = unified(spark, sf)
    return export.wide(merged.select(*KEYS).distinct(), export.tall_cells(merged), [(k, p, "") for k, p in WIDE_CELLS], KEYS)


@query(
    "non_sequential",
    with_views(["v_breaks"], "SELECT doc_id, part, page_ord, month, year, month_no, prior AS prior_month_no, non_sequential FROM v_breaks"),
)
def non_sequential(spark, sf):
    offset = F.when(F.col("part") == 0, F.lit(-(10**9))).otherwise(F.lit(0))
    return export.sequence_breaks(final_records(spark, sf), ["part", "page_ord"], segmented.page_segment() + offset).select(
        "doc_id", "part", "page_ord", "month", "year", "month_no", "prior_month_no", "non_sequential"
    )


@query(
    "non_sequential_pages",
    with_views(
        ["v_page"],
        f"""SELECT doc_id, page_ord, coalesce(month_no <> prior + 1, FALSE) AS non_sequential FROM (
              SELECT *, last_value(month_no IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_ord
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
              FROM (SELECT *, CASE WHEN {_READ} THEN CAST(year AS INTEGER) * 12 + CAST(month AS INTEGER) END AS month_no FROM v_page))""",
    ),
)
def non_sequential_pages(spark, sf):
    return export.sequence_breaks(pages(spark, sf), ["page_ord"], segmented.page_segment()).select("doc_id", "page_ord", "non_sequential")


@query(
    "editor_severity",
    with_views(
        ["v_page", "v_item"],
        f"""SELECT p.doc_id, p.page_ord, CASE WHEN non_sequential THEN 'danger'
               WHEN p.review_required OR coalesce(unsure, FALSE) OR (i.page_ord IS NULL AND month = '' AND year = '') THEN 'warning'
               ELSE '' END AS severity
            FROM (SELECT *, coalesce(readable AND substr(prior, 1, 1) = 't' AND number <> try_cast(substr(prior, 2) AS INTEGER) + 1, FALSE) AS non_sequential
                  FROM (SELECT *, last_value(CASE WHEN month <> '' AND year <> '' THEN CASE WHEN readable THEN 't' || number ELSE 'f' END END IGNORE NULLS)
                          OVER (PARTITION BY doc_id ORDER BY page_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
                        FROM (SELECT *, {_READ} AS readable,
                                CASE WHEN {_READ} THEN CAST(year AS INTEGER) * 12 + CAST(month AS INTEGER) END AS number FROM v_page))) p
            LEFT JOIN (SELECT doc_id, page_ord, bool_or(conflict OR contains(value, '?') OR contains(label, '?')) AS unsure
                       FROM v_item GROUP BY 1, 2) i ON i.doc_id = p.doc_id AND i.page_ord = p.page_ord""",
    ),
)
def editor_severity(spark, sf):
    broken = export.editor_breaks(pages(spark, sf), ["page_ord"], segmented.page_segment())
    return export.editor_severity(broken, items(spark, sf), ["doc_id", "page_ord"]).select("doc_id", "page_ord", "severity")


_ROWS = f"""
  SELECT b.doc_id, b.part, b.page_ord, b.month, b.year, {duck.case_map('b.payroll_type', vocab.PAYROLL_TYPE_LABELS, "'Folha normal'")} AS payroll_type,
         CASE WHEN b.review_required OR coalesce(s.open, FALSE) THEN 'Revisão necessária' ELSE '' END AS review,
         coalesce(s.observations, '') AS observations, coalesce(company, '') AS company, coalesce(employee, '') AS employee,
         coalesce(s.fields, 0) AS fields, coalesce(s.bases, 0) AS bases,
         CASE WHEN non_sequential THEN 'danger'
              WHEN b.review_required OR coalesce(s.open, FALSE) OR contains(b.month, '?') OR contains(coalesce(s.observations, ''), '?') OR contains(coalesce(company, ''), '?') OR contains(coalesce(employee, ''), '?') OR coalesce(s.unsure, FALSE)
                OR (s.fields IS NULL AND b.month = '' AND b.year = '') THEN 'warning' ELSE '' END AS severity
  FROM v_breaks b LEFT JOIN (
    SELECT doc_id, part, page_ord, bool_or(open) AS open, bool_or(contains(value, '?') OR contains(reference, '?')) AS unsure, count(*) FILTER (kind = 'field') AS fields, count(*) FILTER (kind = 'base') AS bases,
           coalesce(string_agg('Revisar: ' || coalesce(nullif(original_label, ''), nullif(label, ''), nullif(code, ''), 'item sem identificação'), ' | ' ORDER BY kind DESC, item_page, item_ord) FILTER (open), '') AS observations
    FROM (SELECT doc_id, 1 AS part, r.page_ord, kind, original_label, label, code, value, reference, open, a.page_ord AS item_page, item_ord
          FROM v_all a JOIN (SELECT doc_id, competency, min(page_ord) AS page_ord FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2) r USING (doc_id, competency)
          UNION ALL
          SELECT i.doc_id, 0, i.page_ord, kind, i.original_label, i.label, i.code, i.value, i.reference, conflict OR i.review_required, i.page_ord, item_ord
          FROM v_numbered i JOIN v_page p ON p.doc_id = i.doc_id AND p.page_ord = i.page_ord WHERE p.competency IS NULL)
    GROUP BY 1, 2, 3) s ON s.doc_id = b.doc_id AND s.part = b.part AND s.page_ord = b.page_ord"""


def sheet_parts(spark, sf, records):
    """(rows of fixed cells, items of the rows): items of merged months and of single records, each under its row."""
    canonical_items = shared(items(spark, sf))
    p = pages(spark, sf)
    merged = unify.unified_items(canonical_items, p)
    at = records.where(F.col("part") == 1).select("doc_id", "competency", F.col("page_ord").alias("row_page"))
    merged_rows = merged.join(at, KEYS).withColumn("part", F.lit(1))
    single = records.where(F.col("part") == 0).select("doc_id", "page_ord")
    open_flag = F.col("review_required") | F.coalesce("conflict", F.lit(False))
    numbered = unify.number_items(canonical_items, PAGE, line_no())
    single_rows = numbered.join(single, ["doc_id", "page_ord"]).withColumns(
        {"open": open_flag, "row_page": F.col("page_ord"), "part": F.lit(0)}
    )
    cols = ["doc_id", "part", "row_page", "page_ord", "item_ord", "kind", "canonical_key", "occurrence", "code", "label", "original_label", "reference", "value", "open"]
    both = shared(merged_rows.select(*cols).unionByName(single_rows.select(*cols)))
    signals = export.item_signals(both, ["doc_id", "part", "row_page"]).withColumnRenamed("row_page", "page_ord")
    return export.export_rows(records, signals, ROW), both


ROW = ["doc_id", "part", "page_ord"]


@query("export_rows", with_views(["v_breaks", "v_all", "v_numbered", "v_page"], _ROWS))
def export_rows(spark, sf):
    rows, _ = sheet_parts(spark, sf, final_records(spark, sf))
    return rows.select(*ROW, "month", "year", "payroll_type", "review", "observations", "company", "employee", "fields", "bases", "severity")


def sheet_pages(spark, sf):
    """Pages with more header values, derived from the ones they have."""
    tail = F.lit(":").cast("string")
    return pages(spark, sf).withColumns({
        "cnpj": F.concat(F.lit("J"), tail, "company"), "cpf": F.when(F.col("page_ord") % 4 != 0, F.concat(F.lit("F"), tail, "employee")),
        "role": F.when(F.col("page_ord") % 6 == 1, F.concat(F.lit("R"), F.col("page_ord").cast("string"))),
        "bank": F.when(F.col("page_ord") % 3 == 0, F.concat(F.lit("B"), F.col("page_ord").cast("string"))),
        "agency": F.when(F.col("page_ord") % 5 == 0, F.concat(F.lit("A"), F.col("page_ord").cast("string"))),
    })


_EXTRA = {"cnpj": "'J:' || company", "cpf": "CASE WHEN page_ord % 4 <> 0 THEN 'F:' || employee END", "role": "CASE WHEN page_ord % 6 = 1 THEN 'R' || page_ord END",
          "bank": "CASE WHEN page_ord % 3 = 0 THEN 'B' || page_ord END", "agency": "CASE WHEN page_ord % 5 = 0 THEN 'A' || page_ord END"}
view("v_heads", ["v_page"], f"SELECT doc_id, page_ord, competency, company, employee, {', '.join(f'{e} AS {c}' for c, e in _EXTRA.items())} FROM v_page")


def _first(group: list[str]) -> str:
    """Values of the first page of a month that has any of them."""
    some = " OR ".join(f"{c} IS NOT NULL" for c in group)
    return f"LEFT JOIN (SELECT DISTINCT ON (doc_id, competency) doc_id, competency, {', '.join(group)} FROM v_heads WHERE competency IS NOT NULL AND ({some}) ORDER BY doc_id, competency, page_ord) USING (doc_id, competency)"


view(
    "v_sheet",
    ["v_final", "v_heads"],
    f"""SELECT doc_id, part, page_ord, company, cnpj, employee, cpf, role, bank, agency FROM (SELECT doc_id, competency, part, page_ord FROM v_final WHERE part = 1)
          {_first(["company", "cnpj"])} {_first(["employee", "cpf", "role"])} {_first(["bank", "agency"])}
        UNION ALL SELECT doc_id, 0, page_ord, company, cnpj, employee, cpf, role, bank, agency FROM v_heads WHERE competency IS NULL""",
)


view("v_rows", ["v_breaks", "v_all", "v_numbered", "v_page"], _ROWS)
view(
    "v_cells",
    ["v_all", "v_numbered", "v_page"],
    """SELECT doc_id, 1 AS part, r.page_ord, a.kind, canonical_key || '#' || occurrence AS k, arg_min(value, (a.page_ord, item_ord)) AS v, arg_min(reference, (a.page_ord, item_ord)) AS f
       FROM v_all a JOIN (SELECT doc_id, competency, min(page_ord) AS page_ord FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2) r USING (doc_id, competency)
       WHERE canonical_key IS NOT NULL GROUP BY 1, 2, 3, 4, 5
       UNION ALL
       SELECT i.doc_id, 0, i.page_ord, kind, canonical_key || '#' || occurrence, arg_min(value, item_ord), arg_min(reference, item_ord) FROM v_numbered i JOIN v_page p
         ON p.doc_id = i.doc_id AND p.page_ord = i.page_ord WHERE p.competency IS NULL AND canonical_key IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
)


_FIXED = [("page", "page_ord", "v_rows"), *[(c, c, "v_rows") for c in ("month", "year", "payroll_type", "review", "observations")],
          *[(c, c, "v_sheet") for c in ("company", "cnpj", "employee", "cpf", "role", "bank", "agency")]]


@query(
    "export_sheet",
    with_views(
        ["v_rows", "v_cells", "v_sheet"],
        "SELECT doc_id, part, page_ord, c AS cell, v AS printed FROM ("
        + " UNION ALL ".join(f"SELECT doc_id, part, page_ord, '{c}' AS c, CAST({e} AS VARCHAR) AS v FROM {t}" for c, e, t in _FIXED)
        + """ UNION ALL SELECT doc_id, part, page_ord, k || '_value', v FROM v_cells
              UNION ALL SELECT doc_id, part, page_ord, k || '_reference', f FROM v_cells WHERE kind = 'field') WHERE v <> ''""",
    ),
)
def export_sheet(spark, sf):
    """The whole sheet, one row per filled cell: all records, fixed cells and item columns."""
    p = shared(unify.with_competency(sheet_pages(spark, sf)))
    records = final_records(spark, sf, p, list(_EXTRA))
    rows, row_items = sheet_parts(spark, sf, records)
    merged = row_items.withColumnRenamed("page_ord", "item_page").withColumnRenamed("row_page", "page_ord")
    columns = export.column_registry(row_items)
    printed = export.sheet(rows.drop("fields", "bases", "severity"), merged.withColumn("item_ord", F.struct("item_page", "item_ord")), columns, ROW)
    return printed.select(*ROW, "cell", "printed")


@query(
    "nested_records",
    with_views(
        ["v_all"],
        """SELECT doc_id, competency, count(*) FILTER (kind = 'field') AS n_fields, count(*) FILTER (kind = 'base') AS n_bases,
             coalesce(string_agg(canonical_key || '=' || value, ';' ORDER BY page_ord, item_ord) FILTER (kind = 'field'), '') AS fields_text FROM v_all GROUP BY 1, 2""",
    ),
)
def nested_records(spark, sf):
    merged = unified(spark, sf)
    nested = export.nested_records(merged.select(*KEYS).distinct(), merged, KEYS)
    text_of = F.array_join(F.transform("fields", lambda i: F.concat(i["canonical_key"], F.lit("="), i["value"])), ";")
    return nested.select(
        *KEYS, F.size("fields").cast("long").alias("n_fields"), F.size("bases").cast("long").alias("n_bases"), text_of.alias("fields_text")
    )


@query(
    "best_candidate",
    with_views(
        ["v_review"],
        """SELECT doc_id, page_ord, canonical_key, arg_min(item_ord, k) AS item_ord, arg_min(value, k) AS value,
             bool_or(many) OR arg_min(conflict, k) AS conflict
           FROM (SELECT *, ((conflict OR review_required)::INT, -confidence, item_ord) AS k,
                   count(DISTINCT nullif(value, '')) OVER (PARTITION BY doc_id, page_ord, canonical_key) > 1 AS many
                 FROM v_review WHERE canonical_key IS NOT NULL) GROUP BY 1, 2, 3""",
    ),
)
def best_candidate(spark, sf):
    return export.best_candidate(items(spark, sf), ["doc_id", "page_ord"]).select(
        "doc_id", "page_ord", "canonical_key", "item_ord", "value", "conflict"
    )


def audited(spark, sf):
    return pages(spark, sf).withColumn("is_inferred", F.col("order_key") % 41 == 0)


view(
    "v_flag",
    ["v_page"],
    """
  SELECT *, CASE WHEN invalid IS NULL AND NOT missing THEN lpad(month, 2, '0') || '/' || year END AS comp,
         coalesce(payroll_type, 'normal') AS event_type
  FROM (SELECT * EXCLUDE (competency), month = '' OR year = '' AS missing,
          CASE WHEN month = '' OR year = '' THEN NULL
               WHEN NOT coalesce(try_cast(regexp_extract(month, '^[0-9]+') AS INTEGER) BETWEEN 1 AND 12, FALSE) THEN 'Mês inválido'
               WHEN NOT coalesce(try_cast(regexp_extract(year, '^[0-9]+') AS INTEGER) BETWEEN 1990 AND 2100, FALSE) THEN 'Ano inválido'
               WHEN contains(month || year, '?') THEN 'Formato ambíguo' END AS invalid,
          order_key % 41 = 0 AND month <> '' AND year <> '' AS inferred FROM v_page)""",
)
view("v_events", ["v_flag"], "SELECT doc_id, comp, event_type, count(*) AS n FROM v_flag WHERE comp IS NOT NULL GROUP BY 1, 2, 3")
view("v_months", ["v_events"], "SELECT doc_id, comp, sum(n) AS n, count(*) AS types FROM v_events GROUP BY 1, 2")


@query(
    "audit_findings",
    with_views(
        ["v_flag", "v_events", "v_months"],
        """
SELECT doc_id, 'missing_evidence' AS finding, CAST(page_ord AS VARCHAR) AS page, NULL AS competency, NULL AS payroll_type, NULL AS record_key,
       'Página ' || page_ord || ': Competência não evidenciada no documento.' AS detail FROM v_flag WHERE missing
UNION ALL SELECT doc_id, 'inferred', CAST(page_ord AS VARCHAR), month || '/' || year, NULL, NULL,
       'Página ' || page_ord || ': Competência ' || month || '/' || year || ' foi marcada como inferida.' FROM v_flag WHERE inferred
UNION ALL SELECT doc_id, 'invalid_format', CAST(page_ord AS VARCHAR), month || '/' || year, NULL, NULL, invalid FROM v_flag WHERE invalid IS NOT NULL
UNION ALL SELECT doc_id, 'duplicate_competency', NULL, comp, NULL, NULL, 'aparece duplicada (' || CAST(n AS BIGINT) || ' vezes)' FROM v_months WHERE n > 1 AND types = 1
UNION ALL SELECT e.doc_id, 'legitimate_repeat', NULL, e.comp, e.event_type, NULL, NULL FROM v_events e JOIN v_months m USING (doc_id, comp) WHERE types > 1
UNION ALL SELECT f.doc_id, 'duplicate_event', CAST(page_ord AS VARCHAR), f.comp, f.event_type, record_key, NULL
  FROM v_flag f JOIN v_events e USING (doc_id, comp, event_type) WHERE e.n > 1
UNION ALL SELECT doc_id, 'year_inconsistency', NULL, NULL, NULL, NULL, string_agg(DISTINCT year, ', ' ORDER BY year) FROM v_flag WHERE comp IS NOT NULL
  GROUP BY doc_id HAVING count(DISTINCT year) > 2""",
    ),
)
def audit_findings(spark, sf):
    return audit.findings(audited(spark, sf))


@query(
    "audit_status",
    with_views(
        ["v_flag", "v_events", "v_months"],
        """SELECT *, CASE WHEN duplicates + invalid_formats + missing_evidence + inferred > 0 OR years > 2 THEN 'review_required' ELSE 'ok' END AS status
           FROM (SELECT f.doc_id, count(DISTINCT comp) AS competencies,
                   (SELECT count(*) FROM v_months m WHERE m.doc_id = f.doc_id AND n > 1 AND types = 1)
                   + (SELECT count(*) FROM v_events e WHERE e.doc_id = f.doc_id AND n > 1) AS duplicates,
                   (SELECT count(*) FROM v_months m WHERE m.doc_id = f.doc_id AND types > 1) AS legitimate_repeats,
                   count(*) FILTER (invalid IS NOT NULL) AS invalid_formats, count(*) FILTER (missing) AS missing_evidence,
                   count(*) FILTER (inferred) AS inferred, count(DISTINCT year) FILTER (comp IS NOT NULL) AS years
                 FROM v_flag f GROUP BY f.doc_id)""",
    ),
)
def audit_status(spark, sf):
    return audit.document_status(audited(spark, sf))


@query(
    "nested_result",
    with_views(
        ["v_all", "v_final", "v_flag", "v_events", "v_months"],
        """SELECT f.doc_id, f.competency, f.part, f.page_ord, f.company, f.review_required, coalesce(n_fields, 0) AS n_fields, coalesce(fields_text, '') AS fields_text,
             coalesce(bases_text, '') AS bases_text, d.missing AS audit_missing, d.invalid AS audit_invalid,
             CASE WHEN d.missing + d.invalid + d.inferred > 0 OR d.years > 2 OR coalesce(r.n, 0) > 0 OR coalesce(m.n, 0) > 0 THEN 'review_required' ELSE 'ok' END AS audit_status
           FROM v_final f LEFT JOIN (SELECT doc_id, competency, count(*) FILTER (kind = 'field') AS n_fields,
               coalesce(string_agg(canonical_key || '#' || occurrence || '=' || reference || '/' || value, ';' ORDER BY page_ord, item_ord) FILTER (kind = 'field'), '') AS fields_text,
               coalesce(string_agg(label || '=' || value, ';' ORDER BY page_ord, item_ord) FILTER (kind = 'base'), '') AS bases_text FROM v_all GROUP BY 1, 2) a
             ON a.doc_id = f.doc_id AND a.competency IS NOT DISTINCT FROM f.competency
           JOIN (SELECT doc_id, count(*) FILTER (missing) AS missing, count(*) FILTER (invalid IS NOT NULL) AS invalid, count(*) FILTER (inferred) AS inferred,
                   count(DISTINCT year) FILTER (comp IS NOT NULL) AS years FROM v_flag GROUP BY 1) d ON d.doc_id = f.doc_id
           LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_events WHERE n > 1 GROUP BY 1) r ON r.doc_id = f.doc_id
           LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_months WHERE n > 1 AND types = 1 GROUP BY 1) m ON m.doc_id = f.doc_id""",
    ),
)
def nested_result(spark, sf):
    nested = export.nested_result(final_records(spark, sf), unified(spark, sf), audit.document_status(audited(spark, sf)), KEYS)
    printed = lambda c, of: F.array_join(F.transform(c, of), ";")
    field = lambda i: F.concat(i["canonical_key"], F.lit("#"), i["occurrence"].cast("string"), F.lit("="), i["reference"], F.lit("/"), i["value"])
    return nested.select(
        *KEYS, "page.part", "page.page_ord", "page.company", "page.review_required", F.size("fields").cast("long").alias("n_fields"), printed("fields", field).alias("fields_text"),
        printed("bases", lambda i: F.concat(i["label"], F.lit("="), i["value"])).alias("bases_text"),
        F.col("audit.missing_evidence").alias("audit_missing"), F.col("audit.invalid_formats").alias("audit_invalid"), F.col("audit.status").alias("audit_status"),
    )


def metrics(spark, sf):
    """Extraction metrics per record; a third of the rows use the older column names."""
    it = raw(spark, sf)
    counts = it.groupBy("doc_id", "page_ord", "order_key").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("blank"), F.count_if(F.col("conflict")).alias("clash")
    )
    old, bare = F.col("order_key") % 3 == 0, F.col("order_key") % 3 == 1
    none = F.lit(None).cast("long")
    return counts.select(
        "doc_id", "page_ord",
        F.when(old, none).otherwise(F.col("n") - F.col("blank")).alias("deterministic_items"),
        F.when(old, F.col("n")).alias("local_items"),
        F.when(old, none).otherwise(F.col("blank")).alias("ai_recovered_items"), F.when(old, F.col("blank")).alias("ai_items"),
        F.col("clash").alias("ai_validated_items"),
        F.when(bare, F.col("n") + 1).alias("visible_items"), F.when(old, F.lit(0).cast("long")).alias("expected_count"),
        none.alias("extracted_count"), F.when(F.col("order_key") % 6 == 1, F.col("clash")).alias("pending_items"),
        F.when(old, none).otherwise(F.lit(2).cast("long")).alias("planned_batches"), F.lit(3).cast("long").alias("planned_prompts"),
        F.when(F.col("order_key") % 5 == 0, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("executed_prompts"),
        F.when(old, "SPATIAL").when(bare, "TEXT").alias("strategy"),
    )


view(
    "v_metrics",
    ["v_raw"],
    """
  SELECT *, CASE WHEN vis > 0 THEN greatest(0.0, least(1.0, CAST(vis - pend AS DOUBLE) / vis)) WHEN pend <> 0 THEN 0.0 ELSE 1.0 END AS coverage
  FROM (SELECT *, coalesce(pending, greatest(0, vis - least(vis, det + rec))) AS pend
        FROM (SELECT doc_id, page_ord, order_key, CASE WHEN order_key % 3 = 0 THEN n ELSE n - blank END AS det, blank AS rec, clash AS val,
                CASE WHEN order_key % 3 = 1 THEN n + 1 WHEN order_key % 3 = 0 THEN n + blank ELSE n END AS vis,
                CASE WHEN order_key % 6 = 1 THEN clash END AS pending, CASE WHEN order_key % 3 = 0 THEN 3 ELSE 2 END AS planned,
                CASE WHEN order_key % 5 = 0 THEN 0 ELSE 1 END AS executed,
                CASE order_key % 3 WHEN 0 THEN 'SPATIAL' WHEN 1 THEN 'TEXT' END AS strategy
              FROM (SELECT doc_id, page_ord, order_key, count(*) AS n, count(*) FILTER (value = '') AS blank, count(*) FILTER (conflict) AS clash
                    FROM v_raw GROUP BY 1, 2, 3)))""",
)


@query(
    "metrics_normalized",
    with_views(
        ["v_metrics"],
        """SELECT doc_id, page_ord, strategy, vis AS visible_items, det AS deterministic_items, rec AS ai_recovered_items, val AS ai_validated_items,
             pend AS pending_items, coverage, CAST(planned AS BIGINT) AS planned_batches, CAST(executed AS BIGINT) AS executed_prompts FROM v_metrics""",
    ),
)
def metrics_normalized(spark, sf):
    return audit.normalize_metrics(metrics(spark, sf))


@query(
    "metrics_rollup",
    with_views(
        ["v_metrics"],
        """SELECT doc_id, count(*) AS units, CAST(sum(vis) AS BIGINT) AS visible_items, CAST(sum(det) AS BIGINT) AS deterministic_items,
             CAST(sum(rec) AS BIGINT) AS ai_recovered_items, CAST(sum(val) AS BIGINT) AS ai_validated_items, CAST(sum(pend) AS BIGINT) AS pending_items,
             CAST(sum(planned) AS BIGINT) AS planned_batches, CAST(sum(executed) AS BIGINT) AS executed_prompts,
             CASE WHEN sum(vis) <> 0 THEN CAST(sum(vis) - sum(pend) AS DOUBLE) / sum(vis) ELSE 1.0 END AS coverage,
             CAST(greatest(0, sum(vis) - sum(pend)) AS BIGINT) AS extracted_items FROM v_metrics GROUP BY 1""",
    ),
)
def metrics_rollup(spark, sf):
    return audit.rollup_metrics(audit.normalize_metrics(metrics(spark, sf)))


@query(
    "metrics_strategies",
    with_views(["v_metrics"], "SELECT doc_id, strategy, min(page_ord) AS first_page, count(*) AS units FROM v_metrics WHERE strategy IS NOT NULL GROUP BY 1, 2"),
)
def metrics_strategies(spark, sf):
    return audit.strategies(metrics(spark, sf))


view(
    "v_warn",
    ["v_page"],
    """SELECT doc_id, warning, min(page_ord) AS first_page FROM (
         SELECT doc_id, page_ord, CASE WHEN month <> '' AND year <> '' THEN month || '/' || year ELSE 'página ' || page_ord END
           || ' (' || coalesce(payroll_type, 'normal') || '): itens ambíguos ou conflitantes exigem revisão.' AS warning
         FROM v_page WHERE review_required) GROUP BY 1, 2""",
)


@query("review_warnings", with_views(["v_warn"], "SELECT * FROM v_warn"))
def review_warnings(spark, sf):
    return audit.review_warnings(pages(spark, sf))


@query(
    "warning_banner",
    with_views(
        ["v_warn"],
        """SELECT doc_id, string_agg(warning, ' ' ORDER BY rn) FILTER (rn <= 3) AS shown, greatest(count(*) - 3, 0) AS more
           FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, warning) AS rn FROM v_warn) GROUP BY 1""",
    ),
)
def warning_banner(spark, sf):
    return audit.banner(audit.review_warnings(pages(spark, sf)))


