"""Queries over two versions of the same records: halves, reconciliation, edits, accuracy; work batches and guard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import batches, benchmark, edits, guard, reconcile, text_extract, unify
from ..sources import testviews
from . import duck
from .catalogue import query
from .duck import q, view, with_views
from .queries_items import items, pages, raw
from .queries_text import texts
from .reuse import shared

PAGE = ["doc_id", "page_ord"]


def pk():
    """Part number inside the item position."""
    return F.expr("(item_ord % 1000000000000000000) div 10000000")


def line_no():
    return F.expr("item_ord div 1000000000000000000")



def halves(spark, sf):
    r = raw(spark, sf).select(*PAGE, "item_ord", "code", "label", "reference", "value").withColumn("pk", pk())
    left = r.where("pk % 3 <> 0").withColumn("value", F.when(F.col("pk") % 4 == 0, "").otherwise(F.col("value")))
    right = r.where("pk % 3 <> 1").withColumn("reference", F.when(F.col("pk") % 5 == 0, "").otherwise(F.col("reference")))
    return left, right


view("v_pk", ["v_raw"], "SELECT *, (item_ord % 1000000000000000000) // 10000000 AS pk FROM v_raw")
view("v_left", ["v_pk"], "SELECT doc_id, page_ord, item_ord, code, trim(label) AS label, lower(trim(label)) AS low, reference, CASE WHEN pk % 4 = 0 THEN '' ELSE value END AS value, CASE WHEN code <> '' THEN code || '-' || lower(trim(label)) ELSE lower(trim(label)) END AS key FROM v_pk WHERE pk % 3 <> 0")
view("v_right", ["v_pk"], "SELECT doc_id, page_ord, item_ord, code, trim(label) AS label, lower(trim(label)) AS low, CASE WHEN pk % 5 = 0 THEN '' ELSE reference END AS reference, value, CASE WHEN code <> '' THEN code || '-' || lower(trim(label)) ELSE lower(trim(label)) END AS key FROM v_pk WHERE pk % 3 <> 1")


@query(
    "merge_halves",
    with_views(
        ["v_left", "v_right"],
        """SELECT l.doc_id, l.page_ord, 0 AS src_rank, l.item_ord, CASE WHEN l.code <> '' THEN l.code ELSE coalesce(m.code, '') END AS code, l.label,
             CASE WHEN l.reference = '' THEN coalesce(m.reference, '') ELSE l.reference END AS reference,
             CASE WHEN l.value IN ('', '0,00') AND coalesce(m.value, '') <> '' THEN m.value ELSE l.value END AS value
           FROM v_left l LEFT JOIN (SELECT l.doc_id, l.page_ord, l.item_ord AS at, arg_min(r.code, r.item_ord) AS code, arg_min(r.reference, r.item_ord) AS reference, arg_min(r.value, r.item_ord) AS value
             FROM v_left l JOIN v_right r ON r.doc_id = l.doc_id AND r.page_ord = l.page_ord AND ((l.code <> '' AND l.code = r.code) OR (l.low <> '' AND l.low = r.low)) GROUP BY 1, 2, 3) m
           ON m.doc_id = l.doc_id AND m.page_ord = l.page_ord AND m.at = l.item_ord
           UNION ALL
           SELECT doc_id, page_ord, 1, item_ord, code, label, reference, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, key ORDER BY item_ord) AS rn FROM v_right r
             WHERE NOT EXISTS (SELECT 1 FROM v_left l WHERE l.doc_id = r.doc_id AND l.page_ord = r.page_ord AND l.key = r.key)) WHERE rn = 1""",
    ),
)
def merge_halves(spark, sf):
    return reconcile.merge_halves(*halves(spark, sf), PAGE)


@query(
    "merge_half_bases",
    with_views(
        ["v_left", "v_right"],
        """SELECT doc_id, page_ord, src_rank, item_ord, label, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, low, value ORDER BY src_rank, item_ord) AS rn
           FROM (SELECT *, 0 AS src_rank FROM v_left UNION ALL SELECT *, 1 FROM v_right) WHERE label <> '') WHERE rn = 1""",
    ),
)
def merge_half_bases(spark, sf):
    left, right = halves(spark, sf)
    return reconcile.merge_half_bases(left, right, PAGE)


@query(
    "merge_half_pages",
    with_views(
        ["v_page"],
        """SELECT doc_id, page_ord, CASE WHEN page_ord % 3 = 0 THEN '' ELSE month END AS month, year, TRUE AS is_horizontal_merged FROM v_page
           WHERE page_ord % 5 <> 0 AND page_ord % 7 = 0
           UNION ALL SELECT doc_id, page_ord, month, year, TRUE FROM v_page WHERE page_ord % 7 <> 0""",
    ),
)
def merge_half_pages(spark, sf):
    p = shared(pages(spark, sf).select(*PAGE, "month", "year"))
    left = p.where("page_ord % 5 <> 0").withColumn("month", F.when(F.col("page_ord") % 3 == 0, "").otherwise(F.col("month")))
    return reconcile.merge_half_pages(left, p.where("page_ord % 7 <> 0"), PAGE, ["month", "year"])


def two_extractions(spark, sf):
    r = raw(spark, sf).select(*PAGE, "item_ord", "code", "label", "reference", "value", "type", "evidence_type").withColumn("pk", pk())
    first = r.where("pk % 2 = 0").withColumn("value", F.when(F.col("pk") % 6 == 0, "").when(F.col("pk") % 10 == 0, "0,00").otherwise(F.col("value")))
    second = r.where("pk % 3 <> 0").withColumn("value", F.when(F.col("pk") % 13 == 0, "1,00").otherwise(F.col("value")))
    return first.drop("pk"), second.drop("pk")


view(
    "v_two",
    ["v_pk"],
    f"""SELECT *, CASE WHEN trim(code) <> '' THEN 'code:' || trim(code) ELSE 'label:' || {duck.label_key('label')} END AS identity FROM (
          SELECT doc_id, page_ord, 0 AS src_rank, item_ord, code, label, reference, CASE WHEN pk % 6 = 0 THEN '' WHEN pk % 10 = 0 THEN '0,00' ELSE value END AS value, type FROM v_pk WHERE pk % 2 = 0
          UNION ALL SELECT doc_id, page_ord, 1, item_ord, code, label, reference, CASE WHEN pk % 13 = 0 THEN '1,00' ELSE value END, type FROM v_pk WHERE pk % 3 <> 0)
        WHERE label <> '' OR code <> '' OR value <> ''""",
)
view(
    "v_two_seq",
    ["v_two"],
    """SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, identity ORDER BY src_rank, item_ord) AS rn FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, identity, trim(reference), trim(value), coalesce(type, '') ORDER BY src_rank, item_ord) AS copy FROM v_two) WHERE copy = 1""",
)
view(
    "v_two_fold",
    ["v_two_seq"],
    """/*recursive*/
  SELECT doc_id, page_ord, identity, rn, value AS s, TRUE AS took, FALSE AS clash, '' AS against, label AS hl, reference AS hr FROM v_two_seq WHERE rn = 1
  UNION ALL
  SELECT n.doc_id, n.page_ord, n.identity, n.rn, CASE WHEN f.s IN ('', '0,00') AND n.value <> '' THEN n.value ELSE f.s END, f.s IN ('', '0,00') AND n.value <> '',
         NOT (f.s IN ('', '0,00') AND n.value <> '') AND f.s <> '' AND n.value <> '' AND f.s <> n.value, f.s,
         CASE WHEN f.s IN ('', '0,00') AND n.value <> '' THEN n.label ELSE f.hl END, CASE WHEN f.s IN ('', '0,00') AND n.value <> '' THEN n.reference ELSE f.hr END
  FROM v_two_fold f JOIN v_two_seq n ON n.doc_id = f.doc_id AND n.page_ord = f.page_ord AND n.identity = f.identity AND n.rn = f.rn + 1""",
)
view(
    "v_reconciled",
    ["v_two_fold", "v_two_seq"],
    """SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, identity ORDER BY src_rank, item_ord) AS occurrence FROM (
         SELECT q.doc_id, q.page_ord, q.identity, q.src_rank, q.item_ord, CASE WHEN q.rn = 1 THEN e.hl ELSE q.label END AS label, CASE WHEN q.rn = 1 THEN e.hr ELSE q.reference END AS reference,
                CASE WHEN q.rn = 1 THEN e.s ELSE q.value END AS value, f.clash AS conflict, CASE WHEN f.clash THEN f.against END AS primary_value
         FROM v_two_seq q JOIN v_two_fold f ON f.doc_id = q.doc_id AND f.page_ord = q.page_ord AND f.identity = q.identity AND f.rn = q.rn
         JOIN (SELECT doc_id, page_ord, identity, arg_max(s, rn) AS s, arg_max(hl, rn) AS hl, arg_max(hr, rn) AS hr FROM v_two_fold GROUP BY 1, 2, 3) e
           ON e.doc_id = q.doc_id AND e.page_ord = q.page_ord AND e.identity = q.identity
         WHERE q.rn = 1 OR NOT f.took)""",
)


def reconciled(spark, sf):
    return reconcile.reconcile(*two_extractions(spark, sf), PAGE, F.struct("src_rank", line_no().alias("line")))


@query(
    "reconcile",
    with_views(["v_reconciled"], "SELECT doc_id, page_ord, identity, src_rank, item_ord, label, reference, value, conflict, primary_value, CAST(occurrence AS BIGINT) AS occurrence FROM v_reconciled"),
)
def reconcile_query(spark, sf):
    return reconciled(spark, sf).select(
        *PAGE, "identity", "src_rank", "item_ord", "label", "reference", "value", "conflict", "primary_value", F.col("occurrence").cast("long").alias("occurrence")
    )


@query("reconcile_conflicts", with_views(["v_reconciled"], "SELECT doc_id, page_ord, identity, primary_value, value AS secondary_value, src_rank, item_ord FROM v_reconciled WHERE conflict"))
def reconcile_conflicts(spark, sf):
    return reconcile.conflicts(reconciled(spark, sf), PAGE)


view("v_tot", ["v_sum"], """SELECT doc_id, page, arg_max(value, (line, seg)) FILTER (target = 'total_additions') AS total_additions, arg_max(value, (line, seg)) FILTER (target = 'total_deductions') AS total_deductions,
   arg_max(value, (line, seg)) FILTER (target = 'net_value') AS net_value FROM v_sum WHERE target <> 'base' GROUP BY 1, 2""")


@query(
    "merge_totals",
    with_views(
        ["v_tot"],
        """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, coalesce(nullif(a.t, ''), b.total_additions) AS total_additions,
             coalesce(a.total_deductions, b.total_deductions) AS total_deductions, coalesce(a.net_value, b.net_value) AS net_value
           FROM (SELECT *, CASE WHEN page % 3 = 0 THEN '' ELSE total_additions END AS t FROM v_tot WHERE page % 5 <> 0) a
           FULL JOIN (SELECT * FROM v_tot WHERE page % 4 <> 0) b ON a.doc_id = b.doc_id AND a.page = b.page""",
    ),
)
def merge_totals(spark, sf):
    totals = shared(text_extract.local_totals(text_extract.local_summaries(text_extract.segments(texts(spark, sf)))))
    first = totals.where("page % 5 <> 0").withColumn("total_additions", F.when(F.col("page") % 3 == 0, "").otherwise(F.col("total_additions")))
    return reconcile.merge_totals(first, totals.where("page % 4 <> 0"), ["doc_id", "page"])


@query(
    "item_accounting",
    with_views(
        ["v_item"],
        """SELECT doc_id, page_ord, f AS final_items, v AS ai_validated_items, d AS deterministic_items, greatest(0, f - d) AS ai_recovered_items, greatest(0, d - least(d, f)) AS pending_items
           FROM (SELECT doc_id, page_ord, count(*) AS f, count(*) FILTER (evidence_type LIKE 'ai%') AS v, count(*) FILTER (item_ord % 17 <> 0) AS d FROM v_item GROUP BY 1, 2)""",
    ),
)
def item_accounting(spark, sf):
    found = shared(items(spark, sf).select(*PAGE, "item_ord", "evidence_type"))
    return reconcile.item_accounting(found, found.where("item_ord % 17 <> 0"), PAGE)


view(
    "v_numbered",
    ["v_review"],
    """SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, kind, canonical_key ORDER BY item_ord) AS occurrence FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord, kind, canonical_key, reference, value ORDER BY item_ord) AS copy FROM v_review) WHERE copy = 1""",
)


def numbered(spark, sf):
    return unify.number_items(items(spark, sf), PAGE, line_no())


@query("items_numbered", with_views(["v_numbered"], "SELECT doc_id, page_ord, kind, canonical_key, item_ord, reference, value, CAST(occurrence AS BIGINT) AS occurrence FROM v_numbered"))
def items_numbered(spark, sf):
    return numbered(spark, sf).select(*PAGE, "kind", "canonical_key", "item_ord", "reference", "value", F.col("occurrence").cast("long").alias("occurrence"))


@query(
    "apply_cell_edits",
    with_views(
        ["v_numbered", "v_page"],
        """SELECT doc_id, page_ord, kind, canonical_key, occurrence, label, code, CASE WHEN page_ord % 50 = 0 AND occurrence = 1 THEN '9,99' ELSE value END AS value, FALSE AS is_new,
             page_ord % 50 = 0 AND occurrence = 1 AS edited FROM v_numbered
           UNION ALL SELECT doc_id, page_ord, 'field', 'field:code:99', 1, 'Novo item', '99', '5,00', TRUE, TRUE FROM v_page WHERE page_ord % 70 = 0""",
    ),
)
def apply_cell_edits(spark, sf):
    now = shared(numbered(spark, sf).withColumn("occurrence", F.col("occurrence").cast("long")))
    old = now.where((F.col("page_ord") % 50 == 0) & (F.col("occurrence") == 1)).select(
        *PAGE, "kind", "canonical_key", "occurrence", F.col("label").alias("header"), "code", F.lit("9,99").alias("new_value")
    )
    new = testviews.records(spark, sf).where("page_ord % 70 = 0").select(
        *PAGE, F.lit("field").alias("kind"), F.lit("field:code:99").alias("canonical_key"), F.lit(1).cast("long").alias("occurrence"),
        F.lit("Novo item 2").alias("header"), F.lit("99").alias("code"), F.lit("5,00").alias("new_value"),
    )
    return edits.apply_cell_edits(now, old.unionByName(new), PAGE).select(
        *PAGE, "kind", "canonical_key", "occurrence", "label", "code", "value", "is_new", "edited"
    )


@query(
    "apply_label_edits",
    with_views(
        ["v_review"],
        """SELECT doc_id, page_ord, item_ord, kind, CASE WHEN e THEN CASE WHEN kind = 'base' THEN 'Valor Líquido' ELSE 'Líquido a Receber' END ELSE label END AS label,
             CASE WHEN e THEN CASE WHEN kind = 'base' THEN 'base:valor_liquido' WHEN code <> '' THEN canonical_key ELSE 'field:label:valor liquido' END ELSE canonical_key END AS canonical_key,
             CASE WHEN e THEN conflict ELSE review_required END AS review_required
           FROM (SELECT *, page_ord % 40 = 0 AS e FROM v_review)""",
    ),
)
def apply_label_edits(spark, sf):
    now = shared(items(spark, sf))
    change = now.where("page_ord % 40 = 0").select(*PAGE, "item_ord", F.lit("Líquido a Receber").alias("new_label"))
    return edits.apply_label_edits(now, change, PAGE).select(*PAGE, "item_ord", "kind", "label", "canonical_key", "review_required")


@query(
    "apply_competency_edits",
    with_views(
        ["v_page"],
        """SELECT doc_id, page_ord, CASE WHEN page_ord % 30 = 0 THEN '05' WHEN page_ord % 45 = 0 THEN '7' ELSE month END AS month, CASE WHEN page_ord % 30 = 0 THEN '2001' ELSE year END AS year FROM v_page""",
    ),
)
def apply_competency_edits(spark, sf):
    p = shared(pages(spark, sf).select(*PAGE, "month", "year"))
    cell = F.when(F.col("page_ord") % 30 == 0, "05/2001").when(F.col("page_ord") % 45 == 0, "7")
    change = p.select(*PAGE, cell.alias("new_competency")).where(F.col("new_competency").isNotNull())
    return edits.apply_competency_edits(p, change, PAGE)


def batch_targets(spark, sf):
    page = shared(texts(spark, sf))
    key = ["doc_id", "page"]
    codes = text_extract.inventory_codes(page).select(*key, F.lit("fields").alias("kind"), "line", "pos", "evidence")
    lines = text_extract.inventory_unresolved(page).select(*key, F.lit("ambiguous").alias("kind"), "line", F.lit(0).alias("pos"), "evidence")
    sums = text_extract.inventory_summaries(page).select(*key, F.lit("summaries").alias("kind"), "line", F.lit(0).alias("pos"), "evidence")
    rows = codes.unionByName(lines).unionByName(sums)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*key, "kind").orderBy("line", "pos")))


view(
    "v_targets",
    ["v_icodes", "v_isum", "v_ilines"],
    """SELECT doc_id, page, kind, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY line, pos) AS ord, raw AS evidence FROM (
         SELECT i.doc_id, i.page, 'fields' AS kind, i.line, pos, raw FROM v_icodes i JOIN v_lines l ON l.doc_id = i.doc_id AND l.page = i.page AND l.line = i.line
         UNION ALL SELECT i.doc_id, i.page, 'summaries', i.line, 0, raw FROM v_isum i JOIN v_lines l ON l.doc_id = i.doc_id AND l.page = i.page AND l.line = i.line
         UNION ALL SELECT doc_id, page, 'ambiguous', line, 0, raw FROM v_ilines WHERE len(codes) = 0 AND has_money AND NOT regexp_matches(raw, '(?i)base|total|líquido|liquido|fgts|inss|irrf|irf|remunera|dias?\\s*/\\s*horas?'))""",
)
view(
    "v_spans",
    ["v_targets"],
    """/*recursive*/
  SELECT doc_id, page, kind, (ord - 1) // 6 AS chunk, list(evidence ORDER BY ord) AS ev, min(ord) AS base, 0 AS lo, CAST(count(*) AS INTEGER) AS n FROM v_targets GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT doc_id, page, kind, chunk, ev, base, lo + h * CAST(ceil(n / 2) AS INTEGER), CASE WHEN h = 0 THEN CAST(ceil(n / 2) AS INTEGER) ELSE n - CAST(ceil(n / 2) AS INTEGER) END
  FROM v_spans, (VALUES (0), (1)) s(h) WHERE n > 1 AND list_sum(list_transform(ev[lo + 1 : lo + n], lambda e: length(e) + 1)) > 500""",
)
view(
    "v_batches",
    ["v_spans"],
    """SELECT doc_id, page, kind, base + lo AS first_ord, n AS target_count, length(array_to_string(ev[lo + 1 : lo + n], chr(10))) AS payload_chars,
         len(regexp_extract_all(array_to_string(ev[lo + 1 : lo + n], chr(10)), '-?\\d{1,3}(?:\\.\\d{3})*,\\d{2}|-?\\d+(?:[.,]\\d+)?%')) AS numeric_values,
         length(array_to_string(ev[lo + 1 : lo + n], chr(10))) > 500 AS blocked
       FROM v_spans WHERE n = 1 OR list_sum(list_transform(ev[lo + 1 : lo + n], lambda e: length(e) + 1)) <= 500""",
)


@query(
    "work_batches",
    with_views(["v_batches"], "SELECT doc_id, page, kind, CAST(first_ord AS INTEGER) AS first_ord, target_count, CAST(numeric_values AS INTEGER) AS numeric_values, CAST(payload_chars AS INTEGER) AS payload_chars, blocked FROM v_batches"),
)
def work_batches(spark, sf):
    return batches.plan_batches(batch_targets(spark, sf), ["doc_id", "page"], max_chars=500)


@query(
    "planned_calls",
    with_views(
        ["v_batches"],
        """SELECT doc_id, page, f AS field_batches, a AS line_batches, s AS summary_passes, 2 + f + a AS planned_prompts FROM (SELECT doc_id, page, count(*) FILTER (kind = 'fields') AS f,
             count(*) FILTER (kind = 'ambiguous') AS a, count(*) FILTER (kind = 'summaries') AS s FROM v_batches GROUP BY 1, 2)""",
    ),
)
def planned_calls(spark, sf):
    return batches.planned_calls(batches.plan_batches(batch_targets(spark, sf), ["doc_id", "page"], max_chars=500), ["doc_id", "page"])


@query(
    "batch_gate",
    with_views(
        ["v_batches"],
        """SELECT violation, count(*) AS n FROM (SELECT CASE WHEN page % 11 = 0 THEN 'METADATA_REQUIRED' WHEN page % 13 = 0 THEN 'CONTEXT_REQUIRED' WHEN blocked THEN 'REQUIRES_SMALLER_REGION'
             WHEN target_count > 5 THEN 'TARGET_LIMIT' WHEN payload_chars > 400 THEN 'SIZE_LIMIT' END AS violation FROM v_batches) GROUP BY 1""",
    ),
)
def batch_gate(spark, sf):
    planned = batches.plan_batches(batch_targets(spark, sf), ["doc_id", "page"], max_chars=500)
    unit = F.concat(F.lit("page:"), F.col("page").cast("string"))
    named = batches.batch_ids(planned, ["doc_id", "page"], unit).withColumns(
        {
            "reason": F.when(F.col("page") % 11 != 0, "required_ai_extraction"), "record_key": unit,
            "region": F.when(F.col("page") % 13 != 0, unit), "strategy": F.lit("FICHA_ADAPTIVE_AI"),
        }
    )
    return named.withColumn("violation", batches.violation(5, 400)).groupBy("violation").agg(F.count("*").alias("n"))


PHRASES = [
    "Holerite Total Proventos Total Descontos Base INSS Salário Líquido ",
    "Espelho de Ponto Entrada Saída Jornada de Trabalho Banco de Horas ",
    "Contrato de prestação de serviços e condições comerciais ",
    "",
]


def _signals(patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(t, {q(p)})::INT" for p in patterns) + ")"


@query(
    "document_guard",
    f"""SELECT doc_id, CASE WHEN trim(t) = '' THEN 'scanned_unknown' WHEN weak AND tc >= 1 THEN 'rejected' WHEN weak AND ot >= 1 THEN 'rejected' WHEN weak THEN 'payroll_candidate' ELSE 'payroll' END AS classification,
          CASE WHEN trim(t) = '' THEN NULL WHEN weak AND tc >= 1 THEN {q(vocab.GUARD_REASON_TIMECARD)} WHEN weak AND ot >= 1 THEN {q(vocab.GUARD_REASON_OTHER)} END AS reason, pay AS payroll_signals,
          trim(t) = '' OR (weak AND tc < 1 AND ot < 1) AS requires_visual_validation
        FROM (SELECT *, {_signals(vocab.GUARD_PAYROLL)} AS pay, {_signals(vocab.GUARD_TIMECARD)} AS tc, {_signals(vocab.GUARD_OTHER)} AS ot,
                NOT regexp_matches(t, {q(vocab.GUARD_IDENTITY)}) AND {_signals(vocab.GUARD_PAYROLL)} < 2 AS weak
              FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(lower(strip_accents(CASE WHEN doc_id % 5 = 4 THEN '' ELSE
                      (CASE doc_id % 5 WHEN 0 THEN {q(PHRASES[0])} WHEN 1 THEN {q(PHRASES[1])} WHEN 2 THEN {q(PHRASES[2])} ELSE '' END) || text END)), '\\s+', ' ', 'g') AS t FROM documents))""",
)
def document_guard(spark, sf):
    docs = testviews.table(spark, sf, "documents")
    phrase = testviews._pick([*PHRASES, ""], (F.col("doc_id") % 5).cast("int"))
    body = F.when(F.col("doc_id") % 5 == 4, "").otherwise(F.concat(phrase, "text"))
    page = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), body.alias("text"))
    return guard.classify(guard.opening_text(page))


def truth_and_found(spark, sf):
    it = shared(items(spark, sf).where(F.col("kind") == "field").select(*PAGE, "item_ord", "code", "label", "value", "type").withColumn("pk", pk()))
    truth = it.withColumn("source", F.when(F.col("page_ord") % 10 == 0, "decimo_terceiro").otherwise("folha_normal"))
    found = it.where("pk % 17 <> 0").withColumns(
        {"code": F.when(F.col("pk") % 11 == 0, "").otherwise(F.col("code")), "value": F.when(F.col("pk") % 13 == 0, "1,00").otherwise(F.col("value"))}
    )
    return truth, found


_NUM = "CASE WHEN {0} = '' THEN NULL ELSE CAST(replace(replace({0}, '.', ''), ',', '.') AS DOUBLE) END"
view("v_truth", ["v_item"], f"""SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord ORDER BY item_ord) AS rn, {duck.label_key('label')} AS lkey, {_NUM.format('value')} AS number,
   CASE WHEN page_ord % 10 = 0 THEN 'decimo_terceiro' ELSE 'folha_normal' END AS source FROM v_item WHERE kind = 'field'""")
view(
    "v_found",
    ["v_truth"],
    f"""SELECT doc_id, page_ord, list({{'o': item_ord, 'code': c, 'lkey': lkey, 'num': num}} ORDER BY item_ord) AS have FROM (
          SELECT *, CASE WHEN pk % 11 = 0 THEN '' ELSE code END AS c, CASE WHEN pk % 13 = 0 THEN 1.0 ELSE number END AS num FROM (SELECT *, (item_ord % 1000000000000000000) // 10000000 AS pk FROM v_truth) WHERE pk % 17 <> 0) GROUP BY 1, 2""",
)
_FREE = "list_filter(have, lambda h: NOT list_contains(m.used, h.o))"
view(
    "v_match",
    ["v_truth", "v_found"],
    f"""/*recursive*/
  SELECT doc_id, page_ord, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS found_ord, CAST(NULL AS VARCHAR) AS match_type FROM (SELECT DISTINCT doc_id, page_ord FROM v_truth)
  UNION ALL
  SELECT doc_id, page_ord, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick, CASE WHEN a IS NOT NULL THEN 'by_code' WHEN b IS NOT NULL THEN 'by_label' WHEN c IS NOT NULL THEN 'by_substring' END
  FROM (SELECT *, coalesce(a, b, c) AS pick FROM (
    SELECT m.doc_id, m.page_ord, t.rn, m.used,
           CASE WHEN t.code <> '' THEN list_filter({_FREE}, lambda h: h.code = t.code)[1].o END AS a,
           CASE WHEN t.lkey <> '' THEN list_filter({_FREE}, lambda h: h.lkey = t.lkey)[1].o END AS b,
           CASE WHEN t.lkey <> '' THEN list_filter({_FREE}, lambda h: h.lkey <> '' AND (contains(h.lkey, t.lkey) OR contains(t.lkey, h.lkey)))[1].o END AS c
    FROM v_match m JOIN v_truth t ON t.doc_id = m.doc_id AND t.page_ord = m.page_ord AND t.rn = m.rn + 1 LEFT JOIN v_found f ON f.doc_id = m.doc_id AND f.page_ord = m.page_ord))""",
)
view(
    "v_matched",
    ["v_match", "v_found", "v_truth"],
    """SELECT t.doc_id, t.page_ord, t.item_ord, m.found_ord, m.match_type, t.source, t.number AS expected, f.num AS extracted, coalesce(abs(t.number - f.num) <= 0.01, FALSE) AS is_value_match
       FROM v_truth t JOIN v_match m ON m.doc_id = t.doc_id AND m.page_ord = t.page_ord AND m.rn = t.rn
       LEFT JOIN (SELECT doc_id, page_ord, unnest(have).o AS o, unnest(have).num AS num FROM v_found) f ON f.doc_id = t.doc_id AND f.page_ord = t.page_ord AND f.o = m.found_ord""",
)


@query("accuracy_items", with_views(["v_matched"], "SELECT doc_id, page_ord, item_ord, found_ord, match_type, source, expected, extracted, is_value_match, round(expected - extracted, 2) AS value_diff FROM v_matched"))
def accuracy_items(spark, sf):
    return benchmark.match_items(*truth_and_found(spark, sf), PAGE)


@query(
    "accuracy_extra",
    with_views(
        ["v_matched", "v_found"],
        """SELECT doc_id, page_ord, o AS item_ord FROM (SELECT doc_id, page_ord, unnest(have).o AS o FROM v_found) f
           WHERE NOT EXISTS (SELECT 1 FROM v_matched m WHERE m.doc_id = f.doc_id AND m.page_ord = f.page_ord AND m.found_ord = f.o)""",
    ),
)
def accuracy_extra(spark, sf):
    truth, found = truth_and_found(spark, sf)
    return benchmark.extra_items(found, benchmark.match_items(truth, found, PAGE), PAGE).select(*PAGE, "item_ord")


CHECKS = {"base:base_inss": "base_calculo_inss", "base:fgts_mes": "valor_fgts", "base:valor_liquido": "salario_liquido"}


def summary_truth(spark, sf):
    base = shared(items(spark, sf).where(F.col("kind") == "base").select(*PAGE, "item_ord", "canonical_key", "label", "value").withColumn("pk", pk()))
    from ..functions import money

    first = [
        F.min_by(money.parse_number(F.col("value")), F.when(F.col("canonical_key") == key, F.col("item_ord"))).alias(name) for key, name in CHECKS.items()
    ]
    found = base.where("pk % 17 <> 0").withColumn("value", F.when(F.col("pk") % 13 == 0, "1,00").otherwise(F.col("value")))
    return base.groupBy(*PAGE).agg(*first), found


view(
    "v_checks",
    ["v_item"],
    f"""SELECT doc_id, page_ord, label, expected, extracted, coalesce(abs(expected - extracted) <= 0.01, FALSE) AS matched FROM (
          SELECT doc_id, page_ord, CASE canonical_key WHEN 'base:base_inss' THEN 'Base INSS' WHEN 'base:fgts_mes' THEN 'Valor FGTS' ELSE 'Salário Líquido' END AS label, arg_min(num, item_ord) AS expected,
                 arg_min(CASE WHEN pk % 13 = 0 THEN 1.0 ELSE num END, item_ord) FILTER (pk % 17 <> 0) AS extracted
          FROM (SELECT *, (item_ord % 1000000000000000000) // 10000000 AS pk, {_NUM.format('value')} AS num FROM v_item WHERE kind = 'base' AND canonical_key IN ('base:base_inss', 'base:fgts_mes', 'base:valor_liquido')) GROUP BY doc_id, page_ord, canonical_key)
        WHERE expected IS NOT NULL""",
)


@query("accuracy_summaries", with_views(["v_checks"], "SELECT doc_id, page_ord, label, expected, extracted, matched FROM v_checks"))
def accuracy_summaries(spark, sf):
    return benchmark.check_summaries(*summary_truth(spark, sf), PAGE)


@query(
    "accuracy_score",
    with_views(
        ["v_matched", "v_checks", "v_found", "v_truth"],
        """SELECT pages, matched_pages, audited_items, matched_items, value_matches, extracted_items, checks, checks_matched,
             round((matched_items / audited_items * 35 + value_matches / matched_items * 30 + checks_matched / checks * 20 + matched_pages / pages * 15) / 10, 2) AS score10
           FROM (SELECT count(*) AS audited_items, count(found_ord) AS matched_items, count(*) FILTER (is_value_match) AS value_matches FROM v_matched),
                (SELECT count(*) AS checks, count(*) FILTER (matched) AS checks_matched FROM v_checks), (SELECT CAST(sum(len(have)) AS BIGINT) AS extracted_items, count(*) AS matched_pages FROM v_found),
                (SELECT count(DISTINCT (doc_id, page_ord)) AS pages FROM v_truth)""",
    ),
)
def accuracy_score(spark, sf):
    truth, found = truth_and_found(spark, sf)
    matches = shared(benchmark.match_items(truth, found, PAGE))
    seen = found.select(*PAGE).distinct().withColumn("found_in_extraction", F.lit(True))
    page = truth.select(*PAGE).distinct().join(seen, PAGE, "left").na.fill(False, ["found_in_extraction"])
    checks = benchmark.check_summaries(*summary_truth(spark, sf), PAGE)
    return benchmark.score(page, matches, found, checks).select(
        "pages", "matched_pages", "audited_items", "matched_items", "value_matches", "extracted_items", "checks", "checks_matched", "score10"
    )


@query(
    "one_record_per_month",
    with_views(
        ["v_page"],
        """SELECT doc_id, competency, arg_min(page_ord, (coalesce(payroll_type, '') <> 'normal', page_ord)) AS page_ord FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2""",
    ),
)
def one_record_per_month(spark, sf):
    known, _ = unify.split_unknown(pages(spark, sf))
    return benchmark.one_record_per_month(known.select("doc_id", "competency", "page_ord", "payroll_type"), ["doc_id", "competency"]).select("doc_id", "competency", "page_ord")


