"""Queries over page text: catalog, extraction, inventory, coverage, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, vocab
from ..operators import catalog, coverage, reconcile, text_extract
from ..sources import testviews
from . import duck
from .catalogue import query
from .duck import q, view, with_views
from .queries_items import items, raw
from .reuse import shared

PAGE = ["doc_id", "page"]

view(
    "v_catalog",
    [],
    "SELECT *, " + duck.label_key("alias") + " AS alias_key FROM ("
    + duck.values([(i, g, k, a) for i, (_, g, k, _, a) in enumerate(vocab.catalog_rows())], "ord", "category", "category_kind", "alias") + ")",
)


def classified(name: str, source: str, needs: list[str]) -> None:
    """A view (lkey -> category) for the distinct label keys of a source query."""
    view(
        name,
        [*needs, "v_catalog"],
        f"""SELECT lkey, arg_min(category, (-length(alias_key), ord)) AS category, arg_min(category_kind, (-length(alias_key), ord)) AS category_kind,
                   arg_min(alias, (-length(alias_key), ord)) AS alias
            FROM ({source}) k JOIN v_catalog c ON lkey <> '' AND (contains(lkey, alias_key) OR contains(alias_key, lkey)) GROUP BY lkey""",
    )


classified("v_class_items", "SELECT DISTINCT lkey FROM v_keyed", ["v_keyed"])


@query(
    "label_catalog",
    with_views(
        ["v_keyed", "v_class_items"],
        """SELECT label, category, category_kind, alias, count(*) AS items FROM v_keyed k LEFT JOIN v_class_items c ON c.lkey = k.lkey GROUP BY ALL""",
    ),
)
def label_catalog(spark, sf):
    counted = raw(spark, sf).groupBy("label").agg(F.count("*").alias("items"))
    return counted.withColumn("hit", catalog.classify(F.col("label"))).select(
        "label", F.col("hit.category").alias("category"), F.col("hit.kind").alias("category_kind"), F.col("hit.alias").alias("alias"), "items"
    )


@query(
    "catalog_dimension",
    with_views(["v_catalog", "v_keyed"], """SELECT c.category, c.category_kind, c.alias, c.alias_key, coalesce(n, 0) AS items FROM v_catalog c
      LEFT JOIN (SELECT lkey, count(*) AS n FROM v_keyed GROUP BY 1) k ON k.lkey = c.alias_key"""),
)
def catalog_dimension(spark, sf):
    counts = raw(spark, sf).groupBy(text.label_key(F.col("label")).alias("alias_key")).agg(F.count("*").alias("items"))
    return catalog.dimension(spark).join(counts, "alias_key", "left").select(
        "category", F.col("kind").alias("category_kind"), "alias", "alias_key", F.coalesce("items", F.lit(0)).alias("items")
    )


@query(
    "catalog_hints",
    with_views(
        ["v_keyed", "v_class_items"],
        """SELECT doc_id, page_ord, category, category_kind, CAST(rn AS INTEGER) AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id, page_ord ORDER BY first) AS rn FROM (
               SELECT doc_id, page_ord, category, category_kind, min(item_ord) AS first FROM v_keyed k JOIN v_class_items c ON c.lkey = k.lkey GROUP BY 1, 2, 3, 4))
           WHERE rn <= 12""",
    ),
)
def catalog_hints(spark, sf):
    return catalog.hints(raw(spark, sf), ["doc_id", "page_ord"], ["item_ord"])


@query(
    "labels_deduplicated",
    with_views(
        ["v_keyed"],
        """SELECT doc_id, lkey AS label_key, arg_max(label, (length(label), -page_ord, -item_ord)) AS label,
             arg_min(page_ord, (page_ord, item_ord)) AS page_ord, arg_min(item_ord, (page_ord, item_ord)) AS item_ord
           FROM v_keyed WHERE lkey <> '' GROUP BY 1, 2""",
    ),
)
def labels_deduplicated(spark, sf):
    return catalog.deduplicate_labels(raw(spark, sf), ["doc_id"], ["page_ord", "item_ord"])


@query(
    "field_map_canonical",
    with_views(
        ["v_keyed"],
        """SELECT doc_id, page_ord, lkey AS label_key, arg_min(label, (value = '', item_ord)) AS original_label,
             arg_min(value, (value = '', item_ord)) AS value FROM v_keyed WHERE lkey <> '' GROUP BY 1, 2, 3""",
    ),
)
def field_map_canonical(spark, sf):
    return catalog.canonical_map(raw(spark, sf), ["doc_id", "page_ord"], "item_ord")


EXISTING = ["Salario Base", "Vale-Transporte", "salário  base", "IR", "Horas extras"]


@query(
    "similar_label",
    with_views(
        ["v_keyed"],
        "SELECT label, CASE lkey WHEN 'salario base' THEN 'Salario Base' WHEN 'vale transporte' THEN 'Vale-Transporte' WHEN 'irrf' THEN 'IR' "
        "WHEN 'horas extras' THEN 'Horas extras' END AS similar, count(*) AS items FROM v_keyed GROUP BY ALL",
    ),
)
def similar_label(spark, sf):
    counted = raw(spark, sf).groupBy("label").agg(F.count("*").alias("items"))
    known = F.array(*[F.lit(v) for v in EXISTING])
    return counted.select("label", catalog.find_similar(F.col("label"), known).alias("similar"), "items")


_M = r"-?\d{1,3}(?:\.\d{3})*,\d{2}|-?\d+[.,]\d{2}"
view(
    "v_text",
    ["v_raw", "v_page"],
    f"""
  SELECT r.doc_id, r.page_ord AS page, r.order_key, raw_month || '/' || raw_year AS period,
         'Competência: ' || raw_month || '/' || raw_year || chr(10) || body || chr(10)
         || 'TOTAL PROVENTOS ' || {duck.cents('plus')} || chr(10) || 'TOTAL DESCONTOS ' || {duck.cents('minus')} || chr(10)
         || 'VALOR LÍQUIDO ' || CASE WHEN plus < minus THEN '-' ELSE '' END || {duck.cents('abs(plus - minus)')} || chr(10)
         || 'BASE DE CÁLCULO DO INSS ' || {duck.cents('plus')} || chr(10) || 'FGTS EMPRESA ' || {duck.cents('minus')} || chr(10)
         || 'Outros valores ' || {duck.cents('minus')} AS text
  FROM (SELECT doc_id, page_ord, order_key, string_agg(line, chr(10) ORDER BY n) AS body, CAST(sum(plus) AS BIGINT) AS plus, CAST(sum(minus) AS BIGINT) AS minus
        FROM (SELECT doc_id, page_ord, order_key, rn // 2 AS n, string_agg(chunk, '  |  ' ORDER BY rn) AS line,
                     sum(CASE WHEN type = 'desconto' THEN 0 ELSE c END) AS plus, sum(CASE WHEN type = 'desconto' THEN c ELSE 0 END) AS minus
              FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY item_ord) - 1 AS rn,
                           CASE WHEN value = '' THEN 0 ELSE CAST(replace(replace(value, '.', ''), ',', '') AS BIGINT) END AS c,
                           concat_ws('  |  ', trim(code || ' ' || label), nullif(reference, ''), nullif(value, '')) AS chunk
                    FROM v_raw) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) r
  JOIN v_page p ON p.order_key = r.order_key""",
)
view(
    "v_lines",
    ["v_text"],
    "SELECT doc_id, page, text, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM v_text",
)
_C = "^[-–]?\\s*[0-9]{1,4}\\s+[A-Za-zÀ-ÿ]"
view(
    "v_segs",
    ["v_lines"],
    f"""
  SELECT *, regexp_extract_all(segment, {q(_M)}) AS amounts,
         regexp_extract(segment, '^[-–]?\\s*([0-9]{{1,4}})\\s+(.+?)\\s+-?[0-9]', 1) AS code,
         regexp_extract(segment, '^[-–]?\\s*([0-9]{{1,4}})\\s+(.+?)\\s+-?[0-9]', 2) AS words
  FROM (SELECT doc_id, page, line, g - 1 AS seg, string_agg(part, ' ' ORDER BY pos) AS segment
        FROM (SELECT *, sum(coded::INT) OVER (PARTITION BY doc_id, page, line ORDER BY pos) AS g
              FROM (SELECT *, regexp_matches(part, {q(_C)}) AS coded
                    FROM (SELECT doc_id, page, line, trim(regexp_replace(unnest(string_split_regex(raw, '\\s+\\|\\s+')), '\\s+', ' ', 'g')) AS part,
                                 unnest(generate_series(1, len(string_split_regex(raw, '\\s+\\|\\s+')))) AS pos FROM v_lines)
                    WHERE part <> ''))
        WHERE g > 0 GROUP BY 1, 2, 3, 4
        UNION ALL
        SELECT doc_id, page, line, 0, trim(regexp_replace(raw, '\\s+', ' ', 'g')) FROM v_lines
        WHERE NOT regexp_matches(trim(raw), {q(_C)}) AND NOT regexp_matches(raw, '\\s\\|\\s+[-–]?\\s*[0-9]{{1,4}}\\s+[A-Za-zÀ-ÿ]'))""",
)
view(
    "v_role",
    ["v_segs"],
    """
  SELECT *, CASE WHEN len(amounts) > 0 AND code <> '' THEN 'field'
                 WHEN len(amounts) > 0 AND regexp_matches(segment, '(?i)base|total|l[ií]quido|fgts|inss|irrf|remunera|tribut[aá]vel|isento') THEN 'summary'
                 WHEN len(amounts) > 0 OR regexp_matches(segment, '[0-9]{1,4}\\s+[A-Za-zÀ-ÿ]') THEN 'unresolved' END AS role FROM v_segs""",
)


def texts(spark, sf):
    return testviews.page_texts(raw(spark, sf))


@query("page_texts", with_views(["v_text"], "SELECT doc_id, page, text FROM v_text"))
def page_texts(spark, sf):
    return texts(spark, sf).select("doc_id", "page", "text")


@query(
    "competency_infer",
    with_views(
        ["v_text"],
        """SELECT doc_id, page, CASE WHEN m <> '' THEN lpad(m, 2, '0') END AS month, CASE WHEN m <> '' THEN CASE WHEN length(y) = 2 THEN '20' || y ELSE y END END AS year
           FROM (SELECT *, regexp_extract(text, '(?i)compet[eê]ncia\\s*[:-]?\\s*(0?[1-9]|1[0-2])[/-](20\\d{2}|\\d{2})', 1) AS m,
                        regexp_extract(text, '(?i)compet[eê]ncia\\s*[:-]?\\s*(0?[1-9]|1[0-2])[/-](20\\d{2}|\\d{2})', 2) AS y FROM v_text)""",
    ),
)
def competency_infer(spark, sf):
    return texts(spark, sf).withColumn("c", dates.infer_competency(F.col("text"))).select(
        "doc_id", "page", F.col("c.month").alias("month"), F.col("c.year").alias("year")
    )


classified("v_class_seg", f"SELECT DISTINCT {duck.label_key('words')} AS lkey FROM v_role WHERE role = 'field'", ["v_role"])


@query(
    "text_fields",
    with_views(
        ["v_role", "v_class_seg"],
        f"""SELECT doc_id, page, CAST(line AS INTEGER) AS line, CAST(seg AS INTEGER) AS seg, code, words AS label,
              CASE WHEN len(amounts) > 1 THEN amounts[-2] ELSE coalesce(regexp_extract_all(left(segment, length(segment) - length(amounts[-1])), '[0-9]+(?:[,.][0-9]+)?\\s*%')[-1], '') END AS reference,
              amounts[-1] AS value,
              CASE WHEN regexp_matches(words, '(?i)inss|irrf|desconto|falt|adiant|consign|pens[aã]o|plano|vale[- ]?(?:transporte|refei|alimenta)') THEN 'desconto' ELSE 'provento' END AS type,
              c.category FROM v_role r LEFT JOIN v_class_seg c ON c.lkey = {duck.label_key('words')} WHERE role = 'field'""",
    ),
)
def text_fields(spark, sf):
    return text_extract.local_fields(text_extract.segments(texts(spark, sf))).select(
        "doc_id", "page", "line", "seg", "code", "label", "reference", "value", "type", "category"
    )


view(
    "v_sum",
    ["v_role"],
    f"""
  SELECT *, CASE WHEN regexp_matches(label, '(?i)total.*provent|total.*venc|total.*cr[eé]dit|total bruto') THEN 'total_additions'
                 WHEN regexp_matches(label, '(?i)total.*descont|total.*d[eé]bit') THEN 'total_deductions'
                 WHEN regexp_matches(label, '(?i)l[ií]quido|a receber|creditado') THEN 'net_value' ELSE 'base' END AS target
  FROM (SELECT doc_id, page, line, seg, trim(regexp_replace(regexp_replace(segment, {q(_M)}, '', 'g'), '\\s+', ' ', 'g')) AS label, amounts[-1] AS value
        FROM v_role WHERE role = 'summary')""",
)


@query(
    "text_summaries",
    with_views(["v_sum"], "SELECT doc_id, page, CAST(line AS INTEGER) AS line, label, value, target FROM v_sum"),
)
def text_summaries(spark, sf):
    return text_extract.local_summaries(text_extract.segments(texts(spark, sf))).select("doc_id", "page", "line", "label", "value", "target")


@query(
    "text_totals",
    with_views(
        ["v_sum"],
        """SELECT doc_id, page, t[1] AS total_additions, t[2] AS total_deductions, t[3] AS net_value, a IS NOT NULL AND d IS NOT NULL AND n IS NOT NULL AS all_present,
             coalesce(abs((a - d) - n) <= 0.02, FALSE) AS consistent
           FROM (SELECT *, CAST(replace(replace(t[1], '.', ''), ',', '.') AS DOUBLE) AS a, CAST(replace(replace(t[2], '.', ''), ',', '.') AS DOUBLE) AS d,
                        CAST(replace(replace(t[3], '.', ''), ',', '.') AS DOUBLE) AS n
                 FROM (SELECT doc_id, page, [arg_max(value, (line, seg)) FILTER (target = 'total_additions'), arg_max(value, (line, seg)) FILTER (target = 'total_deductions'),
                              arg_max(value, (line, seg)) FILTER (target = 'net_value')] AS t FROM v_sum WHERE target <> 'base' GROUP BY 1, 2))""",
    ),
)
def text_totals(spark, sf):
    segs = text_extract.segments(texts(spark, sf))
    return reconcile.check_totals(text_extract.local_totals(text_extract.local_summaries(segs)))


@query(
    "text_unresolved",
    with_views(["v_role"], "SELECT doc_id, page, CAST(line AS INTEGER) AS line, CAST(seg AS INTEGER) AS seg, segment FROM v_role WHERE role = 'unresolved'"),
)
def text_unresolved(spark, sf):
    return text_extract.unresolved_segments(text_extract.segments(texts(spark, sf)))


_INV = "(?:^|\\||\\s{2,})\\s*[-–]?\\s*([0-9]{1,4})\\s+([A-Za-zÀ-ÿ][^|\\n]{1,60})"
_HINT = "(?i)base|total|líquido|liquido|fgts|inss|irrf|irf|remunera|dias?\\s*/\\s*horas?"
view("v_ilines", ["v_lines"], f"""SELECT *, regexp_extract_all(trim(raw), {q(_INV)}, 1) AS codes, regexp_extract_all(trim(raw), {q(_INV)}, 2) AS labels,
   regexp_matches(raw, {q(_M)}) AS has_money FROM v_lines WHERE trim(raw) <> ''""")
view(
    "v_icodes",
    ["v_ilines"],
    f"""SELECT doc_id, page, line, pos, code, row_number() OVER (PARTITION BY doc_id, page, code ORDER BY line, pos) AS occurrence,
          trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split_regex(lab, '\\s{{2,}}|\\|')[1], {q(_M)}, '', 'g'),
            '^\\s*[:|\\-]+', ''), '\\s*[:|\\-]+$', ''), '\\s+', ' ', 'g')) AS label
        FROM (SELECT doc_id, page, line, unnest(codes) AS code, unnest(labels) AS lab, unnest(generate_series(0, len(codes) - 1)) AS pos FROM v_ilines WHERE len(codes) > 0)""",
)
classified("v_class_inv", f"SELECT DISTINCT {duck.label_key('label')} AS lkey FROM v_icodes", ["v_icodes"])
view(
    "v_isum",
    ["v_ilines"],
    f"""SELECT doc_id, page, key, min(line) AS line, arg_min(label, line) AS label
        FROM (SELECT *, {duck.label_key('label')} AS key
              FROM (SELECT doc_id, page, line, coalesce({duck.first_rule(duck.compact('raw'), vocab.LINE_SUMMARIES)},
                      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, {q(_M)}, '', 'g'), '^\\s*[:|\\-]+', ''), '\\s*[:|\\-]+$', ''), '\\s+', ' ', 'g'))) AS label
                    FROM v_ilines WHERE len(codes) = 0 AND has_money AND regexp_matches(raw, {q(_HINT)}) AND NOT contains(raw, '|')
                    UNION ALL
                    SELECT doc_id, page, line, coalesce({duck.first_rule(duck.compact('raw'), vocab.LINE_SUMMARIES)},
                      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_filter(string_split(raw, '|'), lambda p: regexp_matches(p, {q(_HINT)}))[1], {q(_M)}, '', 'g'), '^\\s*[:|\\-]+', ''), '\\s*[:|\\-]+$', ''), '\\s+', ' ', 'g')))
                    FROM v_ilines WHERE len(codes) = 0 AND has_money AND regexp_matches(raw, {q(_HINT)}) AND contains(raw, '|')))
        WHERE label <> '' AND key <> '' GROUP BY 1, 2, 3""",
)


@query(
    "inventory_codes",
    with_views(
        ["v_icodes", "v_class_inv"],
        f"""SELECT doc_id, page, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, code, label, CAST(occurrence AS INTEGER) AS occurrence, c.category,
              coalesce(c.category_kind, 'verba') AS category_kind FROM v_icodes i LEFT JOIN v_class_inv c ON c.lkey = {duck.label_key('label')}""",
    ),
)
def inventory_codes(spark, sf):
    return text_extract.inventory_codes(texts(spark, sf)).drop("evidence")


@query("inventory_summaries", with_views(["v_isum"], "SELECT doc_id, page, key, CAST(line AS INTEGER) AS line, label FROM v_isum"))
def inventory_summaries(spark, sf):
    return text_extract.inventory_summaries(texts(spark, sf)).drop("evidence")


@query(
    "inventory_unresolved",
    with_views(["v_ilines"], f"SELECT doc_id, page, CAST(line AS INTEGER) AS line, raw AS evidence FROM v_ilines WHERE len(codes) = 0 AND has_money AND NOT regexp_matches(raw, {q(_HINT)})"),
)
def inventory_unresolved(spark, sf):
    return text_extract.inventory_unresolved(texts(spark, sf))


def thinned(spark, sf):
    """Extracted items of a page: the canonical items with some rows lost."""
    return items(spark, sf).where(F.col("item_ord") % 17 != 0).withColumn("page", F.col("page_ord"))


view("v_thin", ["v_item"], "SELECT *, page_ord AS page FROM v_item WHERE item_ord % 17 <> 0")
view(
    "v_lost_codes",
    ["v_icodes", "v_thin"],
    """SELECT i.* FROM v_icodes i LEFT JOIN (SELECT doc_id, page, code, count(*) AS n FROM v_thin WHERE code <> '' GROUP BY 1, 2, 3) t
         ON t.doc_id = i.doc_id AND t.page = i.page AND t.code = i.code WHERE occurrence > coalesce(n, 0)""",
)
view(
    "v_lost_sums",
    ["v_isum", "v_thin"],
    f"""SELECT s.* FROM v_isum s WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, page, {duck.label_key('label')} AS have FROM v_thin) t
          WHERE t.doc_id = s.doc_id AND t.page = s.page AND have <> '' AND (contains(have, key) OR contains(key, have)))""",
)


@query("coverage_codes", with_views(["v_lost_codes"], "SELECT doc_id, page, CAST(line AS INTEGER) AS line, code, CAST(occurrence AS INTEGER) AS occurrence FROM v_lost_codes"))
def coverage_codes(spark, sf):
    wanted = text_extract.numbered_codes(texts(spark, sf))
    return coverage.missing_codes(wanted, thinned(spark, sf), PAGE).select("doc_id", "page", "line", "code", "occurrence")


@query("coverage_summaries", with_views(["v_lost_sums"], "SELECT doc_id, page, label, CAST(line AS INTEGER) AS line FROM v_lost_sums"))
def coverage_summaries(spark, sf):
    wanted = text_extract.inventory_summaries(texts(spark, sf))
    have = coverage.extracted_label_keys(thinned(spark, sf), None, PAGE)
    return coverage.missing_summaries(wanted, have, PAGE).select("doc_id", "page", "label", "line")


view(
    "v_stated",
    ["v_text"],
    """SELECT doc_id, page, '1,00' AS total_additions, CASE WHEN page % 3 = 0 THEN ' ' END AS total_deductions, CASE WHEN page % 4 = 0 THEN '2,00' ELSE '' END AS net_value
       FROM v_text WHERE page % 2 = 0""",
)
_TOTALS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, page, {duck.label_key(duck.q(label))} FROM v_stated WHERE trim(coalesce({column}, '')) <> ''" for label, column in zip(vocab.TOTAL_LABELS, coverage.TOTALS, strict=True)
)


view("v_have", ["v_thin", "v_stated"], f"SELECT doc_id, page, {duck.label_key('label')} AS have FROM v_thin UNION ALL {_TOTALS_SQL}")


@query(
    "coverage_totals",
    with_views(
        ["v_isum", "v_have"],
        """SELECT doc_id, page, label, CAST(line AS INTEGER) AS line FROM v_isum s WHERE NOT EXISTS (SELECT 1 FROM v_have h
             WHERE h.doc_id = s.doc_id AND h.page = s.page AND have <> '' AND (contains(have, key) OR contains(key, have)))""",
    ),
)
def coverage_totals(spark, sf):
    page = texts(spark, sf)
    stated = page.where("page % 2 = 0").select(
        "doc_id", "page", F.lit("1,00").alias("total_additions"), F.when(F.col("page") % 3 == 0, " ").alias("total_deductions"),
        F.when(F.col("page") % 4 == 0, "2,00").otherwise("").alias("net_value"),
    )
    have = coverage.extracted_label_keys(thinned(spark, sf), stated, PAGE)
    return coverage.missing_summaries(text_extract.inventory_summaries(page), have, PAGE).select("doc_id", "page", "label", "line")


@query(
    "coverage_report",
    with_views(
        ["v_text", "v_icodes", "v_isum", "v_lost_codes", "v_lost_sums", "v_thin"],
        """SELECT doc_id, page, v AS expected_count, greatest(0, v - m) AS extracted_count, lc AS missing_codes, ls AS missing_summaries,
             CASE WHEN v > 0 THEN greatest(0.0, CAST(v - m AS DOUBLE) / v) WHEN n > 0 THEN 1.0 ELSE 0.0 END AS coverage, m = 0 AND n > 0 AS valid, f = 0 AND length(text) > 100 AS empty_region
           FROM (SELECT *, c + s AS v, lc + ls AS m FROM (SELECT t.doc_id, t.page, t.text,
               (SELECT count(*) FROM v_icodes x WHERE x.doc_id = t.doc_id AND x.page = t.page) AS c, (SELECT count(*) FROM v_isum x WHERE x.doc_id = t.doc_id AND x.page = t.page) AS s,
               (SELECT count(*) FROM v_lost_codes x WHERE x.doc_id = t.doc_id AND x.page = t.page) AS lc, (SELECT count(*) FROM v_lost_sums x WHERE x.doc_id = t.doc_id AND x.page = t.page) AS ls,
               (SELECT count(*) FROM v_thin x WHERE x.doc_id = t.doc_id AND x.page = t.page) AS n,
               (SELECT count(*) FROM v_thin x WHERE x.doc_id = t.doc_id AND x.page = t.page AND kind = 'field') AS f FROM v_text t))""",
    ),
)
def coverage_report(spark, sf):
    page = shared(texts(spark, sf))
    codes, sums = shared(text_extract.inventory_codes(page)), shared(text_extract.inventory_summaries(page))
    found = shared(thinned(spark, sf))
    have = coverage.extracted_label_keys(found, None, PAGE)
    return coverage.coverage(
        codes, sums, coverage.missing_codes(codes, found, PAGE), coverage.missing_summaries(sums, have, PAGE), found, text_extract.text_length(page), PAGE
    )


@query(
    "block_validation",
    with_views(
        ["v_text", "v_thin"],
        """SELECT doc_id, page, CASE WHEN len(w) > 0 THEN CAST(len(f) AS DOUBLE) / len(w) WHEN len(f) > 0 THEN 1.0 ELSE 0.0 END AS coverage,
             coalesce(list_aggregate(list_sort(list_filter(w, lambda x: NOT list_contains(f, x))), 'string_agg', ','), '') AS missing_codes,
             NOT has_base AND wants_base AS missing_bases, NOT has_total AND wants_total AS missing_totals,
             CASE WHEN len(w) > 0 THEN CAST(len(f) AS DOUBLE) / len(w) WHEN len(f) > 0 THEN 1.0 ELSE 0.0 END >= 0.8 AND (has_base OR NOT wants_base) AND (has_total OR NOT wants_total) AS valid
           FROM (SELECT *, regexp_matches(text, '(?i)BASE\\s*DE\\s*CALCULO|BASEDECALCULO|VALOR\\s*DO\\s*FGTS') AS wants_base, regexp_matches(text, '(?i)TOT\\.?\\s*RENDIMENTOS|TOTAL\\s*DESCONTOS|SALARIO\\s*LIQUIDO') AS wants_total FROM (SELECT t.doc_id, t.page, t.text, list_distinct(flatten(list_transform(string_split(text, chr(10)), lambda l: regexp_extract_all(l, '(?:^|\\|)\\s*([0-9]{1,4})\\s+[A-Za-zÀ-ÿ]', 1)))) AS w,
                   coalesce(e.f, []) AS f, coalesce(e.b, FALSE) AS has_base, coalesce(e.t, FALSE) AS has_total
                 FROM v_text t LEFT JOIN (SELECT doc_id, page, list_distinct(list(code) FILTER (code <> '')) AS f, bool_or(kind = 'base') AS b, bool_or(canonical_key = 'base:valor_liquido') AS t FROM v_thin GROUP BY 1, 2) e
                   ON e.doc_id = t.doc_id AND e.page = t.page))""",
    ),
)
def block_validation(spark, sf):
    found = thinned(spark, sf).groupBy(*PAGE).agg(
        F.collect_set(F.when(F.col("code") != "", F.col("code"))).alias("found"), F.bool_or(F.col("kind") == "base").alias("has_base"),
        F.bool_or(F.col("canonical_key") == "base:valor_liquido").alias("has_total"),
    )
    page = texts(spark, sf).join(found, PAGE, "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<string>)")))
    checks = coverage.validate_block(F.col("text"), F.col("found"), F.coalesce("has_total", F.lit(False)), F.coalesce("has_base", F.lit(False)))
    return page.withColumns(checks).select(
        "doc_id", "page", "coverage", F.array_join(F.array_sort("missing_codes"), ",").alias("missing_codes"), "missing_bases", "missing_totals", "valid"
    )

