"""Queries over positioned tokens."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import blocks, layout
from ..sources import testviews
from . import duck
from .catalogue import query
from .duck import view, with_views

from .reuse import shared

PAGE = ["doc_id", "page"]
_MON = "(['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'])[month(order_date)]"
_NET = f"(CASE WHEN plus < minus THEN '-' ELSE '' END || {duck.cents('abs(plus - minus)')})"
view(
    "v_cell",
    ["v_raw"],
    """SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY item_ord) - 1 AS i,
              CASE WHEN value = '' THEN 0 ELSE CAST(replace(replace(value, '.', ''), ',', '') AS BIGINT) END AS c FROM v_raw""",
)
view(
    "v_sheet_base",
    ["v_page", "v_cell"],
    """SELECT p.doc_id, p.page_ord, p.order_date, (p.page_ord - 1) // 6 + 1 AS page, (p.page_ord - 1) % 6 AS block, coalesce(n, 0) AS n,
              coalesce(plus, 0) AS plus, coalesce(minus, 0) AS minus
       FROM v_page p LEFT JOIN (SELECT doc_id, page_ord, count(*) AS n, CAST(sum(CASE WHEN type = 'desconto' THEN 0 ELSE c END) AS BIGINT) AS plus,
              CAST(sum(CASE WHEN type = 'desconto' THEN c ELSE 0 END) AS BIGINT) AS minus FROM v_cell GROUP BY 1, 2) s USING (doc_id, page_ord)""",
)


def _frame(text: str, x: int, line: str, k: int) -> str:
    return f"SELECT doc_id, page, block, {text} AS str, {x} AS x, {line} AS line, {k} AS k FROM v_sheet_base"


_END = "(n + 1) // 2 + 1"
view(
    "v_tok",
    ["v_sheet_base", "v_cell"],
    f"""
  SELECT doc_id, CASE WHEN over THEN page + 1 ELSE page END AS page, CASE WHEN over THEN -1 ELSE block END * 1000000 + k AS item_ord, str, CAST(x AS DOUBLE) AS x,
         CAST(base_y + (k % 3) * 0.5 AS DOUBLE) AS y, CAST(length(str) * 6.0 AS DOUBLE) AS width, base_y
  FROM (SELECT *, CASE WHEN over THEN 12 * (line - 2) ELSE 200 + 1000 * block + 12 * line END AS base_y
        FROM (SELECT *, page % 7 = 0 AND block = 5 AND line >= 3 AS over FROM (
          {_frame("'Folha Normal'", 10, "-1", 0)} UNION ALL {_frame("'Mês: ' || " + _MON + " || '-' || strftime(order_date, '%y')", 10, "0", 1)}
          UNION ALL {_frame("'TOT.RENDIMENTOS'", 10, _END, 900000)} UNION ALL {_frame(duck.cents('plus'), 150, _END, 900001)}
          UNION ALL {_frame("'TOTALDESCONTOS'", 310, _END, 900002)} UNION ALL {_frame(duck.cents('minus'), 460, _END, 900003)}
          UNION ALL {_frame("'BASEDECALCULODOINSS'", 600, _END, 900004)} UNION ALL {_frame(duck.cents('plus'), 760, _END, 900005)}
          UNION ALL {_frame("'SALARIOLIQUIDONOMES'", 600, _END + " + 1", 900006)} UNION ALL {_frame(_NET, 760, _END + " + 1", 900007)}
          UNION ALL SELECT doc_id, (page_ord - 1) // 6 + 1, (page_ord - 1) % 6, trim(code || ' ' || label), 10 + (i % 2) * 300, i // 2 + 1, i * 10 + 10 FROM v_cell
          UNION ALL SELECT doc_id, (page_ord - 1) // 6 + 1, (page_ord - 1) % 6, reference, 150 + (i % 2) * 300, i // 2 + 1, i * 10 + 11 FROM v_cell
          UNION ALL SELECT doc_id, (page_ord - 1) // 6 + 1, (page_ord - 1) % 6, value, 210 + (i % 2) * 300, i // 2 + 1, i * 10 + 12 FROM v_cell)))
  WHERE str <> ''""",
)
view("v_sheets", ["v_tok"], "SELECT DISTINCT doc_id, page FROM v_tok")


def tokens(spark, sf):
    heads = testviews.records(spark, sf)
    toks = testviews.page_tokens(testviews.raw_items(spark, sf, heads), heads)
    return toks, toks.select(*PAGE).distinct().withColumn("page_height", F.lit(6500.0))


@query("page_tokens", with_views(["v_tok"], "SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(item_ord AS BIGINT) AS item_ord, str, x, y, width FROM v_tok"))
def page_tokens(spark, sf):
    return tokens(spark, sf)[0]


_B4 = "CAST(floor(y / 4 + 0.5) * 4 AS BIGINT)"
view(
    "v_tlines",
    ["v_tok"],
    f"""SELECT doc_id, page, {_B4} AS line_y, trim(regexp_replace(string_agg(str, ' ' ORDER BY x, item_ord), '\\s+', ' ', 'g')) AS text, count(*) AS n
        FROM v_tok GROUP BY 1, 2, 3""",
)


@query("token_lines", with_views(["v_tlines"], "SELECT doc_id, CAST(page AS INTEGER) AS page, line_y, text FROM v_tlines"))
def token_lines(spark, sf):
    return layout.visual_lines(tokens(spark, sf)[0]).select("doc_id", "page", F.col("line_y").cast("long").alias("line_y"), "text")


@query(
    "token_clusters",
    with_views(
        ["v_tok"],
        """SELECT doc_id, CAST(page AS INTEGER) AS page, arg_min(y, item_ord) AS line_y, trim(regexp_replace(string_agg(str, ' ' ORDER BY x, item_ord), '\\s+', ' ', 'g')) AS text,
             count(*) AS n_items FROM v_tok GROUP BY doc_id, page, base_y""",
    ),
)
def token_clusters(spark, sf):
    return layout.clustered_text(layout.cluster_lines(tokens(spark, sf)[0]))


def spatial_sql(source: str, keys: str, fixed: float | None = None) -> str:
    limit = str(fixed) if fixed is not None else "greatest(10.0, least(40.0, coalesce(list_sort(list(gap) FILTER (gap > 0))[count(gap) FILTER (gap > 0) // 2 + 1], 15.0) * 1.5))"
    return f"""
  SELECT {keys}, string_agg(line, chr(10) ORDER BY b) AS text FROM (
    SELECT {keys}, b, string_agg(CASE WHEN gap IS NULL THEN str WHEN gap > lim THEN '  |  ' || str ELSE ' ' || str END, '' ORDER BY x, item_ord) AS line
    FROM (SELECT *, x - lag(x + width) OVER (PARTITION BY {keys}, b ORDER BY x, item_ord) AS gap FROM (SELECT *, {_B4} AS b FROM {source}))
    JOIN (SELECT {keys}, {limit} AS lim FROM (SELECT *, x - lag(x + width) OVER (PARTITION BY {keys}, b ORDER BY x, item_ord) AS gap
            FROM (SELECT *, {_B4} AS b FROM {source})) GROUP BY {keys}) USING ({keys})
    GROUP BY {keys}, b) GROUP BY {keys}"""


@query("spatial_text", with_views(["v_tok"], f"SELECT doc_id, CAST(page AS INTEGER) AS page, text FROM ({spatial_sql('v_tok', 'doc_id, page')})"))
def spatial_text(spark, sf):
    return layout.spatial_text(tokens(spark, sf)[0])


@query("page_text_fixed_gap", with_views(["v_tok"], f"SELECT doc_id, CAST(page AS INTEGER) AS page, text FROM ({spatial_sql('v_tok', 'doc_id, page', 15.0)})"))
def page_text_fixed_gap(spark, sf):
    return layout.spatial_text(tokens(spark, sf)[0], fixed_gap=15.0)


_DOC_TOK = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, ln, w, str FROM (
   SELECT doc_id, ln, unnest(string_split(line, ' ')) AS str, unnest(generate_series(0, len(string_split(line, ' ')) - 1)) AS w FROM (
     SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS ln FROM documents)) WHERE str <> ''"""


@query(
    "document_density",
    f"""SELECT doc_id, chars AS char_count, words AS element_count, lines AS line_count, chars < 100 AS is_sparse, chars < 50 OR (words <= 4 AND chars < 200) AS is_scanned,
          CASE WHEN chars < 50 OR (words <= 4 AND chars < 200) THEN 'VISION_SINGLE_PASS' ELSE 'DUAL_PASS' END AS strategy
        FROM (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(coalesce(sum(length(trim(str, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)))), 0) AS BIGINT) AS chars,
                count(str) AS words, count(DISTINCT ln) FILTER (trim(str, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)) <> '') AS lines
              FROM documents d LEFT JOIN ({_DOC_TOK}) t ON t.doc_id = CAST(d.doc_id AS VARCHAR) GROUP BY 1)""",
)
def document_density(spark, sf):
    docs = testviews.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"))
    dense = layout.page_density(testviews.document_tokens(spark, sf), docs)
    return dense.withColumn("strategy", layout.strategy(F.lit(False), F.col("is_scanned"), F.col("char_count"))).drop("page")


@query(
    "page_density",
    with_views(
        ["v_tok", "v_sheets"],
        f"""SELECT s.doc_id, CAST(s.page AS INTEGER) AS page, CAST(sum(length(trim(str))) AS BIGINT) AS char_count, count(str) AS element_count, count(DISTINCT {_B4}) AS line_count,
              sum(length(trim(str))) < 100 AS is_sparse, sum(length(trim(str))) < 50 OR (count(str) <= 4 AND sum(length(trim(str))) < 200) AS is_scanned
            FROM v_sheets s LEFT JOIN v_tok t ON t.doc_id = s.doc_id AND t.page = s.page GROUP BY 1, 2""",
    ),
)
def page_density(spark, sf):
    toks, pages = tokens(spark, sf)
    return layout.page_density(toks, pages)


view("v_marks", ["v_tlines"], """SELECT doc_id, page, row_number() OVER w - 1 AS block_index, line_y AS y_start, lead(line_y) OVER w AS next_y, text,
   'page:' || page || ':block:' || (row_number() OVER w - 1) AS record_key
   FROM v_tlines WHERE regexp_matches(text, '(?i)^M[eê]s\\s*:\\s*[a-záéíóúâêîôûãõçàèìòù]{3,9}[\\s/-][0-9]{2,4}\\b') WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_y)""")


@query(
    "month_sheets",
    with_views(
        ["v_marks", "v_sheets"],
        """SELECT doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS markers, max(n) > 1 OR sum(n) > count(*) AS is_month_sheet
           FROM (SELECT s.doc_id, s.page, count(m.text) AS n FROM v_sheets s LEFT JOIN v_marks m ON m.doc_id = s.doc_id AND m.page = s.page GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def month_sheets(spark, sf):
    return blocks.month_sheets(*tokens(spark, sf))


view(
    "v_btok",
    ["v_tok", "v_marks"],
    """SELECT t.*, m.record_key, 0 AS part FROM v_tok t JOIN v_marks m ON m.doc_id = t.doc_id AND m.page = t.page
         AND y >= y_start - 2 AND (next_y IS NULL OR y < next_y + 1)""",
)
view(
    "v_lead",
    ["v_tok", "v_marks"],
    f"""SELECT * EXCLUDE (prev) , prev AS record_key, 1 AS part FROM (
          SELECT t.*, m.prev FROM v_tok t JOIN (SELECT *, lag(last_key) OVER (PARTITION BY doc_id ORDER BY page) AS prev
            FROM (SELECT doc_id, page, min(y_start) AS first_y, arg_max(record_key, block_index) AS last_key FROM v_marks GROUP BY 1, 2)) m
          ON m.doc_id = t.doc_id AND m.page = t.page AND y < first_y - 2 AND prev IS NOT NULL)""",
)
view(
    "v_lead_ok",
    ["v_lead"],
    f"""SELECT l.* FROM v_lead l JOIN ({spatial_sql('v_lead', 'doc_id, page')}) s USING (doc_id, page)
        WHERE regexp_matches(s.text, '(?i)(?:^|\\|)\\s*[0-9]{{1,4}}\\s+\\p{{L}}|TOT\\.?RENDIMENTOS|TOTALDESCONTOS|BASEDECALCULO|SALARIOLIQUIDO')""",
)
view(
    "v_stitched",
    ["v_btok", "v_lead_ok", "v_marks"],
    """SELECT doc_id, page, item_ord, str, x, y, width, record_key, part FROM v_btok
       UNION ALL SELECT l.doc_id, l.page, item_ord, str, x, y + greatest(max_y, y_start) + 20 - min(y) OVER (PARTITION BY l.doc_id, l.record_key), width, l.record_key, part
       FROM v_lead_ok l JOIN (SELECT doc_id, record_key, max(y) AS max_y FROM v_btok GROUP BY 1, 2) b USING (doc_id, record_key) JOIN v_marks m ON m.doc_id = l.doc_id AND m.record_key = l.record_key""",
)


def stitched(spark, sf):
    # kept once, dealt by page; the tokens of blocks are derived from them again rather than kept too
    toks = shared(tokens(spark, sf)[0])
    marks = shared(blocks.block_marks(toks))
    return toks, marks, blocks.stitched_tokens(toks, marks)


view(
    "v_blocks",
    ["v_stitched", "v_marks"],
    f"""SELECT m.doc_id, CAST(m.page AS INTEGER) AS page, CAST(block_index AS INTEGER) AS block_index, m.record_key, month, year, CAST(y_start AS DOUBLE) AS y_start,
              coalesce(moved, CAST(coalesce(next_y - 1, y_start + 200) AS DOUBLE)) AS y_end, CAST(coalesce(np, m.page) AS INTEGER) AS last_page,
              a.text || CASE WHEN z.text IS NOT NULL THEN chr(10) || z.text ELSE '' END AS raw_text
            FROM (SELECT *, lpad(CAST(list_position(['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'], substr(text, 6, 3)) AS VARCHAR), 2, '0') AS month, '20' || substr(text, 10, 2) AS year FROM v_marks) m
            LEFT JOIN ({spatial_sql('(SELECT * FROM v_stitched WHERE part = 0)', 'doc_id, record_key')}) a ON a.doc_id = m.doc_id AND a.record_key = m.record_key
            LEFT JOIN ({spatial_sql('(SELECT * FROM v_stitched WHERE part = 1)', 'doc_id, record_key')}) z ON z.doc_id = m.doc_id AND z.record_key = m.record_key
            LEFT JOIN (SELECT doc_id, record_key, max(y) AS moved, max(page) AS np FROM v_stitched WHERE part = 1 GROUP BY 1, 2) e ON e.doc_id = m.doc_id AND e.record_key = m.record_key""",
)


@query("month_blocks", with_views(["v_blocks"], "SELECT * FROM v_blocks"))
def month_blocks(spark, sf):
    return blocks.blocks(*stitched(spark, sf)).drop("payroll_type")


@query(
    "month_block_types",
    with_views(
        ["v_blocks"],
        r"""SELECT doc_id, record_key, month, year, CASE
              WHEN len(regexp_extract_all(t, '\b(?:371|374)\s+13')) >= 3 OR len(regexp_extract_all(t, 'salarioliquidonomes')) >= 3 THEN 'historico_13'
              WHEN regexp_matches(t, 'remuneracaomes|dias/?horastrab') THEN 'normal'
              WHEN regexp_matches(t, '\b311\s+part\s+lucr|\b313\s+irf\s+part\s+result') THEN 'plr'
              WHEN regexp_matches(t, '\b13\b|13o\.\s*sal|13\s*sal') THEN 'decimo_terceiro' ELSE 'suplementar' END AS payroll_type
            FROM (SELECT *, regexp_replace(strip_accents(lower(coalesce(raw_text, ''))), '[^a-z0-9\s.]', '', 'g') AS t FROM v_blocks)""",
    ),
)
def month_block_types(spark, sf):
    return blocks.blocks(*stitched(spark, sf)).select("doc_id", "record_key", "month", "year", "payroll_type")


view(
    "v_bounds",
    ["v_stitched"],
    """SELECT doc_id, record_key, split_x, coalesce(base_x - 5, split_x + 200) AS base_x FROM (
         SELECT doc_id, record_key, coalesce(arg_max(x, (gap, -x)) FILTER (gap > 0), 215) AS split_x, min(x) FILTER (regexp_matches(trim(str), '(?i)^(?:BASEDECALCULO|VALORDOFGTS|VALORDOIR|SALARIOL)')) AS base_x
         FROM (SELECT *, CASE WHEN cl THEN x - lag(x) OVER (PARTITION BY doc_id, record_key, cl ORDER BY x) END AS gap
               FROM (SELECT *, regexp_matches(trim(str), '^([0-9]{1,4})\\s+([A-Za-zÀ-ÿ].{1,40})$') AS cl FROM v_stitched)) GROUP BY 1, 2)""",
)


@query("block_columns", with_views(["v_bounds"], "SELECT * FROM v_bounds"))
def block_columns(spark, sf):
    return blocks.column_bounds(stitched(spark, sf)[2])


@query(
    "block_items",
    with_views(
        ["v_stitched", "v_bounds"],
        f"""SELECT doc_id, record_key, code, label, reference, value, CASE WHEN side = 0 THEN 'provento' ELSE 'desconto' END AS type FROM (
              SELECT *, row_number() OVER (PARTITION BY doc_id, record_key, code, lower(label), reference, value ORDER BY b, side) AS copy FROM (
                SELECT doc_id, record_key, b, side, regexp_extract(head, '^([0-9]{{1,4}})\\s+(.*)$', 1) AS code, trim(regexp_extract(head, '^([0-9]{{1,4}})\\s+(.*)$', 2)) AS label,
                       CASE WHEN len(nums) > 1 THEN nums[1] ELSE '' END AS reference, nums[-1] AS value
                FROM (SELECT doc_id, record_key, b, side, (list(trim(str) ORDER BY x, part, item_ord) FILTER (regexp_matches(trim(str), '^([0-9]{{1,4}})\\s+([A-Za-zÀ-ÿ].{{1,40}})$')))[1] AS head,
                             list(trim(str) ORDER BY x, part, item_ord) FILTER (regexp_matches(trim(str), '^-?[0-9]+(?:[.,][0-9]+)*%?$')) AS nums
                      FROM (SELECT s.*, {_B4} AS b, CASE WHEN x >= 0 AND x < split_x THEN 0 WHEN x >= split_x AND x < base_x THEN 1 END AS side
                            FROM v_stitched s JOIN v_bounds USING (doc_id, record_key)) WHERE side IS NOT NULL GROUP BY 1, 2, 3, 4)
                WHERE head IS NOT NULL AND len(nums) > 0)) WHERE copy = 1""",
    ),
)
def block_items(spark, sf):
    return blocks.block_items(stitched(spark, sf)[2]).drop("row_y", "side")


_SUMS = " UNION ALL ".join(
    f"SELECT doc_id, record_key, {duck.q(label)} AS label, {fn}(regexp_extract(line, '(?i){pat}\\s+([0-9.,]+)', 1), b) AS value, {total} AS is_total FROM v_blines "
    f"WHERE regexp_matches(line, '(?i){pat}\\s+([0-9.,]+)') GROUP BY 1, 2"
    for label, pat, fn, total in [
        ("Base INSS", "BASEDECALCULODOINSS", "arg_min", "FALSE"), ("Total Proventos", "TOT\\.?RENDIMENTOS", "arg_max", "TRUE"),
        ("Total Descontos", "TOTALDESCONTOS", "arg_max", "TRUE"), ("Valor Líquido", "SALARIOLIQUIDONOMES", "arg_max", "TRUE"),
    ]
)
view("v_blines", ["v_stitched"], f"SELECT doc_id, record_key, {_B4} AS b, trim(string_agg(str, ' ' ORDER BY x, part, item_ord)) AS line FROM v_stitched GROUP BY 1, 2, 3")


@query("block_summaries", with_views(["v_blines"], _SUMS))
def block_summaries(spark, sf):
    return blocks.block_summaries(stitched(spark, sf)[2])


view(
    "v_clus",
    ["v_tok"],
    """SELECT doc_id, page, arg_min(y, item_ord) AS line_y, trim(regexp_replace(string_agg(str, ' ' ORDER BY x, item_ord), '\\s+', ' ', 'g')) AS text FROM v_tok GROUP BY doc_id, page, base_y""",
)


def _kept(name: str, pattern: str, distance: int) -> None:
    view(
        name,
        ["v_clus"],
        f"""SELECT c.* FROM v_clus c JOIN (
              SELECT doc_id, page, unnest(list_reduce(list_transform(list_sort(list(line_y)), lambda y: [y]),
                lambda a, y: CASE WHEN y[1] - a[-1] > {distance} THEN list_concat(a, y) ELSE a END)) AS line_y
              FROM v_clus WHERE regexp_matches(text, {duck.q(pattern)}) GROUP BY 1, 2) k USING (doc_id, page, line_y)""",
    )


_kept("v_hmarks", "(?i)Folha\\s+Normal|Mês\\s*:\\s*[a-z]{3}-\\d{2}", 55)
_kept("v_fmarks", "(?i)TOTALDESCONTOS|SALARIOLIQUIDONOMES|Líquido", 30)


view(
    "v_regions",
    ["v_sheets", "v_clus", "v_hmarks", "v_fmarks"],
    """SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS index, y_start, CASE WHEN nxt IS NOT NULL THEN coalesce(foot + 15, nxt - 5) ELSE least(6500.0, coalesce(foot + 25, max_y + 15)) END AS y_end,
             text AS header_text, CAST(0.95 AS DOUBLE) AS confidence, FALSE AS is_fallback
           FROM (SELECT h.*, CASE WHEN i = 1 THEN greatest(0.0, line_y - 20) ELSE line_y - 8 END AS y_start, (SELECT max(line_y) FROM v_clus c WHERE c.doc_id = h.doc_id AND c.page = h.page) AS max_y,
                   (SELECT min(line_y) FROM v_fmarks f WHERE f.doc_id = h.doc_id AND f.page = h.page AND f.line_y > h.line_y AND (h.nxt IS NULL OR f.line_y < h.nxt)) AS foot
                 FROM (SELECT *, row_number() OVER w AS i, lead(line_y) OVER w AS nxt, count(*) OVER (PARTITION BY doc_id, page) AS n FROM v_hmarks WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_y)) h WHERE n >= 2)
           UNION ALL
           SELECT doc_id, CAST(page AS INTEGER), CAST(i - 1 AS INTEGER), coalesce(before + 20, 0.0), line_y + 20, NULL, CAST(0.85 AS DOUBLE), FALSE
           FROM (SELECT *, row_number() OVER w AS i, lag(line_y) OVER w AS before, count(*) OVER (PARTITION BY doc_id, page) AS n FROM v_fmarks WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_y)) f
           WHERE n >= 2 AND (SELECT count(*) FROM v_hmarks h WHERE h.doc_id = f.doc_id AND h.page = f.page) < 2
           UNION ALL
           SELECT s.doc_id, CAST(s.page AS INTEGER), 0, 0.0, 6500.0, NULL, CAST(1.0 AS DOUBLE), TRUE FROM v_sheets s
           WHERE (SELECT count(*) FROM v_hmarks h WHERE h.doc_id = s.doc_id AND h.page = s.page) < 2 AND (SELECT count(*) FROM v_fmarks f WHERE f.doc_id = s.doc_id AND f.page = s.page) < 2""",
)


@query("payslip_regions", with_views(["v_regions"], "SELECT * FROM v_regions"))
def payslip_regions(spark, sf):
    toks, pages = tokens(spark, sf)
    return layout.payslip_regions(toks, pages).drop("lo", "hi")


view("v_units", ["v_regions"], "SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM v_regions")
view(
    "v_rtok",
    ["v_units", "v_tok"],
    """SELECT t.*, u.index FROM v_tok t JOIN v_units u ON u.doc_id = t.doc_id AND u.page = t.page AND n > 1 AND NOT is_fallback
         AND t.y >= y_start - CASE WHEN header_text IS NULL THEN 0 ELSE 2 END AND t.y <= y_end + CASE WHEN header_text IS NULL THEN 0 ELSE 2 END""",
)


def _unit_sql(keys: str, source: str, units: str, text: str) -> str:
    return f"""SELECT u.doc_id, u.page, u.index, u.result_key, u.source_region, coalesce(x.text, '') AS text, coalesce(c, 0) AS char_count, coalesce(e, 0) AS element_count, coalesce(l, 0) AS line_count,
        coalesce(c, 0) < 100 AS is_sparse, coalesce(c, 0) < 50 OR (coalesce(e, 0) <= 4 AND coalesce(c, 0) < 200) AS is_scanned
      FROM ({units}) u LEFT JOIN ({text}) x USING ({keys}) LEFT JOIN (SELECT {keys}, CAST(sum(length(trim(str))) AS BIGINT) AS c, count(*) AS e, count(DISTINCT {_B4}) FILTER (trim(str) <> '') AS l FROM {source} GROUP BY ALL) d USING ({keys})"""


_PLAIN_TYPE = r"""CASE WHEN regexp_matches(p, '\bacerto\b|suplementar|complementar') THEN 'suplementar' WHEN regexp_matches(p, 'folha de pagamento:\s*\|?\s*mes\b') THEN 'normal'
  WHEN regexp_matches(p, 'participacao.*(?:lucro|resultado)|\bplr\b') THEN 'plr'
  WHEN regexp_matches(p[:600], 'folha de pagamento:[^\n]*(?:13|decimo)|\b13\s*(?:o\s+salario|salario)|decimo terceiro') THEN 'decimo_terceiro' ELSE 'normal' END"""


@query(
    "processing_units",
    with_views(
        ["v_units", "v_rtok", "v_tok"],
        f"""SELECT * EXCLUDE (p), {_PLAIN_TYPE} AS payroll_type FROM (SELECT *, strip_accents(lower(text)) AS p FROM (
              {_unit_sql("doc_id, page, index", "v_rtok", "SELECT doc_id, page, index, 'page:' || page || ':region:' || index AS result_key, 'region:' || index AS source_region FROM v_units WHERE n > 1 AND NOT is_fallback", spatial_sql("v_rtok", "doc_id, page, index"))}
              UNION ALL
              {_unit_sql("doc_id, page", "v_tok", "SELECT doc_id, page, CAST(NULL AS INTEGER) AS index, 'page:' || page AS result_key, CAST(NULL AS VARCHAR) AS source_region FROM v_units WHERE n = 1", spatial_sql("v_tok", "doc_id, page", 15.0))}))""",
    ),
)
def processing_units(spark, sf):
    toks, pages = tokens(spark, sf)
    toks = shared(toks)
    return layout.processing_units(toks, pages, layout.spatial_text(toks, fixed_gap=15.0))


@query(
    "layout_complexity",
    with_views(
        ["v_tok"],
        """SELECT doc_id, CAST(page AS INTEGER) AS page, cols AS col_count, x_min, x_max, n AS max_items_per_line, cols >= 6 OR n >= 7 AS is_complex
           FROM (SELECT doc_id, page, min(x) AS x_min, max(x + width) AS x_max, count(DISTINCT CASE WHEN x = 460 THEN 450 ELSE x END) AS cols FROM v_tok GROUP BY 1, 2)
           JOIN (SELECT doc_id, page, max(n) AS n FROM (SELECT doc_id, page, base_y, count(*) AS n FROM v_tok GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (doc_id, page)""",
    ),
)
def layout_complexity(spark, sf):
    return layout.complexity(tokens(spark, sf)[0], PAGE)


@query(
    "vertical_cut",
    with_views(
        ["v_tok"],
        """SELECT doc_id, CAST(page AS INTEGER) AS page, x_min, x_max, floor(arg_min(cx, (score, k)) * 100 + 0.5) / 100 AS x_cut
           FROM (SELECT e.doc_id, e.page, x_min, x_max, k, lo + 2 * k AS cx, count(*) FILTER (lo + 2 * k > x + 1 AND lo + 2 * k < x + width - 1) * 1000 + abs(lo + 2 * k - mid) AS score
                 FROM (SELECT *, unnest(generate_series(0, CAST(floor(rad) AS BIGINT))) AS k FROM (SELECT *, (x_max - x_min) * 0.25 AS rad, x_min + (x_max - x_min) / 2 AS mid, x_min + (x_max - x_min) / 2 - (x_max - x_min) * 0.25 AS lo
                        FROM (SELECT doc_id, page, min(x) AS x_min, max(x + width) AS x_max FROM v_tok GROUP BY 1, 2))) e JOIN v_tok t ON t.doc_id = e.doc_id AND t.page = e.page
                 GROUP BY e.doc_id, e.page, x_min, x_max, k, lo, mid) GROUP BY 1, 2, 3, 4""",
    ),
)
def vertical_cut(spark, sf):
    toks = shared(tokens(spark, sf)[0])
    return layout.vertical_cut(toks, layout.complexity(toks, PAGE), PAGE)


@query(
    "split_halves",
    with_views(
        ["v_tok"],
        """SELECT doc_id, CAST(page AS INTEGER) AS page, side AS sub_index, count(*) AS n, string_agg(str, '|' ORDER BY item_ord) AS content, min(x) AS x_from, max(x + width) AS x_to FROM v_tok, (VALUES ('left'), ('right')) s(side)
           WHERE (side = 'left' AND x <= 320) OR (side = 'right' AND x + width >= 280) GROUP BY 1, 2, 3""",
    ),
)
def split_halves(spark, sf):
    toks, pages = tokens(spark, sf)
    cuts = pages.select(*PAGE, F.lit(0.0).alias("x_min"), F.lit(900.0).alias("x_max"), F.lit(300.0).alias("x_cut"))
    return layout.split_halves(toks, cuts, PAGE).groupBy(*PAGE, "sub_index").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "str"))), lambda t: t["str"]), "|").alias("content"),
        F.min("x").alias("x_from"), F.max(F.col("x") + F.col("width")).alias("x_to"),
    )


