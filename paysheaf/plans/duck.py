"""Plain SQL forms of the test views and of small text rules, for result checks.

The SQL is written independently of the DataFrame code: window functions and
recursive steps where the operators use aggregates, for example.
"""

from __future__ import annotations

from ..functions import vocab
from ..sources.testviews import LABELS, TYPES


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case_map(expr: str, pairs: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def bare_key(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x},''))), '[^a-z0-9]+', ' ', 'g'))"


def label_key(x: str) -> str:
    aliases = {k: v for k, v in vocab.LABEL_ALIASES.items() if k != v}
    return case_map(bare_key(x), aliases, bare_key(x))


def compact(x: str) -> str:
    return f"regexp_replace(lower(strip_accents(coalesce({x},''))), '[^a-z0-9]', '', 'g')"


def code_key(x: str) -> str:
    return (
        f"CASE WHEN trim({x}) = '' THEN '' WHEN regexp_full_match(trim({x}), '[0-9]+') "
        f"THEN CAST(CAST(trim({x}) AS BIGINT) AS VARCHAR) ELSE {label_key(x)} END"
    )


def cents(x: str) -> str:
    return (
        f"(replace(format('{{:,}}', ({x}) // 100), ',', '.') || ',' || lpad(CAST(({x}) % 100 AS VARCHAR), 2, '0'))"
    )


def zero(x: str) -> str:
    return f"(coalesce({x},'') IN ('','0','0,0','0,00','0.00'))"


def first_rule(key: str, rules: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN regexp_matches({key}, {q(p)}) THEN {q(v)}" for v, p in rules)
    return f"CASE {whens} END"


def summary_id(x: str) -> str:
    return first_rule(compact(x), [(sid, p) for sid, _, p in vocab.SUMMARIES])


def values(rows: list[tuple], *names: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(names)})"


V: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], sql: str) -> None:
    V[name] = (needs, sql)


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the views it needs, each once, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in V[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    recursive = "RECURSIVE " if any("/*recursive*/" in V[n][1] for n in ordered) or "/*recursive*/" in body else ""
    ctes = ",\n".join(f"{n} AS ({V[n][1]})" for n in ordered)
    joiner = ",\n" if body.lstrip().startswith("+") else "\n"
    return f"WITH {recursive}{ctes}{joiner}{body.lstrip().removeprefix('+')}"


view("labels20", [], values([(i, a, b) for i, (a, b) in enumerate(LABELS)], "num", "label_a", "label_b"))

view(
    "v_rec",
    [],
    f"""
  SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, o_orderkey AS order_key, o_orderdate AS order_date,
         'order:' || o_orderkey AS record_key,
         CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN '13' WHEN o_orderkey % 103 = 0 THEN '0?'
              WHEN o_orderkey % 107 = 0 THEN 'MM' WHEN o_orderkey % 7 = 0 THEN CAST(month(o_orderdate) AS VARCHAR)
              ELSE strftime(o_orderdate, '%m') END AS raw_month,
         CASE WHEN o_orderkey % 211 = 0 THEN '0000' ELSE strftime(o_orderdate, '%Y') END AS raw_year,
         CASE WHEN o_orderkey % 11 <> 0 THEN {case_map('o_orderpriority', TYPES, 'NULL')} END AS payroll_type,
         CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS company,
         CASE WHEN o_orderkey % 3 <> 0 THEN c_name END AS employee,
         CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS payment_date,
         o_orderkey % 113 = 0 AS review_required,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS page_ord
  FROM orders JOIN customer ON o_custkey = c_custkey""",
)

view(
    "v_page",
    ["v_rec"],
    """
  SELECT *, CASE WHEN month <> '' AND year <> '' THEN lpad(month, 2, '0') || '/' || year END AS competency
  FROM (SELECT *,
          CASE WHEN upper(raw_month) = 'MM' OR raw_month = '00' THEN '' WHEN length(raw_month) = 1 THEN '0' || raw_month
               ELSE raw_month END AS month,
          CASE WHEN upper(raw_year) = 'YYYY' OR raw_year = '0000' THEN '' ELSE raw_year END AS year
        FROM v_rec)""",
)

view(
    "v_raw",
    ["labels20", "v_page"],
    f"""
  SELECT p.doc_id, p.page_ord, p.record_key, CASE WHEN (l_linenumber + page_ord) % 2 = 0 THEN label_b ELSE label_a END AS label,
         l.* EXCLUDE (l_linenumber, label_a, label_b)
  FROM (SELECT l_orderkey AS order_key,
          CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 10000000 + l_suppkey AS item_ord,
          CASE WHEN l_partkey % 17 = 0 OR l_suppkey % 20 >= 17 THEN ''
               WHEN l_orderkey % 2 = 1 THEN lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0')
               ELSE CAST(l_suppkey % 20 AS VARCHAR) END AS code,
          l_linenumber, label_a, label_b,
          CASE WHEN l_partkey % 89 = 0 THEN amount ELSE quantity END AS reference,
          CASE WHEN l_partkey % 89 = 0 THEN '' ELSE amount END AS value,
          CASE WHEN l_partkey % 19 <> 0 THEN CASE WHEN l_returnflag = 'R' THEN 'desconto' ELSE 'provento' END END AS type,
          l_suppkey % 20 = 18 AS is_base,
          l_partkey % 997 = 0 AS conflict,
          (l_quantity % 5) / 5 AS confidence,
          CASE WHEN l_linenumber % 3 = 0 THEN 'text' END AS evidence_type
        FROM (SELECT *,
                CASE WHEN l_linenumber = 7 THEN '0,00'
                     ELSE {cents('CAST(round(l_extendedprice * 100) AS BIGINT)')} END AS amount,
                CASE WHEN l_partkey % 13 = 0 THEN ''
                     ELSE {cents('CAST(round(l_quantity * 100) AS BIGINT)')} END AS quantity
              FROM lineitem) JOIN labels20 ON num = l_suppkey % 20) l
  JOIN v_page p ON p.order_key = l.order_key""",
)

view(
    "v_keyed",
    ["v_raw"],
    f"""
  SELECT *, {label_key('label')} AS lkey, {summary_id('label')} AS sid FROM v_raw
  WHERE trim(label) <> '' OR trim(value) <> ''""",
)

_names = case_map("sid", {sid: label for sid, label, _ in vocab.SUMMARIES}, "trim(label)")
view(
    "v_item",
    ["v_keyed"],
    f"""
  SELECT doc_id, page_ord, order_key, record_key, item_ord, kind, original_label, confidence, conflict,
         coalesce(evidence_type, 'ai') AS evidence_type,
         CASE WHEN kind = 'base' THEN '' ELSE trim(code) END AS code,
         CASE WHEN kind = 'base' THEN base_label ELSE original_label END AS label,
         CASE WHEN kind = 'base' THEN '' WHEN trim(value) = '' THEN '' ELSE trim(reference) END AS reference,
         CASE WHEN trim(value) = '' THEN trim(reference) ELSE trim(value) END AS value,
         CASE WHEN kind = 'base' THEN '' ELSE coalesce(type, 'provento') END AS type,
         CASE WHEN kind = 'field' THEN
                CASE WHEN ckey <> '' THEN 'field:code:' || ckey WHEN lkey <> '' THEN 'field:label:' || lkey END
              WHEN sid IS NOT NULL THEN 'base:' || sid WHEN lkey <> '' THEN 'base:label:' || lkey END AS canonical_key
  FROM (SELECT *, trim(label) AS original_label, {_names} AS base_label, {code_key('code')} AS ckey,
               CASE WHEN is_base OR regexp_matches(lkey, {q(vocab.BASE_LABEL_KEY)}) THEN 'base' ELSE 'field' END AS kind
        FROM v_keyed)""",
)
view("v_review", ["v_item"], "SELECT *, conflict OR canonical_key IS NULL AS review_required FROM v_item")
view(
    "v_field_seq",
    ["v_item", "v_page"],
    """
  SELECT i.doc_id, p.competency, canonical_key AS gk, i.page_ord, item_ord, code, i.label, reference, value, type,
         i.page_ord > i2.opening AS late,
         row_number() OVER (PARTITION BY i.doc_id, p.competency, canonical_key ORDER BY i.page_ord, item_ord) AS rn
  FROM v_item i JOIN v_page p ON p.doc_id = i.doc_id AND p.page_ord = i.page_ord
  JOIN (SELECT doc_id, competency, min(page_ord) AS opening FROM v_page WHERE competency IS NOT NULL GROUP BY 1, 2) i2
    ON i2.doc_id = p.doc_id AND i2.competency = p.competency
  WHERE kind = 'field'""",
)
_same = "(h.hv = n.value AND h.hr = n.reference)"
_fits = (
    f"(({zero('h.hv')} OR {zero('n.value')}) AND ({zero('h.hr')} OR {zero('n.reference')} OR h.hr = n.reference))"
)
view(
    "v_fold",
    ["v_field_seq"],
    f"""/*recursive*/
  SELECT doc_id, competency, gk, rn, value AS hv, reference AS hr, label AS hl, TRUE AS took FROM v_field_seq WHERE rn = 1
  UNION ALL
  SELECT doc_id, competency, gk, rn,
         CASE WHEN took AND {zero('hv')} AND NOT {zero('value')} THEN value ELSE hv END,
         CASE WHEN took AND {zero('hr')} AND NOT {zero('reference')} THEN reference ELSE hr END,
         CASE WHEN took AND length(hl) < length(label) THEN label ELSE hl END, took
  FROM (SELECT n.doc_id, n.competency, n.gk, n.rn, h.hv, h.hr, h.hl, n.value, n.reference, n.label,
               n.late AND ({_same} OR {_fits}) AS took
        FROM v_fold h JOIN v_field_seq n ON n.doc_id = h.doc_id AND n.competency = h.competency AND n.gk = h.gk
                                        AND n.rn = h.rn + 1)""",
)
view(
    "v_unified",
    ["v_fold"],
    """
  SELECT doc_id, competency, gk AS canonical_key, page_ord, item_ord, code, label, type, reference, value,
         row_number() OVER (PARTITION BY doc_id, competency, gk ORDER BY rn) AS occurrence
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, competency, gk, value, reference ORDER BY rn) AS copy
        FROM (SELECT s.doc_id, s.competency, s.gk, s.rn, s.page_ord, s.item_ord, s.code, s.type,
                     CASE WHEN s.rn = 1 THEN e.hl ELSE s.label END AS label,
                     CASE WHEN s.rn = 1 THEN e.hv ELSE s.value END AS value,
                     CASE WHEN s.rn = 1 THEN e.hr ELSE s.reference END AS reference
              FROM v_field_seq s
              JOIN v_fold f ON f.doc_id = s.doc_id AND f.competency = s.competency AND f.gk = s.gk AND f.rn = s.rn
              JOIN (SELECT doc_id, competency, gk, arg_max(hv, rn) AS hv, arg_max(hr, rn) AS hr, arg_max(hl, rn) AS hl
                    FROM v_fold GROUP BY 1, 2, 3) e
                ON e.doc_id = s.doc_id AND e.competency = s.competency AND e.gk = s.gk
              WHERE s.rn = 1 OR NOT f.took))
  WHERE copy = 1""",
)
view(
    "v_ubase",
    ["v_item", "v_page"],
    """
  SELECT doc_id, competency, canonical_key, page_ord, item_ord, label, reference, value,
         row_number() OVER (PARTITION BY doc_id, competency, canonical_key ORDER BY page_ord, item_ord) AS occurrence
  FROM (SELECT i.*, p.competency, row_number() OVER (PARTITION BY i.doc_id, p.competency, canonical_key, value
                                                     ORDER BY i.page_ord, item_ord) AS copy
        FROM v_item i JOIN v_page p ON p.doc_id = i.doc_id AND p.page_ord = i.page_ord
        WHERE kind = 'base' AND competency IS NOT NULL)
  WHERE copy = 1""",
)
