"""Queries that write files, read them back and compare what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..operators import state
from ..sources import readers, sinks, testviews
from .catalogue import query
from .duck import view, with_views
from .queries_items import raw
from .queries_layout import tokens
from .queries_state import results
from .queries_text import texts

MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
_BROKEN = '{"cabecalho": {"mes_ano": "jan-20"},\n "itens": 5,,}\n'


def audited_text(spark, sf) -> str:
    """A folder of text files: one audited month per order on many lines, headings between them, some months broken."""
    line = testviews.table(spark, sf, "lineitem")
    item = F.struct(
        F.col("l_suppkey").cast("string").alias("codigo"), F.concat(F.lit('Verba {"'), "l_returnflag", F.lit('"} \\')).alias("descricao"),
        F.when(F.col("l_returnflag") == "R", "Desconto").otherwise("Provento").alias("tipo"), F.col("l_partkey").cast("string").alias("referencia"),
        F.concat(F.col("l_quantity").cast("int"), F.lit(",00")).alias("valor"),
    )
    placed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("item"))))
    months = line.groupBy("l_orderkey").agg(F.transform(placed, lambda p: p["item"]).alias("itens"))
    label = F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), (F.col("l_orderkey") % 12 + 1).cast("int")), F.lit("-"), F.lpad((F.col("l_orderkey") % 30).cast("string"), 2, "0"))
    whole = F.to_json(F.struct(F.struct(label.alias("mes_ano")).alias("cabecalho"), "itens"))
    printed = F.concat(F.lit("Folha "), "l_orderkey", F.lit(":\n"), F.replace(whole, F.lit('},{"codigo"'), F.lit('},\n  {"codigo"')), F.when(F.col("l_orderkey") % 50 == 0, F.lit("\n" + _BROKEN)).otherwise(""))
    folder = session.scratch_dir(spark, "audited")
    months.select(printed.alias("value")).write.text(folder)
    return folder


@query(
    "audited_items",
    """SELECT strftime(make_date(2000, CAST(l_orderkey % 12 + 1 AS INTEGER), 1), '%m') || '/' || (2000 + l_orderkey % 30) AS competency, CAST(l_suppkey AS VARCHAR) AS code,
         'Verba {"' || l_returnflag || '"} \\' AS label, CASE WHEN l_returnflag = 'R' THEN 'desconto' ELSE 'provento' END AS type, CAST(l_partkey AS VARCHAR) AS reference,
         CAST(l_quantity AS INTEGER) || ',00' AS value, 'folha_normal' AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS item_ord FROM lineitem""",
)
def audited_items(spark, sf):
    return readers.audited_items(readers.audited_blocks(spark, audited_text(spark, sf)))


@query("audited_unreadable", f"SELECT trim('{_BROKEN}', chr(10)) AS raw, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 50 = 0 HAVING count(*) > 0")
def audited_unreadable(spark, sf):
    return readers.audited_objects(spark, audited_text(spark, sf))[1].groupBy("raw").agg(F.count("*").alias("n"))


@query(
    "replace_final_stored",
    with_views(
        ["v_latest"],
        """SELECT job_id, result_key, page_number, result_kind, value, attempts FROM v_latest WHERE result_kind <> 'final' OR CAST(job_id AS BIGINT) % 2 <> 0
           UNION ALL SELECT job_id, printf('final:%05d', page_number), page_number, 'final', min(value), 1 FROM v_latest WHERE CAST(job_id AS BIGINT) % 2 = 0 GROUP BY job_id, page_number""",
    ),
)
def replace_final_stored(spark, sf):
    latest = state.latest_results(results(spark, sf)).drop("executed")
    even = latest.where(F.col("job_id").cast("long") % 2 == 0)
    finals = even.groupBy("job_id", "page_number").agg(F.min("value").alias("value"), F.max("completed_at").alias("completed_at")).withColumn("position", F.col("page_number"))
    path = session.scratch_dir(spark, "results")
    sinks.write_results(latest, path)
    fresh = state.replace_final(latest.limit(0), finals)
    # jobs that had no final rows so far get theirs as well
    sinks.write_results(fresh, path)
    return sinks.read_results(spark, path).drop("completed_at")


view("v_csv", [], """SELECT CAST(l_orderkey AS VARCHAR) AS "Código", CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'dito "' || l_returnflag || '", ' || l_linestatus END AS "Descrição", l_quantity AS "Valor; total" FROM lineitem""")


def _cells(spark, sf):
    quoted = F.concat(F.lit('dito "'), "l_returnflag", F.lit('", '), "l_linestatus")
    return testviews.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("Código"), F.when(F.col("l_returnflag") != "R", quoted).alias("Descrição"), F.col("l_quantity").alias("Valor; total")
    )


@query("csv_sink", with_views(["v_csv"], """SELECT "Código", coalesce("Descrição", '') AS "Descrição", "Valor; total" FROM v_csv"""))
def csv_sink(spark, sf):
    path = session.scratch_dir(spark, "sheet")
    sinks.export(_cells(spark, sf), path)
    read = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return read.select("Código", F.coalesce("Descrição", F.lit("")).alias("Descrição"), F.col("`Valor; total`").cast("double").alias("Valor; total"))


@query("json_sink", with_views(["v_csv"], "SELECT * FROM v_csv"))
def json_sink(spark, sf):
    path = session.scratch_dir(spark, "json")
    df = _cells(spark, sf)
    sinks.export(df, path, "JSON")
    return spark.read.schema(df.schema).json(path)


@query("token_source", with_views(["v_tok"], "SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(item_ord AS BIGINT) AS item_ord, str, x, y, width, CAST(NULL AS DOUBLE) AS page_height FROM v_tok"))
def token_source(spark, sf):
    path = session.scratch_dir(spark, "tokens")
    tokens(spark, sf)[0].write.json(path)
    return readers.tokens(spark, path, "json")


@query("page_text_source", with_views(["v_text"], "SELECT doc_id, CAST(page AS INTEGER) AS page, text FROM v_text"))
def page_text_source(spark, sf):
    path = session.scratch_dir(spark, "texts")
    texts(spark, sf).select("doc_id", F.col("page").cast("int").alias("page"), "text").write.parquet(path)
    return readers.page_texts(spark, path)


def raw_texts(spark, sf):
    """One raw extraction text per page; odd pages use the other property names."""
    item = {
        "code": F.col("code"), "label": F.when(F.col("page_ord") % 2 == 0, F.col("label")), "description": F.when(F.col("page_ord") % 2 == 1, F.col("label")),
        "reference": F.when(F.col("page_ord") % 2 == 0, F.col("reference")), "ref": F.when(F.col("page_ord") % 2 == 1, F.col("reference")),
        "value": F.when(F.col("page_ord") % 2 == 0, F.col("value")), "amount": F.when(F.col("page_ord") % 2 == 1, F.col("value")),
        "type": F.col("type"), "isBase": F.col("is_base"), "conflict": F.col("conflict"), "confidence": F.col("confidence"), "evidenceType": F.col("evidence_type"),
    }
    listed = F.transform(F.array_sort(F.collect_list(F.struct("item_ord", F.struct(*[c.alias(n) for n, c in item.items()]).alias("i")))), lambda p: p["i"])
    pages = raw(spark, sf).groupBy("doc_id", "page_ord", "record_key", "raw_month", "raw_year").agg(listed.alias("items"))
    page = F.struct(F.col("page_ord").alias("pageNumber"), F.col("raw_month").alias("month"), F.col("raw_year").alias("year"), F.col("record_key").alias("recordKey"), "items")
    return pages.select("doc_id", F.when(F.col("page_ord") % 3 == 0, F.to_json(F.struct(F.array(page).alias("pages")))).otherwise(F.to_json(page)).alias("raw_json"))


@query(
    "raw_extraction",
    with_views(
        ["v_raw", "v_page"],
        """SELECT r.doc_id, r.page_ord AS page, p.month, p.year, r.record_key, row_number() OVER (PARTITION BY r.doc_id, r.page_ord ORDER BY r.item_ord) AS item_ord,
             r.code, r.label, coalesce(r.reference, '') AS reference, coalesce(r.value, '') AS value, r.type, r.is_base, r.conflict, r.confidence, r.evidence_type
           FROM v_raw r JOIN v_page p USING (doc_id, page_ord)""",
    ),
)
def raw_extraction(spark, sf):
    # each text is an extraction of its own
    texts_of = raw_texts(spark, sf).withColumn("doc_id", F.concat_ws("#", "doc_id", F.get_json_object("raw_json", "$.pageNumber"), F.get_json_object("raw_json", "$.pages[0].pageNumber")))
    pages = readers.raw_pages(texts_of)
    found = readers.raw_page_items(pages).join(pages.select("doc_id", "page_ord", "page", "month", "year", "record_key"), ["doc_id", "page_ord"])
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select(
        F.substring_index("doc_id", "#", 1).alias("doc_id"), F.col("page").cast("long").alias("page"), "month", "year", "record_key", "item_ord", "code", "label",
        blank("reference"), blank("value"), "type", "is_base", "conflict", "confidence", "evidence_type",
    )
