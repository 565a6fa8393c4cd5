"""Payslip-shaped views over the star-schema test tables.

One order is one payslip page, its line items are the payslip items, and all
orders of one nation form one document.  Every rule below is a pure function of
the row, so the same views can be written in SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..plans import segmented

# label, other spelling; the position is the numeric code
LABELS = [
    ("Salário Base", "SAL BASE"),
    ("INSS Normal", "INSS NORMAL"),
    ("Imposto de Renda", "IRRF"),
    ("Vale Transporte", "VT"),
    ("Vale Refeição", "Vale  Refeicao"),
    ("Horas Extras", "Hora Extra"),
    ("Adiantamento Salarial", "ADIANTAMENTO SALARIAL"),
    ("Faltas", "Desc. Faltas"),
    ("13º Salário", "13 Salário"),
    ("Plano de Saúde", "PLANO DE SAÚDE"),
    ("Adicional Noturno", "Adic. Noturno"),
    ("Comissão", "COMISSÃO"),
    ("Pensão Alimentícia", "Pensao Alimenticia"),
    ("Empréstimo Consignado", "Emprest. Consignado"),
    ("Reembolso VR", "Reemb. VR"),
    ("Part Lucr Resul", "PART LUCR RESUL"),
    ("Insalubridade", "INSALUBRIDADE 20%"),
    ("Base INSS", "Base de Cálculo do INSS"),
    ("FGTS do Mês", "FGTS DO MES"),
    ("Valor Líquido", "Salário Líquido"),
]
TYPES = {
    "1-URGENT": "plr", "2-HIGH": "decimo_terceiro", "3-MEDIUM": "suplementar",
    "4-NOT SPECIFIED": "historico_13", "5-LOW": "normal",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), position + 1)


def record_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their document, before the position in the document is known."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    key = F.col("o_orderkey")
    month = (
        F.when(key % 97 == 0, "")
        .when(key % 101 == 0, "13")
        .when(key % 103 == 0, "0?")
        .when(key % 107 == 0, "MM")
        .when(key % 7 == 0, F.month("o_orderdate").cast("string"))
        .otherwise(F.date_format("o_orderdate", "MM"))
    )
    year = F.when(key % 211 == 0, "0000").otherwise(F.date_format("o_orderdate", "yyyy"))
    payroll_type = F.lit(None).cast("string")
    for priority, name in TYPES.items():
        payroll_type = F.when(F.col("o_orderpriority") == priority, name).otherwise(payroll_type)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("doc_id"),
        key.alias("order_key"),
        F.col("o_orderdate").alias("order_date"),
        F.concat(F.lit("order:"), key).alias("record_key"),
        month.alias("raw_month"),
        year.alias("raw_year"),
        F.when(key % 11 != 0, payroll_type).alias("payroll_type"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("company"),
        F.when(key % 3 != 0, F.col("c_name")).alias("employee"),
        F.when(key % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("payment_date"),
        (key % 113 == 0).alias("review_required"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per payslip page: doc_id, page_ord (1..n in document order), header values."""
    heads = record_heads(spark, sf_dir)
    return segmented.numbered(
        heads, ["doc_id"], ["order_date", "order_key"], F.col("order_date"), out="page_ord"
    ).withColumn("page_ord", F.col("page_ord").cast("long"))


def raw_items(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    """One row per printed item, before any repair or routing."""
    heads = records(spark, sf_dir) if heads is None else heads
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    number = (F.col("l_suppkey") % 20).cast("int")
    printed = F.when(F.col("l_orderkey") % 2 == 1, F.lpad(number.cast("string"), 3, "0")).otherwise(
        number.cast("string")
    )
    code = F.when((F.col("l_partkey") % 17 == 0) | (number >= 17), "").otherwise(printed)
    label = F.when((F.col("l_linenumber") + F.col("page_ord")) % 2 == 0, _pick([b for _, b in LABELS], number)).otherwise(
        _pick([a for a, _ in LABELS], number)
    )
    amount = F.when(F.col("l_linenumber") == 7, "0,00").otherwise(
        money.format_cents(F.round(F.col("l_extendedprice") * 100).cast("long"))
    )
    quantity = F.when(F.col("l_partkey") % 13 == 0, "").otherwise(
        money.format_cents(F.round(F.col("l_quantity") * 100).cast("long"))
    )
    shifted = F.col("l_partkey") % 89 == 0
    order = (
        F.col("l_linenumber").cast("long") * F.lit(10**18)
        + F.col("l_partkey") * F.lit(10**7)
        + F.col("l_suppkey")
    )
    keys = heads.select("order_key", "doc_id", "page_ord", "record_key", "raw_month", "raw_year", "payroll_type")
    # joined first: the shuffle then carries a few numbers per item instead of printed text
    return line.join(keys, line.l_orderkey == keys.order_key).select(
        *keys.columns,
        order.alias("item_ord"),
        code.alias("code"),
        label.alias("label"),
        F.when(shifted, amount).otherwise(quantity).alias("reference"),
        F.when(shifted, "").otherwise(amount).alias("value"),
        F.when(F.col("l_partkey") % 19 != 0, F.when(F.col("l_returnflag") == "R", "desconto").otherwise("provento"))
        .alias("type"),
        (number == 18).alias("is_base"),
        (F.col("l_partkey") % 997 == 0).alias("conflict"),
        F.lit(False).alias("review_required"),
        ((F.col("l_quantity") % 5) / 5).alias("confidence"),
        F.when(F.col("l_linenumber") % 3 == 0, "text").alias("evidence_type"),
    )


def amount_cents(c: Column) -> Column:
    """Cents of a printed amount of these views, 0 when blank."""
    digits = F.regexp_replace(c, "[.,]", "")
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.cast("long"))


def page_texts(items: DataFrame) -> DataFrame:
    """Printed text of every payslip page: two items per line, then the totals.

    A page's text is one cell, so the items of one page are put together here.
    """
    chunk = F.concat_ws(
        "  |  ",
        F.trim(F.concat_ws(" ", "code", "label")),
        F.when(F.col("reference") != "", F.col("reference")),
        F.when(F.col("value") != "", F.col("value")),
    )
    cents = amount_cents(F.col("value"))
    pages = items.groupBy("doc_id", "page_ord", "order_key", "raw_month", "raw_year").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_ord", chunk.alias("chunk")))), lambda e: e["chunk"]).alias("chunks"),
        F.sum(F.when(F.col("type") == "desconto", F.lit(0)).otherwise(cents)).alias("plus"),
        F.sum(F.when(F.col("type") == "desconto", cents).otherwise(F.lit(0))).alias("minus"),
    )
    lines = F.transform(
        F.sequence(F.lit(1), F.size("chunks"), F.lit(2)), lambda i: F.array_join(F.slice("chunks", i, 2), "  |  ")
    )
    foot = F.array(
        F.concat(F.lit("TOTAL PROVENTOS "), money.format_cents(F.col("plus"))),
        F.concat(F.lit("TOTAL DESCONTOS "), money.format_cents(F.col("minus"))),
        F.concat(F.lit("VALOR LÍQUIDO "), money.format_cents(F.col("plus") - F.col("minus"))),
        F.concat(F.lit("BASE DE CÁLCULO DO INSS "), money.format_cents(F.col("plus"))),
        F.concat(F.lit("FGTS EMPRESA "), money.format_cents(F.col("minus"))),
        F.concat(F.lit("Outros valores "), money.format_cents(F.col("minus"))),
    )
    head = F.array(F.concat(F.lit("Competência: "), F.col("raw_month"), F.lit("/"), F.col("raw_year")))
    return pages.select(
        "doc_id", F.col("page_ord").alias("page"), "order_key", F.array_join(F.concat(head, lines, foot), "\n").alias("text")
    )


BLOCKS_PER_PAGE = 6


def page_tokens(items: DataFrame, heads: DataFrame) -> DataFrame:
    """Positioned tokens: six payslips stacked on a sheet, two items per line, totals below.

    On every seventh sheet the last payslip runs over to the top of the next one.
    """
    names = list("jan fev mar abr mai jun jul ago set out nov dez".split())
    sheet = F.floor((F.col("page_ord") - 1) / BLOCKS_PER_PAGE).cast("int") + 1
    block = ((F.col("page_ord") - 1) % BLOCKS_PER_PAGE).cast("int")
    cents = amount_cents(F.col("value"))
    cells = F.struct("item_ord", F.trim(F.concat_ws(" ", "code", "label")).alias("name"), "reference", "value")
    # items lie by order: their lists are made and joined there, so only finished pages move
    lists = items.groupBy("order_key", "doc_id", "page_ord").agg(
        F.array_sort(F.collect_list(cells)).alias("cells"), F.sum(F.when(F.col("type") == "desconto", F.lit(0)).otherwise(cents)).alias("plus"),
        F.sum(F.when(F.col("type") == "desconto", cents).otherwise(F.lit(0))).alias("minus"),
    ).select(F.col("order_key").alias("_key"), F.struct("doc_id", "page_ord").alias("_page"), "cells", "plus", "minus")
    own = F.array_contains(F.array("_page"), F.struct("doc_id", "page_ord")) & F.col("doc_id").isNotNull()
    base = heads.select("doc_id", "page_ord", "order_date", "order_key").hint("shuffle_hash").join(lists, (F.col("order_key") == F.col("_key")) & own, "left").withColumns(
        {"page": sheet, "block": block, "n": F.when(F.col("cells").isNull(), 0).otherwise(F.size("cells"))}
    )

    def tok(s, x, line, k):
        return F.struct(s.alias("str"), F.lit(float(x)).alias("x"), line.cast("int").alias("line"), k.cast("int").alias("k"))

    period = F.concat(F.lit("Mês: "), _pick(names, F.month("order_date") - 1), F.lit("-"), F.date_format("order_date", "yy"))
    end = F.floor((F.col("n") + 1) / 2) + 1
    amount = [money.format_cents(F.coalesce(c, F.lit(0).cast("long"))) for c in (F.col("plus"), F.col("minus"), F.col("plus") - F.col("minus"))]
    frame = F.array(
        tok(F.lit("Folha Normal"), 10, F.lit(-1), F.lit(0)), tok(period, 10, F.lit(0), F.lit(1)),
        tok(F.lit("TOT.RENDIMENTOS"), 10, end, F.lit(900000)), tok(amount[0], 150, end, F.lit(900001)),
        tok(F.lit("TOTALDESCONTOS"), 310, end, F.lit(900002)), tok(amount[1], 460, end, F.lit(900003)),
        tok(F.lit("BASEDECALCULODOINSS"), 600, end, F.lit(900004)), tok(amount[0], 760, end, F.lit(900005)),
        tok(F.lit("SALARIOLIQUIDONOMES"), 600, end + 1, F.lit(900006)), tok(amount[2], 760, end + 1, F.lit(900007)),
    )

    def printed(c, i):
        line, shift = F.floor(i / 2) + 1, (i % 2) * 300
        return F.array(
            *[
                F.struct(
                    c[name].alias("str"), (F.lit(float(x)) + shift).alias("x"), line.cast("int").alias("line"), (i * 10 + 10 + at).cast("int").alias("k")
                )
                for at, (name, x) in enumerate([("name", 10), ("reference", 150), ("value", 210)])
            ]
        )

    body = F.flatten(F.transform(F.coalesce("cells", F.expr("cast(array() as array<struct<item_ord:bigint,name:string,reference:string,value:string>>)")), printed))
    whole = base.select("doc_id", "page", "block", F.filter(F.concat(frame, body), lambda t: t["str"] != "").alias("toks"))

    def part(page, block, toks):
        return F.struct(page.alias("page"), block.cast("int").alias("block"), toks.alias("toks"))

    runs_over = (F.col("page") % 7 == 0) & (F.col("block") == BLOCKS_PER_PAGE - 1)
    stays, moves = F.filter("toks", lambda t: t["line"] < 3), F.filter("toks", lambda t: t["line"] >= 3)
    parts = F.when(runs_over, F.array(part(F.col("page"), F.col("block"), stays), part(F.col("page") + 1, F.lit(-1), moves))).otherwise(
        F.array(part(F.col("page"), F.col("block"), F.col("toks")))
    )
    # the tokens of a page come together once, packed; nothing is pruned or filtered below the unpacking, so all branches of a plan share this shuffle
    packed = whole.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*").repartition("doc_id", "page")
    flat = packed.select("doc_id", "page", "block", F.explode(F.when(F.rand(0) >= 0, F.col("toks"))).alias("t")).select("doc_id", "page", "block", "t.*")
    over = F.col("block") < 0
    line_y = F.when(over, 12 * (F.col("line") - 2)).otherwise(200 + 1000 * F.col("block") + 12 * F.col("line"))
    return flat.select(
        "doc_id",
        "page",
        (F.col("block").cast("long") * 1000000 + F.col("k")).alias("item_ord"),
        "str", "x", (line_y + (F.col("k") % 3) * 0.5).cast("double").alias("y"), (F.length("str") * 6.0).cast("double").alias("width"),
    )


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every prose document as tokens: one line of text per line, x by character offset."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), "text")
    lines = docs.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    words = lines.select("doc_id", "page", "ln", F.posexplode(F.split("line", " ")).alias("w", "str"))
    return words.where(F.col("str") != "").select(
        "doc_id", "page", (F.col("ln").cast("long") * 1000000 + F.col("w")).alias("item_ord"), "str",
        (F.col("w") * 40.0).alias("x"), (F.col("ln") * 12.0).alias("y"), (F.length("str") * 6.0).alias("width"),
    )
