import pytest
from pyspark.sql import functions as F

from paysheaf.functions import canonical, dates, money, text, vocab
from paysheaf.operators import catalog


def one(spark, value, builder, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(builder(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "label, key",
    [
        ("SAL. BASE", "salario base"), ("Salário  Base", "salario base"), ("13º Salário", "13 salario"), ("Líquido a Receber", "valor liquido"),
        ("  --  ", ""), (None, ""), ("Vale Transp.", "vale transporte"), ("H.E.", "h e"), ("Salário Líquido", "valor liquido"),
    ],
)
def test_label_key(spark, label, key):
    assert one(spark, label, text.label_key) == key
    if label:
        assert text.constant_label_key(label) == key


@pytest.mark.parametrize("code, key", [("001", "1"), ("000", "0"), (" 42 ", "42"), ("A-1", "a 1"), ("", ""), (None, "")])
def test_code_key(spark, code, key):
    assert one(spark, code, text.code_key) == key


@pytest.mark.parametrize("value, printed", [(1234567.891, "1.234.567,89"), (0.125, "0,13"), (0.0, "0,00"), (-3.5, "-3,50"), (999.999, "1.000,00"), (None, "")])
def test_format_number(spark, value, printed):
    assert one(spark, value, money.format_number, "double") == printed


@pytest.mark.parametrize("value, number", [("R$ 1.620,65", 1620.65), ("1.5", 15.0), ("-10,00", -10.0), ("", None), ("abc", 0.0), ("1,2,3", None)])
def test_parse_currency(spark, value, number):
    assert one(spark, value, money.parse_currency) == number


@pytest.mark.parametrize("value, number", [("R$ 100,85", 100.85), ("12,5%", 12.5), ("abc", None), ("", None), (None, None)])
def test_parse_number(spark, value, number):
    assert one(spark, value, money.parse_number) == number


def test_totals_consistency(spark):
    df = spark.createDataFrame([("1.620,65", "228,10", "1.392,55"), ("1.620,65", "228,10", "1.392,00"), (None, "1,00", "1,00")], "a string, d string, n string")
    rows = df.select(money.totals_consistent(F.col("a"), F.col("d"), F.col("n")).alias("r")).collect()
    assert [r.r for r in rows] == [True, False, False]


@pytest.mark.parametrize("month, clean", [("MM", ""), ("00", ""), ("4", "04"), ("12", "12"), (None, ""), (" 7 ", "07")])
def test_clean_month(spark, month, clean):
    assert one(spark, month, dates.clean_month) == clean


@pytest.mark.parametrize(
    "label, expected", [("abr-17", ("04", "2017")), ("Abril/2017", ("04", "2017")), ("MARÇO-18", ("03", "2018")), ("xyz-17", None), ("abr17", None)]
)
def test_parse_month_label(spark, label, expected):
    got = one(spark, label, dates.parse_month_label)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ("Competência: 5/24", ("05", "2024")), ("PERÍODO 05-2024", ("05", "2024")), ("Mês/Ano: 12/2023", ("12", "2023")),
        ("Referência: 01/2020 Competência: 02/2021", ("02", "2021")), ("pago\n03/2022\nfim", ("03", "2022")), ("valor 103/2022", None),
    ],
)
def test_infer_competency(spark, page, expected):
    got = one(spark, page, dates.infer_competency)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "value, ok", [("29/02/2024", True), ("29/02/2023", False), ("38/07", False), ("31.12", True), ("1-13", False), ("?1/02", False), ("", False), ("29/02", True)]
)
def test_valid_date(spark, value, ok):
    assert one(spark, value, dates.is_valid_date) is ok


@pytest.mark.parametrize("raw, time", [("8:5", "08:05"), ("0825", "08:25"), ("?8:25", "?8:25"), (None, "??:??"), ("abc", "abc"), ("123:4", "123:04")])
def test_normalize_time(spark, raw, time):
    assert one(spark, raw, dates.normalize_time) == time


def test_mask_uncertain(spark):
    df = spark.createDataFrame([("Ab 1-9", 0.5), ("Ab 1-9", 0.7), ("Ab 1-9", None)], "t string, c double")
    assert [r.r for r in df.select(dates.mask_uncertain(F.col("t"), F.col("c")).alias("r")).collect()] == ["?? ?-?", "Ab 1-9", "Ab 1-9"]


def test_progress_percent(spark):
    df = spark.createDataFrame([(0, 4), (1, 4), (4, 4), (0, 0)], "d int, t int")
    assert [r.r for r in df.select(dates.progress_percent(F.col("d"), F.col("t")).alias("r")).collect()] == [10, 31, 95, 10]


@pytest.mark.parametrize(
    "label, sid",
    [("Base de Cálculo do INSS", "base_inss"), ("BASE IRRF 13º", "base_irrf_13"), ("Base IRF", "base_irrf"), ("Valor do FGTS", None), ("TOT.RENDIMENTOS", "total_proventos"), ("Salário", None)],
)
def test_summary_id(spark, label, sid):
    assert one(spark, label, canonical.summary_id) == sid


def test_summary_label_of_a_line(spark):
    assert one(spark, "VALOR DO FGTS 100,00", text.summary_label) == "FGTS do Mês"
    assert one(spark, "x | Base especial: 10,00 | y", text.summary_label) == "Base especial:"
    assert one(spark, "- Base especial 10,00", text.summary_label) == "Base especial"


@pytest.mark.parametrize(
    "page, kind",
    [
        ("Folha de Pagamento: | MÊS", "normal"), ("ACERTO de férias", "suplementar"), ("Participação nos Lucros", "plr"),
        ("Folha de pagamento: 13o", "decimo_terceiro"), ("x" * 700 + " decimo terceiro", "normal"), (None, "normal"),
    ],
)
def test_standard_type(spark, page, kind):
    assert one(spark, page, text.standard_payroll_type) == kind


@pytest.mark.parametrize(
    "block, kind",
    [
        ("371 13o\n374 13o\n371 13o", "historico_13"), ("REMUNERAÇÃOMES 1", "normal"), ("311 Part Lucr Resul", "plr"), ("13o. Salario", "decimo_terceiro"), ("Outros", "suplementar"),
    ],
)
def test_block_type(spark, block, kind):
    assert one(spark, block, text.block_payroll_type) == kind


def test_catalog(spark):
    assert len({r[0] for r in vocab.catalog_rows()}) == 47
    assert one(spark, "FGTS Empresa", catalog.classify)["kind"] == "informativo_patronal"
    assert one(spark, "SALÁRIO BASE", catalog.classify)["category"] == "remuneracao_principal"
    assert one(spark, "Alíquota IRRF", catalog.classify)["kind"] == "percentual"
    assert one(spark, "zzz", catalog.classify) is None
    assert one(spark, "", catalog.classify) is None


def test_payroll_type_label(spark):
    assert one(spark, "historico_13", text.payroll_type_label) == "Histórico de 13º"
    assert one(spark, "unknown", text.payroll_type_label) == "Folha normal"
