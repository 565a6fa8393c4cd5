import pytest
from pyspark.sql import functions as F

from paysheaf.operators import batches, blocks, guard, layout
from paysheaf.sources import readers


def tokens(spark, rows, page=1):
    return spark.createDataFrame([("d", page, i, s, float(x), float(y), float(w), None) for i, (s, x, y, w) in enumerate(rows)], readers.TOKENS)


def pages(spark, n=1, height=842.0):
    return spark.createDataFrame([("d", p + 1, height) for p in range(n)], "doc_id string, page int, page_height double")


def test_block_items_split_at_the_second_code_column(spark):
    t = tokens(spark, [("1 Salário Base", 10, 100, 70), ("220,00", 105, 100, 35), ("3.000,00", 155, 100, 45), ("511 INSS Normal", 260, 100, 75), ("11,00", 350, 100, 30), ("330,00", 395, 100, 40)])
    s = t.select("*", F.lit("b").alias("record_key"), F.lit(0).alias("part"))
    got = blocks.block_items(s).orderBy("code").collect()
    assert [(r.code, r.label, r.reference, r.value, r.type) for r in got] == [("1", "Salário Base", "220,00", "3.000,00", "provento"), ("511", "INSS Normal", "11,00", "330,00", "desconto")]


def test_month_blocks_and_stitching(spark):
    first = tokens(spark, [("Mês: abr-17", 10, 100, 60), ("1 Salário", 10, 112, 50), ("10,00", 200, 112, 30), ("Mês: mai-17", 10, 200, 60), ("2 Abono", 10, 212, 50), ("5,00", 200, 212, 30)])
    second = tokens(spark, [("3 Extra", 10, 20, 40), ("7,00", 200, 20, 30), ("Mês: jun-17", 10, 100, 60)], page=2)
    t = first.unionByName(second)
    marks = blocks.block_marks(t)
    st = blocks.stitched_tokens(t, marks)
    got = blocks.blocks(t, marks, st).orderBy("page", "block_index").collect()
    assert [(r.record_key, r.month, r.year, r.last_page) for r in got] == [("page:1:block:0", "04", "2017", 1), ("page:1:block:1", "05", "2017", 2), ("page:2:block:0", "06", "2017", 2)]
    assert got[1].raw_text.endswith("3 Extra  |  7,00")
    codes = {r.record_key: r.code for r in blocks.block_items(st).where("code = '3'").collect()}
    assert codes == {"page:1:block:1": "3"}
    assert blocks.month_sheets(t, pages(spark, 2)).first().is_month_sheet


def test_region_modes(spark):
    t = tokens(spark, [("Recibo de Pagamento", 10, 50, 90), ("Líquido", 10, 150, 40), ("Recibo de Pagamento", 10, 300, 90), ("x", 10, 420, 9)])
    got = layout.payslip_regions(t, pages(spark)).orderBy("index").collect()
    assert [(r.y_start, r.y_end, r.is_fallback) for r in got] == [(30.0, 165.0, False), (292.0, 435.0, False)]
    feet = tokens(spark, [("Líquido", 10, 100, 40), ("Líquido", 10, 120, 40), ("Líquido", 10, 300, 40)])
    assert [(r.y_start, r.y_end, r.confidence) for r in layout.payslip_regions(feet, pages(spark)).orderBy("index").collect()] == [(0.0, 120.0, 0.85), (120.0, 320.0, 0.85)]
    empty = tokens(spark, [("x", 1, 1, 1)]).where("false")
    assert [r.is_fallback for r in layout.payslip_regions(empty, pages(spark)).collect()] == [True]


def test_units_of_a_page_with_two_payslips(spark):
    t = tokens(spark, [("Folha de Pagamento: MÊS", 10, 50, 90), ("Líquido", 10, 150, 40), ("Folha de Pagamento: ACERTO", 10, 300, 90), ("x", 10, 420, 9)])
    units = layout.processing_units(t, pages(spark), layout.spatial_text(t, fixed_gap=15.0)).orderBy("result_key").collect()
    assert [(u.result_key, u.payroll_type) for u in units] == [("page:1:region:0", "normal"), ("page:1:region:1", "suplementar")]


def test_complexity(spark):
    simple = tokens(spark, [("a", 20, 100, 0), ("b", 200, 100, 0), ("c", 20, 120, 0), ("d", 200, 120, 0)])
    assert not layout.complexity(simple, layout.PAGE).first().is_complex
    dense = tokens(spark, [("a", x, 100, 0) for x in (10, 50, 150, 200, 300, 380, 450, 520)])
    row = layout.complexity(dense, layout.PAGE).first()
    assert row.is_complex and row.col_count == 8


def test_cut_avoids_boxes(spark):
    t = tokens(spark, [("a", 10, 1, 80), ("b", 100, 1, 40), ("c", 200, 1, 60), ("d", 280, 1, 80)])
    cut = layout.vertical_cut(t, spark.createDataFrame([("d", 1, 10.0, 360.0)], "doc_id string, page int, x_min double, x_max double"), layout.PAGE).first().x_cut
    assert cut < 100 or 140 < cut < 200 or cut > 260


def test_greedy_lines_follow_token_order(spark):
    t = tokens(spark, [("a", 1, 10, 1), ("b", 2, 13, 1), ("c", 3, 16, 1), ("d", 4, 15, 1)])
    lines = {r.str: r.line_y for r in layout.cluster_lines(t).collect()}
    assert lines == {"a": 10.0, "b": 10.0, "c": 16.0, "d": 16.0}


def test_density_and_strategy(spark):
    t = tokens(spark, [("Recibo", 1, 10, 1)])
    row = layout.page_density(t, pages(spark, 2)).orderBy("page").collect()
    assert [(r.char_count, r.element_count, r.is_scanned) for r in row] == [(6, 1, True), (0, 0, True)]


def targets(spark, n, size=0):
    rows = [("r", "fields", i + 1, f"{i + 1} VERBA 1,00" + "x" * size) for i in range(n)]
    return spark.createDataFrame(rows, "record_key string, kind string, ord int, evidence string")


@pytest.mark.parametrize("n, sizes", [(7, [6, 1]), (13, [6, 6, 1]), (24, [6, 6, 6, 6])])
def test_batches_of_six(spark, n, sizes):
    got = batches.plan_batches(targets(spark, n), ["record_key"]).orderBy("first_ord").collect()
    assert [r.target_count for r in got] == sizes


def test_batches_are_halved_and_oversized_ones_blocked(spark):
    got = batches.plan_batches(targets(spark, 6, 200), ["record_key"], max_chars=500).orderBy("first_ord").collect()
    assert [r.target_count for r in got] == [2, 1, 2, 1]
    big = batches.plan_batches(targets(spark, 1, 600), ["record_key"], max_chars=500).first()
    assert big.blocked


def test_planned_calls(spark):
    for n, planned in [(4, 3), (24, 6)]:
        assert batches.planned_calls(batches.plan_batches(targets(spark, n), ["record_key"]), ["record_key"]).first().planned_prompts == planned


@pytest.mark.parametrize(
    "body, verdict",
    [
        ("Holerite Total Proventos Total Descontos Base INSS Salário Líquido", "payroll"), ("Espelho de Ponto Entrada Saída Jornada de Trabalho Banco de Horas", "rejected"),
        ("Contrato de prestação de serviços e condições comerciais", "rejected"), ("FUNC 001 05/2024 x7 ilegível 1.234,56", "payroll_candidate"), ("  ", "scanned_unknown"),
    ],
)
def test_guard(spark, body, verdict):
    page = spark.createDataFrame([("d", 1, body), ("d", 5, "holerite")], readers.PAGE_TEXT)
    assert guard.classify(guard.opening_text(page)).first().classification == verdict


def test_vertical_cut_equals_all_candidates(spark):
    import random

    rng = random.Random(7)
    rows = []
    for page in range(40):
        for i in range(rng.randrange(1, 40)):
            rows.append(("d", page, i, "x", rng.choice([0.0, rng.randrange(0, 600) / 2, rng.random() * 300]), 10.0, rng.choice([None, 0.0, 7.0, rng.random() * 90])))
    toks = spark.createDataFrame(rows, "doc_id string, page int, item_ord int, str string, x double, y double, width double")
    extents = toks.groupBy("doc_id", "page").agg(F.min("x").alias("x_min"), F.max(F.col("x") + F.coalesce("width", F.lit(0.0))).alias("x_max"))
    got = {r["page"]: r["x_cut"] for r in layout.vertical_cut(toks, extents, ["doc_id", "page"]).collect()}
    for page, lo, hi in [(r["page"], r["x_min"], r["x_max"]) for r in extents.collect()]:
        mid, radius = lo + (hi - lo) / 2, (hi - lo) * 0.25
        boxes = [(r[4] or 0.0, (r[4] or 0.0) + (r[6] if r[6] and r[6] > 0 else 20.0)) for r in rows if r[1] == page]
        best = min((sum(a + 1 < x < b - 1 for a, b in boxes) * 1000 + abs(x - mid), k, x) for k in range(int(radius) + 1) for x in [mid - radius + k * 2])
        assert got[page] == int(best[2] * 100 + 0.5) / 100


def test_vertical_cut_of_a_very_wide_page(spark):
    toks = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") * 40).cast("double").alias("x"), F.lit(30.0).alias("width"))
    extents = toks.groupBy("doc_id", "page").agg(F.min("x").alias("x_min"), F.max(F.col("x") + F.col("width")).alias("x_max"))
    (row,) = layout.vertical_cut(toks, extents, ["doc_id", "page"]).collect()
    assert not 1 < row["x_cut"] % 40 < 29


def test_page_work_moves_packed_pages_once(spark):
    """Tokens come dealt by page: lines, text, clusters and blocks of a page need no further shuffle of tokens."""
    from paysheaf.operators import blocks
    from paysheaf.plans.queries_layout import tokens

    toks, _ = tokens(spark, "/root/testdata/sf0.001")
    for df in (layout.visual_lines(toks), layout.spatial_text(toks), layout.clustered_text(layout.cluster_lines(toks))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_COL") == 1
        above = plan.split("REPARTITION_BY_COL")[0].rsplit("Exchange", 1)[0]
        assert "Exchange" not in above
    marks = blocks.block_marks(toks)
    assert "Exchange" not in marks._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_COL")[0].rsplit("Exchange", 1)[0]
