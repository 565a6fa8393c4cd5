import random

import pytest
from pyspark.sql import functions as F

from paysheaf.operators import audit, benchmark, coverage, export, normalize, reconcile, text_extract, unify
from paysheaf.plans import segmented
from paysheaf.sources import readers

RAW = (
    "doc_id string, page_ord long, item_ord long, code string, label string, reference string, value string, type string, is_base boolean,"
    " conflict boolean, review_required boolean, confidence double, evidence_type string"
)


def raw(spark, rows):
    full = [(d, p, i, c, label, r, v, None, False, None, None, None, None) for d, p, i, c, label, r, v in rows]
    return spark.createDataFrame(full, RAW)


def heads(spark, rows):
    return spark.createDataFrame(
        [(d, p, m, y, t, f"r{p}", None, None, None, False) for d, p, m, y, t in rows],
        "doc_id string, page_ord long, month string, year string, payroll_type string, record_key string, company string, employee string, payment_date string, review_required boolean",
    )


def unified(spark, rows, pages):
    items = normalize.canonical_items(raw(spark, rows)).where("kind = 'field'")
    got = unify.unify_fields(items, heads(spark, pages)).orderBy("page_ord", "item_ord").collect()
    return [(r.code, r.label, r.reference, r.value, r.occurrence) for r in got]


def test_complementary_pages_merge(spark):
    rows = [("d", 1, 1, "10", "Salário Base", "", "3.000,00"), ("d", 1, 2, "40", "Reembolso VR", "0,00", "0,00"), ("d", 2, 1, "40", "Reembolso VR", "0,00", "360,00"), ("d", 2, 2, "50", "Horas", "", "250,00")]
    got = unified(spark, rows, [("d", 1, "02", "2018", None), ("d", 2, "02", "2018", None)])
    assert [g[3] for g in got] == ["3.000,00", "360,00", "250,00"]


def test_other_values_become_occurrences(spark):
    rows = [("d", 1, 1, "10", "Salário", "", "1.000,00"), ("d", 2, 1, "010", "Salário", "", "500,00"), ("d", 3, 1, "10", "Salário", "", "500,00")]
    got = unified(spark, rows, [("d", p, "12", "2024", None) for p in (1, 2, 3)])
    assert [(g[3], g[4]) for g in got] == [("1.000,00", 1), ("500,00", 2)]


def fold(rows):
    """Plain sequential rule, for comparison with the relational form."""
    zero = lambda v: v in ("", "0", "0,0", "0,00", "0.00")
    kept = []
    opening = rows[0][0]
    for page, _, label, ref, value in rows:
        head = kept[0] if kept and page > opening else None
        if head:
            same = head[2] == value and head[1] == ref
            fits = (zero(head[2]) or zero(value)) and (zero(head[1]) or zero(ref) or head[1] == ref)
            if same or fits:
                if zero(head[2]) and not zero(value):
                    head[2] = value
                if zero(head[1]) and not zero(ref):
                    head[1] = ref
                if len(head[0]) < len(label):
                    head[0] = label
                continue
        kept.append([label, ref, value])
    seen, out = set(), []
    for label, ref, value in kept:
        if (ref, value) not in seen:
            seen.add((ref, value))
            out.append((label, ref, value, len(out) + 1))
    return out


def test_unify_equals_the_sequential_rule(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for doc in range(400):
        name = f"d{doc}"
        group = []
        for page in sorted(rnd.choices(range(1, 5), k=rnd.randint(1, 7))):
            item = len(group) + 1
            ref, value = rnd.choice(["", "0,00", "5", "7"]), rnd.choice(["", "0,00", "10,00", "20,00"])
            if value == "" and ref != "":
                ref = ""  # a blank value with a reference is repaired before
            group.append((page, item, rnd.choice(["A", "A longer", "Bee"]), ref, value))
        rows += [(name, p, i, "7", label, r, v) for p, i, label, r, v in group]
        want[name] = fold(group)
    items = raw(spark, rows).select("*", F.lit("field").alias("kind"), F.lit("field:code:7").alias("canonical_key"))
    pages = heads(spark, [(f"d{d}", p, "01", "2020", None) for d in range(400) for p in range(1, 5)])
    used = items.select("doc_id", "page_ord").distinct()
    got = {}
    for r in unify.unify_fields(items, pages.join(used, ["doc_id", "page_ord"])).orderBy("doc_id", "page_ord", "item_ord").collect():
        got.setdefault(r.doc_id, []).append((r.label, r.reference, r.value, r.occurrence))
    assert got == want


def test_bases_keep_distinct_values_and_keyless_repeats(spark):
    rows = [("d", 1, 1, "", "Base INSS", "", "1,00"), ("d", 2, 1, "", "Base de Calculo do INSS", "", "1,00"), ("d", 2, 2, "", "Base INSS", "", "2,00"), ("d", 2, 3, "", "Base | INSS", "", "1,00"), ("d", 2, 4, "", "Base | X", "", "3,00")]
    items = normalize.canonical_items(raw(spark, rows).withColumn("is_base", F.lit(True)))
    got = unify.unify_bases(items, heads(spark, [("d", 1, "01", "2020", None), ("d", 2, "01", "2020", None)])).orderBy("page_ord", "item_ord").collect()
    assert [(r.canonical_key, r.value, r.occurrence) for r in got] == [("base:base_inss", "1,00", 1), ("base:base_inss", "2,00", 2), (None, "3,00", 1)]


def test_raw_pages_repair_and_routing(spark):
    doc = """{"pages":[{"page":1,"month":"4","year":"2017","items":[{"code":"40","description":"Reembolso VR","reference":"0,00","amount":"360,00"},
      {"code":"100","description":"Salário Base","reference":"2.500,00","amount":""},{"description":"Base INSS","amount":"2.500,00"}],"totals":{"netValue":"9,00"}},{"month":"MM","items":[]}]}"""
    pages = readers.raw_pages(spark.createDataFrame([("d", doc), ("e", '{"month":"05","year":"2017","fields":[{"code":"1","label":"X","value":"1,00"}]}')], "doc_id string, raw_json string"))
    assert [(r.doc_id, r.page, r.month) for r in pages.orderBy("doc_id", "page_ord").collect()] == [("d", 1, "04"), ("d", 2, ""), ("e", 1, "05")]
    items = normalize.canonical_items(readers.raw_page_items(pages))
    got = {(r.doc_id, r.label): (r.kind, r.reference, r.value) for r in items.collect()}
    assert got[("d", "Salário Base")] == ("field", "", "2.500,00")
    assert got[("d", "Base INSS")] == ("base", "", "2.500,00")
    extra = normalize.totals_as_bases(readers.raw_page_totals(pages), items.where("kind = 'base'"), ["doc_id", "page_ord"])
    assert [(r.canonical_key, r.value) for r in extra.collect()] == [("base:valor_liquido", "9,00")]


def test_ambiguous_base_has_no_key(spark):
    items = normalize.canonical_items(raw(spark, [("d", 1, 1, "", "Base I.N.S.S. | F.G.T.S. do Mês", "", "100,00")]).withColumn("is_base", F.lit(True)))
    row = items.first()
    assert row.canonical_key is None and row.review_required


def test_reconcile_keeps_primary_and_fills_gaps(spark):
    schema = "doc_id string, item_ord long, code string, label string, reference string, value string, type string, evidence_type string"
    a = spark.createDataFrame([("d", 1, "10", "Salário Base", "", "3.000,00", None, "text"), ("d", 2, "20", "Vazio", "", "", None, "text"), ("d", 3, "30", "Outro", "", "1,00", None, "text")], schema)
    b = spark.createDataFrame([("d", 1, "10", "Salário Base", "", "3.000,00", None, None), ("d", 2, "91", "INSS", "", "330,00", None, None), ("d", 3, "20", "Vazio", "", "5,00", None, None), ("d", 4, "30", "Outro", "", "2,00", None, None)], schema)
    got = reconcile.reconcile(a, b, ["doc_id"]).orderBy("src_rank", "item_ord").collect()
    assert [(r.code, r.value, r.conflict, r.occurrence) for r in got] == [("10", "3.000,00", False, 1), ("20", "5,00", False, 1), ("30", "1,00", False, 1), ("91", "330,00", False, 1), ("30", "2,00", True, 2)]
    assert got[0].evidence_type == "text" and got[1].evidence_type == "text"


def test_merge_halves(spark):
    schema = "doc_id string, item_ord long, code string, label string, reference string, value string"
    left = spark.createDataFrame([("d", 1, "40", "Reembolso VR", "0,00", ""), ("d", 2, "91", "Adicional Periculosidade", "146,67", "")], schema)
    right = spark.createDataFrame([("d", 1, "40", "Reembolso VR", "", "360,00"), ("d", 2, "91", "Adicional Periculosidade", "", "290,92"), ("d", 3, "511", "INSS Normal", "0,00", "100,85")], schema)
    got = reconcile.merge_halves(left, right, ["doc_id"]).orderBy("src_rank", "item_ord").collect()
    assert [(r.code, r.reference, r.value) for r in got] == [("40", "0,00", "360,00"), ("91", "146,67", "290,92"), ("511", "0,00", "100,85")]


def test_inventory_and_coverage(spark):
    page = spark.createDataFrame([("d", 1, "10 Salário Base | 220,00 | 3.000,00\n91 INSS | 11,00 | 330,00\nREMUNERAÇÃO MÊS 3.000,00\nBASE DE CÁLCULO DO INSS 3.000,00\nTOTAL DESCONTOS 330,00")], readers.PAGE_TEXT)
    codes = text_extract.inventory_codes(page)
    assert [r.code for r in codes.orderBy("line").collect()] == ["10", "91"]
    assert "Remuneração do Mês" in [r.label for r in text_extract.inventory_summaries(page).collect()]
    found = spark.createDataFrame([("d", 1, "10", "Salário Base")], "doc_id string, page int, code string, label string")
    assert [r.code for r in coverage.missing_codes(codes, found, ["doc_id", "page"]).collect()] == ["91"]


def test_local_extraction(spark):
    text = "001 Salário Base | 220,00 | 3.000,00 | 091 Hora Extra | 50% | 0,00\nFGTS EMPRESA 240,00\nTOTAL PROVENTOS 3.000,00\nTOTAL DESCONTOS 0,00\nVALOR LÍQUIDO 3.000,00"
    segs = text_extract.segments(spark.createDataFrame([("d", 1, text)], readers.PAGE_TEXT))
    fields = text_extract.local_fields(segs).orderBy("seg").collect()
    assert [(r.reference, r.value) for r in fields] == [("220,00", "3.000,00"), ("50%", "0,00")]
    sums = text_extract.local_summaries(segs)
    assert text_extract.local_totals(sums).first().net_value == "3.000,00"
    assert [(r.label, r.category) for r in text_extract.local_bases(sums).collect()] == [("FGTS EMPRESA", "patronais_informativos")]


def test_block_validation(spark):
    raw_text = "1 Salário | 100,00\n2 INSS | 10,00\nTOT.RENDIMENTOS 100,00\nBASEDECALCULODOINSS 100,00"
    df = spark.createDataFrame([(raw_text, ["1"], False, False), (raw_text, ["1", "2"], True, True)], "t string, c array<string>, ht boolean, hb boolean")
    checks = coverage.validate_block(F.col("t"), F.col("c"), F.col("ht"), F.col("hb"))
    rows = df.select(checks["valid"].alias("valid"), checks["missing_codes"].alias("missing")).collect()
    assert [(r.valid, r.missing) for r in rows] == [(False, ["2"]), (True, [])]


def test_legitimate_and_duplicate_competencies(spark):
    same = heads(spark, [("d", 1, "10", "2017", "normal"), ("d", 2, "10", "2017", "plr"), ("e", 1, "10", "2017", "normal"), ("e", 2, "10", "2017", "normal")])
    status = {r.doc_id: r for r in audit.document_status(same).collect()}
    assert status["d"].status == "ok" and status["d"].duplicates == 0
    assert status["e"].status == "review_required" and status["e"].duplicates > 0
    kinds = {(r.doc_id, r.finding) for r in audit.findings(same).collect()}
    assert kinds == {("d", "legitimate_repeat"), ("e", "duplicate_competency"), ("e", "duplicate_event")}


def test_legacy_metrics(spark):
    cols = "doc_id string, deterministic_items long, local_items long, ai_recovered_items long, ai_items long, ai_validated_items long, visible_items long, expected_count long, extracted_count long, pending_items long, planned_batches long, planned_prompts long, executed_prompts long, strategy string"
    row = audit.normalize_metrics(spark.createDataFrame([("d", None, 20, None, None, None, None, 0, None, None, None, None, 0, None)], cols)).first()
    assert (row.visible_items, row.deterministic_items, row.pending_items, row.coverage) == (20, 20, 0, 1.0)


def test_registry_headers_and_wide(spark):
    items = spark.createDataFrame(
        [("d", "12/2024", "field", "field:code:10", 1, 1, "10", "Salário", "220", "1.000,00", 1), ("d", "12/2024", "field", "field:code:10", 1, 2, "10", "Salário", "10", "500,00", 2), ("d", "12/2024", "base", "base:valor_liquido", 1, 3, "", "Valor Líquido", "", "900,00", 1)],
        "doc_id string, competency string, kind string, canonical_key string, page_ord long, item_ord long, code string, label string, reference string, value string, occurrence long",
    )
    cells = [r.cell for r in export.headers(export.column_registry(items)).orderBy(F.desc("kind"), "occurrence", F.desc("property")).collect()]
    assert cells == ["Salário", "Salário — Referência", "Salário 2", "Salário 2 — Referência", "Valor Líquido"]
    columns = export.cell_columns(export.column_registry(items))
    assert [h for *_, h in columns] == cells
    records = spark.createDataFrame([("d", "12/2024"), ("d", "01/2025")], "doc_id string, competency string")
    rows = {r.competency: r for r in export.wide(records, export.tall_cells(items), columns, ["doc_id", "competency"]).collect()}
    row = rows["12/2024"]
    assert (row["field:code:10#1_value"], row["field:code:10#2_reference"], row["base:valor_liquido#1_value"]) == ("1.000,00", "10", "900,00")
    assert set(tuple(rows["01/2025"])[2:]) == {""} and "base:valor_liquido#1_reference" not in row
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="columns"):
            export.cell_columns(export.column_registry(items))
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_sequence_breaks_skip_unreadable(spark):
    df = heads(spark, [("d", 1, "11", "2023", None), ("d", 2, "0?", "2023", None), ("d", 3, "12", "2023", None), ("d", 4, "01", "2024", None), ("d", 5, "03", "2024", None)])
    got = export.sequence_breaks(df, ["page_ord"], segmented.page_segment(pages=2)).orderBy("page_ord").collect()
    assert [r.non_sequential for r in got] == [False, False, False, False, True]


@pytest.mark.parametrize("pages", [1, 3, 1000])
def test_segmented_numbering_equals_the_plain_window(spark, pages):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("page_ord"))
    got = segmented.numbered(df, ["k"], ["page_ord"], segmented.page_segment(pages=pages)).collect()
    assert all(r.rn == r.page_ord // 3 + 1 for r in got)


def test_accuracy(spark):
    schema = "doc_id string, item_ord long, code string, label string, value string, type string"
    truth = spark.createDataFrame([("d", 1, "511", "INSS Normal", "100,85", "desconto"), ("d", 2, None, "Vale Transporte", "5,00", None), ("d", 3, None, "Horas", "7,00", None)], schema).withColumn("source", F.lit("folha_normal"))
    found = spark.createDataFrame([("d", 1, "9", "VT", "5,00", None), ("d", 2, "511", "INSS", "100,85", None), ("d", 3, "", "Horas Extras", "8,00", None), ("d", 4, "", "Sobra", "1,00", None)], schema)
    m = benchmark.match_items(truth, found, ["doc_id"])
    assert [(r.found_ord, r.match_type, r.is_value_match) for r in m.orderBy("item_ord").collect()] == [(2, "by_code", True), (1, "by_label", True), (3, "by_substring", False)]
    assert [r.item_ord for r in benchmark.extra_items(found, m, ["doc_id"]).collect()] == [4]
    sums = benchmark.check_summaries(
        spark.createDataFrame([("d", 10.0, None)], "doc_id string, valor_fgts double, base_calculo_inss double"),
        spark.createDataFrame([("d", 1, "FGTS do Mês", "10,00"), ("d", 2, "FGTS do Mês", "11,00")], "doc_id string, item_ord long, label string, value string"),
        ["doc_id"],
    ).collect()
    assert [(r.label, r.extracted, r.matched) for r in sums] == [("Valor FGTS", 10.0, True)]


def test_sheet_prints_filled_cells_of_any_number_of_columns(spark):
    cols = "doc_id string, part int, page_ord long, kind string, canonical_key string, item_page long, item_ord long, code string, label string, reference string, value string, occurrence long"
    rows = [("d", 1, 1, "field", "field:code:10", 1, i, "10", "Salário", "" if i % 2 else f"r{i}", f"v{i}", i) for i in range(1, 41)]
    items = spark.createDataFrame([*rows, ("d", 1, 1, "field", "field:code:10", 1, 99, "10", "Salário", "", "late", 1), (None, 1, 1, "base", "base:x", 1, 1, "", "X", "", "lost", 1)], cols)
    heads = spark.createDataFrame([("d", 1, 1, "12", ""), ("d", 1, 2, "01", "nota"), (None, 1, 1, "02", "")], "doc_id string, part int, page_ord long, month string, observations string")
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        registry = export.column_registry(items.drop("page_ord").withColumnRenamed("item_page", "page_ord"))
        got = export.sheet(heads, items.withColumn("item_ord", F.struct("item_page", "item_ord")), registry, ["doc_id", "part", "page_ord"]).collect()
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    cells = {(r.doc_id, r.page_ord, r.cell): r.printed for r in got}
    want = {("d", 1, "month"): "12", ("d", 2, "month"): "01", ("d", 2, "observations"): "nota", (None, 1, "month"): "02"}
    want |= {("d", 1, f"field:code:10#{i}_value"): f"v{i}" for i in range(1, 41)} | {("d", 1, f"field:code:10#{i}_reference"): f"r{i}" for i in range(2, 41, 2)}
    assert cells == want and len(got) == len(want)
    assert {r.header for r in got if r.cell == "field:code:10#2_reference"} == {"Salário 2 — Referência"}


def test_text_rules_run_once_per_line_and_segment(spark):
    """No filter above the lines computes a pattern again that a column already holds; the rows are those of the rules."""
    text = "010 Salário Base  |  220,00 | 1.000,00\nTOTAL PROVENTOS 1.000,00\nsem código 12,00\n||\n | 12 Vale  |  x 3,00\n\nBase INSS 1,00"
    page = spark.createDataFrame([("d", 1, text), ("d", 2, None)], "doc_id string, page int, text string").localCheckpoint()
    segs = text_extract.segments(page)
    got = sorted((r.line, r.seg, r.segment, r.role) for r in segs.collect())
    assert got == [
        (1, 0, "010 Salário Base 220,00 1.000,00", "field"), (2, 0, "TOTAL PROVENTOS 1.000,00", "summary"),
        (3, 0, "sem código 12,00", "unresolved"), (5, 0, "12 Vale x 3,00", "field"),
        (7, 0, "Base INSS 1,00", "summary"),
    ]
    sums = text_extract.inventory_summaries(page)
    assert [r.line for r in sums.orderBy("line").collect()] == [2, 7]
    for df in (text_extract.unresolved_segments(segs), sums.where("label <> ''")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [x for x in plan.split("\n") if "Filter" in x]
        assert filters and not any("regexp_extract_all" in x or "regexp_replace" in x for x in filters)
