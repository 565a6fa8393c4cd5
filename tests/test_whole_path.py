"""From raw extraction texts to nested records with their audit, and operators on crowded pages."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from paysheaf.operators import audit, coverage, export, layout, normalize, unify
from paysheaf.sources import readers

PAGE = ["doc_id", "page_ord"]


def test_raw_texts_to_nested_records(spark):
    pages = [
        {"pageNumber": 1, "month": "04", "year": "2017", "recordKey": "a", "company": {"name": "ACME"},
         "items": [{"code": "1", "label": "Salário Base", "reference": "220,00", "value": "3.000,00"}, {"label": "Base INSS", "value": "3.000,00", "isBase": True}],
         "bases": [{"label": "Base INSS", "value": "3.000,00"}, {"label": "Base FGTS", "value": "2.900,00"}, {"label": "Base FGTS", "value": "2.900,00"}],
         "totals": {"totalAdditions": "3.000,00", "totalDeductions": "330,00", "netValue": ""}},
        {"pageNumber": 2, "month": "04", "year": "2017", "recordKey": "b", "items": [{"code": "1", "label": "Salário Base", "reference": "220,00", "value": "500,00"}]},
        {"pageNumber": 3, "month": "MM", "year": "2017", "recordKey": "c", "items": []},
        {"pageNumber": 4, "month": "05", "year": "2017", "recordKey": "d"},
    ]
    raw = spark.createDataFrame([("d", json.dumps({"pages": pages}))], "doc_id string, raw_json string")
    read = readers.raw_pages(raw)
    records = read.withColumns({"is_inferred": F.lit(False)})
    found = normalize.canonical_items(readers.raw_page_items(read))
    stated = normalize.canonical_items(readers.raw_page_items(read, "bases"))
    fields, own = found.where("kind = 'field'"), found.where("kind = 'base'")
    bases = normalize.merge_stated_bases(own, stated, PAGE)
    assert sorted((r["label"], r["src_rank"]) for r in bases.collect()) == [("Base FGTS", 1), ("Base INSS", 0)]
    totals = normalize.totals_as_bases(readers.raw_page_totals(read), bases, PAGE)
    items = fields.unionByName(bases.drop("src_rank"), allowMissingColumns=True).unionByName(totals, allowMissingColumns=True)
    items = items.withColumn("item_ord", F.coalesce("item_ord", F.lit(1000).cast("bigint")))
    p = unify.with_competency(records)
    head = unify.unify_headers(p).select("doc_id", "competency", "page_ord", "record_key", "payroll_type", "review_required", "company")
    unknown = p.where("competency is null").select(*head.columns)
    nested = export.nested_result(unknown.unionByName(head), unify.unified_items(items, records), audit.document_status(records), ["doc_id", "competency"])
    got = {r["competency"]: r for r in nested.collect()}
    assert set(got) == {None, "04/2017", "05/2017"}
    april = got["04/2017"]
    assert [(i["canonical_key"], i["occurrence"], i["value"]) for i in april["fields"]] == [("field:code:1", 1, "3.000,00"), ("field:code:1", 2, "500,00")]
    labels = [i["label"] for i in april["bases"]]
    assert sorted(i["value"] for i in april["bases"]) == ["2.900,00", "3.000,00", "3.000,00", "330,00"] and labels.count("Base INSS") == 1
    assert april["page"]["company"] == "ACME" and got["05/2017"]["fields"] == [] and got[None]["bases"] == []
    # the month without evidence makes the document one to review
    assert {r["audit"]["missing_evidence"] for r in got.values()} == {1} and got[None]["audit"]["status"] == "review_required"


def first_fit(heights, tolerance=3.0):
    lines, out = [], {}
    for y in heights:
        hit = next((l for l in lines if abs(l - y) <= tolerance), None)
        if hit is None:
            lines.append(y)
            hit = y
        out[y] = hit
    return out


@pytest.mark.parametrize("seed, n, top", [(1, 60, 90), (2, 200, 200), (3, 150, 2000)])
def test_lines_by_sweep_equal_first_fit(spark, seed, n, top):
    rng = random.Random(seed)
    rows, want = [], {}
    for page in range(5):
        ys = [rng.randrange(top * 4) / 4 for _ in range(n)]
        rows += [("d", page, i, f"t{i}", 1.0 * i, y, 5.0) for i, y in enumerate(ys)]
        want |= {(page, y): line for y, line in first_fit(ys).items()}
    rng.shuffle(rows)
    tokens = spark.createDataFrame(rows, "doc_id string, page int, item_ord bigint, str string, x double, y double, width double").repartition(3)
    got = layout.cluster_lines(tokens).collect()
    assert len(got) == len(rows) and all(want[r["page"], r["y"]] == r["line_y"] for r in got)


def test_a_page_of_20000_heights(spark):
    rng = random.Random(4)
    ys = [rng.random() * 90_000 for _ in range(20_000)]
    rows = [("d", 1, i, "x", 1.0, y, 5.0) for i, y in enumerate(ys)]
    tokens = spark.createDataFrame(rows, "doc_id string, page int, item_ord bigint, str string, x double, y double, width double")
    start = time.time()
    got = {r["y"]: r["line_y"] for r in layout.cluster_lines(tokens).collect()}
    assert time.time() - start < 30 and got == first_fit(ys)


def test_missing_summaries_against_all_comparisons(spark):
    rng = random.Random(6)
    parts = ["base", "inss", "fgts", "irrf", "total", "a", "de", "liquido", "13"]
    label = lambda: " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    wanted = [(f"d{i % 9}", 1, n, label()) for i in range(60) for n in range(4)]
    have = sorted({(f"d{i % 9}", 1, label()) for i in range(25)} | {("d1", 1, "de"), ("d2", 1, "a")})
    expected = spark.createDataFrame(wanted, "doc_id string, page int, line int, label string")
    got = coverage.missing_summaries(expected, spark.createDataFrame(have, "doc_id string, page int, have string"), ["doc_id", "page"])
    missing = [w for w in wanted if not any(h[0] == w[0] and (h[2] in w[3] or w[3] in h[2]) for h in have)]
    assert sorted(map(tuple, got.collect())) == sorted(missing) and missing


def test_a_month_of_5000_labels(spark):
    expected = spark.range(5000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("line"), F.concat(F.lit("rubrica "), F.sha2(F.col("id").cast("string"), 256)).alias("label"))
    have = expected.where("line % 2 = 0").select("doc_id", F.substring("label", 9, 40).alias("have"))
    start = time.time()
    assert coverage.missing_summaries(expected, have, ["doc_id"]).count() == 2500
    assert time.time() - start < 30


def test_only_records_with_many_labels_meet_through_the_index(spark, monkeypatch):
    """Small records compare their labels as one list; nulls in the keys find nothing, as in a join."""
    indexed = []
    whole = coverage._missing_of_many

    def counted(open_labels, have, keys):
        indexed.append({r["doc_id"] for r in have.select("doc_id").distinct().collect()})
        return whole(open_labels, have, keys)

    monkeypatch.setattr(coverage, "_missing_of_many", counted)
    expected = spark.createDataFrame(
        [("a", "Base INSS"), ("a", "Total"), ("b", "Base INSS"), ("b", "Liquido"), (None, "Total"), ("c", "Total")], "doc_id string, label string"
    )
    have = [("a", "base inss do mes"), ("b", "base"), (None, "total")] + [("b", f"verba {i}") for i in range(100)]
    lost = coverage.missing_summaries(expected, spark.createDataFrame(have, "doc_id string, have string"), ["doc_id"])
    assert sorted((r["doc_id"] or "", r["label"]) for r in lost.collect()) == [("", "Total"), ("a", "Total"), ("b", "Liquido"), ("c", "Total")]
    assert indexed == [{"b"}]
