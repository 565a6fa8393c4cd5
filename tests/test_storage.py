"""Result stores, audited text files, and operators that pass all columns through."""

import json
import os
import pathlib
import random
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from paysheaf.operators import catalog, coverage, edits, reconcile, unify
from paysheaf.operators import unify
from paysheaf.plans import reuse, segmented
from paysheaf.sources import job_listing, json_text, readers, sinks


def test_replacing_one_job_keeps_all_others(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [(f"j{i}", f"page:{p}", kind, f"v{i}.{p}", i) for i in range(1200) for p in (1, 2) for kind in ("final", "checkpoint")]
    schema = "job_id string, result_key string, result_kind string, value string, seq int"
    sinks.write_results(spark.createDataFrame(rows, schema), path, buckets=1)
    new = [("j7", "page:9", "final", "novo", None), ("extra", "page:1", "final", "x", 1)]
    # another bucket count does not move what is stored
    sinks.write_results(spark.createDataFrame(new, schema), path, buckets=8)
    want = {r for r in rows if not (r[0] == "j7" and r[2] == "final")} | set(new)
    assert {tuple(r) for r in sinks.read_results(spark, path).select("job_id", "result_key", "result_kind", "value", "seq").collect()} == want
    sinks.write_results(spark.createDataFrame(new[1:], schema), path, buckets=8)
    assert sinks.read_results(spark, path).count() == len(want)


def test_audited_objects_on_any_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        'cabeçalho\n{"cabecalho": {"mes_ano": "JAN/2017", "observacao": "chave } e \\" aspas"},\n "itens": [\n {"codigo": "1",\n "descricao": "Salário", "valor": "1,00"}]}'
        '{"cabecalho": {"mes_ano": "FEV/2017"}, "itens": []}\n\n{"cabecalho": {"mes_ano": 3}, "itens": 5,,}\n{"cabecalho": {"mes_ano": "MAR/2017"'
    )
    (tmp_path / "b.txt").write_text('{"cabecalho": {"mes_ano": "ABR/2017"}}')
    good, bad = readers.audited_objects(spark, str(tmp_path))
    assert sorted(r["cabecalho"]["mes_ano"] for r in good.collect()) == ["ABR/2017", "FEV/2017", "JAN/2017"]
    assert [r["descricao"] if "descricao" in r else r["label"] for r in readers.audited_items(good).collect()] == ["Salário"]
    assert sorted(r["object_ord"] for r in bad.collect()) == [3, 4]
    assert readers.audited_blocks(spark, str(tmp_path)).count() == 3


ITEM = "doc_id string, item_ord long, code string, label string, reference string, value string, type string, evidence_type string, conflict boolean, confidence double, source_page int"


def test_lists_of_an_audited_month_are_read_at_once(spark, tmp_path):
    part = {"proventos": [{"codigo": " 7 ", "descricao": "Médias"}], "descontos": [None, {"codigo": "", "tipo": "x", "valor": "2,00"}]}
    months = [{"cabecalho": {"mes_ano": "jan-17"}, "itens": [{"codigo": "1"}, {"tipo": "Desconto"}], "decimo_terceiro_eventos_historico": part}]
    months += [{"cabecalho": {"mes_ano": "fev-17"}, "folha_normal": {"itens": [{"codigo": "2"}]}}, {"cabecalho": {"mes_ano": "mar-17"}}]
    (tmp_path / "a.txt").write_text("\n".join(map(json.dumps, months)), encoding="utf-8")
    items = readers.audited_items(readers.audited_blocks(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in items.select("competency", "item_ord", F.coalesce("code", F.lit("-")), "type", "source").collect()) == [
        ("01/2017", 0, "1", "provento", "folha_normal"), ("01/2017", 1, "-", "desconto", "folha_normal"), ("01/2017", 1000000, "7", "provento", "decimo_terceiro"),
        ("01/2017", 2000000, "-", "desconto", "decimo_terceiro"), ("01/2017", 2000001, "-", "desconto", "decimo_terceiro"), ("02/2017", 0, "2", "provento", "folha_normal"),
    ]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    # the pieces of the files stand in the plan for each item's text and for the count of objects, not for each list again
    assert "Union" not in plan and plan.count("Relation") == 2


def test_reconcile_keeps_columns_and_conflicts(spark):
    first = spark.createDataFrame([("d", 1, "10", "Salário", "", "", "provento", "local", True, 0.5, 3), ("d", 2, "20", "INSS", "", "5,00", "desconto", "local", None, 0.9, 4)], ITEM)
    second = spark.createDataFrame([("d", 1, "10", "Salário", "", "7,00", "provento", "ai", None, 0.8, 5), ("d", 2, "20", "INSS", "", "6,00", "desconto", "ai", None, 0.7, 6), ("d", 3, "30", "Vale", "", "1,00", "desconto", "ai", True, 0.1, 7)], ITEM)
    got = {(r["code"], r["occurrence"]): r for r in reconcile.reconcile(first, second, ["doc_id"]).collect()}
    assert got["10", 1]["value"] == "7,00" and got["10", 1]["conflict"] and got["10", 1]["confidence"] == 0.8 and got["10", 1]["source_page"] == 5
    assert not got["20", 1]["conflict"] and got["20", 1]["source_page"] == 4
    assert got["20", 2]["conflict"] and got["20", 2]["primary_value"] == "5,00"
    assert got["30", 1]["conflict"] and got["30", 1]["primary_value"] is None


def test_cell_edits_keep_other_columns(spark):
    items = spark.createDataFrame([("d", "field", "field:code:1", 1, "Salário", "1", "1,00", "", 4, 0.5)], "doc_id string, kind string, canonical_key string, occurrence int, label string, code string, value string, reference string, source_page int, confidence double")
    change = spark.createDataFrame([("d", "field", "field:code:1", 1, "Salário", "1", "2,00")], "doc_id string, kind string, canonical_key string, occurrence int, header string, code string, new_value string")
    (row,) = edits.apply_cell_edits(items, change, ["doc_id"]).collect()
    assert (row["value"], row["source_page"], row["confidence"]) == ("2,00", 4, 0.5)


def test_a_record_with_only_totals_is_valid(spark):
    keys = ["doc_id"]
    empty = spark.createDataFrame([], "doc_id string, code string, label string, kind string, occurrence int")
    records = spark.createDataFrame([("a", 10), ("b", 10)], "doc_id string, text_length int")
    totals = spark.createDataFrame([("a", "1,00", None, None), ("b", "", None, "")], "doc_id string, total_additions string, total_deductions string, net_value string")
    got = {r["doc_id"]: (r["valid"], r["coverage"]) for r in coverage.coverage(empty, empty, empty, empty, empty, records, keys, totals).collect()}
    assert got == {"a": (True, 1.0), "b": (False, 0.0)}
    assert {r["doc_id"]: r["valid"] for r in coverage.coverage(empty, empty, empty, empty, empty, records, keys).collect()} == {"a": False, "b": False}


def test_raw_pages_keep_headers_and_print_numbers(spark):
    raw = '''{"pages": [{"pageNumber": 2, "blockIndex": 1, "month": "01", "year": "2020", "company": {"name": "ACME", "cnpj": "12"}, "employee": {"name": "Ana", "cpf": "9", "role": "chefe"},
      "bankInfo": {"bank": "B", "agency": "1", "account": "2"}, "extraction": {"valid": false, "warnings": ["fraco"]},
      "items": [{"code": "1", "label": "a", "value": 1234.5}, {"code": "2", "label": "b", "value": " 7,00 "}, {"code": "3", "label": "c", "value": 0, "amount": 10}, {"code": "4", "label": "d", "value": "1234.5"}]}]}'''
    pages = readers.raw_pages(spark.createDataFrame([("d", raw)], "doc_id string, raw_json string"))
    (head,) = pages.collect()
    assert (head["company"], head["cnpj"], head["cpf"], head["role"], head["bank"], head["block_index"], head["warnings"], head["extraction_valid"]) == ("ACME", "12", "9", "chefe", "B", 1, ["fraco"], False)
    values = {r["code"]: r["value"] for r in readers.raw_page_items(pages).collect()}
    assert values == {"1": "1.234,50", "2": "7,00", "3": "10,00", "4": "1234.5"}


def test_headers_come_whole_from_the_first_page_that_has_one(spark):
    schema = "doc_id string, page_ord long, month string, year string, record_key string, review_required boolean, company string, cnpj string, employee string, cpf string, bank string, agency string, payment_date string, warnings array<string>"
    rows = [
        ("d", 1, "01", "2020", "a", False, None, None, "Ana", None, None, None, None, ["um"]),
        ("d", 2, "01", "2020", "b", True, "ACME", None, "Bia", "9", "B", None, None, None),
        ("d", 3, "01", "2020", "c", False, "Outra", "12", None, None, None, "1", "05/02", None),
    ]
    (head,) = unify.unify_headers(spark.createDataFrame(rows, schema)).collect()
    got = tuple(head[c] for c in ("company", "cnpj", "employee", "cpf", "bank", "agency", "payment_date", "warnings", "review_required"))
    assert got == ("ACME", None, "Ana", None, "B", None, "05/02", ["um"], True)


def objects_in(text):
    """Outermost objects by walking over the text; quotes count everywhere."""
    out, depth, inside, start, i = [], 0, False, None, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
                start = None
        i += 1
    return out + ([text[start:]] if start is not None else [])


def test_json_objects_over_many_ranges(spark, tmp_path):
    """Ranges of a few bytes: objects, strings and escapes lie across them."""
    rng = random.Random(3)
    texts = {}
    for n in range(12):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            word = "".join(rng.choice('ab{}é\\"\n') for _ in range(rng.randrange(12)))
            nested = {"a": word, "b": [{"c": word[::-1]}] * rng.randrange(3)}
            parts.append(json.dumps(nested, ensure_ascii=False, indent=rng.choice([None, 1])) + rng.choice(["", "\n", " x } y\n", ", "]))
        texts[f"t{n}.txt"] = rng.choice(["", "título\n"]) + "".join(parts) + rng.choice(["", '{"aberto": [1, {"x', "fim"])
    texts["vazio.txt"] = ""
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = json_text.objects(spark, str(tmp_path / "in"))
        assert json_text._pieces(spark, str(tmp_path / "in")).select("path", "range_start").distinct().count() > 40
        got = sorted((r["path"].rsplit("/", 1)[1], r["object_ord"], r["raw"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((name, i + 1, o) for name, text in texts.items() for i, o in enumerate(objects_in(text)))


def test_label_dictionary_classifies_new_labels_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["FGTS Empresa", "Salário Base", "zzz", None][i % 4]) for i in range(40)], "n int, label string")
    words = catalog.LabelDictionary(spark, str(tmp_path / "labels"))
    got = catalog.with_category(rows, dictionary=words)
    # no row is moved: the dictionary is sent to them
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
    want = {(i, None if c is None else c["category"]) for i, c in (
        (r["n"], r["c"]) for r in rows.select("n", catalog.classify(F.col("label")).alias("c")).collect())}
    assert {(r["n"], r["category"]) for r in got.collect()} == want
    ids = {r["label"]: r["label_id"] for r in words.read().collect()}
    assert set(ids) == {"FGTS Empresa", "Salário Base", "zzz"}
    more = rows.unionByName(spark.createDataFrame([(99, "INSS")], "n int, label string"))
    salted = catalog.with_category(more, dictionary=words, sent_labels=1)
    assert {(r["n"], r["category"]) for r in salted.where("n < 99").collect()} == want and salted.count() == 41
    after = {r["label"]: r["label_id"] for r in words.read().collect()}
    assert after.items() > ids.items() and len(set(after.values())) == 4
    # the second run added one label, in a run of its own
    assert spark.read.parquet(str(tmp_path / "labels" / words.table.manifest().runs[-1].folder)).count() == 1


def test_hot_label_is_dealt_to_many_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "INSS").otherwise(F.concat(F.lit("rubrica "), F.col("id") % 50)).alias("label"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = catalog.with_category(rows, sent_labels=1)
        tasks = found.where("label = 'INSS'").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and sum(r["count"] for r in tasks) == 6667
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_last_page_reads_one_range(spark, tmp_path):
    jobs = spark.range(100_003).select(F.concat(F.lit("j"), "id").alias("job_id"), F.timestamp_seconds(F.col("id") % 5000).alias("updated_at"))
    jobs = jobs.unionByName(spark.createDataFrame([("nunca", None)], "job_id string, updated_at timestamp"))
    listing = job_listing.JobListing(spark, str(tmp_path / "l"), rows_per_range=5000)
    listing.write(jobs)
    whole = [r["job_id"] for r in jobs.orderBy(F.desc("updated_at"), "job_id").collect()]
    n_files = len(listing._jobs().inputFiles())
    for page in (1, 2, 777, 5001, 10_001, 99_999):
        got = listing.page(page)
        first = (min(page, 10_001) - 1) * 10
        assert [r["job_id"] for r in got.collect()] == whole[first : first + 10]
    assert n_files >= 20 and "PartitionFilters: [isnotnull(range" in got._jdf.queryExecution().toString()
    place = 7215
    head = jobs.where(F.col("job_id") == whole[place]).select(F.col("updated_at").cast("string")).first()[0]
    assert [r["job_id"] for r in listing.after(head, whole[place]).collect()] == whole[place + 1 : place + 11]
    assert job_listing.JobListing(spark, str(tmp_path / "e")).write(jobs.limit(0)) is None
    assert job_listing.JobListing(spark, str(tmp_path / "e")).page(3).collect() == []


def test_scopes_keep_what_another_still_uses(spark):
    frame = lambda: spark.range(100).select((F.col("id") * 3).alias("x"))
    with reuse.scope() as first:
        reuse.shared(frame())
    with reuse.scope() as second:
        reuse.shared(frame())
        reuse.shared(frame())
    first.close()
    assert frame().storageLevel.useMemory
    second.close()
    assert not frame().storageLevel.useMemory


def test_entry_without_the_training_data_folder(tmp_path):
    """With the folder of that subpackage gone, the entry imports and has the other queries."""
    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == ["False", "False"] and int(out.stdout.split()[0]) > 100


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_frames_are_computed_once_without_a_scope(spark):
    made = spark.range(7).withColumn("twice", F.col("id") * 2)
    token = reuse._active.set(None)
    try:
        kept = reuse.shared(made)
    finally:
        reuse._active.reset(token)
    assert "Range" not in _plan(kept) and sorted(map(tuple, kept.collect())) == [(i, 2 * i) for i in range(7)]


def test_unified_items_are_made_once_for_fields_and_bases(spark):
    columns = "doc_id string, page_ord long, item_ord long, kind string, canonical_key string, code string, label string, reference string, value string, type string, evidence_type string, confidence double"
    rows = [("a", 1, 1, "field", "field:code:1", "1", "Base", "", "1,00", "provento", "ai", 0.5), ("a", 2, 1, "base", "base:x", "", "X", "", "2,00", "", "ai", 0.5)]
    items = spark.createDataFrame(rows, columns).withColumn("item_ord", F.col("item_ord") + F.length("doc_id"))
    records = spark.createDataFrame([("a", 1, "01", "2020"), ("a", 2, "01", "2020")], "doc_id string, page_ord long, month string, year string")
    token = reuse._active.set(None)
    try:
        merged = unify.unified_items(items, records)
    finally:
        reuse._active.reset(token)
    # what is left to compute reads stored rows only
    assert "LogicalRDD" not in _plan(merged) and "LocalRelation" not in _plan(merged)
    assert sorted((r["kind"], r["value"], r["occurrence"]) for r in merged.collect()) == [("base", "2,00", 1), ("field", "1,00", 1)]


def test_numbering_scans_the_rows_once(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 1), (None, 2, 2), ("a", 1, 1), ("a", 2, 1)], "k string, seg int, ord int")
    out = segmented.numbered(rows, ["k"], ["seg", "ord"], F.col("seg"))
    assert _plan(out).count("row_number()") == 1
    assert sorted((r["k"] or "", r["seg"], r["ord"], r["rn"]) for r in out.collect()) == [("", 1, 1, 1), ("", 2, 1, 2), ("", 2, 2, 3), ("a", 1, 1, 1), ("a", 2, 1, 2)]
