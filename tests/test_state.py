from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paysheaf.operators import state
from paysheaf.plans import registry
from paysheaf.sources import job_store, readers, runs, sinks
from paysheaf.streaming import unit_results

RES = "job_id string, result_key string, page_number long, result_kind string, value string, executed int, completed_at timestamp, seq long"


def results(spark):
    at = "2024-01-01 00:00:0"
    rows = [("j", f"page:1:block:{b}", 1, "checkpoint", f"v{b}", 1, f"{at}{b}", b) for b in range(6)] + [("j", "page:1:block:0", 1, "checkpoint", "new", 0, f"{at}9", 9)]
    return spark.createDataFrame(rows, RES.replace("completed_at timestamp", "completed_at string")).withColumn("completed_at", F.col("completed_at").cast("timestamp"))


def test_upsert_and_gate(spark):
    got = {r.result_key: r for r in state.latest_results(results(spark)).collect()}
    assert len(got) == 6 and got["page:1:block:0"].value == "new" and got["page:1:block:0"].attempts == 2
    assert state.verified(state.latest_results(results(spark))).count() == 5
    with pytest.raises(ValueError, match="REQUIRED_EXECUTION_MISSING: 1"):
        state.assert_verified(state.latest_results(results(spark)))


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    df, source, table, checkpoint = results(spark), str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    cols = ["result_key", "value", "attempts"]

    def run(to=table):
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        unit_results.run_to_table(unit_results.unit_rows(live), to, checkpoint, unit_results.fold_units, state.UNIT, buckets=3)
        return sorted(map(tuple, unit_results.read_table(spark, to, unit_results.fold_units, state.UNIT).select(*cols).collect()))

    def batch(rows):
        return sorted(map(tuple, state.latest_results(rows).select(*cols).collect()))

    for i in range(2):
        df.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    assert run() == batch(df.where(F.col("seq") % 3 < 2))
    stored = runs.RunTable(spark, table, unit_results.fold_units, state.UNIT)
    before = stored.manifest()
    df.where(F.col("seq") % 3 == 2).coalesce(1).write.mode("append").parquet(source)
    # the second run reads only the new file: one more run
    assert run() == batch(df) and run() == batch(df)
    assert set(before.runs) < set(stored.manifest().runs) and len(stored.manifest().runs) == len(before.runs) + 1
    assert stored.manifest().buckets == 3
    unit_results.compact(spark, table, unit_results.fold_units, state.UNIT)
    assert len(stored.manifest().runs) == 1 and run() == batch(df)


def test_replayed_batch_counts_once(spark, tmp_path):
    df, source, table = results(spark), str(tmp_path / "in"), str(tmp_path / "table")
    df.coalesce(1).write.parquet(source)
    for checkpoint in ("a", "b"):  # a lost checkpoint runs batch 0 again
        live = unit_results.unit_rows(spark.readStream.schema(df.schema).parquet(source))
        unit_results.run_to_table(live, table, str(tmp_path / checkpoint), unit_results.fold_units, state.UNIT)
    assert sorted(r["attempts"] for r in unit_results.read_table(spark, table, unit_results.fold_units, state.UNIT).collect()) == [1, 1, 1, 1, 1, 2]


def test_progress_stream_keeps_filled_messages(spark, tmp_path):
    schema = "job_id string, seq bigint, current int, total int, percentage int, message string, log string"
    rows = [("j", 1, 1, 9, None, "um", "a"), ("j", 2, None, None, 50, "", "b"), ("j", 3, 2, None, None, None, ""), ("k", 4, None, None, None, "x", None)]
    df = spark.createDataFrame(rows, schema)
    for i in range(4):
        df.where(F.col("seq") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    unit_results.run_to_table(unit_results.progress_rows(live), str(tmp_path / "t"), str(tmp_path / "c"), unit_results.fold_progress, ["job_id"])
    got = {r["job_id"]: tuple(r)[1:] for r in unit_results.progress_table(unit_results.read_table(spark, str(tmp_path / "t"), unit_results.fold_progress, ["job_id"])).collect()}
    assert got == {"j": (2, 9, 50, "um", ["a", "b"], 2), "k": (None, None, None, "x", [], 0)}
    want = {r["job_id"]: (r["current"], r["total"], r["percentage"], r["message"], r["log_lines"]) for r in state.job_progress(df).collect()}
    assert want == {k: (*v[:4], v[5]) for k, v in got.items()}


def test_pending_units(spark):
    units = spark.createDataFrame([("j", "page:1", 1), ("j", "page:2:region:0", 2), ("j", "page:3", 3)], "job_id string, result_key string, page_number long")
    done = spark.createDataFrame([("j", "page:1"), ("j", "page:2")], "job_id string, result_key string")
    assert [r.result_key for r in state.pending_units(units, done).collect()] == ["page:3"]


def test_job_status(spark):
    events = spark.createDataFrame([("a", 1, "fail", "boom"), ("a", 2, "retry", None), ("a", 3, "retry", None), ("a", 4, "complete", None), ("b", 1, "fail", "")], "job_id string, seq long, event string, error string")
    got = {r.job_id: (r.status, r.retry_count, r.last_error) for r in state.job_status(events).collect()}
    assert got == {"a": ("concluido", 1, None), "b": ("erro", 0, "Erro interno no processamento do documento")}


def test_documents_and_sinks(spark, tmp_path):
    for name in ("holerite-1.PDF", "sub/Outro.pdf", "sub/holerite-2.pdf", "note.txt"):
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%PDF-1")
    got = {(r.name, r.category) for r in readers.list_documents(spark, str(tmp_path / "docs")).collect()}
    assert got == {("holerite-1.PDF", "payroll"), ("Outro.pdf", "other"), ("holerite-2.pdf", "payroll")}
    df = spark.createDataFrame([('say "hi"', None)], "`Pág.` string, b string")
    sinks.export(df, str(tmp_path / "csv"), "csv")
    lines = {line for part in (tmp_path / "csv").glob("*.csv") for line in part.read_text().splitlines()}
    assert lines == {'"Pág.","b"', '"say ""hi""",""'}
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "docx")


def test_replaced_partitions_only(spark, tmp_path):
    path = str(tmp_path / "results")
    base = results(spark).drop("executed", "seq")
    sinks.write_results(base.withColumn("job_id", F.lit("a")), path)
    sinks.write_results(base.withColumn("job_id", F.lit("b")).withColumn("result_kind", F.lit("final")), path)
    assert {r.job_id for r in sinks.read_results(spark, path).select("job_id").distinct().collect()} == {"a", "b"}


def test_audited_months(spark, tmp_path):
    f = tmp_path / "gt.json"
    f.write_text(
        '{"cabecalho":{"mes_ano":"abr-17"},"itens":[{"codigo":"511","descricao":"INSS Normal","tipo":"Desconto","valor":"100,85"}],"totais":{"salario_liquido":"1.392,55"}}\n'
        '{"cabecalho":{"mes_ano":"dez-17"},"folha_normal":{"itens":[{"codigo":"1","descricao":"A","valor":"1,00"}],"bases":{"valor_fgts":"2,00"}},"decimo_terceiro_eventos_historico":{"descontos":[{"codigo":"9","descricao":"B","valor":"3,00"}]}}\nbroken{\n'
    )
    blocks = readers.audited_blocks(spark, str(f))
    items = {(r.competency, r.code, r.type, r.source) for r in readers.audited_items(blocks).collect()}
    assert items == {("04/2017", "511", "desconto", "folha_normal"), ("12/2017", "1", "provento", "folha_normal"), ("12/2017", "9", "desconto", "decimo_terceiro")}
    sums = {r.competency: (r.salario_liquido, r.valor_fgts) for r in readers.audited_summaries(blocks).collect()}
    assert sums == {"04/2017": (1392.55, None), "12/2017": (None, 2.0)}


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 90


def run_files(path):
    return {str(f): f.stat().st_size for f in path.glob("run-*/**/*.parquet")}


def test_small_batch_writes_little_with_many_tasks(spark, tmp_path):
    """1 % of the keys write about 1 % of the bytes; a large batch is written by more than 16 tasks."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("job"), F.col("id") % 5000).alias("job_id"), F.concat(F.lit("page:"), "id").alias("result_key"), (F.col("id") % 7).alias("page_number"),
        F.lit("checkpoint").alias("result_kind"), F.sha2(F.col("id").cast("string"), 256).alias("value"), F.lit(1).alias("executed"),
        F.timestamp_seconds(F.col("id")).alias("completed_at"), F.col("id").alias("seq"),
    )
    table = runs.RunTable(spark, str(tmp_path / "t"), unit_results.fold_units, state.UNIT)
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        table.add(unit_results.unit_rows(rows), 0)
        first = run_files(tmp_path / "t")
        table.add(unit_results.unit_rows(rows.where("seq % 100 = 3").withColumn("value", F.lit("novo"))), 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    fresh = {f: n for f, n in run_files(tmp_path / "t").items() if f not in first}
    assert len(first) > 16 and sum(fresh.values()) < 0.015 * sum(first.values())
    now = table.read()
    assert now.count() == 200_000 and now.where("value = 'novo' and attempts = 2").count() == 2000


def test_levels_fold_and_killed_writers_leave_the_old_state(spark, tmp_path, monkeypatch):
    df = unit_results.unit_rows(results(spark))
    table = runs.RunTable(spark, str(tmp_path / "t"), unit_results.fold_units, state.UNIT, fanout=3)
    for batch in range(7):
        table.add(df, batch)
    # three of the first level made one of the next, twice; one batch is on its own
    assert sorted(r.level for r in table.manifest().runs) == [0, 1, 1]
    old = sorted(map(str, table.read().collect()))
    assert sorted(r["attempts"] for r in table.read().collect()) == [7, 7, 7, 7, 7, 14]

    def killed(self, new):
        (tmp_path / "t" / "manifest" / f"version={new.version + 1}" / "_temporary").mkdir(parents=True)
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(runs.RunTable, "_commit", killed)
        with pytest.raises(RuntimeError):
            table.add(df, 7)
    assert sorted(map(str, table.read().collect())) == old
    table.add(df, 7)
    table.add(df, 7)
    assert sorted(r["attempts"] for r in table.read().collect()) == [8, 8, 8, 8, 8, 16]
    table.compact()
    table.vacuum()
    assert len(list((tmp_path / "t").glob("run-*"))) == 1 and len(list((tmp_path / "t" / "manifest").iterdir())) == 1
    assert sorted(r["attempts"] for r in table.read().collect()) == [8, 8, 8, 8, 8, 16]


def test_killed_replacement_keeps_the_results(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    base = results(spark).drop("executed", "seq")
    sinks.write_results(base, path)
    old = sorted(map(str, sinks.read_results(spark, path).collect()))
    with monkeypatch.context() as broken:
        broken.setattr(runs.RunTable, "_commit", lambda self, new: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.write_results(base.limit(1).withColumn("value", F.lit("x")), path)
    assert sorted(map(str, sinks.read_results(spark, path).collect())) == old
    sinks.write_results(base.limit(1).withColumn("value", F.lit("x")), path)
    assert [r["value"] for r in sinks.read_results(spark, path).collect()] == ["x"]


def test_sweep_touches_only_expired_days(spark, tmp_path):
    jobs = spark.sql("select concat('j', id) job_id, timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(id as int)) expires_at from range(6)")
    jobs = jobs.unionByName(spark.sql("select 'stays' job_id, cast(null as timestamp) expires_at"))
    rows = jobs.crossJoin(spark.range(3)).select("job_id", F.concat(F.lit("page:"), "id").alias("result_key"), F.lit("v").alias("value"))
    store = job_store.JobStore(spark, str(tmp_path / "s"))
    store.add(jobs, rows)
    store.add(jobs.where("job_id = 'j5'"), rows.where("job_id = 'j5'").withColumn("value", F.lit("novo")))
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s").glob("**/*.parquet")}
    now = datetime(2024, 1, 3, 13)
    gone = store.sweep(now)
    assert {g.split("part=")[1] for g in gone} == {"2024-01-01", "2024-01-02"}
    assert files == {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s").glob("**/*.parquet")}
    left, dependants = store.read(F.lit(now))
    # of the running day the hour decides
    assert {r["job_id"] for r in left.collect()} == {"j3", "j4", "j5", "stays"}
    got = sorted((r["job_id"], r["value"]) for r in dependants.collect())
    assert got == sorted([(j, "v") for j in ("j3", "j4", "stays")] * 3 + [("j5", "novo")] * 3)
    store.jobs_table.vacuum()
    store.rows_table.vacuum()
    after = {str(f) for f in (tmp_path / "s").glob("**/*.parquet")}
    assert {f for f in files if f not in after} == {f for f in files if "part=2024-01-01" in f or "part=2024-01-02" in f}
    assert sorted((r["job_id"], r["value"]) for r in store.read(F.lit(now))[1].collect()) == got
