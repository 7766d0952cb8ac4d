"""Files in and out: listings, events, schema files, exports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.operators import joins
from foliant.sinks import writers as W
from foliant.sinks.versioned import LeveledLog, VersionedTable
from foliant.sources import documents as D
from foliant.sources import schemas as S


def test_scan_documents_ignores_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.pdf", "B.PDF", "c.txt", "sub/d.Pdf", "document"):
        (tmp_path / n).write_bytes(b"x" * 3)
    rows = D.scan_documents(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["B.PDF", "a.pdf", "d.Pdf"] and rows[0]["length"] == 3
    assert "content" not in D.scan_documents(spark, str(tmp_path)).columns


def test_scan_events(spark):
    def body(kind, url):
        return json.dumps({"eventType": kind, "data": {"url": url}})

    rows = [(body(D.CREATED, "https://s/container/test.pdf"),), (body(D.CREATED, "https://s/container/test.txt"),),
            (body("Microsoft.Storage.BlobDeleted", "https://s/c/x.pdf"),), ("not json",)]
    assert [r["name"] for r in D.scan_events(spark.createDataFrame(rows, "body string")).collect()] == ["test.pdf"]


def test_schema_files_and_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"template_type": "memo", "fields": [{"name": "subject", "field_type": "text"}],
                                                 "tables": [{"name": "t", "columns": [{"name": "c", "field_type": "text"}]}]}, indent=2))
    (tmp_path / "bad.json").write_text("{oops")
    schemas = S.load_schemas(spark, str(tmp_path))
    assert list(schemas) == ["memo"]
    memo = schemas["memo"]
    assert memo.required_confidence == 0.8 and memo.fields[0].threshold == 0.7 and not memo.fields[0].required
    assert memo.tables[0].max_rows == 1000 and memo.tables[0].header_required
    row = S.schema_table_rows(S.scan_schemas(spark, str(tmp_path))).first()
    assert row["min_rows"] == 0 and row["max_rows"] == 1000


def test_schema_lookup_fallbacks(spark):
    req = spark.createDataFrame([("invoice",), ("receipt",), ("memo",)], "document_type string")
    known = joins.schema_fields(spark, {"invoice": config.INVOICE})
    got = {r["document_type"]: r["field_names"] for r in S.schema_lookup(req, known).collect()}
    assert got["invoice"][0] == "invoice_number" and got["receipt"] == ["MerchantName", "Total", "TransactionDate"] and got["memo"] == ["content"]


KIND = "document_id string, start_time timestamp, created_at timestamp, v int"


def metric_rows(spark, *rows):
    return spark.createDataFrame([(i, dt.datetime.fromisoformat(day), dt.datetime.fromisoformat(day), v) for i, day, v in rows], KIND)


def test_upsert_last_write_wins_on_disk(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "cur"), by="dt")
    W.upsert_document_metrics(metric_rows(spark, ("a", "2024-01-01", 1), ("b", "2024-01-01", 2), ("z", "2024-03-05", 7)), table)
    new = metric_rows(spark, ("b", "2024-01-01", 9), ("c", "2024-01-01", 3))
    for _ in range(2):  # a batch that comes twice changes nothing
        W.upsert_document_metrics(new, table)
        assert {r["document_id"]: r["v"] for r in table.read().collect()} == {"a": 1, "b": 9, "c": 3, "z": 7}
    W.upsert_document_metrics(metric_rows(spark, ("b", "2024-02-10", 4)), table)
    W.upsert_document_metrics(metric_rows(spark, ("z", "2024-02-10", 5)), table)  # its old day is empty now
    got = {r["document_id"]: (r["v"], str(r["dt"])) for r in table.read().collect()}
    assert got == {"a": (1, "2024-01-01"), "c": (3, "2024-01-01"), "b": (4, "2024-02-10"), "z": (5, "2024-02-10")}
    assert {p for p, _ in table.version().entries} == {"2024-01-01", "2024-02-10"}
    # Days that a batch does not touch keep their folder, and older versions can be read.
    before = {p: f for p, f in table.version().entries}
    W.upsert_document_metrics(metric_rows(spark, ("q", "2024-05-01", 1)), table)
    assert before.items() <= dict(table.version().entries).items()
    assert {r["document_id"] for r in table.read(table.version().number - 1).collect()} == {"a", "b", "c", "z"}
    table.vacuum(keep=1)
    assert {r["document_id"] for r in table.read().collect()} == {"a", "b", "c", "z", "q"}


def test_upsert_stopped_at_any_step(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "cur"), by="dt")
    W.upsert_document_metrics(metric_rows(spark, ("a", "2024-01-01", 1), ("b", "2024-01-02", 2)), table)
    new = metric_rows(spark, ("b", "2024-01-03", 9), ("c", "2024-01-01", 3))
    old = {"a": 1, "b": 2}
    rows = lambda: {r["document_id"]: r["v"] for r in table.read().collect()}
    for step in ("add_folder", "commit"):
        with monkeypatch.context() as m:
            real = getattr(VersionedTable, step)

            def stop(self, *args, **kwargs):
                if step == "add_folder":
                    real(self, *args, **kwargs)  # the data are written, the manifest is not
                raise RuntimeError("stopped")

            m.setattr(VersionedTable, step, stop)
            with pytest.raises(RuntimeError):
                W.upsert_document_metrics(new, table)
        assert rows() == old
    W.upsert_document_metrics(new, table)
    assert rows() == {"a": 1, "b": 9, "c": 3}


def test_log_stays_short_and_survives_a_stop(spark, tmp_path, monkeypatch):
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    log = LeveledLog(spark, str(tmp_path / "log"), merge, fan=3)
    total: dict = {}
    for i in range(20):
        batch = [(i % 4, 1), (i % 3, 10)]
        for k, n in batch:
            total[k] = total.get(k, 0) + n
        frame = spark.createDataFrame(batch, "k int, n long").coalesce(1)
        if i == 8:  # the batch whose merges go two levels up is stopped before the switch
            with monkeypatch.context() as m:
                m.setattr(VersionedTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
                with pytest.raises(RuntimeError):
                    log.append(frame, i)
            assert sum(r["n"] for r in log.read().collect()) == 11 * i
        log.append(frame, i)
        log.append(frame, i)  # a batch that comes again
        assert len(log.table.version().entries) <= 6
    assert {r["k"]: r["n"] for r in log.read().collect()} == total
    assert sum(r["n"] for r in log.read(log.table.version().number - 1).collect()) == 11 * 19


def test_csv_columns_sorted_and_union(spark):
    kind = "blob_name string, extracted_data map<string,struct<value:string,confidence:double>>"
    df = spark.createDataFrame([("x", {"b": ("1", 0.5)}), ("y", {"a": ("2", 0.6)})], kind)
    flat = W.flatten_csv(df, ["a", "b"])
    assert flat.columns == ["blob_name", "field_a_confidence", "field_a_value", "field_b_confidence", "field_b_value"]
    u = W.union_columns(spark.range(1).select("id"), spark.createDataFrame([(5, "z")], "id long, s string"))
    assert u.columns == ["id", "s"] and u.count() == 2


def test_stored_metrics_read_only_their_days(spark, tmp_path):
    """Old and new status names, JSON maps, and a folder that lacks columns; other days are not listed."""
    from foliant.sources import metrics as M

    plain = str(tmp_path / "plain")
    rows = [("a", "completed", "2024-01-01T10:00:00", '{"compute": 0.5}'), ("b", "success", "2024-01-02T10:00:00", "not json"), ("c", "hitl_required", "2024-01-03T10:00:00", None)]
    df = spark.createDataFrame(rows, "document_id string, processing_status string, start_time string, cost_breakdown string").withColumn("dt", F.to_date("start_time"))
    df.write.partitionBy("dt").parquet(plain)
    table = VersionedTable(spark, str(tmp_path / "versions"), by="dt")
    table.replace(df)
    for source in (spark.read.parquet(plain), table):
        got = M.stored_metrics(source, "2024-01-01 00:00:00", "2024-01-02 23:00:00")
        assert {r["document_id"]: (r["processing_status"], r["cost_breakdown"], r["hitl_required"]) for r in got.collect()} == {
            "a": ("success", {"compute": 0.5}, False), "b": ("success", {}, False)}
        assert got.columns == list(M.METRICS)
        assert len(got.inputFiles()) <= 3
    assert {r["document_id"]: r["processing_status"] for r in M.stored_metrics(table).collect()}["c"] == "needs_review"
    plan = M.stored_metrics(spark.read.parquet(plain), "2024-01-01", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    # A versioned table leaves out the folders of other days before Spark sees them.
    assert all("2024-01-03" not in f for f in M.stored_metrics(table, "2024-01-01", "2024-01-02").inputFiles())
