import json

from ledgerloom.plans import ingest
from ledgerloom.streaming import jobs


def provider(prompt):
    facts = [
        {"page_no": "1", "entity": "Acme Ltd.", "metric": "Revenue from operations", "value": "1,200", "unit": "INR crore", "period": "FY'24", "quote": "Revenue from operations was INR 1,200 crore in FY24"},
        {"page_no": "1", "entity": "Acme", "metric": "EBITDA", "value": "300", "quote": "EBITDA stood at 300 on another page"},
        {"page_no": 1, "entity": "Acme", "metric": "EPS", "value": "5", "quote": "this was never written anywhere"},
    ]
    return json.dumps({"facts": facts})


def test_files_to_facts(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "lake"
    folder.mkdir()
    (folder / "acme.pdf").write_bytes(b"Revenue from operations was INR 1,200 crore in FY24, up 12% on the year.\fEBITDA stood at 300 on another page. Nothing else of note in 2024 here.")
    (folder / "same.pdf").write_bytes((folder / "acme.pdf").read_bytes())
    documents = spark.createDataFrame([], "document_id string, document_version int, content_hash string, status string")
    done = ingest.ingest(spark, str(folder), [provider], documents, 7, str(root))
    found = {r.metric: r for r in done.facts.collect()}
    assert set(found) == {"Revenue from operations", "EBITDA"}
    first = found["Revenue from operations"]
    assert (first.norm_entity, first.norm_metric, first.norm_value, first.norm_unit, first.norm_period, first.evidence_status) == ("acme", "revenue", 1200.0, "inr_crore", "FY2024", "verified")
    assert (found["EBITDA"].page_no, found["EBITDA"].evidence_status) == (2, "flagged")
    assert first.embedding_status == "success" and len({r.id for r in found.values()}) == 2
    assert tuple(ingest.run_report(done).first()) == (1, 1, 2, 2, 1, 0)
    assert spark.read.parquet(f"{root}/silver").count() == 2 and spark.read.parquet(f"{root}/gold/facts").count() == 2
    complete = done.documents.where("status = 'new'").selectExpr("document_id", "document_version", "content_hash", "'complete' AS status")
    again = ingest.ingest(spark, str(folder), [provider], complete, 8)
    assert again.facts.count() == 0


def test_job_stream(spark, tmp_path):
    folder = tmp_path / "jobs"
    folder.mkdir()
    job = json.dumps({"document_id": "a", "filename": "a.pdf", "content_hash": "h", "path": "p", "uploaded_at": "2024-01-01T00:00:00Z"})
    (folder / "one.json").write_text(f"{job}\n{job}\nnot a job\n")
    seen = []
    jobs.start(jobs.file_source(spark, str(folder)), lambda batch, n: seen.extend(batch.collect()), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert [r.document_id for r in seen] == ["a"]
    events = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 2, "complete"), (2, 1, "queued")], "job_id int, at int, status string")
    assert {r.job_id: r.status for r in jobs.job_states(events).collect()} == {1: "complete", 2: "queued"}


def test_jobs_from_file_to_relations(spark, tmp_path):
    from ledgerloom.plans import service
    from ledgerloom.sources import storage

    folder, root = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()

    def said(value):
        return f"Revenue from operations was INR {value} crore in FY24, up 12% on the year.".encode()

    def provider(prompt):
        value = prompt.split("INR ")[1].split(" crore")[0]
        return json.dumps([{"page_no": 1, "entity": "Acme", "metric": "Revenue", "value": value, "unit": "INR crore", "period": "FY24", "quote": f"INR {value} crore in FY24"}])

    (folder / "a.pdf").write_bytes(said("1,200"))
    handle = service.handler(spark, [provider], root)
    batch = spark.createDataFrame([(str(folder / "a.pdf"),)], "path string")
    handle(batch, 0)
    (folder / "b.pdf").write_bytes(said("1,205"))
    second = spark.createDataFrame([(str(folder / "b.pdf"),)], "path string")
    assert service.submit(second, lambda _: 1 / 0, handle, 1) == "inline"
    handle(second, 1)  # delivered again
    handle(batch, 2)  # the same bytes in a later batch
    relations = service.state(spark, root, "relations", service.RELATIONS).collect()
    assert [(r.relation_type, r.run_id) for r in relations] == [("corroborates", 2)]
    assert {r.job_id: r.status for r in service.states(spark, root).collect()} == {"a": "complete", "b": "complete"}
    assert service.facts(spark, root).where("is_active").count() == 2
    assert service.evaluation(spark, root).count() == 1
    service.reprocess(spark, str(folder), [provider], root)
    found = service.facts(spark, root).collect()
    assert sorted((r.document_id, r.document_version, r.is_active) for r in found) == [("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, True)]
    assert storage.ensure_folder(spark, f"{root}/store") and storage.put(spark, str(folder / "a.pdf"), f"{root}/store", "a.pdf") == f"{root}/store/a.pdf"
    assert storage.put(spark, str(folder / "none.pdf"), f"{root}/store", "x") is None
