"""Embeddings with a status, listings, documents as JSON, migrated state, failures of single files, coverage, order of chunks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ask, chunk, embed, evidence, model_stage
from ledgerloom.options import Options
from ledgerloom.plans import service
from ledgerloom.sources import lake, pages


def model(texts):
    if any("boom" in t for t in texts):
        raise ValueError("no boom")
    known = {"zero": [0.0] * 3, "short": [1.0], "odd": [1.0, math.nan, 0.0], "gone": None}
    return [known.get(t, [float(len(t)), 1.0, 0.0]) for t in texts]


def test_embeddings_have_a_status(spark):
    texts = ["ab", "ab", None, " \t", "zero", "short", "odd", "gone", "boom 1", "fine"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "id long, text string, _key2 string, embedding string")
    rows = {r.id: r for r in embed.embedded(df, F.col("text"), model, "m1", 3).collect()}
    want = {2: "blank text", 3: "blank text", 4: "all values are zero", 5: "wrong dimension: 1 instead of 3", 6: "a value is not finite", 7: "no vector", 8: "ValueError: no boom"}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert r.embedding_error == want.get(i) and r.embedding_status == ("failed" if i in want else "success") and r.embedding_model == (None if i in want else "m1")
        assert r.embedding == (None if i in want else [float(len(t)), 1.0, 0.0])


def test_a_model_with_too_few_vectors_fails_each_text():
    assert [e for _, e in embed.vectors_of(["a", "b"], lambda texts: [[1.0]][: len(texts) - 1], 1)] == ["ValueError: 0 vectors for 1 texts"] * 2


def test_listing_is_by_pattern_and_name(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt", "A.pdf", "z.PDF", "d.csv"):
        (tmp_path / name).write_text("x")
    rows = pages.listing(spark, str(tmp_path), ["*.txt", "*.pdf", "[a-b]*"]).collect()
    assert [(r.nth, r.filename) for r in rows] == [(1, "c.txt"), (2, "A.pdf"), (3, "a.pdf"), (4, "b.pdf")]


def test_one_json_file_for_each_document(spark, tmp_path):
    df = spark.createDataFrame([("d1", 2, None), ("d1", 1, "x"), ("d2", 3, "y")], "document_id string, id long, t string")
    lake.write_document_json(df, str(tmp_path / "out"))
    files = {p.parent.name: [json.loads(line) for line in p.read_text().splitlines()] for p in (tmp_path / "out").rglob("*.txt")}
    assert files == {"document_id=d1": [{"document_id": "d1", "id": 1, "t": "x"}, {"document_id": "d1", "id": 2, "t": None}], "document_id=d2": [{"document_id": "d2", "id": 3, "t": "y"}]}


def test_state_takes_new_columns(spark, tmp_path):
    root = str(tmp_path)
    service.record(spark.createDataFrame([("a", 1)], "job_id string, old int"), root, "things", 1)
    service.record(spark.createDataFrame([("b", 2, "n")], "job_id string, old int, fresh string"), root, "things", 2)
    rows = service.state(spark, root, "things", "job_id string, fresh string, later double").orderBy("job_id").collect()
    assert [(r.job_id, r.fresh, r.later, r.old, r.run_id) for r in rows] == [("a", None, None, 1, 1), ("b", "n", None, 2, 2)]


def test_only_failing_files_are_left_failed(spark, tmp_path, monkeypatch):
    seen = []

    def process(spark, paths, providers, root, run_id, **options):
        seen.append((tuple(paths), run_id))
        if "bad" in paths:
            raise ValueError("bad file")

    monkeypatch.setattr(service, "process", process)
    batch = spark.createDataFrame([(p,) for p in ["a", "bad", "c", "d", None, "a"]], "path string")
    service.handler(spark, [], str(tmp_path))(batch, 4)
    assert seen[0] == (("a", "bad", "c", "d"), 5)
    done = [p for paths, _ in seen if "bad" not in paths for p in paths]
    assert sorted(done) == ["a", "c", "d"] and (("bad",), seen[[p for p, _ in seen].index(("bad",))][1]) in seen
    assert len({r for _, r in seen}) == len(seen)


@pytest.mark.parametrize("coverage, status", [(0.7, "unverifiable"), (0.4, "verified")])
def test_coverage_is_an_option(spark, coverage, status):
    quote = "the revenue of the year was one hundred crore and nothing else of note happened at all"
    facts = spark.createDataFrame([(1, "d", 1, 1, quote)], "fact_id long, document_id string, document_version int, page_no int, quote string")
    texts = spark.createDataFrame([("d", 1, 1, "it says " + quote[: len(quote) // 2] + " then stops")], "document_id string, document_version int, page_no int, text string")
    assert evidence.verified(facts, texts, **Options(coverage=coverage).grounding()).first().evidence_status == status


def test_quotes_meet_pages_of_their_own_document(spark):
    quote = "alpha beta gamma delta epsilon zeta"
    facts = spark.createDataFrame([(1, "d", 1, 9, quote), (2, "e", 1, 9, quote), (3, "d", 1, 9, "q r"), (4, "d", 1, 9, "beta xx gamma delta")], "fact_id long, document_id string, document_version int, page_no int, quote string")
    texts = spark.createDataFrame([("d", 1, 1, f"x {quote} y"), ("d", 1, 2, "c q rc"), ("e", 1, 1, "beta gamma"), ("e", 2, 1, f"x {quote}")], "document_id string, document_version int, page_no int, text string")
    found = {r.fact_id: (r.evidence_status, r.page_no) for r in evidence.verified(facts, texts).collect()}
    assert found == {1: ("flagged", 1), 2: ("unverifiable", 9), 3: ("flagged", 2), 4: ("unverifiable", 9)}


def test_chunks_in_their_order(spark):
    rows = [("b", f"b_c{i:03d}", i // 2 + 1) for i in (1001, 999, 1000, 2)] + [("a", "a_c000", 1)]
    df = spark.createDataFrame(rows, "document_id string, chunk_id string, start_page int")
    assert [r.chunk_id for r in chunk.in_order(df).collect()] == ["a_c000", "b_c002", "b_c999", "b_c1000", "b_c1001"]


FACTS = "id long, document_id string, page_no int, entity string, metric string, value string, unit string, period string, scope string, geography string, reporting_basis string, quote string, norm_entity string, norm_metric string, norm_value double, norm_period string, norm_scope string, evidence_status string, is_active boolean, embedding array<double>"


def asked(spark, reply):
    rows = [(i, "d", 1, "Acme", "Revenue", v, "USD", f"FY202{i}", "consolidated", None, None, f"Revenue was {v}", "acme", "revenue", float(v), f"FY202{i}", None, "verified", True, None) for i, v in ((1, "100"), (2, "200"))]
    return ask.answer_question(spark.createDataFrame(rows, FACTS), "What was the revenue of Acme?", reply).first()


def test_numbers_are_checked_against_cited_facts(spark):
    row = asked(spark, lambda p: {"answer": "100 and 200 in 2021", "cited_fact_ids": [1, "x"]})
    assert row.answer == "100 and [UNSUPPORTED:200] in 2021" and row.unsupported == ["200"] and [c.id for c in row.cited] == [1]


def test_without_a_model_nothing_is_marked(spark):
    def down(prompt):
        raise model_stage.QuotaError

    for reply in (None, down):
        row = asked(spark, reply)
        assert row.answer.startswith("No model is available.") and "UNSUPPORTED" not in row.answer and row.unsupported == [] and len(row.cited) == 2


def test_an_answer_that_is_no_object_is_its_text(spark):
    row = asked(spark, lambda p: ["100", 7])
    assert row.answer == "['100', [UNSUPPORTED:7]]" and len(row.cited) == 2
