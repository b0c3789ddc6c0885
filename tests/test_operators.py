import operator
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ask, chunk, compare, evidence, model_stage, retrieve, tables, validate
from ledgerloom.sources import lake, pages

BASE = {
    "id": 1, "document_id": "a", "entity": "Acme", "norm_entity": "acme", "metric": "Revenue", "norm_metric": "revenue", "value": "100", "norm_value": 100.0, "unit": "%", "norm_unit": "percent",
    "period": "FY2024", "norm_period": "FY2024", "scope": "consolidated", "norm_scope": "consolidated", "geography": "India", "norm_geography": "india", "reporting_basis": "actual", "quote": "Revenue was 100",
}
KINDS = ", ".join(f"{k} {'long' if k == 'id' else 'double' if k == 'norm_value' else 'string'}" for k in BASE)

CASES = [
    ({}, {"norm_period": "FY2023", "norm_value": 90.0}, ("reconcilable", "different_reporting_period")),
    ({}, {"norm_scope": "standalone", "norm_value": 80.0}, ("reconcilable", "different_scope")),
    ({"norm_unit": "inr_crore"}, {"norm_unit": "usd_million", "norm_value": 12.0}, ("reconcilable", "different_currency")),
    ({"norm_unit": "inr_crore"}, {"norm_unit": "inr_lakh"}, ("reconcilable", "different_unit")),
    ({}, {"reporting_basis": "estimate", "norm_value": 110.0}, ("reconcilable", "actual_vs_estimate")),
    ({}, {"norm_geography": "global", "norm_value": 200.0}, ("reconcilable", "different_geography")),
    ({}, {"norm_value": 100.5}, ("corroborates", "none")),
    ({}, {"norm_value": 108.0}, ("reconcilable", "updated_information")),
    ({}, {"norm_value": 200.0}, (None, None)),
    ({}, {"norm_entity": "beta", "entity": "Beta"}, ("unrelated", "none")),
    ({}, {"norm_metric": "eps"}, ("unrelated", "none")),
    ({}, {"norm_value": None}, ("needs_review", "none")),
    ({"norm_value": 0.0}, {"norm_value": 0.0}, (None, None)),
    ({}, {"norm_period": None, "norm_value": 100.2}, ("corroborates", "none")),
    ({"norm_unit": "unitless"}, {"norm_value": 100.0}, ("corroborates", "none")),
]


def facts(spark, *rows):
    return spark.createDataFrame([tuple((BASE | r)[k] for k in BASE) for r in rows], KINDS)


def test_classifier(spark):
    rows = []
    for i, (a, b, _) in enumerate(CASES):
        rows += [a | {"id": 2 * i}, b | {"id": 2 * i + 1, "document_id": "b"}]
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(CASES))], "fact_id long, cand_id long")
    found = {r.fact_id: (r.relation_type, r.reason) for r in compare.classified(pairs, facts(spark, *rows)).select("fact_id", "relation_type", "reason").collect()}
    assert [found[2 * i] for i in range(len(CASES))] == [want for _, _, want in CASES]


def test_pools_prefer_the_entity(spark):
    df = retrieve.keyed(facts(spark, {}, {"id": 2, "document_id": "b"}, {"id": 3, "document_id": "b", "norm_entity": "beta"}, {"id": 4, "document_id": "a"}, {"id": 5, "document_id": "c", "norm_metric": "eps"}, {"id": 6, "document_id": "d", "norm_entity": "only"})).withColumn("is_active", F.lit(True))
    found = {(r.fact_id, r.cand_id): r.tier for r in retrieve.pools(df, df).collect()}
    assert {c: t for (f, c), t in found.items() if f == 1} == {2: 0, 5: 1}
    assert {c for f, c in found if f == 6} == {1, 2, 3, 4, 5}


def test_retrieval_and_comparison(spark):
    df = facts(spark, {}, {"id": 2, "document_id": "b", "norm_value": 100.5}, {"id": 3, "document_id": "c", "norm_value": 300.0}, {"id": 4, "document_id": "c", "norm_metric": "eps"})
    df = df.withColumns({"is_active": F.lit(True), "evidence_status": F.lit("verified"), "embedding": F.lit(None).cast("array<double>")})
    none = spark.createDataFrame([], "fact_a_id long, fact_b_id long, is_active boolean")
    found = {(r.fact_a_id, r.fact_b_id): (r.relation_type, r.source) for r in compare.compare_new_facts(df.where("id = 1"), df, none).collect()}
    assert found == {(1, 2): ("corroborates", "table"), (1, 3): ("needs_review", "none")}
    known = spark.createDataFrame([(2, 1, True)], "fact_a_id long, fact_b_id long, is_active boolean")
    assert {(r.fact_a_id, r.fact_b_id) for r in compare.compare_new_facts(df.where("id = 1"), df, known).collect()} == {(1, 3)}


def test_nearest_is_exact(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.nearest(df, df, 1, threshold=0.45, n_blocks=2).collect()}
    assert best == {(1, 1): 3, (3, 1): 1}


def test_nearest_sends_nothing_to_all_tasks(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = retrieve.nearest(df, df, 4, n_blocks=3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v}
    for i, v in unit.items():
        scores = sorted((-round(sum(map(operator.mul, v, w)), 9), j) for j, w in unit.items() if j != i)
        assert [r.vec_id for r in found.where(F.col("query_id") == i).orderBy("rank").collect()] == [j for _, j in scores[:4]] if i % 20 == 0 else True


def test_evidence(spark):
    text = "Total revenue for the year was 100 crore and it was audited"
    pages_ = spark.createDataFrame([("d", 1, 1, "nothing"), ("d", 1, 2, text.upper()), ("d", 1, 3, text + " again"), ("e", 1, 1, text)], "document_id string, document_version int, page_no int, text string")
    claims = [(1, "d", 1, 2, text, None), (2, "e", 1, 9, text, None), (3, "d", 1, 1, "not there at all", None), (4, "d", 1, 1, text, [1, 3]), (5, "d", 1, 1, " ", None), (6, "d", 1, None, text[:40] + " changed at its end", None)]
    df = spark.createDataFrame(claims, "fact_id long, document_id string, document_version int, page_no int, quote string, chunk_pages array<int>")
    found = {r.fact_id: (r.evidence_status, r.page_no) for r in evidence.verified(df, pages_).collect()}
    assert found == {1: ("verified", 2), 2: ("flagged", 1), 3: ("unverifiable", 1), 4: ("flagged", 3), 5: ("unverifiable", 1), 6: ("flagged", 2)}


def greedy_chunks(sizes):
    """(start, end) page numbers of a document's chunks by a plain loop."""
    out, i = [], 0
    while i < len(sizes):
        (page, n), last = sizes[i], i
        if n <= chunk.CHUNK_LIMIT and i + 1 < len(sizes) and sizes[i + 1][0] == page + 1 and n + sizes[i + 1][1] <= chunk.MERGE_LIMIT:
            last = i + 1
        out.append((page, sizes[last][0]))
        i = last + 1
    return out


def test_chunks_equal_the_greedy_rule(spark):
    import random

    random.seed(3)
    rows, want = [], {}
    for d in range(12):
        sizes = [(p, random.choice([10, 400, 1700, 1800, 3400, 4900])) for p in range(1, 15) if random.random() < 0.8]
        want[f"d{d}"] = greedy_chunks(sizes)
        rows += [(f"d{d}", p, "x" * n, len(sizes)) for p, n in sizes]
    made = chunk.chunks(spark.createDataFrame(rows, "document_id string, page_no int, text string, n_pages long"))
    got = {d: [] for d in want}
    for r in made.orderBy("document_id", "chunk_id").collect():
        got[r.document_id].append((r.start_page, r.end_page))
    assert got == want


def test_long_page_is_split_at_paragraphs(spark):
    parts = ["a" * 3000, "b" * 1990, "c" * 20, "d" * 6000, "e"]
    df = spark.createDataFrame([("d", 1, "\n\n".join(parts), 1)], "document_id string, page_no int, text string, n_pages long")
    texts = [r.text.removeprefix("[page 1]\n") for r in chunk.chunks(df).orderBy("chunk_id").collect()]
    assert texts == ["\n\n".join(parts[:2]), parts[2], parts[3], parts[4]]


def test_candidate_fallback_and_top_chunks(spark):
    rows = [("d", 1, "short"), ("d", 2, ""), ("e", 1, "Revenue grew 12% in FY2024 to INR 500 crore."), ("e", 2, "contents only")]
    df = spark.createDataFrame(rows, "document_id string, page_no int, text string")
    assert {(r.document_id, r.page_no, r.n_pages) for r in chunk.candidate_pages(df).collect()} == {("d", 1, 1), ("e", 1, 2)}
    many = spark.createDataFrame([("big", f"c{i:02d}", "revenue and earnings" if i == 29 else "zzz", 30) for i in range(30)], "document_id string, chunk_id string, text string, n_pages int")
    kept = {r.chunk_id for r in chunk.top_chunks(many, chunk.query_score(F.col("text"))).collect()}
    assert len(kept) == chunk.MOST_CHUNKS and "c29" in kept


def test_grounding_numbers(spark):
    df = spark.createDataFrame([("It was 100 and 999 in 2024, or 5%.", ["100", "5"]), (None, [])], "a string, allowed array<string>")
    rows = [r.g for r in df.select(ask.grounded(F.col("a"), F.col("allowed")).alias("g")).collect()]
    assert rows[0].answer == "It was 100 and [UNSUPPORTED:999] in 2024, or 5%." and rows[0].unsupported == ["999"]
    assert rows[1].answer == "" and rows[1].unsupported == []


def test_ask(spark):
    df = facts(spark, {}, {"id": 2, "norm_entity": "beta", "entity": "Beta"}, {"id": 3, "norm_metric": "eps", "metric": "EPS"}).withColumns({"is_active": F.lit(True), "evidence_status": F.lit("verified"), "embedding": F.lit(None).cast("array<double>")})
    assert [r.id for r in ask.facts_for(df, "What was the revenue of Acme?").collect()] == [1]
    row = ask.answer_question(df, "What was the revenue of Acme?", lambda p: {"answer": "100, not 7", "cited_fact_ids": [99]}).first()
    assert row.answer == "100, not [UNSUPPORTED:7]" and [c.id for c in row.cited] == [1]
    with pytest.raises(ValueError):
        ask.answer_question(df, "  ")


def test_registration(spark):
    documents = spark.createDataFrame([("a", 1, "h1", "complete"), ("b", 1, "h2", "failed")], "document_id string, document_version int, content_hash string, status string")
    uploads = spark.createDataFrame([("a", "h1", 1), ("a", "h3", 2), ("b", "h2", 3), ("c", "h3", 4), ("a", "h4", 5)], "document_id string, content_hash string, uploaded_at long")
    found = {(r.document_id, r.content_hash): (r.status, r.document_version) for r in tables.register(uploads, documents).collect()}
    assert found == {("a", "h1"): ("skipped", None), ("a", "h3"): ("new", 2), ("b", "h2"): ("new", 2), ("c", "h3"): ("skipped", None), ("a", "h4"): ("new", 3)}


def test_tables(spark):
    rels = spark.createDataFrame([(1, 1, 2, "x", 1), (2, 2, 1, "y", 2), (3, 1, 3, "z", 1)], "id long, fact_a_id long, fact_b_id long, relation_type string, created_at long")
    assert {r.id for r in tables.merged_relations(rels.limit(0), rels).collect()} == {2, 3}
    df = facts(spark, {}, {"id": 2, "document_id": "b"}).withColumn("embedding", F.lit(None).cast("array<float>"))
    seen = tables.fact_relations(rels.where("id = 3").withColumn("is_active", F.lit(True)), df).collect()
    assert {(r.fact_id, r.other_id, r.other is None) for r in seen} == {(1, 3, True), (3, 1, False)}
    pages_ = spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 1, "new"), ("a", 1, 2, "kept")], "document_id string, document_version int, page_no int, text string")
    assert {(r.page_no, r.text) for r in tables.page_map(pages_, "a").collect()} == {(1, "new"), (2, "kept")}
    ids = tables.surrogate_ids(spark.range(20).select(F.col("id").alias("k")), F.col("k"), 100).collect()
    assert sorted((r.k, r.id) for r in ids) == [(i, 101 + i) for i in range(20)]


def test_gates(spark):
    raw = spark.createDataFrame([(1, "e", "m", "v", "q", "HIGH", "x", "85"), (0, "e", "m", "", "q", None, None, None)], "page_no int, entity string, metric string, value string, quote string, confidence string, reporting_basis string, numeric_confidence string")
    good, bad = validate.facts(raw)
    assert good.first().confidence == "high" and bad.first().problems == ["page_no", "value"]


def test_model_stage(spark):
    def provider(prompt):
        return '```json\n{"facts": [{"page_no": "x", "entity": "E", "metric": "M", "value": 5, "quote": "q", "is_reported_value": false}]}\n```'

    cache = spark.createDataFrame([], "key string, value string, created_at timestamp")
    chunks = spark.createDataFrame([("d", 1, "d_c000", 4, [4], "p"), ("d", 1, "d_c001", 5, [5], "p")], "document_id string, document_version int, chunk_id string, start_page int, page_map array<int>, prompt string")
    replies = model_stage.answered(chunks, [provider], cache)
    found = model_stage.raw_facts(replies).orderBy("page_no").collect()
    assert [(r.page_no, r.entity, r.value, r.confidence) for r in found] == [(4, "E", "5", "medium"), (5, "E", "5", "medium")]
    calls = []

    def failing(prompt):
        calls.append(prompt)
        raise model_stage.TransientError

    assert model_stage.ask("p", [failing], wait=lambda s: None) == (None, "failed") and len(calls) == model_stage.ATTEMPTS


def test_files_and_lake(spark, tmp_path):
    (tmp_path / "one.PDF").write_bytes(b"page 1\fpage 2\f  ")
    (tmp_path / "two.txt").write_bytes(b"no")
    found = pages.files(spark, str(tmp_path))
    assert [(r.document_id, r.filename) for r in found.select("document_id", "filename").collect()] == [("one", "one.PDF")]
    assert [(r.page_no, r.text, r.num_pages) for r in pages.split_pages(found).orderBy("page_no").collect()] == [(1, "page 1", 3), (2, "page 2", 3)]
    df = facts(spark, {}, {"id": 2}).withColumns({"document_version": F.lit(1), "run_id": F.lit(7).cast("long"), "evidence_status": F.when(F.col("id") == 2, "unverifiable").otherwise("verified")})
    lake.write_gold(df, str(tmp_path / "lake"))
    lake.write_gold(df, str(tmp_path / "lake"))
    compact = lake.compact_gold(spark, str(tmp_path / "lake"))
    assert [(r.fact_id, r.entity, r.value) for r in compact.collect()] == [(1, "acme", 100.0)]
    html = spark.createDataFrame([("<style>p{}</style><p>a &amp; b</p><script>x()</script><div>c<br>d</div>",)], "h string")
    assert html.select(pages.html_text(F.col("h"))).first()[0] == "a & b\nc\nd"


def test_viewer_columns(spark):
    from ledgerloom.operators import viewer

    rows = [("revenue", 8993.6, "inr_crore", "FY2024", 0.885, "different_scope", " ", None, None, 8), (None, 100.0, "", "", None, "none", "seen", "", False, 7), ("eps", 0.0, "usd", None, 0.6, None, None, "forecast", False, None), ("eps", None, "usd", None, 1.0, "", "x", "actual", True, 1)]
    df = spark.createDataFrame(rows, "m string, v double, u string, p string, c double, r string, e string, b string, i boolean, n int")
    line = viewer.normalized_line(F.col("m"), F.col("v"), F.col("u"), F.col("p"))
    got = df.select(line, viewer.percent(F.col("c")), viewer.reason_text(F.col("r")), viewer.shown_quote(F.col("e"), F.lit("quote")), viewer.shown_basis(F.col("b"), F.col("i")), viewer.is_large(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("revenue = 8993.6 inr_crore (FY2024)", 89, "different scope", "quote", "actual", True),
        (" = 100", None, None, "seen", "estimate", False),
        ("eps = usd", 60, None, "quote", "forecast", False),
        ("", 100, None, "x", "actual", False),
    ]


def test_counters_options_and_lazy_providers(spark, tmp_path):
    from ledgerloom.operators import counters, model_stage, tables
    from ledgerloom.options import Options

    def make():
        def provider(prompt):
            if prompt == "bad":
                raise ValueError("not an answer")
            return prompt.upper()

        return provider

    prompts = spark.createDataFrame([("a",), ("a",), ("bad",)], "prompt string")
    replies, seen = counters.observed(model_stage.answered(prompts, [model_stage.lazily(make)]), "run-1")
    replies.write.parquet(str(tmp_path / "replies"))
    assert seen.get["answers"] == 2 and seen.get["failed"] == 1 and seen.get["prompt_chars"] == 5
    assert counters.added(seen.get, seen.get)["calls"] == 6
    read = Options.read({"LEDGERLOOM_FINAL_K": "3", "LEDGERLOOM_THRESHOLD": "0.5", "OTHER": "x"})
    assert (read.final_k, read.threshold, read.vector_k) == (3, 0.5, 20) and read.retrieval()["k"] == 3
    facts = spark.createDataFrame([(1, False, [0.1]), (2, True, [0.2])], "id long, is_active boolean, embedding array<double>")
    assert tables.fact(facts, 1).collect() == [(1, False)] and counters.index_size(facts).first().size == 2
