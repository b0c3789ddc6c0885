"""Vector index, pruned ranking, clusters, sketches, verdicts, cubes and SQL text."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import sql
from ledgerloom.operators import clusters, compare, model_stage, retrieve, sketches, tables, vector_index, verdict
from ledgerloom.sources import tabular
from tests.test_catalogue import SF, duck, test_equals_sql  # noqa: F401

NAMES = ["index_search", "index_hits", "bm25_pruned", "sketch_tokens", "sketch_quantiles", "compare_by_model", "sql_unsupported", "relation_cube", "fact_clusters", "split_long", "chunk_pages", "candidate_chunks", "document_matrix", "reconciliation", "csv_import", "orc_import"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_sql(spark, duck, name):  # noqa: F811
    test_equals_sql(spark, duck, name)


def embedded(spark, seed, n=300, dim=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] + 0.2 * draw.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, rows[0][1]), (n + 4, rows[0][1]), (n + 5, [-x for x in rows[0][1]])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(rows, k, threshold):
    held = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.linalg.norm(v) > 0}
    out = {}
    for i, v in held.items():
        scores = sorted((-round(float(v @ w), 9), j) for j, w in held.items() if j != i and (threshold is None or round(float(v @ w), 9) >= threshold))
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize("k, threshold, pivots", [(5, None, None), (3, 0.55, 4), (400, None, 7), (20, 0.9, 1)])
def test_index_loses_no_neighbour(spark, k, threshold, pivots):
    rows, df = embedded(spark, 1)
    index = vector_index.build(df, pivots)
    got = defaultdict(dict)
    for r in vector_index.search(df, index, k, threshold).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    for i, want in brute(rows, k, threshold).items():
        found = [got[i][n] for n in sorted(got[i])]
        assert [j for j, _ in found] == [j for j, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-8)


def test_index_sends_queries_one_by_one(spark):
    """A row of the shuffle is one vector, so that no Arrow batch holds many matrices."""
    _, df = embedded(spark, 3, 900)
    index = vector_index.build(df)
    asked = vector_index._asked(vector_index.usable(df).withColumn("reach", F.lit(None).cast("double")), index, 5, float("inf"), False)
    longest = asked.agg(*[F.max(F.length(c)).alias(c) for c, kind in asked.dtypes if kind == "binary"]).first().asDict()
    assert longest == {"unit": 8 * 8, "wanted": -(-len(index.sizes) // 8)}
    flat = df.where("size(embedding) > 0").toPandas()
    batch = pa.RecordBatch.from_arrays([pa.array(flat["vec_id"]), pa.array(flat["embedding"].tolist())], ["vec_id", "embedding"])
    parts = list(vector_index.units([batch]))
    assert len(parts) > 1 and all(len(m) == p.num_rows <= vector_index.QUERY_ROWS for p, m in parts)


def test_index_skips_blocks(spark):
    _, df = embedded(spark, 2, 600)
    index = vector_index.build(df, 12)
    report = vector_index.probed(df, index, 5).first()
    assert report.n_read < 0.7 * report.n_queries * report.n_blocks
    far = vector_index.probed(df, index, 5, 0.95).first()
    assert far.n_read < report.n_read


def test_index_of_nothing(spark):
    _, df = embedded(spark, 1, 10)
    empty = vector_index.build(df.limit(0))
    assert vector_index.search(df, empty).count() == 0
    assert vector_index.search(df.limit(0), vector_index.build(df)).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert vector_index.search(zeros, vector_index.build(zeros)).count() == 0


def test_rankings_shuffle_documents_only(spark):
    """Neither pairs of query and document nor postings by word are shuffled."""
    docs = spark.range(400).select(F.col("id").alias("cand_id"), F.expr("transform(sequence(0, 20), i -> concat('w', cast(pmod(xxhash64(id, i), 50) AS string)))").alias("_tokens"))
    items = docs.limit(5).withColumnRenamed("cand_id", "fact_id")
    whole, pruned = retrieve.bm25_corpus(items, docs.repartition("cand_id"), 3), retrieve.bm25_pruned(items, docs, 3)
    plan = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in (("whole", whole), ("pruned", pruned))}
    assert not re.search(r"hashpartitioning\((fact_id|cand_id)#\d+L, (fact_id|cand_id|dl|token)#", plan["whole"])
    assert not re.search(r"hashpartitioning\([^)]*token#", plan["pruned"])
    assert {tuple(r) for r in whole.select("fact_id", "cand_id", "rank").collect()} == {tuple(r) for r in pruned.select("fact_id", "cand_id", "rank").collect()}


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_pruned_ranking_equals_the_whole(spark, seed, k):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: draw.choices(words, weights=[2.0**-i for i in range(12)], k=n)
    docs = spark.createDataFrame([(i, text(draw.randint(0, 25))) for i in range(60)], "cand_id long, _tokens array<string>")
    items = spark.createDataFrame([(i, text(draw.randint(0, 6)) + ["none"] * (i % 2)) for i in range(9)], "fact_id long, _tokens array<string>")
    want = {(r.fact_id, r.cand_id, r["rank"], round(r.score, 6)) for r in retrieve.bm25_corpus(items, docs, k).collect()}
    assert {(r.fact_id, r.cand_id, r["rank"], round(r.score, 6)) for r in retrieve.bm25_pruned(items, docs, k).collect()} == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 14)), st.one_of(st.none(), st.integers(0, 14))), max_size=25))
def test_clusters_are_components(spark, edges):
    parent = {i: i for i in range(15)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = clusters.clusters(spark.createDataFrame(edges, "a long, b long"), spark.range(15))
    assert {r.id: r.cluster_id for r in found.collect()} == {i: root(i) for i in range(15)}


def test_clusters_of_a_long_chain_and_a_ring(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500 + i, 500 + (i + 1) % 50) for i in range(50)]
    found = {r.id: r.cluster_id for r in clusters.clusters(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {500 + i: 500 for i in range(50)}


def test_sketches_merge(spark):
    words = spark.range(60_000).select((F.col("id") % 3).alias("source"), (F.col("id") % 20).alias("doc_id"), (F.col("id") % 25_000).cast("string").alias("token"), (F.col("id") % 1000).alias("value"))
    found = sketches.distinct_tokens(sketches.token_sketches(words, ["source", "doc_id"]), ["source"])
    exact = {r.source: r.n for r in words.groupBy("source").agg(F.count_distinct("token").alias("n")).collect()}
    assert all(abs(r.n_tokens - exact[r.source]) <= sketches.ERROR * exact[r.source] for r in found.collect()) and found.count() == 3
    values = words.unionByName(words.limit(5).withColumn("value", F.lit(None).cast("long")))
    for r in sketches.quantiles(sketches.value_sketches(values, ["source", "doc_id"]), ["source"], [0.0, 0.5, 1.0]).collect():
        assert abs(r.value - 999 * r["rank"]) <= 1000 * sketches.RANK_ERROR


SIDES = "id long, document_id string, page_no int, entity string, metric string, value string, unit string, period string, scope string, geography string, reporting_basis string, quote string, norm_entity string, norm_metric string, norm_unit string, norm_value double, norm_period string"


def pair(spark):
    rows = [(1, "a", 3, "Acme", "Revenue", "10", "USD", "FY2020", None, None, None, "ten", "acme", "revenue", "usd", 10.0, "FY2020"), (2, "b", 4, "Acme", "Revenue", "20", "USD", "FY2021", "group", "", "estimate", None, "acme", "revenue", "usd", 20.0, "FY2021")]
    facts = spark.createDataFrame(rows, SIDES)
    return facts, compare.classified(spark.createDataFrame([(1, 2)], "fact_id long, cand_id long"), facts).drop("rule", "relation_type", "confidence", "reason")


ANSWERS = {
    '{"relation_type": "Corroborated", "confidence": "0.9", "fact_b_evidence": " its words "}': ("corroborates", 0.9, "none", "ten", "its words", "model"),
    '```json\n{"relation_type": "reconcilable", "reason": "different-period"}\n```': ("reconcilable", 0.5, "different_reporting_period", "ten", "", "model"),
    '{"relation_type": "contradicts", "confidence": 7}': ("reconcilable", 0.88, "actual_vs_estimate", "ten", "", "table"),
    '{"relation_type": null}': ("unrelated", 0.5, "none", "ten", "", "model"),
    "[1, 2]": None,
    "no idea": None,
    "": None,
}


@pytest.mark.parametrize("answer", list(ANSWERS))
def test_verdicts(spark, answer):
    facts, pairs = pair(spark)
    rows = verdict.verdicts(pairs, facts, facts, [lambda prompt: answer]).collect()
    want = ANSWERS[answer]
    assert [(r.relation_type, r.confidence, r.reason, r.fact_a_evidence, r.fact_b_evidence, r.source) for r in rows] == ([want] if want else [])


def test_a_model_that_is_down_leaves_review(spark):
    facts, pairs = pair(spark)

    def down(prompt):
        raise model_stage.QuotaError

    (row,) = verdict.verdicts(pairs, facts, facts, [down]).collect()
    assert (row.relation_type, row.confidence, row.reason, row.source, row.explanation) == ("needs_review", 0.3, "none", "none", "no model answered: quota")


def test_the_prompt_says_what_documents_say(spark):
    facts, pairs = pair(spark)
    seen = verdict.verdicts(pairs, facts, facts, [lambda prompt: json.dumps({"relation_type": "needs_review", "explanation": prompt})]).first().explanation
    assert "Fact A, from a, page 3\nentity: Acme\nmetric: Revenue\nvalue: 10\nunit: USD\nperiod: FY2020\nscope: unspecified\ngeography: unspecified\nbasis: actual\nquote: ten" in seen
    assert "scope: group\ngeography: unspecified\nbasis: estimate\nquote: " in seen and "needs_review" in seen and "different_scope" in seen


def test_cube_has_all_subtotals(spark):
    relations = spark.createDataFrame([(1, "x", None, 0.5), (2, "x", "r", 0.7), (3, "y", None, None), (9, "y", "r", 0.1)], "fact_a_id long, relation_type string, reason string, confidence double")
    facts = spark.createDataFrame([(1, "d"), (2, "d"), (3, "e")], "id long, document_id string")
    found = {(r.level, r.relation_type, r.reason, r.document_id): r.n for r in tables.relation_cube(relations, facts).collect()}
    rows = [("x", None, "d"), ("x", "r", "d"), ("y", None, "e"), ("y", "r", None)]
    want = Counter((level, *[None if level >> (2 - i) & 1 else v for i, v in enumerate(r)]) for r in rows for level in range(8))
    assert found == want


def test_reconciled_keeps_both_sides(spark):
    left = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "x", 1), (3, None, "x", 5)], "id long, k string, j string, v int")
    right = spark.createDataFrame([(7, "a", "x", 13), (8, None, "x", 5), (9, "c", "x", None)], "id long, k string, j string, v int")
    found = {(r.k, r.left_id, r.right_id, r.side, r.apart) for r in tables.reconciled(left, right, ["k", "j"], "v").collect()}
    assert found == {("a", 1, 7, "both", 3), ("b", 2, None, "left", None), (None, 3, None, "left", None), (None, None, 8, "right", None), ("c", None, 9, "right", None)}


def test_matrix_has_a_column_for_each_value(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("a", "p", 5.0), ("b", "other", 1.0)], "k string, c string, v double")
    assert sorted(map(tuple, tables.matrix(df, ["k"], "c", ["p", "q"], "v").collect())) == [("a", 5.0, 2.0), ("b", None, None)]


ODD = [(1, 'a "b", c\nd', 1.5), (2, "", None), (3, None, -2.0), (4, "é,;", 0.0)]


@pytest.mark.parametrize("kind", tabular.FORMATS)
def test_files_come_back_as_they_were(spark, tmp_path, kind):
    path, schema = str(tmp_path / kind), "id long, t string, v double"
    tabular.write(spark.createDataFrame(ODD, schema), path, kind)
    rows, rejected = tabular.read(spark, path, schema, kind)
    assert sorted(map(tuple, rows.collect())) == ODD and rejected.count() == 0
    tabular.write(spark.createDataFrame([], schema), path, kind)
    rows, rejected = tabular.read(spark, path, schema, kind)
    assert rows.columns == ["id", "t", "v"] and rows.count() == 0 and rejected.count() == 0


def test_lines_that_dont_fit_are_rejected(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,t,v\n1,a,2.5\n2,b\nthree,c,1\n4,d,1,9\n5,"e, f",\n6,g,x\n')
    rows, rejected = tabular.read(spark, str(tmp_path / "x.csv"), "id long, t string, v double")
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 2.5), (5, "e, f", None)]
    assert sorted(r.line for r in rejected.collect()) == ["2,b", "4,d,1,9", "6,g,x", "three,c,1"]
    with pytest.raises(ValueError):
        tabular.read(spark, "x", "id long", "xml")


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT bare_number('1,200'), is_year('1999'), is_year('2199'), numbers_of('b 2,000 a 7% 2,000'), match_form(' A’s  x '), page_text(' a  b \r\n\r\n\r\n\r\nc ')").first()
    assert tuple(row) == ("1200", True, False, ["2000", "7%"], "a's x", "a b\n\nc")
    rows = spark.sql("SELECT k, joined(position, number) AS found FROM VALUES (1, 'x 3 y 1,5 3'), (2, NULL), (3, 'none') t(k, v), LATERAL numbers(v) GROUP BY k").collect()
    assert {r.k: r.found for r in rows} == {1: "3 1,5 3"}
