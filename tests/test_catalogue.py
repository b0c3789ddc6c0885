import glob
import math
import os
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import vectors
from ledgerloom.plans import catalogue
from ledgerloom.plans.inputs import facts

SF = "/root/testdata/sf0.001"
NAMES = ["relation_summary", "normalize_entity", "normalize_period", "coerced", "clean_text", "bm25_topk", "hash_embedding", "dedupe_content_hash", "stream_daily_counts", "set_ops"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def best_by_brute_force(fact, rows):
    """[(id, score rounded)]: the five best candidates of one fact, by plain loops over all facts."""
    rows = [r | {"norm_entity": r["norm_entity"] or r["entity"].lower()} for r in rows]
    fact = next(r for r in rows if r["id"] == fact["id"])

    def words(r):
        fields = ("entity", "metric", "value", "unit", "period", "scope", "geography", "reporting_basis", "quote")
        return re.findall("[a-z0-9]+", " ".join(r[f] or "" for f in fields).lower())

    def vector(r):
        return vectors.counts_of(" | ".join(r[f] or "" for f in ("entity", "metric", "value", "unit", "period", "scope", "quote")))

    others = [r for r in rows if r["document_id"] != fact["document_id"]]
    pool = [r for r in others if r["norm_entity"] == fact["norm_entity"]] or others
    tier = {r["id"]: int(not (fact["norm_metric"] and fact["norm_metric"] == r["norm_metric"])) for r in pool}
    bags, asked, own = {r["id"]: Counter(words(r)) for r in pool}, Counter(words(fact)), vector(fact)
    average = sum(sum(b.values()) for b in bags.values()) / len(bags)
    near, lexical = {}, {}
    for r in pool:
        other, bag = vector(r), bags[r["id"]]
        near[r["id"]] = sum(x * y for x, y in zip(own, other)) / math.sqrt(sum(x * x for x in own) * sum(y * y for y in other))
        for word, times in asked.items():
            df, tf = sum(word in b for b in bags.values()), bag[word]
            term = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(bag.values()) / average)) * times
            lexical[r["id"]] = lexical.get(r["id"], 0) + term

    def places(scores):
        order = sorted(scores, key=lambda i: (-round(scores[i], 9), tier[i], i))[:20]
        return {i: n for n, i in enumerate(order, 1)}

    v, w = places({i: s for i, s in near.items() if s >= 0.45}), places({i: s for i, s in lexical.items() if s > 0})
    scores = {}
    for r in pool:
        if r["id"] in v or r["id"] in w:
            equal = [b for f, b in (("norm_entity", 0.15), ("norm_metric", 0.2), ("norm_period", 0.1), ("norm_scope", 0.05)) if fact[f] and fact[f] != "unspecified" and fact[f] == r[f]]
            scores[r["id"]] = sum(equal) + sum(1 / (60 + found[r["id"]]) for found in (v, w) if r["id"] in found)
    best = sorted(scores, key=lambda i: (-round(scores[i], 9), v.get(i, 99), w.get(i, 99), i))[:5]
    return [(i, round(scores[i], 6)) for i in best]


def test_every_fact_gets_its_candidates(spark):
    rows = [r.asDict() for r in facts(spark, SF).collect()]
    found = defaultdict(dict)
    for r in catalogue.QUERIES["retrieve_candidates"](spark, SF).collect():
        found[r.fact_id][r["rank"]] = (r.cand_id, r.score)
    assert {r["document_id"] for r in rows} == {"orders", "lines", "review"} and set(found) == {r["id"] for r in rows}
    for fact in rows[::7]:
        got = [found[fact["id"]][n] for n in sorted(found[fact["id"]])]
        want = best_by_brute_force(fact, rows)
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_quotes_and_embeddings_see_every_document(spark, tmp_path):
    quote = "The caf\u00e9\u2019s total revenue for the year was 100 crore, and it was audited by the of\ufb01ce"
    plain = unicodedata.normalize("NFKC", quote)
    texts = [None, "", "nothing here", f"x {plain} y", unicodedata.normalize("NFD", plain), f"x {plain[:-9]} y", f"x {plain[:40]} y", plain.upper() + " again" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("src1")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, quote), (2, " "), (21, "nothing here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.item_id, r.doc_id): r.exact for r in catalogue.QUERIES["quote_window"](spark, str(tmp_path)).collect()}
    assert found == {(1, 3): True, (1, 4): True, (1, 5): False, (1, 7): True}
    assert {(r.item_id, r.doc_id) for r in catalogue.QUERIES["quote_exact"](spark, str(tmp_path)).where("item_id = 1").collect()} == {(1, 3), (1, 4), (1, 7)}
    assert {r.fact_id: r.n_hits for r in catalogue.QUERIES["evidence_status"](spark, str(tmp_path)).collect()}[1] == 4
    slots = defaultdict(dict)
    for r in catalogue.QUERIES["hash_embedding_documents"](spark, str(tmp_path)).collect():
        slots[r.doc_id][r.slot] = r.v
    assert all(slots[d] == {i: v for i, v in enumerate(vectors.counts_of(t or "")) if v} for d, t in enumerate(texts))


@pytest.mark.parametrize("name", ["hash_embedding_documents", "quote_exact"])
def test_equals_sql_on_documents(spark, duck, name):
    test_equals_sql(spark, duck, name)
