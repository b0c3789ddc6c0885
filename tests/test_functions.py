import hashlib
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import coerce, normalize, text, vectors
from ledgerloom.operators import embed


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_entity(spark):
    cases = {"Bajaj Finance Ltd.": "bajaj finance", "M&M": "mahindra & mahindra", "  Acme,  Inc. ": "acme", "Company": "company", None: "", "": "", "Acme Pvt. Ltd. Holdings": "acme holdings"}
    assert values(spark, normalize.clean_entity, list(cases)) == list(cases.values())


def test_metric_unit_period_geography(spark):
    assert values(spark, normalize.canonical_metric, ["Revenue from operations", " EPS (INR) ", "Odd Metric (x)", "₹"]) == ["revenue", "eps", "odd_metric_x", ""]
    assert values(spark, normalize.canonical_unit, ["%", "Rs. crore", None, "", "₹", "Kilo Watts"]) == ["percent", "inr_crore", "unitless", "unitless", "", "kilo_watts"]
    assert values(spark, normalize.canonical_period, ["FY'24", "Q1 fy 2024", "FY123", "Q2 2023", " as of now ", "", None]) == ["FY2024", "Q1 FY2024", "FY123", "2023", "as of now", None, None]
    assert values(spark, normalize.canonical_geography, ["Indian", "U.S.", "South Asia", "", None]) == ["india", "united_states", "south_asia", None, None]
    assert values(spark, normalize.currency_of, ["Rs. crore", "US$", "eur mn", "%", None]) == ["INR", "USD", "EUR", None, None]


def test_value(spark):
    assert values(spark, normalize.numeric_value, ["8,993.6", "15.2%", "resigned", "(12)", ".5", "-1,000", "", None]) == [8993.6, 15.2, None, 12.0, 5.0, -1000.0, None, None]


def test_slug_is_idempotent(spark):
    once = values(spark, normalize.slug, ["A b--C", "__x__", "é1", ""])
    assert values(spark, normalize.slug, once) == once


def test_normalized_row(spark):
    df = spark.createDataFrame([("Acme", "Revenue", "1,234.5", "INR crore", "FY24", None, "India"), ("Acme", "₹", "1", None, None, None, None), ("Acme", "Revenue", "none", None, None, None, None)], "entity string, metric string, value string, unit string, period string, scope string, geography string")
    rows = normalize.normalized(df).collect()
    assert (rows[0].norm_metric, rows[0].norm_value, rows[0].norm_unit, rows[0].norm_currency, rows[0].norm_geography, rows[0].norm_period, rows[0].norm_scope) == ("revenue", 1234.5, "inr_crore", "INR", "india", "FY2024", "unspecified")
    assert rows[1].norm_metric is None and rows[2].norm_value is None and rows[2].norm_entity is None


def test_coercions(spark):
    assert values(spark, coerce.confidence, [" HIGH ", "x", None]) == ["high", "medium", "medium"]
    assert values(spark, coerce.reporting_basis, ["Reported", "E", "guidance", "TP", "odd", "", None]) == ["actual", "estimate", "forecast", "target", "odd", "actual", "actual"]
    assert values(spark, coerce.numeric_confidence, ["85", "3", "-1", "nan", "bad", None, "0.4"]) == [0.85, 1.0, 0.0, 0.6, 0.6, 0.6, 0.4]
    assert values(spark, coerce.relation_type, ["Needs Review", "corroborated", "contradicts", "reconcile", "what"]) == ["needs_review", "corroborates", "contradicts", "reconcilable", "unrelated"]
    assert values(spark, coerce.reason, ["unit definition", "Different-Unit", "actual vs estimate", "", "different_scope", "x"]) == ["different_definition", "different_unit", "actual_vs_estimate", "none", "different_scope", "none"]


def test_page_text(spark):
    raw = " a\t\tb \r\n\r\n\r\n\r\n c d \r e "
    assert values(spark, text.clean_page_text, [raw, None, "\n\n"]) == ["a b\n\nc d\ne", "", ""]
    good = "Revenue grew 12% in FY2024 to INR 500 crore."
    assert values(spark, text.is_candidate_page, [good, "Table of contents and nothing else here", "Rev 1", None]) == [True, False, False, False]


def test_numbers_and_match_form(spark):
    assert values(spark, text.numbers, ["up 1,000 or 12.5% and 12.5%", "none", None]) == [["1000", "12.5%"], [], []]
    assert values(spark, text.match_form, ["ﬁnance – “10²”\n X", None]) == ['finance - "102" x', ""]
    assert values(spark, text.without_fences, ['```json\n{"a": 1}\n```', "[1]"]) == ['{"a": 1}', "[1]"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, 0.0, 0.0]
    assert values(spark, vectors.as_vector, ["[1, 2]", "[0, 0]", "oops", "", None, "[1, null]"]) == [[1.0, 2.0], None, None, None, None, None]
    assert values(spark, lambda c: vectors.is_usable(c, 2), [[1.0, 2.0], [math.nan, 1.0], [0.0, 0.0], [1.0], None], "array<double>") == [True, False, False, False, False]


@pytest.mark.parametrize("words", ["net sales rose 5 percent", "", "a a b A", "x" * 50])
def test_hashed_embedding(spark, words):
    want = [0.0] * vectors.DIMENSION
    for token in words.lower().split():
        h = int(hashlib.sha256(token.encode()).hexdigest(), 16)
        want[h % vectors.DIMENSION] += 1.0 if (h // vectors.DIMENSION) % 2 == 0 else -1.0
    size = math.sqrt(sum(x * x for x in want)) or 1.0
    got = values(spark, vectors.hashed_embedding, [words])[0]
    assert got == pytest.approx([x / size for x in want])
    assert vectors.counts_of(words) == want


def test_composition_only_where_it_may_change(spark):
    """Composed texts don't go to Python; all others do, also those that compose with a neighbour only."""
    odd = ["plain", "Größe “ñ” — ж 中文 かな", "e\u0301", "\ufb01n", "\u1100\u1161\u11a8", "\uac00\u11a8", "か\u3099", "①", "\u0915\u093c", "𝐀𝟙", "a\u0327\u0301", "\u09c7\u09be", "", None, "Ａ\u00a0b"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    found = {r.i: (r.done, r.sent) for r in rows.select("i", text.nfkc(F.col("t")).alias("done"), F.col("t").rlike(text.CHANGING).alias("sent")).collect()}
    for i, t in enumerate(odd):
        assert found[i][0] == (None if t is None else unicodedata.normalize("NFKC", t)), t
    assert [found[i][1] for i in (0, 12)] == [False, False] and all(found[i][1] for i in range(2, 12))
    draw = random.Random(7)
    mixed = ["".join(chr(draw.choice([draw.randrange(1, 0xD800), draw.randrange(0x300, 0x370), draw.randrange(32, 127)])) for _ in range(6)) for _ in range(400)]
    mixed = [t for t in mixed if all(unicodedata.category(c) != "Cn" for c in t)]
    rows = spark.createDataFrame([(t,) for t in mixed], "t string")
    assert all(r.done == unicodedata.normalize("NFKC", r.t) for r in rows.select("t", text.nfkc(F.col("t")).alias("done")).collect())


def test_slot_rows_are_the_hashed_counts(spark, monkeypatch):
    monkeypatch.setattr(embed, "MOST_AT_ONCE", 50)
    draw = random.Random(3)
    texts = [None, "", " - ", "Ünï", "a a b", *[" ".join(draw.choices([f"w{i}" for i in range(90)], k=draw.randrange(200))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    want = sorted((i, at, int(v)) for i, t in enumerate(texts) for at, v in enumerate(vectors.counts_of(t or "")) if v)
    found = embed.slot_rows(df, "doc_id", F.col("t"))
    assert sorted(map(tuple, found.collect())) == want
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()
