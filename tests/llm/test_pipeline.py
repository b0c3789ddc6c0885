"""The pipeline against plain versions of its stages."""

import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import quality
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(8)
    words = ["".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(draw.choices(words, k=n))

    passage = "\n".join(prose(8).capitalize() + "." for _ in range(9))
    rows = []
    for i in range(160):
        text = ".\n".join(prose(draw.randint(10, 25)) for _ in range(4))
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 7 == 0:
            text = f"{text}.\n{passage}\n{prose(12)}"
        elif i % 11 == 0:
            text += ' token = "' + "".join(draw.choices("0123456789abcdef", k=40)) + '"'
        rows.append((i, text))
    rows += [(200, rows[1][1]), (201, rows[2][1].replace(rows[2][1].split(" ")[20], "changed", 1)), (202, "")]
    return rows


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d % 5 != 0), 0) for d, _ in rows if d < 160], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "secrets", "packing"]
    good = {r.doc_id for r in quality.scored(spark_docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect() if r.predicted}
    assert {d for d, _ in rows if d < 160 and d % 5} <= good and not {d for d in range(0, 160, 5)} & good
    kept = [(d, t) for d, t in rows if d in good]
    deduped = brute.deduplicated(kept)
    kept = [(d, deduped[d][0]) for d, _ in kept if deduped[d][0]]
    groups = brute.components(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d or not groups[d][0]]
    final = {}
    for d, t in kept:
        text, at = "", 0
        for span in filter(None, brute.base_spans(t).split(",")):
            start, end = map(int, span.split(":")[1:])
            if start >= at:
                text += t[at:start] + "[SECRET]"
                at = end
        final[d] = text + t[at:]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in final.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert len(ids) <= 1024
        want[d] = (len(ids), zlib.crc32(ids.tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == want
    assert len(want) < len(rows) - 32 and any(re.search(r"\[SECRET\]", t) for t in final.values())
    loads = {}
    for r in got:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 1024


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "a b c. d e f.\n", "en", "s", 14)], COLUMNS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns and left.count() == 2, name


def test_one_row_of_each_component_stays(spark):
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choices(string.ascii_lowercase, k=6)) for _ in range(60)) for _ in range(6)]
    near = [t + " end" for t in texts]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (None, near[1]), (3, texts[2]), (4, near[2]), (4, texts[3]), (None, texts[4]), (None, near[4]), (None, texts[4]), (5, texts[5]), (5, near[5]), (None, None), (None, None), (6, ""), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()]
    fixed = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[3]), (None, None), (None, None), (6, ""), (6, "")]
    rest = sorted((r for r in left if r not in fixed), key=str)
    assert sorted((r for r in left if r in fixed), key=str) == sorted(fixed, key=str)
    assert len(rest) == 2 and rest[0][0] == 5 and rest[0][1] in (texts[5], near[5]) and rest[1][0] is None and rest[1][1] in (texts[4], near[4])


HELPERS = (
    "_text _base _runs _candidates _scores _prose _spans spans _row _fence _fence_ _own _nth nth g_id g_hash b_id text_hash component_key component_id times _id _hash _units _bare _lines _at _later _gone _kept _wanted "
    "_windows chunk start n first_id first_hash low high parts _bucket _bit _bits _maybe score predicted held_out x y n_removed found key rest"
).split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Each stage gives back every column with its value, whatever its name, and so does a map column."""
    rows = [(i, t) for i, t in corpus()[:40]] + [(1, corpus()[1][1])]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *HELPERS]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), *[f"{c}:{d}" for c in HELPERS]) for d, t in rows], ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns))
    docs = docs.withColumn("pairs", corpus_pipeline.F.create_map("lang", "source"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns and left.schema["pairs"] == docs.schema["pairs"], name
        found = left.collect()
        assert found and all(r[c] == f"{c}:{r.doc_id}" for r in found for c in HELPERS) and all(r.pairs == {"en": "s"} for r in found), name
