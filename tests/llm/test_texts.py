"""Operators on whole texts: media, sketches, pieces, packing, quality."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import iblt, media, packing, pieces, quality
from ledgerloom.llm.runtime import arrow_map

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "x▁y ▁", "日本語 テキスト 😀", "\n\n", "tab\tand\r\nlines \n x", "\x00 nul", "it's don't 's", "<s> </s> <|endoftext|> end", "a <|endoftext|> b",
    "word " * 3000, "z" * 5000, "the same text", "the same text", "é" * 70 + " ﬁ ½",
]
EXTRA = "doc_id long, text string, lang string, x string, feature string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "x", "f", "k") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, EXTRA)


def known(doc_id):
    return "no id" if doc_id is None else TEXTS[doc_id] or ""


def test_media(docs):
    rows = media.media_features(docs, keep_media=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        data = known(r.doc_id).encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_wav(bytes(r.media)) == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert r.pair_times == sorted(r.pair_times) and len(r.feature) == 16 * len(r.pair_times)
    assert len({r.feature for r in rows if known(r.doc_id) == "the same text"}) == 1
    assert media.media_features(docs.limit(0)).count() == 0


def test_peak_pairs_equal_plain_version():
    draw = np.random.default_rng(3)
    for size in (64, 512, 576, 1984):
        payload = draw.integers(0, 256, size).astype(np.uint8)
        wave = [float(x) - 128 for x in payload] + [0.0] * (-size % 256 if size > 512 else 512 - size)
        window = [0.5 - 0.5 * np.cos(2 * np.pi * i / 511) for i in range(512)]
        turns = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512)
        power = [abs(turns @ np.array([a * b for a, b in zip(wave[at : at + 512], window)])) for at in range(0, len(wave) - 511, 256)]
        peaks = []
        for t, row in enumerate(power):
            for a, b in zip(media.BANDS, media.BANDS[1:]):
                best = a + int(np.argmax(row[a:b]))
                others = [max(power[u][a:b]) if 0 <= u < len(power) else 0 for u in (t - 1, t + 1)]
                if row[best] > 1e-3 and row[best] >= others[0] and row[best] > others[1]:
                    peaks.append((t, best))
        pairs = sorted((t, f << 15 | g << 6 | u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN_OUT] if u - t <= 63)
        times, codes = media.fingerprint(payload.tobytes())
        assert list(zip(times.tolist(), codes.tolist())) == pairs and pairs


def test_frames_cover_the_whole_payload():
    draw = np.random.default_rng(4)
    for size in range(64, 2100, 64):
        payload = draw.integers(1, 255, size).astype(np.uint8)
        _, sizes = media.band_peaks(payload.tobytes())
        assert len(sizes) == 1 + max(0, -(-(size - 512) // 256))
        payload[-60:-4] = 128
        assert not np.array_equal(media.band_peaks(payload.tobytes())[1][-1], sizes[-1])


def test_pieces(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in pieces.encode_pieces(docs, PIECES).collect():
        ids = model.encode(known(r.doc_id))
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == model.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(docs.limit(0), PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab ▁\n.é日\t<>0"), max_size=40))
def test_any_text_encodes_as_the_libraries_do(text):
    codec = pieces.codec(PIECES)
    ids = codec.model.encode(text)
    assert codec.code([text]) == [(len(ids), ",".join(map(str, ids)), codec.model.decode(ids))]
    own = packing.coder(BPE, RANKS)
    assert own.code([text]) == own.whole([text])


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_WORDS", 5)
    codec = pieces.PieceCodec(PIECES)
    for text in ("a b c", "d e f g h i j", "a b"):
        assert codec.code([text])[0][1] == ",".join(map(str, codec.model.encode(text)))


def test_packing(docs):
    tokenizer = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(docs, BPE, RANKS).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(TEXTS) + 1
    for doc_id, own in by_doc.items():
        ids = [*tokenizer.encode(known(doc_id), add_special_tokens=False).ids, 2]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and (len(own) > 1) == (len(ids) > 1024)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(docs.limit(0), BPE, RANKS).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 3000), max_size=30))
def test_plan_uses_every_piece(histogram):
    plan = packing.plan_packing(histogram, 64)
    used = Counter()
    for config, n in plan:
        assert sum(length * x for length, x in config.items()) <= 64
        for length, x in config.items():
            used[length] += n * x
    assert used == Counter(histogram)
    counts = np.array([histogram.get(i, 0) for i in range(65)])
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit([], counts, 64))


@pytest.mark.parametrize("times", [1, 25, 100_000])
def test_plan_is_the_linear_programs(times):
    draw = np.random.default_rng(6)
    lengths = np.concatenate([draw.integers(1, 1025, 6000), np.minimum(draw.geometric(0.004, 4000), 1024)])
    histogram = {int(k): int(n) * times for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan, bound, began = packing.planned(histogram, 1024)
    total, full = sum(n for _, n in plan), histogram.get(1024, 0)
    counts = np.array([histogram.get(i, 0) for i in range(1025)])
    assert began - full >= 0.95 * (total - full)
    assert total <= sum(n for _, n in packing.best_fit([], counts, 1024))
    assert sum(k * n for k, n in histogram.items()) / 1024 <= bound <= total <= max(np.ceil(bound), 1.001 * bound)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4))
def test_bound_is_below_every_packing(histogram):
    """The prices' bound against the least number of sequences by exhaustive search."""
    pieces = sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True)
    plan, bound, _ = packing.planned(histogram, 12)

    def fits(n, rooms=None, at=0):
        rooms = rooms or [12] * n
        if at == len(pieces):
            return True
        return any(fits(n, [*rooms[:i], rooms[i] - pieces[at], *rooms[i + 1 :]], at + 1) for i in {r: i for i, r in enumerate(rooms)}.values() if rooms[i] >= pieces[at])

    total = sum(n for _, n in plan)
    least = next(n for n in range(1, total + 1) if fits(n))
    assert bound <= least + 1e-6 and total <= least + 1


def test_tables_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MOST_TABLE", 40)
    own = packing.WordCoder(BPE, RANKS)
    for text in ("x" * 50 + " a b", "c d", "x" * 50):
        assert own.code([text]) == own.whole([text])
    assert len(own.table) <= 3
    monkeypatch.setattr(pieces, "MOST_TABLE", 40)
    codec = pieces.PieceCodec(PIECES)
    for text in ("x" * 50 + " a b", "c d", "x" * 50):
        assert codec.code([text])[0][1] == ",".join(map(str, codec.model.encode(text)))
    assert len(codec.ids) <= 4


def test_batches_are_bounded_by_bytes(spark):
    """A batch for Python has a few MB, however long its rows are, and every row comes once."""

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "held"])

    rows = spark.range(0, 61, 1, 1).select(F.expr("repeat('x', if(id = 60, 9000000, 500000))").alias("text"))
    batches = arrow_map(rows, seen, "n long, held long").collect()
    assert sum(b.n for b in batches) == 61
    assert sum(b.held for b in batches) >= 60 * 500_000 + 9_000_000
    assert max(b.held for b in batches) < 9_000_000 + 2 * (4 << 20)
    assert sorted(b.held for b in batches)[-2] < 2 * (4 << 20)


def test_fingerprints(docs, spark):
    order = sorted((i for i in range(len(TEXTS))), reverse=True) + [None]
    rows = {r.doc_id: r for r in iblt.fingerprints(docs, keep_difference=True).collect()}
    assert len(rows) == len(order)
    for i, doc_id in enumerate(order):
        text, after = known(doc_id), known(order[(i + 1) % len(order)])
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        r, a, b, c = rows[doc_id], *(set(iblt.digests(t).tolist()) for t in (text, changed, after))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
        assert {x % 2**64 for x in r.only_before} == a - b and {x % 2**64 for x in r.only_after} == b - a
        assert len(base64.b64decode(r.fingerprint)) == 16 * iblt.CELLS
    assert rows[18].fingerprint == rows[19].fingerprint
    assert iblt.fingerprints(docs.limit(0)).count() == 0
    one = iblt.fingerprints(spark.createDataFrame([(5, "abc. def")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_short_texts_are_like_their_edited_versions(spark):
    text = "one sentence of a few words without any line, and no other sentence after it to the end of the text"
    rows = [(2, text), (1, "something else entirely, with other words in each and every place of this line here")]
    found = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(r.near_edited > 0.3 and r.near_next < 0.2 for r in found)


def test_peeling_recovers_differences_and_retries():
    draw = np.random.default_rng(1)
    left = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 3, 40, 4000)]
    right = [np.unique(np.concatenate([s[: len(s) // 2], draw.integers(0, 2**63, 5).astype(np.uint64)])) for s in left]
    for a, b, (x, y) in zip(left, right, iblt.differences(left, right)):
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist()) and set(y.tolist()) == set(b.tolist()) - set(a.tolist())


def test_quality(spark):
    random.seed(5)
    words = "the of and region metric answer value long short very".split()

    def make(good):
        text = " ".join(random.choice(words) for _ in range(random.randint(20, 80)))
        return text if good else text.upper().replace(" ", "!! ")

    truth = [i % 4 != 0 for i in range(400)]
    docs = spark.createDataFrame([(i, make(g), "x") for i, g in enumerate(truth)] + [(1000, "", "y"), (1001, None, "y"), (None, "no id", "y")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(truth)] + [(None, 1, 0), (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in set(held)) for i in range(400))
    assert sum(rows[i].predicted == int(truth[i]) for i in held) / len(held) > 0.95
    nothing = quality.scored(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in nothing] == [0.5]
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert y.tolist() == [0.0, 0.5, 1.0] and np.allclose(x, [0.1, 0.25, 0.4])


def test_shuffled_columns_do_not_matter(docs):
    turned = docs.select("key", "text", "feature", "doc_id").withColumn("n_tokens", F.lit("clash"))
    assert pieces.encode_pieces(turned, PIECES, keep_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
