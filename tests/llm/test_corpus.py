"""Operators across documents and pages: archives, filters, deduplication, secrets, the pipeline."""

import base64
import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, line_dedup, secret_scan, url_lists, warc
from tests.llm import brute

random.seed(11)
WORDS = ["".join(random.choices(string.ascii_lowercase, k=random.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


def near(text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[random.randrange(len(words))] = random.choice(WORDS)
    return " ".join(words)


def near_copies():
    rows = ["", None, "  ", "one two", "ONE\ttwo", "one two three", "a b c d e", "a b c d e f", "a b c d e f g h", "a b c d e f g h i", "A B C D E F G H I J"]
    for size in (9, 12, 20, 40, 90, 200, 700):
        base = prose(size)
        rows += [base, base.upper()] + [near(base, c) for c in (1, 1, 2, 3)]
    crowd = prose(120)
    rows += [near(crowd, random.randint(0, 3)) for _ in range(90)]
    common = prose(9)
    rows += [common + " " + prose(random.randint(3, 8)) for _ in range(80)]
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(docs).collect()}
    assert got == brute.components(rows)


def test_sets_can_be_compared_on_all_shingles(spark):
    base = prose(60)
    rows = [(0, base), (1, near(base, 1)), (2, prose(44)), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.component_id) for r in jaccard.component_ids(docs, by_shingles=True).collect()]
    assert sorted(found, key=str) == [(0, 0), (1, 0), (2, 2), (None, 0)]
    assert jaccard.component_ids(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [5, 6, 8, 9, 15, 16, 33, 64, 150, 700])
def test_linked_sets_share_a_signature(size):
    draw = np.random.default_rng(size)
    for _ in range(40):
        a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        most = (len(a) * 2) // 9
        gone = draw.integers(0, most + 1) if most else 0
        b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2**63, max(0, most - gone)).astype(np.uint64)]))
        if not jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)) or min(len(a), len(b)) < jaccard.SMALLEST:
            continue
        found = []
        for s in (a, b):
            number = jaccard.band(len(s))
            schemes = [number] + ([number + 1] if 5 * len(s) >= 4 * jaccard.band_edges(number + 1)[0] else [])
            assert not jaccard.too_few(s, number, len(jaccard.signatures(s, number)[0]))
            found.append(np.concatenate([jaccard.signatures(s, n)[0] for n in schemes]))
        assert len(np.intersect1d(*found))


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "x " * 5000, "a b c d e f"]
    alone, together = jaccard.shingle_sets(texts[:1])[0], jaccard.shingle_sets(texts)
    assert (alone == together[0]).all() and (alone == together[2]).all()


def passages():
    shared = "\n".join(prose(random.randint(4, 12)).capitalize() + "." for _ in range(14))
    rows = [prose(30) + ".\n" + prose(12) + ".\n" + shared + "\n" + prose(25) + "." for _ in range(6)]
    rows += [shared.replace("\n", " "), None, "", "\n", "\n\n\n\n", "single line", "single line", rows[0], rows[0] + "\n" + rows[0]]
    rows += ["ünï\r\ncode lines. Here! And\there? Yes.\r\n" * 4, "la la.\n" * 50, prose(40)]
    return list(enumerate(rows))


def test_line_dedup_equals_brute_force(spark):
    rows = passages()
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, chunk string, _lines int")
    found = line_dedup.deduplicated(docs, counts=True).collect()
    want = brute.deduplicated(rows)
    assert {r.doc_id: (r.text or "", r.n_removed) for r in found} == want
    assert [r.text for r in found if r.doc_id == 7] == [None] and found[0].chunk == "c"
    assert sum(n for _, n in want.values()) > 60
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def long_passages():
    draw, rows = random.Random(5), []
    for _ in range(40):
        passage = [" ".join(draw.choices(WORDS, k=draw.randint(1, 30))) + "." for _ in range(draw.randint(1, 9))]
        rows += ["\n".join([" ".join(draw.choices(WORDS, k=9)) + ".", end.join(passage[draw.randint(0, 1) :]), " ".join(draw.choices(WORDS, k=7)) + "."]) for end in "\n \n"]
    line, blanks = " ".join(WORDS[:51]), "\n\n" + "\n\n".join(rows[3].split("\n"))
    rows += [line, line + "\n\nend", " ".join(WORDS[:50]), " ".join(WORDS[:50]), None, "", "\n \n", "la la.\n" * 90, rows[0] + "\n" + rows[0], blanks, blanks]
    return list(enumerate(rows))


def test_long_passages_are_removed(spark):
    rows = long_passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.text or "", r.n_removed) for r in line_dedup.deduplicated(docs, counts=True).collect()}
    assert found == brute.deduplicated(rows)
    want = brute.repeated_passages(rows)
    # all but lines that share a chunk with what is around a passage
    assert sum(min(found[d][1], len(want[d])) for d, _ in rows) >= 0.95 * sum(map(len, want.values())) > 200
    assert sum(found[d][1] > 0 for d, _ in rows if want[d]) >= 0.97 * sum(len(w) > 0 for w in want.values())
    assert want[121] == {0} and found[121][1] and not want[123]


@pytest.mark.parametrize("size", [4, 8, 12])
def test_passages_of_few_lines_are_found(spark, size):
    draw = random.Random(size)
    rows = []
    for _ in range(60):
        passage = " ".join(" ".join(draw.choices(WORDS, k=draw.randint(4, 14))) + "." for _ in range(size))
        for _ in range(2):
            # pasted into the middle of sentences
            rows.append(" ".join(draw.choices(WORDS, k=30)) + " " + passage + " " + " ".join(draw.choices(WORDS, k=30)) + ".")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(docs, counts=True).collect()}
    assert not any(found[d] for d in range(0, 120, 2))
    assert sum(found[d] > 0 for d in range(1, 120, 2)) >= 58 and sum(found[d] for d in range(1, 120, 2)) >= 60 * (size - 2)


def test_windows_of_short_lines_and_marks(spark):
    rows = [(0, "a b.\nc.\n\nd e f g h i j k l m n o p q r.\nx.\nyes it is so here.\n"), (1, "new.\nc.\nd e f g h i j k l m n o p q r.\n\nx.\nyes it is so here.\nend"), (2, "q\u0001. r\u0001! s"), (3, "x" * 30 + ".\n" + "y.\n" * 70), (4, "z\n" + "y.\n" * 70 + "x" * 30 + ".")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_removed int")
    found = line_dedup.deduplicated(docs, counts=True)
    assert found.columns == ["doc_id", "text", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in found.collect()} == brute.deduplicated(rows)
    assert line_dedup.deduplicated(docs).columns == docs.columns


def test_repeated_rows_share_one_decision(spark):
    text = "\n".join(prose(6) for _ in range(12))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "\nend")], "doc_id long, text string")
    left = sorted(((r.doc_id or -1, len(r.text)) for r in line_dedup.deduplicated(docs).collect()))
    assert left[0][1] == len(text) and left[1] == left[2] and left[1][1] < len(text)


SECRETS = [
    None, "", "no secret here", "token=secret=abcdefghijk", 'Password : "abcdefgh"', "token: secret: abcdefghij", "api_key=short", "APIKEY='x9-_=/+.zz'", "AKIAABCDEFGHIJKL AKIAABCDEFGHIJK", "x" + "0a" * 16 + "G" + "f" * 31,
    "é😀 token = 0123456789abcdef0123456789abcdef!", "passwd=aaaaaaaa passwd=aaaaaaab",
]


def test_secrets(spark):
    draw = random.Random(3)
    keys = ["".join(draw.choices(string.ascii_letters + string.digits + "+/", k=44)) for _ in range(4)]
    plain = ["internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the-quick-brown-fox-jumps-over-the-lazy-dog", "abcdefghijklmnopqrstuvwxyz"]
    rows = list(enumerate(SECRETS + [f"a key {k} in text" for k in keys] + [f"a word {p} in text" for p in plain] + [prose(300)]))
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    for d, t in rows:
        base = brute.base_spans(t or "")
        assert found[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (found[d].n_assign, found[d].n_access, found[d].n_hex) == tuple(base.count(k) for k in ("assign", "access", "hex"))
        assert ",".join(s for s in found[d].spans.split(",") if not s.startswith("random")) == base
    n = len(SECRETS)
    assert [found[d].n_random for d in range(n, n + 4)] == [1] * 4
    assert [found[d].n_random for d in range(n + 4, n + 9)] == [0] * 5
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert clean[n] == "a key [SECRET] in text" and clean[2] == SECRETS[2] and clean[0] is None
    assert clean[10] == "é😀 [SECRET]!" and clean[11] == "[SECRET] [SECRET]"
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_random_strings_of_narrow_alphabets_are_found(spark):
    draw = random.Random(9)
    alphabets = (string.ascii_lowercase + "234567", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits)
    keys = ["".join(draw.choices(a, k=n)) for a in alphabets for n in (40, 64) for _ in range(25)]
    plain = ["internationalization", "the/path/of/chapter12/and/section34", "abcdefghijklmnopqrstuvwxyz", "version2version2version2version2"] * 10
    docs = spark.createDataFrame([(d, f"a run {t} in text") for d, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {r.doc_id: r.n_random for r in secret_scan.scan(docs).collect()}
    assert all(sum(found[d] for d in range(at, at + 25)) >= 23 for at in range(0, len(keys), 25))
    assert not any(found[d] for d in range(len(keys), len(found)))


def test_prose_model_is_of_all_text(spark, monkeypatch):
    draw = random.Random(13)
    texts = [None, "", " . ", "x" * 21, "ab cd" * 8000]
    for size in (22, 23, 27, 28, 29, 50, 51, 90, 91, 154, 155, 250, 272, 345, 346, 347, 500, 595, 596, 597, 900, 5000):
        letters = "".join(draw.choices("eeeetttaaoinshrdlu" + draw.choice(["", "EMN", "0123456789", "-/+_="]), k=size))
        key = "".join(draw.choices(string.ascii_letters + string.digits, k=30))
        words = " ".join(letters[at : at + 7] for at in range(0, size, 7))
        texts += [words, words.replace(" ", ",\n", 3) + f" é {key}."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    models, rule = [], secret_scan.thresholds
    monkeypatch.setattr(secret_scan, "thresholds", lambda scores, model: models.append(model) or rule(scores, model))
    secret_scan.scan(docs).count()
    want = brute.prose_model([t or "" for t in texts])
    assert len(models) == 1 and models[0].keys() == want.keys()
    for band, tests in want.items():
        for test, (mean, spread) in tests.items():
            assert models[0][band][test][:2] == pytest.approx((mean, max(spread, 0.02)), rel=1e-9), (band, test)


def page_rows():
    fake = "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n broken"
    htmls = [None, "", "same", "same", fake, fake, "héllo 😀", "x" * 3000, "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"]
    return [(i, f"http://h{i}.org/\n", h) for i, h in enumerate(htmls)] + [(None, None, "same"), (2, "again", "same")]


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_warc(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "OVERLAP", 700 if block == 500 else 1 << 20)
    monkeypatch.setattr(warc, "PER_FILE", 4)
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archived(pages).collect()), key=str)
    want = []
    for page, _, html in page_rows():
        data = (html or "").encode()
        first = min(p for p, _, h in page_rows() if p is not None and (h or "") == (html or ""))
        kind = ("response", None) if page == first else ("revisit", first)
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses_and_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    kinds = {(r.page_id, r.record_type) for r in warc.archived(pages, least=5).collect()}
    assert (3, "response") in kinds and (5, "revisit") in kinds
    assert warc.archived(pages.limit(0)).count() == 0
    path = tmp_path / "cut"
    warc.write_archives(pages.coalesce(1), str(path))
    for part in path.glob("part-*"):
        part.write_bytes(part.read_bytes()[:-3])
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="damaged"):
        warc.read_archives(spark, str(path))


def test_large_pages_and_wrong_digests(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "LARGE", 200)
    monkeypatch.setattr(warc, "FILE_BYTES", 7000)
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    assert warc.archived(pages).count() == len(page_rows())
    path = tmp_path / "wrong"
    warc.write_archives(pages.coalesce(1), str(path))
    assert len(list(path.glob("part-*"))) >= 2
    for part in path.glob("part-*"):
        part.write_bytes(part.read_bytes().replace(b"xxx", b"xxy"))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="digest"):
        warc.read_archives(spark, str(path)).count()


def test_reachable_follows_only_the_chain():
    at, following = np.array([0, 10, 15, 30, 35]), np.array([10, 30, 35, 50, 50])
    assert warc.reachable(at, following).tolist() == [True, True, False, True, False]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]
    long = np.arange(0, 70_000, 7)
    assert warc.reachable(long, long + 7).all()


def test_url_lists(spark, monkeypatch):
    monkeypatch.setattr(url_lists, "PER_SALT", 2)
    entries = spark.createDataFrame(
        [("bad.org", "2024-01-10", "add"), ("bad.org", "2024-02-10", "remove"), ("bad.org", "2024-02-10", "add"), ("bad.org", "2024-03-01", "remove"), ("www.bad.org/p", "2024-01-01", "add"), (None, "2024-01-01", "add"), ("x.com", "2024-01-01", "odd"), ("late.net", None, "add")],
        "key string, day string, action string",
    ).withColumn("day", F.col("day").cast("date"))
    urls = [("http://bad.org/a", "2024-01-09"), ("http://bad.org/a", "2024-01-10"), ("https://u@WWW.Bad.org:8/q", "2024-02-20"), ("http://bad.org", "2024-03-01"), ("http://www.bad.org/p/x", "2024-01-15"), ("nonsense", "2024-01-15"), (None, "2024-01-15"), ("http://bad.org/z", None), ("http://x.com/", "2024-05-01"), ("http://bad.org/a", "2024-01-10")]
    captures = spark.createDataFrame([(i % 9, u, f) for i, (u, f) in enumerate(urls)], "page_id int, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    got = sorted(((r.page_id, r.listed, r.list_key, str(r.listed_since), str(r.listed_until)) for r in url_lists.evaluate(captures, entries).collect()), key=str)
    hit = ("bad.org", "2024-01-10", "2024-03-01")
    none = (False, None, "None", "None")
    want = [(0, *none), (0, True, *hit), (1, True, *hit), (2, True, *hit), (3, *none), (4, True, "www.bad.org/p", "2024-01-01", "None"), (5, *none), (6, *none), (7, *none), (8, *none)]
    assert got == sorted(want, key=str)
    assert url_lists.evaluate(captures, entries.limit(0)).where("listed").count() == 0
