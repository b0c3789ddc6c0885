"""Order-preserving packing against a plain dynamic program and the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import ordered_packing as packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_cost(places, penalties, capacity):
    cost = [0] * len(places)
    for j in range(1, len(places)):
        cost[j] = min(cost[i] + packing.padding(places[j] - places[i], capacity) for i in range(j) if places[j] - places[i] <= capacity) + penalties[j]
    return cost


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([0, 5, 40])), min_size=1, max_size=60), st.sampled_from([32, 64]))
def test_cuts_cost_least(steps, capacity):
    places, penalties = np.cumsum([0] + [n for n, _ in steps]), np.array([0] + [p for _, p in steps])
    cost, back_to = packing.cheapest_cuts(places, penalties, capacity)
    assert cost == plain_cost(places.tolist(), penalties.tolist(), capacity)
    cuts = packing.cuts_of(places, penalties, capacity, last=True).tolist()
    assert cuts[0] == 0 and cuts[-1] == places[-1] and all(0 < b - a <= capacity for a, b in zip(cuts, cuts[1:]))
    assert sum(packing.padding(b - a, capacity) + penalties[places.tolist().index(b)] for a, b in zip(cuts, cuts[1:])) == cost[-1]


ALPHABET = [*"abcDEZ éÉßñœŒÿ\n\t'sS.,!?-_0129²½ªºµ", "'LL", "’", "Σ", "σ", "İ", "ı", "中", "。", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "́", "\x1c", "\xa0", "\x85", "Ж", "ﬁ", "Ǆ", "ŉ", "ẞ", "😀", "×", "ʰ", "ɏ"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(texts):
    whole = Tokenizer.from_file(PATH)
    own = packing.words_of(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.code(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_tables_that_are_emptied_change_nothing(monkeypatch):
    own = packing.Words(PATH)
    texts = ["one two three", "four five", "one six. Seven", "", "two"] * 3
    want = own.code(texts)
    monkeypatch.setattr(packing, "MOST_WORDS", 2)
    assert [own.code([t])[0] for t in texts] == want


def texts():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(60)]
    prose = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", " ", ". ", "! ", "\n"]) for _ in range(n))
    return [None, "", " ", "one", "中文。" * 30, "x" * 9000, " ".join(words * 40), *[prose(draw.choice([3, 30, 300])) for _ in range(60)], prose(9000)]


def checked(rows, found, capacity):
    """Every id lies in one piece, pieces fill sequences without gaps and in the order of documents."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length > 0 and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces]).tolist()[:-1]] and sum(r.length for r in pieces) == len(ids[d])
    order = []
    for s in sorted(by_sequence):
        pieces = sorted(by_sequence[s], key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces]).tolist()[:-1]] and sum(r.length for r in pieces) <= capacity
        order += [(r.doc_id, r.start) for r in pieces]
    assert order == sorted(order)
    return [sum(r.length for r in v) for v in by_sequence.values()]


@pytest.mark.parametrize("capacity, block", [(256, None), (256, 3000), (4096, None)])
def test_pieces_hold_every_id_in_order(spark, monkeypatch, capacity, block):
    rows = list(enumerate(texts()))
    if block:
        # in the driver's process, since workers don't see the patch
        monkeypatch.setattr(packing, "BLOCK", block)
        monkeypatch.setattr(packing, "AHEAD", block // 4)
        own = packing.words_of(PATH)
        stretch, found = packing.Stretch(own.ends, capacity, 0), []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for d, t in rows:
            stretch.add(d, np.array([*np.frombuffer(own.code([t or ""])[0], "<u4"), 2], "<u4"))
            if stretch.held >= block:
                found += stretch.solve(last=False)
        found = [type("Piece", (), dict(zip(names, r))) for r in found + stretch.solve(last=True)]
    else:
        found = packing.pack_in_order(spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, length string, offset int, sequence_id string"), PATH, capacity=capacity).collect()
    sizes = checked(rows, found, capacity)
    assert sum(packing.padding(n, capacity) for n in sizes) < 0.05 * sum(sizes) + 4 * capacity


def test_sentences_are_where_cuts_fall():
    """Cuts inside a document are at sentence ends where sentences are short."""
    own = packing.words_of(PATH)
    draw = random.Random(8)
    text = " ".join(" ".join(draw.choices(["red", "green", "blue"], k=draw.randint(3, 9))) + "." for _ in range(500))
    stretch = packing.Stretch(own.ends, 256, 0)
    ids = np.array([*np.frombuffer(own.code([text])[0], "<u4"), 2], "<u4")
    stretch.add(1, ids)
    cuts = [r[1] for r in stretch.solve(last=True)][1:]
    dot = own.tokenizer.encode(".", add_special_tokens=False).ids[0]
    assert cuts and all(ids[c - 1] == dot for c in cuts)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert packing.pack_in_order(spark.createDataFrame([], schema), PATH).count() == 0
    rows = packing.pack_in_order(spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (None, None)], schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (0, 2), (3, 2), (3, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5
