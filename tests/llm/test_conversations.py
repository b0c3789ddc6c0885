"""Prefix trie and structure repair of conversations against plain versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import prefix_trie, queries, structure_repair

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, key string, parent string, head string, _range int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made_rows(seed=5):
    """Conversations with shared beginnings, copies, ties, nulls, repeats, gaps and one long one with a long copy."""
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", None, "", "tool"], ["hello there", "a b\tc", "", None, " \n", "done.", "really?", "done."]
    rows = []
    for conv in [*range(-25, 65), 400, 2**40]:
        if conv % 17 == 3:
            continue
        for turn in range(draw.choice([1, 1, 2, 3, 5, 8])):
            rows.append((conv, draw.choice([turn, turn, turn + 2, None]), draw.choice(roles[: draw.choice([2, 6])]), draw.choice(texts)))
    common = [(t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(30)]
    for conv in (1000, 1001, 1017, 1018, 1019, 1040):
        rows += [(conv, *r) for r in common[: 30 if conv != 1017 else 24]]
    rows += [(1060, t, "user", "same") for t in range(3)] * 2  # repeated rows
    rows += [(5000 + 20 * i, 0, "user", "hi") for i in range(70)]  # a group of copies
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", "h", 1) for r in rows], SCHEMA)


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(tuple(made[c][:d]), []).append(c)
    out = set()
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q != p and q)]
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in members if len(made[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.add((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, sha(ends)))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("rows", [made_rows(), made_rows()[:40], [(7, 0, "user", "x y")], [(7, 0, "user", "x y"), (None, 1, "user", "lost")], [(i, 0, "user", "same words") for i in range(300)]])
def test_trie_equals_plain_version(spark, rows):
    found = prefix_trie.prefix_trie(frame(spark, rows))
    assert found.columns == TRIE
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0


def test_large_nodes_go_by_broadcast(spark, monkeypatch):
    rows = made_rows(9)
    monkeypatch.setattr(prefix_trie, "LARGEST", 3)  # so that nodes are on both sides of the share
    assert {tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()} == plain_trie(rows)


def test_trie_sql_equals_operator(spark):
    rows = [(c, t, r, x) for c, t, r, x in made_rows(3)]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(f"SELECT {', '.join(TRIE)} FROM ({queries.OP11_SQL})").fetchall()
    assert set(want) == plain_trie(rows)


LETTERS = {"s": "s", "u": "u", "a": "a"}


def plain_cheapest(rows):
    """(cost, audit): from the end, by all edits; rows are (initial, fault)."""

    @lru_cache(None)
    def best(i, state, inserted):
        steps = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        to = {"s": 1, "u": 2, "a": 3}
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            found += [(c + 3, "I" + x) for r in steps if r != "s" for c, x in [best(i, to[r], inserted + 1)]]
        if i < len(rows):
            initial, fault = rows[i]
            found += [(c + 4, "D" + x) for c, x in [best(i + 1, state, 0)]]
            if fault not in "bd":
                extra = 3 * (fault == "t")
                found += [(c + 3 + extra, "R" + x) for r in steps if r != "s" for c, x in [best(i + 1, to[r], 0)]]
                if initial in steps:
                    found += [(c + extra, "K" + x) for c, x in [best(i + 1, to[initial], 0)]]
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suatx "), st.sampled_from("   bdt")), max_size=9))
def test_search_finds_the_cheapest_edits(rows):
    assert structure_repair.cheapest("".join(r for r, _ in rows), "".join(f for _, f in rows)) == plain_cheapest(tuple(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("DIKR", max_size=12), min_size=2, max_size=8))
def test_audits_are_ordered_as_texts(texts):
    made = []
    for t in texts:
        at = structure_repair.Audit(None, "")
        for letter in t:
            at = structure_repair.Audit(at, letter)
        made.append(at)
    assert [str(a) for a in sorted(made)] == sorted(texts)


def test_a_long_conversation_is_searched_whole():
    draw = random.Random(2)
    initials, faults = "".join(draw.choices("suat", k=3000)), "".join(draw.choices("    bdt", k=3000))
    cost, audit = structure_repair.cheapest(initials, faults)
    roles = "".join(r[:1] or initials[i] for r, i in zip(structure_repair.roles_after(audit, initials), rows_of(audit)) if r is not None)
    assert re.fullmatch("(s?(ua)+)?", roles) and sum(x != "I" for x in audit) == 3000
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    assert cost == sum(price[x] + 3 * (x in "KR" and faults[i] == "t") for x, i in zip(audit, rows_of(audit)))


def rows_of(audit):
    at, out = 0, []
    for letter in audit:
        out.append(at)
        at += letter != "I"
    return out


def plain_repair(rows):
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(name).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        coded, seen = [], set()
        for _, role, text in found:
            words = WORD.findall(text)
            coded.append((role[:1] or " ", "b" if not words else "d" if (role, text) in seen else " " if words[-1][-1] in ".!?" else "t"))
            seen.add((role, text))
        cost, audit = plain_cheapest(tuple(coded))
        at, state, lines = 0, "", []
        for x in audit:
            if x in "RI":
                state = "user" if state != "u" else "assistant"
                lines.append(f"{state}:" + (found[at][2] if x == "R" else ""))
            elif x == "K":
                state = found[at][1]
                lines.append(f"{state}:{found[at][2]}")
            state = state[:1]
            at += x != "I"
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, f in coded]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:]))
        out.add((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(lines))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain_version(spark, seed):
    rows = made_rows(seed) + [(None, 1, "user", "no id."), (None, None, None, None)]
    found = structure_repair.repaired(frame(spark, rows))
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(got) == len(set(got)) and set(got) == plain_repair(rows)


def test_repair_of_dropped_and_no_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert structure_repair.repaired(frame(spark, [])).count() == 0
    assert [tuple(r) for r in structure_repair.repaired(frame(spark, [(dropped, 0, "user", "x")])).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
