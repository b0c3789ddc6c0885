"""Conversation structure repair: the cheapest edits that make the roles of a conversation regular.

A row's first fault is blank (no character but white space), duplicate (role and text seen earlier in
the conversation) or truncated (the last such character is none of ``. ! ?``).  Edits keep a row (K),
give it the role user or assistant (R), delete it (D, required for blanks and duplicates) or insert
an empty user or assistant row (I); the initials of the roles that result must match ``(s?(ua)+)?``.

Dijkstra's search runs on the implicit lattice of (row, state of the roles' grammar), whose edges are
made as nodes are popped, by key (cost, audit), and stops at the first popped accepting end node.  No
edge lowers the key: an edge costs something or adds a letter.  Two audits of one node with equal cost
are never one the other's beginning (they would differ by inserts alone, which cost), so the smaller
stays the smaller whatever follows.  Audits are chains of letters with skip pointers and hashes, compared in logarithmic
time, so that a long conversation takes memory in proportion to its rows.

What meets in one task for a conversation is a byte a row, its initial and fault, found by JVM
expressions; texts are shuffled once, sorted, and hashed as a stream behind their conversation's audit.

Defined cases: in ``damaged`` a null role or text is one space, and so is a null turn in the key of the
damage; null turns sort first, equal turns by role and the text's digest; a null conv_id is a conversation of its
own; a role without characters or with another initial can't be kept; a conversation without rows
has zeros, an empty audit and the hash of nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.runtime import arrow_map

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = "b", "d", "t"
#: States of ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a.  What each initial leads to, and the initial that an edit may give.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}
_MASK = (1 << 61) - 1


class Audit:
    """A text that grows at its end and shares its beginnings; ordered as texts are."""

    __slots__ = ("depth", "before", "letter", "skip", "mark")

    def __init__(self, before: Audit | None, letter: str):
        self.before, self.letter = before, letter
        if before is None:
            self.depth, self.skip, self.mark = 0, self, 0
        else:
            self.depth = before.depth + 1
            far = before.skip
            self.skip = far.skip if before.depth - far.depth == far.depth - far.skip.depth else before
            self.mark = (before.mark * 1_000_003 + ord(letter)) & _MASK

    def up_to(self, depth: int) -> Audit:
        at = self
        while at.depth > depth:
            at = at.skip if at.skip.depth >= depth else at.before
        return at

    def __lt__(self, other: Audit) -> bool:
        a, b = self.up_to(other.depth), other.up_to(self.depth)
        if a.mark == b.mark:
            return self.depth < other.depth  # one is the other's beginning
        while a.before.mark != b.before.mark:
            a, b = (a.skip, b.skip) if a.skip.mark != b.skip.mark else (a.before, b.before)
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, at = [], self
        while at.before is not None:
            letters.append(at.letter)
            at = at.before
        return "".join(reversed(letters))


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of the best edits of rows with these initials and faults (one character a row, a space for none)."""
    n = len(initials)
    heap: list[tuple[int, Audit, int, int]] = [(0, Audit(None, ""), 0, 0)]
    best: dict[int, tuple[int, Audit]] = {}
    closed = set()
    push, pop = heapq.heappush, heapq.heappop
    while True:
        cost, audit, row, state = pop(heap)
        if row == n and state in ACCEPTING:
            return cost, str(audit)
        name = 4 * row + state
        if name in closed:
            continue
        closed.add(name)
        given = STEPS[state][GIVEN[state]]
        edges = [(INSERT, "I", row, given)]
        if row < n:
            fault = faults[row]
            edges.append((DELETE, "D", row + 1, state))
            if fault != BLANK_ROW and fault != DUPLICATE_ROW:
                extra = TRUNCATED if fault == TRUNCATED_ROW else 0
                edges.append((REROLE + extra, "R", row + 1, given))
                kept = STEPS[state].get(initials[row])
                if kept is not None:
                    edges.append((extra, "K", row + 1, kept))
        for price, letter, to_row, to_state in edges:
            to, total = 4 * to_row + to_state, cost + price
            if to in closed:
                continue
            held = best.get(to)
            if held is not None and held[0] < total:
                continue
            longer = Audit(audit, letter)
            if held is None or total < held[0] or longer < held[1]:
                best[to] = (total, longer)
                push(heap, (total, longer, to_row, to_state))


def roles_after(audit: str, initials: str) -> list[str | None]:
    """For each letter of the audit the role that results: None for a deleted row, '' for a row's own."""
    state, row, out = 0, 0, []
    for letter in audit:
        if letter == "K":
            state = STEPS[state][initials[row]]
            out.append("")
        elif letter == "D":
            out.append(None)
        else:
            given = GIVEN[state]
            state = STEPS[state][given]
            out.append(NAMES[given])
        row += letter != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with planted faults; ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    space = F.lit(" ")
    df = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault) without texts, a row for each copy; of a dropped row its conv_id alone, with no initial."""
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")), -1, 1)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    fault = F.when(last == "", BLANK_ROW).when(~last.isin(".", "!", "?"), TRUNCATED_ROW).otherwise(" ")
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    slim = rows.select("conv_id", "turn", "role", digest.alias("digest"), initial.alias("initial"), fault.alias("fault"), "copies")
    there = slim.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    first = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    again = (F.row_number().over(first) > 1) & (F.col("fault") != BLANK_ROW)
    there = there.select("conv_id", "turn", "role", "digest", "initial", F.when(again, DUPLICATE_ROW).otherwise(F.col("fault")).alias("fault"))
    none = slim.where("copies = 0").select("conv_id").distinct()
    return there.unionByName(none.withColumns({"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "digest": F.lit(None).cast("binary"), "initial": F.lit(None).cast("string"), "fault": F.lit(None).cast("string")}))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, initials string"


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``faulted`` rows: the counts, the cost, the audit and the rows' initials."""
    names = [x.split()[0] for x in _REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def report(conv_id: int | None, turns: list, initials: str, faults: str) -> tuple:
        cost, audit = cheapest(initials, faults)
        known = [t for t in turns if t is not None]
        gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
        illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        return conv_id, gaps, faults.count(BLANK_ROW), faults.count(DUPLICATE_ROW), faults.count(TRUNCATED_ROW), illegal, cost, audit, initials

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, turns, letters, faults = [], ..., [], [], []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for conv_id, turn, initial, fault in _groups(batches, ["conv_id", "turn", "initial", "fault"]):
            if conv_id != now:
                if now is not ...:
                    out.append(report(now, turns, "".join(letters), "".join(faults)))
                now, turns, letters, faults = conv_id, [], [], []
                if len(out) >= 5000:
                    yield packed(out)
                    out = []
            if initial is not None:
                if turn is None or not turns or turns[-1] != turn:
                    turns.append(turn)
                letters.append(initial)
                faults.append(fault)
        if now is not ...:
            out.append(report(now, turns, "".join(letters), "".join(faults)))
        yield packed(out)

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("fault") == DUPLICATE_ROW]
    ordered = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault")
    return arrow_map(ordered, run, _REPORT)


def repaired(conversations: DataFrame) -> DataFrame:
    """``repair`` of the conversations with planted faults."""
    return repair(damaged(conversations))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, copies): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = reports(faulted(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = found.select("conv_id", F.struct(*counts, "audit", "initials").alias("head"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", digest.alias("digest"), "text", "copies")
    empty = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int"))}
    stream = texts.withColumn("head", F.lit(None).cast(heads.schema["head"].dataType)).unionByName(heads.withColumns(empty))
    order = [F.col("conv_id"), F.col("head").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = stream.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "head", "role", "text", "copies")
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", *counts, "audit", "repaired_sha256"])

        class Writer:
            """The hash of the rows that an audit leaves, as its conversation's rows come in."""

            def __init__(self, conv_id: int | None, head: dict):
                self.row = (conv_id, *[head[c] for c in counts], head["audit"])
                self.roles, self.sha, self.any = iter(roles_after(head["audit"], head["initials"])), hashlib.sha256(), False
                self.letters = iter(head["audit"])

            def add(self, line: str) -> None:
                self.sha.update(("\n" * self.any + line).encode())
                self.any = True

            def feed(self, role: str, text: str) -> None:
                for letter, given in zip(self.letters, self.roles):
                    if letter != "I":
                        if given is not None:
                            self.add(f"{given or role}:{text}")
                        return
                    self.add(f"{given}:")

            def done(self) -> tuple:
                for given in self.roles:  # inserts after the last row
                    self.add(f"{given}:")
                return (*self.row, self.sha.hexdigest())

        for conv_id, head, role, text, copies in _groups(batches, ["conv_id", "head", "role", "text", "copies"]):
            if head is not None:
                if now:
                    out.append(now.done())
                    if len(out) >= 5000:
                        yield packed()
                        out.clear()
                now = Writer(conv_id, head)
            else:
                for _ in range(copies):
                    now.feed(role, text)
        if now:
            out.append(now.done())
        yield packed()

    return arrow_map(ordered, run, schema)
