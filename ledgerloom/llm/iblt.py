"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are stretches of words that end where the content says: at a line's end, after a word with
a punctuation mark at its end, and after a word whose last character has a code point divisible by ``EVERY``.  This
one rule cuts texts of all sizes, so that two versions of a text share the paragraphs outside the changed
place and one on either side of it.  Each distinct paragraph has a 64-bit digest, and a
sketch holds every digest in one cell of each of three sub-tables: a count, the digests' exclusive or and the exclusive or of check
words.  Subtracting two sketches cancels what both texts hold; peeling takes cells with a single
digest left until none remain, which recovers the digests on either side.  When peeling leaves a
non-empty cell, both sketches are made again four times larger, as often as it takes: with many more
cells than digests nearly every digest is alone in one.  Likeness is the Jaccard share that the
recovered difference implies.

The edited text of a document replaces its last third with the beginning of the next document in
descending order of ``doc_id`` (the first after the last).  Rows are dealt into ranges of ids whose
bounds come from a quantile sketch over all ids, sorted inside, and the first row of each range is
also sent to the range before it, so one shuffle of the texts makes each row's successor available.

Defined cases: a null text is the empty text; two texts without paragraphs have likeness 1; equal
texts have equal fingerprints; null ids come after all others; rows with equal ids follow one
another by text; a table of one row is its own successor; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import arrow_map, id_and_text, importable, slices

CELLS = 24  # of the stored sketch: three sub-tables of eight
GROWTH = 4
AT_ONCE = 1 << 20  # cells held at once
EVERY = 4
#: A cut: a line's end, or white space behind a byte that is a punctuation mark or divisible by EVERY.  The last byte of a
#: character in UTF-8 has the remainder of its code point by 4.
CUT = re.compile(b"\n|(?<=[%s])[ \t\r\x0b\x0c]+" % b"".join(re.escape(bytes([b])) for b in range(33, 256) if b % EVERY == 0 or b in b".!?,;:"))


def paragraphs(text: str) -> list[bytes]:
    return [p for p in map(bytes.strip, CUT.split(text.encode("utf-8", "surrogatepass"))) if p]


def digests(text: str) -> np.ndarray:
    """The distinct paragraph digests, in ascending order."""
    return np.array(sorted(set(map(xxhash.xxh3_64_intdigest, paragraphs(text)))), np.uint64)


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) of salted keys."""
    x = keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, 7) & np.uint64(0xFFFFFFFF)


def _cells(keys: np.ndarray, n_cells: int) -> list[np.ndarray]:
    third = n_cells // 3
    return [(_mixed(keys, j + 1) % np.uint64(third)).astype(np.int64) + j * third for j in range(3)]


class Sketches:
    """Sketches of equal size for several documents, as arrays over documents x cells."""

    def __init__(self, n: int, n_cells: int):
        self.n_cells = n_cells
        self.count = np.zeros(n * n_cells, np.int32)
        self.keys = np.zeros(n * n_cells, np.uint64)
        self.checks = np.zeros(n * n_cells, np.uint64)

    def add(self, rows: np.ndarray, keys: np.ndarray, signs: np.ndarray | int = 1) -> None:
        checks = _check(keys)
        for cell in _cells(keys, self.n_cells):
            at = rows * self.n_cells + cell
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.n_cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (row, key, side) and the rows that did not empty; the sketches are used up."""
        rows, keys, sides = [], [], []
        for _ in range(4 * self.n_cells):
            single = np.flatnonzero(np.abs(self.count) == 1)
            single = single[self.checks[single] == _check(self.keys[single])]
            if not len(single):
                break
            row, key, side = single // self.n_cells, self.keys[single], self.count[single]
            order = np.lexsort((key, row))
            row, key, side = row[order], key[order], side[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, side = row[first], key[first], side[first]
            self.add(row, key, -side)
            rows.append(row)
            keys.append(key)
            sides.append(side)
        full = np.flatnonzero((self.count != 0) | (self.keys != 0)) // self.n_cells
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, keys, sides)) + (np.unique(full),)

    def texts(self) -> list[str]:
        """Each sketch as base64 of its cells: count, key, check, little-endian."""
        cells = np.zeros(len(self.count), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        cells["count"], cells["key"], cells["check"] = self.count, self.keys, self.checks
        data = cells.reshape(-1, self.n_cells)
        return [base64.b64encode(row.tobytes()).decode() for row in data]


def sketch(sets: list[np.ndarray], n_cells: int) -> Sketches:
    made = Sketches(len(sets), n_cells)
    if sets:
        made.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
    return made


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests of the left side only and of the right side only, by subtracting and peeling."""
    out: list = [None] * len(left)
    # a difference is no smaller than that of the numbers of digests; cells for less than that can't be peeled
    least = np.array([abs(len(a) - len(b)) for a, b in zip(left, right)])
    todo, n_cells = np.arange(len(left)), CELLS
    while len(todo):
        failed = [todo[least[todo] > n_cells]]
        todo = todo[least[todo] <= n_cells]
        step = max(1, AT_ONCE // n_cells)
        for part in (todo[i : i + step] for i in range(0, len(todo), step)):
            rest = sketch([left[i] for i in part], n_cells).minus(sketch([right[i] for i in part], n_cells))
            row, key, side, full = rest.peel()
            order = np.argsort(row, kind="stable")
            row, key, side = row[order], key[order], side[order]
            ends = np.searchsorted(row, np.arange(len(part) + 1))
            for k, i in enumerate(part):
                a, b = ends[k], ends[k + 1]
                out[i] = (key[a:b][side[a:b] > 0], key[a:b][side[a:b] < 0])
            failed.append(part[full])
        todo, n_cells = np.concatenate(failed), n_cells * GROWTH
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    out = []
    for a, b, (x, y) in zip(left, right, differences(left, right)):
        apart = len(x) + len(y)
        shared = (len(a) + len(b) - apart) / 2
        out.append(shared / (shared + apart) if shared + apart else 1.0)
    return out


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (range, ahead, doc_id, text), each range sorted by descending id in one partition, with the row after its last."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    n_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", shares, 20 * n_ranges).alias("b")).first().b or [], np.int64))

    def ranges(ids: pd.Series) -> np.ndarray:
        there = ids.notna().to_numpy()
        return np.where(there, np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy()) + 1, 0)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(ranges(ids.astype("Int64")))

    importable(spark)
    heads = {r["range"]: r.head for r in rows.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    sent_to = {heads[r]: order[i - 1] for i, r in enumerate(order)}  # the first row of a range also goes to the one above

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        ids = ids.astype("Int64")
        keys = [None if x is pd.NA else int(x) for x in ids]
        return pd.Series([[2 * int(r)] + ([2 * sent_to[k] + 1] if k in sent_to else []) for r, k in zip(ranges(ids), keys)])

    placed = rows.withColumn("place", F.explode(places("doc_id"))).select((F.col("place") / 2).cast("long").alias("range"), (F.col("place") % 2).cast("int").alias("ahead"), "doc_id", "text")
    return placed.repartition(n_ranges, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the beginning of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, keep_difference: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``keep_difference`` adds the digests recovered for the edit: only_before and only_after.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema += ", only_before array<long>, only_after array<long>" if keep_difference else ""

    def made(rows: list[tuple], after: tuple) -> pa.RecordBatch:
        """Rows and the row after the last of them; all (range, ahead, doc_id, text)."""
        texts = [r[3] for r in rows] + [after[3]]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own = [digests(t) for t in texts]
        other = [digests(t) for t in changed]
        arrays = [
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(sketch(own[:-1], CELLS).texts()),
            pa.array(sketch(other, CELLS).texts()),
            pa.array(likeness(own[:-1], other)),
            pa.array(likeness(own[:-1], own[1:])),
        ]
        if keep_difference:
            for side in zip(*differences(own[:-1], other)):
                arrays.append(pa.array([x.astype(np.int64).tolist() for x in side], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, [part.split()[0] for part in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        skip = None  # the range whose row ahead has been used
        for batch in slices(batches, "text", 4 << 20):
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
                if row[1]:
                    if held and skip != row[0]:
                        yield made(held, row)
                    held, skip = [], row[0]
                else:
                    held.append(row)
            if len(held) > 1:
                yield made(held[:-1], held[-1])
                held = held[-1:]

    return arrow_map(in_order(docs), run, schema)
