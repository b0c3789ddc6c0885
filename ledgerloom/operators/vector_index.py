"""Vector index with exact pruning: a stored table of blocks around pivots, of which a search reads those that may matter.

Vectors are scaled to unit length, so that cosine and Euclidean distance order alike (d^2 = 2 - 2 cos) and
the triangle inequality holds.  Pivots are a bounded, deterministic sample (``pivots``) moved once to the mean of
what is nearest to them.  Every vector goes to its nearest pivot and, inside, to one of ``SHELLS`` shells by its
distance from it, so that a block has a least and a greatest distance, and a query at distance x of the
pivot is no nearer to any of it than max(x - greatest, least - x, 0).

Blocks lie on shelves of about ``SHELF_ROWS`` vectors, which is what a task holds and what a query is sent to.  A search
reads for each query first its nearest blocks with enough vectors, which bounds the k-th distance, then all other blocks
whose lower bound isn't beyond that, so that no neighbour is lost.  Queries go only to shelves with a block to read; a shelf's
vectors come before its queries in one sorted shuffle, and a task holds one shelf and QUERY_ROWS queries.

Vectors that are null, empty or zero have no direction; they are not in the index and find nothing.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.retrieve import DIGITS, best_of_rows, first_of_rows, unit_rows
from ledgerloom.sources.storage import materialize

MOST_PIVOTS, SHELLS = 1024, 4
SHELF_ROWS, COPIES = 8192, 2
QUERY_ROWS = 512  # with SHELF_ROWS the scores, with MOST_PIVOTS * SHELLS the bounds that a task holds
SLACK = 1e-6  # distances are computed in doubles
THRESHOLD = 0.55


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """At most QUERY_ROWS rows (vec_id, embedding) at a time that have a direction, and their unit vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_ROWS):
            part = batch.slice(at, QUERY_ROWS)
            _, matrix = unit_rows(part)
            kept = np.abs(matrix).sum(1) > 0
            if kept.any():
                yield part.filter(pa.array(kept)), matrix[kept]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


@dataclasses.dataclass
class Index:
    """``rows`` (shelf, block, vec_id, unit), stored by shelf and block, and what a search must know of the blocks, in arrays."""

    rows: DataFrame
    pivots: np.ndarray
    pivot_of: np.ndarray  # of each block
    least: np.ndarray
    greatest: np.ndarray
    sizes: np.ndarray
    shelf_of: np.ndarray

    def bounds(self, matrix: np.ndarray) -> np.ndarray:
        """No vector of a block is nearer to a query than this, queries x blocks."""
        far = distances(matrix, self.pivots)[:, self.pivot_of]
        return np.maximum(0.0, np.maximum(far - self.greatest, self.least - far))

    def nearest(self, bound: np.ndarray, k: int) -> np.ndarray:
        """The blocks of least bounds that hold ``k`` vectors and the query itself."""
        by = np.argsort(bound, axis=1, kind="stable")
        before = np.cumsum(self.sizes[by], axis=1) - self.sizes[by]
        enough = np.zeros_like(bound, bool)
        np.put_along_axis(enough, by, before < k + 1, axis=1)
        return enough


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def build(vectors: DataFrame, pivots: int | None = None) -> Index:
    """The index of (vec_id, embedding); ``pivots`` is the square root of their number, at most MOST_PIVOTS, unless given."""
    own = usable(vectors)
    n = own.count()
    k = pivots or max(1, min(MOST_PIVOTS, int(n**0.5)))
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).collect()  # bounded by MOST_PIVOTS
    none = np.zeros(0, np.int64)
    if not sample:
        return Index(own.select(F.lit(0).alias("shelf"), F.lit(0).alias("block"), "vec_id", F.lit(b"").alias("unit")), np.zeros((0, 0)), none, none, none, none, none)
    first = np.array([r.embedding for r in sample], np.float64)
    sizes = np.linalg.norm(first, axis=1)
    first = first[sizes > 0] / sizes[sizes > 0, None]
    if not len(first):
        first = np.ones((1, len(sample[0].embedding))) / len(sample[0].embedding) ** 0.5

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(first)
        for _, matrix in units(batches):
            np.add.at(total, distances(matrix, first).argmin(1), matrix)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = sum(np.frombuffer(r.total).reshape(first.shape) for r in own.coalesce(64).mapInArrow(sums, "total binary").collect())  # at most 64 sums
    sizes = np.linalg.norm(total, axis=1, keepdims=True)
    centres = np.divide(total, sizes, out=first.copy(), where=sizes > 0)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in units(batches):
            far = distances(matrix, centres)
            pivot = far.argmin(1)
            arrays = [pa.array(pivot.astype(np.int32)), part.column("vec_id"), pa.array(far[np.arange(len(pivot)), pivot]), pa.array([row.tobytes() for row in matrix], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["pivot", "vec_id", "far", "unit"])

    placed = materialize(own.mapInArrow(assigned, "pivot int, vec_id long, far double, unit binary"), "placed")
    limits = placed.groupBy("pivot").agg(F.percentile_approx("far", [i / SHELLS for i in range(1, SHELLS)], 1000).alias("limits"))
    shell = F.expr("size(filter(limits, x -> x < far))")
    rows = placed.join(F.broadcast(limits), "pivot").withColumn("number", F.col("pivot") * SHELLS + shell)  # at most MOST_PIVOTS rows
    rows = materialize(rows.drop("limits"), "numbered")
    found = rows.groupBy("number", "pivot").agg(F.min("far").alias("least"), F.max("far").alias("greatest"), F.count(F.lit(1)).alias("n")).orderBy("number").collect()  # at most MOST_PIVOTS * SHELLS
    # blocks of neighbouring numbers share a pivot; a block of more than a shelf is spread over several shelves by its ids
    blocks, held = [], 0
    shelf = -1
    for r in found:
        parts = -(-r.n // SHELF_ROWS)
        if shelf < 0 or held + r.n > SHELF_ROWS:
            shelf, held = shelf + 1, 0
        for part in range(parts):
            blocks.append((r.number, part, parts, shelf + part, r))
        shelf, held = shelf + parts - 1, held + r.n if parts == 1 else SHELF_ROWS
    places = own.sparkSession.createDataFrame([(n, part, parts, s, i) for i, (n, part, parts, s, _) in enumerate(blocks)], "number int, part int, parts int, shelf int, block int")
    dealt = rows.join(F.broadcast(places), "number").where("parts = 1 OR pmod(xxhash64(vec_id), parts) = part")
    dealt = dealt.select("shelf", "block", "vec_id", "unit").repartitionByRange("shelf", "block", "vec_id").sortWithinPartitions("shelf", "block", "vec_id")
    columns = [np.array(c) for c in zip(*[(b[4].pivot, b[4].least, b[4].greatest, b[4].n / b[2], b[3]) for b in blocks])] if blocks else [none] * 5
    return Index(materialize(dealt, "index"), centres, *columns)


def _wanted(index: Index, k: int, widest: float, matrix: np.ndarray, reach: np.ndarray | None) -> np.ndarray:
    """Which blocks a query reads: without ``reach`` its nearest ones, with it all others within it."""
    bound = index.bounds(matrix)
    near = index.nearest(bound, k) & (bound <= widest + SLACK)
    return near if reach is None else ~near & (bound <= np.minimum(reach, widest)[:, None] + SLACK)


def _reach(part: pa.RecordBatch) -> np.ndarray:
    reach = part.column("reach").to_numpy(zero_copy_only=False)
    return np.where(np.isnan(reach), np.inf, reach)


def _asked(queries: DataFrame, index: Index, k: int, widest: float, later: bool) -> DataFrame:
    """(shelf, copy, vec_id, unit, wanted): each query for each shelf that has a block to read, and which of the shelf's blocks, as bits."""
    about = dataclasses.replace(index, rows=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in units(batches) if len(about.sizes) else []:
            ids = part.column("vec_id").to_numpy()
            wanted = _wanted(about, k, widest, matrix, _reach(part) if later else None)
            for shelf in np.unique(about.shelf_of[wanted.any(0)]).tolist():
                bits = wanted[:, about.shelf_of == shelf]
                some = np.flatnonzero(bits.any(1))
                arrays = [pa.array(np.full(len(some), shelf, np.int32)), pa.array((ids[some] % COPIES).astype(np.int32)), pa.array(ids[some]), pa.array([matrix[i].tobytes() for i in some], pa.binary()), pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["shelf", "copy", "vec_id", "unit", "wanted"])

    return queries.select("vec_id", "embedding", "reach").mapInArrow(run, "shelf int, copy int, vec_id long, unit binary, wanted binary")


def _read(asked: DataFrame, index: Index, k: int, least: float) -> DataFrame:
    """(query_id, vec_id, score): the best k of each shelf for each query that asks it."""
    blocks_of = [np.flatnonzero(index.shelf_of == shelf) for shelf in range(int(index.shelf_of.max(initial=-1)) + 1)]

    def matrix_of(part: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(part.num_rows, -1)

    def matched(part: pa.RecordBatch, blocks: np.ndarray, v: np.ndarray, block: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        q, own = part.column("vec_id").to_numpy(), matrix_of(part)
        bits = np.frombuffer(b"".join(part.column("wanted").to_pylist()), np.uint8).reshape(len(q), -1)
        wanted = np.unpackbits(bits, axis=1, count=len(blocks)).astype(bool)
        scores = np.full((len(q), len(v)), -np.inf)
        for i, b in enumerate(blocks.tolist()):
            rows, columns = np.flatnonzero(wanted[:, i]), slice(*np.searchsorted(block, [b, b + 1]).tolist())
            if len(rows):
                scores[rows, columns] = np.round(own[rows] @ held[columns].T, DIGITS)
        scores[q[:, None] == v[None, :]] = -np.inf
        scores[scores < least] = -np.inf
        row, column = best_of_rows(scores, k)
        first = first_of_rows(row, v[column], scores[row, column], k)
        row, column = row[first], column[first]
        return pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(v[column]), pa.array(scores[row, column])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, block, rows = None, [], [], []
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in ("shelf", "copy", "side")])
            cuts = [0, *(np.flatnonzero((np.diff(places) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                shelf, copy, side = places[:, start].tolist() if start < end else (None, None, None)
                if start < end and (shelf, copy) != now:
                    now, ids, block, rows = (shelf, copy), [], [], []
                for at in range(start, end, QUERY_ROWS):
                    part = batch.slice(at, min(QUERY_ROWS, end - at))
                    if side == 0:
                        ids.append(part.column("vec_id").to_numpy())
                        block.append(part.column("block").to_numpy())
                        rows.append(matrix_of(part))
                    elif ids:
                        if len(ids) > 1:  # all of the shelf's vectors are here
                            ids, block, rows = [np.concatenate(ids)], [np.concatenate(block)], [np.concatenate(rows)]
                        yield matched(part, blocks_of[shelf], ids[0], block[0], rows[0])

    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    held = index.rows.select("shelf", copies.alias("copy"), F.lit(0).alias("side"), F.coalesce("block", F.lit(-1)).alias("block"), "vec_id", "unit", F.lit(None).cast("binary").alias("wanted"))
    asked = asked.select("shelf", "copy", F.lit(1).alias("side"), F.lit(-1).alias("block"), "vec_id", "unit", "wanted")
    dealt = held.unionByName(asked).repartition("shelf", "copy").sortWithinPartitions("shelf", "copy", "side", "block")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _phases(queries: DataFrame, index: Index, k: int, threshold: float | None) -> tuple[DataFrame, DataFrame, float, float]:
    """The best among the nearest blocks, and the queries with how far their k-th is (``reach``, null where there are fewer)."""
    least = -2.0 if threshold is None else threshold
    widest = float("inf") if threshold is None else float(np.sqrt(2 - 2 * threshold))
    own = usable(queries)
    first = _asked(own.withColumn("reach", F.lit(None).cast("double")), index, k, widest, later=False)
    found = materialize(_ranked(_read(first, index, k, least), k).drop("rank"), "found")
    reach = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    limit = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))))
    return found, own.join(reach.select("vec_id", limit.alias("reach")), "vec_id", "left"), widest, least


def search(queries: DataFrame, index: Index, k: int = 5, threshold: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` best by cosine, then id, of each (vec_id, embedding), without itself.

    With a ``threshold`` only scores that reach it, clamped to [0, 1].
    """
    found, farther, widest, least = _phases(queries, index, k, threshold)
    more = _read(_asked(farther, index, k, widest, later=True), index, k, least)
    result = _ranked(found.unionByName(more), k)
    if threshold is not None:
        result = result.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
    return result


def probed(queries: DataFrame, index: Index, k: int = 5, threshold: float | None = None) -> DataFrame:
    """One row: n_queries, n_blocks, and of all their pairs n_read that a search reads."""
    _, farther, widest, _ = _phases(queries, index, k, threshold)
    about = dataclasses.replace(index, rows=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in units(batches) if len(about.sizes) else []:
            n = _wanted(about, k, widest, matrix, None).sum() + _wanted(about, k, widest, matrix, _reach(part)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([int(n)], pa.int64())], ["n", "read"])

    counts = farther.select("vec_id", "embedding", "reach").mapInArrow(run, "n long, read long")
    return counts.agg(F.sum("n").alias("n_queries"), F.lit(len(index.sizes)).alias("n_blocks"), F.sum("read").alias("n_read"))
