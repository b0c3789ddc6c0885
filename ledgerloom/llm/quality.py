"""Quality classifier: random Fourier features, ridge from partition sums, isotonic calibration.

Each document becomes a vector of statistics (lengths, shares of character kinds, repetition of
lines and words, entropy).  Standardized by the mean and deviation over all documents, they pass
through random cosine features whose inner products approximate a Gaussian kernel.  Labelled rows
outside the held-out fold fit a ridge regression: each partition sums its normal equations, and
the driver adds up to ``PARTS`` such sums.  A fifth of the labels outside the held-out fold takes
no part in the fit and calibrates the scores by isotonic regression (pool adjacent violators,
joined linearly between the pools' centres).

Only the fit is bounded: it takes at most about ``MOST_FIT`` labelled rows, by a hash of the
document's id, and the calibration as many.  Statistics, means and scores cover all rows.

Defined cases: a null or empty text has the statistics of an empty document and a score; a null
``doc_id`` is scored and is not held out; labels that are null or whose document is absent are
ignored; repeated labels count once each; without usable labels every score is 0.5; with one class
the score is that class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import arrow_map, id_and_text, materialize, slices

FOLDS = 5
CALIBRATION_FOLD = 4
MOST_FIT = 40_000
PARTS = 16
N_FEATURES = 384
THRESHOLD = 0.3
_KINDS = (b"0123456789", b"!", b"?", b".", b",", b"|", b"#$%&*@^~+=<>_", b"()[]{}", b"\"'`", b":;/\\-")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def statistics(text: str) -> list[float]:
    """What the classifier sees of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    words, lines = text.split(), text.split("\n")
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    upper, lower = bytes_of[65:91].sum(), bytes_of[97:123].sum()
    shares = bytes_of[bytes_of > 0] / n
    spread = np.array([len(w) for w in words] or [0])
    distinct_lines = set(lines)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        upper / max(upper + lower, 1),
        (upper + lower) / n,
        bytes_of[128:].sum() / n,
        bytes_of[32] / n,
        *(sum(bytes_of[b] for b in kind) / n for kind in _KINDS),
        float(-(shares * np.log(shares)).sum()),
        spread.mean(),
        spread.std(),
        (spread <= 3).mean(),
        (spread >= 12).mean(),
        len(set(words)) / n_words,
        len(distinct_lines) / n_lines,
        sum(map(len, distinct_lines)) / max(sum(map(len, lines)), 1),
        sum(not w[-1].isalnum() for w in words) / n_words,
        sum(w[:1].isupper() for w in words) / n_words,
        sum(w.isupper() and len(w) > 1 for w in words) / n_words,
        np.log1p(len(text) / n_lines),
    ]


N_STATISTICS = len(statistics(""))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the statistics ``x`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64)
            flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, N_STATISTICS, dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), flat], ["doc_id", "text_hash", "x"])

    return arrow_map(id_and_text(docs).withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosine features of a Gaussian kernel whose width is the square root of the dimension."""
        draw = np.random.default_rng(20_240_501)
        directions = draw.standard_normal((x.shape[1], N_FEATURES)) / np.sqrt(x.shape[1])
        phases = draw.uniform(0, 2 * np.pi, N_FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ directions + phases) * np.sqrt(2 / N_FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.ridge is None or self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centres of the pools and their shares of label 1."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of scores, sum of labels, rows
    for s, y in zip(scores[order], labels[order]):
        pools.append([s, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over ``rows`` (x, y), one partial sum for each of at most PARTS partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for batch in batches:
            z = model.features(_rows(batch))
            total += z.T @ np.hstack([z, batch.column("y").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = arrow_map(rows.select("x", "y").repartition(PARTS), run, "total binary").collect()
    total = sum((np.frombuffer(p.total).reshape(N_FEATURES + 1, N_FEATURES + 2) for p in parts), np.zeros((N_FEATURES + 1, N_FEATURES + 2)))
    return total[:, :-1], total[:, -1]


def fit(stats: DataFrame, labels: DataFrame, penalty: float = 1e-3) -> Model:
    """The model for ``stats`` (doc_id, x) from ``labels`` (doc_id, quality) outside the held-out fold."""
    moments = [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(N_STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = stats.agg(*moments).first()
    mean = np.array([found[f"m{i}"] or 0.0 for i in range(N_STATISTICS)])
    scale = np.array([found[f"s{i}"] or 0.0 for i in range(N_STATISTICS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"), fold(F.col("doc_id")).alias("fold")).where("fold <> 0")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    most = {r.c: r.n for r in usable.groupBy((F.col("fold") == CALIBRATION_FOLD).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bounded = F.when(F.col("fold") == CALIBRATION_FOLD, int(min(1, MOST_FIT / max(1, most.get(True, 0))) * (1 << 20))).otherwise(int(min(1, MOST_FIT / max(1, most.get(False, 0))) * (1 << 20)))
    labelled = materialize(stats.join(usable.where(share < bounded), "doc_id"), "labelled")
    fitted, held = labelled.where(F.col("fold") != CALIBRATION_FOLD), labelled.where(F.col("fold") == CALIBRATION_FOLD)
    square, right = normal_equations(fitted, model)
    n = square[-1, -1]
    if n == 0:
        return model
    ridge = np.eye(len(square)) * penalty * n / N_FEATURES
    ridge[-1, -1] = 1e-9
    model.ridge = np.linalg.solve(square + ridge, right)
    rows = held.select("x", "y").toPandas()
    if len(rows) == 0:
        rows = fitted.select("x", "y").toPandas()
    model.knots = isotonic(model.raw(np.array(rows["x"].tolist())), rows["y"].to_numpy())
    return model


def scored(docs: DataFrame, labels: DataFrame, keep_hash: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; ``keep_hash`` adds xxhash64 of the text."""
    stats = materialize(document_statistics(docs), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(model.score(_rows(batch)))], ["doc_id", "text_hash", "score"])

    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    columns = ["doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")]
    return arrow_map(stats, run, "doc_id long, text_hash long, score double").select(*columns, *["text_hash"] * keep_hash)
