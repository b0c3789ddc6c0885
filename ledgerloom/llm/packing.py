"""Best-fit packing: token pieces fill sequences by a configuration linear program.

Documents become token ids and one end id; only those longer than a sequence are cut, from the
end, so that every piece but the first is full.  The packing works on the histogram of piece
lengths, which has at most ``capacity`` entries however large the corpus is.

The linear program has a variable for each configuration (a multiset of lengths that fits one
sequence) and a row for each length.  Multiplicative weights hold a price for each length, which starts a
little more than in proportion to the length, so that of equally full configurations those of long pieces are dearer.
A round covers all pieces by these prices: for the longest piece left, a knapsack dynamic program over the capacity
finds the dearest configuration that holds it, which is taken as often as the pieces allow, and lengths are
priced anew when one that is wanted has run out.  Then the prices of lengths that lie in badly filled sequences rise.  A
round's cover is in whole numbers already: the rounds' average solves the program, and it is rounded to its best
round, whose worse filled sequences best fit may deal out again.  Rounds end at a gap of ``GAP`` to the lower bound,
which is the largest of tokens over capacity and the rounds' prices over that of their dearest
configuration, or after ``ROUNDS``.  Should best fit alone need fewer sequences still, its cover stands.  The plan is
a list of configurations with multiplicities, whose number doesn't grow with the corpus.

Pieces then get a rank within their length (a window over length and a salt, so that one common
length is not one task, plus the count of the salts before) and the rank is looked up in the plan.

Defined cases: a null text is the empty text, one piece with the end id alone; equal rows are
separate pieces; an empty table gives an empty result; other columns are ignored; a null
``doc_id`` is kept.  A text holding a special token's string is encoded as the tokenizer does.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.runtime import arrow_map, caches, id_and_text, materialize, slices

MOST_WORDS = 400_000
MOST_TABLE = 64 << 20  # bytes of the words and ids that a worker's table holds
POWER, RATE, GAP, ROUNDS = 1.05, 0.1, 0.001, 4  # of the linear program
_coders: dict[tuple, WordCoder] = {}
caches[__name__] = _coders.clear


class WordCoder:
    """Token ids as little-endian 32-bit bytes, through a table of the distinct words met so far.

    The pre-tokenizer of a byte-level model never joins a character to a following space and
    letter, so a text may be cut before every single space between two other characters and each
    word encoded once.  A word that begins or ends with white space (from runs of it) breaks that
    rule, and its text is encoded whole.  ``ranks`` (path and split pattern) names the same
    vocabulary in rank form, which encodes single words faster (that tokens and merges are the same is
    checked once on the driver); words that hold an added token's
    string always go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = None
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding("words", pat_str=ranks[1], mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.table: dict[str, bytes | None] = {}
        self.held = 0  # bytes of the words and ids in the table

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | None:
        if word[-1].isspace() or word[0].isspace() and (len(word) == 1 or word[1].isspace()):
            return None
        if self.by_rank is None or any(t in word for t in self.added):
            return self.whole([word])[0]
        ids = self.by_rank(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def code(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            first, *rest = text.split(" ")
            cut.append([first, *[f" {w}" for w in rest]] if first else [text] if text else [])
        words = {w for found in cut for w in found}
        new = words.difference(self.table)
        if len(self.table) + len(new) > MOST_WORDS or self.held > MOST_TABLE:
            self.table, self.held, new = {}, 0, words
        for word in new:
            self.table[word] = ids = self._word(word)
            self.held += 4 * len(word) + len(ids or b"")
        find, out = self.table.__getitem__, []
        for text, found in zip(texts, cut):
            ids = list(map(find, found))
            out.append(b"".join(ids) if None not in ids else self.whole([text])[0])
        return out


def same_vocabulary(path: str, ranks: str) -> None:
    """Raise unless the ranks are the tokenizer's own tokens and merges: then merging by rank is merging in the model's order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path) as file:
        whole = json.load(file)
    added = {t["content"] for t in whole["added_tokens"]}
    tokens = {bytes(map(letters.__getitem__, t)): i for t, i in whole["model"]["vocab"].items() if t not in added}
    merged = [tokens[bytes(map(letters.__getitem__, "".join(m if isinstance(m, list) else m.split(" "))))] for m in whole["model"]["merges"]]
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if tokens != table or merged != sorted(merged):
        raise ValueError("the ranks are not the tokenizer's vocabulary")


def coder(path: str, ranks: tuple[str, str] | None = None) -> WordCoder:
    if (path, ranks) not in _coders:
        _coders[path, ranks] = WordCoder(path, ranks)
    return _coders[path, ranks]


def token_pieces(docs: DataFrame, tokenizer: str, ranks: tuple[str, str] | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; ``keep_ids`` adds the ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()
    if ranks:
        same_vocabulary(tokenizer, ranks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer, ranks)
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.code(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
                for piece, (a, b) in enumerate(itertools.pairwise(cuts)):
                    part = ids[4 * a : 4 * b]
                    row = (doc_id, piece, a, b - a, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<i4").tolist()) if keep_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    return arrow_map(id_and_text(docs), run, schema)


Plan = list[tuple[dict[int, int], int]]


def priced(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over ascending lengths: the best total weight within each capacity, the length taken first (0: none)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    own, fits = weights[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            totals = own[: fits[room]] + best[room - lengths[: fits[room]]]
            take = int(totals.argmax())
            if totals[take] > best[room]:
                best[room], taken[room] = totals[take], lengths[take]
    return best, taken


def configuration(first: int, taken: np.ndarray, capacity: int) -> Counter:
    """The priced configuration that holds ``first``."""
    made, room = Counter({first: 1}), capacity - first
    while room > 0:
        length = int(taken[room])
        if length:
            made[length] += 1
        room -= length or 1
    return made


def cover(counts: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[Plan, float]:
    """Configurations that use every piece, the dearest first for each length from the longest, and the program's lower bound by these prices."""
    left, plan, length, bound, taken = counts.copy(), [], capacity, 0.0, None
    while left.any():
        while not left[length]:
            length -= 1
        if taken is None:
            best, taken = priced(prices, np.flatnonzero(left), capacity)
            bound = bound or float((prices * counts).sum() / best[capacity])
        made = configuration(length, taken, capacity)
        if not all(left[k] for k in made):
            taken = None  # priced with a length that has run out
            continue
        made = {k: min(x, int(left[k])) for k, x in made.items()}
        times = min(int(left[k]) // x for k, x in made.items())
        for k, x in made.items():
            left[k] -= times * x
        plan.append((made, times))
    return plan, bound


def fill(config: dict[int, int]) -> int:
    return sum(length * x for length, x in config.items())


def refilled(plan: Plan, counts: np.ndarray, capacity: int) -> Plan:
    """The plan with its sequences that lack more than a 256th dealt out again by best fit."""
    kept, left = [(config, n) for config, n in plan if 256 * (capacity - fill(config)) <= capacity], counts.copy()
    for config, n in kept:
        for length, x in config.items():
            left[length] -= n * x
    return best_fit(kept, left, capacity)


def dearer(prices: np.ndarray, plan: Plan, capacity: int) -> np.ndarray:
    """Prices raised by the share of room that a length's sequences leave empty."""
    empty, pieces = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for config, n in plan:
        for length, x in config.items():
            empty[length] += n * x * (1 - fill(config) / capacity)
            pieces[length] += n * x
    return prices * np.exp(RATE * np.divide(empty, pieces, out=np.zeros(capacity + 1), where=pieces > 0))


def best_fit(plan: Plan, counts: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing of ``counts`` into the room that the plan's sequences leave, then into new ones."""
    groups: dict[int, list[list]] = {}  # by room left: [configuration, number of sequences]
    for config, n in plan:
        groups.setdefault(capacity - sum(k * v for k, v in config.items()), []).append([Counter(config), n])
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if groups.get(r)), None)
            if room is None:
                each = min(capacity // length, left)
                made = [(Counter({length: each}), left // each)] + ([(Counter({length: left % each}), 1)] if left % each else [])
                for config, n in made:
                    groups.setdefault(capacity - sum(k * v for k, v in config.items()), []).append([config, n])
                break
            config, n = groups[room].pop()
            used = min(n, left)
            if n > used:
                groups[room].append([config, n - used])
            groups.setdefault(room - length, []).append([config + Counter({length: 1}), used])
            left -= used
    return [(dict(config), n) for made in groups.values() for config, n in made]


def planned(histogram: dict[int, int], capacity: int) -> tuple[Plan, float, int]:
    """Configurations with multiplicities that use every length exactly as often as the histogram says, the program's lower bound, and how many sequences are the rounds' own."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full: Plan = [({capacity: 1}, int(counts[capacity]))] if counts[capacity] else []
    n_full, counts[capacity] = int(counts[capacity]), 0
    if not counts.any():
        return full, float(n_full), n_full

    def needed(plan: Plan) -> int:
        return sum(n for _, n in plan)

    lengths = np.arange(capacity + 1)
    prices, bound = (lengths / capacity) ** POWER, float((lengths * counts).sum() / capacity)
    best = by_rounds = None
    for _ in range(ROUNDS):
        plan, own = cover(counts, prices, capacity)
        bound = max(bound, own)
        for made in (plan, refilled(plan, counts, capacity)):
            if best is None or needed(made) < needed(best):
                best, by_rounds = made, plan
        if needed(best) <= max(math.ceil(bound - 1e-6), (1 + GAP) * bound):
            break
        prices = dearer(prices, plan, capacity)
    alone = best_fit([], counts, capacity)
    if needed(alone) < needed(best):
        return full + alone, n_full + bound, n_full
    began = needed(best) if best is by_rounds else sum(n for config, n in by_rounds if 256 * (capacity - fill(config)) <= capacity)
    return full + best, n_full + bound, n_full + began


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    return planned(histogram, capacity)[0]


def slots(plan: Plan, capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of the length in each sequence, offset), by length and rank."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for config, n in plan:
        offset = 0
        for length, x in sorted(config.items(), reverse=True):
            rows.append((length, used[length], sequence, x, offset))
            used[length] += n * x
            offset += length * x
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (materialized, with doc_id, piece and length) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan_packing(histogram, capacity), capacity)
    n_salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_salts)).cast("int"))
    by_salt = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(inside)).join(bases, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_in") - 1).alias("_rank"))
    names = pieces.columns
    starts = table[:, 0] << 44 | table[:, 1] if len(table) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = table[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
            at = rank - row[:, 1]
            arrays = [batch.column(c) for c in names] + [pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return arrow_map(ranked, place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: tuple[str, str] | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    return pack(materialize(token_pieces(docs, tokenizer, ranks, end_id, capacity), "pieces"), capacity)
