"""Exact n-gram Jaccard join by partitioning the universe of shingles.

Documents are sets of five-word shingles (64-bit hashes of the words' bytes after A-Z is lowered);
two link when 100 |A n B| >= 80 |A u B|, so their symmetric difference is at most (|A| + |B|) / 9.
Equal sets form a class, and the join runs between classes.

Sizes fall into bands, and each band has a scheme.  ``allocate`` picks its form by cost (signatures
plus an estimate of chance matches):

- *segments*: shingles are hashed into m segments, and every non-empty segment of a set is a
  signature.  Of a set's non-empty segments at most h = floor(2 s / 9) can differ from those of a
  partner that is not larger, so with more than h of them one segment is equal (pigeonhole).
  m is the cheapest number at which a set of any size of the band has too few non-empty segments
  with a probability below 1e-9; a set that still has too few is compared on all its shingles.
- *one deletion*: one segment; the signatures are the whole set and the set without each of its
  shingles, which finds every pair that differs in one shingle (the most at small sizes).

A set emits signatures in its own band's scheme and, where a partner there may be larger by a
quarter, in the next.  Signatures travel packed, as arrays for each task and signature range, cut to
32 bits inside a range: two that are equal only there make needless candidates.

Of its signatures a set needs only the rarest: linked sets have all but h + 1 in common (h + 1 is the
most that can differ, and one), so each skips as many of the most frequent as it has above h + 1,
in one order by group size for all (prefix filter).  A set whose own text is unusual enough so
skips every shared passage and has no candidates at all.

Of each group left, the member in most groups is the pivot, and groups with the same pivot are one
star.  First every pivot is verified against its star, one row for each member, and links join
components.  Stars that lie in one component are done.  In the others every member outside the
largest component is verified against the whole star, in blocks of bounded size, through an
inverted index of the block's shingles; no rows of pairs are made.  All pairs with a common
signature so are compared or in one component, and no link between components is missed.
Verification compares hashes cut to 32 bits first, which only overestimates what is common, and the
few pairs left by their words.

Defined cases: a null or empty text, or one without words, has no shingles and is its own
component; texts with fewer than five words have one shingle, the whole sequence; repeated rows and
rows with equal ids are in one component only if their texts link; a null doc_id takes part and is
never the smallest id unless alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.bloom import native_split
from ledgerloom.llm.runtime import arrow_map, discard, id_and_text, materialize, slices

WORDS = 5
SMALLEST = 4  # below it only equal sets can link
GROWTH = 2
FAIL = 1e-9
CHANCE, CHANCE_COST = 0.05, 200.0
ONE_DELETION, SEGMENTS = 1, 2
MOST_SIGNATURES = 300_000  # packed at once
AT_ONCE = 1 << 19  # bytes of text hashed at once
PER_PART = 2_000_000  # shingles for each range of signatures
PER_SALT = 1024
PER_BLOCK = 2_000_000  # shingles of one side of a block
MOST_SEEN = 200_000  # classes a task remembers to send their signatures once
_U = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer of ``x`` and a salt."""
    x = x + _U((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mixed(np.arange(256, dtype=_U), 99)


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of ``base``, at least ``n``; the longest run asked for is kept."""
    if len(_kept_powers.get(base, ())) < n:
        steps = np.full(n, _U(base))
        steps[0] = 1
        _kept_powers[base] = np.cumprod(steps)
    return _kept_powers[base]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    ends = np.cumsum(lengths)
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    gap = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    size = 1 << max(16, len(joined).bit_length())
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[joined] * _powers(_BASE, size)[: len(joined)])])
    words = mixed((sums[last] - sums[first]) * _powers(_INVERSE, size)[first]) + (last - first).astype(_U)  # wherever they stand
    bounds = np.searchsorted(first, np.concatenate([[0], ends]))
    grams = words[: max(0, len(words) - WORDS + 1)].copy()
    for i in range(1, WORDS):
        grams = mixed(grams) + words[i : i + len(grams)]
    grams = mixed(grams, WORDS)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            whole = words[a : a + 1].copy()
            for i in range(a + 1, b):
                whole = mixed(whole) + words[i : i + 1]
            out.append(mixed(whole, int(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    return np.array([mixed(shingles, 11).sum(dtype=_U), mixed(shingles, 12).sum(dtype=_U) + _U(len(shingles))], _U).tobytes()


def linked(common: int, left: int, right: int) -> bool:
    return 100 * common >= 80 * (left + right - common)


def band(size: int) -> int:
    """0 for sizes that only equal sets share, else the number of the band."""
    return 0 if size < SMALLEST else int(math.log(size / SMALLEST + 1e-12, GROWTH)) + 1


def band_edges(number: int) -> tuple[int, int]:
    least = SMALLEST * GROWTH ** (number - 1)
    return least, least * GROWTH - 1


def _fails(m: int, size: int) -> float:
    """Bound on the chance that ``size`` shingles meet at most h of m segments, as a logarithm."""
    h = 2 * size // 9
    if h >= m:
        return 0.0
    if h == 0:
        return -math.inf
    return math.lgamma(m + 1) - math.lgamma(h + 1) - math.lgamma(m - h + 1) + size * math.log(h / m)


@lru_cache(maxsize=None)
def allocate(number: int) -> tuple[int, int]:
    """The form of a band's scheme and its number of segments, by cost."""
    least, most = band_edges(number)
    middle = (least + most) / 2
    options = []
    if 2 * most // 9 <= 1:
        options.append((middle + 1, ONE_DELETION, 1))
    sizes = sorted({least, most, *np.linspace(least, most, 9).astype(int).tolist()})
    m = max(2, 2 * most // 9 + 1)
    while m <= 64 * most:
        if max(_fails(m, s) for s in sizes) < math.log(FAIL):
            used = m * (1 - (1 - 1 / m) ** middle)
            options.append((used * (1 + CHANCE_COST * CHANCE ** (middle / used)), SEGMENTS, m))
            break
        m += max(1, m // 64)
    return min(options)[1:]


def signatures(shingles: np.ndarray, number: int) -> tuple[np.ndarray, int]:
    """Signatures in a scheme, and how many equal segments the set can lose (negative: none)."""
    form, m = allocate(number)
    size = len(shingles)
    if form == ONE_DELETION:
        parts = mixed(shingles, 3)
        total = parts.sum(dtype=_U)
        return mixed(np.concatenate([[total], total - parts]), 1000 + number), -1
    segment = mixed(shingles, 5) % _U(m)
    order = np.argsort(segment, kind="stable")
    segment, parts = segment[order], mixed(shingles, 6)[order]
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    found = mixed(np.add.reduceat(parts, starts) ^ mixed(segment[starts], 7), 1000 + number)
    largest = min(band_edges(number)[1], size * 5 // 4)
    return found, len(found) - ((size + largest) // 9 + 1)


def too_few(shingles: np.ndarray, number: int, found: int) -> bool:
    """Whether pigeonhole needs more signatures than a set of the band has."""
    return allocate(number)[0] == SEGMENTS and found <= 2 * len(shingles) // 9


SETS = "doc_id long, n_shingles long, key binary, text_hash long"


def hashed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the class key and the text's hash, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary()), batch.column("text_hash")], ["doc_id", "n_shingles", "key", "text_hash"])

    return arrow_map(hashed(docs), run, SETS)


_CLASS = np.dtype([("key", "V16"), ("n", "<u4"), ("spare", "<i4"), ("few", "<u4"), ("cid", "<i8")])


def class_id(key: bytes, scheme: int, few: bool) -> int:
    """A long for a class in a scheme, odd where the set has too few segments there."""
    return int(mixed(np.frombuffer(key, _U)[:1], 50 + scheme)[0] | _U(1)) - (not few) & 0xFFFFFFFFFFFFFFFF


def packed_signatures(docs: DataFrame, n_parts: int, whole: bool = False) -> DataFrame:
    """(part, ids, counts, codes): for each task and range the 32-bit signatures, class after class.

    Ranges from ``n_parts`` on hold the classes themselves instead (``_CLASS`` in ids), so that a
    signature costs 14 bytes at most however many ranges there are.  ``whole`` makes every shingle
    a signature, for sets that have too few segments.
    """
    names = ["part", "ids", "counts", "codes"]

    def packed(entries: list[tuple], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = np.array(entries, _CLASS)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code = np.concatenate(codes)
        part = ((code >> _U(32)) * _U(n_parts) >> _U(32)).astype(np.int64)
        order = np.argsort(part * len(codes) + owner, kind="stable")
        part, code, owner = part[order], code[order].astype("<u4"), owner[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rows = [(n_parts + int(table["cid"][0] % n_parts), table.tobytes(), b"", b"")]
        for a, b in zip(starts, [*starts[1:], len(part)]):
            there, counts = np.unique(owner[a:b], return_counts=True)
            rows.append((int(part[a]), table["cid"][there].tobytes(), counts.astype("<u4").tobytes(), code[a:b].tobytes()))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256]), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, codes, held, seen = [], [], 0, set()
        for batch in slices(batches, "text", AT_ONCE):
            for shingles in shingle_sets(batch.column("text").to_pylist()):
                size = len(shingles)
                if size < SMALLEST:
                    continue
                key = class_key(shingles)
                if key in seen:
                    continue
                if len(seen) < MOST_SEEN:
                    seen.add(key)
                number = band(size)
                schemes = [number] + ([number + 1] if 5 * size >= 4 * band_edges(number + 1)[0] else [])
                for scheme in schemes:
                    found, spare = signatures(shingles, scheme)
                    few = scheme == number and too_few(shingles, scheme, len(found))
                    if whole:
                        found, spare = mixed(shingles, 8), -1
                    entries.append((np.void(key), size, spare, few, np.uint64(class_id(key, scheme, few)).astype(np.int64)))
                    codes.append(found)
                    held += len(found)
                    if whole:
                        break
            if held >= MOST_SIGNATURES:
                yield from packed(entries, codes)
                entries, codes, held = [], [], 0
        if held:
            yield from packed(entries, codes)

    return arrow_map(id_and_text(docs), run, "part long, ids binary, counts binary, codes binary")


GROUPS = "grp long, cid long, times int, size int, key binary, n int, spare int"


def shared_groups(packed: DataFrame, n_parts: int, only_few: bool = False) -> DataFrame:
    """Groups of two classes or more that share a signature, and the classes, as rows of size 0.

    Equal groups of a range are one, ``times`` over.  ``only_few`` keeps groups with a set of too few segments.
    """

    def batch_of(columns: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
        kinds = {"grp": pa.int64(), "cid": pa.int64(), "times": pa.int32(), "size": pa.int32(), "key": pa.binary(), "n": pa.int32(), "spare": pa.int32()}
        return pa.RecordBatch.from_pydict({c: pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()})

    def classes(blobs: list[tuple]) -> pa.RecordBatch:
        table = np.concatenate([np.frombuffer(ids, _CLASS) for ids, _, _ in blobs])
        table = table[np.unique(table["cid"], return_index=True)[1]]
        columns = {c: table[c].astype(np.int32) for c in ("n", "spare")} | {"cid": table["cid"], "times": np.zeros(len(table), np.int32), "size": np.zeros(len(table), np.int32)}
        return batch_of(columns | {"key": [k.tobytes() for k in table["key"]]}, len(table))

    def resolved(blobs: list[tuple]) -> pa.RecordBatch | None:
        code = np.concatenate([np.frombuffer(codes, "<u4") for _, _, codes in blobs])
        order = np.argsort(code, kind="stable")
        code = code[order]
        twice = np.zeros(len(code), bool)
        twice[1:] = code[1:] == code[:-1]
        twice[:-1] |= twice[1:]
        order, code = order[twice], code[twice]
        cid = np.concatenate([np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4")) for ids, counts, _ in blobs])[order]
        order = np.lexsort((cid, code))
        code, cid = code[order], cid[order]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != code[:-1]) | (cid[1:] != cid[:-1])
        code, cid = code[keep], cid[keep]
        if not len(code):
            return None
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(code)]]))
        names = mixed(np.add.reduceat(mixed(cid.view(_U), 22), starts), 23)
        wanted = sizes > 1
        if only_few:
            wanted &= np.add.reduceat(cid & 1, starts) > 0
        if not wanted.any():
            return None
        picked, at, times = np.unique(names[wanted], return_index=True, return_counts=True)
        at = np.flatnonzero(wanted)[at]
        n = sizes[at]
        rows = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return batch_of({"grp": np.repeat(picked, n).view(np.int64), "cid": cid[rows], "times": np.repeat(times, n).astype(np.int32), "size": np.repeat(n, n).astype(np.int32)}, len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []

        def done() -> Iterator[pa.RecordBatch]:
            made = classes(blobs) if part is not None and part >= n_parts else resolved(blobs) if blobs else None
            if made is not None:
                yield made

        for batch in batches:
            for row in zip(*batch.columns):
                if row[0].as_py() != part:
                    yield from done()
                    part, blobs = row[0].as_py(), []
                blobs.append(tuple(x.as_buffer() for x in row[1:]))
        yield from done()

    return arrow_map(packed.repartition(n_parts, "part").sortWithinPartitions("part"), run, GROUPS)


def reduced(shingles: np.ndarray) -> bytes:
    """A set's hashes cut to 32 bits, sorted."""
    return np.sort(shingles.astype(np.uint32)).tobytes()


def most_common(left: np.ndarray, right: np.ndarray) -> int:
    """An upper bound on the common shingles of two sets, from the reduced hashes of both (a cut value may repeat)."""
    values, counts = np.unique(left, return_counts=True)
    there = np.searchsorted(right, values, "right") - np.searchsorted(right, values, "left")
    return int(np.minimum(counts, there).sum())


def word_shingles(text: str) -> frozenset:
    """The shingles as tuples of words: what the hashes stand for."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode("utf-8", "surrogatepass").lower())
    return frozenset(zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else frozenset([tuple(words)])


def candidate_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, n, cut, text) for the classes of ``reps`` (key, doc_id, text_hash), from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array([reduced(s) for s in sets], pa.binary()), batch.column("text")], ["key", "n", "cut", "text"])

    texts, _ = native_split(hashed(docs), reps, ["text_hash"])
    texts = texts.join(reps.withColumnRenamed("doc_id", "rep_id"), "text_hash").where(F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("key", "text").dropDuplicates(["key"])
    return arrow_map(texts, run, "key binary, n int, cut binary, text string")


def verified(pairs: DataFrame, sets: DataFrame, by_words: bool) -> DataFrame:
    """The pairs (a, b) of classes whose sets link: by reduced hashes, which may let a few others pass, or by words.

    Each set goes once to every pivot ``a`` it is compared with; a pivot with many partners is
    repeated for salts.
    """
    payload = "text" if by_words else "cut"
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(counts, "a")
    members = salted.select(F.col("b").alias("own"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"))
    pivots = counts.select(F.col("a").alias("own"), F.col("a").alias("pivot"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("side"))
    roles = members.unionByName(pivots).join(sets.select(F.col("key").alias("own"), "n", F.col(payload).alias("held")), "own").select("pivot", "salt", "side", "own", "n", "held")

    def opened(held: bytes | str) -> np.ndarray | frozenset:
        return word_shingles(held) if by_words else np.frombuffer(held, np.uint32)

    def common(left: np.ndarray | frozenset, right: np.ndarray | frozenset) -> int:
        return len(left & right) if by_words else most_common(left, right)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for whole in batches:
            for batch in slices(iter([whole]), "held"):
                a, b = [], []
                for key, salt, side, own, n, held in zip(*(c.to_pylist() for c in batch.columns)):
                    if side == 0:
                        group, pivot = (key, salt), (n, opened(held))
                    elif group == (key, salt) and 100 * min(n, pivot[0]) >= 80 * max(n, pivot[0]) and linked(common(pivot[1], opened(held)), pivot[0], n):
                        a.append(key)
                        b.append(own)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return arrow_map(roles.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "side"), compare, "a binary, b binary")


def links_across(few: list[tuple], many: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Pairs of a row of ``few`` and one of ``many`` (key, label, n, reduced hashes) whose labels differ and whose hashes link."""
    sizes = np.array([n for _, _, n, _ in many], np.int64)
    marks = np.unique([label for _, label, _, _ in many], return_inverse=True)
    names = {label: i for i, label in enumerate(marks[0].tolist())}
    token = np.concatenate([x for *_, x in many])
    owner = np.repeat(np.arange(len(many)), [len(x) for *_, x in many])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = []
    for key, label, n, own in few:
        own = np.unique(own)
        first, last = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        held = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
        common = np.bincount(owner[at], minlength=len(many))
        likely = (100 * common >= 80 * (n + sizes - common)) & (marks[1] != names.get(label, -1))
        out += [(key, many[i][0]) for i in np.flatnonzero(likely)]
    return out


def across(stars: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Likely links (a, b) between members of one star (pivot, key, n) in different components.

    Members outside a star's largest component meet all its members; both sides are cut by a hash of
    the class into blocks of about PER_BLOCK shingles.
    """
    marked = stars.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    by_label = marked.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    parts = by_label.groupBy("pivot").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max(F.struct("c", "label", "n"))["n"].alias("main_n"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    parts = parts.select("pivot", "main", F.expr(f"cast(ceil((all_n - main_n) / {PER_BLOCK}) AS int)").alias("rows_cut"), F.expr(f"cast(ceil(all_n / {PER_BLOCK}) AS int)").alias("columns_cut"))
    members = marked.join(parts, "pivot").withColumn("h", F.xxhash64("key"))
    few = members.where("label <> main").select("pivot", "key", "label", F.expr("cast(pmod(h, rows_cut) AS int)").alias("i"), F.explode(F.expr("sequence(0, columns_cut - 1)")).alias("j"), F.lit(0).alias("side"))
    many = members.select("pivot", "key", "label", F.explode(F.expr("sequence(0, rows_cut - 1)")).alias("i"), F.expr("cast(pmod(h, columns_cut) AS int)").alias("j"), F.lit(1).alias("side"))
    roles = few.unionByName(many).join(sets.select("key", "n", "cut"), "key").select("pivot", "i", "j", "side", "key", "label", "n", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if all(sides) and (found := links_across(*sides)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

        for batch in batches:
            for pivot, i, j, side, key, label, n, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if block != (pivot, i, j):
                    yield from done()
                    block, sides = (pivot, i, j), ([], [])
                sides[side].append((key, label, n, np.frombuffer(cut, np.uint32)))
        yield from done()

    return arrow_map(roles.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j"), run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key reachable, for every key that has a link."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.key).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.key == near.a).select("key", F.least("label", "near").alias("lower"), F.col("label").alias("was"))
        target = labels.select(F.col("key").alias("t_key"), F.col("label").alias("t_label"))
        jumped = materialize(lower.join(target, lower.lower == target.t_key, "left").select("key", F.least("lower", F.coalesce("t_label", "lower")).alias("label"), "was"), "labels")
        changed = jumped.where("label <> was").limit(1).count()
        discard(labels)
        labels = jumped.select("key", "label")
        if not changed:
            discard(edges)
            return labels


def rarest(groups: DataFrame) -> DataFrame:
    """(grp, key, n): of each set's groups those that it can't skip, the most frequent being skipped first."""
    spread = groups.where("size > 0").groupBy("grp", "cid").agg(F.sum("times").alias("times"), F.max("size").alias("size"))
    order = Window.partitionBy("cid").orderBy(F.col("size").desc(), "grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = spread.withColumn("frequent", F.sum("times").over(order))
    classes = groups.where("size = 0").select("cid", "key", "n", "spare").distinct()
    return ranked.join(classes, "cid").where("frequent > spare").select("grp", "key", "n")


def near_links(docs: DataFrame, sets: DataFrame, by_shingles: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """All links needed for components between classes, and the components; ``sets`` is materialized.

    ``by_shingles`` compares all sets on all shingles, as is done for those with too few segments.
    """
    spark = docs.sparkSession
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PER_PART) + 1)
    groups = materialize(shared_groups(packed_signatures(docs, n_parts, by_shingles), n_parts), "shared")
    kept = rarest(groups)
    if not by_shingles and groups.where("size = 0 AND cid % 2 <> 0").limit(1).count():
        kept = kept.union(rarest(shared_groups(packed_signatures(docs, n_parts, whole=True), n_parts, only_few=True)))
    kept = materialize(kept, "kept")
    discard(groups)
    degrees = kept.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    pivots = kept.join(degrees, "key").groupBy("grp").agg(F.max(F.struct("degree", "key"))["key"].alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = materialize(kept.join(pivots, "grp").select("pivot", "key", "n").distinct(), "stars")
    discard(kept)
    if not stars.limit(1).count():
        return None, None
    reps = sets.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep")).select("key", "rep.doc_id", "rep.text_hash")
    cut = materialize(candidate_sets(docs, reps.join(stars.select("key").distinct(), "key")), "candidates")
    likely = verified(stars.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")), cut, by_words=False)
    links = materialize(verified(likely, cut, by_words=True), "links")
    labels = components(links)
    more = materialize(across(stars, labels, cut).distinct(), "across")
    if more.limit(1).count():
        found = materialize(verified(more, cut, by_words=True), "links")
        if found.limit(1).count():
            discard(labels)
            links = links.union(found)
            labels = components(links)
    for done in (more, stars, cut):
        discard(done)
    return links, labels


def component_ids(docs: DataFrame, by_shingles: bool = False, keep_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; ``by_shingles`` as in ``near_links``.

    ``keep_keys`` adds text_hash and component_key, which tells components apart also where no doc_id does.
    """
    sets = materialize(document_sets(docs), "sets")
    _, labels = near_links(docs, sets, by_shingles)
    classes = sets.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        named = labels.join(classes, "key")
        smallest = named.groupBy("label").agg(F.min("least").alias("component"))
        classes = classes.join(named.join(smallest, "label").select("key", "label", "component"), "key", "left").select("key", F.coalesce("label", "key").alias("component_key"), F.coalesce("component", "least").alias("component"))
    else:
        classes = classes.select("key", F.col("key").alias("component_key"), F.col("least").alias("component"))
    classes = materialize(classes, "classes")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return sets.join(classes, "key", "left").select("doc_id", "n_shingles", own.alias("component_id"), *(["text_hash", "component_key"] if keep_keys else []))
