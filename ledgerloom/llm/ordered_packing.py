"""Order-preserving packing: the token stream is cut into sequences where cutting costs least.

Documents in the order of their ids make a stream of token ids; a sequence is a window of at most
``capacity`` of them.  A window may end at a document's end for nothing, at a sentence's end for
``SENTENCE`` and, inside ``LONG`` tokens without either, at every ``STEP`` tokens for ``MIDDLE``.  A window
is padded to the capacity unless its length is a power of two.  Dynamic programming finds the cuts with
the least padding plus penalties: f(j) = penalty(j) + min over windows (i, j) of f(i) + padding.  The
padding is capacity - (p(j) - p(i)), so a monotone queue of f(i) + p(i) over the last ``capacity`` tokens gives
the best padded window at once, and one look for each power of two the best unpadded one.

Spark deals the texts out by ranges of ids, so that each task holds a stretch of the stream, and the cuts
are solved there as texts come in: ``BLOCK`` tokens at a time, of which the cuts before the last ``AHEAD``
are final and the rest is solved again with what follows.  Each stretch's end is a document's end.  So
memory is that of a block, or of one document if that is longer.

Ids come from a worker's table of the parts met so far.  The tokenizer drops white space and never joins
over it, so that a text is the sequence of its words.  A text of characters below U+0250 is lower-cased and
cut by the tokenizer's own pattern, other texts at white space; a part of letters is encoded by the
tokenizer's model itself, any other by the whole tokenizer.

Defined cases: a null text is the empty text, one id; a null doc_id comes first; equal rows are separate
documents, in any order; a document longer than a sequence is cut as any other; an empty table gives an
empty result; other columns are ignored.  The text of a special token is that token, as in the tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import arrow_map, caches, id_and_text, slices

SENTENCE, MIDDLE, LONG, STEP = 16, 512, 256, 32
BLOCK, AHEAD = 1 << 19, 1 << 17
MOST_WORDS = 700_000
MOST_TABLE = 64 << 20  # bytes of the words and ids that a worker's table holds
#: The tokenizer's pattern of parts, for lower-case texts below U+0250.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
ID = struct.Struct("<I").pack
ENDS = set(".!?。！？")
#: These are white space to ``str.split`` and not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_coders: dict[str, Words] = {}
caches[__name__] = _coders.clear


def _bytes_as_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Table(dict):
    """Parts and their ids; a part that is asked for the first time is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = self.encode(part)
        self.held += 4 * len(part) + len(ids)
        return ids


class Words:
    """Token ids, as little-endian 32-bit bytes, of texts by a table of the parts met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _bytes_as_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            body = token.removesuffix("</w>")
            self.ends[i] = body != token and not any(c.isalnum() for c in body) and bool(ENDS & set(body))
        for mark in "。！？":
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                self.ends[ids] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.empty_table()

    def empty_table(self) -> None:
        self.table = Table(self.of)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def low(text: str) -> bool:
        """Whether lower-casing, as the tokenizer does it after composing, is ``str.lower``: below U+0250 no character but one depends on others."""
        return text.isascii() or max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text)

    def of(self, part: str) -> bytes:
        if not part.isalpha() or not self.low(part):
            return self.whole(part)
        body = part.lower()
        tokens = self.model.tokenize(body if body.isascii() else body.encode().decode("latin-1").translate(self.letters))
        return b"".join([ID(t.id) for t in tokens])

    def parts(self, text: str) -> list[str] | None:
        if any(s in text for s in SEPARATORS):
            return None
        return PARTS.findall(text.lower()) if self.low(text) and not any(a in text for a in self.added) else text.split()

    def code(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > MOST_WORDS or self.table.held > MOST_TABLE:
            self.empty_table()
        find, out = self.table.__getitem__, []
        for text in texts:
            parts = self.parts(text)
            out.append(b"".join(map(find, parts)) if parts is not None else self.whole(text))
        return out


def words_of(path: str) -> Words:
    if path not in _coders:
        _coders[path] = Words(path)
    return _coders[path]


def padding(length: int, capacity: int) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


def candidates(sentence_ends: np.ndarray, document_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut, ascending from 0 to the last document's end, and their penalties."""
    every = np.unique(np.concatenate([[0], sentence_ends, document_ends]))
    gaps = np.flatnonzero(np.diff(every) > LONG)
    inside = [np.arange(every[g] + STEP, every[g + 1], STEP) for g in gaps]
    places = np.unique(np.concatenate([every, *inside]))
    penalty = np.full(len(places), MIDDLE)
    penalty[np.searchsorted(places, every)] = SENTENCE
    penalty[np.searchsorted(places, document_ends)] = 0
    penalty[0] = 0
    return places, penalty


def cheapest_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """f of every place, and the place (by number) where its last window starts."""
    n = len(places)
    # windows whose length is a power of two, by their end
    ends, starts = [], []
    for power in range(capacity.bit_length()):
        back = places - (1 << power)
        at = np.searchsorted(places, back)
        hit = np.flatnonzero((back >= 0) & (places[at] == back))
        ends.append(hit)
        starts.append(at[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    starts = starts[order].tolist()
    p, pen = places.tolist(), penalties.tolist()
    cost, back_to = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(p[0], p[0], 0)])  # (f + place, place, number), values ascending
    for j in range(1, n):
        here = p[j]
        while queue[0][1] < here - capacity:
            queue.popleft()
        value, _, best = queue[0]
        value += capacity - here
        for i in starts[first[j] : first[j + 1]]:
            if cost[i] < value:
                value, best = cost[i], i
        value += pen[j]
        cost[j], back_to[j] = value, best
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    return cost, back_to


def cuts_of(places: np.ndarray, penalties: np.ndarray, capacity: int, last: bool) -> np.ndarray:
    """The cuts from the first place to the last one, or to the best in the last window."""
    cost, back_to = cheapest_cuts(places, penalties, capacity)
    j = len(places) - 1
    if not last:
        near = range(int(np.searchsorted(places, places[-1] - capacity)), len(places))
        j = min(near, key=lambda i: cost[i] - places[i] // capacity)
    path = [j]
    while path[-1]:
        path.append(back_to[path[-1]])
    return places[path[::-1]]


class Stretch:
    """The token stream of one task: documents come in, pieces of finished sequences go out."""

    def __init__(self, ends: np.ndarray, capacity: int, first_id: int):
        self.ends, self.capacity, self.next_id = ends, capacity, first_id
        self.ids, self.held = [], 0
        self.docs: list[tuple] = []  # (doc_id, tokens, place of its first token)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), self.held))
        self.ids.append(ids)
        self.held += len(ids)

    def solve(self, last: bool) -> list[tuple]:
        """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the sequences that are final."""
        if not self.held:
            return []
        ids = np.concatenate(self.ids)
        begins = np.array([d[2] for d in self.docs])
        ends = begins + [d[1] for d in self.docs]
        places, penalties = candidates(np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1, ends)
        cuts = cuts_of(places, penalties, self.capacity, last)
        if not last:
            final = cuts[cuts <= self.held - AHEAD]
            cuts = final if len(final) > 1 else cuts
        upto = int(cuts[-1])
        bounds = np.unique(np.concatenate([cuts, ends[ends <= upto]]))
        doc = np.searchsorted(begins, bounds[:-1], "right") - 1
        window = np.searchsorted(cuts, bounds[:-1], "right") - 1
        raw, out = memoryview(ids.tobytes()), []
        for a, b, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), window.tolist()):
            doc_id, tokens, begin = self.docs[d]
            out.append((doc_id, a - begin, b - a, zlib.crc32(raw[4 * a : 4 * b]), tokens, self.next_id + w, a - int(cuts[w])))
        self.next_id += len(cuts) - 1
        self.docs = [(x, n, begin - upto) for (x, n, begin), end in zip(self.docs, ends.tolist()) if end > upto]
        self.ids, self.held = [ids[upto:]], self.held - upto
        return out


def pack_in_order(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; sequences follow the order of ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], "<u4").tobytes()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(tokenizer)
        stretch = Stretch(own.ends, capacity, TaskContext.get().partitionId() << 40)
        for batch in slices(batches, "text", 2 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.code(batch.column("text").to_pylist())):
                stretch.add(doc_id, np.frombuffer(ids + end, "<u4"))
                if stretch.held >= BLOCK:
                    yield packed(stretch.solve(last=False))
        yield packed(stretch.solve(last=True))

    # the row's number parts equal rows, so that any group of them can be split
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = id_and_text(docs).repartitionByRange(*order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return arrow_map(ordered, run, ", ".join(f"{c} long" for c in names))
