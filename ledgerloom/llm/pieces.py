"""SentencePiece encoding and decoding through a table of distinct marked words.

The model escapes spaces as the marker U+2581 and puts one before the text.  When no vocabulary
piece has a marker after another character (checked when the model is loaded), no merge crosses
from a word into the next marker, so a text may be cut before every run of markers and each
distinct marked word segmented once.  A worker keeps the table of the words that it has met, as
the decimal ids joined by commas and what these ids decode to, and the ids of a document are
joined back in the order of its words.  The table is emptied before it would hold more than
``MOST_WORDS`` words (or those of one batch), which bounds memory and changes no result.  A model that lacks the property is applied to whole texts.

Defined cases: a null text is the empty text, with no ids and the decoded text ''; runs of spaces,
leading and trailing spaces and literal markers go through the same cut; unknown characters become
byte pieces inside their word; very long words are segmented whole; equal texts give equal rows
and repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ledgerloom.llm.runtime import arrow_map, caches, id_and_text, slices

MARK = "▁"
MOST_WORDS = 400_000
MOST_TABLE = 64 << 20  # bytes of the words and ids that a worker's table holds
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[str, PieceCodec] = {}
caches[__name__] = _codecs.clear


class PieceCodec:
    """One model and its table of distinct marked words."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.by_words = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.normalize(f"a  {MARK}b ") == f"{MARK}a{MARK * 3}b{MARK}"
        self.alone = str(self.model.piece_to_id(MARK))
        self.empty_table()

    def empty_table(self) -> None:
        self.ids: dict[str, str] = {"": self.alone}  # of each marked word, joined by commas
        self.decoded: dict[str, str] = {}  # of the words that decoding changes
        self.held = 0  # bytes of the words and ids

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words without their first marker, spaces standing for markers; '' is a marker alone."""
        if "  " in text or MARK in text or text[:1] == " ":
            return [w[1:].replace(MARK, " ") for w in _MARKED.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ") if text else []

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.ids))
        if (len(self.ids) + len(new) > MOST_WORDS or self.held > MOST_TABLE) and len(self.ids) > 1:
            self.empty_table()
            new = list(words.difference(self.ids))
        encoded = self.model.encode(new, num_threads=1) if new else []
        for word, ids, back in zip(new, encoded, self.model.decode(encoded, num_threads=1) if new else []):
            self.ids[word] = ",".join(map(str, ids))
            self.held += 4 * len(word) + len(self.ids[word])
            if back != word:
                self.decoded[word] = back

    def code(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by commas, decoded text, for each text."""
        if not self.by_words:
            ids = self.model.encode(texts, num_threads=1)
            return [(len(x), ",".join(map(str, x)), self.model.decode(x)) for x in ids]
        cut = [self.words(t) for t in texts]
        self.learn({w for words in cut for w in words})
        find, changed, out = self.ids.__getitem__, self.decoded, []
        for words in cut:
            ids = ",".join(map(find, words))
            out.append((ids.count(",") + bool(ids), ids, " ".join(words if not changed else [changed.get(w, w) for w in words])))
        return out


def codec(model: str) -> PieceCodec:
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def encode_pieces(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ``keep_ids`` adds ids and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, "text", 4 << 20):
            rows = own.code(batch.column("text").to_pylist())
            arrays = [
                batch.column("doc_id"),
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in rows], pa.string()),
                pa.array([hashlib.sha256(back.encode()).hexdigest() for _, _, back in rows], pa.string()),
            ]
            if keep_ids:
                arrays += [pa.array([[int(x) for x in ids.split(",")] if ids else [] for _, ids, _ in rows], pa.list_(pa.int32())), pa.array([back for _, _, back in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    return arrow_map(id_and_text(docs), run, schema)
