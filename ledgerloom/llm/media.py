"""Media columns: bytes kept as 8-bit WAV, short-time spectra and peak-pair fingerprints.

A payload becomes a one-channel 8-bit WAV file written and read by the standard ``wave`` module.
The samples read back go through a Hann-windowed short-time Fourier transform.  In each of a few
frequency bands the strongest bin of a frame is a peak when it is not weaker than the same band's
peak in the frames before and after.  Each peak is paired with the next few peaks in time; a pair
is coded as (time of the first peak, first bin, second bin, frames between) and the fingerprint is
the array of these codes in time order.

Defined cases: a null text is the empty text; the payload is the UTF-8 text with zero bytes up to
a positive multiple of 64, so an empty text has 64 zero bytes; a silent signal (constant samples)
has no peaks and the empty fingerprint; equal texts have equal values, repeated rows stay repeated;
an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored; a
null ``doc_id`` is kept.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.runtime import arrow_map, id_and_text, slices

UNIT = 64
FRAME = 512
HOP = 256
BANDS = (1, 8, 24, 64, 128, 257)  # bin edges
FAN_OUT = 2
MOST_FRAMES_APART = 63
BLOCK = 2048  # frames transformed at once
_HANN = np.hanning(FRAME).astype(np.float32)


def padded(text: str) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its bytes with zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples expected")
        return w.readframes(w.getnframes())


def band_peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bin and magnitude of the strongest bin of every frame and band; frames are rows."""
    samples = np.frombuffer(payload, np.uint8)
    # the last frame covers the end of the payload, silence fills it
    whole = FRAME + max(0, -(-(len(samples) - FRAME) // HOP)) * HOP
    samples = np.pad(samples, (0, whole - len(samples)), constant_values=128)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, sizes = [], []
    for at in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft((frames[at : at + BLOCK].astype(np.float32) - 128) * _HANN, axis=1)).astype(np.float32)
        best = [power[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:])]
        bins.append(np.stack(best, axis=1))
        sizes.append(np.stack([power[np.arange(len(power)), x] for x in best], axis=1))
    return np.concatenate(bins), np.concatenate(sizes)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of the peak pairs, by time."""
    bins, sizes = band_peaks(payload)
    edge = np.zeros((1, sizes.shape[1]), np.float32)
    before, after = np.concatenate([edge, sizes[:-1]]), np.concatenate([sizes[1:], edge])
    times, bands = np.nonzero((sizes > 1e-3) & (sizes >= before) & (sizes > after))
    found = bins[times, bands]
    first_times, codes = [], []
    for step in range(1, FAN_OUT + 1):
        if len(times) > step:
            apart = times[step:] - times[:-step]
            near = apart <= MOST_FRAMES_APART
            first_times.append(times[:-step][near])
            codes.append(((found[:-step] << 15) | (found[step:] << 6) | apart)[near])
    if not first_times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    when, code = np.concatenate(first_times), np.concatenate(codes)
    order = np.lexsort((code, when))
    return when[order], code[order]


def coded(times: np.ndarray, codes: np.ndarray) -> str:
    """The time-coded array as text: eight hex digits of time and eight of code for each pair."""
    return np.stack([times, codes], axis=1).astype(">u4").tobytes().hex()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pairs long, feature string, pair_times array<long>, pair_codes array<long>"


def media_features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document with what its stored WAV yields, the time-coded arrays among it; ``keep_media`` adds the file."""
    schema = FEATURES + (", media binary" if keep_media else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                n_bytes, payload = padded(text)
                media = to_wav(payload)
                back = from_wav(media)
                times, codes = fingerprint(back)
                row = (n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(times), coded(times, codes), times, codes)
                rows.append(row + ((media,) if keep_media else ()))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pairs", "feature", "pair_times", "pair_codes", "media"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names[: len(arrays)]])

    return arrow_map(id_and_text(docs), run, schema)
