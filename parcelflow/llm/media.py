"""Telephony audio in media columns: mu-law and A-law by lookup tables, IMA ADPCM blocks with numpy across
blocks, resampling, and WAV containers."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
RATE, STORED_RATE = 8_000, 16_000
#: A payload is padded with bytes 255 to a positive multiple of this.
FRAME = 576
#: Bytes of an ADPCM block: 4 of header, the rest two samples each.
ADPCM_BLOCK = 144


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, low + 264 << np.maximum(step, 1) - 1)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()

#: Step sizes of IMA ADPCM (fixed values of the format).
ADPCM_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
#: Change of the step index by a nibble's size (fixed values of the format).
ADPCM_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# the difference that a nibble stands for at each step, and the step index after it
_NIBBLE = np.arange(16)
_DIFFERENCE = np.where(_NIBBLE & 8, -1, 1) * ((ADPCM_STEPS[:, None] >> 3) + (ADPCM_STEPS[:, None] >> 2) * (_NIBBLE & 1) + (ADPCM_STEPS[:, None] >> 1) * (_NIBBLE >> 1 & 1) + ADPCM_STEPS[:, None] * (_NIBBLE >> 2 & 1))
_NEXT_INDEX = np.clip(np.arange(89)[:, None] + ADPCM_INDEX[_NIBBLE & 7], 0, 88)
_DIFFERENCE, _NEXT_INDEX = _DIFFERENCE.astype(np.int32).ravel(), _NEXT_INDEX.astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x samples, int16) of mono IMA ADPCM blocks (blocks x bytes): one step in time for all blocks
    at once. A header is the first sample (2 bytes), the step index (kept within its table) and a spare byte."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value
    for i, column in enumerate(data):
        for k, nibble in enumerate((column & 15, column >> 4)):
            at = index * 16 + nibble
            value = np.clip(value + _DIFFERENCE[at], -32768, 32767)
            index = _NEXT_INDEX[at]
            out[1 + 2 * i + k] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if not len(pcm) or rate == to:
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // to, at % to
    wide = pcm.astype(np.int64)
    return ((wide[low] * (to - part) + wide[np.minimum(low + 1, len(pcm) - 1)] * part) // to).astype(np.int16)


def doubled(pcm: np.ndarray) -> np.ndarray:
    """``resample`` to twice the rate."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = wide[:-1] + wide[1:] >> 1
    out[-1:] = pcm[-1:]
    return out


def write_wav(data: bytes, kind: int, rate: int = RATE, block: int = 0) -> bytes:
    """A mono WAV file of samples that are already in the format ``kind``."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA_ADPCM: 4}[kind]
    align = block or bits // 8
    per_second = rate * align // (1 + 2 * (block - 4)) if block else rate * align
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if kind == IMA_ADPCM else struct.pack("<H", 0) if kind != PCM else b""
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, bytes of a block and stored samples of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif media[at : at + 4] == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or data is None or fmt[1] != 1:
        raise ValueError("not a mono WAV file")
    if fmt[2] == 0 or fmt[4] == 0 or (fmt[0] == IMA_ADPCM and fmt[4] <= 4):
        raise ValueError("a rate or block of nothing")
    return fmt[0], fmt[2], fmt[4], data


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (int16) and rate of a WAV file of any of the four formats; whole ADPCM blocks only."""
    kind, rate, block, data = read_wav(media)
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return MULAW_TABLE[raw], rate
    if kind == ALAW:
        return ALAW_TABLE[raw], rate
    if kind == IMA_ADPCM:
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel(), rate
    if kind == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2"), rate
    raise ValueError(f"format {kind}")


def store_pcm(media: DataFrame, column: str = "media", rate: int = STORED_RATE) -> DataFrame:
    """The rows with ``pcm``: the media column decoded, resampled and stored as a 16-bit WAV (null where it is null or
    no sound mono WAV file of a known format: cut off, of another kind, or with a rate or block of zero). A column of that
    name is replaced; rows that repeat stay; an empty table has no rows."""
    common.small_batches(media.sparkSession)
    names = [n for n in media.columns if n != "pcm"]

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for value in batch.column(batch.schema.names.index(column)).to_pylist():
                try:
                    pcm, own = decode(value)
                    out.append(write_wav(resample(pcm, own, rate).tobytes(), PCM, rate))
                except (ValueError, TypeError, struct.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in names] + [pa.array(out, pa.binary())], [*names, "pcm"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields if f.name != "pcm")
    return media.mapInArrow(one, kept + ", pcm binary")


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text (null: none) and its payload, padded with bytes 255 to a positive multiple of ``FRAME``."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each whole text's payload as the 8-bit mu-law samples of a WAV file, written to
    the shared folder as a media column and read back."""
    common.small_batches(docs.sparkSession)

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            rows = [payload(t) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([write_wav(r[1], MULAW) for r in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(one, "doc_id long, n_bytes long, media binary"), "media")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.int64)


def read_features(stored: DataFrame) -> DataFrame:
    """Each stored WAV file read back: its sizes and hashes, and features of its samples after mu-law expansion,
    resampling to 16 kHz, and of the same bytes taken as A-law samples and as ADPCM blocks."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(stream):
            data = [read_wav(m)[3] for m in b["media"]]
            size = np.array([len(d) for d in data], np.int64)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            raw = np.frombuffer(b"".join(data), np.uint8)
            linear = MULAW_TABLE[raw]
            turned = np.diff(linear < 0, prepend=linear[:1] < 0)
            turned[starts] = False
            square = linear.astype(np.int32) ** 2
            a_law = np.abs(ALAW_TABLE[raw].astype(np.int32))
            adpcm = np.abs(decode_adpcm(raw.reshape(-1, ADPCM_BLOCK)).astype(np.int32)).sum(axis=1)
            energy, crossings, a_sum, d_sum = _sums(square, starts), _sums(turned.view(np.uint8), starts), _sums(a_law, starts), _sums(adpcm, starts // ADPCM_BLOCK)
            peak = np.maximum.reduceat(np.abs(linear), starts)
            rows = []
            for i, (doc_id, n, media, own) in enumerate(zip(b["doc_id"], b["n_bytes"], b["media"], data)):
                pcm = doubled(linear[starts[i] : starts[i] + size[i]])
                m = int(size[i])
                feature = f"pcm16k_samples={len(pcm)};pcm16k_crc32={zlib.crc32(pcm.tobytes())};rms={int((int(energy[i]) / m) ** 0.5)};peak={int(peak[i])};crossings={int(crossings[i])};alaw_mean={int(a_sum[i]) // m};adpcm_mean={int(d_sum[i]) // m}"
                rows.append((doc_id, n, m, hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    common.small_batches(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(one, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
