import hashlib
import zlib

import numpy as np
import pytest

from parcelflow.llm import media


def test_companding_tables():
    assert media.MULAW_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def adpcm_by_hand(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.ADPCM_STEPS[index])
            change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(media.ADPCM_INDEX[nibble & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_against_one_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (7, media.ADPCM_BLOCK), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [adpcm_by_hand(b.tobytes()) for b in blocks]


def test_resampling_and_containers():
    pcm = np.array([0, 100, -100, 32767], np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == media.doubled(pcm).tolist() == [0, 50, 100, 0, -100, 16333, 32767, 32767]
    assert media.resample(pcm, 8000, 4000).tolist() == [0, -100] and len(media.resample(pcm[:0], 8000, 16000)) == 0
    for kind, block in ((media.PCM, 0), (media.ALAW, 0), (media.MULAW, 0), (media.IMA_ADPCM, 144)):
        assert media.read_wav(media.write_wav(b"abcd" * 36 + b"e" * (kind != media.PCM), kind, block=block))[::3] == (kind, b"abcd" * 36 + b"e" * (kind != media.PCM))
    with pytest.raises(ValueError):
        media.read_wav(b"RIFFxxxxWAVE")


def test_stored_texts_read_back(spark):
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, "x" * 576), (4, "x" * 576), (None, "y" * 577)]
    got = media.read_features(media.store_texts(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, media int"))).collect()
    want = []
    for doc_id, text in rows:
        n, payload = media.payload(text)
        assert len(payload) % 576 == 0 and payload
        want.append((doc_id or 0, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({r.feature for r in got if r.doc_id == 4}) == 1
    assert media.read_features(media.store_texts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_decoding_a_media_column(spark):
    files = [media.write_wav(b"\x80\xff", media.MULAW), b"junk", None]
    got = [r.pcm for r in media.store_pcm(spark.createDataFrame([(f, "x") for f in files], "media binary, pcm string")).collect()]
    assert media.decode(got[0])[0].tolist() == [32124, 16062, 0, 0] and got[1:] == [None, None]


def test_malformed_files_are_null(spark):
    sound = media.write_wav(bytes(288), media.IMA_ADPCM, block=144)
    broken = []
    for at, value in ((24, bytes(4)), (32, bytes(2)), (32, b"\4\0"), (20, b"\x99\0"), (22, b"\2\0")):  # rate, block, kind, channels
        broken.append(sound[:at] + value + sound[at + len(value) :])
    broken += [sound[:i] for i in (0, 11, 12, 20, 30, 43)] + [media.write_wav(b"", media.MULAW), media.write_wav(b"abc", media.PCM)]
    got = [r.pcm for r in media.store_pcm(spark.createDataFrame([(f,) for f in [sound, *broken]], "media binary")).collect()]
    assert got[0] is not None and got[1:12] == [None] * 11
    assert len(media.decode(got[12])[0]) == 0 and len(media.decode(got[13])[0]) == 2
