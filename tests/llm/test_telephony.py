import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import telephony as t
from sparkveil.llm.queries import op2_telephony_audio


def test_tables_have_the_standard_values():
    assert t.MULAW_PCM[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert t.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def plain_adpcm(block: bytes) -> list[int]:
    value, index = struct.unpack_from("<hB", block)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(t._STEPS[index])
            change = step >> 3
            change += step >> 2 if nibble & 1 else 0
            change += step >> 1 if nibble & 2 else 0
            change += step if nibble & 4 else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_blocks_decode_as_one_by_one():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (40, 68), dtype=np.uint8)
    blocks[:, 2] %= 89
    assert t.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_resampling_agrees_between_its_two_ways():
    pcm = np.random.default_rng(1).integers(-32768, 32768, 1000).astype(np.int16)
    at = np.arange(2000, dtype=np.int64) * 8000
    left, part = at // 16000, at % 16000
    slow = (pcm[left].astype(int) * (16000 - part) + pcm[np.minimum(left + 1, 999)].astype(int) * part) // 16000
    assert (t.resample(pcm, 8000, 16000) == slow).all()
    assert len(t.resample(pcm, 8000, 11025)) == 1000 * 11025 // 8000


def test_any_bytes_come_back_from_each_format():
    for raw in (b"", b"abc", bytes(range(256)), b"x" * 1000):
        payload = t.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == raw.rstrip(b"\0")
        for kind in (t.MULAW, t.ALAW, t.ADPCM):
            assert t.read_codes([t.store_codes(payload, kind)])[0][0] == payload
    assert t.read_codes([None, b"RIFF", b"not audio"]) == [None, None, None]


def test_query_against_plain_python(spark, tmp_path):
    texts = ["héllo", "", None, "a" * 64, "b" * 200_000, "héllo"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in op2_telephony_audio(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert out[0][1:] == out[5][1:]


def test_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", b"junk", "p"), (1, None, None, None)], "doc_id bigint, text string, media binary, pcm string")
    read = t.decode_media(df)
    assert [r["payload"] for r in read.collect()] == [None, None]
    again = t.decode_media(t.encode_media(df))
    assert again.columns.count("media") == 1 and again.where(F.col("payload").isNull()).count() == 0
    assert t.decode_media(t.encode_media(df.limit(0))).count() == 0


def test_malformed_files_give_nulls(spark):
    good = t.wav(t.MULAW, 8000, bytes(range(200)))
    rate = good.index(b"fmt ") + 12
    files = [good, good[:rate] + bytes(4) + good[rate + 4 :], good[:-20], good[:30], good.replace(b"fmt ", b"fmx "), b"", None, b"RIFF" + bytes(100)]
    out = t.decode_media(spark.createDataFrame(list(enumerate(files)), "i int, media binary")).orderBy("i").collect()
    assert bytes(out[0]["payload"]) == bytes(range(200))
    assert all(r[c] is None for r in out[1:] for c in ("payload", "pcm", "feature"))
