"""Telephony audio columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks,
WAV containers for the coded bytes, and resampled PCM.

`encode_media` puts any bytes into a WAV container as the code words themselves, so nothing is lost;
`decode_media` reads the container back: the code words, 16-bit PCM at the target rate, and features.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkveil.llm._common import map_arrow, slices

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE, TARGET_RATE = 8000, 16000
#: Code bytes of an ADPCM block behind its four-byte header; each holds two samples.
BLOCK_BYTES = 64


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(step == 0, low, (low + 256) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()

# Fixed values of the IMA ADPCM format: step sizes and index changes.
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (uint8, one row a block: predictor int16, index, 0, code bytes). Each
    step takes the same nibble of all blocks at once."""
    n = len(blocks)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = blocks[:, 4:]
    out = np.empty((n, 1 + 2 * codes.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * codes.shape[1]):
        nibble = ((codes[:, k >> 1] >> (4 * (k & 1))) & 15).astype(np.int32)
        step = _STEPS[index]
        change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + _MOVES[nibble & 7], 0, 88)
        out[:, k + 1] = value
    return out


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at another rate by linear interpolation between neighbours, in integers rounded down. There is no
    low-pass filter: going up leaves images of the spectrum above the old band, going down lets what is beyond the new
    one fold back."""
    if rate == target or not len(pcm):
        return pcm
    if target % rate == 0:
        times = target // rate
        a = pcm.astype(np.int32)
        b = np.concatenate((a[1:], a[-1:]))
        out = np.empty((len(pcm), times), np.int16)
        for k in range(times):
            out[:, k] = (a * (times - k) + b * k) // times if k else pcm
        return out.ravel()
    count = len(pcm) * target // rate
    at = np.arange(count, dtype=np.int64) * rate
    left, part = at // target, at % target
    a = pcm[left].astype(np.int64)
    b = pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int64)
    return ((a * (target - part) + b * part) // target).astype(np.int16)


def wav(kind: int, rate: int, data: bytes, *, align: int = 1, per_block: int = 1, bits: int = 8) -> bytes:
    """A RIFF WAV file of mono data. Formats other than PCM carry the sample count in a fact chunk."""
    extra = struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0) if kind != PCM else b""
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * align // per_block, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if kind != PCM:
        body += b"fact" + struct.pack("<II", 4, len(data) // align * per_block)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data of a WAV file; ValueError if it is not one, names no rate, or has fewer
    bytes of data than it says."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, align = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            if not rate:
                raise ValueError("no format, or a rate of 0")
            if at + 8 + size > len(media):
                raise ValueError("data cut short")
            return kind, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def store_codes(payload: bytes, kind: int) -> bytes:
    """A WAV file that holds payload as code words of the format; for ADPCM its length is a multiple of BLOCK_BYTES."""
    if kind in (MULAW, ALAW):
        return wav(kind, RATE, payload)
    codes = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_BYTES)
    blocks = np.zeros((len(codes), BLOCK_BYTES + 4), np.uint8)
    blocks[:, 4:] = codes
    # A block starts at the middle of the range and at the step its own first byte names, as an encoder would carry it.
    blocks[:, 2] = codes[:, 0] % 89
    return wav(ADPCM, RATE, blocks.tobytes(), align=BLOCK_BYTES + 4, per_block=1 + 2 * BLOCK_BYTES, bits=4)


def read_codes(files: list[bytes | None]) -> list[tuple[bytes, np.ndarray, int, int] | None]:
    """Code words, 16-bit PCM, rate and format tag of telephony WAV files; None for what is not one. ADPCM blocks
    of one size are decoded together, whatever file they are from."""
    out: list[tuple[bytes, np.ndarray, int, int] | None] = [None] * len(files)
    coded: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        try:
            kind, rate, align, data = read_wav(media or b"")
        except (ValueError, struct.error):
            continue
        raw = np.frombuffer(data, np.uint8)
        if kind in (MULAW, ALAW):
            out[i] = data, (MULAW_PCM if kind == MULAW else ALAW_PCM)[raw], rate, kind
        elif kind == ADPCM and align > 4:
            coded.setdefault(align, []).append((i, rate, raw[: len(raw) // align * align].reshape(-1, align)))
    for group in coded.values():
        samples = decode_adpcm(np.concatenate([blocks for _, _, blocks in group]))
        done = 0
        for i, rate, blocks in group:
            out[i] = blocks[:, 4:].tobytes(), samples[done : done + len(blocks)].ravel(), rate, ADPCM
            done += len(blocks)
    return out


def features(pcm: np.ndarray, rate: int, kind: int) -> str:
    """What the samples are like: format, milliseconds, peak, root mean square, zero crossings, share clipped."""
    if not len(pcm):
        return f"{kind}|0|0|0.00|0|0.0000"
    size = np.abs(pcm.astype(np.int32))
    low = pcm < 0
    power = int(np.square(size).sum(dtype=np.int64))
    clipped = np.count_nonzero(size >= 32124) / len(pcm)
    return f"{kind}|{len(pcm) * 1000 // rate}|{int(size.max())}|{(power / len(pcm)) ** 0.5:.2f}|{np.count_nonzero(low[1:] != low[:-1])}|{clipped:.4f}"


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))


def format_of(payload: bytes) -> int:
    """Which format holds the payload: chosen by its bytes alone, so equal texts are stored alike."""
    return (MULAW, ALAW, ADPCM)[(len(payload) // 64 + payload[0]) % 3]


def _mapped(df: DataFrame, source: str, added: dict[str, tuple[str, pa.DataType]], make, keep: list[str]) -> DataFrame:
    others = [c for c in keep if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                new = [pa.array(values, kind) for values, (_, kind) in zip(make(column.slice(a, b - a).to_pylist()), added.values())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), *new], names=[*others, *added])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), *(f"`{c}` {kind}" for c, (kind, _) in added.items())])
    return map_arrow(df.select(*(f"`{c}`" for c in dict.fromkeys([*others, source]))), run, schema)


def encode_media(df: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Store each whole text (UTF-8; null: empty), padded with zero bytes to a positive multiple of 64, as the
    code words of a WAV file. Adds `n_bytes` (unpadded) and `media`. Rows are kept one for one, repeated rows
    too, without a shuffle; the new columns replace those of their name."""

    def make(values: list[str | None]) -> tuple[list[int], list[bytes]]:
        raws = [(value or "").encode() for value in values]
        payloads = [padded(raw) for raw in raws]
        return [len(raw) for raw in raws], [store_codes(p, format_of(p)) for p in payloads]

    return _mapped(df, text, {"n_bytes": ("bigint", pa.int64()), "media": ("binary", pa.binary())}, make, keep if keep is not None else df.columns)


def decode_media(df: DataFrame, *, media: str = "media", target_rate: int = TARGET_RATE) -> DataFrame:
    """Read WAV files back. Adds `payload` (the code words), `pcm` (a PCM WAV file at target_rate) and `feature`;
    all three are null where `media` is null, not a telephony WAV file, without a rate, or cut short."""

    def make(values: list[bytes | None]) -> tuple[list[bytes | None], list[bytes | None], list[str | None]]:
        codes, files, said = [], [], []
        for read in read_codes(values):
            even = resample(read[1], read[2], target_rate) if read else None
            codes.append(read[0] if read else None)
            files.append(wav(PCM, target_rate, even.astype("<i2", copy=False).tobytes(), align=2, bits=16) if read else None)
            said.append(features(even, target_rate, read[3]) if read else None)
        return codes, files, said

    return _mapped(df, media, {"payload": ("binary", pa.binary()), "pcm": ("binary", pa.binary()), "feature": ("string", pa.string())}, make, df.columns)
