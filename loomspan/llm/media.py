"""Telephony audio columns (operator 10).

Stored form: RIFF/WAVE with 8-bit mu-law or A-law samples, or 4-bit IMA ADPCM blocks. Decoding expands the
companded samples by 256-entry lookup tables and ADPCM blocks step by step with one numpy vector over all
blocks of a batch; the decoded PCM is resampled and stored as 16-bit WAVE.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_of

MULAW, ALAW, ADPCM = 7, 6, 0x11
UNIT = 576  # payload bytes of an ADPCM block, and the padding unit
BLOCK_HEADER = 4
PASS_BLOCKS = 8192  # ADPCM blocks decoded at once: bounds a pass to about 19 MB of PCM
RATE_IN, RATE_OUT = 8000, 16000

# Fixed values of the IMA ADPCM format.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
    9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law expansion of every code."""
    u = ~np.arange(256) & 0xFF
    magnitude = (((u & 15) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law expansion of every code."""
    a = np.arange(256) ^ 0x55
    segment, mantissa = (a >> 4) & 7, (a & 15) << 4
    magnitude = np.where(segment == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows: header and nibbles, low nibble first), vectorised over the rows."""
    n, width = blocks.shape
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    data = blocks[:, BLOCK_HEADER:]
    out = np.empty((1 + 2 * (width - BLOCK_HEADER), n), dtype=np.int16)
    out[0] = predictor
    codes = np.empty((2 * (width - BLOCK_HEADER), n), dtype=np.int32)
    codes[0::2], codes[1::2] = (data & 15).T, (data >> 4).T
    # change of every (step index, nibble): the format's shift-and-add rule
    half = np.arange(16) & 7
    s = IMA_STEPS[:, None]
    change = (s >> 3) + (s >> 2) * (half & 1) + (s >> 1) * (half >> 1 & 1) + s * (half >> 2 & 1)
    change = np.where(np.arange(16) & 8, -change, change).astype(np.int32)
    for t in range(codes.shape[0]):
        nibble = codes[t]
        predictor += change[index, nibble]
        np.minimum(predictor, 32767, out=predictor)
        np.maximum(predictor, -32768, out=predictor)
        index += IMA_MOVES[nibble]
        np.minimum(index, 88, out=index)
        np.maximum(index, 0, out=index)
        out[t + 1] = predictor
    return out.T


def to_wave(payload: bytes, codec: int, rate: int = RATE_IN) -> bytes:
    """Container of ``payload`` (a multiple of UNIT bytes): every payload byte becomes a sample or two nibbles."""
    if codec == ADPCM:
        raw = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        body = np.hstack([np.zeros((len(raw), BLOCK_HEADER), np.uint8), raw]).tobytes()
        align = UNIT + BLOCK_HEADER
        fmt = struct.pack("<HHIIHHHH", codec, 1, rate, rate * align // (2 * UNIT + 1), align, 4, 2, 2 * UNIT + 1)
    else:
        body = payload
        fmt = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wave(media: bytes) -> tuple[int, int, memoryview]:
    """(codec, block size, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, align = 12, None, 1
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt ":
            codec, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif media[at : at + 4] == b"data":
            return codec, align, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(media: bytes) -> bytes:
    codec, align, data = from_wave(media)
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, BLOCK_HEADER:].tobytes() if codec == ADPCM else bytes(data)


def resample(pcm: np.ndarray, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> np.ndarray:
    """Linear interpolation; the doubling that telephony needs runs in integers."""
    if rate_out == rate_in or not len(pcm):
        return pcm
    if rate_out == 2 * rate_in:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * rate_out // rate_in) * (rate_in / rate_out)
    return np.interp(at, np.arange(len(pcm)), pcm).astype(np.int16)


def pcm_wave(pcm: np.ndarray, rate: int = RATE_OUT) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * len(pcm))
    return head + pcm.astype("<i2").tobytes()


def decode_all(media: list[bytes]) -> list[np.ndarray]:
    """PCM of every file; the ADPCM blocks of all files are decoded together, PASS_BLOCKS at a time."""
    parsed = [from_wave(m) for m in media]
    pcm: list = [None] * len(media)
    pending: list[tuple[int, np.ndarray]] = []
    for i, (codec, align, data) in enumerate(parsed):
        if codec == ADPCM:
            pending.append((i, np.frombuffer(data, np.uint8).reshape(-1, align)))
        else:
            pcm[i] = TABLES[codec][np.frombuffer(data, np.uint8)]
    if pending:
        blocks = np.vstack([b for _, b in pending])
        decoded = np.concatenate([decode_adpcm(blocks[k : k + PASS_BLOCKS]) for k in range(0, len(blocks), PASS_BLOCKS)])
        at = 0
        for i, b in pending:
            pcm[i] = decoded[at : at + len(b)].ravel()
            at += len(b)
    return pcm


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def choose_codec(payload: bytes) -> int:
    """The codec depends on the payload alone, so equal texts get equal files."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_pcm: bool = True) -> DataFrame:
    """Store every text losslessly as a telephony audio file and describe what is read back.

    Null texts count as empty (one unit of padding); ids pass through unchanged, nulls and repeats included; an empty table gives none.
    Returns id, n_bytes, media (the file), payload (read back), features and, unless declined, pcm: the resampled PCM as a WAVE file.
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_bytes long, media binary, payload binary, features string, pcm binary"

    def run(batch):
        texts = batch.column(1).to_pylist()
        payloads = [pad(t) for t in texts]
        media = [to_wave(p, choose_codec(p)) for p in payloads]
        features, stored = [], []
        for m, pcm in zip(media, decode_all(media), strict=True):
            up = resample(pcm)
            wide = pcm.astype(np.float64)
            crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
            name = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}[from_wave(m)[0]]
            features.append(f"{name};samples={len(pcm)};rms={np.sqrt(np.dot(wide, wide) / len(wide)):.3f};peak={int(np.abs(pcm.astype(np.int32)).max())};zc={crossings};pcm={RATE_OUT}:{len(up)}:{zlib.crc32(up.tobytes()):08x}")
            stored.append(pcm_wave(up) if keep_pcm else None)
        return {id_col: batch.column(0), "n_bytes": [len(t) for t in texts], "media": media, "payload": [payload_of(m) for m in media], "features": features, "pcm": stored}

    # ADPCM decoding costs the same for one block as for thousands: small partitions would waste it
    return map_batches(df.select(F.col(id_col), text_of(text_col).cast("binary")), run, schema)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("features").alias("feature"), F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )
