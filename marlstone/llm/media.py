"""Telephony audio in media columns.

Mu-law and A-law bytes expand to 16-bit samples by lookup tables; IMA ADPCM blocks are decoded by numpy across blocks, a
step for each pair of nibbles of all blocks at once. Decoded sound is resampled by a polyphase filter and stored as PCM.
Payloads are stored as WAVE files with 8-bit mu-law samples, so the stored form holds any bytes without loss.

Defined cases: a null or empty text is one unit of 255s; equal texts give equal values; a file that is no WAVE file of a
known format raises ValueError; long texts are handled whole; an empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import arrow_column

UNIT, PAD = 576, 255
RATE, STORED_RATE = 8000, 16000
PCM, ALAW, ULAW, IMA = 1, 6, 7, 17  # fixed values: WAVE format tags


def ulaw_table() -> np.ndarray:
    """The sample of each mu-law byte: complemented, then sign, three exponent bits and four mantissa bits."""
    b = ~np.arange(256) & 0xFF
    magnitude = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The sample of each A-law byte: every other bit inverted, then sign, exponent and mantissa."""
    b = np.arange(256) ^ 0x55
    exponent, mantissa = b >> 4 & 7, b & 15
    magnitude = np.where(exponent > 0, (mantissa * 16 + 264) << np.maximum(exponent - 1, 0), mantissa * 16 + 8)
    return np.where(b & 128, magnitude, -magnitude).astype(np.int16)


_ULAW, _ALAW = ulaw_table(), alaw_table()
# Fixed values of IMA ADPCM: index changes by nibble, and step sizes by index.
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + nibble: the change of the predictor, and the next index."""
    index, nibble = np.divmod(np.arange(len(_STEPS) * 16), 16)
    step = _STEPS[index]
    change = (step >> 3) + step * (nibble >> 2 & 1) + (step >> 1) * (nibble >> 1 & 1) + (step >> 2) * (nibble & 1)
    return np.where(nibble & 8, -change, change).astype(np.int32), (np.clip(index + _INDEX[nibble], 0, len(_STEPS) - 1) * 16).astype(np.int32)


_CHANGE, _NEXT = _transitions()


def decode_ima(data: np.ndarray, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks of `block` bytes to samples: a row of 2 * (block - 4) + 1 for each block.

    A block starts with its first sample (little-endian, 16 bits), the index (held within the table) and a spare byte.
    """
    blocks = data.reshape(-1, block)
    n = len(blocks)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (block - 4) + 1, n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(_STEPS) - 1).astype(np.int32) * 16
    out[0] = value
    for k, byte in enumerate(codes):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            at = index + nibble
            value = np.clip(value + _CHANGE[at], -32768, 32767)
            index = _NEXT[at]
            out[2 * k + half + 1] = value
    return out.T


def to_wave(data: bytes, tag: int = ULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A WAVE file of mono samples; 8-bit for the companded formats, 16-bit for PCM, blocks for IMA ADPCM."""
    bits = {PCM: 16, IMA: 4}.get(tag, 8)
    block = {PCM: 2, IMA: block}.get(tag, 1)
    per_block = 2 * (block - 4) + 1
    second = rate * block if tag != IMA else rate * block // per_block
    fmt = struct.pack("<HHIIHH", tag, 1, rate, second, block, bits)
    if tag != PCM:
        fmt += struct.pack("<HH", 2, per_block) if tag == IMA else struct.pack("<H", 0)
    n = {PCM: len(data) // 2, IMA: len(data) // max(block, 1) * per_block}.get(tag, len(data))
    fact = b"" if tag == PCM else struct.pack("<4sII", b"fact", 4, n)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wave(file: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data of a WAVE file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", file, at + 8)
        elif name == b"data":
            if fmt is None or fmt[1] != 1 or fmt[0] not in (PCM, ALAW, ULAW, IMA):
                raise ValueError("a WAVE file of another format")
            return fmt[0], fmt[2], fmt[4], file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without data")


def expand(tag: int, data: bytes, block: int = 1) -> np.ndarray:
    """16-bit samples of stored data."""
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raw = np.frombuffer(data, np.uint8)
    if tag == IMA:
        return decode_ima(raw[: len(raw) // block * block], block).ravel()
    return (_ULAW if tag == ULAW else _ALAW)[raw]


# Half-band filter for doubling the rate: the samples stay, and a sample between two comes from its six neighbours.
_HALF = np.array([3, -25, 150, 150, -25, 3], np.int32)


def double(samples: np.ndarray) -> np.ndarray:
    """Samples at twice the rate; beyond the ends, the end samples go on."""
    if not len(samples):
        return samples.astype("<i2")
    x = np.pad(samples.astype(np.int32), (2, 3), "edge")
    n = len(samples)
    between = (x[2 : n + 2] + x[3 : n + 3]) * _HALF[2] + (x[1 : n + 1] + x[4 : n + 4]) * _HALF[1] + (x[:n] + x[5 : n + 5]) * _HALF[0]
    out = np.empty(2 * n, "<i2")
    out[::2] = samples
    out[1::2] = np.clip((between + 128) >> 8, -32768, 32767)
    return out


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % UNIT or UNIT * (not raw))


def features(samples: np.ndarray) -> str:
    """Samples, root mean square, peak, sign changes and checksum of 16-bit PCM; whole numbers only."""
    wide = samples.astype(np.int64)
    rms = int(np.sqrt(int((wide * wide).sum()) // max(len(wide), 1)))
    negative = samples < 0
    return f"{len(samples)}/{rms}/{int(np.abs(wide).max(initial=0))}/{int((negative[1:] != negative[:-1]).sum())}/{zlib.crc32(samples.tobytes()):08x}"


def _store_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        raw = [t.as_py() for t in texts]
        yield pa.StructArray.from_arrays([pa.array([len(r or b"") for r in raw], pa.int64()), pa.array([to_wave(pad(r or b"")) for r in raw], pa.binary())], ["n_bytes", "media"])


_GROUP = 4 << 20


def _read_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    fields = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for files in batches:
        rows: list[tuple] = []
        group: list[bytes] = []
        size = 0
        for k, file in enumerate(files):
            group.append(file.as_py())
            size += len(group[-1])
            if size >= _GROUP or k + 1 == len(files):
                rows += _read_group(group)
                group, size = [], 0
        cols = list(zip(*rows)) or [[]] * len(fields)
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], fields)


def _read_group(files: list[bytes]) -> Iterator[tuple]:
    """Of each file: its payload's size, digest and tail checksum, its own size and digest, and the features of its sound.

    The payload is heard three ways, each with its decoder: as stored, resampled to 16 kHz; as A-law; and as IMA ADPCM
    blocks of one unit, which are decoded for all files of the group at once.
    """
    parsed = [from_wave(f) for f in files]
    whole = [data[: len(data) // UNIT * UNIT] for *_, data in parsed]
    ima = decode_ima(np.frombuffer(b"".join(whole), np.uint8), UNIT)
    at = 0
    for file, (tag, _, block, data), units in zip(files, parsed, whole):
        blocks = len(units) // UNIT
        heard = features(double(expand(tag, data, block))), features(expand(ALAW, data)), features(np.ascontiguousarray(ima[at : at + blocks]).ravel())
        at += blocks
        yield len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), "pcm16k={};alaw={};ima={}".format(*heard)


def _pcm_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for files in batches:
        out = []
        for file in files:
            tag, rate, block, data = from_wave(file.as_py()) if file.is_valid else (PCM, STORED_RATE, 2, b"")
            samples = expand(tag, data, block)
            out.append(None if not file.is_valid else to_wave((double(samples) if 2 * rate == STORED_RATE else samples).tobytes(), PCM, STORED_RATE if 2 * rate == STORED_RATE else rate))
        yield pa.array(out, pa.binary())


#: UTF-8 bytes -> n_bytes and media, a WAVE file of 8-bit mu-law samples.
store = arrow_column(_store_batches, "struct<n_bytes:bigint,media:binary>")
#: A stored file -> its payload's digests, its own, and features of its sound.
read = arrow_column(_read_batches, "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
#: A WAVE file of any known format -> a WAVE file of 16-bit PCM; 8 kHz becomes 16 kHz, other rates stay; null stays null.
to_pcm = arrow_column(_pcm_batches, "binary")


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the mu-law file) and pcm (its samples expanded and resampled, as a file) of each row of `docs`."""
    stored = docs.select(F.col(id_col), store(F.col(text_col).cast("binary")).alias("_m")).select(id_col, "_m.*")
    return stored.withColumn("pcm", to_pcm("media"))


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text and its sound as 16-bit PCM at 16 kHz, reads both stored files back, and returns id, n_bytes, the digests
    and the features, and of the PCM file its size and digest."""
    stored = store_documents(docs, id_col, text_col)
    told = stored.select(id_col, "n_bytes", read("media").alias("_r"), F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))
    return told.select(id_col, "n_bytes", "_r.*", "pcm_bytes", "pcm_sha256")
