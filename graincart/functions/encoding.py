"""Variable-length integers, block arithmetic and codecs of the record format, as Python and as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from graincart.errors import CorruptChunk, InvalidOption

BLOCK, HEADER, CHUNK_HEADER = 1 << 16, 24, 40
NONE, ZSTD = 0, ord("z")


def check_block_size(size: int) -> int:
    if size < 2 * HEADER:
        raise InvalidOption(f"block size {size} is below {2 * HEADER}")
    return size


def encode_varint(value: int) -> bytes:
    """Groups of seven bits, lowest first. The format goes on while the rest is 127 or more."""
    out = bytearray()
    while value >= 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next place)."""
    value = 0
    for shift in range(0, 64, 7):
        if at >= len(data):
            raise CorruptChunk("integer without an end")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & ((1 << 64) - 1), at
    raise CorruptChunk("integer too long")


def encode_varints(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    if (values < 0x7F).all():
        return values.astype(np.uint8).tobytes()
    return b"".join(map(encode_varint, values.tolist()))


def decode_varints(data: bytes, count: int) -> np.ndarray:
    """Exactly ``count`` integers that fill ``data``."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if len(ends) != count or (count and ends[-1] != len(raw) - 1) or (not count and len(raw)):
        raise CorruptChunk("record sizes do not fit the record count")
    if not count:
        return np.empty(0, np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    if (ends - starts).max() > 8:
        raise CorruptChunk("record size too long")
    place = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (place * np.uint64(7)), starts).astype(np.int64)


def varint_size(value: Column) -> Column:
    """Bytes of the encoded form."""
    size = F.lit(10)
    for k in range(8, -1, -1):
        size = F.when(value < F.lit(127 * 128**k), k + 1).otherwise(size)
    return size


def chunk_end(begin, size, block: int = BLOCK):
    """Where a chunk of ``size`` bytes from ``begin`` ends, block headers included (ints or columns)."""
    usable = block - HEADER
    total = size + (begin + (usable - 1)) % block
    headers = F.floor(total / usable) if isinstance(total, Column) else total // usable
    return begin + size + headers * HEADER


def _zstd(data: bytes, level: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzstd(data: bytes, size: int) -> bytes:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompress(bytes(data), max_output_size=size) if size else b""
    except zstandard.ZstdError as bad:
        raise CorruptChunk(f"zstd: {bad}") from bad


#: Name -> (byte in the file, compress(data, level), decompress(data, size)); ``register_codec`` adds to it.
CODECS: dict[str, tuple[int, Callable[[bytes, int], bytes], Callable[[bytes, int], bytes]]] = {
    "none": (NONE, lambda data, level: data, lambda data, size: data),
    "zstd": (ZSTD, _zstd, _unzstd),
}


def register_codec(name: str, byte: int, compress_, decompress_) -> None:
    """Make a codec known to this process; on a cluster, from a module that the workers import too."""
    if any(b == byte for n, (b, *_) in CODECS.items() if n != name):
        raise InvalidOption(f"byte {byte} belongs to another codec")
    CODECS[name] = byte, compress_, decompress_


def check_codec(codec: str, level: int) -> None:
    if codec not in CODECS:
        raise InvalidOption(f"unknown compression {codec}")
    if codec == "zstd" and not 1 <= level <= 22:
        raise InvalidOption(f"zstd level {level} is not in 1 to 22")


def compress(data: bytes, codec: str, level: int = 3) -> tuple[int, bytes]:
    check_codec(codec, level)
    byte, pack, _ = CODECS[codec]
    return byte, pack(data, level)


def decompress(kind: int, data: bytes, size: int) -> bytes:
    unpack = next((c[2] for c in CODECS.values() if c[0] == kind), None)
    if unpack is None:
        raise CorruptChunk(f"unsupported compression {kind}")
    out = unpack(data, size)
    if len(out) != size:
        raise CorruptChunk(f"{len(out)} bytes after decompression, {size} expected")
    return out
