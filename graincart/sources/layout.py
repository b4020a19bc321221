"""Files of the record format, without Spark: chunks framed into blocks, written and read back.

A ``Source`` is anything with ``size`` and ``read(at, n)``. ``read_chunks`` yields the chunks that
begin in a byte range, so a file can be read in splits; each chunk is owned by exactly one. With
recovery a range begins at the first sound block header at or after its start, and goes on to the
first one at or after its end: so the splits of a damaged file give what one reading gives.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from graincart.errors import BadSignature, ClosedWriter, CorruptBlock, CorruptChunk, InvalidBlockHeader, UnexpectedEnd
from graincart.functions.encoding import BLOCK, CHUNK_HEADER, HEADER, chunk_end, check_block_size, compress, decode_varint, decode_varints, decompress, encode_varint, encode_varints
from graincart.functions.hashing import highway64, highway64_many

SIGNATURE, PADDING, SIMPLE = ord("s"), ord("p"), ord("r")
CHUNK_BYTES = 1 << 20
#: Bytes of chunks that are hashed together; read-ahead of a scan of headers alone.
HASH_BYTES, HEADER_WINDOW = 64 << 20, 512


# --- writing


def _header_rest(kind: int, records: int, decoded: int, size: int, data_hash: int) -> bytes:
    return struct.pack("<QQB", size, data_hash, kind) + records.to_bytes(7, "little") + struct.pack("<Q", decoded)


def chunk_header(kind: int, records: int, decoded: int, size: int, data_hash: int) -> bytes:
    rest = _header_rest(kind, records, decoded, size, data_hash)
    return struct.pack("<Q", highway64(rest)) + rest


def signature() -> bytes:
    return chunk_header(SIGNATURE, 0, 0, 0, highway64(b""))


def framed(begin: int, chunk: bytes, block: int = BLOCK) -> bytes:
    """The bytes of a chunk from file position ``begin``, with a header at each block boundary."""
    end, at, done, out = chunk_end(begin, len(chunk), block), begin, 0, []
    while done < len(chunk):
        if at % block == 0:
            rest = struct.pack("<QQ", at - begin, end - at)
            out += [struct.pack("<Q", highway64(rest)), rest]
            at += HEADER
        take = min(block - at % block, len(chunk) - done)
        out.append(chunk[done : done + take])
        at, done = at + take, done + take
    return b"".join(out)


def chunk_cuts(sizes: np.ndarray, limit: int) -> list[int]:
    """Ends of runs of records: a run is closed after the record with which it reaches ``limit`` bytes."""
    sums, out, base, at = np.cumsum(sizes), [], 0, 0
    while at < len(sizes):
        at = int(np.searchsorted(sums, base + max(limit, 0), "left")) + 1
        if at > len(sizes):
            break
        at = max(at, (out[-1] if out else 0) + 1)
        out.append(at)
        base = int(sums[at - 1])
    return out


class FileWriter:
    """Appends records to a binary file object; chunks are hashed in groups, so that lanes stay wide."""

    def __init__(self, file, block: int = BLOCK, chunk: int = CHUNK_BYTES, codec: str = "none", level: int = 3, data_hash: bool = True, at: int = 0) -> None:
        self.file, self.block, self.chunk, self.codec, self.level, self.data_hash = file, check_block_size(block), chunk, codec, level, data_hash
        self.at, self.records, self.bytes = at, 0, 0
        self._held: list[bytes] = []
        self._size = 0
        self._ready: list[tuple[int, int, bytes]] = []
        self.ready_bytes, self.closed = 0, False
        if at == 0:
            self._emit(signature())

    def _emit(self, chunk: bytes) -> None:
        data = framed(self.at, chunk, self.block)
        self.file.write(data)
        self.at += len(data)

    def _open(self) -> None:
        if self.closed:
            raise ClosedWriter("the file is closed")

    def write(self, record: bytes) -> None:
        self._open()
        self._held.append(record)
        self._size += len(record)
        self.records += 1
        self.bytes += len(record)
        if self._size >= self.chunk:
            self.flush_chunk()

    def write_values(self, offsets: np.ndarray, data: memoryview) -> None:
        """Records that lie in one buffer, at ``offsets``."""
        self._open()
        sizes, at = np.diff(offsets), 0
        if self._held:
            while at < len(sizes) and self._held:
                self.write(bytes(data[offsets[at] : offsets[at + 1]]))
                at += 1
        start = at
        for cut in chunk_cuts(sizes[start:], self.chunk):
            end = start + cut
            self._close(sizes[at:end], data[offsets[at] : offsets[end]])
            at = end
        self.records += len(sizes) - start - (len(sizes) - at)
        self.bytes += int(offsets[at] - offsets[start])
        for k in range(at, len(sizes)):
            self.write(bytes(data[offsets[k] : offsets[k + 1]]))

    def _close(self, sizes: np.ndarray, values: bytes | memoryview) -> None:
        kind, packed = compress(bytes(values), self.codec, self.level)
        lengths = encode_varints(sizes)
        self._ready.append((len(sizes), len(values), b"".join([bytes([kind]), encode_varint(len(lengths)), lengths, packed])))
        self.ready_bytes += len(packed)
        if self.ready_bytes >= HASH_BYTES:
            drain([self])

    def flush_chunk(self) -> None:
        """A chunk boundary after the last record; no chunk if none is pending."""
        if self._held:
            self._close(np.array([len(r) for r in self._held]), b"".join(self._held))
            self._held, self._size = [], 0

    def flush(self) -> None:
        """All records so far are in the file."""
        self._open()
        self.flush_chunk()
        drain([self])
        self.file.flush()

    def end(self) -> None:
        """No more records; what is left to be hashed can wait for ``drain``."""
        if not self.closed:
            self.flush_chunk()
            self.closed = True

    def close(self) -> None:
        """Closing again does nothing."""
        if not self.closed:
            self.end()
            drain([self])
            self.file.flush()


def drain(writers: list[FileWriter]) -> None:
    """Hash the finished chunks of several files together, which keeps the lanes wide, and write them."""
    hashed = [w for w in writers if w.data_hash]
    hashes = iter(highway64_many([c[2] for w in hashed for c in w._ready]))
    rests = [_header_rest(SIMPLE, records, decoded, len(data), next(hashes) if w.data_hash else 0) for w in writers for records, decoded, data in w._ready]
    headers = (struct.pack("<Q", h) + rest for h, rest in zip(highway64_many(rests), rests, strict=True))
    for w in writers:
        for _, _, data in w._ready:
            w._emit(next(headers) + data)
        w._ready, w.ready_bytes = [], 0


# --- reading


class BytesSource:
    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class FileSource:
    """A random-access file with one window of read-ahead."""

    def __init__(self, file, size: int, window: int = 8 << 20) -> None:
        self.file, self.size, self.window = file, size, window
        self._at, self._data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self._at or at + n > self._at + len(self._data):
            self.file.seek(at)
            self._at, self._data = at, self.file.read(min(max(n, self.window), max(0, self.size - at)))
        return self._data[at - self._at : at - self._at + n]


@dataclass
class Chunk:
    begin: int
    end: int
    kind: int
    records: int
    data_size: int
    decoded: int
    data_hash: int
    data: bytes | None = None


@dataclass
class Skip:
    """A place where recovery went on."""

    at: int
    reason: str


def block_header(source, at: int, block: int) -> tuple[int, int]:
    raw = source.read(at, HEADER)
    if len(raw) < HEADER:
        raise UnexpectedEnd(f"block header at {at} is cut")
    told, prev, after = struct.unpack("<3Q", raw)
    if highway64(raw[8:]) != told:
        raise CorruptBlock(f"block header at {at}: wrong hash")
    if prev % block >= block - HEADER or after == 0 or (after - 1) % block < HEADER:
        raise InvalidBlockHeader(f"block header at {at}: impossible values")
    return prev, after


class _Inconsistent(CorruptBlock):
    def __init__(self, at: int, begin: int) -> None:
        super().__init__(f"block header at {at} belongs to another chunk")
        self.begin = begin


def _payload(source, begin: int, at: int, n: int, block: int, checked: bool = True) -> tuple[bytes, int]:
    """``n`` bytes of a chunk from position ``at``, block headers verified and taken out; and where they end."""
    parts = []
    while n:
        if at % block == 0:
            if at >= source.size:
                raise UnexpectedEnd(f"file ends in the chunk at {begin}")
            if checked:
                prev, _ = block_header(source, at, block)
                if prev != at - begin:
                    raise _Inconsistent(at, at - prev)
            at += HEADER
        take = min(block - at % block, n)
        part = source.read(at, take)
        if len(part) < take:
            raise (UnexpectedEnd if at // block != begin // block else CorruptChunk)(f"file ends in the chunk at {begin}")
        parts.append(part)
        at, n = at + take, n - take
    return b"".join(parts) if len(parts) != 1 else parts[0], at


def _parse_header(raw: bytes, begin: int, block: int) -> Chunk:
    told, size, data_hash, kind = struct.unpack_from("<3QB", raw)
    if highway64(raw[8:]) != told:
        raise CorruptChunk(f"chunk header at {begin}: wrong hash")
    if kind not in (SIGNATURE, PADDING, SIMPLE):
        raise CorruptChunk(f"chunk at {begin}: unknown type {kind}")
    return Chunk(begin, chunk_end(begin, CHUNK_HEADER + size, block), kind, int.from_bytes(raw[25:32], "little"), size, struct.unpack_from("<Q", raw, 32)[0], data_hash)


def _resume(source, bad: int, begin: int, block: int) -> int:
    """Where to go on after trouble at ``bad`` in the chunk at ``begin``: the next chunk that a valid block header tells of."""
    at = (bad // block + 1) * block
    while at < source.size:
        try:
            prev, after = block_header(source, at, block)
        except (CorruptBlock, UnexpectedEnd):  # impossible values too: only what reading meets first is refused
            at += block
            continue
        return at - prev if at - prev > bad else at + after
    return source.size


def first_owned(source, start: int, block: int) -> int:
    """The first chunk that begins at or after the block boundary ``start``."""
    if start == 0 or start >= source.size:
        return start
    prev, after = block_header(source, start, block)
    return start if prev == 0 else start + after


def sound_boundary(source, at: int, block: int) -> int:
    """The first block boundary at or after ``at`` with a sound header; 0, and the file's end, are such."""
    while 0 < at < source.size:
        try:
            block_header(source, at, block)
            return at
        except (CorruptBlock, UnexpectedEnd):
            at += block
    return min(at, source.size)


def _header_of(source, begin: int, block: int, recover: bool) -> tuple[Chunk, int, CorruptBlock | None]:
    """(chunk, where its data begins, the damage met): with ``recover``, a header across a damaged block header is still taken if its own hash holds."""
    try:
        raw, after = _payload(source, begin, begin, CHUNK_HEADER, block)
        return _parse_header(raw, begin, block), after, None
    except (InvalidBlockHeader, _Inconsistent):
        raise
    except CorruptBlock as bad:
        if not recover:
            raise
        try:
            raw, after = _payload(source, begin, begin, CHUNK_HEADER, block, checked=False)
            return _parse_header(raw, begin, block), after, bad
        except (CorruptChunk, UnexpectedEnd):
            raise bad from None


def read_chunks(source, start: int = 0, stop: int | None = None, block: int = BLOCK, recover: bool = False, data: bool = True) -> Iterator[Chunk | Skip]:
    """Chunks that begin in [start, stop), signatures aside; with ``data`` false, headers only.

    ``recover``: damage gives a ``Skip`` and reading goes on; a bad signature, a block header with a
    right hash and impossible values, and an end inside a chunk over several blocks still fail.
    """
    stop = source.size if stop is None else min(stop, source.size)
    if start == 0:
        try:
            raw, _ = _payload(source, 0, 0, CHUNK_HEADER, block)
            if _parse_header(raw, 0, block).kind != SIGNATURE or raw != signature():
                raise BadSignature("the file does not begin with a signature")
        except (CorruptBlock, CorruptChunk, UnexpectedEnd) as bad:
            raise BadSignature(f"the file does not begin with a signature: {bad}") from bad
    if recover:
        start, stop = sound_boundary(source, start, block), sound_boundary(source, stop, block)
    if start >= stop:
        return
    at = first_owned(source, start, block)
    while at < stop:
        begin, found = at, None
        try:
            found, after, bad = _header_of(source, begin, block, recover)
            if bad:
                raise bad
            if found.kind == SIGNATURE and (found.data_size or found.records or found.decoded):
                raise CorruptChunk(f"signature at {begin} is not empty")
            if data:
                found.data, _ = _payload(source, begin, after, found.data_size, block)
        except InvalidBlockHeader:
            raise
        except _Inconsistent as bad:
            if not recover:
                raise
            yield Skip(begin, str(bad))
            at = bad.begin if bad.begin > begin else _resume(source, begin, begin, block)
            continue
        except (CorruptBlock, CorruptChunk) as bad:
            if not recover:
                raise
            yield Skip(begin, str(bad))
            # the end of a chunk whose own header is sound is known
            at = found.end if found else _resume(source, begin, begin, block)
            continue
        at = found.end
        if found.kind != SIGNATURE:
            yield found


def decode(chunk: Chunk) -> tuple[np.ndarray, bytes]:
    """(offsets, values) of the records of a chunk whose hash has been checked."""
    if chunk.kind != SIMPLE:
        raise CorruptChunk(f"chunk at {chunk.begin}: type {chr(chunk.kind)} holds no records")
    if not chunk.data:
        raise CorruptChunk(f"chunk at {chunk.begin} is empty")
    size, at = decode_varint(chunk.data, 1)
    sizes = decode_varints(chunk.data[at : at + size], chunk.records)
    values = decompress(chunk.data[0], chunk.data[at + size :], chunk.decoded)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] != len(values):
        raise CorruptChunk(f"chunk at {chunk.begin}: sizes do not add up")
    return offsets, values


def read_records(source, start: int = 0, stop: int | None = None, block: int = BLOCK, recover: bool = False, group: int = HASH_BYTES) -> Iterator[tuple[Chunk, np.ndarray, bytes] | Skip]:
    """(chunk, offsets, values) in order; data hashes are checked for groups of chunks together."""
    for _, found in read_ranges([(None, source, start, stop)], block, recover, group):
        yield found


def read_ranges(ranges: Iterable[tuple], block: int = BLOCK, recover: bool = False, group: int = HASH_BYTES) -> Iterator[tuple[object, tuple[Chunk, np.ndarray, bytes] | Skip]]:
    """(name, what ``read_records`` gives) of ranges (name, source, start, stop) of one or several files, one after the other.

    Groups of chunks go over the ends of ranges. An error has the name of its range as ``range``.
    """
    held: list[tuple[object, Chunk]] = []
    total = 0

    def settle(held):
        checked = [c for _, c in held if c.data_hash]
        good = {id(c): h == c.data_hash for c, h in zip(checked, highway64_many([c.data for c in checked]), strict=True)}
        for name, c in held:
            try:
                if not good.get(id(c), True):
                    raise CorruptChunk(f"chunk at {c.begin}: wrong data hash")
                yield name, (c, *decode(c))
            except CorruptChunk as bad:
                if not recover:
                    bad.range = name
                    raise
                yield name, Skip(c.begin, str(bad))

    name = None
    try:
        for name, source, start, stop in ranges:
            for found in read_chunks(source, start, stop, block, recover):
                if isinstance(found, Skip):
                    yield name, found
                    continue
                held.append((name, found))
                total += found.data_size
                if total >= group:
                    yield from settle(held)
                    held, total = [], 0
    except Exception as bad:
        if not hasattr(bad, "range"):
            yield from settle(held)  # what came before the damage is delivered first
            bad.range = name
        raise
    yield from settle(held)
