"""Golden bytes, round trips, splits and damage of the file format, without Spark."""

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graincart.errors import BadSignature, ClosedWriter, CorruptChunk, InvalidBlockHeader, InvalidOption, RecordError
from graincart.functions import encoding
from graincart.functions.encoding import check_block_size, chunk_end, decode_varint, decode_varints, encode_varint, encode_varints
from graincart.functions.hashing import highway64, highway64_many
from graincart.sources import layout

# The bytes of a file with no record, and of the chunk header and data of one record "test-record".
EMPTY = bytes.fromhex("83af70d10d884a3f 0000000000000000 4000000000000000 91bac23c9287e1a9 0000000000000000 e19f13c0e9b1c372 7300000000000000 0000000000000000")
ONE = bytes.fromhex("bdb91d4e15e0159b 0e00000000000000 7e26cb1da1b3e98a 7201000000000000 0b00000000000000 00010b") + b"test-record"


def written(records, **settings):
    file = io.BytesIO()
    writer = layout.FileWriter(file, **settings)
    for r in records:
        writer.write(r)
    writer.close()
    return file.getvalue()


def read(data, start=0, stop=None, block=1 << 16, recover=False):
    found = layout.read_records(layout.BytesSource(data), start, stop, block, recover)
    return [bytes(v[a:b]) for x in found if not isinstance(x, layout.Skip) for _, o, v in [x] for a, b in zip(o[:-1], o[1:], strict=True)]


def h(text):
    return bytes.fromhex(text)


def u64(*values):
    return b"".join(v.to_bytes(8, "little") for v in values)


def chunk(header_hash, data_hash, records, data, decoded):
    """A chunk by its fields, with the two hashes given."""
    return h(header_hash) + u64(len(data)) + h(data_hash) + bytes([0x72]) + records.to_bytes(7, "little") + u64(decoded) + data


def appended(data, *records, **settings):
    file = io.BytesIO(data)
    file.seek(0, 2)
    writer = layout.FileWriter(file, at=len(data), **settings)
    for r in records:
        writer.write(r)
    writer.close()
    return file.getvalue()


# The header and data hashes of the format's known files.
TWO = chunk("e5df3d1901025c97", "96c5cf8feede2567", 2, h("00020506") + b"firstsecond", 11)
MANY = chunk("cc4cec1bcf70230a", "b72af538cc7d4c60", 4, h("0004050d1f0d") + b"smallmedium recordlarger record with more contentanother small", 62) + chunk("ce036ada9b9ebae1", "3f14eafaeb0a9941", 1, h("000120") + b"final record to close things out", 32)
EMPTIES = chunk("f6b670db6fb45ac3", "b312e00006fb44df", 4, h("000405000004") + b"firstlast", 9)
PLACED = chunk("7d733ef349ffc94a", "564c5d3e3e105b40", 5, h("00050006000300") + b"middleend", 9)
NEAR = chunk("dcdade36eb09882e", "ba2f80f514b2005c", 1, h("000114") + b"x" * 20, 20)
FORCED = chunk("8f0b30b795ef6c8e", "5841a43fa357c15a", 4, h("000408080810") + b"record-1record-2record-3forces-new-chunk", 40) + chunk("8420ba4e2abc7c97", "d86afe50452c5dc3", 1, h("000110") + b"new-chunk-record", 16)
INITIAL = chunk("f540baf759ea2ab8", "9ac5650d514cff9e", 1, h("00010e") + b"initial-record", 14)
AFTER = chunk("f8fb9fe2caf7e1fd", "012c8f245e4f97a0", 1, h("00010f") + b"appended-record", 15)
EXACT = chunk("77b552ecfca33a67", "43dfb5aea94092e0", 1, h("000115") + b"y" * 21, 21)
AT_BORDER = h("62518210f907d83e") + u64(0, 77) + chunk("6c6f800c924676d1", "5a77144442571404", 1, h("00010a") + b"z" * 10, 10)
FIRST = chunk("332cb20cead5da0d", "f6deb03eb608bf13", 1, h("000115") + b"first-appended-record", 21)
LONG = chunk("d41e2f1931683b49", "b4430351de79c95d", 1, h("0002c801") + b"X" * 200, 200)
LONG_BORDERS = (h("6bb242ffcdfa5c32") + u64(36, 280), h("58cb173f0eefe91b") + u64(136, 180), h("53a7072261712e59") + u64(236, 80))


def test_golden_bytes():
    assert written([]) == EMPTY
    assert written([b"test-record"]) == EMPTY + ONE
    assert written([b"first", b"second"], chunk=1024) == EMPTY + TWO
    many = [b"small", b"medium record", b"larger record with more content", b"another small", b"final record to close things out"]
    assert written(many, chunk=50) == EMPTY + MANY
    assert written([b"first", b"", b"", b"last"]) == EMPTY + EMPTIES
    assert written([b"", b"middle", b"", b"end", b""]) == EMPTY + PLACED
    assert written([b"x" * 20], block=128) == EMPTY + NEAR
    assert written([b"record-1", b"record-2", b"record-3", b"forces-new-chunk", b"new-chunk-record"], chunk=30) == EMPTY + FORCED
    # 36 bytes in the first block of 100, then 76 behind each header
    parts = [LONG[:36], LONG[36:112], LONG[112:188], LONG[188:]]
    assert written([b"X" * 200], block=100) == EMPTY + b"".join(x for pair in zip(parts, (*LONG_BORDERS, b""), strict=True) for x in pair)


def test_golden_bytes_of_appended_files():
    assert appended(written([b"initial-record"]), b"appended-record") == EMPTY + INITIAL + AFTER
    exact = written([b"y" * 21], block=128)
    assert exact == EMPTY + EXACT and len(exact) == 128 and read(exact, block=128) == [b"y" * 21]
    both = appended(exact, b"z" * 10, block=128)
    assert both == EMPTY + EXACT + AT_BORDER and read(both, block=128) == [b"y" * 21, b"z" * 10]
    assert appended(EMPTY, b"first-appended-record") == EMPTY + FIRST


@pytest.mark.parametrize("records", [[f"small record {i}".encode() for i in range(1000)], [b""] * 5, [b"first", b"", b"middle", b"", b"", b"last"], [b"X" * 100_000, b"Y" * 200_000, b"Z" * 150_000]])
def test_known_round_trips(records):
    for options in ({"chunk": 5000}, {}, {"codec": "zstd"}):
        assert read(written(records, **options)) == records


def test_flush_makes_a_boundary():
    file = io.BytesIO()
    writer = layout.FileWriter(file)
    for record in (b"first_record", b"second_record", b"third_record"):
        writer.write(record)
        writer.flush_chunk()
        writer.flush_chunk()  # nothing is pending: no chunk
    writer.flush()
    assert read(file.getvalue()) == [b"first_record", b"second_record", b"third_record"]
    assert len(list(layout.read_chunks(layout.BytesSource(file.getvalue())))) == 3
    writer.close()
    writer.close()
    for late in (lambda: writer.write(b"x"), writer.flush, lambda: writer.write_values(np.array([0, 1]), memoryview(b"x"))):
        with pytest.raises(ClosedWriter):
            late()


def test_concatenated_files_padding_and_bad_signatures():
    first = written([b"one"], block=128)
    whole = first + b"\0" * (-len(first) % 128)
    aligned = written([b"y" * 21], block=128) + layout.framed(128, layout.signature(), 128)
    assert read(appended(aligned, b"two", block=128), block=128) == [b"y" * 21, b"two"]  # a signature in the middle
    assert len(whole) % 128 == 0
    with pytest.raises(RecordError):
        read(whole, block=128)  # zeros are no chunk
    padding = layout.chunk_header(layout.PADDING, 0, 0, 3, highway64(b"abc")) + b"abc"
    padded = appended(EMPTY + padding, b"after")
    with pytest.raises(CorruptChunk, match="type p"):
        read(padded)
    assert read(padded, recover=True) == [b"after"]
    full = layout.chunk_header(layout.SIGNATURE, 1, 0, 0, highway64(b""))
    with pytest.raises(CorruptChunk, match="not empty"):
        read(EMPTY + full)


def test_codecs_can_be_added():
    import bz2

    encoding.register_codec("bz2", ord("b"), lambda data, level: bz2.compress(data), lambda data, size: bz2.decompress(data))
    try:
        assert read(written([b"abc" * 100], codec="bz2")) == [b"abc" * 100]
        with pytest.raises(InvalidOption):
            encoding.register_codec("other", ord("z"), None, None)
    finally:
        del encoding.CODECS["bz2"]
    with pytest.raises(InvalidOption):
        written([b"x"], codec="bz2")


def test_hash_of_many_equals_hash_of_one():
    messages = [random.Random(n).randbytes(n) for n in [*range(70), 1000, 4097]]
    assert highway64_many(messages) == [highway64(m) for m in messages]


def test_varints():
    assert encode_varint(127) == b"\xff\x00" and encode_varint(126) == b"\x7e"
    assert decode_varint(b"\x7f") == (127, 1)
    values = np.array([0, 1, 126, 127, 128, 16255, 16256, 1 << 40])
    assert decode_varints(encode_varints(values), len(values)).tolist() == values.tolist()
    for bad in (b"\x80", b"\x80" * 10 + b"\x01"):
        with pytest.raises(CorruptChunk):
            decode_varint(bad)


def test_options_are_checked():
    with pytest.raises(InvalidOption):
        check_block_size(47)
    with pytest.raises(InvalidOption):
        written([b"x"], codec="zstd", level=23)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=25), st.sampled_from([64, 128, 4096]), st.sampled_from([1, 50, 600]), st.sampled_from(["none", "zstd"]), st.integers(1, 4))
def test_round_trip_and_splits(records, block, chunk, codec, blocks):
    data = written(records, block=block, chunk=chunk, codec=codec)
    assert read(data, block=block) == records
    assert [r for at in range(0, len(data), block * blocks) for r in read(data, at, at + block * blocks, block)] == records
    offsets = np.cumsum([0] + [len(r) for r in records])
    file = io.BytesIO()
    writer = layout.FileWriter(file, block, chunk, codec)
    writer.write_values(offsets, memoryview(b"".join(records)))
    writer.close()
    assert file.getvalue() == data


def test_chunk_end_matches_bytes_written():
    for block in (48, 64, 100):
        for begin in range(0, 3 * block):
            if 0 < begin % block <= 24:  # no chunk begins inside or right after a header
                continue
            for size in (1, 23, 24, 40, 75, 76, 77, 200):
                assert begin + len(layout.framed(begin, b"x" * size, block)) == chunk_end(begin, size, block)


def chunks_of(data, block):
    return [(c.begin, c.end, decoded_values(c)) for c in layout.read_chunks(layout.BytesSource(data), 0, None, block)]


def decoded_values(found):
    offsets, values = layout.decode(found)
    return [bytes(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def left_after(chunks, at, block):
    """The records that recovery must give if the byte at ``at``, not in the signature, is damaged."""
    k = next(i for i, (begin, end, _) in enumerate(chunks) if begin <= at < end)
    begin, end, _ = chunks[k]
    lost = {k}
    place = [x for x in range(begin, end) if x % block >= 24]
    if at in place[:40]:  # the chunk's end is unknown: what ends before the next block header is out of reach
        border = (begin // block + 1) * block
        lost |= {i for i, (b, e, _) in enumerate(chunks) if b > begin and e <= border}
    return [r for i, (_, _, rs) in enumerate(chunks) if i not in lost for r in rs]


@pytest.mark.parametrize(("block", "size", "limit", "count", "stride"), [(4096, 100, 256, 90, 61), (128, 10, 25, 60, 7), (64, 30, 60, 16, 5)])
def test_one_damaged_byte_loses_what_it_must_and_no_more(block, size, limit, count, stride):
    data = written([i.to_bytes(2, "big") * (size // 2) for i in range(count)], block=block, chunk=limit)
    chunks = chunks_of(data, block)
    for at in range(64, len(data), stride):
        bad = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
        want = left_after(chunks, at, block)
        assert read(bad, block=block, recover=True) == want, at
        for step in (block, 3 * block):  # the splits give the same
            assert [r for k in range(0, len(bad), step) for r in read(bad, k, k + step, block, True)] == want, (at, step)
        with pytest.raises(RecordError):
            read(bad, block=block)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=40), st.sampled_from([64, 128, 4096]), st.sampled_from([20, 200]), st.lists(st.integers(64, 1 << 20), max_size=6), st.integers(1, 5))
def test_recovery_does_not_hang_on_splits(records, block, chunk, places, blocks):
    data = bytearray(written(records, block=block, chunk=chunk))
    for at in places:
        data[64 + at % max(1, len(data) - 64) if len(data) > 64 else 0] ^= 85
    data = bytes(data)

    def tried(start, stop):
        try:
            return read(data, start, stop, block, True)
        except RecordError as bad:
            return [type(bad).__name__]

    whole, step = tried(0, None), block * blocks
    parts = [r for k in range(0, len(data), step) for r in tried(k, k + step)]
    if whole[-1:] not in (["UnexpectedEnd"], ["InvalidBlockHeader"], ["BadSignature"]):
        assert parts == whole
        assert all(r in records for r in whole)


def test_impossible_block_header():
    data = written([bytes([i]) * 100 for i in range(200)], block=4096, chunk=256)
    rest = u64(4090, 5)
    forged = u64(highway64(rest)) + rest
    bad = data[:4096] + forged + data[4120:]
    with pytest.raises(InvalidBlockHeader):
        read(bad, block=4096, recover=True)
    # met while looking for a place to go on, it is passed over
    both = bad[:2000] + bytes([bad[2000] ^ 1]) + bad[2001:]
    begin = next(c[0] for c in chunks_of(data, 4096) if c[0] < 4096 <= c[1])
    cut = both[:begin] + bytes([both[begin] ^ 1]) + both[begin + 1 :]
    kept = read(cut, block=4096, recover=True)
    assert kept and kept[-1] == bytes([199]) * 100


def test_header_scans_read_headers_only():
    class Counting(layout.FileSource):
        fetched = 0

        def read(self, at, n):
            before = (self._at, len(self._data))
            out = super().read(at, n)
            if (self._at, len(self._data)) != before:
                Counting.fetched += len(self._data)
            return out

    data = written([b"x" * (1 << 20)] * 8, data_hash=False)
    source = Counting(io.BytesIO(data), len(data), layout.HEADER_WINDOW)
    assert sum(c.records for c in layout.read_chunks(source, data=False)) == 8
    assert Counting.fetched <= 20 * layout.HEADER_WINDOW < len(data) // 500


def test_bad_signature_is_never_recovered():
    data = written([b"x"])
    with pytest.raises(BadSignature):
        read(data[:30] + b"?" + data[31:], recover=True)
    with pytest.raises(BadSignature):
        read(b"", recover=True)


def test_truncated_tail():
    data = written([b"a" * 50, b"b" * 50], chunk=10)
    assert read(data[:-5], recover=True) == [b"a" * 50]
    with pytest.raises(RecordError):
        read(data[:-5])


def test_zero_data_hash_is_not_checked():
    data = bytearray(written([b"hello"], data_hash=False))
    data[-1] ^= 1
    assert read(bytes(data)) == [b"helln"]


def test_chunk_cuts_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        sizes, limit = rng.integers(0, 9, rng.integers(0, 30)), int(rng.integers(0, 20))
        want, total = [], 0
        for i, n in enumerate(sizes, 1):
            total += n
            if total >= limit:
                want, total = [*want, i], 0
        assert layout.chunk_cuts(sizes, limit) == want
