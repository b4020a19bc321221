"""Spark data sources of the record format: ``records`` (batch and streaming, both ways), ``record_chunks``, ``record_blocks``.

Options of the scan: ``prefix`` (shard), ``shardPaths`` (a JSON list, in that order, instead of a folder),
``corruption`` (error or recover), ``blockSize``, ``splitBytes``, ``shardOrder`` (name or numeric),
``metadata`` (adds shard_id, shard_order, chunk_begin and chunk_record, the place in the chunk; the
place in the shard is added by ``operators.ordering.with_record_index``).
Options of the sink: ``prefix``, ``pathPattern`` (names with an ``{index}`` instead of the prefix),
``startIndex``, ``compression`` (a codec's name), ``zstdLevel``, ``chunkSize``, ``blockSize``,
``dataHash`` (on or none), ``maxBytesPerShard``, ``autoShard``. ``custom`` makes a format with a
sharder and a locator of the caller's.

A write task writes into a folder of its own attempt; the commit gives the files their names, so a
retried or speculative task leaves nothing behind.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from graincart.errors import InvalidOption, NoShards, PoolExhausted, RecordError
from graincart.functions.encoding import BLOCK, check_block_size, check_codec
from graincart.sources import layout

VALUE = "value binary"
PLACES = VALUE + ", shard_id string, shard_order int, chunk_begin long, chunk_record long"
_BATCH_BYTES = 16 << 20


def filesystem(path: str):
    """(file system, path inside it) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def shards(path: str, prefix: str = "shard", order: str = "name") -> list[tuple[str, int]]:
    """(path, bytes) of the files ``{prefix}_*`` of a folder, by name or by the number that ends the name."""
    from pyarrow import fs

    system, root = filesystem(path)
    found = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and (f.base_name.startswith(prefix + "_") if prefix else not f.base_name.startswith(("_", ".")))]
    number = lambda f: (int(m[0]) if (m := re.search(r"\d+$", f.base_name)) else -1, f.path)
    return [(f.path, f.size) for f in sorted(found, key=number if order == "numeric" else lambda f: f.path)]


#: Extension points: a sharder names the shard with an index; a locator lists (path or URI, bytes) in reading order.
Sharder = Callable[[int], str]
Locator = Callable[["Settings"], list[tuple[str, int]]]


class Settings:
    def __init__(self, options, sharder: Sharder | None = None, locator: Locator | None = None) -> None:
        self.sharder, self.locator = sharder, locator
        get = lambda name, default: options.get(name) or options.get(name.lower()) or default
        self.path, self.prefix = get("path", ""), get("prefix", "shard")
        self.paths = json.loads(get("shardPaths", "[]"))
        self.block = check_block_size(int(get("blockSize", BLOCK)))
        self.corruption, self.order = get("corruption", "error"), get("shardOrder", "name")
        self.split = int(get("splitBytes", 128 << 20)) // self.block * self.block or self.block
        self.metadata = str(get("metadata", "false")).lower() == "true"
        self.codec, self.level = get("compression", "none"), int(get("zstdLevel", 3))
        self.chunk, self.data_hash = int(get("chunkSize", layout.CHUNK_BYTES)), get("dataHash", "on") != "none"
        self.start, self.limit = int(get("startIndex", 0)), int(get("maxBytesPerShard", 0))
        self.auto = str(get("autoShard", "true")).lower() == "true"
        if self.corruption not in ("error", "recover"):
            raise InvalidOption(f"corruption must be error or recover, not {self.corruption}")
        if self.order not in ("name", "numeric"):
            raise InvalidOption(f"shardOrder must be name or numeric, not {self.order}")
        check_codec(self.codec, self.level)
        if self.chunk < 1 or self.limit < 0 or self.start < 0:
            raise InvalidOption("chunkSize must be at least 1, maxBytesPerShard and startIndex at least 0")
        self.pattern = get("pathPattern", "")
        if self.pattern and (self.pattern.format(index=1) == self.pattern.format(index=2) or "/" in self.pattern):
            raise InvalidOption("pathPattern must hold {index} and no folder")
        if not self.path and not self.paths:
            raise InvalidOption("a path is needed")

    def name(self, index: int) -> str:
        """The file name of a shard."""
        if self.sharder:
            return self.sharder(index)
        return self.pattern.format(index=index) if self.pattern else f"{self.prefix}_{index}"

    def found(self) -> list[tuple[str, int]]:
        if self.locator:
            found = self.locator(self)
        elif self.paths:
            found = located(self.paths)
        elif self.pattern:
            before, after = self.pattern.split("{", 1)[0], self.pattern.rsplit("}", 1)[1]
            found = [f for f in shards(self.path, "", self.order) if (n := posixpath.basename(f[0])).startswith(before) and n.endswith(after)]
        else:
            found = shards(self.path, self.prefix, self.order)
        if not found:
            raise NoShards(f"no shards {self.pattern or self.prefix + '_*'} in {self.path}")
        return found

    def system(self, shard: str):
        """(file system, path in it) of a shard: of its own URI where it has one, else of the folder."""
        if "://" in shard or shard.startswith("file:"):
            return filesystem(shard)
        return filesystem(self.path or self.paths[0])[0] if not self.paths else filesystem(shard)[0], shard


def located(paths: list[str]) -> list[tuple[str, int]]:
    """An explicit list of shards, each on a file system of its own, all of which must exist."""
    from pyarrow import fs

    out = []
    for path in paths:
        system, inner = filesystem(path)
        info = system.get_file_info(inner)
        if info.type != fs.FileType.File:
            raise NoShards(f"no such shard: {path}")
        out.append((path, info.size))
    return out


#: Bytes that a task reads: a share of all, so that tasks are about so many, but no more than are hashed together.
TASKS, TASK_BYTES = 32, layout.HASH_BYTES


@dataclass
class Split:
    """A run of whole splits of a shard; each is read by itself."""

    shard: str
    order: int
    start: int
    stop: int
    size: int


@dataclass
class Task(InputPartition):
    splits: list[Split]


def tasks(found: list[tuple[str, int]], split: int) -> list[Task]:
    """The splits of shards, in order, dealt to tasks: one that is large is a task, small ones go together.

    A task costs more than a small split does, and the chunks that one task hashes together keep the lanes wide.
    """
    share = min(TASK_BYTES, sum(size for _, size in found) // TASKS)
    out: list[Task] = []
    room = 0
    for k, (path, size) in enumerate(found):
        at = 0
        while at == 0 or at < size:
            if not out or room < min(split, size - at):
                out.append(Task([]))
                room = share
            stop = min(size, at + max(room // split, 1) * split)
            out[-1].splits.append(Split(path, k, at, stop, size))
            room -= stop - at
            at = max(stop, 1)
    return out


class _Reader(DataSourceReader):
    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def partitions(self) -> list[Task]:
        return tasks(self.s.found(), self.s.split)

    #: Read-ahead, in bytes.
    window = 8 << 20

    def open(self, split: Split):
        system, inner = self.s.system(split.shard)
        return layout.FileSource(system.open_input_file(inner), split.size, self.window)

    def ranges(self, task: Task) -> Iterator[tuple[Split, layout.FileSource, int, int]]:
        for run in task.splits:
            source = self.open(run)
            with source.file:
                for at in range(run.start, max(run.stop, run.start + 1), self.s.split):
                    yield run, source, at, min(run.stop, at + self.s.split)

    def read(self, task: Task) -> Iterator:
        try:
            yield from self.rows(task)
        except RecordError as bad:
            raise type(bad)(f"shard {bad.range.shard}: {bad}") from bad

    def rows(self, task: Task) -> Iterator:
        raise NotImplementedError


class RecordsReader(_Reader):
    def rows(self, task: Task) -> Iterator:
        import pyarrow as pa

        for split, found in layout.read_ranges(self.ranges(task), self.s.block, self.s.corruption == "recover"):
            if isinstance(found, layout.Skip):
                continue
            chunk, offsets, values = found
            at = 0
            while at < len(offsets) - 1:
                to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + _BATCH_BYTES, "right")) - 1, at + 10_000))
                n = to - at
                part = offsets[at : to + 1] - offsets[at]
                arrays = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(part.astype(np.int32)), pa.py_buffer(values[offsets[at] : offsets[to]])])]
                names = ["value"]
                if self.s.metadata:
                    arrays += [pa.array([split.shard] * n), pa.array([split.order] * n, pa.int32()), pa.array([chunk.begin] * n, pa.int64()), pa.array(np.arange(at, to))]
                    names += ["shard_id", "shard_order", "chunk_begin", "chunk_record"]
                yield pa.RecordBatch.from_arrays(arrays, names)
                at = to


class ChunksReader(_Reader):
    """One row per chunk, from the headers alone."""

    window = layout.HEADER_WINDOW

    def rows(self, task: Task) -> Iterator:
        for split, source, start, stop in self.ranges(task):
            try:
                for c in layout.read_chunks(source, start, stop, self.s.block, self.s.corruption == "recover", data=False):
                    if isinstance(c, layout.Chunk):
                        yield split.shard, split.order, c.begin, c.end, chr(c.kind), c.records, c.data_size, c.decoded
            except RecordError as bad:
                bad.range = split
                raise


class SkipsReader(_Reader):
    """One row per place that a recovering scan skips."""

    def rows(self, task: Task) -> Iterator:
        for split, c in layout.read_ranges(self.ranges(task), self.s.block, True):
            if isinstance(c, layout.Skip):
                yield split.shard, split.order, c.at, c.reason


class BlocksReader(_Reader):
    """One row per block header, valid or not, from the headers alone."""

    window = layout.HEADER_WINDOW

    def rows(self, task: Task) -> Iterator:
        for split, source, start, stop in self.ranges(task):
            for at in range(start, stop, self.s.block):
                try:
                    prev, after, fault = *layout.block_header(source, at, self.s.block), None
                except RecordError as bad:
                    prev, after, fault = None, None, str(bad)
                yield split.shard, split.order, at, prev, after, fault


class RecordsStream(DataSourceStreamReader):
    """New shards of a folder; an offset is the set of shards read, as ranges of their numbers and a list of other names."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def _found(self) -> dict[str, tuple[str, int]]:
        try:
            return {posixpath.basename(p): (p, size) for p, size in self.s.found()}
        except NoShards:
            return {}

    def _number(self, name: str) -> int:
        """The index that gives a shard this name, or -1."""
        m = re.search(r"\d+$", name)
        return int(m[0]) if m and self.s.name(int(m[0])) == name else -1

    def initialOffset(self) -> dict:
        return {"ranges": [], "names": []}

    def latestOffset(self) -> dict:
        numbers = {name: self._number(name) for name in self._found()}
        ranges: list[list[int]] = []
        for n in sorted(n for n in numbers.values() if n >= 0):
            if ranges and ranges[-1][1] == n - 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
        return {"ranges": ranges, "names": sorted(name for name, n in numbers.items() if n < 0)}

    def _within(self, name: str, offset: dict) -> bool:
        n = self._number(name)
        return name in offset["names"] if n < 0 else any(a <= n <= b for a, b in offset["ranges"])

    def partitions(self, start: dict, end: dict) -> list[Task]:
        new = [f for name, f in self._found().items() if self._within(name, end) and not self._within(name, start)]
        return tasks(new, self.s.split)

    def read(self, task: Task) -> Iterator:
        yield from RecordsReader(self.s).read(task)


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list[tuple[str, int]]


class _Sink:
    def prepare(self, settings: Settings, overwrite: bool = False) -> None:
        self.s, self.overwrite = settings, overwrite
        self.temporary = posixpath.join(settings.path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, batches: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        system, root = filesystem(self.temporary)
        context = TaskContext.get()
        task, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        waiting: list[layout.FileWriter] = []  # ended, but for what is left to be hashed
        writer = None

        def begin():
            path = posixpath.join(root, f"{task}-{attempt}-{len(files)}")
            files.append((path, 0))
            return layout.FileWriter(system.open_output_stream(path), self.s.block, self.s.chunk, self.s.codec, self.s.level, self.s.data_hash)

        def settle():
            layout.drain(waiting)
            for w in waiting:
                w.file.close()
            waiting.clear()

        def end():
            writer.end()
            files[-1] = (files[-1][0], writer.records)
            waiting.append(writer)
            if sum(w.ready_bytes for w in waiting) >= layout.HASH_BYTES or len(waiting) >= 256:
                settle()

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("value"))
            if column.null_count:
                raise RecordError("a record is null")
            column = pc.cast(column, pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = memoryview(column.buffers()[2] or b"")
            cuts: list[int] = []
            if self.s.limit:  # the file that is open takes what it has room for, the next ones their limit each
                sizes = np.diff(offsets)
                cuts = layout.chunk_cuts(sizes, self.s.limit - (writer.bytes if writer is not None else 0))[:1]
                if cuts:
                    cuts += [cuts[0] + c for c in layout.chunk_cuts(sizes[cuts[0] :], self.s.limit)]
            at, closing = 0, set(cuts)
            for to in sorted({*cuts, len(column)}):
                if to == at:
                    continue
                if writer is None:
                    if files and not self.s.auto:
                        raise PoolExhausted(f"the shard of task {task} is full and autoShard is off")
                    writer = begin()
                writer.write_values(offsets[at : to + 1], data)
                if to in closing:
                    end()
                    writer = None
                at = to
        if writer is not None:
            end()
        elif not files and task == 0:
            writer = begin()
            end()
        settle()
        return Written(task, files)

    def publish(self, messages: list, name) -> set[str]:
        system, root = filesystem(self.s.path)
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for f in m.files]
        wanted = [f for f in files if f[1]] or files[:1]
        names = [name(k) for k in range(len(wanted))]
        for (path, _), new in zip(wanted, names, strict=True):
            target = posixpath.join(root, new)
            try:
                system.move(path, target)  # over an old file of this name, where there is one
            except OSError:
                system.delete_file(target)
                system.move(path, target)
        self.clean()
        return set(names)

    def clean(self) -> None:
        from pyarrow import fs

        system, root = filesystem(self.temporary)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class RecordsWriter(_Sink, DataSourceArrowWriter):
    def __init__(self, settings: Settings, overwrite: bool) -> None:
        self.prepare(settings, overwrite)

    def commit(self, messages: list) -> None:
        system, _ = filesystem(self.s.path)
        try:
            old = {posixpath.basename(p): p for p, _ in self.s.found()}
        except NoShards:
            old = {}
        used = set() if self.overwrite else set(old)
        at = iter(n for n in range(self.s.start, 1 << 62) if self.s.name(n) not in used)
        new = self.publish(messages, lambda _: self.s.name(next(at)))
        if self.overwrite:  # only now that the new shards are in place
            for name in old.keys() - new:
                system.delete_file(old[name])

    def abort(self, messages: list) -> None:
        self.clean()


class RecordsStreamWriter(_Sink, DataSourceStreamArrowWriter):
    """Files of a micro-batch are named by its number, so a repeated commit replaces them."""

    def __init__(self, settings: Settings) -> None:
        self.prepare(settings)

    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, lambda k: f"{self.s.prefix}_{batchId:06d}{k:06d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.clean()


def custom(name_: str, sharder: Sharder | None = None, locator: Locator | None = None) -> type[DataSource]:
    """A format like ``records`` whose shards a caller's sharder names and a caller's locator finds, for ``spark.dataSource.register``."""

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def settings(self) -> Settings:
            return Settings(self.options, sharder, locator)

        def schema(self) -> str:
            return PLACES if self.settings().metadata else VALUE

        def reader(self, schema):
            return RecordsReader(self.settings())

        def streamReader(self, schema):
            return RecordsStream(self.settings())

        def writer(self, schema, overwrite: bool):
            return RecordsWriter(self.settings(), overwrite)

        def streamWriter(self, schema, overwrite: bool):
            return RecordsStreamWriter(self.settings())

    return Format


Records = custom("records")


def _scan(label: str, columns: str, made) -> type[DataSource]:
    class Scan(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema):
            return made(Settings(self.options))

    return Scan


_SHARD = "shard_id string, shard_order int, "
Chunks = _scan("record_chunks", _SHARD + "chunk_begin long, chunk_end long, kind string, num_records long, data_size long, decoded_size long", ChunksReader)
Blocks = _scan("record_blocks", _SHARD + "block_begin long, previous_chunk long, next_chunk long, fault string", BlocksReader)
Skips = _scan("record_skips", _SHARD + "skipped_at long, reason string", SkipsReader)


def register(spark) -> None:
    """Make the formats known to a session."""
    for source in (Records, Chunks, Blocks, Skips):
        spark.dataSource.register(source)
