"""Files of any size as rows of bytes, and rows of bytes as files: Spark data sources.

Reading (`ranges`): a partition is a stretch of one file, or many small files, read in chunks, so that a file over 2 GiB
comes as rows (file_id, off, bytes, last) from many tasks. As a stream, each batch has the files that are new; what has been read is a
time and the files changed since, so that state doesn't grow with the number of files. Files that appear with a
change time more than `settle` seconds behind the newest one are taken for read.

Writing (`parts`): rows (file_id, off, bytes) of one file, which must come to one task in order, are appended to a file
in a folder of the task's attempt below a folder of the job; the job's end moves whole files to their place. A
task that fails leaves nothing behind it, and two jobs in one folder know nothing of each other."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

ROWS = "file_id string, off long, bytes binary, last boolean"
CHUNK, STRETCH, OPENING = 1 << 20, 64 << 20, 64 << 10


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path within it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class Stretch:
    """Bytes begin to end of a file of `size` bytes."""

    path: str
    begin: int
    end: int
    size: int


@dataclass
class Share(InputPartition):
    """What one task reads."""

    stretches: list[Stretch]


def found(path: str, glob: str) -> list[fs.FileInfo]:
    """The files of a folder, those of hidden folders left out."""
    store, base = filesystem(path)
    info = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in p.removeprefix(base).split("/"))
    return [f for f in info if f.type == fs.FileType.File and fnmatch(f.base_name, glob) and not hidden(f.path)]


class Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.chunk, self.stretch, self.opening = int(options.get("chunksize", CHUNK)), int(options.get("stretch", STRETCH)), int(options.get("opening", OPENING))
        if self.chunk <= 0 or self.stretch <= 0:
            raise ValueError("chunkSize and stretch must be positive")
        self.stretch = max(self.chunk, self.stretch // self.chunk * self.chunk)  # chunks don't cross stretches

    def shares(self, files: list[fs.FileInfo]) -> list[Share]:
        """Shares of about `stretch` bytes, where opening a file counts as reading so many bytes more."""
        out, room = [], 0
        for f in files:
            for a in range(0, max(f.size, 1), self.stretch):
                one = Stretch(f.path, a, min(f.size, a + self.stretch), f.size)
                cost = one.end - one.begin + self.opening
                if cost > room:
                    out.append(Share([]))
                    room = max(self.stretch, cost)
                out[-1].stretches.append(one)
                room -= cost
        return out

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        for part in share.stretches if share is not None else ():  # None is Spark's way to read nothing
            yield from self._read(part)

    def _read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(self.path)
        name = part.path.removeprefix(base).lstrip("/")
        with store.open_input_file(part.path) as f:
            f.seek(part.begin)
            at = part.begin
            while True:
                data = f.read(min(self.chunk, part.end - at))
                last = at + len(data) >= part.size
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), pa.array([data], pa.binary()), pa.array([last])], ["file_id", "off", "bytes", "last"])
                at += len(data)
                if at >= part.end:
                    break
                if not data:
                    raise OSError(f"{part.path} has become shorter")


class RangeReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Share]:
        return self.options.shares(found(self.options.path, self.options.glob))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)


class RangeStream(DataSourceStreamReader):
    """Offsets: files changed before `time` (nanoseconds) are read, and those of `since`, which have changed later."""

    def __init__(self, options: Options, settle: float):
        self.options, self.settle = options, int(settle * 1e9)

    def initialOffset(self) -> dict:
        return {"time": 0, "since": []}

    def latestOffset(self) -> dict:
        files = found(self.options.path, self.options.glob)
        time = max(max((f.mtime_ns for f in files), default=0) - self.settle, 0)
        return {"time": time, "since": sorted(f.path for f in files if f.mtime_ns >= time)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        old, new = set(start["since"]), set(end["since"])
        files = [f for f in found(self.options.path, self.options.glob) if f.mtime_ns >= start["time"] and f.path not in old]
        return self.options.shares([f for f in files if f.path in new or f.mtime_ns < end["time"]])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)

    def commit(self, end: dict) -> None:
        pass


class RangeSource(DataSource):
    """Options: path, glob, chunkSize, stretch (bytes of a task), opening (what a file costs
    besides, in bytes), settle (seconds; streams)."""

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: object) -> DataSourceReader:
        return RangeReader(Options(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return RangeStream(Options(self.options), float(self.options.get("settle", 3600)))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class PartWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.job = path, suffix, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = filesystem(self.path)
        context = TaskContext.get()
        folder = f"{self._staging(base)}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        known: set[str] = set()
        out, at = None, 0
        try:
            for batch in iterator:
                for name, off, data in zip(batch.column("file_id").to_pylist(), batch.column("off").to_pylist(), batch.column("bytes"), strict=True):
                    name = f"{name}{self.suffix}"
                    new = not names or names[-1] != name
                    if off != (0 if new else at) or new and name in known:
                        raise ValueError("rows of a file must follow each other without gaps")
                    if new:
                        known.add(name)
                        at = 0
                        if out is not None:
                            out.close()
                        names.append(name)
                        if "/" in name:
                            store.create_dir(f"{folder}/{name.rpartition('/')[0]}", recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}")
                    if data.is_valid:
                        out.write(data.as_buffer())
                        at += data.as_buffer().size
        except BaseException:
            store.delete_dir(folder)
            raise
        finally:
            if out is not None and not out.closed:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = filesystem(self.path)
        for m in messages:
            for name in m.names if m else []:
                if "/" in name:
                    store.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
                store.move(f"{m.folder}/{name}", f"{base}/{name}")
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(self._staging(base)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(base))


class PartSink(DataSource):
    """Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        return "file_id string, off long, bytes binary"

    def writer(self, schema: object, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], self.options.get("suffix", ""))


def register(spark: SparkSession) -> SparkSession:
    for source in (RangeSource, PartSink):
        spark.dataSource.register(source)
    return spark


def read_ranges(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return register(spark).read.format("ranges").options(**{k: str(v) for k, v in options.items()}).load(path)


def stream_ranges(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return register(spark).readStream.format("ranges").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_parts(rows: DataFrame, path: str, suffix: str = "") -> None:
    """rows: (file_id, off, bytes). A file of each file_id, its bytes in order of off. A file of that name is replaced."""
    register(rows.sparkSession)
    ordered = rows.select(F.col("file_id").cast("string").alias("file_id"), F.col("off").cast("long").alias("off"), "bytes").repartition("file_id").sortWithinPartitions("file_id", "off")
    ordered.write.format("parts").mode("append").option("path", path).option("suffix", suffix).save()
