"""Tar archives as tables: a data source whose partitions are runs of members, and a sink with one archive a task."""

from __future__ import annotations

import io
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, member string, size long, offset long, modified timestamp, content binary, problem string"
ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("problem", pa.string())])
#: Archives above so many bytes are cut into runs of members of about that size.
SPLIT_BYTES = 128 << 20
#: Contents of members that are given to Spark in one batch, and the longest member that a row can hold.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000
MOST_BYTES = (1 << 31) - (1 << 16)
ENDINGS = (".tar", ".tar.gz", ".tgz")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[tuple[str, int]]:
    """Name and bytes of the archive at a path, or of all archives in a folder, by name. Hidden and passing files don't count."""
    where, inner = store(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [i for i in where.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.endswith(ENDINGS) and i.base_name[0] not in "._"]
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in found)


def members(file: io.IOBase, start: int = 0, stop: int | None = None) -> Iterator[tarfile.TarInfo | str]:
    """The members of an archive whose headers begin from `start` up to before `stop`; where it isn't whole, at its end, what is wrong."""
    file.seek(start)
    try:
        with tarfile.open(fileobj=file, mode="r:") as tar:
            while (member := tar.next()) is not None:
                if stop is not None and member.offset >= stop:
                    return
                tar.members = []  # not all members of a long archive at once
                yield member
            at = tar.offset
    except tarfile.TarError as e:
        yield f"damaged: {e}"
        return
    file.seek(at)
    block = file.read(tarfile.BLOCKSIZE)
    if len(block) < tarfile.BLOCKSIZE:
        yield f"cut off at byte {at + len(block)}"
    elif any(block):
        yield f"damaged: no member at byte {at}"


@dataclass
class Run(InputPartition):
    """Members of one archive, by the places of their headers; all that follow without a stop."""

    path: str
    start: int = 0
    stop: int | None = None

    def __post_init__(self) -> None:
        super().__init__(self.path)


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.strict, self.contents = options.get("mode", "PERMISSIVE").upper() == "FAILFAST", options.get("contents", "true").lower() == "true"
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of members: others are passed over without reading what they hold."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("member",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield f

    def partitions(self) -> list[Run]:
        """One for an archive, unless it is long: then its headers, not its contents, are read for the runs. Compressed archives can't be cut."""
        runs = []
        for path, size in archives(self.path):
            if size <= self.split or not path.endswith(".tar"):
                runs.append(Run(path))
                continue
            begins = [0]
            where, inner = store(path)
            with where.open_input_file(inner) as file:
                for m in members(file):
                    if not isinstance(m, str) and m.offset - begins[-1] >= self.split:
                        begins.append(m.offset)
            runs += [Run(path, a, b) for a, b in zip(begins, [*begins[1:], None], strict=True)]
        return runs

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(run):
            if row[-1] and self.strict:
                raise ValueError(f"{row[0]}: {row[-1]}")
            if row[-1] and row[1] is None and self.names is not None:
                continue  # no named member
            rows.append(row)
            held += len(row[5] or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    def _rows(self, run: Run) -> Iterator[tuple]:
        where, inner = store(run.path)
        with where.open_input_file(inner) as file:
            if not run.path.endswith(".tar"):
                yield from self._compressed(run.path, file)
                return
            total = file.size()
            for m in members(file, run.start, run.stop):
                if isinstance(m, str):
                    yield run.path, None, None, None, None, None, m
                elif m.isreg() and (self.names is None or m.name in self.names):
                    content, problem = None, None
                    if m.size > MOST_BYTES:
                        problem = f"longer than {MOST_BYTES} bytes"
                    elif m.offset_data + (m.size if m.sparse is None else 0) > total:
                        problem = f"cut off at byte {total}"
                    elif self.contents:
                        content = _content(file, m)
                    yield run.path, m.name, m.size, m.offset_data, int(m.mtime * 1_000_000), content, problem

    def _compressed(self, path: str, file) -> Iterator[tuple]:
        """From begin to end, without seeking; places are those in the archive without compression."""
        m = None
        try:
            with tarfile.open(fileobj=file, mode="r|gz") as tar:
                while (m := tar.next()) is not None:
                    tar.members = []
                    if m.isreg() and (self.names is None or m.name in self.names):
                        fits = m.size <= MOST_BYTES
                        content = tar.extractfile(m).read() if fits and self.contents else None
                        yield path, m.name, m.size, m.offset_data, int(m.mtime * 1_000_000), content, None if fits else f"longer than {MOST_BYTES} bytes"
                    m = None
        except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
            about = (m.name, m.size, m.offset_data, int(m.mtime * 1_000_000)) if m is not None else (None,) * 4
            yield path, *about, None, f"damaged: {e}"


def _content(file, member: tarfile.TarInfo) -> bytes:
    if member.sparse is not None:
        with tarfile.open(fileobj=file, mode="r:") as tar:
            return tar.extractfile(member).read()
    at = file.tell()
    file.seek(member.offset_data)
    out = file.read(member.size)
    file.seek(at)
    return out


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class TarWriter(DataSourceWriter):
    """Each task writes an archive under a passing name; those of the tasks that count get their names when all have ended."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if lost := {"member", "content"} - set(schema.names):
            raise ValueError(f"missing columns: {', '.join(sorted(lost))}")
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        where, folder = store(self.path)
        first = next(rows, None)
        if first is None:
            return Written(None)
        where.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05}-{self.run}"
        passing = f"{folder}/.{name}-{context.taskAttemptId()}"
        with where.open_output_stream(passing) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for row in _chain(first, rows):
                if row["member"] is None:
                    raise ValueError("a member without a name")
                content = row["content"] if row["content"] is not None else b""
                content = content.encode() if isinstance(content, str) else bytes(content)
                info = tarfile.TarInfo(row["member"])
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return Written(passing)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        if self.overwrite:
            for path, _ in archives(self.path):
                where.delete_file(store(path)[1])
        for m in messages:
            if m is not None and m.path:
                name = m.path.rsplit("/", 1)[1][1:].rsplit("-", 1)[0]
                where.move(m.path, f"{folder}/{name}.tar")

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = store(self.path)
        for m in messages:
            if m is not None and m.path:
                where.delete_file(m.path)


def _chain(first: Row, rest: Iterator[Row]) -> Iterator[Row]:
    yield first
    yield from rest


class TarSource(DataSource):
    """format("tar"): a row for each regular member; members of one name each give a row.

    Options of reading: splitBytes; contents (false: names and sizes only); mode (FAILFAST: an archive or member that isn't whole ends
    the job; else a row says so in `problem`, with null for what is missing). Folders, links and devices aren't rows.
    Writing takes columns member and content (text or bytes, null for empty)."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarReader:
        return TarReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(dict(self.options), schema, overwrite)


def read_tar(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members of an archive, or of a folder of archives; filters by member (=, in) reach the reader, for which the session allows
    filters to reach Python sources from then on."""
    spark.dataSource.register(TarSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("tar").options(**options).load(path)


def write_tar(df: DataFrame, path: str, mode: str = "append") -> None:
    """Archives in a folder, one a task that has rows, of the columns member and content."""
    df.sparkSession.dataSource.register(TarSource)
    df.select("member", "content").write.format("tar").mode(mode).save(path)
