"""The files of a case, read by byte ranges.

Spark's own file readers skip names that begin with a dot or an underscore and need a whole
file for one row of bytes. Here every name is listed, and tasks read ranges of files: lines,
chunks that overlap, or a digest that is taken while the bytes pass by. No row holds more
than one range. What cannot be read becomes a row with `error`, never a lost file.

Paths are local ones (or mounted the same everywhere), or URIs that pyarrow opens.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import os
import re
import stat
import sys
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spoorline.operators.running import RunningSum, running
from spoorline.session import written

# Executors get this module with the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = "path string, size long, mtime timestamp, error string"
#: Bytes of a range of lines or of a chunk, and of one read while a digest is taken.
RANGE_BYTES, READ_BYTES, HEADER_BYTES = 32 << 20, 1 << 20, 512
#: Lines handed on at a time.
BATCH_LINES = 10_000
#: Tasks that share the names of a folder of more than so many entries; rows listed at a time.
SLICES, FEW, BATCH_FILES = 32, 1000, 5000
PACKED = (".gz", ".bz2")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+://", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/+", "/", path))


def entries(path: str, piece: int | None = None) -> list[tuple[str, bool, int, datetime, str | None]]:
    """(path, is a folder, size, change time, error) of what lies in a folder, or of one file.

    On a local system links to folders are named, but not followed. `piece`: only the local
    names whose hash falls to that one of `SLICES` pieces.
    """
    system, inner = opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if not isinstance(system, pafs.LocalFileSystem):
        own = system.get_file_info(inner)
        found = system.get_file_info(pafs.FileSelector(inner)) if own.type == pafs.FileType.Directory else [own]
        return [
            (
                prefix + f.path, f.type == pafs.FileType.Directory, f.size or 0,
                f.mtime or datetime.fromtimestamp(0, timezone.utc),
                None if f.type in (pafs.FileType.File, pafs.FileType.Directory) else "not a readable file",
            )
            for f in found
        ]
    out = []
    if os.path.isdir(inner):
        names = sorted(os.path.join(inner, n) for n in os.listdir(inner) if piece is None or _piece(n) == piece)
    else:
        names = [inner]
    for name in names:
        facts = os.lstat(name)
        error = None
        if stat.S_ISLNK(facts.st_mode):
            error = "a link to a folder" if os.path.isdir(name) else None if os.path.isfile(name) else "not a readable file"
            facts = os.stat(name) if os.path.exists(name) else facts
        elif not stat.S_ISREG(facts.st_mode) and not stat.S_ISDIR(facts.st_mode):
            error = "not a readable file"
        folder = stat.S_ISDIR(facts.st_mode) and error is None
        moment = datetime.fromtimestamp(facts.st_mtime, timezone.utc)
        out.append((prefix + name, folder, 0 if folder or error else facts.st_size, moment, error))
    return out


def _piece(name: str) -> int:
    return zlib.crc32(os.fsencode(name)) % SLICES


def _many(path: str) -> bool:
    """Whether a local folder has more than `FEW` entries; no more of them are read."""
    system, inner = opened(path)
    if not isinstance(system, pafs.LocalFileSystem) or not os.path.isdir(inner):
        return False
    with os.scandir(inner) as found:
        return next(islice(found, FEW, None), None) is not None


class FileList(DataSource):
    """Every file below some folders: tasks share the folders, and the names of large ones."""

    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return FileListReader(json.loads(self.options["paths"]))


class FileListReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]) -> None:
        self.paths = list(paths)

    def partitions(self) -> list[InputPartition]:
        """Places to walk: folders and files from the first level that has enough, or pieces of large folders."""
        places, level = [], [(path, True, 0, None, None) for path in self.paths]
        top = True
        while level and (top or len(places) + len(level) < SLICES):
            below = []
            for entry in level:
                path, folder = entry[:2]
                try:
                    if not folder:
                        places.append((entry, None))
                    elif _many(path):
                        places += [(entry, piece) for piece in range(SLICES)]
                    else:
                        below += entries(path)
                except OSError:
                    if top:
                        raise
                    places.append((entry, None))
            level, top = below, False
        places += [(entry, None) for entry in level]
        shares = min(len(places), 4 * SLICES)
        return [InputPartition(places[i::shares]) for i in range(shares)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fields = [("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("error", pa.string())]
        rows = self.walk(partition.value)
        while some := list(islice(rows, BATCH_FILES)):
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, (_, kind) in zip(columns, fields, strict=True)], schema=pa.schema(fields)
            )

    @staticmethod
    def walk(places: Sequence[tuple]) -> Iterator[tuple]:
        waiting = list(places)
        while waiting:
            (path, folder, size, moment, error), piece = waiting.pop()
            if not folder:
                yield path, size, moment, error
                continue
            try:
                waiting += [(entry, None) for entry in entries(path, piece)]
            except OSError as caught:
                if not piece:  # one of the pieces tells
                    yield path, 0, moment, f"folder not listed: {_said(caught)}"


def _said(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}".split("\n")[0]


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, size, mtime, error) of every file below the paths, hidden names included."""
    spark.dataSource.register(FileList)
    given = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("case_files").option("paths", json.dumps(given)).load()


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Each file's rows with `start` of every range of `size` bytes; a packed file is one range."""
    ends = F.lower(F.col("path"))
    packed = ends.endswith(PACKED[0]) | ends.endswith(PACKED[1])
    last = F.when(packed, 0).otherwise(F.greatest(F.col("size") - 1, F.lit(0)))
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(size).cast("long"))
    return files.select("*", F.explode(starts).alias("start")).repartition(_tasks(files.sparkSession), "path", "start")


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small but stand for much: by size Spark would put them into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _unpacked(path: str) -> Iterator[bytes]:
    system, inner = opened(path)
    with system.open_input_file(inner) as raw:
        kind = gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else bz2.BZ2File(raw)
        while block := kind.read(READ_BYTES):
            yield block


def _blocks(path: str, start: int, size: int) -> Iterator[bytes]:
    """The bytes of the lines that begin in [start, start + size): whole lines, block by block."""
    if path.lower().endswith(PACKED):
        yield from _unpacked(path)
        return
    system, inner = opened(path)
    with system.open_input_file(inner) as raw:
        at = max(0, start - 1)
        raw.seek(at)
        skip = start > 0  # up to the end of the line that began before
        while block := raw.read(READ_BYTES):
            if skip:
                cut = block.find(b"\n")
                if cut < 0:
                    at += len(block)
                    if at >= start + size:
                        return
                    continue
                block, at, skip = block[cut + 1 :], at + cut + 1, False
            if at >= start + size:
                return
            if at + len(block) >= start + size:
                # The line that holds the last byte of the range ends this range.
                end = block.find(b"\n", start + size - 1 - at)
                if end >= 0:
                    yield block[: end + 1]
                    return
                yield block
                at += len(block)
                while block := raw.read(READ_BYTES):
                    end = block.find(b"\n")
                    if end >= 0:
                        yield block[: end + 1]
                        return
                    yield block
                return
            yield block
            at += len(block)


def _lines(blocks: Iterator[bytes]) -> Iterator[list[str]]:
    """Lines without their ends (\\n, \\r\\n or \\r), some at a time; bad bytes become replacement characters."""
    kept: list[bytes] = []
    for block in blocks:
        end = block.rfind(b"\n") + 1
        if not end:
            kept.append(block)
            continue
        yield _split(b"".join(kept) + block[:end])
        kept = [block[end:]]
    if rest := b"".join(kept):
        yield _split(rest)


def _split(data: bytes) -> list[str]:
    text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    return (text[:-1] if text.endswith("\n") else text).split("\n")


def lines_in(spots: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """The rows of `ranges` with (place, value, error): the lines that begin in each range.

    `place` counts from 0 in the range. A file that fails part way keeps the lines before, and
    one row tells the error.
    """
    names = spots.columns
    out = f"{_ddl(spots, names)}, place long, value string, error string"
    schema = pa.schema([("value", pa.string()), ("place", pa.int64()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        octets = 0
        for batch in batches:
            for at, row in enumerate(batch.select(["path", "start"]).to_pylist()):
                for found in _batched(row["path"], row["start"], size, schema):
                    kept = batch.slice(at, 1).take(pa.array([0] * len(found), pa.int32()))
                    one = pa.RecordBatch.from_arrays(
                        [*kept.columns, found["place"], found["value"], found["error"]],
                        names=[*names, "place", "value", "error"],
                    )
                    held.append(one)
                    octets += one.nbytes
                    # Lines of small files go together.
                    if octets >= READ_BYTES or len(held) >= 200:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, octets = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    if "error" in names:
        raise ValueError("ranges of files that could not be listed")
    return spots.mapInArrow(read, out)


def _batched(path: str, start: int, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    place = 0

    def batch(values: list[str | None], told: str | None) -> pa.RecordBatch:
        places = range(place, place + len(values))
        return pa.RecordBatch.from_pydict({"value": values, "place": places, "error": [told] * len(values)}, schema)

    try:
        for some in _lines(_blocks(path, start, size)):
            for at in range(0, len(some), BATCH_LINES):
                part = some[at : at + BATCH_LINES]
                yield batch(part, None)
                place += len(part)
    except (OSError, EOFError, ValueError, zlib.error) as caught:
        yield batch([None], _said(caught))


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def numbered(lines: DataFrame) -> DataFrame:
    """Adds `line_no`, from 1 in each file, to lines that lie in a table.

    Only the narrow columns are read again: each range has its number of lines, the numbers
    of a file are summed in order, and a line's number is the sum before it plus its place.
    """
    counts = lines.where("value IS NOT NULL").groupBy("path", "start").agg(F.count(F.lit(1)).alias("__n"))
    before = running(
        counts, ["path"], ["start"], F.floor(F.col("start") / (1 << 40)).cast("long"),
        __before=RunningSum(F.col("__n")),
    ).select("path", "start", "__before")
    return (
        lines.join(before, ["path", "start"])
        .withColumn("line_no", (F.col("__before") + F.col("place") + 1).cast("long"))
        .drop("__before")
    )


def read_table(spots: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Lines of the ranges, read once: they land in a table, which the numbering reads."""
    return written(lines_in(spots, size), "lines")


def chunks_in(spots: DataFrame, overlap: int, size: int = RANGE_BYTES) -> DataFrame:
    """The rows of `ranges` with (content, error): one byte before the range and `overlap` after it."""
    names = spots.columns
    out = f"{_ddl(spots, names)}, content binary, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.select(["path", "start"]).to_pylist()):
                content, error = None, None
                try:
                    system, inner = opened(row["path"])
                    with system.open_input_file(inner) as raw:
                        first = max(0, row["start"] - 1)
                        raw.seek(first)
                        content = raw.read(row["start"] + size + overlap - first)
                except OSError as caught:
                    error = _said(caught)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())],
                    names=[*names, "content", "error"],
                )

    return spots.mapInArrow(read, out)


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256, header, size, mtime, error) of listed files; the bytes only pass by."""
    out = "path string, sha256 string, header binary, size long, mtime timestamp, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str | None, bytes, str | None]] = []
            for row in batch.select(["path", "error"]).to_pylist():
                digest, header, error = hashlib.sha256(), b"", row["error"]
                try:
                    if error is None:
                        system, inner = opened(row["path"])
                        with system.open_input_file(inner) as raw:
                            while block := raw.read(READ_BYTES):
                                header = header or block[:HEADER_BYTES]
                                digest.update(block)
                except OSError as caught:
                    error = _said(caught)
                found.append((None if error else digest.hexdigest(), header, error))
            sums, headers, errors = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["path"], pa.array(sums, pa.string()), pa.array(headers, pa.binary()),
                    batch["size"], batch["mtime"], pa.array(errors, pa.string()),
                ],
                names=["path", "sha256", "header", "size", "mtime", "error"],
            )

    return files.repartition(_tasks(files.sparkSession), "path").mapInArrow(read, out)


def save_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's (path, content) as a file below `folder`; (path, bytes) of those written.

    A retried task writes the same bytes again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, value in zip(batch["path"], batch["content"], strict=True):
                content = value.as_py() or b""  # of one row at a time
                system, inner = opened(f"{folder.rstrip('/')}/{path.as_py().lstrip('/')}")
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner, compression=None) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "path string, bytes long")


def case_path(path: Column, folder: str) -> Column:
    """The path below `folder`."""
    _, inner = opened(folder)
    return F.regexp_replace(path, "^.*?" + re.escape(inner.rstrip("/")), "")
