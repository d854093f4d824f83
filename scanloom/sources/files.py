"""Files as tables: folders are listed, and contents read and written, in tasks.

The driver holds no list that grows with the number of files. File systems are those that pyarrow opens by URI: local or
mounted folders, S3, GCS and HDFS.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.paths import scannable
from scanloom.session import new_folder, settle

#: Folders that one task lists, files whose beginning one task reads, bytes that one task reads.
FOLDERS, HEADS, BYTES = 64, 512, 128 << 20
#: Bytes of contents in one Arrow batch.
BATCH = 32 << 20
#: First bytes of a file that are read for its header, and the most.
HEAD, MOST_HEAD = 4096, 1 << 20
SCHEMES = ("", "file", "s3", "s3a", "s3n", "gs", "hdfs")

ENTRIES = "root string, relative string, folder boolean, length bigint, modificationTime timestamp"
_ENTRIES = pa.schema([
    ("root", pa.string()), ("relative", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()),
    ("modificationTime", pa.timestamp("us", "UTC")),
])


def scheme(path: str) -> str:
    return path.partition(":")[0].lower() if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) else ""


def opened(path: str) -> tuple[filesystems.FileSystem, str]:
    """File system of a path or URI and the path inside it."""
    kind = scheme(path)
    if kind in ("", "file"):
        return filesystems.LocalFileSystem(), re.sub("^[Ff][Ii][Ll][Ee]:/+", "/", path)
    if kind in ("s3a", "s3n"):
        path = "s3" + path[3:]
    return filesystems.FileSystem.from_uri(path)


class Opened(dict):
    """File systems by scheme and authority, so that a task opens each once."""

    def of(self, path: str) -> tuple[filesystems.FileSystem, str]:
        kind = scheme(path)
        if kind in ("", "file"):
            if kind not in self:
                self[kind] = filesystems.LocalFileSystem()
            return self[kind], re.sub("^[Ff][Ii][Ll][Ee]:/+", "/", path)
        head = path[: (path + "/").index("/", path.index("://") + 3)]
        if head not in self:
            self[head] = opened(head)
        system, base = self[head]
        return system, base.rstrip("/") + path[len(head) :]


def _listed(systems: Opened, root: str, relative: str) -> Iterator[tuple]:
    system, path = systems.of(f"{root}/{relative}" if relative else root or "/")
    if not relative:
        own = system.get_file_info(path)
        if own.type == filesystems.FileType.File:
            name = path.rstrip("/").rpartition("/")[2]
            yield root[: -len(name) - 1], name, False, own.size, (own.mtime_ns or 0) // 1000
            return
    for e in system.get_file_info(filesystems.FileSelector(path, allow_not_found=True)):
        name = f"{relative}/{e.base_name}" if relative else e.base_name
        yield root, name, e.type == filesystems.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1000


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def list_tree(spark: SparkSession, roots: str | Sequence[str], hidden: bool = False, depth: int = 64) -> DataFrame:
    """Every file below the roots: path, root, relative, length, modificationTime. No content is read.

    Folders are expanded level by level: the folders of a level are rows, spread over tasks that list them, and what they
    hold is a table again, whose folders are the next level. The driver only learns how many there are. Missing roots have
    no files, a root that is a file has itself. Below a root, hidden names and resource-fork folders are left out,
    whatever the root's own path is called. Folders deeper than ``depth``, as links in a circle make, are an error.
    """
    given = [roots] if isinstance(roots, str) else list(roots)
    given = list(dict.fromkeys(r.rstrip("/") for r in given))
    level = spark.createDataFrame([(r, "") for r in given], "root string, relative string")
    folders, seen, base = len(given), [], new_folder(spark, "listing")

    def run(batches):
        systems = Opened()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield from _batched((e for r, n in pairs for e in _listed(systems, r, n)), _ENTRIES)

    while folders:
        if len(seen) > depth:
            raise ValueError(f"folders are nested more than {depth} levels deep")
        # A number of its own: adaptive execution would merge these small rows into one task.
        tasks = min(-(-folders // FOLDERS), 10_000)
        seen.append(f"{base}/{len(seen)}")
        level.repartition(tasks, "root", "relative").mapInArrow(run, ENTRIES).write.parquet(seen[-1])
        entries = spark.read.schema(ENTRIES).parquet(seen[-1])
        level = entries.where("folder").select("root", "relative")
        if not hidden:
            level = level.where(scannable(F.col("relative")))
        folders = level.count()
    found = spark.read.schema(ENTRIES).parquet(*seen) if seen else spark.createDataFrame([], ENTRIES)
    files = found.where("NOT folder").drop("folder")
    if not hidden:
        files = files.where(scannable(F.col("relative")))
    return files.select(F.concat("root", F.lit("/"), "relative").alias("path"), "root", "relative", "length", "modificationTime")


def spread(rows: DataFrame, size: Column | None, share: int) -> DataFrame:
    """Rows dealt evenly over as many tasks as their total size, or their number, needs."""
    total = rows.agg(F.sum(size) if size is not None else F.count(F.lit(1))).first()[0] or 0
    return rows.repartition(min(max(1, -(-int(total) // share)), 10_000))


def read_contents(files: DataFrame) -> DataFrame:
    """``files(path, length, ...)`` with their bytes as ``content``, NULL where a file has gone or cannot be read.

    A content is one value; files near 2 GiB are read by :func:`read_ranges`.
    """
    columns = files.columns
    return read_ranges(files.withColumns({"_from": F.lit(0).cast("long"), "_size": F.col("length")}), "_from", "_size").select(*columns, "content")


def read_ranges(files: DataFrame, start: str, size: str) -> DataFrame:
    """Each row's bytes of ``path`` from ``start`` on, ``size`` of them, as ``content``.

    Rows are first written down and dealt out by the bytes they ask for, so a large file's ranges are read by many tasks.
    """
    rows = settle(files)
    dealt = spread(rows, F.col(size), BYTES)
    at = [dealt.columns.index(c) for c in ("path", start, size)]

    def run(batches):
        systems = Opened()
        for batch in batches:
            paths, starts, sizes = (batch.column(i).to_pylist() for i in at)
            first, held, contents = 0, 0, []
            for i, (path, begin, n) in enumerate(zip(paths, starts, sizes)):
                contents.append(_range(systems, path, begin, n))
                held += n or 0
                if held > BATCH:
                    yield rows_with(batch.slice(first, i + 1 - first), contents)
                    first, held, contents = i + 1, 0, []
            if contents:
                yield rows_with(batch.slice(first), contents)

    def rows_with(batch, contents):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{schema}, content binary")


def _range(systems: Opened, path: str, start: int, size: int) -> bytes | None:
    try:
        system, inner = systems.of(path)
        with system.open_input_file(inner) as f:
            f.seek(start)
            return f.read(size)
    except OSError:
        return None


def texts_of(path: Column, content: Column) -> Column:
    """Contents as text, those named ``.gz`` unpacked; NULL where that fails."""
    @F.pandas_udf("string")
    def text(paths, contents):
        return contents.combine(paths, _text)

    return text(path, content)


def _text(content: bytes | None, path: str) -> str | None:
    try:
        if content is None:
            return None
        return (gzip.decompress(content) if path.endswith(".gz") else content).decode()
    except (OSError, EOFError, zlib.error, UnicodeDecodeError):
        return None


HEADERS = "separator string, content_type string, transfer_syntax string, payload_start bigint, payload_size bigint"


def _header(systems: Opened, path: str, length: int) -> tuple:
    octets = (None, "application/octet-stream", None, 0, length)
    head, size = b"", HEAD
    while True:
        head = _range(systems, path, 0, min(size, length))
        if not head or not head.startswith(b"--"):
            return octets
        if b"\r\n\r\n" in head or size >= min(length, MOST_HEAD):
            break
        size *= 4
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return octets
    separator, _, lines = head[:end].partition(b"\r\n")
    line = re.search(rb"(?:^|\n)Content-Type:?([^\r\n]*)", lines)
    kind = line[1].partition(b";")[0].strip().decode("latin-1") if line else octets[1]
    syntax = re.search(rb"transfer-syntax=([^;]*)", line[1]) if line else None
    start = end + 4
    close = b"\r\n" + separator + b"--"
    tail = _range(systems, path, max(start, length - len(close) - 2), len(close) + 2) or b""
    at = tail.rfind(close)
    # Without its closing line the file is cut short, and all that is left is payload.
    stop = length if at < 0 else max(start, length - len(close) - 2) + at
    named = syntax[1].strip().decode("latin-1") if syntax else ""
    return separator.decode("latin-1"), kind, named or None, start, max(0, stop - start)


def multipart_headers(files: DataFrame) -> DataFrame:
    """``files(path, length, ...)`` with separator, content type, transfer syntax, and place and size of the payload.

    Only the first and last bytes of a file are read. A file that does not start with ``--``, or whose header has no end
    within ``MOST_HEAD`` bytes, is one octet stream.
    """
    rows = spread(settle(files), None, HEADS)
    at = [rows.columns.index(c) for c in ("path", "length")]
    own = [("separator", pa.string()), ("content_type", pa.string()), ("transfer_syntax", pa.string()), ("payload_start", pa.int64()), ("payload_size", pa.int64())]

    def run(batches):
        systems = Opened()
        for batch in batches:
            if batch.num_rows:
                found = [_header(systems, p, n) for p, n in zip(*(batch.column(i).to_pylist() for i in at))]
                added = [pa.array(c, t) for c, (_, t) in zip(zip(*found), own)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(n for n, _ in own)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {HEADERS}")


def payload_slices(headers: DataFrame, slice_bytes: int = 8 << 20) -> DataFrame:
    """Payloads in slices: the columns of ``headers`` with part (from 0) and content; an empty payload is one empty slice.

    A slice is a row and is read by itself, so no payload has to fit a row, a task or the memory of one.
    """
    last = F.greatest(F.lit(0), F.ceil(F.col("payload_size") / slice_bytes) - 1)
    parts = headers.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    begin = F.col("payload_start") + F.col("part") * slice_bytes
    size = F.least(F.lit(slice_bytes), F.col("payload_size") - F.col("part") * slice_bytes)
    return read_ranges(parts.withColumns({"_from": begin, "_size": size}), "_from", "_size").drop("_from", "_size")


def write_files(rows: DataFrame, root: str, packed: bool = False) -> DataFrame:
    """Write ``rows(path, content)``, one file a row, below ``root``; the manifest (path, length) of what was written.

    With ``packed``, contents of files named ``.gz`` are packed.

    A file is written under another name and then moved, so readers see whole files and a repeated task changes nothing.
    Where two rows have one path, one of them is there afterwards.
    """
    base = root.rstrip("/")
    manifest = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def run(batches):
        systems, made = Opened(), set()
        for batch in batches:
            yield from _batched((put(systems, made, p, c) for p, c in zip(*(x.to_pylist() for x in batch.columns))), manifest)

    def put(systems, made, path, content):
        system, inner = systems.of(f"{base}/{path}")
        folder = inner.rpartition("/")[0]
        if folder not in made:
            system.create_dir(folder, recursive=True)
            made.add(folder)
        partial = f"{folder}/.{uuid.uuid4().hex}"
        data = content or b""
        if packed and path.endswith(".gz"):
            data = gzip.compress(data, mtime=0)
        with system.open_output_stream(partial, compression=None) as f:
            f.write(data)
        system.move(partial, inner)
        return path, len(data)

    return settle(rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, length bigint"))
