"""Members of ZIP, TAR and GZIP files as rows, read where their archive is; members that can't be used are rows with a reason."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, member string, content binary, error string"


@dataclass(frozen=True)
class Limits:
    """Archives within archives, members of a file, and bytes of all its members: beyond them a file fails, nothing is cut."""

    depth: int = 5
    members: int = 10_000
    total: int = 64 << 20


class TooMuch(Exception):
    pass


def kind(data: bytes) -> str | None:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if data[257:262] == b"ustar" else None


def unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or parts[0][1:2] == ":"


def bounded(stream, left: int) -> bytes:
    """All of a stream, of which no more than `left` bytes are ever held."""
    data = stream.read(left + 1)
    if len(data) > left:
        raise TooMuch
    return data


def opened(data: bytes, left: list[int]) -> Iterator[tuple[str, bytes | None, str | None]]:
    """name, content and error of the members of one archive; left[0] is what remains of the bytes."""

    def take(stream) -> bytes:
        got = bounded(stream, left[0])
        left[0] -= len(got)
        return got

    form = kind(data)
    if form == "gzip":
        yield "", take(gzip.GzipFile(fileobj=io.BytesIO(data))), None
    elif form == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                if unsafe(m.filename):
                    yield m.filename, None, "ERR_ARCHIVE_PATH"
                elif m.flag_bits & 1:
                    yield m.filename, None, "ERR_ARCHIVE_ENCRYPTED"
                else:
                    with z.open(m) as stream:
                        yield m.filename, take(stream), None
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            for m in t:
                if unsafe(m.name):
                    yield m.name, None, "ERR_ARCHIVE_PATH"
                elif m.isfile():
                    yield m.name, take(t.extractfile(m)), None


def members(data: bytes, limits: Limits) -> list[tuple[str, bytes | None, str | None]]:
    """Members of an archive and of those within, names joined by '!'; one row with an error if the whole can't be read."""
    found: list[tuple[str, bytes | None, str | None]] = []
    left, todo = [limits.total], [("", data, 0)]
    try:
        while todo:
            prefix, blob, depth = todo.pop()
            for name, content, error in opened(blob, left):
                path = f"{prefix}!{name}" if prefix and name else prefix or name
                if content is not None and kind(content) and depth + 1 >= limits.depth:
                    content, error = None, "ERR_ARCHIVE_DEPTH"
                if content is not None and kind(content):
                    todo.append((path, content, depth + 1))
                else:
                    found.append((path, content, error))
                if len(found) + len(todo) > limits.members:
                    raise TooMuch
    except TooMuch:
        return [("", None, "ERR_LIMIT")]
    except (zipfile.BadZipFile, tarfile.TarError, gzip.BadGzipFile, zlib.error, EOFError, NotImplementedError):
        return [("", None, "ERR_ARCHIVE")]
    return found


def expand(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """path, member, content and error for files (path, content); a file that is no archive is its own member, named ''."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_py()
                rows = members(data, limits) if data is not None and kind(data) else [("", data, None)]
                yield pa.record_batch({"path": pa.array([path] * len(rows), pa.string()), "member": pa.array([r[0] for r in rows], pa.string()),
                                       "content": pa.array([r[1] for r in rows], pa.binary()), "error": pa.array([r[2] for r in rows], pa.string())})

    return files.select("path", "content").mapInArrow(make, MEMBERS)


def read_archives(spark: SparkSession, root: str, max_bytes: int = 32 << 20, limits: Limits = Limits()) -> DataFrame:
    """The members of every file under root; files over max_bytes are rows with a reason and are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    long = files.where(F.col("length") > max_bytes).select("path", F.lit("").alias("member"), F.lit("ERR_TOO_LARGE").alias("error"))
    return expand(files.where(F.col("length") <= max_bytes), limits).unionByName(long, allowMissingColumns=True)
