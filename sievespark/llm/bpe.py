"""Byte-level BPE by monoid tree reduction.

Each match of the pattern is encoded on its own. A match that is a token is its id; any other is halved, both halves are
encoded by the same rule, down to LEAF bytes, and the two lists of ids are joined: the last and first w ids around the
border are encoded anew from their bytes, and w doubles until the new ids fit their neighbours. Two adjacent ids fit if
encoding their bytes gives just these two; a list of ids whose adjacent pairs all fit is the encoding of its bytes, so
nothing outside the window can change. (join, []) is a monoid: it is associative with the empty list as unit, so the
halves may be encoded anywhere and in any order. Decoding concatenates up the same tree.

Null text is encoded as the empty text: no ids. An empty table gives no rows. A very long text is held whole, at about
20 bytes a byte; a match of any length is a tree of its own, so its time grows with its length only. Repeated rows each have their result; only doc_id and text are read.
The vocabulary's path is a parameter; the file is read where the tasks run, as it comes with an installed package.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, table

#: Matches of up to so many characters are remembered in a worker, and so many of them; bytes that the first window of a
#: join would encode anew as a whole, so that halving them is of no use.
SHORT, REMEMBERED, LEAF = 48, 200_000, 12


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.packed: dict[str, bytes] = Packed(self)
        self.pair_fits = lru_cache(REMEMBERED)(lambda a, b: self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b])

    def merge(self, data: bytes) -> list[int]:
        """The ids of a window: merge the pair of least rank, the leftmost of equals, as long as there is one."""
        rank, none = self.ranks.get, len(self.bytes_of)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of data: itself if it is a token, else those of its halves, joined."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:])) if data else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of both lists."""
        if not left or not right or self.pair_fits(left[-1], right[0]):
            return left + right
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            middle = self.merge(b"".join(self.bytes_of[i] for i in left[a:] + right[:b]))
            if (a == 0 or self.pair_fits(left[a - 1], middle[0])) and (b == len(right) or self.pair_fits(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            w *= 2

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([packed[m] for m in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids, concatenated up a tree of halves."""

        def up(part: list[int]) -> bytes:
            if len(part) <= 4096:
                return b"".join(map(self.bytes_of.__getitem__, part))
            half = len(part) // 2
            return up(part[:half]) + up(part[half:])

        return up(np.frombuffer(ids, "<u4").tolist())


class Packed(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, match: str) -> bytes:
        found = np.array(self.codec.encode_bytes(match.encode()), dtype="<u4").tobytes()
        if len(match) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = found
        return found


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, 4 bytes an id), decoded (binary) of each row.

    What a task remembers goes with it: workers are used again by other stages, which would hold it for nothing."""

    def encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([own.decode(x) for x in ids], pa.binary())})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(codec(path, pattern), batches)
        codec.cache_clear()
        gc.collect()  # a codec and its tables refer to each other

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), *vocabulary()))
