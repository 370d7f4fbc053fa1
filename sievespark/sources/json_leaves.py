"""String leaves and keys of JSON texts with their places, and the policies that go by a leaf's path."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
LEAF = "path array<string>, field string, is_key boolean, raw string, value string, start long, end long, error string"


def _walk(text: str) -> Iterator[tuple]:
    """path, field, is_key, raw, value, start, end of each string, in order; places don't count the quotes."""
    json.loads(text)
    path: list[str] = []  # one entry for each open container: the key or index that is current in it
    arrays: list[bool] = []
    key = False
    for m in TOKEN.finditer(text):
        t = m.group()
        if t in "{[":
            arrays.append(t == "[")
            path.append("0" if t == "[" else "")
            key = t == "{"
        elif t in "}]":
            arrays.pop()
            path.pop()
            key = False
        elif t == ",":
            if arrays[-1]:
                path[-1] = str(int(path[-1]) + 1)
            key = not arrays[-1]
        elif t == ":":
            key = False
        elif t[0] == '"':
            value = json.loads(t) if "\\" in t else t[1:-1]
            if key:
                path[-1] = value
            field = next((p for p, a in zip(reversed(path), reversed(arrays)) if not a), "")
            yield list(path), field, key, t[1:-1], value, m.start() + 1, m.end() - 1, None


def leaves(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each string of each JSON text; one row with error ERR_JSON for a text that is none. Null has no rows."""
    schema = docs.select(key).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(k, *r) for r in _walk(t)] if t is not None else []
                except (ValueError, RecursionError):
                    rows.append((k, None, None, None, None, None, None, None, "ERR_JSON"))
            types = [b.schema.field(0).type, pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = [key, "path", "field", "is_key", "raw", "value", "start", "end", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    # A small file of many rows is few tasks where it is read.
    return docs.select(key, text).repartition(key).mapInArrow(make, f"{key} {schema[0].dataType.simpleString()}, {LEAF}")


def field_matches(pattern: str, path: str = "path", field: str = "field") -> Column:
    """A name matches the field in any case and spelling; a dotted path matches step by step, * any one step."""
    norm = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    if "." not in pattern:
        return norm(F.col(field)) == norm(F.lit(pattern))
    steps = pattern.split(".")
    return (F.size(path) == len(steps)) & F.forall(F.arrays_zip(F.col(path).alias("p"), F.array(*map(F.lit, steps)).alias("s")), lambda z: (z["s"] == "*") | (z["p"] == z["s"]))


def beyond_allowed(found: DataFrame, allowed: list[str]) -> DataFrame:
    """Leaves of fields that are not allowed, as findings of type JSON_VALUE."""
    ok = F.lit(False)
    for a in allowed:
        ok = ok | field_matches(a)
    return found.where(~F.col("is_key") & ~ok).withColumn("type", F.lit("JSON_VALUE"))


def duplicate_keys(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that one object has more than once: where there are any, the text is not to be rewritten."""
    return found.where("is_key").groupBy(key, F.concat_ws(".", "path").alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
