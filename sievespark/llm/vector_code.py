"""Vector code compression: product quantization by exact rounds of k-means over integers, pruned by norm-of-sum bounds.

A vector's components become integers and are cut into PARTS equal parts, each with a codebook of its own. A row keeps for each part
its entry, an upper bound of the distance to that entry and a lower bound of the distance to every other entry, each
with the stamp of the round it was measured in. All codebooks so far are retained, so in round t a bound of round s
changes by the true net displacement of an entry, |c(t) - c(s)|, the norm of the sum of its steps and never more than
the sum of their norms. A part whose bounds stay apart keeps its entry; else its own distance is measured, and only if that
doesn't settle it, all entries are scanned. Distances that decide are integers, and bounds only count with
a margin above the rounding of floats, so ties and results are those of plain rounds.

The state of a round is a written table, the one before is deleted once the next is complete. Sums of a round are made per task,
one row for each part and entry, so no shuffle grows with the rows.

Rows whose vector is null or holds null or non-finite components are dropped. So are vectors whose length isn't a positive
multiple of PARTS or isn't the length of the smallest kept vec_id's, and those with a component so large that squared
distances would not fit a long. A null vec_id is the largest; equal ones go by their vectors. Repeated rows are kept and count
each. With fewer than `entries` vectors the codebooks are smaller; an empty table gives no rows. label_error is null where a sum
doesn't fit a long. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import discard, materialize, salted_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are apart only if they are by more than this share and this much: far above the rounding of doubles.
SHARE, LEAST = 1e-9, 1e-6
STATE = {"code": np.uint8, "up": np.float64, "up_at": np.uint8, "low": np.float64, "low_at": np.uint8}


def whole_numbers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Kept rows (vec_id, label, v: integers), and the length of a vector."""
    real = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)).where(real)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    d = first[0] if first else PARTS
    limit = math.isqrt(2**60 // d)
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double") * SCALE) < limit)
    return rows.where((F.size("embedding") == d) & fits).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v")), d


def moved(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each round before, part and entry: how far the entry is now from where it was, and the largest such distance of the other entries."""
    net = np.sqrt(((history[-1] - history) ** 2).sum(-1).astype(np.float64))
    others = np.zeros_like(net)
    for e in range(net.shape[-1]):
        others[..., e] = np.delete(net, e, axis=-1).max(-1, initial=0)
    return net, others


def apart(up: np.ndarray, low: np.ndarray) -> np.ndarray:
    return up * (1 + SHARE) + LEAST < low * (1 - SHARE)


def settle(v: np.ndarray, state: dict[str, np.ndarray] | None, history: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """State of rows v (rows x parts x dimensions) under the last codebook of history, and how many parts were scanned in full."""
    n, t, book = len(v), len(history) - 1, history[-1]
    new = {k: np.zeros((n, PARTS), kind) if state is None else state[k].copy() for k, kind in STATE.items()}
    net, others = moved(history)
    scanned = 0
    for p in range(PARTS):
        left = np.arange(n)
        if state is not None:
            code = new["code"][:, p]
            up = new["up"][:, p] + net[new["up_at"][:, p], p, code]
            low = new["low"][:, p] - others[new["low_at"][:, p], p, code]
            left = np.flatnonzero(~apart(up, low))
            own = np.sqrt(((v[left, p] - book[p, code[left]]) ** 2).sum(-1).astype(np.float64))
            new["up"][left, p], new["up_at"][left, p] = own, t
            left = left[~apart(own, low[left])]
        if not len(left):
            continue
        scanned += len(left)
        far = np.stack([((v[left, p] - entry) ** 2).sum(-1) for entry in book[p]], axis=1)
        best = far.argmin(1)
        at = np.arange(len(left))
        new["code"][left, p], new["up"][left, p] = best, np.sqrt(far[at, best].astype(np.float64))
        rest = far.astype(np.float64)
        rest[at, best] = np.inf
        new["low"][left, p] = np.sqrt(rest.min(1))
        new["up_at"][left, p] = new["low_at"][left, p] = t
    return new, scanned


def vectors_of(b: pa.RecordBatch) -> np.ndarray:
    flat = b.column(b.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(b.num_rows, PARTS, -1)


def state_of(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(b.column(b.schema.get_field_index(k)).to_pylist()), kind).reshape(b.num_rows, PARTS) for k, kind in STATE.items()}


def assigned(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """rows with the state under the last codebook."""
    first = len(history) == 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new, _ = settle(vectors_of(b), None if first else state_of(b), history)
                made = {k: pa.array([x.tobytes() for x in new[k]], pa.binary()) for k in STATE}
                yield pa.record_batch({c: b.column(b.schema.get_field_index(c)) for c in ("vec_id", "label", "v")} | made)

    kept = StructType([rows.schema[c] for c in ("vec_id", "label", "v")])
    for k in STATE:
        kept = kept.add(k, "binary")
    return rows.mapInArrow(make, kept)


def next_book(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry's floor of the mean of its parts; unused entries stay."""
    parts, entries, dims = book.shape

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, dims), np.int64)
        for b in batches:
            if b.num_rows:
                v, code = vectors_of(b), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                slot = (code + np.arange(parts) * entries).reshape(-1)
                count += np.bincount(slot, minlength=len(count))
                np.add.at(total, slot, v.reshape(-1, dims))
        used = np.flatnonzero(count)
        if len(used):
            yield pa.record_batch({"slot": pa.array(used, pa.int64()), "n": pa.array(count[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    sums = rows.select("v", "code").mapInArrow(make, "slot long, n long, total array<long>").groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
    new = book.copy()
    for r in sums.collect():  # at most parts x entries rows
        new[r.slot // entries, r.slot % entries] = np.array(r.total, np.int64) // r.n
    return new


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row per kept row of vectors: vec_id, label, code (a byte for each part), error; and the codebooks (part x entry x dimension)."""
    some, d = whole_numbers(vectors)
    rows = materialize(some)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    book = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, d // PARTS).transpose(1, 0, 2)
    if not len(first):
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), book
    history = book[None]
    state = materialize(assigned(rows, history))
    discard(rows)
    for _ in range(rounds):
        book = next_book(state, history[-1])
        if (book == history[-1]).all():  # further rounds change nothing
            break
        history = np.concatenate([history, book[None]])
        after = materialize(assigned(state, history))
        discard(state)
        state = after
    final = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
                error = ((vectors_of(b) - final[np.arange(PARTS), code]) ** 2).sum((1, 2))
                yield pa.record_batch({"vec_id": b.column(0), "label": b.column(1), "code": b.column(3), "error": pa.array(error)})

    kind = StructType([state.schema["vec_id"], state.schema["label"]]).add("code", "binary").add("error", "long")
    return state.select("vec_id", "label", "v", "code").mapInArrow(measure, kind), final


def op13_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    rows = materialize(coded.select("*", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key"), F.monotonically_increasing_id().alias("row")))
    sums = rows.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    found = salted_join(rows, sums, ["key"], "row", rows.count())
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    out = [
        f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) AS t(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {ENTRIES})",
    ]
    for r in range(rounds + 1):
        # the least of distance * ENTRIES + entry is the nearest entry, the lowest of equal ones
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x.v) AS v, min(CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT) * {ENTRIES} + e) AS m
  FROM parts x JOIN b{r} b ON x.p = b.p GROUP BY vec_id, x.p)""")
        if r < rounds:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS v FROM (SELECT p, m % {ENTRIES} AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y
  FROM (SELECT p, m, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, m % {ENTRIES}, i) GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""")
    out.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    out.append(f"books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM b{rounds}))")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"


SQL = sql()
