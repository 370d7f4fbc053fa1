"""What the operators of this subpackage share: reading, folds, intermediate tables and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task of a salted join may take in any case.
PART = 256
#: Bytes of a batch that goes to a Python worker.
BATCH = 4_000_000
#: White space between words, as a regular expression class; bytes.split() uses the same six bytes.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold -1, which is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session whose executor is the driver may go without the setting, as tests do."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sieve_dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark._sieve_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sieve-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def discard(made: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing is left to be computed from it."""
    path = made.sparkSession._jvm.org.apache.hadoop.fs.Path(made._written)
    path.getFileSystem(made.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the check that stands before every broadcast."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, total: int, how: str = "inner", hint: str | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and in n the number of left's rows with it.

    A key of more than PART rows and a thousandth of total, left's rows, is dealt by the column `by` over as many tasks as it
    takes; there are at most a thousand such keys, so that their list can be broadcast."""
    most = max(PART, total // 1000)
    hot = right.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("parts"))).cast("long").alias("salt")
    dealt = left.join(F.broadcast(hot), keys, "left").select(*[F.col(f"`{c}`") for c in left.columns], salt)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > most, F.ceil(F.col("n") / most) - 1).otherwise(F.lit(0)).cast("long"))).alias("salt")
    spread = right.select("*", each).drop("n")
    return dealt.join(spread.hint(hint) if hint else spread, [*keys, "salt"], how).drop("salt")


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of about BATCH bytes, or of as many as it was told to.

    Spark's own limit of 10,000 rows or 64 MB is held by the worker and, off the heap, by the executor, which gives back little of it."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, spark.conf.get(limit, f"{BATCH}b"))


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text (a longer text is alone), so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float)))
        cut = np.flatnonzero(np.diff(size // limit)) + 1
        for i, j in zip([0, *cut], [*cut, batch.num_rows]):
            yield batch.slice(i, j - i)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def flag_array(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at each of n positions that some [start, end) covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
