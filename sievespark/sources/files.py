"""Files as rows: their bytes are decoded where they are read, and a file that can't be used is a row with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECODED = "encoding string, text string, error string, offset long, record long"
MARKS = ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8"))


def decode_one(data: bytes | None) -> tuple:
    """encoding, text, error, and the byte offset and line of a malformed character."""
    if data is None:
        return None, None, None, None, None
    mark, encoding = next(((m, e) for m, e in MARKS if data.startswith(m)), (b"", "utf-8"))
    try:
        text = data[len(mark):].decode(encoding)
    except UnicodeDecodeError as e:
        at = e.start + len(mark)
        return encoding, None, "ERR_ENCODING", at, data[:at].count(b"\n") + 1
    return (encoding, None, "ERR_BINARY", None, None) if "\0" in text else (encoding, text, None, None, None)


def decode_content(content: Column) -> Column:
    """A struct of DECODED for bytes in UTF-8 or, by their mark, UTF-16: malformed and binary content has no text.

    Rows go to Python in batches of a hundred and not of ten thousand, so what a worker holds doesn't grow with its task's rows."""

    return F.udf(lambda data: decode_one(None if data is None else bytes(data)), DECODED, useArrow=False)(content)


def read_texts(spark: SparkSession, root: str, max_bytes: int = 32 << 20, skip: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """path, length and DECODED of each file under root, but for folders to skip; files that are too long are not read.

    Spark's reader gives no row for an empty file, so neither does this.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    for name in skip:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    read = files.where(F.col("length") <= max_bytes).select("path", "length", decode_content(F.col("content")).alias("d")).select("path", "length", "d.*")
    long = files.where(F.col("length") > max_bytes).select("path", "length", F.lit("ERR_TOO_LARGE").alias("error"))
    return read.unionByName(long, allowMissingColumns=True)
