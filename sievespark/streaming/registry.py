"""Texts of ordered streams, in which what an earlier text confirms is redacted in all later ones, and values that keep one number in a stream."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.stage import shared_folder
from .carried import with_state_store

#: Evidence for a value, in its first group.
EVIDENCE = re.compile(r"(?:[Mm]y name is |[Ii] am called )([^\s,.;]{2,256})|([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
WORD = re.compile(r"[^\s,;:()\"'<>]+")


def _digests(words: set[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.lower().encode(), digest_size=8, key=b"registry").digest(), "little") for w in words], np.uint64)


def redact_stream(rows: DataFrame, stream: str, seq: str, text: str = "text", keep_ms: int | None = None) -> DataFrame:
    """stream, seq, text, n_redacted, late and error (null: nothing ends a stream) for each row of a streaming DataFrame.

    A stream's rows of one batch are taken by seq, then text, in one worker: the source's limits of a batch (maxFilesPerTrigger,
    maxBytesPerTrigger) bound them. Its state is keyed: an entry for each confirmed value, and for each batch a list of keyed digests of the words
    that went out, read one list at a time and only where a batch confirms a value that is new; so a long stream takes room in the state
    store, not in a worker, and there is no limit behind which values are forgotten. late says that a value is confirmed here which had
    gone out before. keep_ms: entries not confirmed again for so long end. Null text is empty.
    """

    class Redacting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.values = handle.getMapState("values", "value string", "seen boolean", keep_ms)
            self.sent = handle.getListState("sent", "words binary", keep_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            values, fresh, out = {k[0] for k in self.values.keys()}, set(), []
            batch = pd.concat(list(rows)).fillna({text: ""}).sort_values([seq, text], kind="stable")
            for n, t in zip(batch[seq], batch[text]):
                said = {(m[1] or m[2]).lower() for m in EVIDENCE.finditer(t)}
                new = said - values
                late = bool(new) and self._sent(new, fresh)
                for v in said if keep_ms else new:
                    self.values.updateValue((v,), (True,))
                values |= new
                count = 0
                if values:
                    every = "|".join(map(re.escape, sorted(values, key=len, reverse=True)))
                    t, count = re.subn(rf"(?i)(?<![^\W_])(?:{every})(?![^\W_])", "[REDACTED]", t)
                fresh |= {w.lower() for w in WORD.findall(t)}
                out.append((key[0], n, t, count, late, None))
            self.sent.appendValue((_digests(fresh).tobytes(),))
            yield pd.DataFrame(out, columns=[stream, seq, text, "n_redacted", "late", "error"]).astype({"error": object})

        def _sent(self, new: set[str], fresh: set[str]) -> bool:
            if new & fresh:
                return True
            wanted = _digests(new)
            return any(np.isin(wanted, np.frombuffer(blob[0], np.uint64)).any() for blob in self.sent.get())

        def close(self) -> None:
            pass

    with_state_store(rows.sparkSession)
    kinds = dict(rows.dtypes)
    made = f"{stream} {kinds[stream]}, {seq} {kinds[seq]}, {text} string, n_redacted long, late boolean, error string"
    return rows.select(stream, seq, text).groupBy(stream).transformWithStateInPandas(Redacting(), outputStructType=made, outputMode="append", timeMode="ProcessingTime" if keep_ms else "none")


def number_stream(found: DataFrame, stream: str, seq: str, keep_ms: int | None = None) -> DataFrame:
    """stream, seq, start, type, value and number of each finding of a streaming DataFrame: the number that its value has among those of
    its type in the stream, by first appearance over all batches (seq, then start, within one).

    State: the number of each value (by type and digest), and a counter for each type. keep_ms: a value that doesn't come again for so
    long gets a new number, which none had before."""

    class Numbering(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.numbers = handle.getMapState("numbers", "type string, digest string", "number long", keep_ms)
            self.counters = handle.getMapState("counters", "type string", "last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values([seq, "start"], kind="stable")
            numbers: dict[tuple[str, str], int] = {}  # of this batch's values
            for kind, value in zip(batch["type"], batch["value"]):
                if (kind, value) in numbers:
                    continue
                entry = (kind, hashlib.blake2b(value.encode(), digest_size=16, key=b"number").hexdigest())
                if self.numbers.containsKey(entry):
                    number = self.numbers.getValue(entry)[0]
                else:
                    number = (self.counters.getValue((kind,))[0] if self.counters.containsKey((kind,)) else 0) + 1
                    self.counters.updateValue((kind,), (number,))
                self.numbers.updateValue(entry, (number,))
                numbers[kind, value] = number
            batch["number"] = [numbers[x] for x in zip(batch["type"], batch["value"])]
            yield batch[[stream, seq, "start", "type", "value", "number"]]

        def close(self) -> None:
            pass

    with_state_store(found.sparkSession)
    kinds = dict(found.dtypes)
    made = f"{stream} {kinds[stream]}, {seq} {kinds[seq]}, start {kinds['start']}, type string, value string, number long"
    return found.select(stream, seq, "start", "type", "value").groupBy(stream).transformWithStateInPandas(Numbering(), outputStructType=made, outputMode="append", timeMode="ProcessingTime" if keep_ms else "none")


def run_available(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream over all that its source has, into files that show only committed batches, and read them."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    made = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    made.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def redact_batch(rows: DataFrame, stream: str, seq: str, text: str = "text") -> DataFrame:
    """stream, seq, text, n_redacted of each row of a table that is there as a whole: all of a stream's values are collected first,
    and redacted in every one of its texts, also before the place that confirms them.

    Values are one row each, so a long stream's texts stay spread; a stream's list of them goes to each of its texts."""
    found = F.regexp_extract_all(text, F.lit(EVIDENCE.pattern), F.lit(0))
    clean = lambda v: F.lower(F.regexp_replace(v, r"^(?:[Mm]y name is |[Ii] am called )", ""))
    values = rows.select(stream, F.explode(F.transform(found, clean)).alias("v")).distinct()
    escaped = F.concat(F.lit(r"\Q"), F.col("v"), F.lit(r"\E"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("v")).alias("n"), escaped.alias("p")))), lambda x: x["p"])
    lists = values.groupBy(stream).agg(F.array_join(ordered, "|").alias("every"))
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])(?:"), F.col("every"), F.lit(r")(?![\p{L}\p{N}])"))
    given = rows.select(stream, seq, F.coalesce(text, F.lit("")).alias("t")).join(lists, stream, "left").withColumn("p", pattern)
    n = F.when(F.col("p").isNull(), 0).otherwise(F.expr("regexp_count(t, p)"))
    return given.select(stream, seq, F.when(F.col("p").isNull(), F.col("t")).otherwise(F.expr("regexp_replace(t, p, '[REDACTED]')")).alias(text), n.cast("long").alias("n_redacted"))
