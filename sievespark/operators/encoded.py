"""Runs of base64 in texts: what they hold is rewritten, and encoded again in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run that may be base64: whole groups of four.
RUN = r"(?:[A-Za-z0-9+/]{4}){4,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"


def decoded(run: Column) -> Column:
    """The text that a canonical run encodes; null if it isn't UTF-8, holds control characters or isn't canonical."""
    data = F.try_to_binary(run, F.lit("base64"))
    text = F.try_validate_utf8(data.cast("string"))
    return F.when((F.base64(data) == run) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), text)


#: Runs of hexadecimal digits and of percent escapes.
HEX, PERCENT = r"(?<![0-9A-Za-z+/%])(?:[0-9a-f]{2}){8,}(?![0-9A-Za-z+/=])", r"(?:%[0-9A-Fa-f]{2}){4,}"


def decoded_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, coding and plain of each run of base64, hexadecimal digits or percent escapes that decodes to text without control
    characters. A run of hexadecimal digits alone is none of base64."""
    utf8 = lambda data: F.try_validate_utf8(data.cast("string"))
    readers = {
        "base64": (RUN, lambda r: F.when(~r.rlike("^[0-9a-f]+$"), decoded(r))),
        "hex": (HEX, lambda r: utf8(F.unhex(r))),
        "percent": (PERCENT, lambda r: utf8(F.unhex(F.replace(r, F.lit("%"), F.lit(""))))),
    }

    def each(name: str, pattern: str, read: Callable[[Column], Column]) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda r: F.struct(F.lit(name).alias("coding"), read(r).alias("plain")))

    runs = F.concat(*[each(name, *reader) for name, reader in readers.items()])
    return docs.select(key, F.explode(runs).alias("r")).select(key, "r.coding", "r.plain").where(F.col("plain").isNotNull() & ~F.col("plain").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))


def rewrite_runs(text: Column, change: Callable[[Column], Column]) -> Column:
    """text with change(what it holds) encoded in the place of each run; runs that `change` leaves alone stay as they are."""

    def again(run: Column) -> Column:
        plain = decoded(run)
        after = change(plain)
        return F.when(plain.isNotNull() & (after != plain), F.base64(F.encode(after, "utf-8"))).otherwise(run)

    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, RUN, -1), runs, lambda gap, run: F.concat(gap, F.coalesce(again(run), F.lit("")))), "")
