"""What is confirmed once in a text is looked for in all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running

INSIDE = r"[\p{L}\p{N}_]"


def propagated(docs: DataFrame, findings: DataFrame, key: str = "doc_id", least: float = 0.85) -> DataFrame:
    """key, type, value, start, end of each further place of a value that a finding of at least this confidence has in the
    same text, with any run of blanks, _ or - for such a run in it, that no letter, digit or _ touches and no finding covers.

    Values of 2 to 256 characters. Seeds and spans of a text meet it once, in one row; only places become rows."""
    seeds = findings.where((F.col("confidence") >= least) & F.col("value").isNotNull()).where("length(value) BETWEEN 2 AND 256")
    quoted = lambda v: F.concat(F.lit(r"\Q"), F.regexp_replace(F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), "[ _-]+", r"\\E[ _-]+\\Q"), F.lit(r"\E"))
    listed = seeds.groupBy(key, "value").agg(F.min("type").alias("type")).groupBy(key).agg(F.collect_list(F.struct("value", "type", quoted(F.col("value")).alias("p"))).alias("seeds"))
    spans = findings.groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = docs.select(key, "text").join(listed.join(spans, key), key)

    def placed(s):
        found, gaps = F.regexp_extract_all("text", s["p"], F.lit(0)), F.split(F.col("text"), s["p"], -1)
        ends = lambda m, g: running(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda x, y: (F.length(x) + F.length(y)).cast("long")))
        place = lambda v, e: F.struct((e - F.length(v)).cast("long").alias("start"), e.cast("long").alias("end"), s["value"].alias("value"), s["type"].alias("type"))
        return let(found, lambda m: let(gaps, lambda g: F.zip_with(m, ends(m, g), place)))

    each = rows.select(key, "text", "spans", F.flatten(F.transform("seeds", placed)).alias("hits"))
    left = lambda h: F.when(h["start"] > 0, F.substring("text", h["start"].cast("int"), F.lit(1))).otherwise("")
    right = lambda h: F.substring("text", (h["end"] + 1).cast("int"), F.lit(1))
    free = lambda h: ~left(h).rlike(INSIDE) & ~right(h).rlike(INSIDE) & ~F.exists("spans", lambda c: (c["start"] <= h["start"]) & (c["end"] >= h["end"]))
    return each.select(key, F.filter("hits", free).alias("hits")).select(key, F.explode("hits").alias("h")).select(key, "h.type", "h.value", "h.start", "h.end")
