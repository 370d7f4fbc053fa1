"""Views of a text in which escapes are decoded, and places in them mapped back to the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of escapes: percent, numeric HTML entities of one character, and \xNN; with how a run is decoded.
PERCENT = r"(?:%[0-9A-Fa-f]{2})+"
ENTITY = r"&#[0-9]{2,7};"
SLASH = r"(?:\\x[0-9A-Fa-f]{2})+"


def _utf8(hexed: Column) -> Column:
    return F.try_validate_utf8(F.unhex(hexed).cast("string"))


DECODERS = {
    "percent": (PERCENT, lambda run: _utf8(F.replace(run, F.lit("%"), F.lit("")))),
    "entity": (ENTITY, lambda run: F.when(F.translate(run, "&#;", "").cast("int").between(32, 127), F.chr(F.translate(run, "&#;", "").cast("int")))),
    "slash": (SLASH, lambda run: _utf8(F.replace(run, F.lit("\\x"), F.lit("")))),
}


def view(docs: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """key, text (decoded; a run that doesn't decode to text stays as it is) and parts: in order the lengths, in the text and in
    the view, of what is between runs and of each run. Only texts with a run."""
    pattern, read = DECODERS[kind]
    cut = docs.select(key, F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("runs")).where(F.size("runs") > 0)
    read_runs = cut.select(key, "gaps", "runs", F.transform("runs", lambda r: F.coalesce(read(r), r)).alias("plain"))
    same = lambda g: F.struct(F.length(g).alias("was"), F.length(g).alias("now"), F.lit(False).alias("run"))
    each = F.transform("gaps", lambda g, i: F.array(same(g), F.struct(F.length(F.get("runs", i)).alias("was"), F.length(F.get("plain", i)).alias("now"), F.lit(True).alias("run"))))
    parts = F.filter(F.flatten(each), lambda p: p["was"].isNotNull())
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("plain", i), F.lit("")))), "")
    return read_runs.select(key, text.alias("text"), parts.alias("parts"))


def mapped(parts: Column, start: Column, end: Column) -> Column:
    """A struct (start, end) of a place of the view in the text; one that begins or ends within a run takes all of the run."""
    at = lambda was, now, run, s, e: F.struct(was.cast("long").alias("was"), now.cast("long").alias("now"), s.cast("long").alias("s"), e.cast("long").alias("e"))

    def step(a: Column, p: Column) -> Column:
        was, now = a["was"] + p["was"], a["now"] + p["now"]
        begins = a["s"].isNull() & (start < now)
        ends = a["e"].isNull() & (end <= now)
        s = F.when(begins, F.when(p["run"], a["was"]).otherwise(a["was"] + start - a["now"])).otherwise(a["s"])
        e = F.when(ends, F.when(p["run"], was).otherwise(a["was"] + end - a["now"])).otherwise(a["e"])
        return at(was, now, None, s, e)

    none = F.lit(None).cast("long")
    return F.aggregate(parts, at(F.lit(0), F.lit(0), None, none, none), step, lambda a: F.struct(a["s"].alias("start"), a["e"].alias("end")))


def found_in_view(findings: DataFrame, views: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings in a view's text with start and end in the text itself; only those that an escape is part of."""
    placed = findings.join(views.select(key, "parts"), key).withColumn("at", mapped(F.col("parts"), F.col("start"), F.col("end")))
    own = placed.where((F.col("at.end") - F.col("at.start")) != (F.col("end") - F.col("start")))
    return own.withColumns({"start": F.col("at.start"), "end": F.col("at.end")}).drop("parts", "at")
