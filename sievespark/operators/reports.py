"""Reports of a scan: what was read, what was skipped and why, and findings as CSV rows and SARIF results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running

#: Columns of the CSV report, in order, and the longest text that a scan reads, in UTF-16 code units: 32 Mi.
CSV = ["status", "path", "reason", "rule", "type", "category", "line", "column", "start", "end", "confidence", "baselined"]
LONGEST = 32 * 1024 * 1024


def too_long(longest: int) -> Column:
    """Whether a text has more UTF-16 code units than that; only texts with so many bytes are encoded to know it."""
    return F.when(F.octet_length("text") > longest, F.octet_length(F.encode("text", "UTF-16LE")) > 2 * longest).otherwise(False)


def skipped(docs: DataFrame, key: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """key and reason of the texts that a scan doesn't read: missing ones and those over `longest`, which are never cut."""
    reason = F.when(F.col("text").isNull(), "ERR_MISSING").when(too_long(longest), "ERR_LIMIT")
    return docs.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def read_texts(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & ~too_long(longest))


def path(key: str) -> Column:
    return F.concat(F.lit("documents/"), F.col(key).cast("string"))


def located(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings with line and column, from 1, of their start. Not texts but the places of their ends of lines meet the findings."""
    lengths = F.transform(F.split("text", "\n", -1), lambda x: (F.length(x) + 1).cast("long"))
    met = findings.join(docs.where("text IS NOT NULL").select(key, running(lengths).alias("ends")), key)  # a line's end is the next one's start
    lines = met.withColumn("before", F.size(F.filter("ends", lambda e: e <= F.col("start"))))
    column = F.col("start") - F.coalesce(F.get("ends", F.col("before") - 1), F.lit(0)) + 1
    return lines.select(*findings.columns, (F.col("before") + 1).cast("long").alias("line"), column.cast("long").alias("column"))


def cell(value: Column, number: bool = False) -> Column:
    """A CSV cell: numbers as they are, text in quotes, and an apostrophe before what a spreadsheet would take for a formula."""
    if number:
        return value.cast("string")
    text = F.coalesce(value, F.lit(""))
    return F.concat(F.lit('"'), F.when(text.rlike(r"^[ \t\r\n]*[=+@-]|^[\t\r\n]"), F.lit("'")).otherwise(""), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(findings: DataFrame, missed: DataFrame, key: str = "doc_id") -> DataFrame:
    """path and line: a line of the report for each located finding and for each text skipped; the header is CSV."""
    numbers = {"line", "column", "start", "end", "confidence"}
    made = lambda df, given: df.select(path(key).alias("path"), F.concat_ws(",", *[cell(given[c], c in numbers) if c in given else F.lit('""') for c in CSV]).alias("line"))
    found = {c: F.col(c) for c in ("rule", "type", "category", "line", "column", "start", "end", "confidence")}
    return made(findings, found | {"status": F.lit("finding"), "path": path(key)}).unionByName(made(missed, {"status": F.lit("skipped"), "path": path(key), "reason": F.col("reason")}))


def sarif_results(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start and result: a SARIF result for each located finding; rules are numbered by their first appearance."""
    firsts = findings.groupBy("rule").agg(F.min(F.struct(key, "start")).alias("p"))  # a row a rule
    order = F.transform(F.array_sort(F.collect_list(F.struct("p", "rule"))), lambda x: x["rule"])
    rules = F.broadcast(firsts.agg(order.alias("rules")))
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("start").alias("charOffset"), (F.col("end") - F.col("start")).alias("charLength"))
    level = F.when(F.col("category") == "credential", "error").otherwise("warning")
    place = F.struct(F.struct(F.struct(path(key).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), (F.array_position("rules", F.col("rule")) - 1).alias("ruleIndex"), level.alias("level"), F.struct(F.concat("type", F.lit(" found by "), "rule").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.join(rules).select(key, "start", F.to_json(result).alias("result"))


def recall(expected: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """By rule: annotated spans, those found exactly, and those that a finding overlaps."""
    e = expected.groupBy(key, "rule", "start", "end").agg(F.count(F.lit(1)).alias("c"))
    f = findings.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    both = e.join(f, (F.col(key) == F.col("k")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left")
    spans = both.groupBy(key, "rule", "start", "end").agg(F.bool_or((F.col("s") == F.col("start")) & (F.col("e") == F.col("end"))).alias("exact"), F.bool_or(F.col("s").isNotNull()).alias("touched"))
    return spans.groupBy("rule").agg(F.count(F.lit(1)).alias("annotated"), F.count_if("exact").alias("exact"), F.count_if("touched").alias("overlapped"))


def reported(records: DataFrame) -> DataFrame:
    """value of each record (JSON) of another scanner's report: its Secret, or its Raw text; records without one are left out."""
    value = F.coalesce(F.get_json_object("record", "$.Secret"), F.get_json_object("record", "$.RawV2"), F.get_json_object("record", "$.Raw"))
    return records.select(value.alias("value")).where("value <> ''")


def _units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def to_utf16(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings with start and end in UTF-16 code units."""
    joined = findings.join(docs.select(key, "text"), key)
    units = lambda c: _units(F.substring("text", F.lit(1), F.col(c).cast("int")))
    return joined.withColumns({"start": units("start"), "end": units("end")}).select(*findings.columns)


def from_utf16(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings given in UTF-16 code units with start and end in code points; an end within a pair takes the whole of it."""
    joined = findings.join(docs.select(key, F.encode("text", "UTF-16LE").alias("units")), key)
    points = lambda c: F.length(F.regexp_replace(F.hex(F.substring("units", F.lit(1), (F.col(c) * 2).cast("int"))), "([0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F]|[0-9A-F]{4})", "x")).cast("long")
    return joined.withColumns({"start": points("start"), "end": points("end")}).select(*findings.columns)
