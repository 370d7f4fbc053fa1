"""Reversible placeholders: each distinct value of a type in a document gets a number, and a map gives it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import rendered, span_union

#: A token, of a type and a number.
TOKEN = r"\[\[[A-Z][a-z0-9_]*-[0-9]+\]\]"
PARTS = r"^\[\[([A-Z][a-z0-9_]*)-([0-9]+)\]\]$"


def placeholders(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the rewritten text, and entries: token and value of each distinct value, in the order of its first place.

    Findings are read once, and texts meet them once; numbers follow from the order of a document's own spans. A token that a
    text holds already is reserved: numbers of its type begin behind the largest there (up to nine digits; longer ones aren't reached)."""
    lists = span_union(findings, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("spans"))
    joined = docs.select(key, "text").join(lists, key, "left")
    said = lambda s: F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    valued = joined.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.struct(s["type"].alias("type"), said(s).alias("value")).alias("v"))))
    firsts = valued.withColumn("firsts", F.array_distinct(F.transform("spans", lambda s: s["v"])))
    number = lambda v: F.size(F.filter(F.slice("firsts", 1, F.array_position("firsts", v).cast("int")), lambda x: x["type"] == v["type"]))
    held = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, PARTS, 1).alias("name"), F.regexp_extract(t, PARTS, 2).alias("n")))
    reserved = firsts.withColumn("held", F.filter(held, lambda t: F.length(t["n"]) < 10))
    name = lambda v: F.initcap(F.lower(v["type"]))
    floor = lambda v: F.coalesce(F.array_max(F.transform(F.filter("held", lambda t: t["name"] == name(v)), lambda t: t["n"].cast("long"))), F.lit(0))
    token = lambda v: F.concat(F.lit("[["), name(v), F.lit("-"), (number(v) + floor(v)).cast("string"), F.lit("]]"))
    named = reserved.withColumn("tokens", F.transform("firsts", token))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at("tokens", F.array_position("firsts", s["v"]).cast("int")).alias("replacement")))
    done = named.withColumn("spans", spans)
    entries = F.transform("firsts", lambda v, i: F.struct(F.get("tokens", i).alias("token"), v["value"].alias("value")))
    return done.select(key, rendered(F.col("text"), F.col("spans")).alias("text"), entries.alias("entries"))


def restore(rewritten: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts with the values of their own map in place of the tokens, in one pass over the tokens of a text: a value that looks like a
    token is not replaced again, and a token that isn't in the map stays."""
    value = lambda t: F.coalesce(F.get(F.transform(F.filter("entries", lambda e: e["token"] == t), lambda e: e["value"]), F.lit(0)), t)
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    back = F.array_join(F.zip_with(F.split("text", TOKEN, -1), F.transform(tokens, value), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    return rewritten.select(key, F.when(F.col("entries").isNull(), F.col("text")).otherwise(back).alias("text"))
