"""Rules applied to texts: each hit is a typed interval in code points, end-exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running
from ..functions.rules import DEFAULT, Rule


def detect(docs: DataFrame, rules: list[Rule] = DEFAULT, key: str = "doc_id", text: str = "text", around: tuple[int, int] | None = None) -> DataFrame:
    """key, start, end, type, category, rule, confidence, value of each hit; one scan whatever the number of rules.

    A hit's start is the running sum of the lengths of the gaps and hits before it, so nothing leaves the JVM. A value that
    was redacted already is no hit. around=(m, n) adds the m characters before and the n behind the value.
    """
    t = F.col(text)
    hits = lambda r: F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))
    found = docs.select(key, text, *[(F.when(F.contains(t, F.lit(r.hint)), hits(r)) if r.hint else hits(r)).alias(f"m{i}") for i, r in enumerate(rules)])
    gaps = found.select("*", *[F.when(F.size(f"m{i}") > 0, F.split(t, r.pattern, -1)).alias(f"g{i}") for i, r in enumerate(rules)])

    def each(i: int) -> Column:
        m, g = F.col(f"m{i}"), F.col(f"g{i}")
        ends = running(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda gap, v: (F.length(gap) + F.length(v)).cast("long")))
        row = lambda v, e: F.struct(F.lit(i).alias("r"), (e - F.length(v)).cast("long").alias("start"), v.alias("value"))
        return F.when(F.size(m) > 0, F.zip_with(m, ends, row))

    arrays = gaps.select(key, text, F.filter(F.array(*[each(i) for i in range(len(rules))]), lambda a: a.isNotNull()).alias("a"))
    rows = arrays.select(key, text, F.explode_outer(F.flatten("a")).alias("f")).where("f IS NOT NULL").select(key, text, "f.*")
    whole = (F.col("start") + F.length("value")).cast("int")
    rows = rows.select("*", F.when(F.col("start") > 0, F.substring(t, F.col("start").cast("int"), F.lit(1))).otherwise("").alias("left"), F.substring(t, whole + 1, F.lit(1)).alias("right"))
    inner = outer = F.col("value")
    for i, r in enumerate(rules):
        if r.lead or r.tail:
            outer = F.when(F.col("r") == i, F.regexp_replace("value", f"^(?:{r.lead})", "")).otherwise(outer)
            inner = F.when(F.col("r") == i, F.regexp_replace(F.regexp_replace("value", f"^(?:{r.lead})", ""), f"(?:{r.tail})$", "")).otherwise(inner)
    rows = rows.withColumns({"start": F.col("start") + F.length("value") - F.length(outer), "value": inner})
    rows = rows.withColumn("end", F.col("start") + F.length("value"))
    ok = F.lit(False)
    for i, r in enumerate(rules):
        test = ~F.contains("value", F.lit("[REDACTED]"))
        if r.edge:
            test = test & ~F.col("left").rlike(f"[{r.edge}]") & ~F.col("right").rlike(f"[{r.behind}{r.edge}]")
        more = r.test(F.col("value"))
        ok = F.when(F.col("r") == i, test if more is None else test & more).otherwise(ok)
    pick = lambda f: F.get(F.array(*[F.lit(f(r)) for r in rules]), F.col("r"))
    near = []
    if around:
        m, n = around
        start = F.col("start").cast("int")
        near = [F.substring(t, F.greatest(F.lit(1), start + 1 - m), F.least(F.lit(m), start)).alias("before"), F.substring(t, F.col("end").cast("int") + 1, F.lit(n)).alias("after")]
    return rows.where(ok).select(key, "start", "end", pick(lambda r: r.type).alias("type"), pick(lambda r: r.category).alias("category"), pick(lambda r: r.id).alias("rule"), pick(lambda r: r.confidence).alias("confidence"), "value", *near)


def detect_sql(rules: list[Rule] = DEFAULT, table: str = "documents", key: str = "doc_id", text: str = "text", around: tuple[int, int] | None = None) -> str:
    """The same as a SELECT for DuckDB."""
    parts = []
    quote = lambda x: x.replace("'", "''")
    near = ""
    if around:
        m, n = around
        near = f", substr(t, CAST(greatest(1, s + 1 - {m}) AS BIGINT), CAST(least({m}, s) AS BIGINT)) AS before, substr(t, s + length(value) + 1, {n}) AS after"
    for r in rules:
        p = quote(r.pattern)
        edge = f"AND NOT regexp_matches(CASE WHEN o > 0 THEN substr(t, o, 1) ELSE '' END, '[{r.edge}]') AND NOT regexp_matches(substr(t, o + length(hit) + 1, 1), '[{r.behind}{r.edge}]')" if r.edge else ""
        outer = f"regexp_replace(v[i], '^(?:{quote(r.lead)})', '')" if r.lead else "v[i]"
        inner = f"regexp_replace({outer}, '(?:{quote(r.tail)})$', '')" if r.tail else outer
        parts.append(
            f"SELECT k AS {key}, CAST(s AS BIGINT) AS start, CAST(s + length(value) AS BIGINT) AS \"end\", '{r.type}' AS type, '{r.category}' AS category, '{r.id}' AS rule, CAST({r.confidence} AS DOUBLE) AS confidence, value{near} FROM ("
            f"SELECT k, t, v[i] AS hit, {inner} AS value, o, o + length(v[i]) - length({outer}) AS s FROM ("
            f"SELECT k, t, v, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS o FROM ("
            f"SELECT k, t, v, g, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {key} AS k, {text} AS t, regexp_extract_all({text}, '{p}') AS v, string_split_regex({text}, '{p}') AS g FROM {table})))) WHERE NOT contains(value, '[REDACTED]') AND ({r.accept_sql}) {edge}"
        )
    return "\nUNION ALL ".join(parts)
