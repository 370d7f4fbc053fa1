"""Policies that look at a finding's surroundings or at its value: suppression comments, templates, context words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comments by which secret scanners are told to leave a line, and the next line, alone.
SAME_LINE = r"(?i)(?:gitleaks|betterleaks|kingfisher|trufflehog):(?:allow|ignore)(?:$|[^A-Za-z0-9_])|pragma:\s*allowlist(?:\s+secret)?(?:$|\s*[^\sA-Za-z0-9_]|\s+(?:[^nN\s]|[nN][^eE]))|(?:^|[^A-Za-z0-9_])NOSONAR(?:$|[^A-Za-z0-9_])"
NEXT_LINE = r"(?i)pragma:\s*allowlist\s+nextline(?:\s+secret)?\b"
#: Values that stand for a value: ${NAME}, $NAME, <name>, {{name}}, %NAME%, runs of mask characters.
TEMPLATE = r"^(?:\$\{[^}]*\}|\$[A-Z_]+|<[^>]*>|\{\{.*\}\}|%[A-Z_]+%|[*xX•.]{4,})$"
#: What a context word adds to a score, and the least score with one.
BOOST, FLOOR = 0.35, 0.4


def with_lines(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings with `line`, the text of the line that each starts in, and `previous`, that of the line before."""
    start = F.col("start").cast("int")
    parts = findings.join(docs.select(key, "text"), key).select(*findings.columns, F.substring("text", F.lit(1), start).alias("_b"), F.substring_index(F.substring("text", start + 1, F.length("text")), "\n", 1).alias("_t"))
    line = F.concat(F.substring_index("_b", "\n", -1), "_t")
    previous = F.when(F.contains("_b", F.lit("\n")), F.substring_index(F.substring_index("_b", "\n", -2), "\n", 1)).otherwise("")
    return parts.select(*findings.columns, line.alias("line"), previous.alias("previous"))


def not_suppressed(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings that no comment in their line, or in the line before, suppresses."""
    lined = with_lines(findings, docs, key)
    return lined.where(~F.col("line").rlike(SAME_LINE) & ~F.col("previous").rlike(NEXT_LINE)).select(*findings.columns)


def without_templates(findings: DataFrame) -> DataFrame:
    """Findings but for credentials whose value is a template or a mask."""
    return findings.where((F.col("category") != "credential") | ~F.col("value").rlike(TEMPLATE))


def without_public(findings: DataFrame, public: DataFrame) -> DataFrame:
    """Personal findings whose type and value are not listed as public; credentials always stay."""
    listed = public.select("type", "value").distinct().withColumn("listed", F.lit(True))
    joined = findings.join(listed, ["type", "value"], "left")
    return joined.where((F.col("category") == "credential") | F.col("listed").isNull()).select(*findings.columns)


def boosted(score: Column, words: str) -> Column:
    """The score of a hit with `before` and `after`, raised where a context word stands there."""
    near = F.lower("before").rlike(words) | F.lower("after").rlike(words)
    return F.when(near, F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), score + BOOST))).otherwise(score)


def without_exempt(findings: DataFrame, exempt: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings but for the personal ones in the texts whose key `exempt` lists; credentials always stay."""
    listed = exempt.select(key).distinct().withColumn("exempt", F.lit(True))
    return findings.join(listed, key, "left").where((F.col("category") == "credential") | F.col("exempt").isNull()).select(*findings.columns)
