"""Identifiers by shape, scored by the words near them and by their check digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import digits
from ..functions.national import IDENTIFIERS, Identifier
from .detect import detect, detect_sql

#: Characters read before and behind a value, and what must not stand there.
AROUND = (80, 32)
LEFT = r"(?:[\p{L}\p{N}_.+-]|[0-9][ ()-]{0,3})\z"
RIGHT = r"^(?:[\p{L}\p{N}_]|[ ()-]{0,3}[0-9])"
# Words behind which a number is a time, a size or a count.
NOISE_WORDS = "timestamp ts time created_at updated_at elapsed duration ms epoch order run size bytes port pid line col"
NOISE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{NOISE_WORDS.replace(' ', '|')})[\x22\x27]?[ :=_-]*\z"
#: Seconds and milliseconds from 2000-01-01 to 2099-12-31.
_DIGITS = digits("value")
EPOCH = f"(length({_DIGITS}) in (10, 13) and translate({_DIGITS}, '0123456789', '') = '' and substr({_DIGITS}, 1, 10) between '0946684800' and '4102444799')"


def _score(i: Identifier, test) -> list[tuple[str, float]]:
    """Conditions in order and their confidence, in SQL of either engine; test renders a match of a pattern."""
    near = test("concat(before, value, after)", i.label)
    check = f"({i.check})"
    plain = test("value", i.plain) if i.plain else "false"
    veto = f"({test('before', NOISE)} or {EPOCH})"
    return [(f"{near} and {check}", 0.99), (near, 0.9), (f"{veto} or not ({check} or {plain})", 0.0), (f"{plain} and {check}", 0.99), (plain, 0.4), (check, 0.35)]


def _rlike(v: str, pattern: str) -> str:
    return f"{v} rlike r'{pattern}'" if "'" not in pattern else f'{v} rlike r"{pattern}"'


def _matches(v: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({v}, '{quoted}')"


def detect_national(docs: DataFrame, identifiers: list[Identifier] = IDENTIFIERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, type, confidence, value. A null text has no findings.

    Near a label the confidence is 0.99 if the check digits hold, else 0.9. Elsewhere numbers that look like times or
    sizes don't count; distinctive shapes score 0.99 or 0.4, and others 0.35 if their check digits hold.
    """
    found = detect(docs, [i.rule() for i in identifiers], key, text, AROUND).where(~F.col("before").rlike(LEFT) & ~F.col("after").rlike(RIGHT))

    def case(i: Identifier) -> Column:
        out = None
        for test, confidence in _score(i, _rlike):
            out = F.when(F.expr(test), confidence) if out is None else out.when(F.expr(test), confidence)
        return out.otherwise(0.0)

    confidence = F.lit(0.0)
    for i in identifiers:
        confidence = F.when(F.col("type") == i.type, case(i)).otherwise(confidence)
    return found.withColumn("confidence", confidence).where("confidence > 0").select(key, "start", "end", "type", "confidence", "value")


def national_sql(i: Identifier, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    cases = " ".join(f"WHEN {test} THEN {confidence}" for test, confidence in _score(i, _matches))
    return (
        f"SELECT {key}, start, \"end\", type, confidence, value FROM (SELECT {key}, start, \"end\", type, CAST(CASE {cases} ELSE 0 END AS DOUBLE) AS confidence, value "
        f"FROM ({detect_sql([i.rule()], table, key, text, AROUND)}) WHERE NOT {_matches('before', LEFT)} AND NOT {_matches('after', RIGHT)}) WHERE confidence > 0"
    )
