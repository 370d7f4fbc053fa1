"""Encoded runs, rewritten in place; forms of names."""

import base64

from pyspark.sql import functions as F

from sievespark.operators import known as K
from sievespark.operators.encoded import rewrite_runs


def test_rewrite_runs(spark):
    code = lambda s: base64.b64encode(s.encode()).decode()
    texts = [f"a {code('mail to bob@example.com')} b {code('nothing to see here')} c", "no run", "", None, "abcdefghijklmnopqrstuvwx", code("bob@example.com, née Bob")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    hide = lambda c: F.regexp_replace(c, r"[a-z]+@[a-z.]+", "[REDACTED]")
    got = [r[0] for r in docs.orderBy("i").select(rewrite_runs(F.col("text"), hide)).collect()]
    assert got == [f"a {code('mail to [REDACTED]')} b {code('nothing to see here')} c", "no run", "", None, "abcdefghijklmnopqrstuvwx", code("[REDACTED], née Bob")]


def test_name_forms(spark):
    docs = spark.createDataFrame([(1, "Ann Lee; Lee, Ann; A. Lee; Lee A. and Ann Leeds")], "doc_id long, text string")
    names = spark.createDataFrame([("Ann", "Lee"), (None, "Lee"), ("", "Lee")], "given string, surname string")
    known = names.select(F.explode(K.name_forms(F.col("given"), F.col("surname"))).alias("value"))
    assert sorted((r.value, r.start) for r in K.known_values(docs, known).collect()) == [("A. Lee", 19), ("Ann Lee", 0), ("Lee A.", 27), ("Lee, Ann", 9)]
