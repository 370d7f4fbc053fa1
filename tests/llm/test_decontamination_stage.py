"""The pipeline's decontamination stage cuts a text into words once, also where its filter is pushed down."""

import re

from pyspark.sql import functions as F

from sievespark.llm import decontaminate as D


def test_words_are_cut_once_in_the_filter(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b-c d e f g h i j y"), (2, "a b c d e f g h i"), (3, None), (4, "")], "doc_id long, text string")
    kept = D.clean(docs, items)
    cut = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"\b[Tt]ranslate", x)]
    assert len(cut) == 1 and len(re.findall(r"\btranslate\(", cut[0])) == 1
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_words_are_the_matches(spark):
    texts = ["", " ", "a", " A1 b", "--x--", "é ñ z\n\tQ", "\U0001f600a\x7fb\x80c", "0:9@A[Z`a{z|~", "\x00", "ab", None, "x" * 9 + "," * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", D.words(F.col("text")).alias("ws")).collect()
    low = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    assert {r.i: r.ws for r in rows} == {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for i, t in enumerate(texts)}
