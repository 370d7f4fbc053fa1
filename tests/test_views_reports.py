"""Views, propagation, known words and reports on literal rows, with nulls, empty texts and empty tables."""

import pytest
from pyspark.sql import functions as F

from sievespark.functions import scalar as S
from sievespark.functions.rules import DEFAULT
from sievespark.operators import known as K
from sievespark.operators import reports as R
from sievespark.operators import views as V
from sievespark.operators.detect import detect
from sievespark.operators.encoded import decoded_runs
from sievespark.operators.propagation import propagated
from sievespark.streaming import registry

ROWS = "doc_id long, text string"


@pytest.mark.parametrize(("kind", "text", "shown"), [("percent", "x %61nn%40b.org, %ff", "%61nn%40b.org"), ("entity", "to &#97;nn@b&#46;org.", "&#97;nn@b&#46;org"), ("slash", r"\x61n\x6E@b.org", r"\x61n\x6E@b.org")])
def test_places_in_views_come_back(spark, kind, text, shown):
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ann@b.org plain")], ROWS)
    views = V.view(docs, kind)
    found = V.found_in_view(detect(views, [r for r in DEFAULT if r.id == "email"]), views).collect()
    assert [(r.doc_id, r.value, text[r.start : r.end]) for r in found] == [(1, "ann@b.org", shown)]
    assert V.view(docs.where("false"), kind).count() == 0


def test_propagation(spark):
    text = "Ann Lee-Ray came. ann lee ray no; Ann_Lee Ray yes, xAnn Lee Ray no. Ann Lee-Ray again"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Ann Lee Ray")], ROWS)
    found = spark.createDataFrame([(1, 0, 11, "PERSON", 0.9, "Ann Lee-Ray"), (1, 0, 3, "PERSON", 0.5, "Ann"), (1, 2, 4, "X", 0.9, "a\\b"), (3, 0, 1, "X", 0.9, None)], "doc_id long, start long, end long, type string, confidence double, value string")
    got = sorted((r.doc_id, text[r.start : r.end], r.value) for r in propagated(docs, found).collect())
    assert got == [(1, "Ann Lee-Ray", "Ann Lee-Ray"), (1, "Ann_Lee Ray", "Ann Lee-Ray")]
    assert propagated(docs, found.where("false")).count() == 0
    back = chr(92)
    odd = f"a{back}Eb, a{back}b; a{back}Eb and a{back}b"
    rows = spark.createDataFrame([(1, 0, 4, "X", "c", 0.9, f"a{back}Eb"), (1, 6, 9, "X", "c", 0.9, f"a{back}b")], "doc_id long, start long, end long, type string, category string, confidence double, value string")
    assert sorted(odd[r.start : r.end] for r in propagated(spark.createDataFrame([(1, odd)], ROWS), rows).collect()) == [f"a{back}Eb", f"a{back}b"]


def test_known_words(spark):
    text = "ANN  LEE | ann_lee load_ann_lee_v2; Ann\nLee, Ann and Lee, Ann\n\nLee joann lee"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], ROWS)
    known = spark.createDataFrame([("Ann Lee",), ("Ann",), (None,), ("",), ("no such words here at all",)], "value string")
    rows = K.known_words(docs, known)
    assert sorted((r.start, r.found) for r in rows.where("value = 'Ann Lee'").collect()) == [(0, "ANN  LEE"), (11, "ann_lee"), (24, "ann_lee"), (36, "Ann\nLee")]
    assert all(text[r.start : r.end] == r.found for r in rows.collect())
    assert sorted(r.found for r in K.proper_case(rows).where("value = 'Ann'").collect()) == ["ANN", "Ann", "Ann", "Ann"]
    assert K.known_words(docs, known.where("false")).count() == 0 == K.known_words(docs.where("false"), known).count()


def test_reports(spark):
    docs = spark.createDataFrame([(1, "a\nmail ann@b.org now"), (2, None), (3, "x" * 101), (4, ""), (5, "é" * 100)], ROWS)
    found = R.located(detect(R.read_texts(docs, 100)), docs)
    assert [(r.line, r.column, r.start) for r in found.collect()] == [(2, 6, 7)]
    assert sorted(tuple(r) for r in R.skipped(docs, longest=100).collect()) == [(2, "ERR_MISSING"), (3, "ERR_LIMIT")]
    lines = {r.path: r.line for r in R.csv_lines(found, R.skipped(docs, longest=100)).collect()}
    assert lines["documents/1"] == '"finding","documents/1","","email","EMAIL","personal",2,6,7,16,0.85,""' and lines["documents/2"].startswith('"skipped","documents/2","ERR_MISSING"') and len(lines) == 3
    cells = spark.createDataFrame([("=1",), ("  +a",), ('q"q',), (None,), ("ok",)], "v string").select(R.cell(F.col("v"))).collect()
    assert [r[0] for r in cells] == ['"\'=1"', '"\'  +a"', '"q""q"', '""', '"ok"']
    expected = spark.createDataFrame([(1, "email", 7, 16), (1, "email", 6, 10), (1, "email", 0, 1)], "doc_id long, rule string, start long, end long")
    assert [tuple(r) for r in R.recall(expected, found).collect()] == [("email", 3, 1, 2)]


def test_decoded_runs_and_fakes(spark):
    docs = spark.createDataFrame([(1, "aGVsbG8gdGhlcmUgeW91 and 68656c6c6f207468657265 and %68%65%6C%6C%6F"), (2, None), (3, "0123456789abcdef0123")], ROWS)
    assert sorted((r.coding, r.plain) for r in decoded_runs(docs).collect()) == [("base64", "hello there you"), ("hex", "hello there"), ("percent", "hello")]
    one = spark.createDataFrame([("GB82WEST12345698765432", "+1 (212) 555-7788", "L898902C3")], "iban string, phone string, doc string")
    r = one.select(S.fake_iban(b"k", F.col("iban")).alias("i"), S.fake_phone(b"k", F.col("phone")).alias("p"), S.mrz_check(F.col("doc")).alias("m"), S.mod97(S.fake_iban(b"k", F.col("iban"))).alias("rest")).first()
    assert r.i != "GB82WEST12345698765432" and r.i[4:8] == "WEST" and r.rest == 1 and r.m == 6 and r.p.startswith("+1 (212) 555-01")


def test_two_passes_and_a_stream_over_its_limit(spark, tmp_path, monkeypatch):
    rows = [("a", 1, "Quill waits, quillon not"), ("a", 2, "my name is Quill."), ("b", 1, "Quill"), ("a", 3, None), ("c", 1, "i a.b@c.org"), ("c", 0, "A.B@C.org?")]
    df = spark.createDataFrame(rows, "s string, n long, text string")
    got = {(r.s, r.n): (r.text, r.n_redacted) for r in registry.redact_batch(df, "s", "n").collect()}
    assert got == {("a", 1): ("[REDACTED] waits, quillon not", 1), ("a", 2): ("my name is [REDACTED].", 1), ("b", 1): ("Quill", 0), ("a", 3): ("", 0), ("c", 1): ("i [REDACTED]", 1), ("c", 0): ("[REDACTED]?", 1)}
    assert registry.redact_batch(df.where("false"), "s", "n").count() == 0


def test_utf16_offsets_and_scanner_records(spark):
    docs = spark.createDataFrame([(1, "😀é ann@b.org 😀x")], ROWS)
    found = detect(docs)
    units = R.to_utf16(found, docs)
    assert [(r.start, r.end) for r in units.collect()] == [(4, 13)] and [(r.start, r.end) for r in found.collect()] == [(3, 12)]
    assert [(r.start, r.end) for r in R.from_utf16(units, docs).collect()] == [(3, 12)]
    records = spark.createDataFrame([('{"Secret":"s1"}',), ('{"Raw":"r","RawV2":"r2"}',), ("{}",), (None,), ("no json",)], "record string")
    assert sorted(r.value for r in R.reported(records).collect()) == ["r2", "s1"]
    text = "saw Dr Ann Lee Ray Now and ann"
    hits = K.known_words(spark.createDataFrame([(1, text)], ROWS), spark.createDataFrame([("Lee",), ("ann",)], "value string"))
    assert sorted(r.whole for r in K.extended(hits, spark.createDataFrame([(1, text)], ROWS)).collect()) == ["Dr Ann Lee Ray Now", "Dr Ann Lee Ray Now", "ann"]
