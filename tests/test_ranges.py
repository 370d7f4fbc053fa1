"""Interval joins, escapes, cut names and JSON strings against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sievespark.functions.arrays import placed_hits, running
from sievespark.functions.rules import DEFAULT, Rule
from sievespark.operators import ranges as G
from sievespark.operators.detect import detect
from sievespark.sources.json_leaves import leaves

ROWS = "doc_id long, text string"
FOUND = "doc_id long, start long, end long, type string, category string, rule string, value string"


def test_running_sums_and_places(spark):
    r = random.Random(1)
    lists = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<long>").select("i", running(F.col("x")).alias("s")).collect()
    assert {x.i: x.s for x in got} == {i: [sum(x[: k + 1]) for k in range(len(x))] for i, x in enumerate(lists)}
    text = "".join(r.choices("ab ", k=3000))
    hits = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(placed_hits(F.col("t"), "ab|ba").alias("h")).collect()
    assert [(h.start, h.value) for h in hits[0].h] == [(m.start(), m[0]) for m in re.finditer("ab|ba", text)] and hits[1].h == []


@pytest.mark.parametrize("size", [4, 512])
def test_overlaps_as_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(G, "RANGE", size)
    r = random.Random(2)
    rows = lambda n: [(d, s, s + r.choice([0, 1, 3, 40])) for d in range(3) for s in (r.randrange(200) for _ in range(n))]
    one, two = rows(20), rows(25)
    kind = "doc_id long, start long, end long"
    got = sorted((x.doc_id, x.start, x.end, x.r_start, x.r_end) for x in G.overlapping(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)).collect())
    assert got == sorted((d, s, e, s2, e2) for d, s, e in one for d2, s2, e2 in two if d == d2 and s < e2 and s2 < e and e > s and e2 > s2)


def test_escapes_are_not_cut(spark):
    back = chr(92)
    text = f"a{back}n b{back}u0041c {back}{back}n d"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain")], ROWS)
    units = [(m.start(), m.end()) for m in re.finditer(r'\\(?:u[0-9A-Fa-f]{4}|["\\/bfnrt])', text)]
    assert sorted((x.start, x.end) for x in G.escapes(docs).collect()) == units and len(units) == 3
    spans = [(s, e) for s in range(len(text)) for e in range(s + 1, len(text) + 1)]
    found = spark.createDataFrame([(1, s, e, "X", "personal", "r", f"{s},{e}") for s, e in spans] + [(3, 0, 2, "X", "personal", "r", "3")], FOUND)
    got = {x.value: (x.start, x.end) for x in G.snapped(found, docs).collect()}
    inside = lambda p: next(((s, e) for s, e in units if s < p < e), (p, p))
    assert got == {f"{s},{e}": (inside(s)[0], inside(e)[1]) for s, e in spans} | {"3": (0, 2)}


def test_names_are_cut_at_cells(spark):
    values = ["Anna Smith", "Anna | Smith", "Anna\tJ. O'Neil-Ray", '"Anna", "Smith"', "Anna\nSmith", "Anna;\nSmith", "1 | 2", "Anna | 7 | Ray"]
    found = spark.createDataFrame([(i, 10, 10 + len(v), "PERSON", "personal", "known", v) for i, v in enumerate(values)] + [(99, 0, 3, "ID", "personal", "r", "a|b")], FOUND)
    got = {}
    for x in G.split_names(found, ["PERSON"]).orderBy("start").collect():
        got.setdefault(x.doc_id, []).append(x.value)
        assert x.doc_id == 99 or values[x.doc_id][x.start - 10 : x.end - 10] == x.value
    assert got == {0: ["Anna Smith"], 1: ["Anna", "Smith"], 2: ["Anna", "J. O'Neil-Ray"], 3: ["Anna", "Smith"], 4: ["Anna\nSmith"], 5: ["Anna;\nSmith"], 7: ["Anna", "Ray"], 99: ["a|b"]}


def plain_leaves(text, found):
    """Strings of a JSON text by a scan of their quotes, each finding against each."""
    strings = [(m.start() + 1, m.end() - 1, bool(re.match(r"\s*:", text[m.end() :]))) for m in re.finditer(r'"(?:[^"\\]|\\.)*"', text)]
    out = set()
    for s, e, category, rule in found:
        for low, high, is_key in strings:
            if low < high and s < high and low < e and not (is_key and category == "personal" and rule != "known-personal" and re.match(r"^[A-Za-z_$][\w$]*$", text[low:high])):
                out.add((s, e, rule) if low <= s and e <= high else (low, high, rule))
    return sorted(out)


def test_findings_in_json_strings(spark):
    r = random.Random(3)
    texts = [json.dumps({"name_1": "Anna a@b.org", "bob@b.org": ["x", {"y z": "tel"}], "n": 12, "e": "", "q": 'a"b\\'}), "not json", None]
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    spans = sorted({(s, s + r.randint(1, 30)) for s in range(len(texts[0])) for _ in range(2)})
    found = [(s, min(e, len(texts[0])), r.choice(["personal", "credential"]), r.choice(["email", "known-personal"])) for s, e in spans]
    df = spark.createDataFrame([(0, s, e, "T", c, k, texts[0][s:e]) for s, e, c, k in found], FOUND)
    got = G.in_leaves(df.drop("value"), leaves(docs)).collect()
    assert sorted({(x.start, x.end, x.rule) for x in got}) == plain_leaves(texts[0], found)
    kept = G.beside_keys(df, leaves(docs)).count()
    keys = [(m.start() + 1, m.end() - 1) for m in re.finditer(r'"([A-Za-z_$][\w$]*)"(?=:)', texts[0])]
    assert kept == sum(not (c == "personal" and k != "known-personal" and any(s < y and x < e for x, y in keys)) for s, e, c, k in found)
    emails = detect(docs, [x for x in DEFAULT if x.id == "email"])
    assert sorted(x.value for x in G.in_leaves(emails, leaves(docs)).collect()) == ["a@b.org", "bob@b.org"]
    across = detect(docs, [Rule("over", "personal", "X", r"b\.org\", \"bob@", 0.9)])
    assert sorted(x.value for x in G.in_leaves(across, leaves(docs)).collect()) == ["Anna a@b.org", "bob@b.org"]
    assert G.in_leaves(df.where("false"), leaves(docs)).count() == 0


def test_intervals_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 0, 3)], "doc_id long, start long, end long")
    met = G.overlapping(rows, rows.withColumn("n", F.lit(1)))
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 1
