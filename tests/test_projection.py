"""Views through layers with places mapped back, and rounds of redaction, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from sievespark.functions.rules import DEFAULT, Rule
from sievespark.operators import known as K
from sievespark.operators import projection as V
from sievespark.operators.detect import detect
from sievespark.operators.residual import redacted_until_clean

ROWS = "doc_id long, text string"
EMAIL = [r for r in DEFAULT if r.id == "email"]


@pytest.mark.parametrize(("layers", "text", "plain"), [
    (["percent"], "x%41%c3%a9%ffz", "xAé%ffz"),
    (["percent", "entity"], "a%26#x41;&eacute;&nosuch;&#0;", "aAé&nosuch;&#0;"),
    (["percent", "entity", "percent"], "%26percnt;41", "A"),
    (["units"], "{0}u0041{0}ud83d{0}ude00{0}ud83d-".format(chr(92)), "A\N{GRINNING FACE}\\ud83d-"),
    (["braced", "bytes"], r"\u{1F600}\x{41}\U00000042%u0043\xc3\xa9", "😀ABCé"),
    (["points", "css"], r"U+0074 U+006F U+006B U+0065 U+0041 and U+200B; \74 \6f \6b \65", "tokeA and U+200B; toke"),
    (["hidden", "terminal", "nul"], "a​­b \x1b[31mc\x1b[0m g\0h\0i\0j\0 x\0y", "ab c ghij x\0y"),
    (["tags"], "a<b>c</b><br/>d<a href='x'>e</a> 1<2", "ac\nde 1<2"),
    (["forms"], "ＡＢ① ٣٤ ﬁ … é", "AB1 34 fi … é"),
    (["accents", "scripts"], "Вели́мир Пряжкинa Paрa A", "Велимир Пряжкина Papa A"),
    (["control", "plus"], r"a\nb\\+c d+e", "a\nb\\+c d e"),
])
def test_layers(layers, text, plain):
    view, places = V.view_of(text, layers)
    assert view == plain and places.at[-1] == len(view)
    starts, ends = [places.start(i) for i in range(len(view))], [places.end(i + 1) for i in range(len(view))]
    assert starts == sorted(starts) and ends == sorted(ends) and all(0 <= s < e <= len(text) for s, e in zip(starts, ends))
    assert all(text[s:e] == c for s, e, c in zip(starts, ends, view) if places.copied(view.index(c), view.index(c) + 1) and view.count(c) == 1)


def test_composed_maps_as_plain_walks():
    """Random edits of three layers: each character of the last view against the interval that a walk through all layers gives."""
    r = random.Random(4)
    for _ in range(300):
        text, places, walk = "".join(r.choices("abcdef", k=r.randint(1, 40))), None, None
        for _ in range(3):
            edits, at = [], 0
            while at < len(text):
                start = at + r.randint(0, 6)
                end = start + r.randint(1, 4)
                if end > len(text):
                    break
                edits.append((start, end, "".join(r.choices("xyz", k=r.randint(0, 3)))))
                at = end
            walk = walk or [(i, i + 1) for i in range(len(text))]
            new, last = [], 0
            for start, end, value in [*edits, (len(text), len(text), "")]:
                new += walk[last:start] + [(walk[start][0], walk[end - 1][1])] * len(value) if end > start else walk[last:start]
                last = end
            text, then = V.applied(text, edits)
            places, walk = V.composed(places, then) if places else then, new
            assert [(places.start(i), places.end(i + 1)) for i in range(len(text))] == walk
            if not text:
                break


def test_nested_views_for_rules_and_known_values(spark):
    shown = "A​nn%26#64;b&period;org"
    text = f"😀 {shown}, also plain@b.org and Ann%26nbsp;L&eacute;e; Пряжкинa"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain@b.org 100% a+b"), (5, "%zz &x; <")], ROWS)
    found = V.everywhere(docs, lambda d: detect(d, EMAIL))
    assert sorted((r.doc_id, text[r.start : r.end] if r.doc_id == 1 else "", r.value) for r in found.collect()) == [(1, shown, "Ann@b.org"), (1, "plain@b.org", "plain@b.org"), (4, "", "plain@b.org")]
    known = spark.createDataFrame([("ann lée",), ("Пряжкина",)], "value string")
    hits = V.everywhere(docs, lambda d: K.known_words(d, known), V.KNOWN)
    assert sorted((r.value, text[r.start : r.end]) for r in hits.collect()) == [("ann lée", "Ann%26nbsp;L&eacute;e"), ("Пряжкина", "Пряжкинa")]
    assert V.projected(docs.where("false")).count() == 0
    assert [r.doc_id for r in V.projected(docs).collect()] == [1]


def test_rounds_until_clean(spark):
    """The first round's cut joins the parts of an address; what is put in its place may be a finding for ever."""
    rows = [(1, "ann@exatel:+15550001111mple.org done"), (2, "nothing"), (3, None), (4, "bob@b.org"), (5, "")]
    docs = spark.createDataFrame(rows, ROWS)
    got = {r.doc_id: (r.text, r.rounds, r.redactions, r.error) for r in redacted_until_clean(docs, lambda d: detect(d, [x for x in DEFAULT if x.id in ("email", "tel-uri")]), "").collect()}
    assert got == {1: (" done", 2, 2, None), 2: ("nothing", 0, 0, None), 3: (None, 0, 0, None), 4: ("", 1, 1, None), 5: ("", 0, 0, None)}
    ever = redacted_until_clean(docs, lambda d: detect(d, EMAIL), lambda kind: F.lit("new@b.org"))
    assert {r.doc_id: (r.text, r.rounds, r.error) for r in ever.where("doc_id in (2, 4)").collect()} == {2: ("nothing", 0, None), 4: (None, 4, "ERR_RESIDUAL")}
    twice = Rule("x", "personal", "X", "ab", 0.9)
    deep = redacted_until_clean(spark.createDataFrame([(1, "a" * 4 + "b" * 4), (2, "a" * 5 + "b" * 5)], ROWS), lambda d: detect(d, [twice]), "")
    assert {r.doc_id: (r.text, r.rounds, r.error) for r in deep.collect()} == {1: ("", 4, None), 2: (None, 4, "ERR_RESIDUAL")}
    assert redacted_until_clean(docs.where("false"), detect).count() == 0


def test_layers_run_only_where_they_change_something(monkeypatch):
    """Letters that no layer changes cost no call each, and what a layer finds is what its pattern finds."""
    from sievespark.operators import projection as P

    plain, calls = "обычный текст é\n" * 50, []
    monkeypatch.setitem(P.LAYERS, "forms", lambda t, of=P.LAYERS["forms"]: calls.append(t) or of(t))
    monkeypatch.setitem(P.LAYERS, "scripts", lambda t, of=P.LAYERS["scripts"]: calls.append(t) or of(t))
    assert P.view_of(plain + "ﬁ²", P.KNOWN)[0] == plain + "fi2" and calls == ["\nﬁ²"]
    for text in ("a…́b\ńc", "Вeлo ﬁ ٣１\n²\n\ncе", plain, "", "…", "ﬁ…²"):
        assert all(P.edits_of(name, text) == list(P.LAYERS[name](text)) for name in P.LAYERS)
