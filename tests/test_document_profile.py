"""Entities of documents by added-up cues, on literal texts in two languages."""

import pytest

from sievespark.operators import document_profile as D

ROWS = "doc_id long, text string"
TEXTS = {
    "person": ("Full name: Anna Stone\nlater Anna Stone left", {("PERSON", "Anna Stone")}),
    "person ru": ("Меня зовут Анна Петрова. Потом Анна Петрова ушла", {("PERSON", "Анна Петрова")}),
    "person by three weak cues": ("Anna Stone said so. Dr. Anna Stone", {("PERSON", "Anna Stone")}),
    "a pair alone": ("we saw Green Hill there and Green Hill again", set()),
    "organisation": ("at Blue River Ltd. and then Blue River sold", {("ORGANIZATION", "Blue River Ltd."), ("ORGANIZATION", "Blue River Ltd")}),
    "organisation ru": ("договор с ООО «Ромашка» подписан", {("ORGANIZATION", "ООО «Ромашка»")}),
    "organisation by two cues": ("she works at Acmecorp now\nAcmecorp, 2010 - 2015", {("ORGANIZATION", "Acmecorp")}),
    "one of them": ("she works at Acmecorp now", set()),
    "education": ("studied at North Lake University\nNorth Lake University is far", {("EDUCATION", "North Lake University")}),
    "education ru": ("Образование: Томский институт", {("EDUCATION", "Томский институт")}),
    "address": ("the house 12 Long Oak Street is", {("ADDRESS", "12 Long Oak Street")}),
    "address ru": ("это ул. Лесная, д. 5 у реки", {("ADDRESS", "ул. Лесная, д. 5")}),
    "contact": ("Phone: 555 123 4567, Telegram: @anna_stone", {("CONTACT", "555 123 4567"), ("CONTACT", "@anna_stone")}),
    "contact ru": ("Телефон: +7 900 123-45-67", {("CONTACT", "+7 900 123-45-67")}),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(TEXTS.values())), (90, None), (91, "")], ROWS)
    out = {}
    for r in D.document_entities(docs).collect():
        name = list(TEXTS)[r.doc_id]
        assert TEXTS[name][0][r.start : r.end] == r.value or r.rule == "document-propagation"
        out.setdefault(name, set()).add((r.type, TEXTS[name][0][r.start : r.end], r.rule, r.confidence))
    return out


@pytest.mark.parametrize("name", list(TEXTS))
def test_entities(found, name):
    got = {(t, v) for t, v, _, _ in found.get(name, set())}
    want = TEXTS[name][1]
    assert {v for _, v in want} >= {v for _, v in got} and {t for t, _ in want} == {t for t, _ in got} and (not want or got)


def test_scores_and_further_places(spark, found):
    assert {(v, r, c) for _, v, r, c in found["person by three weak cues"]} == {("Anna Stone", "person-speaks", 0.846), ("Anna Stone", "person-pair", 0.846), ("Anna Stone", "person-title", 0.846)}
    docs = spark.createDataFrame([(1, "Меня зовут Quill Ray-X. quote: QUILL; Quill_Ray-X came")], ROWS)
    rows = {(r.rule, r.start) for r in D.document_entities(docs).collect()}
    assert ("person-introduction", 11) in rows and any(rule == "document-propagation" for rule, _ in rows)
    assert D.document_entities(docs.where("false")).count() == 0
