"""Names over the fields of records, in five shapes, from literal texts."""

import json

import pytest

from sievespark.operators import records as R
from sievespark.sources.json_leaves import leaves

ROWS = "doc_id long, text string"
KNOWN = [("Anna Smith",), ("Boris Ivanovich Petrov",), ("Lee Ann Ray",), (None,), ("",)]

SHAPES = {
    "pairs": ('first_name: Anna\nlast_name: "Smith"', {("given", "Anna"), ("surname", "Smith")}),
    "json lines": ('{"user":{"lastName":"Smith","age":3,"firstName":"Anna"}}', {("given", "Anna"), ("surname", "Smith")}),
    "url": ("?fname=anna&x=1&lname=SMITH", {("given", "anna"), ("surname", "SMITH")}),
    "three": ("surname => 'Petrov', middle_name = Ivanovich, given=Boris", {("surname", "Petrov"), ("patronymic", "Ivanovich"), ("given", "Boris")}),
    "xml": ("<p><firstName>Anna</firstName><x/>\n<lastName a='1'>Smith</lastName></p>", {("given", "Anna"), ("surname", "Smith")}),
    "markdown": ("- **First name:** Anna\n- **Surname:** *Smith*", {("given", "Anna"), ("surname", "Smith")}),
    "cyrillic": ("Имя: Anna\nФамилия: Smith", {("given", "Anna"), ("surname", "Smith")}),
    "csv": ('id,last_name,first_name\n1,"Smith",Anna\n2,Ray,"Lee Ann"\n\n3,Smith,Anna', {("given", "Anna"), ("surname", "Smith"), ("given", "Lee Ann"), ("surname", "Ray")}),
    "bars": ("| Surname | First name |\n|---|:-:|\n| Smith | Anna |", {("given", "Anna"), ("surname", "Smith")}),
    "tabs": ("given\tsurname\r\nAnna\tSmith\r\n", {("given", "Anna"), ("surname", "Smith")}),
    "field rows": ("| Surname | Smith |\n| Age | 3 |\n| First name | **Anna** |", {("given", "Anna"), ("surname", "Smith")}),
    "insert": ("INSERT INTO t (id, `first_name`, last_name) VALUES (1, 'Anna', 'Smith'),\n (2, 'O,o', 'x')", {("given", "Anna"), ("surname", "Smith")}),
}
APART = {
    "blank line": "first_name: Anna\n\nlast_name: Smith",
    "other object": '[{"first_name":"Anna"},{"last_name":"Smith"}]',
    "other element": "<p><first>Anna</first></p><p><last>Smith</last></p>",
    "repeated role": "first_name: Anna\nfirst_name: Bob\nlast_name: Smith",
    "list items": "people:\n- first_name: Anna\n  x: 1\n- last_name: Smith",
    "long gap": "first_name: Anna " + "x " * 250 + "last_name: Smith",
    "one part": "first_name: Anna Smith",
    "two tables": "| Surname | Smith |\ntext\n| First name | Anna |",
    "rows": "surname,given\nSmith,Bob\nRay,Anna",
}


@pytest.fixture(scope="module")
def hits(spark):
    texts = {**{k: t for k, (t, _) in SHAPES.items()}, **APART}
    docs = spark.createDataFrame([*enumerate(texts.values()), (900, None), (901, ""), (902, "no such field")], ROWS)
    rows = R.known_in_records(R.parts_of(docs), spark.createDataFrame(KNOWN, "value string")).collect()
    named = dict(enumerate(texts.items()))
    out = {}
    for r in rows:
        name, text = named[r.doc_id]
        out.setdefault(name, set()).add((r.role, text[r.start : r.end]))
    return out


@pytest.mark.parametrize("name", list(SHAPES))
def test_shape(hits, name):
    assert hits.get(name) == SHAPES[name][1]


@pytest.mark.parametrize("name", list(APART))
def test_apart(hits, name):
    assert name not in hits


def test_objects_and_roles(spark):
    text = json.dumps({"a": [{"first_name": "Anna", "n": 1, "last_name": "Smıth"}, {"first_name": "Anna"}, {"last_name": "Smith"}], "givenName": "Boris", "family_name": "Petrov", "patronymic": "Ivanovich"}, ensure_ascii=False)
    docs = spark.createDataFrame([(1, text), (2, "{"), (3, None)], ROWS)
    got = R.known_in_records(R.json_parts(leaves(docs)), spark.createDataFrame(KNOWN, "value string")).collect()
    assert sorted((r.role, text[r.start : r.end]) for r in got) == [("given", "Boris"), ("patronymic", "Ivanovich"), ("surname", "Petrov")]
    names = spark.createDataFrame([(x,) for x in ("author_first_name", "user.lastName", "имя_клиента", "FNAME", "contact-surname", "name", "lasting", "middle", None)], "n string")
    assert [r[0] for r in names.select(R.role(names.n)).collect()] == ["given", "surname", "given", "given", "surname", None, None, "patronymic", None]
    assert R.parts_of(docs.where("false")).count() == 0
