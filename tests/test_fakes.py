"""Names given to values: each its own, none that is there."""

from sievespark.operators import fakes
from sievespark.operators.detect import detect
from sievespark.functions.rules import DEFAULT


def test_each_value_its_own_name(spark):
    n = 200_000
    values = spark.range(n).selectExpr("concat('v', id) AS value")
    made = fakes.assigned(values.union(values.limit(10)), spark.createDataFrame([("x",), (None,)], "value string"), "k")
    assert made.count() == n == made.select("fake").distinct().count() == made.select("value").distinct().count()
    some = spark.createDataFrame([(f"v{i}",) for i in range(300)], "value string")
    first = {r.value: r.fake for r in fakes.assigned(some, some, "k").collect()}
    assert first == {r.value: r.fake for r in fakes.assigned(some, some, "k").collect()} != {r.value: r.fake for r in fakes.assigned(some, some, "other").collect()}
    taken = spark.createDataFrame([(f.upper(),) for f in list(first.values())[:150]], "value string")
    again = {r.value: r.fake for r in fakes.assigned(some, taken, "k").collect()}
    assert not {f.upper() for f in again.values()} & {f.upper() for f in list(first.values())[:150]} and len(set(again.values())) == 300
    assert fakes.assigned(some.where("false"), some).count() == 0


def test_names_in_texts(spark):
    docs = spark.createDataFrame([(1, "saw Dr. Anna Stone and Dr. Bob Ray; Dr. Anna Stone left"), (2, "Dr. Anna Stone"), (3, None), (4, "none")], "doc_id long, text string")
    found = detect(docs, [r for r in DEFAULT if r.id == "honorific-name"])
    out = {r.doc_id: (r.text, r.redactions) for r in fakes.with_fakes(docs, found).collect()}
    name = out[2][0]
    other = out[1][0].split(" and ")[1].split(";")[0]
    assert out[1] == (f"saw {name} and {other}; {name} left", 3) and out[3] == (None, 0) and out[4] == ("none", 0)
    assert name != other and name.isalpha() and name.lower() not in "saw dr anna stone and bob ray left none".split()
