"""Row numbers over many tasks against a plain sort."""

import random

from pyspark.sql import functions as F

from sievespark.operators.ranks import row_numbers
from sievespark.operators.spans import beyond_baseline


def test_numbers_as_a_plain_sort(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(5)
    seen, want = {}, {}
    for i, g, v in sorted(rows, key=lambda x: (-x[2], x[0])):
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert {x.i: x.rn for x in row_numbers(df, ["g"], [F.desc("v"), "i"]).collect()} == want
    assert [x.i for x in row_numbers(df, [], ["v", "i"], "n").orderBy("n").collect()] == [i for i, _, _ in sorted(rows, key=lambda x: (x[2], x[0]))]
    assert row_numbers(df.where("false"), ["g"], ["i"]).count() == 0


def test_each_entry_of_a_baseline_takes_one(spark):
    found = spark.createDataFrame([(d, s, fp) for d in (1, 2) for s in (0, 5) for fp in ("x", "y")], "doc_id long, start long, fp string")
    known = spark.createDataFrame([("x", 3), ("z", 1)], "fp string, n long")
    assert sorted((r.doc_id, r.start, r.fp) for r in beyond_baseline(found, known).collect()) == [(1, 0, "y"), (1, 5, "y"), (2, 0, "y"), (2, 5, "x"), (2, 5, "y")]
