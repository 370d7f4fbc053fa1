"""Types of merged spans against a plain fold in every order, and three outcomes of an overlap against plain loops."""

import random
from itertools import permutations

from sievespark.operators import preference as P

FOUND = "doc_id long, start long, end long, category string, type string, rule string, value string"
KINDS = ["JSON_VALUE", "ENCODED_SENSITIVE", "PHONE", "PASSPORT_MRZ", "PERSONAL_ATTRIBUTE", "PERSON", "ID", "FR_PASSPORT", "PASSPORT_NUMBER", "TAX_ID", "MASKED", "EMAIL"]


def plain(a, b, identities, transformed):
    if a == "JSON_VALUE" or b == "JSON_VALUE":
        return a != "JSON_VALUE"
    if a == "ENCODED_SENSITIVE":
        return False
    if b == "PHONE" and a != "PASSPORT_MRZ" or b == "ENCODED_SENSITIVE":
        return True
    if a in transformed:
        return False
    if b in transformed or b == "PASSPORT_MRZ":
        return True
    names = {"PERSON", "PROPER_NAME", "LOCATION", "ORGANIZATION", "EDUCATION"}
    if "PERSONAL_ATTRIBUTE" in (a, b) and {a, b} & names:
        return b == "PERSONAL_ATTRIBUTE"
    broad = lambda t: t in ("ID", "PASSPORT") or "PASSPORT" in t and t not in ("PASSPORT_MRZ", "PASSPORT_NUMBER")
    return broad(a) and b in identities and not broad(b)


def test_fold_in_every_order(spark):
    r = random.Random(6)
    sets = [*permutations(KINDS, 2), *(tuple(r.choices(KINDS, k=r.randint(3, 6))) for _ in range(300))]
    rows, want = [], {}
    for i, kinds in enumerate(sets):
        rows += [(i, k, 100 - k % 3, "personal", t, f"r{k}", "") for k, t in enumerate(kinds)]
        kind = kinds[0]
        for t in kinds[1:]:
            kind = t if plain(kind, t, {"TAX_ID", "PASSPORT_NUMBER"}, {"MASKED"}) else kind
        want[i] = (0, 100, kind, len(kinds))
    got = P.typed_union(spark.createDataFrame(rows, FOUND).repartition(4), identities=["TAX_ID", "PASSPORT_NUMBER"], transformed=["MASKED"]).collect()
    assert {x.doc_id: (x.start, x.end, x.type, x.n_findings) for x in got} == want
    apart = spark.createDataFrame([(1, 0, 5, "personal", "A", "r", ""), (1, 5, 9, "credential", "B", "r", ""), (1, 8, 12, "personal", "PHONE", "s", "")], FOUND)
    assert sorted((x.start, x.end, x.category, x.type) for x in P.typed_union(apart).collect()) == [(0, 5, "personal", "A"), (5, 12, "credential", "PHONE")]
    assert P.typed_union(apart.where("false")).count() == 0


def test_three_outcomes(spark):
    r = random.Random(7)
    make = lambda n, kinds, rule, sizes: [(d, s, s + r.choice(sizes), "personal", r.choice(kinds), f"{rule}{k}", r.choice(["x", "a\nb"])) for d in range(9) for k, s in enumerate(r.sample(range(300), n))]
    docs, prose = make(12, ["EMAIL", "PERSON", "ADDRESS", "OTHER"], "d", [10, 60, 200]), make(15, ["PROPER_NAME"], "p", [2, 5, 20])
    want, covered = set(), set()
    for d in docs:
        hits = [p for p in prose if p[0] == d[0] and p[1] < d[2] and d[1] < p[2]]
        if d[4] == "EMAIL" or not hits:
            want.add(d[:3] + d[4:6])
        elif d[4] in P.TYPED and d[2] - d[1] <= 160 and "\n" not in d[6] and all(d[1] <= p[1] and p[2] <= d[2] for p in hits):
            want.add(d[:3] + d[4:6])
            covered |= {p[:3] for p in hits}
    want |= {p[:3] + p[4:6] for p in prose if p[:3] not in covered}
    got = P.beside_prose(spark.createDataFrame(docs, FOUND), spark.createDataFrame(prose, FOUND)).collect()
    assert {(x.doc_id, x.start, x.end, x.type, x.rule) for x in got} == want and covered
