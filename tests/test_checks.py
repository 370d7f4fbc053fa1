"""Check digits against published valid numbers, and each with its last character changed."""

import duckdb
import pytest

from sievespark.functions.national import IDENTIFIERS
from sievespark.operators.national import detect_national

VALID = {
    "UK_NHS": "943 476 5919", "PL_PESEL": "44051401359", "AU_TFN": "123 456 782", "CA_SIN": "046-454-286", "RU_SNILS": "112-233-445 95",
    "RU_INN": "7707083893", "ABA_ROUTING_NUMBER": "021000021", "ES_NIE": "X1234567L", "AU_ABN": "51 824 753 556", "AU_ACN": "004 085 616",
    "IN_AADHAAR": "2341 2341 2346", "IN_GSTIN": "27AAPFU0939F1ZV", "FI_PERSONAL_IDENTITY_CODE": "131052-308T", "IMEI": "490154203237518",
    "VIN": "1M8GDM9AXKP042788", "DE_TAX_ID": "86095742719", "SG_NRIC_FIN": "S1234567D", "IT_FISCAL_CODE": "RSSMRA85T10A562S", "TRACKING_NUMBER": "1Z999AA10123456784",
    "EU_VAT_NUMBER": "DE136695976", "SE_PERSONNUMMER": "811228-9874", "ZA_ID_NUMBER": "8001015009087",
}


@pytest.mark.parametrize("name", sorted(VALID))
def test_published_number(name):
    rule = next(i for i in IDENTIFIERS if i.type == name)
    good = VALID[name]
    changed = good[:-1] + next(c for c in ("0123456789" if good[-1].isdigit() else "ABCDEFGHIJ") if c != good[-1])
    ok = lambda v: duckdb.sql(f"SELECT {rule.check} FROM (SELECT '{v}' AS value)").fetchall()[0][0]
    assert ok(good) and not ok(changed)


def test_scores_and_vetoes(spark):
    texts = [(1, "NHS 943 476 5919"), (2, "943 476 5919"), (3, "NHS 943 476 5918"), (4, "943 476 5918"), (5, "size: 9434765919"), (6, "x9434765919"), (7, None), (8, "")]
    rule = next(i for i in IDENTIFIERS if i.type == "UK_NHS")
    got = {r.doc_id: r.confidence for r in detect_national(spark.createDataFrame(texts, "doc_id long, text string"), [rule]).collect()}
    assert got == {1: 0.99, 2: 0.35, 3: 0.9}
