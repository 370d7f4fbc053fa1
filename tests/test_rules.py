"""Rules against literal texts: where a value is, and what is no value."""

import re

import pytest

from sievespark.functions.formats import IBAN
from sievespark.functions.national import IDENTIFIERS, near
from sievespark.functions.rules import DEFAULT, PROVIDERS, provider_rule, provider_tokens
from sievespark.operators.detect import detect
from sievespark.operators.national import detect_national

BODY = "Zq81Xw27Vy36Ut45Sr54Qp63On72Ml81Kj90"
TOKENS = {
    "github": ["github_pat_11AB_" + BODY, "gho_" + BODY, "ghs_" + BODY, "ghr_" + BODY[:16]], "gitlab": ["glpat-" + BODY + "-", "gldt-" + BODY, "glffct-" + BODY],
    "gitlab-runner": ["GR1348941" + BODY], "openai": ["sk-" + BODY, "sk-svcacct-" + BODY], "anthropic": ["sk-ant-" + BODY, "sk-ant-api03-" + BODY],
    "aws": ["AKIA" + "B2" * 8, "ASIA" + "C3" * 8, "A3TX" + "D4" * 8], "google": ["AIza" + "b" * 35, "GOCSPX-" + BODY, "ya29." + BODY], "slack": ["xoxp-1-" + BODY, "xapp-" + BODY],
    "stripe": ["rk_live_" + BODY, "sk_test_" + BODY, "whsec_" + BODY], "sendgrid": [f"SG.{BODY}.{BODY}"], "twilio": ["SK" + "0f" * 16], "npm": ["npm_" + BODY], "pypi": ["pypi-" + BODY],
    "digitalocean": ["dopat_v1_" + "1e" * 32], "vault": ["hvb." + BODY], "grafana": ["glc_" + BODY], "notion": ["secret_" + BODY], "shopify": ["shpss_" + "2d" * 16], "square": ["sq0csp-" + BODY],
    "firebase": ["AAAA1234567:APA91b" + BODY], "yandex": ["AQVN" + "x" * 36, "YCAJE" + "y" * 20, "t1.ab==." + "z" * 86], "vercel": ["vercel_" + BODY], "huggingface": ["hf_" + BODY], "linear": ["lin_api_" + BODY], "databricks": ["dapi" + "3c" * 16],
}


def test_tokens_whole_between_brackets(spark):
    rows = [(i, f"é({t})", name, t) for i, (name, t) in enumerate((n, t) for n, ts in TOKENS.items() for t in ts)]
    assert set(TOKENS) == set(PROVIDERS)
    df = spark.createDataFrame(rows, "doc_id long, text string, name string, token string")
    found = {(r.doc_id, r.rule, r.start, r.end, r.value) for r in detect(df, [provider_rule(n) for n in PROVIDERS]).collect()}
    assert found >= {(i, name, 2, 2 + len(t), t) for i, _, name, t in rows}


@pytest.mark.parametrize("name", sorted(PROVIDERS))
def test_least_tokens(name):
    pattern = re.compile(provider_rule(name).pattern)
    for t in provider_tokens(name):
        assert pattern.fullmatch(t) and not pattern.fullmatch(t[:-1])


def one(spark, text, rules=DEFAULT):
    return [(r.rule, r.start, r.value) for r in detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules).collect()]


def test_spaced_cards_handles_and_addresses(spark):
    assert one(spark, "pay 4111 1111 1111 1111 now") == [("luhn", 4, "4111 1111 1111 1111")]
    assert one(spark, "4111-1111-1111-1112") == [] and one(spark, "0000 0000 0000 0000") == []
    assert one(spark, "@someone_1\n@other_22") == [("messenger-handle", 0, "@someone_1"), ("messenger-handle", 11, "@other_22")]
    assert one(spark, "an jürgen@müller.de") == [("email", 3, "jürgen@müller.de")]


def test_padded_tokens_and_phones_beside_numbers(spark):
    token = "t1.abc==." + "a" * 86
    rules = [provider_rule("yandex")]
    assert [one(spark, t, rules) for t in (f"k={token}== end", f"{token}=", f"({token})", f"{token}===", f"x{token}")] == [[("yandex", 2, token + "==")], [("yandex", 0, token + "=")], [("yandex", 1, token)], [], []]
    phones = [r for r in DEFAULT if r.id == "international-phone"]
    assert [v for _, _, v in one(spark, "+1 (212) 555-0100 12, +49 30 1234567; +442071838750 and +1-212-555-0100", phones)] == ["+1 (212) 555-0100", "+49 30 1234567", "+442071838750", "+1-212-555-0100"]


def test_labels_beside_other_letters(spark):
    def score(text, kind):
        found = detect_national(spark.createDataFrame([(1, text)], "doc_id long, text string"), [i for i in IDENTIFIERS if i.type == kind]).collect()
        return [r.confidence for r in found]

    assert score("dociónie X1234567L", "ES_NIE") == score("ciónNIE X1234567L", "ES_NIE") == [0.99]  # ó is no ASCII letter, so a label begins behind it
    assert score("xNIE X1234567L", "ES_NIE") == [0.99] and score("x X-1234567-A", "ES_NIE") == [0.4] and score("NIE X-1234567-A", "ES_NIE") == [0.9]
    assert score("timestamp: 1700000000", "SA_NATIONAL_ID") == [] and score("paid 1234567897", "SA_NATIONAL_ID") == []
    pattern = near("P. IVA", "NIE", "ключ")
    assert re.search(pattern, "anNIE") is None and all(re.search(pattern, t) for t in ("ónie ", "(NIE)", "p.  iva 1", "xКЛЮЧx"))


@pytest.mark.parametrize(("value", "veto"), [("0946684800", True), ("1700000000", True), ("4102444799", True), ("4102444800", False), ("9512345678", False), ("1700000000000", True), ("9512345678000", False)])
def test_epochs(value, veto):
    import duckdb

    from sievespark.operators.national import EPOCH

    assert duckdb.sql(f"SELECT {EPOCH} FROM (SELECT '{value}' AS value)").fetchall() == [(veto,)]


def test_checks_on_days_and_repeats():
    import duckdb

    check = {i.type: i.check for i in IDENTIFIERS}
    ok = lambda kind, v: duckdb.sql(f"SELECT {check[kind]} FROM (SELECT '{v}' AS value)").fetchall()[0][0]
    assert ok("PL_PESEL", "44051401359") and ok("PL_PESEL", "02270803624") and not ok("PL_PESEL", "44053501359")
    assert ok("SE_PERSONNUMMER", "811228-9874") and not ok("SE_PERSONNUMMER", "811328-9873") and ok("ZA_ID_NUMBER", "8001015009087") and not ok("ZA_ID_NUMBER", "8013015009083")
    assert not ok("UK_NHS", "0000000000") and not ok("CA_SIN", "000-000-000") and {"BI27", "MN20", "RU33", "SV28"} <= set(IBAN.split())
