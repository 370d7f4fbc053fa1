"""Known secrets against many texts: few meet a text, pieces are found at any place, and a filter loses none."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from sievespark.operators import known as K


def spelled(secret):
    data = secret.encode()
    coded = base64.b64encode(data).decode().rstrip("=")
    every = {"plain": secret, "hex": data.hex(), "hex-upper": data.hex().upper(), "base64": coded, "base64url": coded.replace("+", "-").replace("/", "_")}
    return {t: min(k for k in every if every[k] == t) for t in every.values()}


def plain(texts, secrets):
    return sorted((d, s, k, x.count(t)) for d, x in texts.items() for s in secrets for t, k in spelled(s).items() if t in x)


@pytest.mark.parametrize("few", [0, 10_000])
def test_found_with_and_without_the_filter(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_TEXTS", few)
    r = random.Random(3)
    secrets = ["a", "é~", "пароль", "p@ss.word!", "sk_live_" + "k" * 30, "sk_live_" + "l" * 30, "\U0001f600?>\U0001f600?>\U0001f600", *[f"Customer#{i:09}" for i in range(300)]]
    texts = {i: "".join(r.choice(["-", "д", "x "]) for _ in range(i % 50)) + r.choice(list(spelled(r.choice(secrets)))) + r.choice(["", "1", "é"]) for i in range(200)}
    found = K.known_secrets(spark.createDataFrame([*texts.items(), (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([(s,) for s in [*secrets, "", None, "a"]], "secret string"))
    assert ("BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString()) == (few == 0)
    assert sorted(tuple(x) for x in found.collect()) == plain(texts, secrets)


def test_places_at_the_edges_of_parts(spark):
    secret = "Customer#000000007"
    texts = {i: "д" * n + secret + "д" * (1000 - n % 3) for i, n in enumerate([0, 237, 238, 255, 256, 257, 65_518, 65_519, 65_535, 65_536, 65_537, 131_060])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = K.known_secrets(docs, spark.createDataFrame([(secret,)], "secret string")).collect()
    assert sorted(x.doc_id for x in got) == list(texts) and all(x.n == 1 for x in got)


def test_a_piece_leads_to_few_secrets(spark):
    """Eight characters of hexadecimal digits are four digits of a name, which one in some thousands of names has."""
    each = spark.range(20_000).select(F.format_string("Customer#%09d", "id").alias("secret")).select("secret", F.explode(K.spellings(F.col("secret"))).alias("s")).select("secret", "s.*")
    sized = each.withColumn("k", F.coalesce(F.greatest(*[F.when(F.length("token") >= n, F.lit(n)) for n in K.PIECES]), F.length("token")))
    led = K.leading(sized)
    assert led.count() == 80_000 and led.groupBy("h").count().agg(F.max("count")).first()[0] == 1
