"""Files with their reasons, and dictionaries against texts."""

from pyspark.sql import functions as F

from sievespark.operators import known as K
from sievespark.operators import policies as O
from sievespark.operators.detect import detect
from sievespark.operators.placeholders import placeholders, restore
from sievespark.sources.files import read_texts


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("né".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe" + "né".encode("utf-16-le"))
    (tmp_path / "bad.txt").write_bytes(b"one\ntwo\xff")
    (tmp_path / "bin").write_bytes(b"a\0b")
    (tmp_path / "long").write_bytes(b"x" * 100)
    (tmp_path / "empty").write_bytes(b"")  # no row
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c").write_bytes(b"c")
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text, r.error, r.offset, r.record) for r in read_texts(spark, str(tmp_path), 50).collect()}
    assert got == {
        "a.txt": ("utf-8", "né", None, None, None),
        "b.txt": ("utf-16-le", "né", None, None, None),
        "bad.txt": ("utf-8", None, "ERR_ENCODING", 7, 2),
        "bin": ("utf-8", None, "ERR_BINARY", None, None),
        "long": (None, None, "ERR_TOO_LARGE", None, None),
    }


def test_known_values(spark):
    docs = spark.createDataFrame([(1, "Ann Lee, Ann Lee and Annie; xAnn Lee"), (2, ""), (3, None), (4, "Ann LeeAnn Lee"), (5, "a.b (a.b) aXb")], "doc_id long, text string")
    known = spark.createDataFrame([("Ann Lee",), ("Ann Lee",), ("a.b",), ("",), (None,), ("...",)], "value string")
    got = sorted(tuple(r) for r in K.known_values(docs, known).collect())
    assert got == [(1, "Ann Lee", 0, 7), (1, "Ann Lee", 9, 16), (5, "a.b", 0, 3), (5, "a.b", 5, 8)]
    assert K.known_values(docs.limit(0), known).count() == 0 == K.known_values(docs, known.limit(0)).count()


def test_known_secrets(spark):
    docs = spark.createDataFrame([(1, "key=s3cret-value aGVsbG8"), (2, "x 7333637265742d76616c7565 czNjcmV0LXZhbHVl"), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in K.known_secrets(docs, spark.createDataFrame([("s3cret-value",)], "secret string")).collect())
    assert got == [(1, "s3cret-value", "plain", 1), (2, "s3cret-value", "base64", 1), (2, "s3cret-value", "hex", 1)]


def test_secrets_of_any_characters(spark):
    docs = spark.createDataFrame([(1, "a p@ss.word! short1 yyxSECRET_1z short1"), (2, "cEBzcy53b3JkIQ== 7040737321 70407373 2e776f7264"), (3, None), (4, ""), (5, "AB 7040" + "p@ss.word!".encode().hex().upper())], "doc_id long, text string")
    secrets = spark.createDataFrame([("p@ss.word!",), ("short1",), ("xSECRET_1",), ("",), (None,)] + [(f"Customer#{i:09}",) for i in range(50)], "secret string")
    got = sorted(tuple(r) for r in K.known_secrets(docs, secrets).collect())
    assert got == [(1, "p@ss.word!", "plain", 1), (1, "short1", "plain", 2), (1, "xSECRET_1", "plain", 1), (2, "p@ss.word!", "base64", 1), (5, "p@ss.word!", "hex-upper", 1)]
    assert K.known_secrets(docs, secrets.where("false")).count() == 0 == K.known_secrets(docs.where("false"), secrets).count()


def test_words_behind_letters_that_grow(spark):
    """The lower case of İ is two characters: places are those of the text as it is."""
    docs = spark.createDataFrame([(1, "İx met Anna Smith today"), (2, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    known = spark.createDataFrame([("Anna Smith",), ("İX",), ("Two three four five six seven eight nine",), ("two three four five six seven eight ten",)], "value string")
    assert sorted((r.doc_id, r.start, r.end, r.found) for r in K.known_words(docs, known).collect()) == [(1, 0, 2, "İx"), (1, 7, 17, "Anna Smith"), (2, 4, 44, "two three four five six seven eight nine")]


def test_tokens_in_a_text_are_reserved(spark):
    texts = ["see [[Email-1]] then write to bob@example.org", "[[Email-7]] a@b.org c@d.org [[Person-9]]", "no", None, "[[Email-99999999999]] a@b.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = placeholders(docs, detect(docs))
    assert {r.doc_id: r.text for r in made.collect()} == {0: "see [[Email-1]] then write to [[Email-2]]", 1: "[[Email-7]] [[Email-8]] [[Email-9]] [[Person-9]]", 2: "no", 3: None, 4: "[[Email-99999999999]] [[Email-1]]"}
    assert {r.doc_id: r.text for r in restore(made).collect()} == dict(enumerate(texts))
    turned = spark.createDataFrame([(1, "[[A-1]] [[B-1]]", [("[[A-1]]", "[[B-1]]"), ("[[B-1]]", "x")])], "doc_id long, text string, entries array<struct<token:string,value:string>>")
    assert restore(turned).first().text == "[[B-1]] x"


def test_suppressed_lines(spark):
    text = "a SECRET\nb SECRET # NOSONAR\n# pragma: allowlist nextline\nc SECRET\nd SECRET"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = [i for i in range(len(text)) if text.startswith("SECRET", i)]
    found = spark.createDataFrame([(1, i) for i in at], "doc_id long, start long")
    assert sorted(r.start for r in O.not_suppressed(found, docs).collect()) == [at[0], at[3]]


def test_templates_and_context(spark):
    values = ["${PASSWORD}", "<token>", "****", "{{ key }}", "real<value>", "xyz"]
    found = spark.createDataFrame([("credential", v) for v in values] + [("personal", "****")], "category string, value string")
    assert sorted((r.category, r.value) for r in O.without_templates(found).collect()) == [("credential", "real<value>"), ("credential", "xyz"), ("personal", "****")]
    near = spark.createDataFrame([("my Order ", "", 0.3), ("", "", 0.3), ("order", "", 0.9), ("order", "", 0.01)], "before string, after string, s double")
    assert [round(r[0], 6) for r in near.select(O.boosted(F.col("s"), "order")).collect()] == [0.65, 0.3, 1.0, 0.4]


def test_growing_tables_are_not_broadcast(spark):
    docs = spark.createDataFrame([(1, "auth: p@ss.word! Anna Smith of Ann Lee")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    secrets = K.known_secrets(docs, spark.createDataFrame([("p@ss.word!",)], "secret string"))
    values = K.known_values(docs, spark.createDataFrame([("Ann Lee",)], "value string"))
    assert "BroadcastExchange" not in plan(secrets) and "BroadcastExchange" not in plan(values)
    assert [(r.secret, r.n) for r in secrets.collect()] == [("p@ss.word!", 1)] and [(r.start, r.end) for r in values.collect()] == [(31, 38)]


def test_many_hits_in_a_long_text(spark):
    """Places and surroundings of each of many hits, behind letters of several bytes."""
    text = "Ян Anna Smith met, " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hits = K.known_words(docs, spark.createDataFrame([("anna smith",), ("met",)], "value string"))
    got = K.extended(hits, docs).collect()
    assert len(got) == 6000 and all(text[r.start : r.end] == r.found for r in got)
    assert {(r.found, r.whole) for r in got} == {("Anna Smith", "Ян Anna Smith"), ("met", "Ян Anna Smith met")}
