"""Dictionaries of known values and secrets against texts, as equi-joins on words and tokens: no table that grows is
broadcast, and no text is held against every entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running, sums

#: A word of a text.
WORD = r"[\p{L}\p{N}_]+"
INSIDE = r"[\p{L}\p{N}_]"


#: Words of the run that leads to the texts that hold a known value or word.
FIRST = 3


def run_hashes(words: str, lengths: list[int]) -> Column:
    """The distinct hashes of the runs of so many words in an array column of words; null without any."""
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: run_hash(F.lit(n), F.slice(words, i + 1, n))))
    return F.array_distinct(F.flatten(F.filter(F.array(*map(of, lengths)), lambda a: a.isNotNull())))


def run_hash(n: Column, words: Column) -> Column:
    return F.xxhash64(n, F.array_join(words, " "))


def known_values(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, value, start, end of each occurrence of a known value that letters, digits or _ don't touch.

    The hash of a value's first words, FIRST at most, leads to the texts that hold them in a row; the texts that contain the whole value are
    cut at it, and the pieces' lengths give the places. All words of a value are whole words of a text where nothing touches it, so no place is missed.
    Occurrences don't overlap. Null and wordless values find nothing. No table is broadcast, as both may be large."""
    words_of = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    entries = known.where("value IS NOT NULL").select("value").distinct().select("value", words_of(F.col("value")).alias("ws")).where(F.size("ws") > 0)
    leads = F.least(F.size("ws"), F.lit(FIRST))
    entries = entries.select("value", run_hash(leads, F.slice("ws", F.lit(1), leads)).alias("run"))
    words = docs.select(key, words_of(F.col("text")).alias("ws")).select(key, F.explode_outer(run_hashes("ws", list(range(1, FIRST + 1)))).alias("run"))
    values = words.join(entries.hint("merge"), "run").groupBy(key).agg(F.collect_set("value").alias("vs"))
    held = docs.join(values.hint("merge"), key).select(key, "text", F.explode("vs").alias("value")).where(F.contains("text", "value"))
    quoted = F.concat(F.lit(r"\Q"), F.col("value"), F.lit(r"\E"))
    pieces = held.select(key, "value", F.split("text", quoted, -1).alias("ps"))
    n = F.length("value")

    def placed(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: F.length(p).cast("long")))
        left = lambda i: F.when(F.get(ps, i) != "", F.right(F.get(ps, i), F.lit(1))).when(i > 0, F.right("value", F.lit(1))).otherwise("")
        right = lambda i: F.when(F.get(ps, i + 1) != "", F.left(F.get(ps, i + 1), F.lit(1))).when(i + 2 < F.size(ps), F.left("value", F.lit(1))).otherwise("")
        each = F.transform(F.slice(ends, F.lit(1), F.size(ps) - 1), lambda e, i: F.struct((e + i * n).cast("long").alias("start"), (~left(i).rlike(INSIDE) & ~right(i).rlike(INSIDE)).alias("free")))
        return F.filter(each, lambda x: x["free"])

    return pieces.select(key, "value", F.explode_outer(let(F.col("ps"), placed)).alias("p")).where("p IS NOT NULL").select(key, "value", "p.start", (F.col("p.start") + n).alias("end"))


#: A word without _, and what may stand between the words of a known value: blanks and the marks of tables, quotes and names, one line break at most.
PLAIN = r"[\p{L}\p{N}]+"
GAP = r"^(?:[^\p{L}\p{N}\n]{1,4}|[^\p{L}\p{N}\n]{0,3}\n[^\p{L}\p{N}\n]{0,4})\z"


#: Words of a run that leads to a known value; longer values are compared as a whole where such a run stands.
LEADING = 6
#: Entries that are broadcast; more are joined by sorting.
FEW = 10_000
#: Characters of the chunks that a text is cut into for places within it.
CHUNK = 512


def known_words(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, value, start, end and found (the text there) of each place where a known value's words stand in a row, in any case and
    with any gap of GAP between them, so also within identifiers and tables. Values without a word find nothing.

    Words are cut from the text as it is and lower-cased one by one, as a letter's lower case may be longer than the letter. Hashes of the runs
    of the first words of each value, LEADING at most, meet those of the texts' runs in an equi-join, and what meets is compared word by word; the text itself is shuffled
    only for texts with a hit, whose places follow from the lengths of the words and gaps before, added up once a text."""
    low = lambda t: F.transform(F.regexp_extract_all(t, F.lit(PLAIN), F.lit(0)), lambda w: F.lower(w))
    entries = known.where("value IS NOT NULL").select("value", low(F.col("value")).alias("ws")).distinct().where(F.size("ws") > 0)
    leads = F.least(F.size("ws"), F.lit(LEADING))
    entries = entries.select("value", F.size("ws").alias("n"), F.array_join("ws", " ").alias("all"), leads.alias("k"), F.array_join(F.slice("ws", F.lit(1), leads), " ").alias("run"))
    lengths = sorted(r[0] for r in entries.select("k").distinct().collect())  # LEADING numbers at most
    entries = entries.withColumn("h", F.xxhash64("k", "run"))
    worded = docs.select(key, low(F.col("text")).alias("ws"))
    runs_of = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.struct(i.alias("i"), F.xxhash64(F.lit(n), F.array_join(F.slice("ws", i + 1, n), " ")).alias("h"))))
    runs = worded.select(key, F.explode_outer(F.flatten(F.filter(F.array(*map(runs_of, lengths or [1])), lambda a: a.isNotNull()))).alias("r")).select(key, "r.i", "r.h")
    few = entries.select("h").limit(FEW + 1).count() <= FEW  # so what is broadcast is bounded
    met = runs.join(entries.select("h", "value", "n", "k", "run", "all").hint("broadcast" if few else "merge"), "h")
    hits = met.groupBy(key).agg(F.collect_list(F.struct("value", "i", "n", "k", "run", "all")).alias("hits"))
    pieces = docs.join(hits.hint("merge"), key).select(key, "hits", F.split("text", PLAIN, -1).alias("gs"), F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)).alias("words"))
    inner = lambda h: F.slice("gs", h["i"] + 2, h["n"] - 1)
    joined = lambda h, n: F.array_join(F.transform(F.slice("words", h["i"] + 1, n), lambda w: F.lower(w)), " ")
    whole = lambda h: (joined(h, h["k"]) == h["run"]) & ((h["n"] <= LEADING) | (joined(h, h["n"]) == h["all"]))
    near = F.filter("hits", lambda h: whole(h) & F.forall(inner(h), lambda g: g.rlike(GAP)))
    sizes = F.zip_with("gs", F.concat("words", F.array(F.lit(""))), lambda g, w: (F.length(g) + F.length(w)).cast("long"))  # of each gap and the word behind it
    text = lambda h: F.array_join(F.zip_with(F.slice("words", h["i"] + 1, h["n"]), F.concat(inner(h), F.array(F.lit(""))), lambda w, g: F.concat(w, g)), "")
    span = lambda h, first: F.struct(h["value"].alias("value"), (first(h["i"]) + F.length(F.get("gs", h["i"]))).alias("start"), first(h["i"] + h["n"]).alias("end"), text(h).alias("found"))
    found = sums(sizes, lambda first: F.transform(near, lambda h: span(h, first)))
    return pieces.select(key, F.explode_outer(found).alias("f")).where("f IS NOT NULL").select(key, "f.*")


def proper_case(hits: DataFrame) -> DataFrame:
    """Hits of known_words but for those in lower case of a value that is one capitalised word."""
    return hits.where(~(F.col("value").rlike(r"^\p{Lu}[\p{L}\p{N}]*$") & (F.col("found") == F.lower("found"))))


def extended(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits of known_words with `whole`: with up to three capitalised words in the 200 characters on either side, a blank between."""
    word = r"\p{Lu}\p{L}+"
    lists = hits.groupBy(key).agg(F.collect_list(F.struct(*[c for c in hits.columns if c != key])).alias("hs"))
    cut = docs.select(key, "text").join(lists.hint("merge"), key).select(key, "hs", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("cs"))

    def near(a: Column, b: Column) -> Column:
        """The text from a to b, from the chunks that hold it: a place is found without counting from the text's beginning."""
        i = F.floor(a / CHUNK).cast("int")
        held = F.array_join(F.slice("cs", i + 1, F.floor(b / CHUNK).cast("int") - i + 1), "")
        return F.substring(held, (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

    before = lambda h: F.regexp_extract(near(F.greatest(F.lit(0), h["start"] - 200), h["start"]), rf"(?:{word} ){{0,3}}\z", 0)
    after = lambda h: F.regexp_extract(near(h["end"], h["end"] + 200), rf"^(?: {word}){{0,3}}", 0)
    whole = F.transform("hs", lambda h: F.struct(h.alias("h"), F.concat(before(h), h["found"], after(h)).alias("whole")))
    return cut.select(key, F.explode(whole).alias("w")).select(key, "w.h.*", "w.whole").select(*hits.columns, "whole")


def name_forms(given: Column, surname: Column) -> Column:
    """The forms that a full name takes: both orders, with a comma, with an initial. None if a part is missing."""
    initial = F.concat(F.left(given, F.lit(1)), F.lit("."))
    forms = F.array(*[F.concat_ws(s, a, b) for s, a, b in ((" ", given, surname), (" ", surname, given), (", ", surname, given), (" ", initial, surname), (" ", surname, initial))])
    return F.when((given != "") & (surname != ""), forms)


def spellings(secret: Column) -> Column:
    """A secret as it is, in hexadecimal digits of either case, in base64 and in base64 for addresses, both without padding: a
    run that is padded holds the run that isn't. Spellings that are the same count as the first of their names."""
    every = F.array(*[F.struct(F.lit(k).alias("spelling"), v.alias("token")) for k, v in tokens(secret).items()])
    return let(every, lambda ss: F.filter(ss, lambda s: ~F.exists(ss, lambda o: (o["token"] == s["token"]) & (o["spelling"] < s["spelling"]))))


def tokens(secret: Column) -> dict[str, Column]:
    data = F.encode(secret, "utf-8")
    coded = F.rtrim(F.base64(data), F.lit("="))
    return {"plain": secret, "hex": F.lower(F.hex(data)), "hex-upper": F.hex(data), "base64": coded, "base64url": F.translate(coded, "+/", "-_")}


#: Characters of the pieces of secrets that lead to the texts that hold them.
PIECES = (8, 16, 32)
#: Bits of a piece's hash, and characters of the parts that a text is cut into for its pieces, then of their parts.
HASH, CUTS = 53, (1 << 16, 1 << 8)
#: Words of 64 bits in the filter of pieces, at most (32 MB), and in a row of it; texts that are not worth one.
WORDS, ROW, FEW_TEXTS = 1 << 22, 64, 10_000


def piece_hashes(text: Column, k: Column, cuts: tuple[int, ...] = CUTS) -> Column:
    """Hashes of the pieces of k characters that begin at each place of a text of k or more. A place is found from the beginning of a small part."""
    places = F.length(text) - k + 1
    if not cuts:
        return F.transform(F.sequence(F.lit(1), places), lambda i: F.xxhash64(k, F.substring(text, i, k)).bitwiseAND(F.lit((1 << HASH) - 1)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((places - 1) / cuts[0]).cast("int")), lambda i: F.substring(text, i * cuts[0] + 1, k + (cuts[0] - 1)))
    return F.flatten(F.transform(parts, lambda p: piece_hashes(p, k, cuts[1:])))


def may_be_among(pieces: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """The rows of pieces whose h is one of chosen's, and a few more: a Bloom filter of 16 bits for each of count, three of a word set for each,
    is broadcast. It has WORDS at most; beyond that more rows pass, and none is lost."""
    words = min(WORDS, 1 << max(ROW.bit_length(), (count // 4).bit_length()))
    word = F.col("h").bitwiseAND(F.lit(words - 1))
    bits = F.expr("shiftleft(1L, int(shiftright(h, 22) & 63)) | shiftleft(1L, int(shiftright(h, 28) & 63)) | shiftleft(1L, int(shiftright(h, 34) & 63))")
    empty = pieces.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = chosen.select(word.alias("word"), bits.alias("bits")).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = filled.groupBy(F.floor(F.col("word") / ROW).alias("row")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("ws")).select("row", F.col("ws.bits").alias("ws"))
    asked = pieces.select("*", F.floor(word / ROW).alias("row"), (word % ROW).cast("int").alias("at"), bits.alias("bits"))
    return asked.join(F.broadcast(rows), "row").where(F.get("ws", F.col("at")).bitwiseAND(F.col("bits")) == F.col("bits")).select(*pieces.columns)


def leading(spelled: DataFrame) -> DataFrame:
    """secret, spelling and h, the hash of the piece of k characters that fewest other spellings have. Of pieces that as many have it is the
    one of least hash, so that it is the same wherever it is computed."""
    each = spelled.select("secret", "spelling", F.explode(F.array_distinct(piece_hashes(F.col("token"), F.col("k")))).alias("h"))
    count = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    ranked = each.join(count.hint("merge"), "h").select("secret", "spelling", F.shiftleft(F.floor(F.log2("c") * 32).cast("long"), HASH).bitwiseOR(F.col("h")).alias("p"))
    return ranked.groupBy("secret", "spelling").agg(F.min("p").alias("p")).select("secret", "spelling", F.col("p").bitwiseAND(F.lit((1 << HASH) - 1)).alias("h"))


def known_secrets(docs: DataFrame, secrets: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, secret, spelling and n (occurrences that don't overlap) of each spelling of a known secret that a text holds, whatever
    stands beside it and whatever characters it is of. Null and empty secrets find nothing.

    Each spelling is led to by one of its pieces, of the most of PIECES characters that it has (all of it, if it is shorter), the one that
    fewest other spellings have, so secrets that begin alike don't meet all texts of each other; pieces as short for all spellings
    would be many secrets' where those have few characters, as digits in hexadecimal. Of the texts' pieces, one for each
    length of pieces there is, those that a filter of the secrets' pieces lets through meet these in an equi-join, and what meets is verified literally.
    No side is broadcast: each grows with its table, which the driver would hold. The filter is, but its size is bounded, and up to FEW_TEXTS texts do without."""
    size = F.length("token")
    k = F.coalesce(F.greatest(*[F.when(size >= n, F.lit(n)) for n in PIECES]), size)
    spelled = secrets.where("secret <> ''").select("secret").distinct().select("secret", F.explode(spellings(F.col("secret"))).alias("s")).select("secret", "s.*").withColumn("k", k)
    lengths = sorted(r[0] for r in spelled.select("k").distinct().collect())  # PIECES and what is shorter at most
    rare = leading(spelled)
    of_length = lambda k: F.when(F.length("text") >= k, piece_hashes(F.col("text"), F.lit(k))).otherwise(F.array().cast("array<bigint>"))
    pieces = docs.where("text IS NOT NULL").select(key, F.explode(F.array_distinct(F.flatten(F.array(*map(of_length, lengths or PIECES[:1]))))).alias("h"))
    if docs.limit(FEW_TEXTS + 1).count() > FEW_TEXTS:
        pieces = may_be_among(pieces, rare, secrets.count() * len(tokens(F.col("secret"))))
    met = pieces.join(rare.hint("merge"), "h").select(key, "secret", "spelling")
    token = F.coalesce(*[F.when(F.col("spelling") == k, v) for k, v in tokens(F.col("secret")).items()])
    found = met.join(docs.select(key, "text").hint("merge"), key).withColumn("token", token).where(F.contains("text", "token"))
    n = ((F.length("text") - F.length(F.replace("text", "token", F.lit("")))) / F.length("token")).cast("long")
    return found.groupBy(key, "secret", "spelling").agg(F.max(n).alias("n"))
