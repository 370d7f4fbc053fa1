"""Scalar functions as Column expressions: checksums, entropy, masks, keyed digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def digits(s: Column) -> Column:
    return F.transform(chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits over code points; 0 for the empty string."""
    n = F.length(s).cast("double")
    share = lambda c: F.size(F.filter(chars(s), lambda d: d == c)) / n
    return F.coalesce(F.aggregate(F.transform(F.array_distinct(chars(s)), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def luhn(s: Column) -> Column:
    """13 to 19 digits, not all equal, with a valid Luhn sum."""
    d = F.regexp_replace(s, "[^0-9]", "")
    return F.length(d).between(13, 19) & (F.size(F.array_distinct(chars(d))) > 1) & F.call_function("luhn_check", d)


def short_luhn(s: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(s, "[^0-9]", ""))


def weighted(s: Column, weights: list[int]) -> Column:
    """Sum of digits times weights."""
    return F.aggregate(F.zip_with(digits(s), F.array(*map(F.lit, weights)), lambda d, w: F.coalesce(d * w, F.lit(0))), F.lit(0), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """Remainder of an IBAN (letters as 10 to 35, the first four characters moved behind) by 97."""
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(chars(turned), value), F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97).cast("int"))


def card_network(s: Column) -> Column:
    d = F.regexp_replace(s, "[^0-9]", "")
    two, four = F.substring(d, 1, 2).cast("int"), F.substring(d, 1, 4).cast("int")
    return (
        F.when(F.substring(d, 1, 1) == "4", "visa")
        .when(two.between(51, 55) | four.between(2221, 2720), "mastercard")
        .when(two.isin(34, 37), "amex")
        .when((four == 6011) | (two == 65), "discover")
        .when(four.between(3528, 3589), "jcb")
        .otherwise("unknown")
    )


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string under a key known to the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def likelihood(confidence: Column) -> Column:
    """The five buckets of a confidence."""
    return F.when(confidence >= 0.9, "VERY_LIKELY").when(confidence >= 0.7, "LIKELY").when(confidence >= 0.4, "POSSIBLE").when(confidence >= 0.2, "UNLIKELY").otherwise("VERY_UNLIKELY")


def hive_mask(s: Column) -> Column:
    """First and last three characters around an ellipsis if there are more than twelve, else all redacted."""
    return F.when(F.length(s) > 12, F.concat(F.left(s, F.lit(3)), F.lit("…"), F.right(s, F.lit(3)))).otherwise("[REDACTED]")


def mask(s: Column, start: int, end: int, char: str = "*", least: int = 5) -> Column:
    """Keep the first `start` and last `end` characters; too short a value is redacted whole."""
    n = F.length(s)
    inner = F.repeat(F.lit(char), n - start - end)
    return F.when((n < least) | (n <= start + end), "[REDACTED]").otherwise(F.concat(F.substring(s, 1, start), inner, F.right(s, F.lit(end)) if end else F.lit("")))


def identity_mask(s: Column) -> Column:
    return F.when(F.length(s) < 5, "[REDACTED]").otherwise(F.concat(F.left(s, F.lit(2)), F.lit("***"), F.right(s, F.lit(2))))


def bucket(n: Column, size: int) -> Column:
    low = (F.floor(n / size) * size).cast("long")
    return F.concat(low.cast("string"), F.lit("–"), (low + size - 1).cast("string"))


def mrz_check(s: Column) -> Column:
    """Check digit of a field of a machine readable zone: weights 7, 3 and 1 in turn; letters are 10 to 35, < is 0."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).when(c == "<", 0).otherwise(F.ascii(c) - 55)
    weight = lambda i: F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
    return (F.aggregate(F.transform(chars(s), lambda c, i: value(c) * weight(i)), F.lit(0), lambda a, x: (a + x).cast("int")) % 10).cast("int")


def number_of(digest: Column, n: int) -> Column:
    """A number below n from a hexadecimal digest."""
    return F.conv(F.left(digest, F.lit(7)), 16, 10).cast("long") % n


def fake_email(key: bytes, value: Column) -> Column:
    return F.concat(F.lit("user-"), F.left(hmac_sha256(key, F.concat(F.lit("EMAIL|"), value)), F.lit(12)), F.lit("@example.com"))


def fake_phone(key: bytes, value: Column) -> Column:
    """A North American number, its last seven digits from the range that is kept for fiction: 555-0100 to 555-0199."""
    n = number_of(hmac_sha256(key, F.concat(F.lit("PHONE|"), value)), 100)
    return F.regexp_replace(value, r"[0-9]{3}([-. ]?)[0-9]{4}$", F.concat(F.lit("555$101"), F.lpad(n.cast("string"), 2, "0")))


def fake_date(key: bytes, day: Column) -> Column:
    """The day moved back by 1 to 365 days, as many for all days under a key."""
    return F.date_sub(day, (number_of(hmac_sha256(key, F.lit("date")), 365) + 1).cast("int"))


def fake_iban(key: bytes, value: Column) -> Column:
    """An IBAN with other digits of the account and right check digits."""
    turned = F.array_join(F.transform(chars(F.substring(value, 5, 64)), lambda c, i: F.when(c.rlike("[0-9]"), (number_of(hmac_sha256(key, F.concat(F.lit("IBAN|"), value, F.lit("|"), i.cast("string"))), 10)).cast("string")).otherwise(c)), "")
    check = lambda t: F.lit(98) - mod97(F.concat(F.left(value, F.lit(2)), F.lit("00"), t))
    return let(turned, lambda t: F.concat(F.left(value, F.lit(2)), F.lpad(check(t).cast("string"), 2, "0"), t))
