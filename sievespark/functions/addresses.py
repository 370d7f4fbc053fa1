"""Check sums of wallet addresses and of tokens, as folds over their characters that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .scalar import chars

# The alphabets, and the numbers of the checksum's polynomial.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
POLYMOD = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]
BECH32_ENDS, BECH32M_ENDS = 1, 0x2BC830A3
#: Bits of a limb; LIMBS of them hold the 200 bits of an address.
LIMB, LIMBS = 24, 9


def place(c: Column, alphabet: str) -> Column:
    """The number of a character in the alphabet, from 0; -1 if it isn't there."""
    return (F.instr(F.lit(alphabet), c) - 1).cast("long")


def base58_hex(value: Column) -> Column:
    """The 25 bytes that a base58 text stands for, in hexadecimal digits; null if it has other characters or more bytes."""

    def step(limbs: Column, digit: Column) -> Column:
        start = F.struct(digit.alias("carry"), F.array().cast("array<long>").alias("out"))
        turned = F.aggregate(limbs, start, lambda a, x: F.struct(F.shiftright(x * 58 + a["carry"], LIMB).alias("carry"), F.concat(a["out"], F.array((x * 58 + a["carry"]).bitwiseAND(F.lit(2**LIMB - 1)))).alias("out")))
        return turned["out"]

    digits = F.transform(chars(value), lambda c: place(c, BASE58))
    whole = let(digits, lambda ds: F.when(~F.exists(ds, lambda d: d < 0), F.aggregate(ds, F.array_repeat(F.lit(0).cast("long"), LIMBS), step)))
    text = F.array_join(F.transform(F.reverse(whole), lambda x: F.lpad(F.lower(F.hex(x)), LIMB // 4, "0")), "")
    spare = LIMB // 4 * LIMBS - 50
    return let(text, lambda t: F.when(F.left(t, F.lit(spare)) == "0" * spare, F.right(t, F.lit(50))))


def base58check(value: Column) -> Column:
    """Whether a text is a base58 address: 25 bytes, the last four of which begin the double SHA-256 of the others, and as many leading
    1 as leading zero bytes."""

    def checked(h: Column) -> Column:
        payload = F.unhex(F.left(h, F.lit(42)))
        digest = F.sha2(F.unhex(F.sha2(payload, 256)), 256)
        zeros = F.length(F.regexp_extract(h, "^(?:00)*", 0)) / 2
        return (F.right(h, F.lit(8)) == F.left(digest, F.lit(8))) & (zeros == F.length(F.regexp_extract(value, "^1*", 0)))

    return F.when(F.length(value).between(25, 36), F.coalesce(let(base58_hex(value), checked), F.lit(False))).otherwise(False)


def polymod(values: Column) -> Column:
    def step(c: Column, v: Column) -> Column:
        moved = F.shiftleft(c.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(v)
        return reduce(lambda made, i: made.bitwiseXOR(F.when(F.shiftright(c, 25 + i).bitwiseAND(F.lit(1)) == 1, F.lit(POLYMOD[i])).otherwise(0).cast("long")), range(5), moved)

    return F.aggregate(values, F.lit(1).cast("long"), step)


def bech32(value: Column, prefix: str = "bc") -> Column:
    """Whether a text is a segwit address of the prefix: one case, known characters, the check sum of its version (bech32 for 0,
    bech32m above it) and a program of a length that the version takes."""
    low = F.lower(value)
    one_case = (value == low) | (value == F.upper(value))
    data = F.transform(chars(F.substring(low, F.lit(len(prefix) + 2), F.length(value))), lambda c: place(c, BECH32))
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]

    def checked(d: Column) -> Column:
        version = F.get(d, F.lit(0))
        ends = polymod(F.concat(F.array(*[F.lit(x).cast("long") for x in head]), d))
        bits = (F.size(d) - 7) * 5
        size = F.floor(bits / 8)
        last = F.get(d, F.size(d) - 7)
        padded = F.when(bits % 8 == 0, True).otherwise((bits % 8 < 5) & (last % F.get(F.array(*[F.lit(2**i) for i in range(8)]), bits % 8) == 0))
        fits = F.when(version == 0, size.isin(20, 32)).otherwise(version.between(1, 16) & size.between(2, 40))
        return ~F.exists(d, lambda x: x < 0) & (ends == F.when(version == 0, BECH32_ENDS).otherwise(BECH32M_ENDS)) & fits & padded

    usable = one_case & low.startswith(prefix + "1") & F.length(value).between(len(prefix) + 8, 90)
    return F.when(usable, F.coalesce(let(data, checked), F.lit(False))).otherwise(False)


def token_checksum(value: Column) -> Column:
    """Whether the last six characters of a token are the CRC-32 of the 30 before them, in base 62; null for other forms."""
    form = r"^(?:gh[opsur]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})$"
    crc = F.crc32(F.encode(F.regexp_extract(value, form, 1), "utf-8"))
    coded = F.concat(*[F.substring(F.lit(BASE62), (F.floor(crc / 62**i) % 62 + 1).cast("int"), F.lit(1)) for i in range(5, -1, -1)])
    return F.when(value.rlike(form), coded == F.regexp_extract(value, form, 2))
