"""Check digits of identifiers, as SQL over a string expression that Spark and DuckDB read alike."""

from __future__ import annotations

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(v: str = "value") -> str:
    return f"translate({v}, ' -./+', '')"


def at(v: str, i: int) -> str:
    """The i-th character, from one, as a number."""
    return f"cast(substr({v}, {i}, 1) as int)"


def number(v: str, i: int, n: int) -> str:
    return f"cast(substr({v}, {i}, {n}) as bigint)"


def both(*tests: str) -> str:
    """All tests in order; a later one is not evaluated where an earlier one fails."""
    out = tests[-1]
    for t in reversed(tests[:-1]):
        out = f"case when {t} then {out} else false end"
    return out


def varied(d: str) -> str:
    """Not one character over and over."""
    return f"translate({d}, substr({d}, 1, 1), '') <> ''"


def day(d: str, year: str = "'20'", months: str = "0", days: str = "0") -> str:
    """The first six digits are a day of the calendar, as yymmdd, once what is added to months and days is taken off."""
    two = lambda i, off: f"lpad(cast({number(d, i, 2)} - ({off}) as string), 2, '0')"
    return f"try_cast(concat({year}, substr({d}, 1, 2), '-', {two(3, months)}, '-', {two(5, days)}) as date) is not null"


def dotted(v: str, weights: list[int], first: int = 1) -> str:
    return "(" + " + ".join(f"{at(v, first + i)} * {w}" for i, w in enumerate(weights) if w) + ")"


def weighted(weights: list[int], modulus: int) -> str:
    """As many digits as weights, whose weighted sum is divisible by the modulus."""
    d = digits()
    return both(f"length({d}) = {len(weights)}", varied(d), f"{dotted(d, weights)} % {modulus} = 0")


def check_digit(weights: list[int], expression: str, v: str | None = None) -> str:
    """The digit behind the weighted ones equals an expression of their sum, written {s}."""
    d = v or digits()
    return both(f"length({d}) > {len(weights)}", f"{at(d, len(weights) + 1)} = {expression.format(s=dotted(d, weights))}")


def luhn(n: int, v: str | None = None) -> str:
    d = v or digits()
    double = lambda i: f"({at(d, i)} * 2 - case when {at(d, i)} > 4 then 9 else 0 end)"
    total = " + ".join(double(i) if (n - i) % 2 else at(d, i) for i in range(1, n + 1))
    return both(f"length({d}) = {n}", varied(d), f"({total}) % 10 = 0")


def product_check(n: int, v: str | None = None) -> str:
    """ISO 7064 MOD 11,10 over n digits, the last of which checks."""
    d, p = v or digits(), "10"
    for i in range(1, n):
        p = f"((({at(d, i)} + {p} + 9) % 10 + 1) * 2 % 11)"
    return both(f"length({d}) = {n}", f"{at(d, n)} = (11 - {p}) % 10")


def verhoeff(n: int) -> str:
    """Products in the dihedral group of ten elements, with the permutation's powers by position from the right."""

    def times(j: int, k: int) -> int:
        if j < 5:
            return (j + k) % 5 if k < 5 else 5 + (j + k - 5) % 5
        return 5 + (j - 5 - k) % 5 if k < 5 else (j - k) % 5

    table = "".join(str(times(j, k)) for j in range(10) for k in range(10))
    step, power, powers = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], list(range(10)), []
    for _ in range(8):
        powers.append("".join(map(str, power)))
        power = [step[x] for x in power]
    d, c = digits(), "0"
    for i in range(n):
        moved = f"cast(substr('{powers[i % 8]}', {at(d, n - i)} + 1, 1) as int)"
        c = f"cast(substr('{table}', {c} * 10 + {moved} + 1, 1) as int)"
    return both(f"length({d}) = {n}", varied(d), f"{c} = 0")


def letter(alphabet: str, remainder: str, where: str) -> str:
    return f"substr('{alphabet}', cast({remainder} as int) + 1, 1) = {where}"


def index(alphabet: str, v: str, i: int) -> str:
    return f"(instr('{alphabet}', substr({v}, {i}, 1)) - 1)"


def snils() -> str:
    d = digits()
    return both(f"length({d}) = 11", varied(d), f"{number(d, 10, 2)} = {dotted(d, list(range(9, 0, -1)))} % 101 % 100")


def inn() -> str:
    d, w = digits(), [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
    ends = lambda weights: f"{at(d, len(weights) + 1)} = {dotted(d, weights)} % 11 % 10"
    return f"case when not ({varied(d)}) then false when length({d}) = 10 then {ends(w[2:])} when length({d}) = 12 then {ends(w[1:])} and {ends(w)} else false end"


def aba() -> str:
    two = number(digits(), 1, 2)
    return both(weighted([3, 7, 1] * 3, 10), f"({two} <= 12 or {two} between 21 and 32 or {two} between 61 and 72 or {two} = 80)")


def abn() -> str:
    d = digits()
    return both(f"length({d}) = 11", varied(d), f"({dotted(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0")


def pesel() -> str:
    """The month also says the century: 80 is added for the 1800s, 20, 40 and 60 for those from 2000 on."""
    d = digits()
    century = f"cast(floor({number(d, 3, 2)} / 20) as int)"
    year = f"substr('1920212218', cast({century} * 2 + 1 as int), 2)"
    return both(weighted([1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1], 10), day(d, year, f"{century} * 20"))


def personnummer() -> str:
    """Coordination numbers have 60 added to the day."""
    d = f"right({digits()}, 10)"
    return both(luhn(10, d), day(d, days=f"case when {number(d, 5, 2)} > 60 then 60 else 0 end"))


def nric() -> str:
    # The published order of check letters, of S and T, of F and G, and of M.
    kinds = [("ST", "JZIHGFEDCBA", 0, 4), ("FG", "XWUTRQPNMLK", 0, 4), ("M", "KLJNPQRTUWX", 3, 3)]
    s, case = dotted("value", [2, 7, 6, 5, 4, 3, 2], 2), ""
    for first, letters, early, late in kinds:
        rest = f"(({s} + case when substr(value, 1, 1) in ('T', 'G') then {late} else {early} end) % 11)"
        place = f"10 - {rest}" if first == "M" else rest
        case += f"when instr('{first}', substr(value, 1, 1)) > 0 then {letter(letters, place, 'substr(value, 9, 1)')} "
    return f"case {case} else false end"


def fiscal_code() -> str:
    # The odd places' weights of 0 to 9 and A to Z, two digits each.
    odd = "01 00 05 07 09 13 15 17 19 21 01 00 05 07 09 13 15 17 19 21 02 04 18 20 11 03 06 08 12 14 16 10 22 25 24 23"
    parts = []
    for i in range(1, 16):
        k = index(ALNUM, "value", i)
        parts.append(f"cast(substr('{odd}', {k} * 3 + 1, 2) as int)" if i % 2 else f"case when {k} < 10 then {k} else {k} - 10 end")
    return both("length(value) = 16", letter(ALNUM[10:], f"(({' + '.join(parts)}) % 26)", "substr(value, 16, 1)"))


def gstin() -> str:
    parts = []
    for i in range(1, 15):
        q = f"{index(ALNUM, 'value', i)} * {2 - i % 2}"
        parts.append(f"(case when {q} > 35 then 1 else 0 end + ({q}) % 36)")
    return letter(ALNUM, f"((36 - ({' + '.join(parts)}) % 36) % 36)", "substr(value, 15, 1)")


def finnish() -> str:
    return both(f"{number('value', 1, 2)} between 1 and 31 and {number('value', 3, 2)} between 1 and 12",
                letter("0123456789ABCDEFHJKLMNPRSTUVWXY", "(cast(concat(substr(value, 1, 6), substr(value, 8, 3)) as bigint) % 31)", "substr(value, 11, 1)"))


def spanish(v: str = "value") -> str:
    n = f"cast(concat(translate(substr(translate({v}, '-', ''), 1, 1), 'XYZ', '012'), substr(translate({v}, '-', ''), 2, 7)) as bigint)"
    return letter("TRWAGMYFPDXBNJZSQVHLCKE", f"({n} % 23)", f"substr(translate({v}, '-', ''), 9, 1)")


def dea() -> str:
    return f"({dotted('value', [1, 2, 1, 2, 1, 2], 3)}) % 10 = {at('value', 9)}"


def vin() -> str:
    v = "translate(value, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')"
    s = dotted(v, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])
    return both("length(value) = 17", f"substr('0123456789X', cast({s} % 11 as int) + 1, 1) = substr(value, 9, 1)")


def ups() -> str:
    parts = []
    for i in range(3, 18):
        k = index(ALNUM, "value", i)
        parts.append(f"(case when {k} > 9 then {k} - 8 else {k} end) % 10 * {1 if i % 2 else 2}")
    return both("substr(value, 1, 2) = '1Z' and length(value) = 18", f"(10 - ({' + '.join(parts)}) % 10) % 10 = {at('value', 18)}")


def cpf() -> str:
    d = digits()
    first, second = dotted(d, list(range(10, 1, -1))), dotted(d, list(range(11, 1, -1)))
    return both(f"length({d}) = 11", f"{at(d, 10)} = {first} * 10 % 11 % 10 and {at(d, 11)} = {second} * 10 % 11 % 10")
