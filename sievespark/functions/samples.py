"""Texts with identifiers in them, for rules whose values the given tables do not hold: SQL that both engines read.

A template is literal text with fields that are filled from digests of a row's id: {d3} three digits, {u2} upper and
{l2} lower case letters, {x4} hexadecimal digits, {c:ABC} one of the characters, {?text} text that half of the rows have, {n} a line break.
"""

from __future__ import annotations

import re


def sample(template: str, key: str) -> str:
    h = f"concat({', '.join(f'md5(concat(cast({key} as string), {chr(39)}{k}{chr(39)}))' for k in 'abcd')})"
    at, out = 2, []

    def take(n: int) -> str:
        nonlocal at
        at += n
        return f"substr({h}, {at - n}, {n})"

    for part in re.split(r"(\{[^}]*\})", template):
        if not part:
            continue
        kind = part[1:2]
        text = "'" + (part[2:-1] if part.startswith("{?") else part).replace("'", "''") + "'"
        if not part.startswith("{"):
            out.append(text)
        elif part == "{n}":
            out.append("chr(10)")
        elif kind == "?":
            out.append(f"case when substr({h}, 1, 1) < '8' then {text} else '' end")
        elif kind == "c":
            chars = part[3:-1]
            out.append(f"substr('{chars}', cast(1 + ascii({take(1)}) % {len(chars)} as int), 1)")
        else:
            got = take(int(part[2:-1]))
            out.append({"d": f"translate({got}, 'abcdef', '123456')", "l": f"translate({got}, '0123456789', 'ghijklmnop')",
                        "u": f"upper(translate({got}, '0123456789', 'ghijklmnop'))", "x": got}[kind])
    return f"concat({', '.join([*out, chr(39) * 2])})"


def with_sample(template: str, key: str = "doc_id", text: str = "text") -> str:
    """The whole text, a line break, the sample and a line break."""
    return f"concat(coalesce({text}, ''), chr(10), {sample(template, key)}, chr(10))"
