"""Views of texts through layers of decoding, with one composed map of places from the view back to the text.

A layer gives edits of the text it gets: what stands in [start, end) is read as something else, or as nothing. Its map is a list
of segments in the order of the view: `at` is where a segment begins in the view, `src` where it comes from, and `stop` the
end of the source that every character of it stands for, or -1 if it is copied character by character. The map of a
later layer is composed with that of the earlier ones by merging both lists of segments, so it always leads to
the original text, however deep its escapes are nested. Places are found in it by binary search.

Null and empty texts, and texts that no layer changes, have no view. Offsets are code points. A text is one row of one task.
"""

from __future__ import annotations

import html.entities
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged

Edit = tuple[int, int, str]


class Places(NamedTuple):
    """Segments of a view; the last entry of `at` is the view's length."""

    at: list[int]
    src: list[int]
    stop: list[int]

    def start(self, place: int) -> int:
        i = bisect_right(self.at, place) - 1
        return self.src[i] if self.stop[i] >= 0 else self.src[i] + place - self.at[i]

    def end(self, place: int) -> int:
        """Where the source of what ends at `place` ends."""
        i = bisect_right(self.at, place - 1) - 1
        return self.stop[i] if self.stop[i] >= 0 else self.src[i] + place - self.at[i]

    def copied(self, start: int, end: int) -> bool:
        """Whether [start, end) stands in the source as it is."""
        i = bisect_right(self.at, start) - 1
        return self.stop[i] < 0 and self.at[i + 1] >= end


def applied(text: str, edits: list[Edit]) -> tuple[str, Places]:
    out, at, src, stop, n, last = [], [], [], [], 0, 0

    def put(piece: str, start: int, end: int) -> None:
        nonlocal n
        if piece:
            out.append(piece)
            at.append(n)
            src.append(start)
            stop.append(end)
            n += len(piece)

    for start, end, new in edits:
        put(text[last:start], last, -1)
        put(new, start, end)
        last = end
    put(text[last:], last, -1)
    return "".join(out), Places([*at, n], src, stop)


def composed(first: Places, then: Places) -> Places:
    """The map of `then`, whose source is the view of `first`, with first's source as its own."""
    at, src, stop = [], [], []
    for k, place in enumerate(then.at[:-1]):
        s = then.src[k]
        if then.stop[k] >= 0:
            at.append(place)
            src.append(first.start(s))
            stop.append(first.end(then.stop[k]))
            continue
        end = s + then.at[k + 1] - place
        i = bisect_right(first.at, s) - 1
        while i < len(first.src) and first.at[i] < end:
            low = max(first.at[i], s)
            at.append(place + low - s)
            src.append(first.src[i] if first.stop[i] >= 0 else first.src[i] + low - first.at[i])
            stop.append(first.stop[i])
            i += 1
    return Places([*at, then.at[-1]], src, stop)


# Characters that show nothing; accents that a Cyrillic letter may carry; letters of the two scripts that look alike;
# elements that stand inside a line of text.
HIDDEN = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff"
ACCENTS = "\u0300\u0301\u0302\u0304\u030b\u030f\u0311"
LATIN, CYRILLIC = "aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ"
INLINE = "a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr"


def characters(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(first byte, end, character) of each UTF-8 character in data; bytes that are none are left out."""
    i = 0
    while i < len(data):
        for n in range(1, 5):
            try:
                yield i, i + n, data[i : i + n].decode()
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            i += 1


def coded(mark: str) -> Callable[[str], Iterator[Edit]]:
    """Runs of bytes in hexadecimal digits behind a mark; each character stands for the escapes of its bytes."""
    wide = len(mark) + 2
    run = re.compile(rf"(?:{re.escape(mark)}[0-9A-Fa-f]{{2}})+")

    def edits(text: str) -> Iterator[Edit]:
        for m in run.finditer(text):
            for i, j, c in characters(bytes.fromhex(m[0].replace(mark, ""))):
                yield m.start() + i * wide, m.start() + j * wide, c

    return edits


def replaced(pattern: str, new: Callable[[re.Match], str | None]) -> Callable[[str], Iterator[Edit]]:
    """What the pattern finds becomes `new`, as one unit; None leaves it."""
    found = re.compile(pattern)

    def edits(text: str) -> Iterator[Edit]:
        for m in found.finditer(text):
            value = new(m)
            if value is not None and value != m[0]:
                yield m.start(), m.end(), value

    return edits


def point(digits: str, base: int = 16) -> str | None:
    code = int(digits, base)
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def reference(m: re.Match) -> str | None:
    name = m[1]
    if name[0] == "#":
        return point(name[2:]) if name[1] in "xX" else point(name[1:], 10)
    return html.entities.html5.get(name + ";")


def units(text: str) -> Iterator[Edit]:
    r"""\uXXXX; two that are the halves of one character are one unit."""
    half = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})")
    for m in half.finditer(text):
        value = bytes.fromhex(m[1] + m[2]).decode("utf-16-be") if m[1] else point(m[3])
        if value is not None:
            yield m.start(), m.end(), value


def plain_form(m: re.Match) -> str:
    value = unicodedata.normalize("NFKC", m[0])
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)


def without_accents(m: re.Match) -> str:
    return unicodedata.normalize("NFC", re.sub(f"[{ACCENTS}]", "", unicodedata.normalize("NFD", m[0])))


def one_script(text: str) -> Iterator[Edit]:
    """Letters of the script that a word has fewer letters of, where the other has one that looks the same."""
    for m in re.finditer(r"\p{L}+", text):
        latin, cyrillic = len(re.findall(r"\p{Script=Latin}", m[0])), len(re.findall(r"\p{Script=Cyrillic}", m[0]))
        if latin and cyrillic and latin != cyrillic:
            swap = dict(zip(LATIN, CYRILLIC) if cyrillic > latin else zip(CYRILLIC, LATIN))
            yield from ((m.start() + i, m.start() + i + 1, swap[c]) for i, c in enumerate(m[0]) if c in swap)


def spelled(run: str, one: str) -> Callable[[str], Iterator[Edit]]:
    """Runs of four units or more; each character stands for the whole run, as part of one is no run any more."""
    return replaced(run, lambda m: "".join(point(x) or "" for x in re.findall(one, m[0])))


LAYERS: dict[str, Callable[[str], Iterator[Edit]]] = {
    "terminal": replaced(r"\x1b\[[0-?]*[ -/]*[@-~]", lambda m: ""),
    "hidden": replaced(f"[{HIDDEN}]+", lambda m: ""),
    "nul": replaced(r"(?<!\S)[^\0\s](?:\0[^\0\s]){3,}\0?(?!\S)", lambda m: m[0].replace("\0", "")),
    "points": spelled(r"U\+[0-9A-Fa-f]{4,6}(?: U\+[0-9A-Fa-f]{4,6}){3,}", r"U\+([0-9A-Fa-f]+)"),
    "css": spelled(r"(?:\\[0-9A-Fa-f]{1,6} ){3,}\\[0-9A-Fa-f]{1,6}", r"\\([0-9A-Fa-f]+)"),
    "units": units,
    "braced": replaced(r"\\[ux]\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|%u([0-9A-Fa-f]{4})", lambda m: point(m[1] or m[2] or m[3])),
    "bytes": coded("\\x"),
    "percent": coded("%"),
    "entity": replaced(r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", reference),
    "control": replaced(r"\\([ntr\\])", lambda m: {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}[m[1]]),
    "plus": replaced(r"(?<=\p{L})\+(?=\p{L})", lambda m: " "),
    "tags": replaced(r"</?([A-Za-z][A-Za-z0-9]*)(?:[\s/][^<>]*)?>", lambda m: "" if m[1].lower() in INLINE.split() else "\n"),
    "forms": replaced(r"[\x00-\x7f]?\p{M}+|[^\x00-\x7f…\p{M}]\p{M}*", plain_form),
    "accents": replaced(r"\p{Script=Cyrillic}\p{M}+", without_accents),
    "scripts": one_script,
}
# What a text holds that a layer can change; each is quicker to look for than the layer's own pattern, and none is missed.
MIXED = re.compile(r"\p{Script=Latin}[^\P{L}\p{Script=Latin}\p{Script=Cyrillic}]*\p{Script=Cyrillic}|\p{Script=Cyrillic}[^\P{L}\p{Script=Latin}\p{Script=Cyrillic}]*\p{Script=Latin}")
LINE = re.compile(r"\n?[^\n]+|\n")  # a break belongs to the line behind it, whose first mark may stand on it
DECIMAL = re.compile(r"[^\P{Nd}0-9]")


def unformed(text: str) -> bool:
    """Parts of a text in NFKC are in it too, so such a text has nothing to change but digits; … stays in any case."""
    return not text.isascii() and (not unicodedata.is_normalized("NFKC", text.replace("…", ".")) or bool(DECIMAL.search(text)))


MARKS = {"terminal": "\x1b", "nul": "\0", "points": "U+", "css": "\\", "units": "\\u", "bytes": "\\x", "percent": "%", "entity": "&", "control": "\\", "plus": "+", "tags": "<"}
CHANGED: dict[str, Callable[[str], bool]] = {
    **{name: lambda text, mark=mark: mark in text for name, mark in MARKS.items()},
    "braced": lambda text: "\\" in text or "%u" in text,
    "hidden": lambda text: not text.isascii(),
    "accents": lambda text: not text.isascii(),
    "forms": unformed,
    "scripts": lambda text: not text.isascii() and bool(MIXED.search(text)),
}
#: Layers whose matches cross no end of a line, so that each line can be looked at by itself.
BY_LINE = ("forms", "scripts")


def edits_of(name: str, text: str) -> list[Edit]:
    """A layer's edits of a text. Its pattern runs only where it can find something."""
    if not CHANGED[name](text):
        return []
    if name not in BY_LINE:
        return list(LAYERS[name](text))
    edits, at = [], 0
    for line in LINE.findall(text):
        if CHANGED[name](line):
            edits += [(at + start, at + end, new) for start, end, new in LAYERS[name](line)]
        at += len(line)
    return edits


#: For rules, and for known values.
GENERAL = ["terminal", "hidden", "nul", "points", "css", "units", "braced", "bytes", "percent", "entity", "tags", "hidden", "forms"]
KNOWN = ["percent", "entity", "percent", "units", "control", "plus", "hidden", "accents", "scripts", "forms"]
#: A text that none of the layers can change.
UNCHANGED = r"^[\x01-\x1a\x1c-\x24\x26-\x2a\x2c-\x3b\x3d-\x54\x56-\x5b\x5d-\x7f]*$"


def view_of(text: str, layers: list[str]) -> tuple[str, Places] | None:
    places = None
    for name in layers:
        edits = edits_of(name, text)
        if edits:
            text, then = applied(text, edits)
            places = composed(places, then) if places else then
    return (text, places) if places and text else None


def projected(docs: DataFrame, layers: list[str] = GENERAL, key: str = "doc_id") -> DataFrame:
    """key, text (the view), at, src and stop of each text that the layers, one after the other, change. A written table, as
    what is found in views and its places both read it: no view is made twice."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(i, v) for i, t in enumerate(b.column(1).to_pylist()) if (v := view_of(t, layers))]
            kept = b.column(0).take(pa.array([i for i, _ in made], pa.int64()))
            arrays = [pa.array([getattr(p, c) for _, (_, p) in made], pa.list_(pa.int32())) for c in Places._fields]
            yield pa.RecordBatch.from_arrays([kept, pa.array([t for _, (t, _) in made], pa.string()), *arrays], [key, "text", *Places._fields])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return staged(docs.where(F.col("text").isNotNull() & ~F.col("text").rlike(UNCHANGED)).select(key, "text").mapInArrow(make, f"{key} {kind}, text string, at array<int>, src array<int>, stop array<int>"))


def placed(findings: DataFrame, views: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings in the text of views with start and end in the original text; only those that it doesn't hold as they are.

    A text's findings meet its map once, and no text is shuffled for it."""
    rest = [c for c in findings.columns if c not in (key, "start", "end")]
    lists = findings.groupBy(key).agg(F.collect_list(F.struct("start", "end", *rest)).alias("found")).join(views.select(key, *Places._fields).hint("merge"), key)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [Places(*x) for x in zip(*(b.column(2 + i).to_pylist() for i in range(3)))]
            moved = [[p.copied(f["start"], f["end"]) and (-1, -1) or (p.start(f["start"]), p.end(f["end"])) for f in found] for p, found in zip(maps, b.column(1).to_pylist())]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"start": s, "end": e} for s, e in m] for m in moved], kind)], [key, "found", "moved"])

    kinds = {f.name: f.dataType.simpleString() for f in lists.schema}
    made = lists.select(key, "found", *Places._fields).mapInArrow(back, f"{key} {kinds[key]}, found {kinds['found']}, moved array<struct<start:long,end:long>>")
    each = made.select(key, F.explode(F.arrays_zip("found", "moved")).alias("z")).where("z.moved.start >= 0")
    return each.select(key, F.col("z.moved.start").alias("start"), F.col("z.moved.end").alias("end"), *[F.col(f"z.found.{c}").alias(c) for c in rest]).select(*findings.columns)


def everywhere(docs: DataFrame, find: Callable[[DataFrame], DataFrame], layers: list[str] = GENERAL, key: str = "doc_id") -> DataFrame:
    """What find(docs) finds in the texts as they are, and in their views, at its places in the texts; once each."""
    views = projected(docs, layers, key)
    found = find(docs)
    return found.unionByName(placed(find(views.select(key, "text")), views, key)).dropDuplicates([c for c in (key, "start", "end", "type", "rule", "value") if c in found.columns])
