"""Known names whose parts stand in separate fields of one record.

Fields come from five shapes: pairs of a key and a value (also elements of XML), tables with a row of names of columns, tables with a field
a row, INSERT statements, and strings of JSON objects. Each gives parts: a record, a role, a value and its place. Pairs are events of a
text in order, cut into records where a blank line, the end of the object around them, a new list item, a long gap or a role that
the record has already comes between. Parts of a record meet by role, their orders meet the known names in one equi-join,
and a hit gives each part that it covers at its own place.

Only texts that name such a field at all are cut into lines, each shape is an array of parts of its text. Null texts have no parts; keys of documents are unique.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, placed_hits, running

# Names of fields, without marks and in lower case, that hold a part of a name; whole, as an end, or as a beginning.
WHOLE = {
    "given": "first given fname forename forenames firstname firstnames givenname givennames имя",
    "surname": "last family lname surname surnames lastname familyname фамилия",
    "patronymic": "middle mname patronymic patronym middlename middlenames отчество",
}
ENDS = {"given": "firstnames?|givennames?|forenames?|имя", "surname": "lastname|familyname|surnames?|фамилия", "patronymic": "middlenames?|patronymic|patronym|отчество"}
BEGINS = {"given": "имя", "surname": "фамилия", "patronymic": "отчество"}
#: What a text that has such a field holds.
HINT = "(?iu)first|last|given|family|surname|forename|middle|patronym|[flm]name|имя|фамили|отчеств"
#: The same words in lower case.
HINTS = "first last given family surname forename middle patronym fname lname mname имя фамили отчеств".split()
ROLES = list(WHOLE)
#: Longest part of a name and longest gap between two fields of a record.
LONGEST, GAP = 200, 400

PAIR = r"""(?u)(?<![\p{L}\p{N}_$])(["'`]?)([\p{L}_$](?:[\p{L}\p{N}_$.-]| (?=[\p{L}\p{N}])){0,63})\1\*{0,3}[ \t]*(?::=|=>|:|=)[ \t]*(?:"((?:[^"\\]|\\.){0,200})"|'((?:[^'\\]|\\.){0,200})'|([^\s,;&|{}\[\]<>"'#][^,;&|{}\[\]<>"'#]{0,199}))"""
ELEMENT = r"<([\p{L}_][\p{L}\p{N}_.:-]{0,63})(?:\s[^<>]{0,200})?>([^<>]{1,200})</\1>"
ITEM = r"^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]"
INSERT = r"(?i)\(([^()\r\n]{1,1000})\)\s*VALUES\s*((?:\([^()]{0,4000}\)\s*,?\s*){1,1000})"
PART = "struct<rec:string,role:string,value:string,start:long,end:long>"
DELIMITERS = ["|", "\t", ";", ","]
#: Lines in a row of which none is blank, and of which each has a bar.
_blank = r"(?! *\r{0,2}(?![^\n]))"
BLOCK = rf"(?<![^\n]){_blank}[^\n]+(?:\n{_blank}[^\n]+)*+"
BARRED = r"(?<![^\n])[^\n|]*\|[^\n]*(?:\n[^\n|]*\|[^\n]*)*+"


def role(name: Column) -> Column:
    """The part of a name that a field of this name holds; null if none."""
    plain = F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""))
    known = F.lit(None).cast("string")
    for tests in (BEGINS, ENDS, WHOLE):  # the last one that holds decides
        for r in reversed(ROLES):
            words = {"B": f"^(?:{tests[r]})", "E": f"(?:{tests[r]})$"}["B" if tests is BEGINS else "E"] if tests is not WHOLE else f"^(?:{tests[r].replace(' ', '|')})$"
            known = F.when(plain.rlike(words), r).otherwise(known)
    return F.when(F.length(plain) <= 64, known)


def _part(rec: Column, kind: Column, raw: Column, at: Column, marks: str = r"[\s*_`]") -> Column:
    """A part without the marks around its value."""
    lead = F.length(F.regexp_extract(raw, f"^{marks}*", 0))
    value = F.regexp_replace(raw, f"^{marks}+|{marks}+$", "")
    return F.struct(rec.cast("string").alias("rec"), kind.alias("role"), value.alias("value"), (at + lead).cast("long").alias("start"), (at + lead + F.length(value)).cast("long").alias("end"))


def named(text: Column) -> Column:
    """text.rlike(HINT), by searches for words: a pattern that ignores case tries all its words at each character."""
    unlike = text.rlike("[ıİſᲀ-ᲅ]") & text.rlike(HINT)  # letters that the pattern takes for others and lower() doesn't
    return let(F.lower(text), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in HINTS])) | unlike


def placed_lines(text: Column) -> Column:
    """at (where it starts) and line of each line of a text."""
    placed = lambda x, e: F.struct((e - F.length(x) - 1).alias("at"), F.regexp_replace(x, "\r$", "").alias("line"))
    return let(F.split(text, "\n", -1), lambda ls: F.zip_with(ls, running(F.transform(ls, lambda x: (F.length(x) + 1).cast("long"))), placed))


def runs_of_lines(text: Column, pattern: str, also: Callable[[Column], Column]) -> Column:
    """start and ls (at, from the start, and line) of each run of lines that a pattern finds and that may have a field of a name."""
    runs = F.filter(placed_hits(text, pattern), lambda h: also(h["value"]) & named(h["value"]))
    return F.transform(runs, lambda h: F.struct(h["start"].alias("start"), F.transform(placed_lines(h["value"]), lambda l: F.struct((h["start"] + l["at"]).alias("at"), l["line"].alias("line"))).alias("ls")))


def pair_parts(text: Column) -> Column:
    """Parts of pairs and elements."""
    group = lambda h, pattern, n: F.regexp_extract(h["value"], pattern, n)

    def paired(h: Column) -> Column:
        quoted = [group(h, PAIR, 3), group(h, PAIR, 4)]
        raw = F.when(quoted[0] != "", quoted[0]).when(quoted[1] != "", quoted[1]).otherwise(group(h, PAIR, 5))
        start = h["start"] + F.length(h["value"]) - F.length(raw) - F.when(h["value"].rlike("[\"']$") & (group(h, PAIR, 5) == ""), 1).otherwise(0)
        return F.struct(h["start"].alias("pos"), role(group(h, PAIR, 2)).alias("role"), raw.alias("raw"), start.alias("at"))

    def element(h: Column) -> Column:
        name, raw = group(h, ELEMENT, 1), group(h, ELEMENT, 2)
        return F.struct(h["start"].alias("pos"), role(name).alias("role"), raw.alias("raw"), (h["start"] + F.length(h["value"]) - F.length(name) - 3 - F.length(raw)).alias("at"))

    def event(line: Column, f: Column) -> Column:
        before = F.substring(line["line"], F.lit(1), f["pos"].cast("int"))
        item = before.rlike(ITEM) & before.rlike(r"^[ \t]*\S+[ \t]+[*_]{0,3}$")
        return let(_part(F.lit(""), f["role"], f["raw"], line["at"] + f["at"]), lambda p: F.struct(*[p[c].alias(c) for c in ("start", "end", "role", "value")], item.alias("item")))

    def events(line: Column) -> Column:
        found = F.concat(F.transform(placed_hits(line["line"], PAIR), paired), F.transform(placed_hits(line["line"], ELEMENT), element))
        return F.transform(F.filter(found, lambda f: f["role"].isNotNull()), lambda f: event(line, f))

    def cut(es: Column) -> Column:
        previous = lambda i: F.get(es, i - 1)
        gap = lambda e, i: F.substring(text, (previous(i)["end"] + 1).cast("int"), (e["start"] - previous(i)["end"]).cast("int"))
        return F.transform(es, lambda e, i: F.struct(e.alias("e"), F.when(i > 0, let(gap(e, i), lambda g: apart(g, previous(i)["item"] & e["item"]))).otherwise(False).alias("cut")))

    each = F.flatten(F.transform(F.filter(placed_lines(text), lambda l: named(l["line"])), events))
    return let(F.array_sort(F.filter(each, lambda e: e["end"] > e["start"])), lambda es: in_records(numbered(cut(es)), F.lit("pair")))


def in_records(parts: Column, name: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(F.concat_ws(" ", name, p["rec"].cast("string")).alias("rec"), *[p[c].alias(c) for c in ("role", "value", "start", "end")]))


def apart(gap: Column, items: Column) -> Column:
    """Whether what stands between two fields ends a record."""
    depth = F.aggregate(F.regexp_extract_all(gap, F.lit(r"[{}\[\]]"), F.lit(0)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("least")), lambda a, c: _step(a, F.when(c.isin("{", "["), 1).otherwise(-1)))
    tags = F.aggregate(F.regexp_extract_all(gap, F.lit(r"</?[\p{L}_][^<>]*>"), F.lit(0)), F.struct(F.lit(1).alias("n"), F.lit(1).alias("least")), lambda a, t: _step(a, F.when(t.endswith("/>"), 0).when(t.startswith("</"), -1).otherwise(1)))
    inner = F.split(gap, "\n", -1)
    between = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    listed = F.when(items, F.exists(between, lambda x: ~x.rlike(ITEM))).otherwise(gap.rlike(r"\n[ \t]*-[ \t]"))
    return (F.length(gap) > GAP) | gap.rlike(r"\n[ \t]*\r?\n") | listed | (depth["least"] < 0) | (tags["least"] < 0)


def _step(a: Column, by: Column) -> Column:
    return F.struct((a["n"] + by).alias("n"), F.least(a["least"], a["n"] + by).alias("least"))


def numbered(events: Column) -> Column:
    """Parts with the number of their record, of events (e, cut) in order: a cut or a role that is there already begins another."""
    start = F.struct(F.lit(0).alias("rec"), F.lit("").alias("seen"), F.array().cast(f"array<{PART.replace('rec:string', 'rec:int')}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        e, new = x["e"], x["cut"] | F.contains(a["seen"], F.concat(F.lit(" "), x["e"]["role"]))
        rec = a["rec"] + new.cast("int")
        seen = F.concat(F.when(new, "").otherwise(a["seen"]), F.lit(" "), e["role"])
        return F.struct(rec.alias("rec"), seen.alias("seen"), F.concat(a["out"], F.array(F.struct(rec.alias("rec"), e["role"].alias("role"), e["value"].alias("value"), e["start"].alias("start"), e["end"].alias("end")))).alias("out"))

    return F.aggregate(events, start, step, lambda a: a["out"])


def cells(line: Column, mark: str, quote: str = '"') -> Column:
    """start and value of each cell of a line, blanks and a pair of quotes around it left out; a mark within quotes cuts nothing."""
    m = "\\" + mark if mark == "|" else mark
    found = placed_hits(F.concat(F.lit(mark), line), f"{m}(?:{quote}[^{quote}]*{quote}?|[^{quote}{m}])*")

    def bare(h: Column) -> Column:
        raw = F.substring(h["value"], F.lit(2), F.length(h["value"]))
        lead = F.length(F.regexp_extract(raw, r"^\s*", 0))
        value = F.regexp_replace(raw, r"^\s+|\s+$", "")
        quoted = value.rlike("(?s)^([\"'`]).*\\1$") & (F.length(value) > 1) if quote == '"' else value.rlike("(?s)^'.*'$") & (F.length(value) > 1)
        return F.struct((h["start"] + lead + quoted.cast("int")).alias("start"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    return F.transform(found, bare)


def by_mark(line: Column, mark: Column) -> Column:
    return reduce(lambda made, d: F.when(mark == d, cells(line, d)).otherwise(made), DELIMITERS, F.lit(None).cast("array<struct<start:long,value:string>>"))


def table_parts(text: Column) -> Column:
    """Parts of the rows below a row of names of columns, up to a blank line."""
    roles = lambda l, d: F.transform(cells(l["line"], d), lambda c: role(c["value"]))
    several = lambda rs: F.size(F.array_distinct(F.filter(rs, lambda r: r.isNotNull()))) > 1

    def head(l: Column) -> Column:
        of = lambda d: F.when(F.contains(l["line"], F.lit(d)), let(roles(l, d), lambda rs: F.when(several(rs), F.struct(l["at"].alias("at"), F.lit(d).alias("mark"), rs.alias("roles")))))
        return F.coalesce(*map(of, DELIMITERS))

    def row(l: Column, top: Column) -> Column:
        zipped = F.zip_with(by_mark(l["line"], top["mark"]), top["roles"], lambda c, r: F.struct(c.alias("c"), r.alias("r")))
        both = F.filter(zipped, lambda z: z["c"].isNotNull() & z["r"].isNotNull())
        return F.transform(both, lambda z: _part(F.concat(F.lit("row "), l["at"].cast("string")), z["r"], z["c"]["value"], l["at"] + z["c"]["start"]))

    def block(b: Column) -> Column:
        heads = F.filter(F.transform(F.filter(b["ls"], lambda l: named(l["line"])), head), lambda h: h.isNotNull())
        below = lambda l, top: (l["at"] > top["at"]) & ~((top["mark"] == "|") & l["line"].rlike(r"^[\s|:-]+$"))
        return let(F.get(heads, F.lit(0)), lambda top: F.when(top.isNotNull(), F.flatten(F.transform(F.filter(b["ls"], lambda l: below(l, top)), lambda l: row(l, top)))).otherwise(F.array().cast(f"array<{PART}>")))

    marked = lambda t: F.contains(t, F.lit("\n")) & reduce(Column.__or__, [F.contains(t, F.lit(d)) for d in DELIMITERS])
    return F.flatten(F.transform(runs_of_lines(text, BLOCK, marked), block))


def field_parts(text: Column) -> Column:
    """Parts of tables with a field a row: its name in the first cell, its value in the second."""
    row = lambda l: let(cells(l["line"], "|"), lambda cs: F.filter(cs, lambda c, i: (c["value"] != "") | ((i > 0) & (i < F.size(cs) - 1))))

    def event(l: Column, cs: Column) -> Column:
        first, second = F.get(cs, F.lit(0)), F.get(cs, F.lit(1))
        part = let(_part(F.lit(""), role(first["value"]), second["value"], l["at"] + second["start"]), lambda p: F.struct(*[p[c].alias(c) for c in ("start", "end", "role", "value")]))
        return F.when((F.size(cs) > 1) & role(second["value"]).isNull(), F.struct(part.alias("e"), F.lit(False).alias("cut")))

    def session(b: Column) -> Column:
        events = F.transform(F.filter(b["ls"], lambda l: named(l["line"])), lambda l: let(row(l), lambda cs: event(l, cs)))
        return in_records(numbered(F.filter(events, lambda x: x["e"]["role"].isNotNull())), F.concat(F.lit("field "), b["start"].cast("string")))

    return F.flatten(F.transform(F.when(F.contains(text, F.lit("|")), runs_of_lines(text, BARRED, lambda _: F.lit(True))), session))


def insert_parts(text: Column) -> Column:
    """Parts of the rows of INSERT statements."""
    names = lambda h: F.transform(cells(F.regexp_extract(h["value"], INSERT, 1), ","), lambda c: role(F.regexp_replace(c["value"], r'[`"\[\]]', "")))

    def row(at: Column, t: Column, roles: Column) -> Column:
        inner, start = F.substring(t["value"], F.lit(2), F.length(t["value"]) - 2), at + t["start"] + 1
        zipped = F.zip_with(cells(inner, ",", "'"), roles, lambda c, r: F.struct(c.alias("c"), r.alias("r")))
        both = F.filter(zipped, lambda z: z["c"].isNotNull() & z["r"].isNotNull())
        return F.transform(both, lambda z: _part(F.concat(F.lit("insert "), start.cast("string")), z["r"], z["c"]["value"], start + z["c"]["start"], r"\s"))

    def statement(h: Column) -> Column:
        values = F.regexp_extract(h["value"], INSERT, 2)
        at = h["start"] + F.length(h["value"]) - F.length(values)
        return let(names(h), lambda roles: F.flatten(F.transform(placed_hits(values, r"\([^()]*\)"), lambda t: row(at, t, roles))))

    has = F.contains(F.lower(text), F.lit("values")) & text.rlike("(?i)\\)\\s*VALUES\\s*\\(")
    return F.flatten(F.transform(F.when(has, placed_hits(text, INSERT)), statement))


def json_parts(leaves: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parts of the strings of an object: those that share their parent."""
    parent = F.to_json(F.slice("path", F.lit(1), F.size("path") - 1))
    return leaves.where("error IS NULL AND NOT is_key").select(key, F.concat(F.lit("json "), parent).alias("rec"), role(F.col("field")).alias("role"), "value", "start", "end").where("role IS NOT NULL")


def parts_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rec, role, value, start, end of the parts of names in a text's records. A text is read once, and nothing of it but its parts is shuffled."""
    text = F.col("text")
    texts = docs.where(named(text)).select(key, "text")
    found = F.flatten(F.filter(F.array(pair_parts(text), table_parts(text), field_parts(text), insert_parts(text)), lambda a: a.isNotNull()))
    return texts.select(key, F.explode_outer(found).alias("p")).where("p IS NOT NULL").select(key, "p.*")


def known_in_records(parts: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, value, role, start, end of each part of a record that a known name covers with another of its parts.

    Two parts match in either order; three as surname, given name, patronymic or given name, patronymic, surname."""
    words = lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda w: F.lower(w)), " ")
    usable = parts.where((F.trim("value") != "") & (F.length("value") <= LONGEST))
    pick = lambda r: F.min(F.when(F.col("role") == r, F.struct("start", "end", "role", "value"))).alias(r)
    records = usable.groupBy(key, "rec").agg(*map(pick, ROLES)).where(sum(F.col(r).isNotNull().cast("int") for r in ROLES) > 1)
    orders = [*permutations(ROLES, 2), ("surname", "given", "patronymic"), ("given", "patronymic", "surname")]
    whole = lambda o: F.when(reduce(Column.__and__, [F.col(r).isNotNull() for r in o]), F.struct(words(F.concat_ws(" ", *[F.col(r)["value"] for r in o])).alias("name"), F.array(*map(F.col, o)).alias("parts")))
    names = records.select(key, F.explode(F.filter(F.array(*map(whole, orders)), lambda x: x.isNotNull())).alias("n")).select(key, "n.*")
    entries = known.where("value IS NOT NULL").select("value", words(F.col("value")).alias("name")).where("name <> ''").distinct()
    hits = names.join(entries, "name").select(key, F.col("value").alias("known"), F.explode("parts").alias("p"))
    return hits.select(key, F.col("known").alias("value"), "p.role", "p.start", "p.end").distinct()
