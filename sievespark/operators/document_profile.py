"""People, organisations, education, addresses and contacts of documents such as applications and letters, in English and Russian.

One cue alone is often weak: two capitalised words, a name before "said", a place behind "lives in". So cues are rows with a score, and those of one
entity in one text are added up: the score of an entity is what is left when each different cue that speaks for it is wrong,
1 - (1 - a)(1 - b)..., and a cue counts once, however often it occurs. Entities that come to `least` are findings at all their cues,
and are then looked for in the rest of their text. Names are compared without case, quotes and legal forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule
from .detect import detect, detect_sql
from .propagation import propagated

WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
NAME = rf"{WORD}(?: {WORD}){{0,3}}"
TO = r"[ \t]*[:—-][ \t]*"
LEGAL_BEFORE, LEGAL_BEHIND = "ООО|АО|ЗАО|ПАО|НКО", r"Ltd|LLC|Inc|Corp|PLC|GmbH|AG|KG|S\.A|B\.V|Oy|AB"
YEARS = r"(?:19|20)[0-9]{2} ?[–-] ?(?:(?:19|20)[0-9]{2}|present|now|н\.в\.|настоящее время)"
EDGE = r"\p{L}\p{N}_"


def cue(rule: str, kind: str, score: float, value: str, before: str = "", after: str = "") -> Rule:
    return Rule(rule, "personal", kind, before + value + after, score, "", EDGE, lead=before, tail=after)


CUES = [
    cue("person-label", "PERSON", 0.75, NAME, rf"(?:Full name|Name|Candidate|Applicant|Имя|ФИО|Кандидат){TO}"),
    cue("person-introduction", "PERSON", 0.75, NAME, "(?:[Mm]y name is|I am called|[Мм]еня зовут) "),
    cue("person-title", "PERSON", 0.6, NAME, r"(?:(?:Mr|Mrs|Ms|Dr|Prof)\.|г-н|г-жа|[Гг]осподин|[Гг]оспожа) "),
    cue("person-signature", "PERSON", 0.6, NAME, r"(?:[Rr]egards|[Ss]incerely|[Сс] уважением),?[ \n]"),
    cue("person-initials", "PERSON", 0.35, r"\p{Lu}\. ?(?:\p{Lu}\. ?)?\p{Lu}\p{L}{2,30}"),
    cue("person-speaks", "PERSON", 0.45, rf"{WORD}(?: {WORD}){{1,2}}", "", " (?:said|wrote|asked|called|сказал|сказала|написал|написала)"),
    cue("person-pair", "PERSON", 0.3, rf"{WORD} {WORD}"),
    cue("organization-legal-before", "ORGANIZATION", 0.7, rf"(?:{LEGAL_BEFORE}) ?[«\"]?{NAME}[»\"]?"),
    cue("organization-legal-behind", "ORGANIZATION", 0.7, rf"{NAME},? (?:{LEGAL_BEHIND})\.?"),
    cue("organization-group", "ORGANIZATION", 0.7, rf"{NAME} (?:Group|Holding|Partners|Групп|Холдинг)"),
    cue("organization-label", "ORGANIZATION", 0.75, NAME, rf"(?:Employer|Company|Organi[sz]ation|Работодатель|Компания|Организация){TO}"),
    cue("organization-work", "ORGANIZATION", 0.5, NAME, r"(?:works? (?:at|for)|employed (?:at|by)|joined|работа(?:ю|ет|л|ла) в(?: компании)?) [«\"]?"),
    cue("organization-years", "ORGANIZATION", 0.45, NAME, "", rf",? \(?{YEARS}"),
    cue("education-type-before", "EDUCATION", 0.65, rf"(?:University|Institute|College|Academy|School) of {NAME}"),
    cue("education-type-behind", "EDUCATION", 0.65, rf"{NAME} (?:University|Institute|College|Academy|School|университет|институт|колледж|академия)"),
    cue("education-label", "EDUCATION", 0.75, r"\p{Lu}[^\n;,]{3,80}", rf"(?:Education|Образование|Вуз|ВУЗ){TO}"),
    cue("education-verb", "EDUCATION", 0.5, rf"{WORD}(?: (?:of )?{WORD}| университет| институт| академия){{0,4}}", r"(?:graduated from|studied at|окончила?|учил(?:ся|ась) в) (?:the )?"),
    cue("address-label", "ADDRESS", 0.75, r"[^\n;]{5,80}", rf"(?:Home address|Address|Адрес|Место жительства){TO}"),
    cue("address-street", "ADDRESS", 0.7, rf"[0-9]{{1,5}}[A-Z]? {NAME} (?:Street|Road|Avenue|Lane|Drive|Square|Boulevard)|(?:ул\.|улица|проспект|пер\.|пл\.) {NAME},? (?:д\.|дом) ?[0-9]{{1,4}}"),
    cue("address-residence", "ADDRESS", 0.5, NAME, r"(?:lives? in|based in|located in|resident of|[Пп]роживаю? в|[Пп]роживает в|[Жж]ив[её]т в|г\.) ?"),
    cue("contact-phone", "CONTACT", 0.85, r"\+?[0-9(][0-9() -]{5,18}[0-9]", r"(?:[Pp]hone|[Mm]obile|[Tt]el|[Тт]елефон|[Тт]ел|[Мм]об)\.?(?:[ \t]*[:—-])?[ \t]*"),
    cue("contact-messenger", "CONTACT", 0.85, r"@?[A-Za-z0-9._]{4,32}", rf"(?:[Tt]elegram|[Ww]hats[Aa]pp|[Ss]kype|[Тт]елеграм|[Сс]кайп){TO}"),
    cue("contact-profile", "CONTACT", 0.8, r"https?://(?:www\.)?(?:linkedin\.com/in|github\.com|vk\.com|t\.me)/[A-Za-z0-9._-]{2,60}"),
]
#: What isn't part of an entity's name.
BARE = rf"(?i)^(?:{LEGAL_BEFORE}) ?|,? (?:{LEGAL_BEHIND})\.?$|[«»\"]"


def entity(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(value, BARE, ""), r"\s+", " ")))


def accumulated(cues: DataFrame, least: float = 0.7, key: str = "doc_id") -> DataFrame:
    """cues (findings with value and confidence) of the entities that come to `least` in their text, with the entity's score as confidence."""
    named = cues.withColumn("entity", entity(F.col("value"))).where("entity <> ''")
    # An entity's cues in a text are one row, so that they are found once.
    fields = [c for c in cues.columns if c not in (key, "type")]
    lists = named.groupBy(key, "type", "entity").agg(F.collect_list(F.struct(*fields)).alias("fs"))
    best = lambda r: F.array_max(F.transform(F.filter("fs", lambda f: f["rule"] == r), lambda f: f["confidence"]))
    rules = F.array_sort(F.array_distinct(F.transform("fs", lambda f: f["rule"])))
    wrong = F.aggregate(rules, F.lit(1.0), lambda p, r: p * (F.lit(1.0) - best(r)))
    scored = lists.withColumn("score", F.round(1 - wrong, 6)).where(F.col("score") >= least)
    return scored.select(key, "type", "score", F.explode("fs").alias("f")).select(key, "type", "score", "f.*").withColumn("confidence", F.col("score")).select(*cues.columns)


def document_entities(docs: DataFrame, least: float = 0.7, key: str = "doc_id", cues: list[Rule] = CUES) -> DataFrame:
    """key, start, end, type, rule, confidence, value of what cues find for strong entities, and of their further places (rule document-propagation)."""
    strong = accumulated(detect(docs, cues, key), least, key).select(key, "start", "end", "type", "rule", "confidence", "value")
    whole = strong.where(F.length("value") >= 5)
    further = propagated(docs, whole, key, 0.0)
    scores = whole.groupBy(key, "value").agg(F.max("confidence").alias("confidence"))
    more = further.join(scores, [key, "value"]).withColumn("rule", F.lit("document-propagation"))
    return strong.unionByName(more.select(*strong.columns)).distinct()


def accumulated_sql(table: str, least: float = 0.7, cues: list[Rule] = CUES) -> str:
    bare = BARE.replace("(?i)", "").replace("'", "''")
    return f"""WITH f AS ({detect_sql(cues, table)}), n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(value, '{bare}', '', 'gi'), '\\s+', ' ', 'g'))) AS entity FROM f),
o AS (SELECT doc_id, type, entity, rule, max(confidence) AS c FROM n WHERE entity <> '' GROUP BY ALL),
s AS (SELECT doc_id, type, entity, round(1 - product(1 - c), 6) AS score FROM o GROUP BY ALL)
SELECT doc_id, start, "end", n.type, rule, score AS confidence, value FROM n JOIN s USING (doc_id, type, entity) WHERE score >= {least}"""
