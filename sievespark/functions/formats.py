"""Formats of personal data, credentials and the strict mode, each with a sample of what it finds (see samples)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks as C
from .rules import Rule
from .scalar import entropy, mod97

# Length of an IBAN by country.
IBAN = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 "
    "NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
# Given names and words that announce a kind of data.
GIVEN = "Anna|Maria|John|James|Robert|Michael|David|Thomas|Peter|Paul|Laura|Sarah|Julia|Emma|Carlos|Luis|Sofia|Lucia|Pierre|Claire|Hans|Klaus|Ivan|Olga"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DAY = rf"(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}|[0-9]{{1,2}} {MONTH} [0-9]{{4}})"
DATE = rf"(?:{DAY}|{MONTH} [0-9]{{1,2}}, [0-9]{{4}})"
NAME = r"[A-Z][a-z]+(?:[ -][A-Z][a-z]+){0,3}"
STREET = "(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)"
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"

_letters = "CASE WHEN c BETWEEN '0' AND '9' THEN try_cast(c AS INT) ELSE ascii(c) - 55 END"
_bare = "translate(value, ' ', '')"
IBAN_SQL = (
    f"instr('{IBAN}', concat(substr({_bare}, 1, 2), length({_bare}))) > 0 AND list_reduce(list_prepend(0, list_transform(string_split(concat(substr({_bare}, 5), substr({_bare}, 1, 4)), ''), "
    f"lambda c: {_letters})), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
)


def iban(v: Column) -> Column:
    bare = F.translate(v, " ", "")
    return F.contains(F.lit(IBAN), F.concat(F.left(bare, F.lit(2)), F.length(bare).cast("string"))) & (mod97(bare) == 1)


def dense(bits: float):
    return lambda v: entropy(v) >= bits


def dense_sql(bits: float) -> str:
    return f"list_entropy(string_split(value, '')) >= {bits}"


def personal(id: str, type: str, pattern: str, confidence: float, sample: str, **more) -> tuple[Rule, str]:
    return Rule(id, "personal", type, pattern, confidence, **more), sample


def secret(id: str, pattern: str, confidence: float, sample: str, **more) -> tuple[Rule, str]:
    return Rule(id, "credential", "SECRET", pattern, confidence, **more), sample


def label(id: str, type: str, words: str, value: str, sample: str, confidence: float = 0.85, **more) -> tuple[Rule, str]:
    """A label, a colon or equals sign, and a value on the same line."""
    lead = rf"(?i:{words}) ?[:=] ?"
    return personal(id, type, lead + value, confidence, sample, lead=lead, **more)


PERSONAL = [
    personal("iban-checksum", "IBAN", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 0.99, "BE{d2} {d4} {d4} {d4}", edge="0-9A-Za-z", accept=iban, accept_sql=IBAN_SQL),
    personal("us-ssn", "US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}", 0.85, "{c:0126789}{d2}-{d2}-{d4}", edge="0-9A-Za-z-",
             accept_sql="substr(value, 1, 1) <> '9' AND substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 5, 2) <> '00' AND substr(value, 8, 4) <> '0000'"),
    personal("ipv6", "IP_ADDRESS", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}", 0.85, "2001:db8:{x4}::{x4}:{x3}", hint=":", edge="0-9A-Za-z:."),
    personal("mac", "MAC_ADDRESS", r"[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})|[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}", 0.85, "{c:0f}{c:0f}:{x2}:{x2}:{x2}:{x2}:{x2}", edge="0-9A-Za-z:.-",
             accept_sql="translate(lower(value), ':-.0', '') <> '' AND translate(lower(value), ':-.f', '') <> ''"),
    personal("postal-address", "ADDRESS", rf"[0-9]{{1,5}} {NAME} {STREET}(?:, (?:Apt|Unit|Suite) [0-9A-Z]{{1,5}})?", 0.85, "{d3} Long Oak Street, Apt {d2}", edge="0-9A-Za-z"),
    personal("home-path", "USERNAME", r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z][A-Za-z0-9._-]{1,31}", 0.95, "/home/{l6}/notes", lead=r"(?:/home/|/Users/|C:\\Users\\)", accept_sql="lower(value) NOT IN ('root', 'shared', 'public', 'runner', 'ubuntu', 'default', 'admin')"),
    personal("name-gazetteer", "PERSON", rf"(?:{GIVEN}) [A-Z][a-z]{{2,20}}", 0.7, "wrote Laura K{l5}", edge="0-9A-Za-z"),
    personal("organization-context", "ORGANIZATION", rf"(?:company|employer|firm) {NAME}", 0.7, "the company B{l5} Trade", lead="(?:company|employer|firm) "),
    personal("phone-context", "PHONE", r"(?i:phone|tel|mobile|fax|call)[.:]? ?[0-9(][0-9() .-]{5,16}[0-9]", 0.9, "phone: {d3} {d3} {d4}", lead="(?i:phone|tel|mobile|fax|call)[.:]? ?", accept_sql="length(translate(value, '() .-', '')) BETWEEN 7 AND 15"),
    personal("birth-context", "DATE_OF_BIRTH", rf"(?i:born|birth|birthday|DOB)[^0-9\n]{{1,40}}{DAY}", 0.9, "She was born on 19{d2}-0{c:123456789}-1{c:012345678}", lead=r"(?i:born|birth|birthday|DOB)[^0-9\n]{1,40}"),
    personal("self-introduction", "PERSON", rf"(?:[Mm]y name is|I am called) {NAME}", 0.9, "My name is Q{l4} W{l5}", lead="(?:[Mm]y name is|I am called) "),
    personal("salutation", "PERSON", rf"(?:Dear|Hello|Hi) {NAME},", 0.85, "Dear J{l4} R{l6},", lead="(?:Dear|Hello|Hi) ", tail=","),
    personal("sign-off", "PERSON", rf"(?:Best|Kind|Warm) regards,\n{NAME}", 0.85, "Kind regards,{n}E{l4} S{l5}", lead="(?:Best|Kind|Warm) regards,\n"),
    personal("mail-display-name", "PERSON", rf"{NAME} <[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+>", 0.9, "F{l4} M{l5} <x{d4}@example.org>", tail=" <[^>]*>"),
    personal("obfuscated-email", "EMAIL", r"[A-Za-z0-9._-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+ ?[\[(]dot[\])] ?[A-Za-z]{2,12}", 0.85, "{l6} [at] mail{d2} [dot] org"),
    personal("po-box", "ADDRESS", r"P\.?O\.? Box [0-9]{1,6}", 0.85, "P.O. Box {d4}"),
    label("messenger-label", "USERNAME", "telegram|whatsapp|skype|signal|discord", r"@?[A-Za-z0-9._]{4,32}", "Telegram: @{l7}"),
    label("card-context", "CREDIT_CARD", "card(?: number)?|credit card", r"[0-9](?:[ -]?[0-9]){12,18}", "card number: {d4} {d4} {d4} {d4}", 0.9),
    label("postal-label", "ADDRESS", "zip(?: code)?|postal code|postcode", r"[0-9]{5}(?:-[0-9]{4})?", "ZIP code: {d5}", 0.9),
    personal("state-zip", "ADDRESS", rf"(?:{STATES}) [0-9]{{5}}(?:-[0-9]{{4}})?", 0.85, "{c:CW}A {d5}", edge="0-9A-Za-z"),
    label("label_person", "PERSON", "full name|first name|last name|patient", NAME, "Full name: P{l4} L{l6}"),
    label("label_address", "ADDRESS", "home address|address", r"[^\n;]{5,80}", "Address: {d2} Hill {u2}"),
    label("label_birth", "DATE_OF_BIRTH", "date of birth|birth date", DATE, "Date of birth: 1{c:0123}.1{c:012}.19{d2}"),
    label("label_id", "ID", "passport no|id number|customer id", r"[A-Z0-9-]{4,20}", "ID number: {u2}{d6}"),
    label("label_email", "EMAIL", "e-?mail", r"[^\s@]+@[^\s@]+", "Email: {l4}@{l5}.test"),
    label("label_organization", "ORGANIZATION", "organi[sz]ation|employer|company", NAME, "Employer: Z{l5} Works"),
    label("label_username", "USERNAME", "user(?:name)?|login", r"[A-Za-z0-9._-]{3,32}", "login: {l8}"),
    personal("mrz", "TRAVEL_DOCUMENT", r"P[A-Z<][A-Z]{3}[A-Z]+<<[A-Z<]{5,37}\n[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{7}[MF<][0-9]{7}[A-Z0-9<]{14}[0-9<][0-9]", 0.85, "P<UTO{u6}<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<{n}L{d8}{d1}UTO{d7}F{d7}ZE{d6}<<<<<<{d1}{d1}"),
    label("passport-format", "PASSPORT", "passport(?: no)?", r"[A-Z]{1,2}[0-9]{6,8}", "Passport: {u2}{d7}", 0.9),
    label("booking-context", "BOOKING", "booking(?: reference)?|PNR|reservation", r"[A-Z0-9]{6}", "PNR: {u3}{d3}"),
    label("ticket-context", "TICKET", "e?-?ticket(?: number)?", r"[0-9]{3}-?[0-9]{10}", "ticket number: {d3}-{d10}"),
    label("visa-context", "VISA", "visa(?: number)?", r"[A-Z0-9]{8,12}", "visa number: {u2}{d8}"),
    personal("entity_br_cpf", "BR_CPF", r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", 0.85, "{d3}.{d3}.{d3}-{d2}", hint=".", edge="0-9A-Za-z", accept_sql=C.cpf()),
    personal("entity_in_pan", "IN_PAN", r"[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", 0.85, "{u3}{c:ABCFP}{u1}{d4}{u1}", edge="0-9A-Za-z"),
    personal("entity_es_dni", "ES_DNI", r"[0-9]{8}[A-Z]", 0.85, "{d8}{u1}", edge="0-9A-Za-z", accept_sql=C.letter("TRWAGMYFPDXBNJZSQVHLCKE", "(cast(substr(value, 1, 8) as bigint) % 23)", "substr(value, 9, 1)")),
    personal("entity_wallet", "CRYPTO_WALLET", r"0x[0-9a-fA-F]{40}|bc1[a-z0-9]{25,59}", 0.85, "0x{x40}", edge="0-9A-Za-z"),
    personal("entity_us_npi", "US_NPI", r"[12][0-9]{9}", 0.95, "{c:12}{d9}", edge="0-9A-Za-z.-", accept_sql=C.luhn(15, "concat('80840', value)")),
]
CREDENTIAL = [
    secret("named-value", r"name: [A-Z_]*(?:TOKEN|PASSWORD|SECRET|KEY)[A-Z_]*\s+value: \S{4,256}", 0.95, "name: DB_PASSWORD value: {x12}", hint="value:", lead=r"name: [A-Z_]+\s+value: "),
    secret("login-call", r"login\(['\"][^'\"\n]{1,64}['\"], ?['\"][^'\"\n]{4,128}['\"]\)", 0.85, "login(\"me\", \"{x9}\")", hint="login(", lead=r"login\(['\"][^'\"\n]{1,64}['\"], ?['\"]", tail=r"['\"]\)"),
    secret("cli-password", r"(?:mysql|psql|sshpass|curl|redis-cli)[^\n]{0,80}? -(?:p|P|u) ?\S{4,128}", 0.95, "mysql -h db -p{x10}", lead=r"(?:mysql|psql|sshpass|curl|redis-cli)[^\n]{0,80}? -(?:p|P|u) ?"),
    secret("cookie", r"(?:Set-)?Cookie: [A-Za-z0-9_.-]+=[^;\s]{4,512}", 0.95, "Cookie: session={x20}; path=/", hint="Cookie:", lead=r"(?:Set-)?Cookie: [A-Za-z0-9_.-]+="),
    secret("webhook", r"https://(?:hooks\.slack\.com/services|discord\.com/api/webhooks)/[A-Za-z0-9_/-]{10,200}", 0.95, "https://hooks.slack.com/services/T{d8}/B{d8}/{x24}", hint="https://", lead=r"https://[a-z.]+/(?:services|api/webhooks)/"),
    secret("quoted-entropy", r"\"[A-Za-z0-9+/=_.-]{20,256}\"", 0.85, "\"{l20}{d4}{u8}\"", hint="\"", lead="\"", tail="\"", accept=dense(4.5), accept_sql=dense_sql(4.5)),
    secret("entropy", r"[A-Za-z0-9+/_=-]{20,256}", 0.85, "{l16}{d4}{u8}", edge="A-Za-z0-9+/_=-", accept=lambda v: (entropy(v) >= 4.2) & ~v.rlike("^[0-9a-fA-F]{7,64}$"), accept_sql=dense_sql(4.2) + " AND NOT regexp_matches(value, '^[0-9a-fA-F]{7,64}$')"),
    secret("credential-pair", r"(?i:user(?:name)?|login)[:=] ?\S{2,64}[,;]? (?i:pass(?:word)?|pwd)[:=] ?\S{4,128}", 0.9, "user: bob password: {x9}", lead=r"(?i:user(?:name)?|login)[:=] ?\S{2,64}[,;]? (?i:pass(?:word)?|pwd)[:=] ?"),
    secret("netrc", r"machine \S+ login \S+ password \S{3,128}", 0.95, "machine host login me password {x11}", hint="machine ", lead=r"machine \S+ login \S+ password "),
    secret("nuget", r"<add key=\"ClearTextPassword\" value=\"[^\"\n]{3,256}\"", 0.95, "<add key=\"ClearTextPassword\" value=\"{x11}\" />", hint="<add", lead="<add key=\"ClearTextPassword\" value=\"", tail="\""),
    secret("wordpress", r"define\( ?'[A-Z_]*(?:PASSWORD|KEY|SALT)', ?'[^'\n]{4,256}'", 0.95, "define( 'DB_PASSWORD', '{x14}' );", hint="define(", lead=r"define\( ?'[A-Z_]+', ?'", tail="'"),
    secret("putty-private-key", r"PuTTY-User-Key-File-[23]: [^\n]+", 0.95, "PuTTY-User-Key-File-3: ssh-ed25519 {x30}", hint="PuTTY"),
    secret("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{16,1000}", 0.95, "eyJ{x20}.eyJ{x30}.{x32}", hint="eyJ"),
    secret("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", 0.95, "{d9}:AA{x33}", hint=":AA", edge="A-Za-z0-9_"),
    secret("discord", r"[MNO][A-Za-z0-9_-]{23,25}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,38}", 0.95, "M{x23}.{x6}.{x27}", hint="."),
    secret("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}", 0.95, "{x32}-us{d1}", hint="-us", edge="A-Za-z0-9"),
]
STRICT = [
    personal("strict-date", "DATE", DATE, 0.9, "on 1{c:012345678} March 19{d2}", edge="0-9A-Za-z"),
    personal("strict-age", "AGE", r"[0-9]{1,3} years? old|(?i:aged) [0-9]{1,3}", 0.9, "aged {c:123456789}{d1}", edge="0-9A-Za-z"),
    personal("strict-number", "NUMBER", r"[0-9]{6,20}", 0.9, "no {d8}", edge="0-9A-Za-z._-"),
]
FORMATS = [*PERSONAL, *CREDENTIAL, *STRICT]
