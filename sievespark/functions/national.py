"""National and vendor identifiers by issuer: a row each, with what raises the confidence of a value of its shape."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import checks as C
from .rules import Rule

NEVER = "false"


def near(*names: str) -> str:
    """A pattern of the names that a number goes by, a blank for any white space. Those in ASCII may not be touched by an ASCII letter, digit or _ (not
    \\b, which Java and RE2 read differently beside other letters); others stand anywhere, as their scripts don't part words alike."""
    each = lambda some: "|".join(re.escape(n).replace(r"\ ", r"\s+").replace(r"\-", "-") for n in some)
    plain, other = [n for n in names if n.isascii()], [n for n in names if not n.isascii()]
    edged = [rf"(?:^|[^A-Za-z0-9_])(?:{each(plain)})(?:$|[^A-Za-z0-9_])"] if plain else []
    return "(?i)" + "|".join(edged + ([each(other)] if other else []))


@dataclass(frozen=True)
class Identifier:
    """shape: the values' pattern. label: words near a value. check: SQL over value. plain: a pattern of the values
    that are distinctive by themselves. must: SQL that holds for every value. sample: see samples."""

    type: str
    shape: str
    label: str
    sample: str
    check: str = NEVER
    plain: str = ""
    must: str = "TRUE"

    def rule(self) -> Rule:
        return Rule("national-format", "personal", self.type, self.shape, 0.0, accept_sql=self.must)


# What the issuers say an identifier looks like.
DIGITS_333 = r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}"
ITIN_GROUP = "(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-2]|9[4-9])"
OMOCODE = "[0-9LMNPQRSTUV]"
FISCAL_MONTH = "[ABCDEHLMPRST]"
DEA_REGISTRANT = "[ABCDEFGHJKLMPRSTUX]"
BIC_COUNTRIES = "AT BE BR CA CH CN CZ DE DK ES FI FR GB GR HK HU IE IL IN IT JP KR LU MX NL NO PL PT RO RU SA SE SG SK TR UA US ZA AE AU"
VAT = {
    "AT": "U[0-9]{8}", "BE": "[01][0-9]{9}", "DE": "[1-9][0-9]{8}", "DK": "[0-9]{8}", "EL": "[0-9]{9}", "ES": "[0-9A-Z][0-9]{7}[0-9A-Z]", "FI": "[0-9]{8}",
    "FR": "[0-9A-HJ-NP-Z]{2}[0-9]{9}", "IE": "[0-9][0-9A-Z+*][0-9]{5}[A-Z]{1,2}", "IT": "[0-9]{11}", "LU": "[0-9]{8}", "NL": "[0-9]{9}B[0-9]{2}", "PL": "[0-9]{10}",
    "PT": "[0-9]{9}", "SE": "[0-9]{12}",
}

ASIA = [
    Identifier("AE_EMIRATES_ID", r"784-?(?:19|20)[0-9]{2}-?[0-9]{7}-?[0-9]", near("Emirates ID", "UAE ID", "Emirates identity card", "resident identity card", "بطاقة الهوية", "هوية إماراتية"), "{?Emirates ID }784-19{d2}-{d7}-{d1}", C.luhn(15), "^784-[0-9]{4}-[0-9]{7}-[0-9]$"),
    Identifier("IL_ID_NUMBER", r"[0-9]{9}", near("Israeli ID", "Israeli identity number", "Mispar Zehut", "Teudat Zehut", "מספר זהות", "תעודת זהות"), "{?Israeli ID }{d9}", C.luhn(9)),
    Identifier("IN_AADHAAR", r"[2-9][0-9]{3}(?:[0-9]{8}| [0-9]{4} [0-9]{4}|-[0-9]{4}-[0-9]{4})", near("Aadhaar", "Aadhaar number", "Aadhaar card", "UID number", "आधार संख्या", "आधार"), "{?Aadhaar }{c:23456789}{d3} {d4} {d4}", C.verhoeff(12)),
    Identifier("IN_GSTIN", r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]", near("GSTIN", "GST registration", "GST identification number", "GST No"), "{?GSTIN }{d2}{u5}{d4}{u1}1Z{d1}", C.gstin(), "."),
    Identifier("IN_PASSPORT", r"[A-PR-WY][1-9][0-9] ?[0-9]{4}[1-9]", near("passport", "passport number", "Indian passport", "पासपोर्ट"), "{?passport }{c:ABCKLMNPR}{c:123456789}{d5}{c:123456789}"),
    Identifier("IN_VOTER", r"[A-Z]{3}[0-9]{7}", near("voter", "voter ID", "elector's photo identity card", "EPIC No", "मतदाता पहचान पत्र"), "{?voter }{u3}{d7}"),
    Identifier("KR_RRN", r"[0-9]{6}[ -]?[1-8][0-9]{6}", near("RRN", "resident registration number", "jumin", "주민등록번호", "주민번호"), "{?RRN }{d2}0{c:123456789}1{d1}-{c:1234}{d6}", C.both(C.day(C.digits()), C.check_digit([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], "(11 - {s} % 11) % 10")), r"^[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"),
    Identifier("SA_NATIONAL_ID", r"[12][0-9]{9}", near("Iqama", "Saudi ID", "national identity number", "residence permit", "رقم الهوية الوطنية", "رقم الإقامة"), "{?iqama }{c:12}{d9}", C.luhn(10)),
    Identifier("SG_NRIC_FIN", r"[STFGM][0-9]{7}[A-Z]", near("NRIC", "NRIC No", "FIN", "Foreign Identification Number", "identity card number"), "{?NRIC }{c:STFGM}{d7}{c:ABCDEFGHIJKLNPQRTUWXZ}", C.nric(), "."),
    Identifier("SG_UEN", r"[0-9]{8}[A-Z]|(?:19|20)[0-9]{7}[A-Z]|[TSR][0-9]{2}[A-Z]{2}[0-9]{4}[A-Z]", near("UEN", "Unique Entity Number", "ACRA"), "{?UEN }{d8}{u1}"),
    Identifier("TH_TNIN", r"[1-8][0-9]{12}|[1-8]-[0-9]{4}-[0-9]{5}-[0-9]{2}-[0-9]", near("Thai ID", "Thai identification number", "citizen identification number", "เลขประจำตัวประชาชน", "บัตรประจำตัวประชาชน"), "{?thai id }{c:12345678}-{d4}-{d5}-{d2}-{d1}", C.check_digit(list(range(13, 1, -1)), "(11 - {s} % 11) % 10")),
]
EUROPE = [
    Identifier("DE_TAX_ID", r"[1-9][0-9](?: ?[0-9]{3}){3}", near("IdNr", "Steuer-IdNr", "Steuer-ID", "Identifikationsnummer", "Steuerliche Identifikationsnummer", "tax identification number"), "{?IdNr }{c:123456789}{d1} {d3} {d3} {d3}", C.product_check(11)),
    Identifier("ES_NIE", r"[XYZ]-?[0-9]{7}-?[A-Z]", near("NIE", "foreigner identity number", "Número de Identidad de Extranjero", "número de extranjero"), "{?NIE }{c:XYZ}-{d7}-{u1}", C.spanish(), "."),
    Identifier("EU_VAT_NUMBER", "(?:" + "|".join(f"{country} ?{number}" for country, number in VAT.items()) + ")", near("VAT", "VAT number", "VAT ID", "USt-IdNr", "Umsatzsteuer-Identifikationsnummer", "UID-Nummer", "TVA intracommunautaire", "btw-nummer", "partita IVA", "momsnummer", "ALV-numero", "NIP UE", "numéro de TVA", "número de IVA"), "{?VAT }DE{c:123456789}{d8}", C.both("substr(value, 1, 2) = 'DE'", C.product_check(9, f"right({C.digits()}, 9)")), "^(?:ATU|NL[0-9]{9}B)"),
    Identifier("FI_PERSONAL_IDENTITY_CODE", r"[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-FHJ-NPR-Y]", near("HETU", "personal identity code", "henkilötunnus", "personbeteckning"), "{?HETU }1{d1}0{c:123456789}{d2}-{d3}{c:0123456789ABCDEFHJKLMNPRSTUVWXY}", C.finnish(), "."),
    Identifier("IT_FISCAL_CODE", rf"[A-Z]{{6}}{OMOCODE}{{2}}{FISCAL_MONTH}{OMOCODE}{{2}}[A-Z]{OMOCODE}{{3}}[A-Z]", near("codice fiscale", "cod. fisc.", "C.F.", "Italian tax code"), "{?codice fiscale }{u6}{d2}{c:ABCDEHLMPRST}{d2}{u1}{d3}{u1}", C.fiscal_code(), "."),
    Identifier("IT_VAT_CODE", r"[0-9]{11}", near("partita IVA", "P.IVA", "P. IVA", "part. IVA", "Italian VAT"), "{?partita iva }{d11}", C.luhn(11)),
    Identifier("PL_PESEL", r"[0-9]{11}", near("PESEL", "numer PESEL", "PESEL number"), "{?PESEL }{d2}0{c:123456789}1{d6}", C.pesel()),
    Identifier("RU_INN", r"[0-9]{12}|[0-9]{10}", near("INN", "taxpayer number", "ИНН", "идентификационный номер налогоплательщика"), "{?INN }{d10}", C.inn()),
    Identifier("RU_SNILS", r"[0-9]{3}[- ][0-9]{3}[- ][0-9]{3}[ -][0-9]{2}|[0-9]{11}", near("SNILS", "individual insurance account", "СНИЛС", "номер индивидуального лицевого счёта"), "{?SNILS }{d3}-{d3}-{d3} {d2}", C.snils()),
    Identifier("SE_PERSONNUMMER", r"(?:[0-9]{2})?[0-9]{6}[-+][0-9]{4}", near("personnummer", "personnr", "samordningsnummer", "Swedish personal identity number"), "{?personnummer }{d2}0{c:123456789}1{d1}-{d4}", C.personnummer()),
    Identifier("UK_DRIVING_LICENCE", r"[A-Z9]{5}[0-9][0156][0-9]{4}[A-Z9]{2}[0-9][A-Z]{2}", near("driving licence", "driving licence number", "driver number", "DVLA", "trwydded yrru"), "{?DVLA }{u5}{d1}{c:0156}{d4}{u2}{d1}{u2}", plain="."),
    Identifier("UK_NATIONAL_INSURANCE_NUMBER", r"[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]", near("National Insurance", "National Insurance number", "NI number", "NINO", "Yswiriant Gwladol"), "{?NINO }{u2}{d6}{c:ABCD}"),
    Identifier("UK_NHS", r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}", near("NHS", "NHS number", "NHS No", "Rhif GIG", "National Health Service"), "{?NHS }{d3} {d3} {d4}", C.weighted(list(range(10, 0, -1)), 11)),
    Identifier("UK_POSTCODE", r"[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][ABD-HJLNP-UW-Z]{2}", near("postcode", "post code", "postal address", "cod post"), "{?postcode }{u2}{d1} {d1}{c:ABDEFGH}{c:ABDEFGH}"),
]
AMERICA = [
    Identifier("ABA_ROUTING_NUMBER", r"[0-9]{4}-?[0-9]{4}-?[0-9]", near("ABA", "ABA routing", "routing number", "routing transit number", "RTN"), "{?ABA }0{d8}", C.aba(), must=C.aba()),
    Identifier("CA_SIN", DIGITS_333, near("SIN", "social insurance number", "NAS", "numéro d'assurance sociale"), "{?SIN }{d3}-{d3}-{d3}", C.luhn(9)),
    Identifier("MEDICAL_LICENSE", DEA_REGISTRANT + "[A-Z9][0-9]{7}", near("DEA", "DEA number", "DEA registration", "registrant number"), "{?DEA }{c:ABFM}{u1}{d7}", C.dea()),
    Identifier("US_BANK_NUMBER", r"[0-9]{8,17}", near("account number", "bank account number", "bank account", "account no", "a/c no", "deposit account"), "{?bank account }{d12}"),
    Identifier("US_DRIVER_LICENSE", r"[A-Z]{1,2}[0-9]{4,14}|[0-9]{7,14}", near("driver license", "driver's license", "DL number", "DLN", "license number", "DMV"), "{?driver license }{u1}{d8}"),
    Identifier("US_ITIN", "9[0-9]{2}(?:" + "|".join(f"{x}{ITIN_GROUP}{x}" for x in ("-", " ", "")) + ")[0-9]{4}", near("ITIN", "individual taxpayer identification number", "IRS number"), "{?ITIN }9{d2}-7{d1}-{d4}", plain="^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
]
SOUTH = [
    Identifier("AU_ABN", r"[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}", near("ABN", "Australian Business Number"), "{?ABN }{d2} {d3} {d3} {d3}", C.abn(), "^[0-9]{2} [0-9]{3} [0-9]{3} [0-9]{3}$"),
    Identifier("AU_ACN", r"[0-9]{3} ?[0-9]{3} ?[0-9]{3}", near("ACN", "Australian Company Number", "ASIC"), "{?ACN }{d3} {d3} {d3}", C.both(f"length({C.digits()}) = 9", C.varied(C.digits()), C.check_digit(list(range(8, 0, -1)), "(10 - {s} % 10) % 10"))),
    Identifier("AU_MEDICARE", r"[2-6][0-9]{3} ?[0-9]{5} ?[0-9](?:[ -/]?[0-9])?", near("Medicare", "Medicare number", "Medicare card", "individual reference number"), "{?medicare }{c:23456}{d3} {d5} {d1}", C.check_digit([1, 3, 7, 9, 1, 3, 7, 9], "{s} % 10")),
    Identifier("AU_TFN", DIGITS_333, near("TFN", "tax file number", "ATO"), "{?TFN }{d3} {d3} {d3}", C.weighted([1, 4, 3, 7, 5, 8, 6, 9, 10], 11)),
    Identifier("ZA_ID_NUMBER", r"[0-9]{10}[0-2][89][0-9]", near("SA ID", "South African ID", "identity number", "ID-nommer", "identiteitsnommer"), "{?SA ID }{d2}0{c:123456789}1{d5}{c:012}{c:89}{d1}", C.both(C.day(C.digits()), C.luhn(13))),
]
VENDORS = [
    Identifier("IMEI", r"[0-9]{15}|[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]", near("IMEI", "International Mobile Equipment Identity", "handset ID"), "{?IMEI }{d2}-{d6}-{d6}-{d1}", C.luhn(15)),
    Identifier("STEAM_ID", r"7656119[0-9]{10}", near("Steam", "SteamID", "SteamID64", "Steam community"), "{?steam }7656119{d10}"),
    Identifier("SWIFT_CODE", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", near("SWIFT", "BIC", "SWIFT code", "Business Identifier Code", "bank identifier"), "{?BIC }{u4}{c:DFGIN}{c:ERBTL}{u2}", must=f"instr('{BIC_COUNTRIES}', substr(value, 5, 2)) > 0"),
    Identifier("TRACKING_NUMBER", r"1Z[0-9A-Z]{15}[0-9]|9[2-5][0-9]{2}(?: ?[0-9]{4}){4}(?: ?[0-9]{2})?", near("UPS", "USPS", "tracking number", "tracking", "waybill", "consignment"), "{?tracking }1Z{d3}{u1}{d2}{u1}{d9}", C.ups(), "^1Z"),
    Identifier("VIN", r"[A-HJ-NPR-Z0-9]{17}", near("VIN", "vehicle identification number", "chassis number", "Fahrgestellnummer", "numéro de châssis"), "{?VIN }{c:123JKW}{c:ABCFGHV}{c:ABCDEF}{d5}{c:0123456789X}{d8}", C.vin(), must="translate(value, '0123456789', '') <> value and translate(value, 'ABCDEFGHJKLMNPRSTUVWXYZ', '') <> value"),
]
IDENTIFIERS = [*ASIA, *EUROPE, *AMERICA, *SOUTH, *VENDORS]
