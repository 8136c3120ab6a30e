"""Detectors: for each kind a Column of spans over a text Column. All stay in Catalyst.

Each has a cheap test (only_if) that rules most texts out before its pattern runs. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import checksums
from spanloom.functions.spans import SPANS, empty, find, keep, let, span
from spanloom.operators.names import person_names
from spanloom.options import RedactionOptions

#: The patterns of the kinds. (?U) gives \d \w \s \b their Unicode sense.
SSN = (
    r"(?U)(?<![\d-])(?:((?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4})"
    r"|(\b(?i:SSN|social\s+security(?:\s+(?:number|no\.?|#))?)\s*[:#]?\s*)((?!000|666|9\d\d)\d{3}(?!00)\d{2}(?!0000)\d{4}))(?![\d-])"
)
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}\b"
PHONE = (
    r"(?U)(?<![\d+-])(?:(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}"
    r"|\+(?!1\b)\d{1,3}[\s.-]?(?:\(?\d{1,4}\)?[\s.-]?){2,4}\d{2,4})(?![\d-])(?:\s*(?i:ext|x|extension)\.?\s*\d{1,5})?"
)
IPV4 = r"(?U)(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"
NUMBER_WORD = r"(?:\s+(?i:no|number|num|#))?"
PASSPORT = rf"(?U)(\b(?i:passport){NUMBER_WORD}\.?\s*[:#]?\s*)((?=[A-Za-z0-9]*\d)[A-Za-z0-9]{{6,9}})\b"
LICENSE = rf"(?U)(\b(?i:driver'?s?\s+licen[cs]e|DL|licen[cs]e){NUMBER_WORD}\.?\s*[:#]?\s*)((?=[A-Za-z0-9-]*\d)[A-Za-z0-9][A-Za-z0-9-]{{3,13}}[A-Za-z0-9])\b"
MRN = rf"(?U)(\b(?i:MRN|medical\s+record{NUMBER_WORD}|patient\s+(?:id|number|no))\.?\s*[:#]?\s*)((?=[A-Za-z0-9-]*\d)[A-Za-z0-9][A-Za-z0-9-]{{2,13}}[A-Za-z0-9])\b"
HEALTH_PLAN = (
    r"(?U)(\b(?i:member|subscriber|policy|group|health\s+plan|beneficiary|insurance|medicaid|medicare)\s+(?i:id|number|no|num|#)\.?\s*[:#]?\s*)"
    r"((?=[A-Za-z0-9-]*\d)[A-Za-z0-9][A-Za-z0-9-]{3,18}[A-Za-z0-9])\b"
    r"|\b([1-9][AC-HJ-KM-NP-RT-Y][AC-HJ-KM-NP-RT-Y0-9]\d[AC-HJ-KM-NP-RT-Y][AC-HJ-KM-NP-RT-Y0-9]\d[AC-HJ-KM-NP-RT-Y]{2}\d{2})\b"
)
NPI = r"(?U)(?<![\d-])\d{10}(?![\d-])"
DEA = r"(?U)\b[ABCDEFGHJKLMPRSTUX][A-Z9]\d{7}\b"
ABA = r"(?U)(?<![\d-])\d{9}(?![\d-])"
CARD = r"(?U)(?<![\d-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\d-])"
IBAN = r"(?U)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
SWIFT = r"(?U)(\b(?i:SWIFT|BIC)(?:\s+(?i:code|no|number))?\.?\s*[:#]?\s*)([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
ACCOUNT = rf"(?U)(\b(?i:account|acct|a/c|routing|ABA){NUMBER_WORD}\.?\s*[:#]?\s*)((?:\d{{4}} ){{1,5}}\d{{2,4}}|\d+(?:-\d+){{1,5}}|\d{{6,24}})(?![\d-])"
STREET_SUFFIXES = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Circle|Cir|Terrace|Ter|Parkway|Pkwy|Highway|Hwy|Trail|Trl|Square|Sq"
ADDRESS = (
    r"(?U)\b\d{1,6}[A-Za-z]?\s+(?:(?:[NSEW]|North|South|East|West)\.?\s+)?(?:[A-Z][A-Za-z']+\s+){1,4}"
    rf"(?:{STREET_SUFFIXES})\.?(?:\s*,?\s*(?:Apt|Apartment|Suite|Ste|Unit|Floor|Fl|#)\.?\s*[A-Za-z0-9-]+)?(?![A-Za-z])"
)
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATE = (
    r"(?iuU)(?<![\d/-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{1,2}([/-])\d{1,2}\1(?:(?:19|20)\d{2}|\d{2})"
    rf"|(?:{MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTH})\.?,?\s+(?:19|20)\d{{2}})(?![\d/-])"
)
MARKERS = (
    r"\b(?:confidential(?:ity)?|proprietary|internal\s+use\s+only|trade\s+secrets?|do\s+not\s+distribute|not\s+for\s+distribution"
    r"|privileged\s+(?:and|&)\s+confidential|attorney[- ]client\s+privileged?)\b"
)
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22,
    "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

HAS_DIGIT = r"\d"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?U)" + pattern)


def ssn(text: Column) -> Column:
    return find(text, SSN, "$2", "$1$3", _has(text, r"\d{4}"))


def email(text: Column) -> Column:
    return find(text, EMAIL, only_if=text.contains("@"))


def phone(text: Column) -> Column:
    return find(text, PHONE, only_if=_has(text, r"\d{3}[\s.-]\d{4}|\+\d"))


def ipv4(text: Column) -> Column:
    octets = lambda v: F.forall(F.split(v, r"\."), lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))
    return keep(find(text, IPV4, only_if=_has(text, r"\d\.\d")), octets)


def passport(text: Column) -> Column:
    return find(text, PASSPORT, "$1", "$2", _has(text, HAS_DIGIT) & text.rlike("(?i)passport"))


def drivers_license(text: Column) -> Column:
    return find(text, LICENSE, "$1", "$2", _has(text, HAS_DIGIT) & text.rlike(r"(?i)licen[cs]e|(?U:\bdl)"))


def medical_record(text: Column) -> Column:
    return find(text, MRN, "$1", "$2", _has(text, HAS_DIGIT) & text.rlike("(?i)mrn|medical|patient"))


def health_plan(text: Column) -> Column:
    return find(text, HEALTH_PLAN, "$1", "$2$3", _has(text, HAS_DIGIT))


def npi(text: Column) -> Column:
    return keep(find(text, NPI, only_if=_has(text, r"\d{10}")), checksums.npi)


def dea(text: Column) -> Column:
    return keep(find(text, DEA, only_if=_has(text, r"[A-Z9]\d{7}")), checksums.dea)


def bank_routing(text: Column) -> Column:
    return keep(find(text, ABA, only_if=_has(text, r"\d{9}")), checksums.aba)


def credit_card(text: Column) -> Column:
    valid = lambda v: F.length(_digits(v)).between(13, 19) & checksums.luhn(_digits(v))
    return keep(find(text, CARD, only_if=_has(text, r"\d{4}")), valid)


def swift(text: Column) -> Column:
    return find(text, SWIFT, "$1", "$2", text.rlike("(?i)swift|bic"))


def account(text: Column) -> Column:
    return keep(find(text, ACCOUNT, "$1", "$2", _has(text, r"\d[\d -]{4}") & text.rlike("(?i)acc|a/c|routing|aba")), lambda v: F.length(_digits(v)).between(6, 24))


def address(text: Column) -> Column:
    return find(text, ADDRESS, only_if=_has(text, HAS_DIGIT))


def date(text: Column) -> Column:
    months = F.create_map(*[x for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split()) for x in (F.lit(m), F.lit(i + 1))])

    def plausible(v: Column) -> Column:
        month_day = lambda m, d: m.between(1, 12) & d.between(1, 31)
        number = lambda p, g=1: F.regexp_extract(v, p, g).try_cast("int")
        iso = month_day(number(r"^\d{4}-(\d{2})-"), number(r"-(\d{2})$"))
        a, b = number(r"^(\d{1,2})[/-]"), number(r"[/-](\d{1,2})[/-]")
        text_month = months[F.regexp_extract(F.lower(v), r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1)]
        day = F.coalesce(number(r"^(\d{1,2})\D"), number(r"^\D+(\d{1,2})\D"))
        return F.coalesce(
            F.when(v.rlike(r"^\d{4}-"), iso).when(v.rlike(r"^\d{1,2}[/-]"), month_day(a, b) | month_day(b, a)).otherwise(month_day(text_month, day)),
            F.lit(False),
        )

    return keep(find(text, DATE, only_if=_has(text, HAS_DIGIT)), plausible)


def iban(text: Column) -> Column:
    """Each match is cut where its country's characters are used up; there it must end at a non-alphanumeric."""
    lengths = F.expr("map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")")

    def cut(s: Column) -> Column:
        return let(_end_of(s["text"]), lambda end: F.struct(s["start"].alias("start"), end.alias("length"), F.substr(s["text"], F.lit(1), end).alias("text"), F.substr(s["text"], end + 1, F.lit(1)).alias("next")))

    def _end_of(v: Column) -> Column:
        need = lengths[F.substring(v, 1, 2)]
        ends = F.filter(
            F.sequence(F.lit(15), F.greatest(F.length(v), F.lit(15))),
            lambda i: (F.length(F.replace(F.substr(v, F.lit(1), i), F.lit(" "))) == need) & (F.substr(v, i, F.lit(1)) != " ") & (i <= F.length(v)),
        )
        return F.get(ends, F.lit(0))

    trimmed = F.transform(find(text, IBAN, only_if=_has(text, r"[A-Z]{2}\d{2}")), cut)
    good = F.filter(trimmed, lambda s: s["length"].isNotNull() & ~s["next"].rlike("^[A-Za-z0-9]") & checksums.iban(F.replace(s["text"], F.lit(" "))))
    return F.transform(good, lambda s: span(s["start"], s["length"], s["text"])).cast(SPANS)


#: A sentence: from its first character that is no white space up to a line break, or through a terminator that white
#: space or the end follows. No repeated group, so that long sentences do not nest matcher frames.
SENTENCE = r"(?U)(\s*)([.!?](?=\s|\z)|\S[^\r\n]*?(?:[.!?](?=\s|\z)|(?=[\r\n])|\z))"
#: A line break between words that may make up a marker.
BROKEN_MARKER = (
    r"(?iU)(?<=\b(?:internal|use|trade|do|not|for|privileged|and|&)[ \t]{0,9})[\r\n]"
    r"(?=\s{0,9}(?:use|only|secrets?|not|distribute|distribution|for|and|&|confidential)\b)"
)


def confidential(text: Column) -> Column:
    """Sentences with a confidentiality marker, without the white space before them. A marker may cross a line break."""
    marker = "(?iuU)" + MARKERS
    crossed = F.exists(F.regexp_extract_all(text, F.lit(marker), F.lit(0)), lambda m: m.rlike(r"[\r\n]"))
    joined = F.when(text.rlike(marker) & crossed, F.regexp_replace(text, BROKEN_MARKER, " ")).otherwise(text)
    found = keep(find(joined, SENTENCE, "$1", "$2", text.rlike(marker)), lambda v: v.rlike(marker))
    return F.transform(found, lambda s: span(s["start"], s["length"], F.substr(text, s["start"] + 1, s["length"])))


def term_pattern(terms) -> str:
    """One alternation of literal terms, longest first; spaces match any white space, letters and digits end at word bounds."""
    parts = []
    for t in sorted(dict.fromkeys(terms), key=lambda t: -len(t)):
        body = r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in t.split(" "))
        parts.append((r"\b" if t[0].isalnum() else "") + body + (r"\b" if t[-1].isalnum() else ""))
    return "|".join(parts)


def custom_terms(text: Column, options: RedactionOptions) -> Column:
    if not options.terms:
        return empty()
    return find(text, ("(?U)" if options.terms_case_sensitive else "(?iuU)") + "(?:" + term_pattern(options.terms) + ")")


Detector = Callable[[Column], Column]
#: The registry: a kind's detector is a function from a text Column to a spans Column, and may be replaced or added to.
REGISTRY: dict[str, Detector] = {
    "SocialSecurityNumber": ssn,
    "EmailAddress": email,
    "PhoneNumber": phone,
    "IpAddress": ipv4,
    "PassportNumber": passport,
    "DriversLicenseNumber": drivers_license,
    "StreetAddress": address,
    "PersonName": person_names,
    "MedicalRecordNumber": medical_record,
    "HealthPlanId": health_plan,
    "NationalProviderId": npi,
    "DeaNumber": dea,
    "Date": date,
    "CreditCardNumber": credit_card,
    "BankRoutingNumber": bank_routing,
    "Iban": iban,
    "SwiftCode": swift,
    "AccountNumber": account,
    "ConfidentialStatement": confidential,
}


def detectors_for(options: RedactionOptions, registry: dict[str, Detector] | None = None) -> dict[str, Detector]:
    """Only the detectors of the effective kinds; kinds without one are left out."""
    known = REGISTRY if registry is None else registry
    out = {k: known[k] for k in options.effective_kinds() if k in known}
    if options.terms:
        out["CustomTerm"] = lambda text: custom_terms(text, options)
    return out
