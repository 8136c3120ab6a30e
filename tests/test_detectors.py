"""Detectors, resolver and redaction on small cases."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import redact
from spanloom.operators.detectors import REGISTRY, custom_terms
from spanloom.operators.names import is_sentence_start
from spanloom.operators.resolve import DETECTIONS, PRIORITY, resolve
from spanloom.options import RedactionOptions, format_placeholder, parse_request

CASES = {
    "SocialSecurityNumber": [("SSN 123-45-6789 and 000-12-3456, ssn: 123456789.", ["123-45-6789", "123456789"])],
    "EmailAddress": [("mail a.b@c-d.example.com, x@y, z@w.io.", ["a.b@c-d.example.com", "z@w.io"])],
    "PhoneNumber": [("(555) 123-4567 ext. 12 or +44 20 7946 0958 not 5551234567", ["(555) 123-4567 ext. 12", "+44 20 7946 0958"])],
    "IpAddress": [("10.0.0.1, 256.1.1.1 and 1.2.3.4.", ["10.0.0.1"])],
    "PassportNumber": [("Passport no: X1234567 passport number ABCDEFG", ["X1234567"])],
    "DriversLicenseNumber": [("Driver's License #: D123-4567", ["D123-4567"])],
    "StreetAddress": [("at 123 N. Main Street, Apt 4B now; 9 lower street", ["123 N. Main Street, Apt 4B"])],
    "MedicalRecordNumber": [("MRN: 12345678 patient id A-9981", ["12345678", "A-9981"])],
    "HealthPlanId": [("Member ID: XYZ123456 and 1EG4TE5MK73", ["XYZ123456", "1EG4TE5MK73"])],
    "NationalProviderId": [("NPI 1234567893 not 1234567890", ["1234567893"])],
    "DeaNumber": [("DEA AB1234563 not AB1234567", ["AB1234563"])],
    "Date": [("on 2024-02-31, 13/25/2024, 12/25/24, Jan 5th, 2024 and 5 September 2023, 1999", ["2024-02-31", "12/25/24", "Jan 5th, 2024", "5 September 2023"])],
    "CreditCardNumber": [("4111 1111 1111 1111 and 378282246310005 and 4111-1111-1111-1112", ["4111 1111 1111 1111", "378282246310005"])],
    "BankRoutingNumber": [("021000021 and 123456789", ["021000021"])],
    "Iban": [("pay DE89 3704 0044 0532 0130 00 now GB82WEST12345698765432 ZZ8937040044053201", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"])],
    "SwiftCode": [("SWIFT code: DEUTDEFF500 bic NEDSZAJJ", ["DEUTDEFF500", "NEDSZAJJ"])],
    "AccountNumber": [("Account No: 1234 5678 90, acct 12-34 routing 021000021", ["1234 5678 90", "021000021"])],
    "ConfidentialStatement": [
        ("Hello. This is CONFIDENTIAL material v1.2 ok!  Next one.\nTrade secrets here", ["This is CONFIDENTIAL material v1.2 ok!", "Trade secrets here"]),
        ("Confidential!Next one. x", ["Confidential!Next one."]),
        ("a internal use\n only b. c", ["a internal use\n only b."]),
        ("word " * 20000 + "confidential. x", ["word " * 20000 + "confidential."]),
    ],
    "PersonName": [
        ("Dr. Jane Smith met Captain America and Captain James Cook. Dear Sir, Dear John,\nSincerely,\nMary O'Brien", ["Jane Smith", "James Cook", "John", "Mary O'Brien"]),
        ("Patient: Smith, John A. Attn: Acme Corporation Mark your calendar. Acme Jane Smith Inc saw Mark Jones", ["Smith, John A.", "Jane Smith", "Mark Jones"]),
        ("Client: Smith, Please call", ["Smith"]),
        ("José García de la Cruz spoke", ["José García de la Cruz"]),
    ],
}


@pytest.mark.parametrize("kind", CASES)
def test_detector(spark, kind):
    rows = spark.createDataFrame([*CASES[kind], ("", []), (None, [])], "text string, expected array<string>")
    for r in rows.withColumn("found", REGISTRY[kind](F.col("text"))).collect():
        assert [s.text for s in r.found] == r.expected
        assert all(r.text[s.start : s.start + s.length] == s.text for s in r.found)


def test_custom_terms(spark):
    df = spark.createDataFrame([("new york  CITY, New York; a+b c++",)], "text string")
    options = RedactionOptions(0, custom_terms=("New York", " New York City ", "a+b", "c++", ""))
    assert [s.text for s in df.select(custom_terms(F.col("text"), options)).first()[0]] == ["new york  CITY", "New York", "a+b", "c++"]


def test_sentence_start(spark):
    rows = [("Mark", 0, True), ("see Mark", 4, False), ("end.  Mark", 6, True), ("a\n\tMark", 3, True), ("(Mark", 1, True)]
    df = spark.createDataFrame(rows, "text string, i int, expected boolean")
    assert df.where(is_sentence_start(F.col("text"), F.col("i")) != F.col("expected")).count() == 0


def test_resolver_prefers_length_then_priority_then_start(spark):
    cases = [
        ([("Date", 0, 5), ("Iban", 3, 9)], [("Iban", 3, 9)]),
        ([("AccountNumber", 0, 9), ("BankRoutingNumber", 0, 9)], [("BankRoutingNumber", 0, 9)]),
        ([("Date", 0, 5), ("Date", 5, 5), ("Date", 3, 5)], [("Date", 0, 5), ("Date", 5, 5)]),
        ([], []),
    ]
    for given, kept in cases:
        df = spark.createDataFrame([([(*g, "") for g in given],)], f"d {DETECTIONS}")
        assert [tuple(x)[:3] for x in df.select(resolve(F.col("d"))).first()[0]] == kept


def test_redaction_and_report(spark):
    df = spark.createDataFrame([(1, "Call (555) 123-4567 or a@b.co. routing 021000021"), (2, ""), (3, None), (4, "nothing")], "id int, text string")
    rows = {r.id: r for r in redact.redact(df).withColumn("report", redact.report_json(F.col("detections"))).collect()}
    assert rows[1].redacted_text == "Call [PHONE] or [EMAIL]. routing [ROUTING-NUMBER]"
    assert rows[1].total == 3 and '"kind":"EmailAddress","count":1' in rows[1].report
    assert (rows[2].redacted_text, rows[3].redacted_text, rows[4].redacted_text) == ("", None, "nothing")


def test_apply_rejects_unordered_detections(spark):
    df = spark.createDataFrame([("abcdef", [("Date", 3, 2, ""), ("Date", 0, 2, "")])], f"text string, d {DETECTIONS}")
    with pytest.raises(Exception, match="overlap"):
        df.select(redact.applied(F.col("text"), F.col("d"))).collect()


def test_options_and_requests():
    assert RedactionOptions(0).effective_kinds() == ()
    assert "CustomTerm" in RedactionOptions(0, frozenset({"CustomTerm"}), ("x",)).effective_kinds()
    assert format_placeholder("<{0}> {{x}}", "A") == "<A> {x}"
    for bad in ("{1}", "{0", "}"):
        with pytest.raises(ValueError):
            format_placeholder(bad, "A")
    options, errors = parse_request("pii; Financial", "Iban", "a, b\nc", placeholder=" ")
    assert not errors and options.categories == 5 and options.terms == ("a, b", "c")
    assert set(parse_request("nope", "what", "", placeholder="{1}")[1]) == {"categories", "excludedKinds", "placeholderFormat"}


def test_many_matches_in_one_text(spark):
    """A whole file is one text: offsets, resolution and the splice stay right, and quick, over 100,000 matches."""
    n = 100_000
    options = RedactionOptions(0, custom_terms=("the",))
    one = spark.createDataFrame([(1, "the x " * n)], "id long, text string")
    row = redact.redact(one, options=options).select("total", "redacted_text", F.transform("detections", lambda d: d["start"]).alias("at")).first()
    assert row.total == n and row.at == list(range(0, 6 * n, 6))
    assert row.redacted_text == "[CUSTOM] x " * n


def test_chains_of_overlaps_resolve_like_brute_force(spark):
    import random

    rng = random.Random(3)
    kinds = ["Date", "Iban", "PhoneNumber", "PersonName"]
    rows = [(i, [(rng.choice(kinds), rng.randrange(400), rng.randrange(0, 9), "") for _ in range(rng.randrange(0, 300))]) for i in range(30)]
    got = {r.id: [(d.kind, d.start, d.length) for d in r.d] for r in spark.createDataFrame(rows, f"id int, d {DETECTIONS}").select("id", resolve(F.col("d")).alias("d")).collect()}
    for i, spans in rows:
        kept = []
        for k, a, n, _ in sorted(spans, key=lambda s: (-s[2], PRIORITY[s[0]], s[1])):
            if all(not (a < b + m and b < a + n) for _, b, m in kept):
                kept.append((k, a, n))
        assert sorted(got[i]) == sorted(kept) and [d[1] for d in got[i]] == sorted(d[1] for d in kept)
