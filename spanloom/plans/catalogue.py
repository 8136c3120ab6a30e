"""Named queries of the span engine, each with the SQL that gives the same rows. Results are flat."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import checksums, scalars
from spanloom.functions.spans import find
from spanloom.operators import blocks, detectors, redact, segments, throughput
from spanloom.operators.resolve import DETECTIONS, resolve
from spanloom.options import RedactionOptions, bind_form, parse_request
from spanloom.plans import routes
from spanloom.scratch import settle, shared_folder
from spanloom.sources import docx, routing, text_files
from spanloom.streaming.redaction import redact_stream, windowed_report

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(found: Column) -> Column:
    return F.transform(found, lambda s: s["text"])


def spans_of(df: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys, start, value) of one detector over `text`."""
    found = df.select(*keys, F.explode(detectors.REGISTRY[kind](F.col("text"))).alias("s"))
    return found.select(*keys, F.col("s.start").alias("start"), F.col("s.text").alias("value"))


def _literal(rows) -> str:
    show = lambda v: "null" if v is None else f"{v}" if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# --- catalog ---------------------------------------------------------------------------------------------------------

#: Fixed values, written out so that the SQL does not repeat the library's table.
KIND_SQL = """(values
  (10, 'CreditCardNumber', 'CREDIT-CARD', 4), (20, 'Iban', 'IBAN', 4), (30, 'NationalProviderId', 'NPI', 2), (40, 'DeaNumber', 'DEA', 2),
  (50, 'BankRoutingNumber', 'ROUTING-NUMBER', 4), (60, 'SocialSecurityNumber', 'SSN', 3), (70, 'CustomTerm', 'CUSTOM', 0), (80, 'EmailAddress', 'EMAIL', 3),
  (90, 'SwiftCode', 'SWIFT', 4), (100, 'MedicalRecordNumber', 'MRN', 2), (110, 'HealthPlanId', 'HEALTH-PLAN-ID', 2), (120, 'PassportNumber', 'PASSPORT', 3),
  (130, 'DriversLicenseNumber', 'DRIVERS-LICENSE', 3), (140, 'AccountNumber', 'ACCOUNT-NUMBER', 4), (150, 'PhoneNumber', 'PHONE', 3), (160, 'IpAddress', 'IP', 3),
  (170, 'StreetAddress', 'ADDRESS', 3), (180, 'Date', 'DATE', 2), (185, 'PersonName', 'NAME', 3), (190, 'ConfidentialStatement', 'CONFIDENTIAL', 8), (200, 'DocumentAuthor', 'AUTHOR', 3)
) k(priority, kind, label, categories)"""


@query(f"select *, kind = 'ConfidentialStatement' as widens, kind = 'DocumentAuthor' as metadata_only from {KIND_SQL}")
def kind_catalog(spark, sf_dir):
    return catalog.kind_catalog(spark)


@query(
    """select 'Pii' as category, unnest(string_split('SocialSecurityNumber EmailAddress PassportNumber DriversLicenseNumber PhoneNumber IpAddress StreetAddress PersonName DocumentAuthor', ' ')) as kind
    union all select 'Hipaa', unnest(string_split('NationalProviderId DeaNumber SocialSecurityNumber EmailAddress MedicalRecordNumber HealthPlanId PassportNumber DriversLicenseNumber PhoneNumber IpAddress StreetAddress Date PersonName DocumentAuthor', ' '))
    union all select 'Financial', unnest(string_split('CreditCardNumber Iban BankRoutingNumber SwiftCode AccountNumber', ' '))
    union all select 'Confidential', 'ConfidentialStatement'"""
)
def kinds_by_category(spark, sf_dir):
    cats = spark.createDataFrame(list(catalog.CATEGORIES.items()), "category string, mask int")
    met = F.col("categories").bitwiseAND(F.col("mask")) != 0
    return catalog.kind_catalog(spark).join(F.broadcast(cats), met).select("category", "kind")  # both sides are fixed tables


REQUESTS = [("financial", 4, "Iban;SwiftCode", 1), ("pii", 1, "PersonName", 0), ("all", 15, "", 0), ("none", 0, "CustomTerm", 1)]


@query(
    f"""select r.name, k.kind from (values {_literal(REQUESTS)}) r(name, mask, excluded, terms), {KIND_SQL}
    where (k.categories & r.mask <> 0 and not list_contains(string_split(r.excluded, ';'), k.kind)) or (k.kind = 'CustomTerm' and r.terms > 0)"""
)
def effective_kinds(spark, sf_dir):
    rows = []
    for name, mask, excluded, terms in REQUESTS:
        options = RedactionOptions(mask, frozenset(excluded.split(";")), ("x",) * terms)
        rows += [(name, k) for k in options.effective_kinds()]
    return spark.createDataFrame(rows, "name string, kind string")


# --- detectors over documents ----------------------------------------------------------------------------------------

EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}\b"
IP_SQL = r"list_filter(regexp_extract_all(text, '[0-9.]+'), lambda v: regexp_full_match(v, '\d{1,3}(\.\d{1,3}){3}') and list_max(list_transform(string_split(v, '.'), lambda o: try_cast(o as int))) <= 255)"
LUHN_SQL = "(list_sum(list_transform(range(length(v)), lambda i: case when (length(v) - i) % 2 = 1 then v[i + 1]::int else (v[i + 1]::int * 2) % 10 + (v[i + 1]::int * 2) // 10 end)) % 10 = 0)"
CARD_SQL = rf"list_filter(regexp_extract_all(text, '[0-9-]+'), lambda v: case when regexp_full_match(v, '\d{{13,19}}') then {LUHN_SQL} else false end)"


@query(rf"select doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}')) as value from documents")
def detect_email(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "documents"), "EmailAddress", "doc_id").drop("start")


@query(f"select doc_id, unnest({IP_SQL}) as value from documents")
def detect_ipv4(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "documents"), "IpAddress", "doc_id").drop("start")


@query(f"select doc_id, unnest({CARD_SQL}) as value from documents")
def detect_card(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "documents"), "CreditCardNumber", "doc_id").drop("start")


@query(r"select doc_id, unnest(regexp_extract_all(' ' || text, '[^0-9+-](\+1 \(\d{3}\) \d{3}-\d{4})', 1)) as value from documents")
def detect_phone(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "documents"), "PhoneNumber", "doc_id").drop("start")


@query(f"select page_id, unnest({IP_SQL.replace('text', 'html')}) as value from pages")
def detect_ipv4_pages(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "IpAddress", "page_id").drop("start")


TERMS = ("than the", "the", "erst", "und")


@query(
    r"""with t as (select doc_id, regexp_extract_all(lower(text), 'than[\s]+the\b|[\p{L}\p{N}\p{M}_]+') as w from documents)
    select doc_id, len(list_filter(w, lambda x: x in ('the', 'erst', 'und') or regexp_full_match(x, 'than\s+the')))::int as n from t where n > 0"""
)
def detect_custom_terms(spark, sf_dir):
    options = RedactionOptions(0, custom_terms=TERMS)
    found = table(spark, sf_dir, "documents").select("doc_id", F.size(detectors.custom_terms(F.col("text"), options)).alias("n"))
    return found.where("n > 0")


@query(
    """select doc_id, 0 as start, 'This report is CONFIDENTIAL and v' || (doc_id % 7) || '.' || (doc_id % 3) || ' only!' as value from documents
    union all select doc_id, 46, 'Trade  secrets ahead' from documents where doc_id % 2 = 0"""
)
def detect_confidential(spark, sf_dir):
    lead = F.concat(F.lit("This report is CONFIDENTIAL and v"), (F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"), F.lit(" only!  "))
    more = F.when(F.col("doc_id") % 2 == 0, "\n Trade  secrets ahead\n").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, more, F.col("text")).alias("text"))
    return spans_of(docs, "ConfidentialStatement", "doc_id")


# --- detectors over texts made from keys -----------------------------------------------------------------------------


def _padded(key: str, n: int) -> Column:
    return F.lpad(F.col(key).cast("string"), n, "0")


def _orders(spark, sf_dir, *parts: Column) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.concat(*parts).alias("text"))


def _customers(spark, sf_dir, *parts: Column) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(*parts).alias("text"))


NPI_SQL = "(list_sum(list_transform(range(15), lambda i: case when i % 2 = 0 then ('80840' || v)[i + 1]::int else (('80840' || v)[i + 1]::int * 2) % 10 + (('80840' || v)[i + 1]::int * 2) // 10 end)) % 10 = 0)"
ABA_SQL = "((3 * (v[1]::int + v[4]::int + v[7]::int) + 7 * (v[2]::int + v[5]::int + v[8]::int) + v[3]::int + v[6]::int + v[9]::int) % 10 = 0 and (v[1:2]::int <= 12 or v[1:2]::int between 21 and 32 or v[1:2]::int between 61 and 72 or v[1:2]::int = 80))"


@query(f"select id, 4 as start, v as value from (select o_orderkey as id, lpad(o_orderkey::varchar, 10, '0') as v from orders) where {NPI_SQL}")
def detect_npi(spark, sf_dir):
    return spans_of(_orders(spark, sf_dir, F.lit("NPI "), _padded("o_orderkey", 10), F.lit(" on file")), "NationalProviderId", "id")


@query(f"select id, 8 as start, v as value from (select o_orderkey as id, lpad(o_orderkey::varchar, 9, '0') as v from orders) where {ABA_SQL}")
def detect_aba(spark, sf_dir):
    return spans_of(_orders(spark, sf_dir, F.lit("routing "), _padded("o_orderkey", 9)), "BankRoutingNumber", "id")


@query(
    """select id, 5 as start, v as value from (select o_orderkey as id, 'AB' || lpad(o_orderkey::varchar, 7, '0') as v from orders)
    where (v[3]::int + v[5]::int + v[7]::int + 2 * (v[4]::int + v[6]::int + v[8]::int)) % 10 = v[9]::int"""
)
def detect_dea(spark, sf_dir):
    return spans_of(_orders(spark, sf_dir, F.lit("DEA: AB"), _padded("o_orderkey", 7), F.lit(".")), "DeaNumber", "id")


@query(
    """with t as (select o_orderkey as id, lpad((o_orderkey * 7919 % 1000000000)::varchar, 9, '0') as d from orders)
    select id, case when id % 2 = 0 then 5 else 3 end as start, case when id % 2 = 0 then d else d[1:3] || '-' || d[4:5] || '-' || d[6:9] end as value
    from t where d[1:3] not in ('000', '666') and d[1] <> '9' and d[4:5] <> '00' and d[6:9] <> '0000'"""
)
def detect_ssn(spark, sf_dir):
    d = F.lpad((F.col("o_orderkey") * 7919 % 1000000000).cast("string"), 9, "0")
    cut = F.concat(F.lit("no "), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 6, 4))
    return spans_of(_orders(spark, sf_dir, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("SSN: "), d)).otherwise(cut)), "SocialSecurityNumber", "id")


@query("select o_orderkey as id, 12 as start, case when o_orderkey % 3 = 0 then lpad(o_orderkey::varchar, 6, '0') || '-77' else lpad(o_orderkey::varchar, 12, '0') end as value from orders")
def detect_account(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.concat(_padded("o_orderkey", 6), F.lit("-77"))).otherwise(_padded("o_orderkey", 12))
    return spans_of(_orders(spark, sf_dir, F.lit("Account No: "), v, F.lit(" is open")), "AccountNumber", "id")


@query("select c_custkey as id, 8 as start, 'A-' || lpad(c_custkey::varchar, 6, '0') as value from customer")
def detect_mrn(spark, sf_dir):
    return spans_of(_customers(spark, sf_dir, F.lit("see MRN A-"), _padded("c_custkey", 6), F.lit(".")), "MedicalRecordNumber", "id")


@query("select c_custkey as id, 11 as start, 'HP' || lpad(c_custkey::varchar, 9, '0') as value from customer")
def detect_health_plan(spark, sf_dir):
    return spans_of(_customers(spark, sf_dir, F.lit("Member ID: HP"), _padded("c_custkey", 9)), "HealthPlanId", "id")


@query("select c_custkey as id, 13 as start, 'X' || lpad(c_custkey::varchar, 7, '0') as value from customer")
def detect_passport(spark, sf_dir):
    return spans_of(_customers(spark, sf_dir, F.lit("Passport No. X"), _padded("c_custkey", 7)), "PassportNumber", "id")


@query("select c_custkey as id, 18 as start, 'D' || lpad(c_custkey::varchar, 6, '0') || '-9' as value from customer")
def detect_license(spark, sf_dir):
    return spans_of(_customers(spark, sf_dir, F.lit("driver's license: D"), _padded("c_custkey", 6), F.lit("-9")), "DriversLicenseNumber", "id")


@query("select c_custkey as id, 12 as start, 'DEUTDE' || lpad((c_custkey % 100)::varchar, 2, '0') || case when c_custkey % 2 = 0 then '500' else '' end as value from customer")
def detect_swift(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 2 == 0, "500").otherwise("")
    return spans_of(_customers(spark, sf_dir, F.lit("SWIFT code: DEUTDE"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), tail), "SwiftCode", "id")


@query(
    """select o_orderkey as id, 3 as start, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%m/%d/%Y')
    when 2 then strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) else day(o_orderdate) || strftime(o_orderdate, ' %b ') || year(o_orderdate) end as value from orders"""
)
def detect_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(d, "MMMM d, yyyy"))
        .otherwise(F.date_format(d, "d MMM yyyy"))
    )
    return spans_of(_orders(spark, sf_dir, F.lit("on "), text, F.lit(" it ran")), "Date", "id")


@query(
    """with t as (select c_custkey as id, lpad(c_custkey::varchar, 18, '0') as b from customer),
    c as (select id, 'DE' || lpad(((98 - ((b || '131400')::hugeint % 97))::int)::varchar, 2, '0') || b as v from t)
    select id, 4 as start, case when id % 3 = 0 then v[1:4] || ' ' || v[5:8] || ' ' || v[9:12] || ' ' || v[13:16] || ' ' || v[17:20] || ' ' || v[21:22] else v end as value from c where id % 2 = 0"""
)
def detect_iban(spark, sf_dir):
    b = _padded("c_custkey", 18)
    rest = (F.concat(b, F.lit("131400")).cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")).cast("int")
    check = F.lpad((F.when(F.col("c_custkey") % 2 == 0, 98 - rest).otherwise(97 - rest)).cast("string"), 2, "0")
    v = F.concat(F.lit("DE"), check, b)
    grouped = F.concat_ws(" ", *[F.substring(v, i, 4) for i in range(1, 22, 4)])
    return spans_of(_customers(spark, sf_dir, F.lit("pay "), F.when(F.col("c_custkey") % 3 == 0, grouped).otherwise(v), F.lit(" now")), "Iban", "id")


@query("select o_orderkey as id, 3 as start, o_orderkey || ' N. Old Oak Street, Apt ' || (o_orderkey % 9) || 'B' as value from orders where o_orderkey < 1000000")
def detect_address(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    text = _orders(spark, sf_dir, F.lit("at "), key, F.lit(" N. Old Oak Street, Apt "), (F.col("o_orderkey") % 9).cast("string"), F.lit("B; and 9 low road"))
    return spans_of(text, "StreetAddress", "id")


NAME_TEXTS = [
    ("Dr. Jane Smith saw ", "Jane Smith", 4),
    ("Patient: Smith, John A. has ", "Smith, John A.", 9),
    ("Dear Sir, Captain James Cook took ", "James Cook", 18),
    ("Mark your Acme Mary Jones Inc for ", "Mary Jones", 15),
    ("regards,\nZoë O’Brien-Lee wrote ", "Zoë O’Brien-Lee", 9),
    ("Captain America left ", None, 0),
]


@query(f"select o_orderkey as id, n.start, n.value from orders join (values {_literal((i, v, s) for i, (_, v, s) in enumerate(NAME_TEXTS))}) n(k, value, start) on o_orderkey % 6 = n.k where n.value is not null")
def detect_person_name(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in NAME_TEXTS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return spans_of(_orders(spark, sf_dir, text, F.col("o_orderkey").cast("string")), "PersonName", "id")


#: (kind, text, what is found): forms of identifiers that the tables do not hold, and texts that must find nothing.
DETECTOR_CASES = [
    ("SocialSecurityNumber", "ssn #219-09-9999, social security no. 219099999", "219-09-9999|219099999"),
    ("SocialSecurityNumber", "219 09 9999; 900-12-3456 666-12-3456 219-00-1234 219-09-0000 1219-09-9999", "219 09 9999"),
    ("EmailAddress", "to <o'neil.a+b@sub-1.mail.example.org>; no@host, @x.com, a@b.c", "neil.a+b@sub-1.mail.example.org"),
    ("PhoneNumber", "212-555-0187, 212.555.0187, (212)555-0187 x42, 1-212-555-0187", "212-555-0187|212.555.0187|(212)555-0187 x42|1-212-555-0187"),
    ("PhoneNumber", "+49 30 901820, +33 1 42 68 53 00; 12-555-0187 2125550187", "+49 30 901820|+33 1 42 68 53 00"),
    ("IpAddress", "at 0.0.0.0 and 255.255.255.255, not 1.2.3, 1.2.3.4.5, 300.1.1.1", "0.0.0.0|255.255.255.255"),
    ("PassportNumber", "passport # C01X00T47 and PASSPORT number 987654321; passport holder", "C01X00T47|987654321"),
    ("DriversLicenseNumber", "DL: K9876-54321; driver licence no K55-66; bundled 99887766", "K9876-54321|K55-66"),
    ("DriversLicenseNumber", "a software licence, version", ""),
    ("MedicalRecordNumber", "mrn 77-1234, patient no. B2C4, medical record number: 0099; mrnx 8888", "77-1234|B2C4|0099"),
    ("HealthPlanId", "policy number PN-44-8, medicaid id: 0A1B2C; card 2AA1CC3DD45 shown", "PN-44-8|0A1B2C|2AA1CC3DD45"),
    ("HealthPlanId", "0AA1CC3DD45 and member idea", ""),
    ("NationalProviderId", "1234567893, 1245319599; 1234567890", "1234567893|1245319599"),
    ("DeaNumber", "F91234563 BB1388568 ab1234563 BB1388569", "F91234563|BB1388568"),
    ("BankRoutingNumber", "021000021 and 011401533 but not 021000022 or 991000021", "021000021|011401533"),
    ("CreditCardNumber", "5555-5555-5555-4444, 3782 822463 10005, 6011111111111117, 4111 1111-1111 1111", "5555-5555-5555-4444|3782 822463 10005|6011111111111117"),
    ("Iban", "NO93 8601 1117 947, FR1420041010050500013M02606 and GB82WEST12345698765432x", "NO93 8601 1117 947|FR1420041010050500013M02606"),
    ("Iban", "GB82 WEST 1234 5698 7654 33, ZZ82WEST12345698765432", ""),
    ("SwiftCode", "BIC: NEDSZAJJXXX; swift code CHASUS33. SWIFT progress", "NEDSZAJJXXX|CHASUS33"),
    ("AccountNumber", "acct 1234 5678 90, account number 55-66-7788, a/c 00112233, account 12-34", "1234 5678 90|55-66-7788|00112233"),
    ("StreetAddress", "5B S. Elm Ave., Suite 12 or 1600 North Oak Tree Parkway; 7 days Street", "5B S. Elm Ave., Suite 12|1600 North Oak Tree Parkway"),
    ("Date", "3/4/1999, 31-12-24, 2023-11-05, Sept 9 2001, 1st Mar. 2020; 45/45/2020, 2023-13-01", "3/4/1999|31-12-24|2023-11-05|Sept 9 2001|1st Mar. 2020"),
    ("ConfidentialStatement", "Hello there. This is internal use only! Bye.\nOur trade secret", "This is internal use only!|Our trade secret"),
    ("PersonName", "Prof. Ada van der Berg met Judge Amy Coney at noon.", "Ada van der Berg|Amy Coney"),
    ("PersonName", "Attn - Lee, Kim\nDear Max,\nYours truly,\nJosé García-Díaz", "Lee, Kim|Max|José García-Díaz"),
    ("PersonName", "May Day is here. He met May Parker and Thomas Gray Inc.", "May Parker|Thomas Gray"),
]


@query(f"select case_id, kind, unnest(string_split(found, '|')) as value from (values {_literal((i, k, f) for i, (k, _, f) in enumerate(DETECTOR_CASES))}) t(case_id, kind, found) where found <> ''")
def detector_cases(spark, sf_dir):
    rows = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(DETECTOR_CASES)], "case_id int, kind string, text string")
    kinds = sorted({k for k, _, _ in DETECTOR_CASES})
    found = None
    for kind in kinds:
        part = spans_of(rows.where(F.col("kind") == kind), kind, "case_id", "kind").drop("start")
        found = part if found is None else found.unionByName(part)
    return found


#: (name, form fields, mask, excluded kinds, terms, error fields).
REQUEST_FORMS = [
    ("lists", [("categories", "pii"), ("categories", "Financial; hipaa / phi"), ("customTerms", "a b\nc")], 7, "", "a b|c", ""),
    ("numbers", [("categories", "all"), ("excludedKinds", "0,iban"), ("customTermsAreCaseSensitive", "TRUE")], 15, "Iban|SocialSecurityNumber", "", ""),
    ("terms only", [("customTerms", " x "), ("customTermsAreCaseSensitive", "yes")], 0, "", "x", ""),
    ("nothing", [("categories", " ; ,"), ("other", "pii")], None, "", "", "categories"),
    ("all wrong", [("categories", "nope"), ("excludedKinds", "21"), ("placeholderFormat", "{1}")], None, "", "", "categories|excludedKinds|placeholderFormat"),
]


@query(f"select * from (values {_literal((n, m, e, t, x) for n, _, m, e, t, x in REQUEST_FORMS)}) r(name, mask, excluded, terms, errors)")
def request_forms(spark, sf_dir):
    rows = []
    for name, fields, *_ in REQUEST_FORMS:
        options, errors = parse_request(**bind_form(fields))
        rows.append((name, options and options.categories, "|".join(sorted(options.excluded)) if options else "", "|".join(options.terms) if options else "", "|".join(sorted(errors))))
    return spark.createDataFrame(rows, "name string, mask int, excluded string, terms string, errors string")


@query("select (c_custkey * 1234567)::bigint as n, format('{:,}', (c_custkey * 1234567)::bigint) as shown from customer")
def thousands_format(spark, sf_dir):
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 1234567).alias("n")).withColumn("shown", scalars.thousands(F.col("n")))


@query("select l_orderkey as id, l_linenumber as n, greatest(1.0::double, least(400.0::double, (l_quantity - 10) * 15)) as size from lineitem")
def point_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), scalars.clamped_point_size((F.col("l_quantity") - 10) * 15).alias("size"))


# --- span algebra ----------------------------------------------------------------------------------------------------

SPAN_KINDS = ("Date", "Iban", "PhoneNumber", "SocialSecurityNumber", "EmailAddress", "AccountNumber", "PersonName")


@query(
    f"""with s as (select l_orderkey as id, k.kind, k.priority, ((l_linenumber * 7 + l_partkey) % 40)::int as start, (l_quantity::int % 12 + 1)::int as length
      from lineitem join {KIND_SQL} on k.kind = [{", ".join(repr(k) for k in SPAN_KINDS)}][l_linenumber]),
    l as (select id, list([struct_pack(start := start, length := length, kind := kind)] order by -length, priority, start) as spans from s group by id),
    r as (select id, list_reduce(spans, lambda acc, x: case when len(list_filter(acc, lambda y: y.start < x[1].start + x[1].length and x[1].start < y.start + y.length)) > 0 then acc else list_concat(acc, x) end) as kept from l)
    select id, unnest(kept, recursive := true) from r"""
)
def resolve_overlaps(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in SPAN_KINDS]), F.col("l_linenumber"))
    start = ((F.col("l_linenumber") * 7 + F.col("l_partkey")) % 40).cast("int")
    one = F.struct(kind.alias("kind"), start.alias("start"), (F.rint("l_quantity").cast("int") % 12 + 1).cast("int").alias("length"), F.lit("").alias("text"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).cast(DETECTIONS).alias("d"))
    return rows.withColumn("d", resolve(F.col("d"))).select("id", F.explode("d").alias("s")).select("id", "s.start", "s.length", "s.kind")


CONTACTS = RedactionOptions(15, frozenset(k.name for k in catalog.KINDS) - {"EmailAddress", "IpAddress", "CreditCardNumber"})


PHONE_SQL = r"regexp_extract_all(' ' || text, '[^0-9+-](\+1 \(\d{3}\) \d{3}-\d{4})', 1)"
NPIS_SQL = f"list_filter(regexp_extract_all(text, '[0-9-]+'), lambda v: case when length(v) = 10 and regexp_full_match(v, '[0-9]+') then {NPI_SQL} else false end)"
#: Names that the documents hold stand behind a spelled-out title, two words at least.
NAMES_SQL = r"regexp_extract_all(text, '\bGeneral[ \t]+([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)+)', 1)"
FOUND_SQL = f"[{CARD_SQL}, {NPIS_SQL}, regexp_extract_all(text, '{EMAIL_RE}'), {PHONE_SQL}, {IP_SQL}, {NAMES_SQL}]"


@query(
    f"""with t0 as (select doc_id, text, {FOUND_SQL} as found from documents),
    t1 as (select doc_id, found, list_reduce([text] || found[1], lambda acc, x: replace(acc, x, '[CREDIT-CARD]')) as text from t0),
    t2 as (select doc_id, found, list_reduce([text] || found[2], lambda acc, x: replace(acc, x, '[NPI]')) as text from t1),
    t3 as (select doc_id, found, list_reduce([text] || found[3], lambda acc, x: replace(acc, x, '[EMAIL]')) as text from t2),
    t4 as (select doc_id, found, list_reduce([text] || found[4], lambda acc, x: replace(acc, x, '[PHONE]')) as text from t3),
    t5 as (select doc_id, found, list_reduce([text] || found[5], lambda acc, x: replace(acc, x, '[IP]')) as text from t4),
    t6 as (select doc_id, found, list_reduce([text] || found[6], lambda acc, x: replace(acc, x, '[NAME]')) as text from t5)
    select doc_id, text as redacted_text, len(flatten(found))::int as total from t6"""
)
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all kinds of all categories in every document."""
    return redact.redact(table(spark, sf_dir, "documents")).select("doc_id", "redacted_text", "total")


@query(
    rf"""with t as (select doc_id, text, len(regexp_extract_all(text, '{EMAIL_RE}')) + len({IP_SQL}) as total from documents)
    select doc_id, regexp_replace(regexp_replace(text, '{EMAIL_RE}', '[EMAIL]', 'g'), '(^|[^0-9.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}($|[^0-9.])', '\1[IP]\2', 'g') as redacted_text, total::int as total from t"""
)
def redact_contacts(spark, sf_dir):
    options = RedactionOptions(15, CONTACTS.excluded | {"CreditCardNumber"})
    return redact.redact(table(spark, sf_dir, "documents"), options=options).select("doc_id", "redacted_text", "total")


COUNTS_SQL = f"""(select doc_id, source, lang, unnest(['EmailAddress', 'IpAddress', 'CreditCardNumber']) as kind,
    unnest([len(regexp_extract_all(text, '{EMAIL_RE}')), len({IP_SQL}), len({CARD_SQL})]) as n from documents)"""


REPORT_JSON_SQL = f"""select doc_id, '{{"total":' || sum(n)::bigint || ',"counts":[' || coalesce(string_agg('{{"kind":"' || kind || '","count":' || n || '}}', ',' order by kind) filter (n > 0), '') || ']}}' as report
    from {COUNTS_SQL} group by doc_id"""


@query(f"select kind, sum(n)::bigint as n from {COUNTS_SQL} where n > 0 group by kind")
def report_by_kind(spark, sf_dir):
    return redact.long_report(redact.detect(table(spark, sf_dir, "documents"), options=CONTACTS), [])


@query(f"select source, lang, kind, sum(n)::bigint as n from {COUNTS_SQL} where n > 0 group by all")
def report_by_source(spark, sf_dir):
    return redact.long_report(redact.detect(table(spark, sf_dir, "documents"), options=CONTACTS), ["source", "lang"])


@query(
    f"""select kind, sum(n)::bigint as n from (select kind, n from {COUNTS_SQL} where n > 0
      union all select 'IpAddress', len({IP_SQL.replace("text", "html")}) from pages) group by kind having sum(n) > 0"""
)
def report_merge(spark, sf_dir):
    """The reports of two corpora: documents by source, and addresses in raw pages."""
    docs = redact.long_report(redact.detect(table(spark, sf_dir, "documents"), options=CONTACTS), ["source"])
    only_ip = RedactionOptions(15, frozenset(k.name for k in catalog.KINDS) - {"IpAddress"})
    pages = redact.long_report(redact.detect(table(spark, sf_dir, "pages"), "html", only_ip), [])
    return redact.merge_reports(docs.select("kind", "n").unionByName(pages))


@query(
    f"""select kind, source, n, place from (select kind, source, sum(n)::bigint as n, row_number() over (partition by kind order by sum(n) desc, source)::int as place
      from {COUNTS_SQL} where n > 0 group by kind, source) where place <= 3"""
)
def report_top_sources(spark, sf_dir):
    """The three sources with the most spans of each kind."""
    report = redact.long_report(redact.detect(table(spark, sf_dir, "documents"), options=CONTACTS), ["source"])
    return redact.top_rows(report, ["kind"], ["source"], 3)


@query("select doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{32,}')) as value from documents")
def own_registry(spark, sf_dir):
    """A registry with one detector of the caller's own; kinds without a detector are left out."""
    registry = {"AccountNumber": lambda text: find(text, "[0-9a-f]{32,}")}
    found = redact.detect(table(spark, sf_dir, "documents"), registry=registry)
    return found.select("doc_id", F.explode(values(F.col("detections"))).alias("value"))


CONTACT_REQUEST = {"categories": "pii,financial", "excluded": ";".join(sorted(CONTACTS.excluded - {"MedicalRecordNumber"}))}


@query("select category, unnest(string_split(kinds, ' ')) as kind from (values ('Financial', 'CreditCardNumber Iban BankRoutingNumber SwiftCode AccountNumber'), ('Confidential', 'ConfidentialStatement')) t(category, kinds)")
def route_categories(spark, sf_dir):
    return routes.categories(spark).where("category in ('Financial', 'Confidential')").select("category", F.explode("kinds").alias("kind"))


@query(REPORT_JSON_SQL)
def route_summary(spark, sf_dir):
    return routes.summary(table(spark, sf_dir, "documents").select("doc_id", "text"), CONTACT_REQUEST)


@query(
    rf"""with t as (select doc_id, text, {CARD_SQL} as cards from documents),
    u as (select doc_id, list_reduce([text] || cards, lambda acc, x: replace(acc, x, '[CREDIT-CARD]')) as text from t)
    select doc_id, regexp_replace(regexp_replace(text, '{EMAIL_RE}', '[EMAIL]', 'g'), '(^|[^0-9.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}($|[^0-9.])', '\1[IP]\2', 'g') as text from u"""
)
def route_redacted(spark, sf_dir):
    return routes.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), CONTACT_REQUEST).select("doc_id", "text")


@query("select * from (values ('none', 200), ('unsupported', 415), ('invalid', 422), ('empty', 422), ('too_large', 413), ('other', 400)) t(error, status)")
def status_codes(spark, sf_dir):
    errors = ["none", "unsupported", "invalid", "empty", "too_large", "other"]
    return spark.createDataFrame([(e, throughput.status_code(None if e == "none" else e)) for e in errors], "error string, status int")


# --- checksums and scalars -------------------------------------------------------------------------------------------


@query(f"select id, v as value, {LUHN_SQL} as valid from (select l_orderkey * 8 + l_linenumber as id, (l_orderkey * 8 + l_linenumber)::varchar as v from lineitem)")
def checksum_luhn(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return rows.withColumn("value", F.col("id").cast("string")).withColumn("valid", checksums.luhn(F.col("value")))


@query(f"select v as value, {NPI_SQL} as valid from (select lpad(o_orderkey::varchar, 10, '0') as v from orders)")
def checksum_npi(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(_padded("o_orderkey", 10).alias("value")).withColumn("valid", checksums.npi(F.col("value")))


@query(f"select v as value, {ABA_SQL} as valid from (select lpad((o_orderkey * 104729 % 1000000000)::varchar, 9, '0') as v from orders)")
def checksum_aba(spark, sf_dir):
    v = F.lpad((F.col("o_orderkey") * 104729 % 1000000000).cast("string"), 9, "0")
    return table(spark, sf_dir, "orders").select(v.alias("value")).withColumn("valid", checksums.aba(F.col("value")))


@query("select v as value, (v[5:22] || '1314' || v[3:4])::hugeint % 97 = 1 as valid from (select 'DE' || lpad((o_orderkey % 97)::varchar, 2, '0') || lpad(o_orderkey::varchar, 18, '0') as v from orders)")
def checksum_iban(spark, sf_dir):
    v = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), _padded("o_orderkey", 18))
    return table(spark, sf_dir, "orders").select(v.alias("value")).withColumn("valid", checksums.iban(F.col("value")))


@query(
    """with t as (select event_id, round_even(greatest(0, (value - 50) * 997.5), 0)::bigint as n from events)
    select event_id, case when n < 60 then n || 's' when n < 3600 then n // 60 || 'm ' || n % 60 || 's' when n < 86400 then n // 3600 || 'h ' || n % 3600 // 60 || 'm ' || n % 60 || 's'
    else n // 86400 || 'd ' || n % 86400 // 3600 || 'h ' || n % 3600 // 60 || 'm ' || n % 60 || 's' end as duration from t"""
)
def duration_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.format_duration((F.col("value") - 50) * 997.5).alias("duration"))


@query(
    """with t as (select event_id, user_id, ts, (event_id * 7919 % 50000000)::bigint as bytes, 0.5 + event_id % 10 as seconds from events),
    w as (select *, sum(bytes) over p as b, sum(seconds::double) over p as s from t window p as (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding))
    select event_id, greatest(1.0::double, bytes / (case when s > 0 and b > 0 then b::double / s else 2000000.0 end)::double) as estimate from w"""
)
def throughput_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") * 7919 % 50000000).alias("bytes"), (F.lit(0.5) + F.col("event_id") % 10).alias("seconds"))
    return throughput.estimates(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "estimate")


@query(
    """select event_id, (epoch_us(ts) // 600000000 * 600)::bigint as window_start, row_number() over (partition by event_type, epoch_us(ts) // 600000000 order by ts, event_id)::int as place,
    row_number() over (partition by event_type, epoch_us(ts) // 600000000 order by ts, event_id) <= 2 as allowed from events"""
)
def fixed_window_throttle(spark, sf_dir):
    out = throughput.throttle(table(spark, sf_dir, "events"), ["event_type"], "ts", ["event_id"], 2, 600)
    return out.select("event_id", "window_start", "place", "allowed")


FONTS = [("ABCDEF+TimesNewRomanPS", "serif"), ("Courier-Bold", "monospace"), ("NotoSansSerif", "sans-serif"), ("XYZ+SourceCodePro", "monospace"), ("Georgia", "serif"), ("Helvetica", "sans-serif"), ("", "sans-serif"), (None, "sans-serif")]


@query(f"select * from (values {_literal(FONTS)}) t(font, family)")
def font_family(spark, sf_dir):
    return spark.createDataFrame([(f,) for f, _ in FONTS], "font string").withColumn("family", scalars.font_family(F.col("font")))


@query(
    """select c_custkey as id, case when c_custkey % 37 = 0 and c_custkey % 41 = 20 then 0.0::double else
    (((round(-degrees(atan2((c_custkey % 41 - 20)::double, (c_custkey % 37)::double)), 3) % 360) + 360) % 360)::double end as angle from customer"""
)
def baseline_angle(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 37).cast("double").alias("x"), (F.col("c_custkey") % 41 - 20).cast("double").alias("y"))
    return rows.select("id", scalars.angle_degrees(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y")).alias("angle"))


SIZES = [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (26214400, "25 MB"), (1100000, "1 MB")]


@query(f"select * from (values {_literal(SIZES)}) t(n, size)")
def byte_format(spark, sf_dir):
    return spark.createDataFrame([(n,) for n, _ in SIZES], "n int").withColumn("size", scalars.format_bytes(F.col("n")))


LINKS = [("mailto:a%2Bb%40c.com", "mailto:a+b@c.com"), ("a+b%40c", "a+b@c"), ("50%", "50%"), ("plain", "plain")]


@query(f"select * from (values {_literal(LINKS)}) t(target, decoded)")
def link_decode(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in LINKS], "target string").withColumn("decoded", scalars.unescaped_link(F.col("target")))


UNSAFE = [("a\x01b", "a\ufffdb"), ("tab\tok", "tab\tok"), ("\x0bx\x1f", "\ufffdx\ufffd")]


@query(f"select * from (values {_literal(UNSAFE)}) t(text, safe)")
def xml_safe(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in UNSAFE], "text string").withColumn("safe", scalars.xml_safe(F.col("text")))


@query("select event_id, greatest(0.0, value - event_id % 60)::double as remaining from events")
def estimate_remaining(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.remaining(F.col("value"), (F.col("event_id") % 60).cast("double")).alias("remaining"))


@query(
    """with s as (select o_custkey as doc_id, o_orderkey as stream_id, ['FlateDecode', 'LZWDecode', 'RunLengthDecode', 'DCTDecode'][o_orderkey % 4 + 1] as filter, o_orderkey % 5000 as encoded_bytes from orders),
    b as (select *, encoded_bytes * case filter when 'FlateDecode' then 1032 when 'LZWDecode' then 2560 when 'RunLengthDecode' then 64 else 1 end as bound from s),
    r as (select *, sum(bound) over (partition by doc_id order by stream_id) as running from b)
    select doc_id, stream_id, bound, running::bigint as running_bytes, case when bound > 5000000 or running > 9000000 then 'too_large' else 'ok' end as status from r"""
)
def decode_limits(spark, sf_dir):
    filters = F.array(*[F.lit(x) for x in ("FlateDecode", "LZWDecode", "RunLengthDecode", "DCTDecode")])
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("stream_id"), F.get(filters, (F.col("o_orderkey") % 4).cast("int")).alias("filter"), (F.col("o_orderkey") % 5000).alias("encoded_bytes"))
    out = throughput.within_decode_limits(rows, throughput.DocumentLimits(5_000_000, 9_000_000))
    return out.select("doc_id", "stream_id", "bound", "running_bytes", "status")


@query(REPORT_JSON_SQL)
def report_json(spark, sf_dir):
    found = redact.detect(table(spark, sf_dir, "documents"), options=CONTACTS)
    return found.select("doc_id", redact.report_json(F.col("detections")).alias("report"))


@query(
    """select c_custkey as doc_id, field, case field when 'creator' then '[AUTHOR]' when 'title' then 'mail [EMAIL]' when 'Number' then 'c' || c_custkey || '@x.org' else 'for [EMAIL] only' end as new_value,
    case when field = 'Number' then 0 else 1 end as n from customer, (values ('creator'), ('title'), ('Note'), ('Number')) f(field)"""
)
def property_redaction(spark, sf_dir):
    mail = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    row = lambda scope, field, value, kind: F.struct(F.lit(scope).alias("scope"), F.lit(field).alias("field"), value.alias("value"), F.lit(kind).alias("type"))
    fields = F.array(row("core", "creator", F.col("c_name"), "lpwstr"), row("core", "title", F.concat(F.lit("mail "), mail), "lpwstr"), row("custom", "Note", F.concat(F.lit("for "), mail, F.lit(" only")), "lpwstr"), row("custom", "Number", mail, "i4"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(fields).alias("p")).select("doc_id", "p.*")
    options = RedactionOptions(15, CONTACTS.excluded - {"DocumentAuthor"})
    return segments.redact_properties(rows, options).select("doc_id", "field", "new_value", "n")


@query(
    """select c_nationkey::bigint as doc_id, count(*) || case when count(*) = 1 then ' embedded object stays' else ' embedded objects stay' end ||
    ' as before: files inside the package are not opened or redacted.' as warning from customer where c_custkey % 3 < 2 group by c_nationkey
    union all select c_nationkey, count(*) || case when count(*) = 1 then ' imported or diagram part stays' else ' imported or diagram parts stay' end ||
    ' as before: text of imports and diagrams is not redacted.' from customer where c_custkey % 3 = 2 and c_custkey % 30 = 2 group by c_nationkey"""
)
def package_warnings(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "embedded_object").when(k % 3 == 1, "embedded_package").when(k % 30 == 2, "diagram_data").otherwise("styles")
    return segments.warnings(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), kind.alias("part_type")))


# --- sources ---------------------------------------------------------------------------------------------------------

ROUTES = [("a.TXT", "application/pdf", "text"), ("b.docx", "", "word"), ("c", "application/pdf; q=1", "pdf"), ("d.bin", " Text/Plain ;x", "text"), ("e.bin", "image/png", None), ("log.md", None, "text")]


@query(f"select file_name, content_type, format from (values {_literal(ROUTES)}) t(file_name, content_type, format)")
def route_format(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in ROUTES], "file_name string, content_type string")
    return rows.withColumn("format", routing.format_of(F.col("file_name"), F.col("content_type")))


@query(
    f"""select file_name, content_type, 'No processor for ''' || seen || '''; known are .csv, .docx, .log, .md, .pdf, .text, .txt' as message
    from (values ('e.BIN', 'image/png', '.BIN'), ('noext', ' image/png ;q=1', 'image/png'), ('noext', null, 'unknown')) t(file_name, content_type, seen)"""
)
def route_errors(spark, sf_dir):
    rows = spark.createDataFrame([*[r[:2] for r in ROUTES], ("e.BIN", "image/png"), ("noext", " image/png ;q=1"), ("noext", None)], "file_name string, content_type string").where("file_name <> 'e.bin'")
    return rows.withColumn("message", routing.unsupported_message(F.col("file_name"), F.col("content_type"))).where("message is not null")


@query("select c_custkey as id, case when c_custkey % 5 = 0 then 'document' else c_name end || '-redacted' || case c_custkey % 3 when 0 then '.txt' when 1 then '.docx' else '.pdf' end as name from customer")
def output_name(spark, sf_dir):
    k = F.col("c_custkey")
    stem = F.when(k % 5 == 0, "").otherwise(F.col("c_name"))
    ext = F.when(k % 3 == 0, ".md").when(k % 3 == 1, ".docx").otherwise(".pdf")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("dir/"), stem, ext).alias("f"))
    return rows.select("id", routing.output_name(F.col("f"), routing.format_of(F.col("f"), F.lit(None).cast("string"))).alias("name"))


@query("select doc_id, ['UTF-8', 'UTF-8', 'UTF-16LE', 'UTF-16BE', 'UTF-32LE'][doc_id % 5 + 1] as encoding, doc_id % 5 <> 0 as has_bom, md5(text) as text_md5, true as round_trip from documents")
def text_encodings(spark, sf_dir):
    """Texts written with five kinds of marks, read back and written again."""
    k = (F.col("doc_id") % 5).cast("int")
    names = F.array(*[F.lit(n) for n in ("UTF-8", "UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32LE")])
    files = table(spark, sf_dir, "documents").select("doc_id", text_files.encoded(F.col("text"), F.get(names, k), k != 0).alias("content"))
    back = text_files.decoded(files)
    again = text_files.encoded(F.col("text"), F.col("encoding"), F.col("has_bom")) == F.col("content")
    return back.select("doc_id", "encoding", "has_bom", F.md5("text").alias("text_md5"), again.alias("round_trip"))


W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def sample_docx() -> bytes:
    """A small Word package: a name and a number broken over runs, a link, a header, tracked authors, properties."""
    body = (
        f'<w:document {W_NS}><w:body><w:p><w:r><w:t>Call Dr. Jane </w:t></w:r><w:r><w:t>Smith at 555-1</w:t></w:r><w:r><w:t>23-4567</w:t></w:r><w:r><w:tab/><w:t>today</w:t></w:r></w:p>'
        '<w:p><w:ins w:author="Ann Lee" w:initials="AL"><w:r><w:t>Nothing here</w:t></w:r></w:ins><w:del w:author="Bo"><w:r><w:delText>SSN 123-45-6789</w:delText></w:r></w:del></w:p></w:body></w:document>'
    )
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" TargetMode="External" Type="http://x/hyperlink" Target="mailto:a%40b.com"/></Relationships>'
    core = '<c:coreProperties xmlns:c="http://c" xmlns:d="http://d"><d:creator>Ann Lee</d:creator><d:title>For bob@x.org</d:title></c:coreProperties>'
    header = f"<w:hdr {W_NS}><w:p><w:r><w:t>Page of 10.0.0.1</w:t></w:r></w:p></w:hdr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("word/document.xml", body), ("word/_rels/document.xml.rels", rels), ("docProps/core.xml", core), ("word/header1.xml", header), ("word/embeddings/o1.bin", "x")):
            z.writestr(name, data)
    return out.getvalue()


def _word_files(spark) -> DataFrame:
    return spark.createDataFrame([("a.docx", bytearray(sample_docx())), ("broken.docx", bytearray(b"no zip"))], "path string, content binary")


def damaged_packages() -> list[tuple[str, bytes]]:
    """Files that are no package, cut off, without the main part, with a wrong checksum, and with a part that is no XML."""
    good = sample_docx()
    at = good.index(b"Nothing here")

    def one_part(name: str, data: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    return [("no_zip", b"no zip"), ("empty", b""), ("cut", good[: len(good) // 2]), ("no_main", one_part("word/other.xml", "<a/>")), ("checksum", good[:at] + b"X" + good[at + 1 :]), ("no_xml", one_part("word/document.xml", "<a><b></a>"))]


@query("select unnest(['no_zip', 'empty', 'cut', 'no_main', 'checksum', 'no_xml']) as doc_id, 'invalid' as error")
def word_errors(spark, sf_dir):
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in damaged_packages()], "path string, content binary")
    return docx.scan(files).select("doc_id", "error")


@query(
    """select * from (values ('a.docx', 'DocumentAuthor', 3), ('a.docx', 'EmailAddress', 2), ('a.docx', 'IpAddress', 1), ('a.docx', 'PersonName', 1),
    ('a.docx', 'PhoneNumber', 1), ('a.docx', 'SocialSecurityNumber', 1)) t(doc_id, kind, n)"""
)
def word_report(spark, sf_dir):
    return docx.redact_items(docx.scan(_word_files(spark)))[1].withColumn("n", F.col("n").cast("int"))


@query(
    """select * from (values ('a.docx', 'word/document.xml', 0, 0, 'Call Dr. [NAME]'), ('a.docx', 'word/document.xml', 0, 1, ' at [PHONE]'), ('a.docx', 'word/document.xml', 0, 2, ''),
    ('a.docx', 'word/document.xml', 0, 4, 'today'), ('a.docx', 'word/document.xml', 1, 0, 'Nothing here'), ('a.docx', 'word/document.xml', 1, 1, 'SSN [SSN]'),
    ('a.docx', 'word/header1.xml', 0, 0, 'Page of [IP]')) t(doc_id, part, para_id, seg_id, text)"""
)
def word_rewrite(spark, sf_dir):
    """Scan, redact, write, and scan what was written."""
    files = _word_files(spark).where("path = 'a.docx'")
    edits, _ = docx.redact_items(docx.scan(files))
    return docx.scan(docx.rewrite(files, edits)).where("kind = 'segment'").select("doc_id", "part", "para_id", "seg_id", "text")


# --- layout blocks ---------------------------------------------------------------------------------------------------

GLYPH = "doc_id long, page int, block int, line int, word int, glyph int, text string, left double, right double, top double, bottom double, base_x double, base_y double, end_x double, end_y double, point_size double, bold boolean, italic boolean, family string, angle double"


def _glyphs(spark, sf_dir) -> DataFrame:
    """A block of two lines for each customer: `Mail c<key>@x.org now` and `ip 10.0.0.1`; each glyph is 6 points wide."""
    lines = F.array(F.concat(F.lit("Mail c"), F.col("c_custkey").cast("string"), F.lit("@x.org now")), F.lit("ip 10.0.0.1"))
    words = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("line", "l")).select("doc_id", "line", F.posexplode(F.split("l", " ")).alias("word", "w"), "l")
    before = F.length(F.concat_ws(" ", F.slice(F.split("l", " "), F.lit(1), F.col("word")))) + F.when(F.col("word") > 0, 1).otherwise(0)
    g = words.select("doc_id", "line", "word", before.alias("before"), F.posexplode(F.filter(F.split("w", ""), lambda c: c != "")).alias("glyph", "text"))
    x, y = (F.col("before") + F.col("glyph")) * 6.0, 700.0 - F.col("line") * 14.0
    return g.select(
        "doc_id", F.lit(1).alias("page"), F.lit(0).alias("block"), "line", "word", "glyph", "text", x.alias("left"), (x + 6).alias("right"), (y + 9).alias("top"), (y - 2).alias("bottom"),
        x.alias("base_x"), y.alias("base_y"), (x + 6).alias("end_x"), y.alias("end_y"), F.lit(11.0).alias("point_size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("serif").alias("family"), F.lit(0.0).alias("angle"),
    )


def _block_parts(spark, sf_dir):
    glyphs = blocks.with_offsets(_glyphs(spark, sf_dir))
    found = blocks.detect_blocks(blocks.block_texts(glyphs), CONTACTS)
    return glyphs, blocks.flat_detections(found)


@query("select c_custkey as doc_id, 'Mail c' || c_custkey || '@x.org now' || chr(10) || 'ip 10.0.0.1' as text from customer")
def block_text(spark, sf_dir):
    return blocks.block_texts(_glyphs(spark, sf_dir)).select("doc_id", "text")


@query(
    """select c_custkey as doc_id, line, kind, l * 6.0 - 0.5 as "left", r * 6.0 + 0.5 as "right", label, least(11.0, ((r - l) * 6.0 - 1.0) / (0.72 * length(label))) as label_size
    from (select c_custkey, 0 as line, 'EmailAddress' as kind, 5 as l, 12 + length(c_custkey::varchar) as r, ' [EMAIL] ' as label from customer
      union all select c_custkey, 1, 'IpAddress', 3, 11, ' [IP] ' from customer)"""
)
def glyph_boxes(spark, sf_dir):
    glyphs, found = _block_parts(spark, sf_dir)
    return blocks.redaction_boxes(glyphs, found, CONTACTS).select("doc_id", "line", "kind", "left", "right", "label", "label_size")


@query("select c_custkey as doc_id, l as line, t as text from customer, (values (0, 'Mail '), (0, 'now '), (1, 'ip ')) v(l, t)")
def text_runs(spark, sf_dir):
    glyphs, found = _block_parts(spark, sf_dir)
    return blocks.text_runs(glyphs, found).select("doc_id", "line", "text")


def _sql_number(x: str) -> str:
    return f"regexp_replace(printf('%.3f', ({x})::double), '\\.?0+$', '')"


def _sql_text(x: str, y: str, size: str, family: str, fill: str, text: str) -> str:
    tail = f"font-family=\"{family}\" fill=\"{fill}\" xml:space=\"preserve\">"
    return f"'<text x=\"' || {_sql_number(x)} || '\" y=\"' || {_sql_number(y)} || '\" font-size=\"' || {_sql_number(size)} || '\" {tail}' || {text} || '</text>'"


@query(
    f"""with c as (select c_custkey as id, length(c_custkey::varchar) as l from customer),
    runs as (select id, unnest([{{'a': 0, 't': 'Mail ', 'y': 92}}, {{'a': 13 + l, 't': 'now ', 'y': 92}}, {{'a': 0, 't': 'ip ', 'y': 106}}]) as r from c),
    drawn as (select id, r.y as y, r.a + i as o, {_sql_text("(r.a + i) * 6", "r.y", "11", "serif", "black", "r.t[i + 1]")} as e from runs, range(5) g(i) where i < length(r.t)),
    boxes as (select id, unnest([{{'a': 5, 'n': 7 + l, 'y': 92, 't': ' [EMAIL] '}}, {{'a': 3, 'n': 8, 'y': 106, 't': ' [IP] '}}]) as b from c),
    covers as (select id, 1000 + b.y as y, 0 as o, '<rect x="' || {_sql_number("b.a * 6 - 0.5")} || '" y="' || {_sql_number("b.y - 9.5")} || '" width="' || {_sql_number("b.n * 6 + 1")} || '" height="12" fill="black" />' ||
      {_sql_text("b.a * 6", "b.y", "least(11.0, (b.n * 6.0 - 1.0) / (0.72 * length(b.t)))", "sans-serif", "white", "b.t")} as e from boxes),
    parts as (select * from drawn union all select * from covers)
    select id as doc_id, '<svg xmlns="http://www.w3.org/2000/svg" width="612" height="792" viewBox="0 0 612 792">' || string_agg(e, '' order by y, o) || '</svg>' as svg from parts group by id"""
)
def page_svg(spark, sf_dir):
    """Runs and boxes both read the detections, which are settled so that the detectors run once and the plan stays small."""
    glyphs, found = _block_parts(spark, sf_dir)
    found = settle(found, "spans")
    pages = glyphs.select("doc_id", "page").distinct().withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    return blocks.page_svg(pages, blocks.text_runs(glyphs, found), blocks.redaction_boxes(glyphs, found, CONTACTS)).select("doc_id", "svg")


@query(
    rf"""with k as (select c_custkey as doc_id, lpad((c_custkey % 10000)::varchar, 4, '0') as t from customer),
    cards as (select doc_id, t, '411111111111' || t as v from k)
    select doc_id, 'CreditCardNumber' as kind, 5 as start, '4111 1111 1111' || chr(10) || t as value from cards where {LUHN_SQL}
    union all select doc_id, 'SocialSecurityNumber', 28, '212 45' || chr(10) || t from k where t <> '0000'"""
)
def block_two_pass(spark, sf_dir):
    """A card and a social security number broken over lines, where their patterns want a blank: the second pass alone finds them."""
    last = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("card 4111 1111 1111\n"), last, F.lit(" or 212 45\n"), last, F.lit(" now"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    options = RedactionOptions(15, frozenset(k.name for k in catalog.KINDS) - {"CreditCardNumber", "SocialSecurityNumber"})
    found = blocks.detect_blocks(rows, options).select("doc_id", "text", F.explode("detections").alias("d"))
    return found.select("doc_id", "d.kind", "d.start", F.substr("text", F.col("d.start") + 1, F.col("d.length")).alias("value"))


@query(
    """with s as (select l_orderkey as id, l_linenumber as n, ((l_partkey * 13) % 60)::int as a, ((l_partkey * 13) % 60 + l_quantity::int % 9 + 1)::int as z, l_linenumber <= 2 as s from lineitem),
    m as (select *, max(z) over (partition by id order by a, z, s rows between unbounded preceding and 1 preceding) as seen from s),
    g as (select *, sum(case when seen is null or a >= seen then 1 else 0 end) over (partition by id order by a, z, s rows unbounded preceding) as island from m)
    select id, min(a)::int as start, (max(z) - min(a))::int as length from g group by id, island having bool_or(s)"""
)
def widen_sentences(spark, sf_dir):
    start = ((F.col("l_partkey") * 13) % 60).cast("int")
    kind = F.when(F.col("l_linenumber") <= 2, "ConfidentialStatement").otherwise("PhoneNumber")
    one = F.struct(kind.alias("kind"), start.alias("start"), (F.rint("l_quantity").cast("int") % 9 + 1).cast("int").alias("length"), F.lit("").alias("text"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).cast(DETECTIONS).alias("d"))
    is_sentence = lambda d: d["kind"] == "ConfidentialStatement"
    wide = blocks.widened(F.filter("d", is_sentence), F.filter("d", lambda d: ~is_sentence(d)), F.lit(""))
    return rows.select("id", F.explode(wide).alias("s")).select("id", "s.start", "s.length")


@query(
    """select o_orderkey as id, seg_id, case seg_id when 0 then 'to [EMAIL]' when 1 then '' else ' ok ' || o_orderkey end as new_text, seg_id < 2 as changed
    from orders, (values (0), (1), (2)) s(seg_id)"""
)
def segment_splice(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    parts = F.array(F.concat(F.lit("to a"), key), F.lit("@b.com"), F.concat(F.lit(" ok "), key))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parts.alias("p"))
    starts = F.transform("p", lambda x, i: F.length(F.array_join(F.slice("p", F.lit(1), i), "")))
    seg = rows.select("id", F.posexplode(F.arrays_zip(F.col("p").alias("t"), starts.alias("s"))).alias("seg_id", "x")).select("id", "seg_id", F.col("x.t").alias("text"), F.col("x.s").alias("start"))
    seg = seg.withColumn("length", F.length("text"))
    found = redact.detect(rows.select("id", F.array_join("p", "").alias("text")), options=CONTACTS)
    spans = found.select("id", F.explode("detections").alias("d")).select("id", "d.kind", F.col("d.start").alias("d_start"), F.col("d.length").alias("d_length"))
    return segments.splice(seg, spans, ["id"], CONTACTS).select("id", "seg_id", "new_text", "changed")


@query("select doc_id, page, sum(n) over (partition by doc_id order by page) as running_chars, case when sum(n) over (partition by doc_id order by page) > 9000 then 'too_much_text' else 'ok' end as status from (select c_nationkey::bigint as doc_id, c_custkey as page, (c_custkey % 100)::bigint as n from customer)")
def page_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").alias("page"), (F.col("c_custkey") % 100).alias("chars"))
    return blocks.within_page_limits(rows, 100_000, 9000).select("doc_id", "page", "running_chars", "status")


# --- streaming -------------------------------------------------------------------------------------------------------


@query(f"select kind, sum(n)::bigint as n from {COUNTS_SQL} where n > 0 group by kind")
def stream_report(spark, sf_dir):
    """Documents read as a stream, redacted, written as Parquet to the shared folder by an available-now trigger, and counted."""
    schema = table(spark, sf_dir, "documents").schema
    path = f"{shared_folder(spark)}/spanloom-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{sf_dir}/documents.parquet*")
    out = redact_stream(stream, options=CONTACTS).select("doc_id", "detections", "redacted_text")
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return redact.long_report(spark.read.parquet(f"{path}/out"), [])


@query(
    f"""with c as (select doc_id, (doc_id % 1440) // 10 * 10 as minute, len({IP_SQL}) as n from documents)
    select strftime(timestamp '2024-01-01' + to_minutes(minute::int), '%Y-%m-%d %H:%M') as window_start, 'IpAddress' as kind, sum(n)::bigint as n from c where n > 0 group by all"""
)
def stream_windowed_report(spark, sf_dir):
    """Documents as a stream, each with a time by rule, counted by kind in windows of ten minutes behind a watermark of two days."""
    schema = table(spark, sf_dir, "documents").schema
    path = f"{shared_folder(spark)}/spanloom-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{sf_dir}/documents.parquet*")
    timed = stream.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(1440)) * 60))
    only_ip = RedactionOptions(15, frozenset(k.name for k in catalog.KINDS) - {"IpAddress"})
    report = windowed_report(redact_stream(timed, options=only_ip), "ts", "10 minutes", "2 days")
    # Complete tables go to the shared folder batch by batch; the last one has all windows.
    run = report.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
    run.start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "kind", "n")
