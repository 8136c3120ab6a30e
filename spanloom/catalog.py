"""The kinds of sensitive spans: labels, categories and priorities, as Python data and as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PII, HIPAA, FINANCIAL, CONFIDENTIAL = 1, 2, 4, 8
CATEGORIES = {"Pii": PII, "Hipaa": HIPAA, "Financial": FINANCIAL, "Confidential": CONFIDENTIAL}


@dataclass(frozen=True)
class Kind:
    priority: int
    name: str
    label: str
    categories: int
    widens: bool = False
    metadata_only: bool = False


#: Of two spans of one length the lower priority number wins.
KINDS = (
    Kind(10, "CreditCardNumber", "CREDIT-CARD", FINANCIAL),
    Kind(20, "Iban", "IBAN", FINANCIAL),
    Kind(30, "NationalProviderId", "NPI", HIPAA),
    Kind(40, "DeaNumber", "DEA", HIPAA),
    Kind(50, "BankRoutingNumber", "ROUTING-NUMBER", FINANCIAL),
    Kind(60, "SocialSecurityNumber", "SSN", PII | HIPAA),
    Kind(70, "CustomTerm", "CUSTOM", 0),
    Kind(80, "EmailAddress", "EMAIL", PII | HIPAA),
    Kind(90, "SwiftCode", "SWIFT", FINANCIAL),
    Kind(100, "MedicalRecordNumber", "MRN", HIPAA),
    Kind(110, "HealthPlanId", "HEALTH-PLAN-ID", HIPAA),
    Kind(120, "PassportNumber", "PASSPORT", PII | HIPAA),
    Kind(130, "DriversLicenseNumber", "DRIVERS-LICENSE", PII | HIPAA),
    Kind(140, "AccountNumber", "ACCOUNT-NUMBER", FINANCIAL),
    Kind(150, "PhoneNumber", "PHONE", PII | HIPAA),
    Kind(160, "IpAddress", "IP", PII | HIPAA),
    Kind(170, "StreetAddress", "ADDRESS", PII | HIPAA),
    Kind(180, "Date", "DATE", HIPAA),
    Kind(185, "PersonName", "NAME", PII | HIPAA),
    Kind(190, "ConfidentialStatement", "CONFIDENTIAL", CONFIDENTIAL, widens=True),
    Kind(200, "DocumentAuthor", "AUTHOR", PII | HIPAA, metadata_only=True),
)
BY_NAME = {k.name: k for k in KINDS}
SENTENCE_KINDS = frozenset(k.name for k in KINDS if k.widens)
METADATA_KINDS = frozenset(k.name for k in KINDS if k.metadata_only)


def kind_catalog(spark: SparkSession) -> DataFrame:
    """One row for each kind, by priority."""
    rows = [(k.priority, k.name, k.label, k.categories, k.widens, k.metadata_only) for k in KINDS]
    return spark.createDataFrame(rows, "priority int, kind string, label string, categories int, widens boolean, metadata_only boolean")


#: Kinds by their numbers in requests.
NUMBERED = (
    "SocialSecurityNumber", "EmailAddress", "PhoneNumber", "IpAddress", "PassportNumber", "DriversLicenseNumber", "StreetAddress",
    "MedicalRecordNumber", "HealthPlanId", "NationalProviderId", "DeaNumber", "Date", "CreditCardNumber", "BankRoutingNumber", "Iban",
    "SwiftCode", "AccountNumber", "ConfidentialStatement", "CustomTerm", "DocumentAuthor", "PersonName",
)


def parse_category(text: str) -> int | None:
    """The mask of a category's name, or of `all`, in any case; None if there is no such category."""
    name = text.strip().lower()
    if name == "all":
        return PII | HIPAA | FINANCIAL | CONFIDENTIAL
    return {"hipaa / phi": HIPAA, **{k.lower(): v for k, v in CATEGORIES.items()}}.get(name)


def parse_kind(text: str) -> str | None:
    """A kind by its name in any case, or by its number; None if there is no such kind."""
    name = text.strip()
    if name.lstrip("+-").isascii() and name.lstrip("+-").isdigit() and len(name) - len(name.lstrip("+-")) <= 1:
        return NUMBERED[int(name)] if 0 <= int(name) < len(NUMBERED) else None
    return {k.lower(): k for k in BY_NAME}.get(name.lower())
