"""Label ontology: native labels to gateway types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNMAPPED = "UNMAPPED"

# The default ontology, in the order of the labels.
ONTOLOGY = {
    "account_number": "BANK_ACCOUNT", "age": "UNMAPPED", "api_key": "UNMAPPED", "bank_routing_number": "BANK_ACCOUNT", "biometric_identifier": "UNMAPPED",
    "blood_type": "UNMAPPED", "certificate_license_number": "UNMAPPED", "city": "LOCATION", "company_name": "ORGANIZATION", "coordinate": "LOCATION",
    "country": "LOCATION", "county": "LOCATION", "credit_debit_card": "CREDIT_CARD", "customer_id": "ID_CARD", "cvv": "CREDIT_CARD", "date": "DATE",
    "date_of_birth": "DATE", "date_time": "DATE", "device_identifier": "UNMAPPED", "education_level": "UNMAPPED", "email": "EMAIL_ADDRESS",
    "employee_id": "ID_CARD", "employment_status": "UNMAPPED", "fax_number": "PHONE_NUMBER", "first_name": "PERSON", "gender": "UNMAPPED",
    "health_plan_beneficiary_number": "SOCIAL_IDENTIFIER", "http_cookie": "UNMAPPED", "ipv4": "IP_ADDRESS", "ipv6": "IP_ADDRESS", "language": "UNMAPPED",
    "last_name": "PERSON", "license_plate": "UNMAPPED", "mac_address": "UNMAPPED", "medical_record_number": "SOCIAL_IDENTIFIER", "national_id": "ID_CARD",
    "occupation": "UNMAPPED", "password": "UNMAPPED", "phone_number": "PHONE_NUMBER", "pin": "UNMAPPED", "political_view": "UNMAPPED", "postcode": "ADDRESS",
    "race_ethnicity": "UNMAPPED", "religious_belief": "UNMAPPED", "sexuality": "UNMAPPED", "ssn": "SOCIAL_IDENTIFIER", "state": "LOCATION",
    "street_address": "ADDRESS", "swift_bic": "BANK_ACCOUNT", "tax_id": "SOCIAL_IDENTIFIER", "time": "TIME", "unique_id": "UNMAPPED", "url": "UNMAPPED",
    "user_name": "USERNAME", "vehicle_identifier": "UNMAPPED",
}
# The types that detectors emit directly, and the evaluation's merge of date and time.
SUPPORTED = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "DATE_TIME", "IP_ADDRESS", "CREDIT_CARD")
EVALUATION_TYPES = {"DATE": "DATE_TIME", "TIME": "DATE_TIME"}
LABEL = re.compile(r"[a-z][a-z0-9_]{0,63}")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def gateway_type(label: Column, ontology: dict[str, str] = ONTOLOGY, on_unknown: str = "unmapped") -> Column:
    """Type of a native label. Unknown labels become UNMAPPED, or fail the query without echoing the label (``on_unknown='error'``)."""
    found = F.element_at(literal_map(ontology), label) if ontology else F.lit(None).cast("string")
    if on_unknown == "error":
        return F.coalesce(found, F.when(label.isNull(), F.lit(UNMAPPED)).otherwise(F.raise_error(F.lit("a label is missing from the ontology")).cast("string")))
    return F.coalesce(found, F.lit(UNMAPPED))


def evaluation_type(entity_type: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(EVALUATION_TYPES), entity_type), entity_type)


def adapter_category(entity_type: Column) -> Column:
    """Why a type can be found or not: unmapped label, merged date or time, emitted directly, or not supported."""
    return (
        F.when(entity_type == UNMAPPED, "unmapped_source_label").when(entity_type.isin(*EVALUATION_TYPES), "adapter_mapped_date_time")
        .when(entity_type.isin(*SUPPORTED), "supported_direct").otherwise("unsupported_entity")
    )


def ontology_table(spark: SparkSession, ontology: dict[str, str] = ONTOLOGY) -> DataFrame:
    """The ontology as a dimension: a few dozen rows, safe to broadcast."""
    return spark.createDataFrame(sorted(ontology.items()), "label string, gateway_type string")


def parse_ontology(text: str) -> dict[str, str]:
    """Read ``labels:`` of a YAML ontology; duplicate, empty or malformed entries are errors."""
    found: dict[str, str] = {}
    inside = False
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.split("#", 1)[0].rstrip()
        if not bare:
            continue
        if not bare.startswith((" ", "\t")):
            inside = bare.strip() == "labels:"
            continue
        if not inside:
            continue
        key, colon, value = bare.strip().partition(":")
        key, value = key.strip().strip("'\""), value.strip().strip("'\"")
        if not colon or not LABEL.fullmatch(key) or not re.fullmatch(r"[A-Z][A-Z0-9_]{0,63}", value) or key in found:
            raise ValueError(f"ontology line {number} is invalid")
        found[key] = value
    if not found:
        raise ValueError("the ontology has no labels")
    return found
