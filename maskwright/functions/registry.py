"""Types, sources and reasons of the engine."""

from __future__ import annotations

# The canonical type names.
TYPES = (
    "FULL_NAME", "FIRST_NAME", "LAST_NAME", "MIDDLE_NAME", "BIRTH_DATE", "BIRTH_PLACE", "PASSPORT_NUMBER", "CITIZENSHIP", "PASSPORT_ISSUER", "PASSPORT_DIVISION_CODE",
    "PASSPORT_ISSUE_DATE", "DRIVER_LICENSE_NUMBER", "ADDRESS", "ADDRESS_COUNTRY", "ADDRESS_POSTAL_CODE", "ADDRESS_REGION", "ADDRESS_CITY", "ADDRESS_STREET", "ADDRESS_HOUSE",
    "ADDRESS_BUILDING", "ADDRESS_APARTMENT", "EMAIL", "PHONE", "INN_PERSON", "BANK_CARD_NUMBER", "CARD_CVV", "CARD_PIN", "CARDHOLDER_NAME",
)
INTERMEDIATE = ("DATE", "LOCATION")  # promoted or dropped by context, never a result
SOURCES = ("rubert", "gliner", "regex", "validator")
ADDRESS_PARTS = ("ADDRESS_COUNTRY", "ADDRESS_POSTAL_CODE", "ADDRESS_REGION", "ADDRESS_CITY", "ADDRESS_STREET", "ADDRESS_HOUSE", "ADDRESS_BUILDING", "ADDRESS_APARTMENT")
NAME_TYPES = ("FULL_NAME", "FIRST_NAME", "LAST_NAME", "MIDDLE_NAME")
LINKED_TYPES = ("PASSPORT_NUMBER", "PHONE", "EMAIL", "BIRTH_DATE")
LABELLED_TYPES = ("PHONE", "EMAIL")
HIGH_RISK_TYPES = (
    "EMAIL", "PHONE", "PASSPORT_NUMBER", "PASSPORT_DIVISION_CODE", "PASSPORT_ISSUE_DATE", "PASSPORT_ISSUER", "DRIVER_LICENSE_NUMBER", "INN_PERSON", "BANK_CARD_NUMBER", "CARD_CVV", "CARD_PIN",
    "CARDHOLDER_NAME", "CITIZENSHIP",
)
REASONS = (
    "client_context", "passport_context", "positive_context", "linked_entities", "field_label", "organization_context", "public_context", "ambiguous_context", "type_disabled_by_policy",
)
REASON_SCORES = {"client_context": 0.9, "passport_context": 0.9, "positive_context": 0.9, "linked_entities": 0.8, "field_label": 0.7}
# Fixed values: (model, label) -> type.
MODEL_LABELS = {
    ("rubert", "FIRST_NAME"): "FIRST_NAME", ("rubert", "LAST_NAME"): "LAST_NAME", ("rubert", "MIDDLE_NAME"): "MIDDLE_NAME", ("rubert", "EMAIL"): "EMAIL", ("rubert", "PHONE"): "PHONE",
    ("rubert", "COUNTRY"): "ADDRESS_COUNTRY", ("rubert", "REGION"): "ADDRESS_REGION", ("rubert", "DISTRICT"): "ADDRESS_REGION", ("rubert", "CITY"): "ADDRESS_CITY",
    ("rubert", "STREET"): "ADDRESS_STREET", ("rubert", "HOUSE"): "ADDRESS_HOUSE", ("gliner", "ru_pii_person"): "FULL_NAME", ("gliner", "ru_pii_phone"): "PHONE",
    ("gliner", "ru_pii_email"): "EMAIL", ("gliner", "ru_pii_location"): "LOCATION", ("gliner", "ru_pii_date"): "DATE",
}
# Labels that count only where a rule has validated the same span.
DOCUMENT_LABELS = {"PASSPORT": "PASSPORT_NUMBER", "INN": "INN_PERSON", "CREDIT_CARD": "BANK_CARD_NUMBER", "DRIVER_LICENSE": "DRIVER_LICENSE_NUMBER"}


def extended(*extra: str) -> tuple[str, ...]:
    """The canonical types and more of one's own; names are upper case and new."""
    for name in extra:
        if not name or not name.replace("_", "").isalnum() or name != name.upper() or not name[0].isalpha():
            raise ValueError(f"{name!r} is no name of a type")
        if name in TYPES or name in INTERMEDIATE or extra.count(name) > 1:
            raise ValueError(f"{name} is there already")
    return (*TYPES, *extra)
