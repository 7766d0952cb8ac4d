"""Masking of personal data in text by audience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.luhn import luhn_valid

CARD = r"\b(?:[0-9][ -]?){12,15}[0-9]\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\b"


def mask_cards(text: Column, tag: str) -> Column:
    """Replace card numbers that pass the checksum; other long numbers stay."""
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    between = F.split(text, CARD)
    masked = F.zip_with(between, found, lambda gap, m: F.concat(
        gap, F.when(m.isNull(), "").when(luhn_valid(m), tag).otherwise(m)))
    return F.when(text.rlike(CARD), F.array_join(masked, "")).otherwise(text)


def mask_pii(text: Column, audience: str = "internal") -> Column:
    """internal: cards and SSN; restricted: everything as [REDACTED]; public: everything as typed tags."""
    redact = audience == "restricted"
    tag = (lambda name: "[REDACTED]") if redact else (lambda name: f"<{name}>")
    out = mask_cards(text, tag("CREDIT_CARD"))
    out = F.regexp_replace(out, SSN, tag("SSN"))
    if audience != "internal":
        out = F.regexp_replace(out, EMAIL, tag("EMAIL_ADDRESS"))
        out = F.regexp_replace(out, PHONE, tag("PHONE_NUMBER"))
    return out
