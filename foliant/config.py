"""Configuration tables: document schemas, keyword lists, rule sets and thresholds.

All tables here are small and of fixed size. Operators read them on the driver and compile them
into column expressions, or turn them into literal frames that Spark broadcasts by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FieldSpec:
    name: str
    field_type: str = "text"
    required: bool = False
    threshold: float = 0.7
    synonyms: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    default: str | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    field_type: str = "text"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    min_rows: int = 0
    max_rows: int = 1000
    header_required: bool = True


@dataclass(frozen=True)
class DocSchema:
    document_type: str
    required_confidence: float = 0.8
    fields: tuple[FieldSpec, ...] = ()
    tables: tuple[TableSpec, ...] = ()
    business_rules: tuple[str, ...] = field(default_factory=tuple)


def _f(name, field_type, required=False, threshold=0.7, synonyms=(), rules=()):
    return FieldSpec(name, field_type, required, threshold, tuple(synonyms), tuple(rules))


def _cols(*pairs):
    return tuple(ColumnSpec(n, t) for n, t in pairs)


# Document schemas.
INVOICE = DocSchema(
    "invoice", 0.8,
    (
        _f("invoice_number", "text", True, 0.9, ["invoice #", "inv #", "invoice id", "bill number"], ["not_empty", "alphanumeric"]),
        _f("vendor_name", "text", True, 0.8, ["from", "bill from", "seller", "company"], ["not_empty", "min_length:2"]),
        _f("invoice_date", "date", True, 0.8, ["date", "bill date", "invoice dt"], ["valid_date", "past_date"]),
        _f("due_date", "date", False, 0.7, ["payment due", "due", "pay by"], ["valid_date", "future_date_from_invoice"]),
        _f("total_amount", "currency", True, 0.9, ["total", "amount due", "balance", "grand total"], ["positive_amount", "currency_format"]),
        _f("subtotal", "currency", False, 0.7, ["sub total", "net amount", "before tax"], ["positive_amount"]),
        _f("tax_amount", "currency", False, 0.7, ["tax", "vat", "sales tax", "gst"], ["non_negative_amount"]),
        _f("customer_name", "text", False, 0.7, ["bill to", "customer", "client", "buyer"], ["not_empty"]),
    ),
    (TableSpec("line_items", _cols(("description", "text"), ("quantity", "number"), ("unit_price", "currency"), ("amount", "currency")), 1),),
    ("total_equals_subtotal_plus_tax", "due_date_after_invoice_date", "line_items_sum_to_subtotal"),
)
RECEIPT = DocSchema(
    "receipt", 0.7,
    (
        _f("merchant_name", "text", True, 0.8, ["store", "retailer", "shop"], ["not_empty"]),
        _f("transaction_date", "date", True, 0.8, ["date", "purchase date", "trans date"], ["valid_date", "past_date"]),
        _f("total_amount", "currency", True, 0.9, ["total", "amount", "grand total"], ["positive_amount"]),
        _f("payment_method", "text", False, 0.7, ["payment", "paid by", "method"], ["valid_payment_method"]),
    ),
    (TableSpec("items", _cols(("item_name", "text"), ("price", "currency")), 1, header_required=False),),
    ("items_sum_to_total",),
)
CONTRACT = DocSchema(
    "contract", 0.8,
    (
        _f("contract_title", "text", False, 0.7, ["title", "agreement title", "contract name"], ["not_empty"]),
        _f("parties", "text", True, 0.8, ["between", "party", "contracting parties", "signatories"], ["not_empty", "min_length:5"]),
        _f("contract_date", "date", True, 0.8, ["date", "effective date", "execution date", "signed on"], ["valid_date"]),
        _f("effective_date", "date", False, 0.7, ["starts on", "begins", "commences"], ["valid_date"]),
        _f("expiration_date", "date", False, 0.7, ["expires", "ends", "termination date", "until"], ["valid_date", "after_effective_date"]),
        _f("contract_value", "currency", False, 0.7, ["amount", "value", "consideration", "payment"], ["positive_amount"]),
        _f("terms", "text", False, 0.7, ["conditions", "provisions", "clauses"], ["not_empty"]),
        _f("signatures", "text", False, 0.7, ["signed by", "signature", "executed by"], ["not_empty"]),
        _f("governing_law", "text", False, 0.7, ["jurisdiction", "governed by", "applicable law"], ["not_empty"]),
    ),
    (),
    ("expiration_after_effective_date", "parties_must_be_identified", "signatures_match_parties"),
)
ID_DOCUMENT = DocSchema(
    "id_document", 0.9,
    (
        _f("document_type", "text", False, 0.8, ["type", "document", "id type"], ["not_empty"]),
        _f("first_name", "text", True, 0.9, ["given name", "first", "name"], ["not_empty", "alphabetic"]),
        _f("last_name", "text", True, 0.9, ["surname", "family name", "last"], ["not_empty", "alphabetic"]),
        _f("middle_name", "text", False, 0.7, ["middle", "middle initial"], ["alphabetic"]),
        _f("document_number", "text", True, 0.9, ["id number", "license number", "passport number", "number"], ["not_empty", "alphanumeric"]),
        _f("date_of_birth", "date", True, 0.9, ["dob", "birth date", "born"], ["valid_date", "past_date", "reasonable_age"]),
        _f("issue_date", "date", False, 0.7, ["issued", "date issued", "issued on"], ["valid_date", "past_date"]),
        _f("expiration_date", "date", False, 0.7, ["expires", "exp", "expiry", "valid until"], ["valid_date", "future_date"]),
        _f("address", "text", False, 0.7, ["addr", "residence", "home address"], ["not_empty", "min_length:10"]),
        _f("gender", "text", False, 0.7, ["sex", "m/f"], ["valid_gender"]),
        _f("height", "text", False, 0.7, ["ht", "hgt"], ["valid_height"]),
        _f("weight", "text", False, 0.7, ["wt", "wgt"], ["valid_weight"]),
        _f("eye_color", "text", False, 0.7, ["eyes", "eye"], ["valid_eye_color"]),
        _f("nationality", "text", False, 0.7, ["country of origin", "citizenship"], ["not_empty"]),
    ),
    (),
    ("expiration_after_issue_date", "reasonable_age_range", "required_fields_present"),
)
GENERAL_DOCUMENT = DocSchema(
    "general_document", 0.6,
    (
        _f("document_title", "text", False, 0.7, ["title", "subject", "heading"], ["not_empty"]),
        _f("document_date", "date", False, 0.7, ["date", "created", "dated"], ["valid_date"]),
        _f("author", "text", False, 0.7, ["by", "from", "prepared by", "written by"], ["not_empty"]),
        _f("content", "text", True, 0.6, ["text", "body", "content"], ["not_empty", "min_length:50"]),
        _f("pages", "number", False, 0.7, ["page count", "total pages", "number of pages"], ["positive_number"]),
        _f("language", "text", False, 0.7, ["lang", "language"], ["valid_language_code"]),
        _f("key_phrases", "text", False, 0.7, ["keywords", "key terms", "important phrases"], ["not_empty"]),
        _f("document_type", "text", False, 0.7, ["type", "category", "classification"], ["not_empty"]),
        _f("confidence_score", "number", False, 0.7, ["confidence", "score", "accuracy"], ["between_0_and_1"]),
    ),
    (TableSpec("extracted_tables", _cols(("table_data", "text")), 0, header_required=False),),
    ("content_not_empty", "reasonable_confidence_score"),
)
GENERIC = DocSchema(
    "custom", 0.5,
    (
        _f("text_content", "text", False, 0.5),
        _f("dates", "date", False, 0.6, ["date", "dated"]),
        _f("amounts", "currency", False, 0.6, ["amount", "total", "sum", "value"]),
    ),
)
SCHEMAS: dict[str, DocSchema] = {s.document_type: s for s in (INVOICE, RECEIPT, CONTRACT, ID_DOCUMENT, GENERAL_DOCUMENT)}

# Defaults of the schema file loader.
SCHEMA_DEFAULTS = {"required": False, "confidence_threshold": 0.7, "min_rows": 0, "max_rows": 1000,
                   "header_required": True, "required_confidence": 0.8, "version": "1.0"}

# Field lists used when a document type has no schema.
FALLBACK_FIELDS = {
    "invoice": ["VendorName", "InvoiceTotal", "InvoiceDate", "InvoiceId"],
    "receipt": ["MerchantName", "Total", "TransactionDate"],
    "contract": ["Parties", "ContractDate", "Terms"],
    "id_document": ["FirstName", "LastName", "DocumentNumber", "DateOfBirth"],
    "general_document": ["Content", "Pages"],
}
FALLBACK_DEFAULT = ["content"]

# Value part of the label patterns per field type; other types use TEXT.
LABEL_VALUE_PATTERNS = {
    "text": r"([^\n\r]+)",
    "number": r"([0-9,]+(?:\.[0-9]+)?)",
    "currency": r"(\$?[0-9,]+(?:\.[0-9]{2})?)",
    "date": r"([0-9]{1,2}[\/\-][0-9]{1,2}[\/\-][0-9]{2,4})",
    "email": r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    "phone": r"(\+?[0-9\-\(\)\s]+)",
}
# Free patterns tried when no label matches, and confidences of the strategies.
ANY_CURRENCY = r"\$[0-9,]+(?:\.[0-9]{2})?"
ANY_DATES = (
    r"[0-9]{1,2}\/[0-9]{1,2}\/[0-9]{2,4}",
    r"[0-9]{1,2}\-[0-9]{1,2}\-[0-9]{2,4}",
    r"[A-Za-z]{3,9}\s+[0-9]{1,2},?\s+[0-9]{2,4}",
)
CONF_LABEL, CONF_CURRENCY, CONF_DATE, CONF_DEFAULT, CONF_CELL = 0.8, 0.6, 0.7, 0.5, 0.8

# Fields with a normaliser.
NORMALIZED_DATES = ("invoice_date", "due_date", "transaction_date")
NORMALIZED_AMOUNTS = ("total_amount", "subtotal", "tax_amount")

# Named patterns.
PATTERNS = {
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "ein": r"^\d{2}-?\d{7}$",
    "credit_card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
    "invoice_number": r"^[A-Za-z0-9\-_]{3,20}$",
    "po_number": r"^[A-Za-z0-9\-_]{3,25}$",
    "amount": r"^\$?[0-9]{1,3}(?:,?[0-9]{3})*(?:\.[0-9]{2})?$",
    "percentage": r"^\d{1,3}(?:\.\d{1,2})?%?$",
    "zipcode": r"^\d{5}(?:-\d{4})?$",
    "account_number": r"^[0-9]{8,17}$",
    "routing_number": r"^[0-9]{9}$",
    "aba_number": r"^[0-9]{9}$",
}
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[+]?[1-9]?[0-9]{7,15}$"
CURRENCY_PATTERN = r"^\$?[0-9,]+(?:\.[0-9]{2})?$"
ALNUM_PATTERN = r"^[a-zA-Z0-9\s\-_]+$"
PAYMENT_METHODS = ["cash", "credit card", "debit card", "check", "cheque", "visa", "mastercard", "amex",
                   "discover", "paypal", "bank transfer", "wire transfer", "ach"]

# Inferred validation settings by field type and document type.
TYPE_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "currency": r"^\$?[\d,]+\.?\d{0,2}$",
    "alphanumeric": r"^[A-Za-z0-9-]+$",
}
REQUIRED_BY_TYPE = {
    "invoice": ["invoice_number", "amount", "date"],
    "receipt": ["total", "date"],
    "purchase_order": ["po_number", "amount"],
    "custom": [],
}
METADATA_FIELDS = ["document_type", "template_type", "overall_confidence"]
TEXT_LENGTH = (1, 1000)
DATE_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y")
NUMERIC_RANGE = (0, 999999999)
DEFAULT_CROSS_RULES = [
    {"name": "invoice_date_before_due_date", "type": "date_sequence", "field1": "invoice_date", "field2": "due_date", "rule": "date1_before_date2"},
    {"name": "invoice_total_consistency", "type": "amount_consistency", "formula": "total = subtotal + tax", "fields": ["subtotal", "tax", "total"]},
    {"name": "po_date_before_delivery", "type": "date_sequence", "field1": "po_date", "field2": "delivery_date", "rule": "date1_before_date2"},
]
# Extractor names accepted for the names the total rule asks for.
FIELD_ALIASES = {"tax": "tax_amount", "total": "total_amount"}

# Keyword classes in tie-break order.
KEYWORD_CLASSES = {
    "invoice": ["invoice", "bill to", "invoice number", "amount due", "payment terms"],
    "receipt": ["receipt", "purchased", "total", "thank you", "transaction"],
    "contract": ["agreement", "contract", "party", "terms and conditions", "signature"],
    "form": ["application", "form", "please fill", "submit", "information"],
    "statement": ["statement", "balance", "account", "period ending", "summary"],
    "report": ["report", "analysis", "findings", "conclusion", "executive summary"],
}
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]

# Expected fields inferred from the type name, first hit wins.
INFERRED_FIELDS = [
    (("invoice",), ["vendor", "total", "date", "number", "items"]),
    (("receipt",), ["merchant", "total", "date", "items"]),
    (("business", "card"), ["name", "company", "email", "phone"]),
    (("id", "identity"), ["name", "number", "date", "address"]),
    (("health", "insurance"), ["member", "insurer", "group", "policy"]),
    (("tax",), ["employee", "employer", "wages", "tax"]),
    (("layout",), ["pages", "tables", "paragraphs", "lines"]),
    (("read", "text"), ["content", "lines", "words"]),
]
INFERRED_DEFAULT = ["content", "text", "data"]

# Class to recognition model, and class to template.
MODEL_BY_CLASS = {"invoice": "prebuilt-invoice", "receipt": "prebuilt-receipt", "business_card": "prebuilt-businessCard",
                  "id_document": "prebuilt-idDocument", "tax_form": "prebuilt-tax.us.w2", "form": "prebuilt-layout",
                  "report": "prebuilt-layout", "letter": "prebuilt-read"}
DEFAULT_MODEL = "prebuilt-layout"
TEMPLATE_BY_CLASS = {"invoice": "invoice", "receipt": "receipt", "purchase_order": "purchase_order", "tax_form": "tax_form",
                     "contract": "contract", "form": "form_application", "form_application": "form_application",
                     "bank_statement": "bank_statement", "insurance_claim": "insurance_claim"}

# Exception descriptions.
EXCEPTION_TEXT = {
    "low_ocr_confidence": "OCR confidence below threshold",
    "validation_failure": "Field validation rule failure",
    "missing_page": "Required page missing from document",
    "unsupported_format": "Document format not supported",
    "processing_timeout": "Processing exceeded time limit",
    "poison_queue": "Document failed multiple processing attempts",
}

# Review queue settings.
QUEUE_RANK = {"urgent": 0, "high": 1, "normal": 2, "low": 3}
REVIEW_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
MAX_ATTEMPTS, RETRY_BASE_SECONDS, RETRY_FACTOR, TASK_TIMEOUT_SECONDS = 3, 60, 2, 3600
SLA_HOURS = {1: 72, 2: 24, 3: 2}
SLA_DEFAULT_HOURS = 24
ESCALATION_SECONDS = 900
MAX_PRIORITY = 3
NAMED_FIELDS = ["invoice_number", "total_amount", "vendor_name"]
REVIEW_STEPS = [
    "\nActions required:",
    "1. Review the document image",
    "2. Verify or correct extracted field values",
    "3. Ensure all required fields are present",
    "4. Validate business rule compliance",
    "5. Mark task as completed when done",
]
REVIEW_FOCUS = {
    "invoice": {
        "task_type": "invoice_review",
        "priority_fields": ["invoice_number", "vendor_name", "total_amount", "invoice_date"],
        "validation_focus": ["Verify total calculation accuracy", "Confirm vendor name is complete",
                             "Validate invoice number format", "Check date format and reasonableness"],
        "business_rules": ["Total should equal subtotal + tax", "Due date should be after invoice date",
                           "Line items should sum to subtotal"],
    },
    "receipt": {
        "task_type": "receipt_review",
        "priority_fields": ["merchant_name", "total_amount", "transaction_date"],
        "validation_focus": ["Verify merchant name is legible", "Confirm total amount accuracy",
                             "Check transaction date", "Validate item prices if visible"],
        "business_rules": ["Items should sum to total amount", "Transaction date should be reasonable"],
    },
}

# What the text features look for.
TEXT_PATTERNS = {
    "numbers": r"\d",
    "dates": r"\d{1,2}[/-]\d{1,2}[/-]\d{4}",
    "currency": r"[$€£¥]|\b\d+\.\d{2}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
}
# Words by which a field's kind is told from its name, first fit first.
FIELD_KINDS = {
    "date": ("date",),
    "currency": ("amount", "total", "price", "cost", "sum"),
    "alphanumeric": ("number", "id", "code"),
    "email": ("email",),
    "phone": ("phone",),
}
# Words and codes that strict rules accept.
LANGUAGE_CODES = ["en", "de", "fr", "es", "it", "pt", "nl", "english", "german", "french", "spanish"]
GENDERS = ["m", "f", "x", "male", "female", "other"]
EYE_COLORS = ["blue", "brown", "green", "hazel", "gray", "grey", "black", "bro", "blu", "grn", "haz", "gry", "blk"]
# Bounds and steps by which field quality is estimated from confidence: (valid: most, step), (else: least, step).
QUALITY_PROXY = {
    "precision": ((0.95, 0.05), (0.60, 0.20)),
    "recall": ((0.95, 0.03), (0.65, 0.15)),
    "accuracy": ((0.98, 0.08), (0.70, 0.10)),
}
# Thresholds of routing and reporting.
HITL_THRESHOLD, AUTO_APPROVE_THRESHOLD, NAMED_FIELD_THRESHOLD, LOW_FIELD_THRESHOLD = 0.6, 0.95, 0.8, 0.7
MODEL_THRESHOLD = 0.7
SLA_SECONDS = 300
IMPORT_SECONDS, IMPORT_COST, IMPORT_CONFIDENCE = 5.0, 2.50, 0.75
