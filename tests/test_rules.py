"""Rule edge cases on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.functions import luhn, mask, parse, rules
from foliant.functions import text as T
from foliant.operators import classify, crossfield, routing, validate


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("number,valid", [("4532123456789012", False), ("4532123456789013", False), ("123456789", False), ("", False),
                                          ("79927398713", True), ("7992-7398 713", True), ("12a", False), (None, False)])
def test_luhn(spark, number, valid):
    assert one(spark, number, luhn.luhn_valid) is valid


def test_check_digit(spark):
    assert one(spark, "7992739871", luhn.luhn_check_digit) == "3"
    assert one(spark, "79x", luhn.luhn_check_digit) is None


@pytest.mark.parametrize("text,day", [("2024-01-15", dt.date(2024, 1, 15)), ("1/5/2024", dt.date(2024, 1, 5)), ("1-5-2024", dt.date(2024, 1, 5)),
                                      ("1/5/24", dt.date(2024, 1, 5)), ("March 3, 2024", dt.date(2024, 3, 3)), ("Mar 3 2024", dt.date(2024, 3, 3)),
                                      ("13/45/2024", None), ("soon", None), ("2024", None), ("", None), (None, None)])
def test_dates(spark, text, day):
    assert one(spark, text, parse.to_date) == day


@pytest.mark.parametrize("a,b,valid", [("2024-01-15", "2024-02-15", True), ("2024-02-15", "2024-01-15", False), ("2024-01-15", "2024-01-15", True), ("x", "2024-01-15", False)])
def test_date_sequence(spark, a, b, valid):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(crossfield.date_sequence(F.col("a"), F.col("b"), "a", "b").alias("r")).first()["r"]
    assert r["is_valid"] is valid and r["severity"] == ("info" if valid else "error")


@pytest.mark.parametrize("subtotal,tax,total,valid", [("100.00", "8.50", "108.50", True), ("100.00", "8.50", "110.00", False), ("250.00", "21.25", "271.25", True),
                                                      ("100.00", "8.50", "108.51", False), ("$1,150.00", "$84.56", "$1,234.56", True), ("abc", "1", "2", False)])
def test_amount_consistency(spark, subtotal, tax, total, valid):
    df = spark.createDataFrame([(subtotal, tax, total)], "s string, t string, total string")
    r = df.select(crossfield.amount_consistency({"subtotal": F.col("s"), "tax": F.col("t"), "total": F.col("total")}, "total = subtotal + tax").alias("r")).first()["r"]
    assert r["is_valid"] is valid


def test_unknown_formula(spark):
    r = spark.range(1).select(crossfield.amount_consistency({}, "total = x").alias("r")).first()["r"]
    assert not r["is_valid"] and r["message"] == "Unknown formula: total = x"


def test_total_calc_lets_a_cent_pass(spark):
    df = spark.sql("select cast(108.51 as decimal(28,6)) t, cast(100 as decimal(28,6)) s, cast(8.5 as decimal(28,6)) x")
    assert df.select(crossfield.total_calc(F.col("t"), F.col("s"), F.col("x")).alias("r")).first()["r"] is None
    df = spark.sql("select cast(108.52 as decimal(28,6)) t, cast(100 as decimal(28,6)) s, cast(8.5 as decimal(28,6)) x")
    assert df.select(crossfield.total_calc(F.col("t"), F.col("s"), F.col("x")).alias("r")).first()["r"]["suggested_value"] == "108.50"


def test_equal_due_date_is_a_warning(spark):
    df = spark.sql("select date'2024-01-15' a")
    assert df.select(crossfield.due_date(F.col("a"), F.col("a")).alias("r")).first()["r"]["severity"] == "warning"


VALIDATION_DOCS = [
    ("INV-2024-001", "invoice", {"invoice_number": "INV-2024-001", "invoice_date": "2024-01-15", "due_date": "2024-02-15", "vendor_name": "ABC Company",
                                 "total_amount": "$1,234.56", "subtotal": "$1,150.00", "tax": "$84.56", "amount": "$1,234.56", "date": "2024-01-15"}),
    ("INV-2024-002", "invoice", {"invoice_number": "INV-INVALID-!!!", "invoice_date": "2024-01-30", "due_date": "2024-01-15", "total_amount": "$2,500.00",
                                 "subtotal": "$2,000.00", "tax": "$400.00"}),
    ("C-1", "contract", {"contract_number": "C-2024-001", "party2": "", "email": "invalid-email-format"}),
    ("R-1", "receipt", {"total": "", "date": "2024-01-20"}),
]


def test_validate_document(spark):
    docs = spark.createDataFrame(VALIDATION_DOCS, "document_id string, document_type string, fields map<string,string>")
    rows = validate.validate_document(docs).select("document_id", F.explode("validation_results").alias("r")).select("document_id", "r.*").collect()
    bad = {(r["document_id"], r["field_name"], r["rule_name"]) for r in rows if not r["is_valid"]}
    assert bad == {
        ("INV-2024-002", "invoice_number", "regex"), ("INV-2024-002", "invoice_date+due_date", "invoice_date_before_due_date"),
        ("INV-2024-002", "amount_consistency", "invoice_total_consistency"), ("C-1", "email", "regex"), ("R-1", "total", "required"),
        ("C-1", "invoice_total_consistency", "invoice_total_consistency"), ("R-1", "invoice_total_consistency", "invoice_total_consistency")}
    missing = [r for r in rows if r["document_id"] == "C-1" and r["rule_name"] == "invoice_total_consistency"][0]
    assert missing["severity"] == "warning" and "'subtotal'" in missing["message"]


def test_invalid_pattern_is_an_error_row(spark):
    assert one(spark, "x", lambda v: rules.rule_regex(v, "("))["message"].startswith("Invalid regex pattern")


def test_schema_rule_uses_normalised_value(spark):
    df = spark.createDataFrame([("d", "invoice", "total_amount", "$1,234.5"), ("d", "invoice", "invoice_number", ""), ("e", "receipt", "payment_method", "barter")],
                               "document_id string, document_type string, field_name string, value string")
    got = {(r["field_name"], r["rule_name"], r["severity"]) for r in validate.validate_field_rows(df, "2024-06-01").collect()}
    assert got == {("total_amount", "currency_format", "error"), ("invoice_number", "not_empty", "error"), ("invoice_number", "alphanumeric", "error"),
                   ("payment_method", "valid_payment_method", "warning")}


def test_overall_confidence_limits(spark):
    df = spark.createDataFrame([(0.5, 9, 0), (1.0, 0, 0), (None, 0, 0), (0.9, 1, 2)], "m double, e int, w int")
    got = [round(r["c"], 6) for r in df.select(routing.penalized(F.col("m"), F.col("e"), F.col("w")).alias("c")).collect()]
    assert got == [0.0, 1.0, 0.0, 0.7]


def test_text_features(spark):
    df = spark.createDataFrame([("Invoice #12345 Date: 2024-01-15 Amount: $1,250.00",), ("  ",), ("Ωμέγα λόγος",)], "t string")
    a, blank, greek = classify.text_features(df, "t").collect()
    assert (a["word_count"], a["has_numbers"], a["has_currency"], a["has_dates"], a["has_email"]) == (6, True, True, False, False)
    assert (blank["word_count"], blank["language"], blank["avg_word_length"]) == (0, "unknown", 0.0)
    assert greek["language"] == "other" and a["language"] == "english"


def test_key_phrases_ties_and_stop_words(spark):
    df = spark.createDataFrame([("with beta Alpha alpha beta the the the gamma",), ("",)], "t string")
    a, b = classify.key_phrases(df, "t").collect()
    assert a["key_phrases"] == ["beta", "alpha", "gamma"] and b["key_phrases"] == []


def test_words_split_on_unicode_space(spark):
    assert one(spark, "a b　c", T.words) == ["a", "b", "c"]


def test_mask(spark):
    text = "card 7992 7398 7100 0011 ok 4111 1111 1111 1111, x@y.org 123-45-6789 555-010-1234"
    internal = one(spark, text, lambda c: mask.mask_pii(c, "internal"))
    assert internal == "card 7992 7398 7100 0011 ok <CREDIT_CARD>, x@y.org <SSN> 555-010-1234"
    assert one(spark, text, lambda c: mask.mask_pii(c, "restricted")).count("[REDACTED]") == 4
    assert "<EMAIL_ADDRESS>" in one(spark, text, lambda c: mask.mask_pii(c, "public"))


def test_config_lists():
    assert len(config.KEYWORD_CLASSES) == 6 and all(len(v) == 5 for v in config.KEYWORD_CLASSES.values())
    assert len(config.STOP_WORDS) == 14 and len(config.PAYMENT_METHODS) == 13
