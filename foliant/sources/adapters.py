"""The star-schema and event tables read as the tables of this library.

Every frame is a narrow projection of one table (plus map-side combined totals where named), so the
work grows with the table and nothing is collected.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import spread

TYPES = ["invoice", "receipt", "contract", "id_document", "general_document", "purchase_order"]
EXCEPTIONS = ["low_ocr_confidence", "validation_failure", "missing_page", "unsupported_format", "processing_timeout", "poison_queue"]
FIELDS = ["invoice_number", "total_amount", "vendor_name", "invoice_date", "due_date"]
DAY_MICROS = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, for work that is heavy in the row."""
    return spread(table(spark, sf_dir, "documents"))


def pick(values: list[str], key: Column) -> Column:
    """values[key mod n], for non-negative keys."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def events_as_metrics(ev: DataFrame) -> DataFrame:
    """``document_metrics`` from events, batch or streaming: one document per event."""
    kind, t, e = F.col("event_type"), F.col("value"), F.col("event_id")
    status = (
        F.when(kind.isin("purchase", "view"), "success").when(kind == "signup", "needs_review")
        .when(kind == "click", "reprocessing").otherwise("failed")
    )
    review = F.when(kind == "signup", 0.05).otherwise(0.0)
    compute = F.greatest(F.lit(0.001), t * 0.0001)
    return ev.select(
        F.concat(F.lit("doc_"), e.cast("string")).alias("document_id"),
        pick(TYPES, F.col("user_id")).alias("document_type"),
        status.alias("processing_status"),
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(secs=t.cast("decimal(18,6)"))).alias("end_time"),
        t.alias("total_processing_time"),
        (e % 14 + 1).cast("int").alias("field_count"),
        (kind == "signup").alias("hitl_required"),
        F.when(kind == "signup", "Low confidence scores").alias("hitl_reason"),
        F.when(kind == "error", pick(EXCEPTIONS, e)).alias("exception_type"),
        F.when(e % 97 == 0, F.lit(None))
        .when(e % 2 == 0, F.create_map(F.lit("compute_cost"), compute, F.lit("storage_cost"), F.lit(0.0001), F.lit("review_cost"), review))
        .otherwise(F.create_map(F.lit("compute"), compute, F.lit("storage"), F.lit(0.0001), F.lit("review"), review))
        .alias("cost_breakdown"),
        F.create_map(F.lit("overall"), (F.lit(50) + e % 50) / 100.0).alias("confidence_scores"),
        F.col("ts").alias("created_at"),
    )


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_metrics(table(spark, sf_dir, "events"))


def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    p, r = (F.lit(60) + e % 40) / 100.0, (F.lit(60) + (e * 3) % 40) / 100.0
    return table(spark, sf_dir, "events").select(
        pick(FIELDS, e).alias("field_name"), pick(TYPES, F.col("user_id")).alias("document_type"),
        p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1_score"),
        ((F.lit(60) + (e * 7) % 40) / 100.0).alias("accuracy"), F.lit(1).alias("total_predictions"),
        ((F.lit(50) + e % 50) / 100.0).alias("confidence_avg"), F.col("ts").alias("created_at"), e.alias("metric_id"),
    )


def processing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run result per event, with ordered stages, extracted data and validation results."""
    kind, e = F.col("event_type"), F.col("event_id")
    conf = lambda k: (F.lit(50) + (e * k) % 50) / 100.0
    ok = lambda cond: F.when(cond, "completed").otherwise("failed")

    def stage(name, status):
        return F.struct(F.lit(name).alias("name"), status.alias("status"), F.lit(f"/tmp/{name}").alias("temp_path"))

    def result(name, valid):
        return F.struct(F.lit(name).alias("field"), valid.alias("valid"), F.lit("check").alias("message"))

    def value(text, c):
        return F.struct(text.alias("value"), c.alias("confidence"))

    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("inbox/"), kind, F.lit("/doc_"), e.cast("string"), F.lit(".pdf")).alias("blob_name"),
        F.col("ts").alias("timestamp"), F.col("value").alias("processing_time"),
        (kind == "signup").alias("needs_human_review"), pick(TYPES, F.col("user_id")).alias("document_type"),
        F.array(stage("download", F.lit("completed")), stage("preprocessing", ok(e % 11 != 0)),
                stage("classification", F.lit("completed")), stage("ocr", ok(kind != "error")),
                stage("field_extraction", F.lit("completed"))).alias("stages"),
        (e % 14 + 1).cast("int").alias("field_count"),
        F.create_map(F.lit("total_amount"), value(F.format_string("%.2f", F.col("value")), conf(1)),
                     F.lit("invoice_number"), value(F.concat(F.lit("INV-"), e.cast("string")), conf(3)),
                     F.lit("date"), value(F.date_format("ts", "yyyy-MM-dd"), conf(7))).alias("extracted_data"),
        F.array(result("date", e % 3 != 0), result("total_amount", e % 5 != 0), result("date", e % 4 != 0),
                result("vendor_name", e % 2 == 0)).alias("validation_results"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects from pages: names ending in .pdf, .PDF, .docx or nothing."""
    ext = pick([".pdf", ".PDF", ".docx", ""], F.col("page_id"))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.col("url"), F.lit("/p"), F.col("page_id").cast("string"), ext).alias("path"),
        F.length("html").cast("long").alias("length"), F.col("page_id"),
    )


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs_from(spread(table(spark, sf_dir, "orders"), "o_orderkey"))


def order_docs_from(orders: DataFrame) -> DataFrame:
    """A document per order (batch or stream) with the figures its text and field maps are made of."""
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    tax = F.round(total * F.lit("0.08").cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    # One document in seven states a total that is off by a dollar.
    stated = F.when(k % 7 == 0, total + 1).otherwise(total).cast("decimal(18,2)")
    due_days = (k % 45).cast("int")
    return orders.select(
        k.alias("key"), F.concat(F.lit("DOC-"), k.cast("string")).alias("document_id"),
        pick(["invoice", "invoice", "invoice", "receipt", "contract", "general_document", "custom"], k).alias("document_type"),
        (total - tax).cast("decimal(18,2)").alias("subtotal"), tax.alias("tax"), stated.alias("total"),
        F.to_date("o_orderdate").alias("doc_date"), F.date_add(F.to_date("o_orderdate"), due_days - 5).alias("due_date"),
        F.col("o_custkey").alias("party"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("created"),
    )


def order_text(d: DataFrame) -> DataFrame:
    """Adds ``full_text``: labelled lines whose labels change from document to document.

    Amounts and dates are written in a step before the text, once each, so that both steps stay small enough for the JVM to compile.
    """
    k = F.col("key")
    written = {f"__{c}": F.concat(F.lit("$"), F.format_number(c, 2)) for c in ("subtotal", "tax", "total")}
    written |= {f"__{c}": F.date_format(c, "M/d/yyyy") for c in ("doc_date", "due_date")}
    d = d.withColumns(written)
    usd = mdy = lambda c: F.col(f"__{c}")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    key = k.cast("string")
    party = F.concat(F.lit("Trader "), F.col("party").cast("string"), F.lit(" Ltd"))
    invoice = F.concat(
        line("INVOICE"),
        line(pick(["Invoice #: INV-", "Inv #: INV-", "Bill Number: INV-", "Reference: INV-"], k), key),
        line(pick(["From: ", "Seller: ", "Bill From: "], k), party),
        line(pick(["Date: ", "Bill Date: ", "Issued "], k), F.when(k % 4 == 3, F.col("doc_date").cast("string")).otherwise(mdy("doc_date"))),
        line(pick(["Payment Due: ", "Due: "], k), mdy("due_date")),
        line(pick(["Sub Total: ", "Net Amount: "], k), usd("subtotal")),
        line(pick(["Sales Tax: ", "VAT: ", "Tax (8.0%): "], k), usd("tax")),
        line(pick(["Grand Total: ", "Amount Due: ", "Balance: ", "Pay "], k), usd("total")),
        line("Customer: C-", F.col("party").cast("string")),
        line("Payment terms apply. Thank you"),
    )
    receipt = F.concat(
        line(pick(["Store: ", "Shop: "], k), party), line("Purchase Date: ", mdy("doc_date")),
        line("Total: ", usd("total")), line("Paid by: ", pick(["Visa", "Cash", "Voucher"], k)),
        line("Thank you for your transaction"),
    )
    contract = F.concat(
        line("Agreement Title: Supply contract ", key), line("Between: ", party, " and Buyer ", F.col("party").cast("string")),
        line("Effective Date: ", mdy("doc_date")), line("Expires: ", mdy("due_date")), line("Consideration: ", usd("total")),
        line("Governed by: Law ", pick(["A", "B"], k)), line("terms and conditions and signature of each party"),
    )
    general = F.concat(
        line("Subject: Report ", key), line("Prepared by: ", party), line("Created: ", mdy("doc_date")),
        line("Body: analysis and findings with a conclusion in the executive summary of account ", key),
        line("Page Count: ", (k % 30).cast("string")),
    )
    other = F.concat(line("Note ", key, " dated ", F.date_format("doc_date", "MMMM d, yyyy")), line("value of ", usd("total"), " and ", usd("tax")))
    t = F.col("document_type")
    text = F.when(t == "invoice", invoice).when(t == "receipt", receipt).when(t == "contract", contract).when(t == "general_document", general)
    return d.withColumn("full_text", text.otherwise(other)).drop(*written)


def ocr_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition results: text, recognised fields, a table and text blocks per document."""
    k = F.col("key")
    d = order_text(order_docs(spark, sf_dir))
    conf = lambda m: (F.lit(60) + (k * m) % 40) / 100.0

    def ocr_field(name, value, c):
        return F.struct(name.alias("field_name"), value.alias("value"), F.lit("string").alias("field_type"), c.alias("confidence"))

    fields = F.array(
        ocr_field(F.when(k % 3 == 0, F.lit("Total_Amount")).otherwise("other"), F.concat(F.lit("$"), F.col("total").cast("string")), conf(3)),
        ocr_field(F.when(k % 5 == 0, F.lit("VENDOR_NAME")).otherwise("note"), F.concat(F.lit("Vendor "), k.cast("string")), conf(7)),
        ocr_field(F.lit("total_amount"), F.lit("$1.00"), conf(1)),
    )
    qty = (k % 4 + 1).cast("int")
    amount = F.round(F.col("subtotal") / 2, 2).cast("decimal(18,2)")
    row = lambda a, b, c, e: F.array(a, b, c, e)
    items = F.array(
        row(*[F.lit(x) for x in ("Description", "Quantity", "Unit Price", "Amount")]),
        row(F.lit("Goods"), qty.cast("string"), F.format_number(amount, 2), F.concat(F.lit("$"), F.format_number(amount, 2))),
        row(F.lit("Freight"), F.lit(" "), F.lit("n/a"), F.concat(F.lit("$"), F.format_number(F.col("subtotal") - amount, 2))),
    )
    tables = F.when(k % 6 == 5, F.array().cast("array<struct<rows:array<array<string>>,headers:array<string>,confidence:double>>")).otherwise(
        F.array(F.struct(items.alias("rows"), items[0].alias("headers"), F.lit(0.9).alias("confidence"))))
    blocks = F.transform(
        F.split(F.regexp_replace("full_text", "\n$", ""), "\n"),
        lambda s, i: F.struct(
            s.alias("content"),
            F.struct((F.lit(50.0) + (k % 3) * i).alias("x"), (i * 20.0).alias("y"), (F.length(s) * 6.0).alias("width"),
                     (F.lit(10.0) + (k + i) % 3).alias("height")).alias("bbox"),
            ((F.lit(70) + (k + i * 7) % 30) / 100.0).alias("confidence"), ((k + i) % 5 == 0).alias("is_handwritten")),
    )
    scores = F.when(k % 10 == 0, F.create_map(F.lit("tables"), F.lit(1.0))).otherwise(F.create_map(F.lit("text"), conf(1), F.lit("tables"), F.lit(1.0)))
    return d.select("*", fields.alias("ocr_fields"), tables.alias("tables"), blocks.alias("text_blocks"),
                    (k % 4 + 1).cast("int").alias("pages"), F.lit("en").alias("language"),
                    ((k % 90) / 10.0).alias("processing_time"), F.lit("prebuilt-layout").alias("model_used"),
                    scores.alias("confidence_scores"))


def field_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as field maps with a confidence per field."""
    k = F.col("key")
    text = lambda c: F.concat(F.lit("$"), c.cast("string"))
    fields = F.create_map(
        F.lit("invoice_number"), F.when(k % 13 == 0, "").when(k % 5 == 0, "INV/!").otherwise(F.concat(F.lit("INV-"), k.cast("string"))),
        F.lit("invoice_date"), F.col("doc_date").cast("string"),
        F.lit("due_date"), F.when(k % 17 == 0, "soon").otherwise(F.date_format("due_date", "M/d/yyyy")),
        F.lit("total_amount"), text(F.col("total")), F.lit("subtotal"), text(F.col("subtotal")), F.lit("tax_amount"), text(F.col("tax")),
        F.lit("email"), F.when(k % 9 == 0, "bad-address").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@Example.COM"))),
        F.lit("phone"), F.when(k % 8 == 0, "12-34").otherwise(F.concat(F.lit("(555) 010-"), F.lpad((k % 10000).cast("string"), 4, "0"))),
        F.lit("card"), F.concat(F.lit("4"), F.lpad(k.cast("string"), 15, "7")),
        F.lit("payment_method"), pick(["Visa debit", "barter", "CASH"], k),
    )
    conf = lambda m: (F.lit(50) + (k * m) % 50) / 100.0
    scores = F.create_map(F.lit("invoice_number"), conf(3), F.lit("total_amount"), conf(7), F.lit("vendor_name"), conf(9), F.lit("invoice_date"), conf(11))
    return order_docs(spark, sf_dir).withColumn("fields", fields).withColumn("confidence_scores", scores)


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table of field values: one row per document and field."""
    return field_docs(spark, sf_dir).select("key", "document_id", "document_type", F.explode("fields").alias("field_name", "value"))


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted values of line items: five field names, several rows per document, repeats included."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("DOC-"), F.col("l_orderkey").cast("string")).alias("document_id"),
        pick(FIELDS, F.col("l_linenumber")).alias("field_name"),
        F.lit("invoice").alias("document_type"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value"),
        ((F.lit(50) + q) / 100.0).alias("confidence"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + q).alias("pos"),
        (F.col("l_returnflag") != "R").alias("valid"),
        F.when(F.col("l_linestatus") == "O", "error").otherwise("warning").alias("severity"),
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells of invoices: one amount text per line, every eleventh unreadable."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        F.when(F.col("l_partkey") % 11 == 0, "n/a").otherwise(
            F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))).alias("amount"),
        F.col("l_partkey").alias("item"),
    )


def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review tasks from orders; ages follow from the key."""
    k = F.col("o_orderkey")
    created = F.col("o_orderdate") + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)"))
    status = F.when(F.col("o_orderstatus") == "F", F.when(k % 10 == 0, "approved").otherwise("completed")).when(
        F.col("o_orderstatus") == "O", pick(["pending", "assigned"], k)).otherwise("in_progress")
    done = status.isin("completed", "approved")
    touched = F.when((done & (k % 20 != 1)) | (status == "in_progress"), created + F.make_dt_interval(mins=(k % 240).cast("int")))
    resolved = F.when(done, created + F.make_dt_interval(mins=(k % 240 + 30 + k % 77).cast("int")))
    priority = (F.substring("o_orderpriority", 1, 1).cast("int") % 3 + 1).cast("int")

    def f(name, value, conf, violations):
        return F.struct(F.lit(name).alias("field_name"), value.alias("value"), conf.alias("confidence"), violations.alias("violations"),
                        F.lit("pattern_match").alias("extraction_method"))

    conf = lambda m: (F.lit(50) + (k * m) % 50) / 100.0
    fields = F.array(
        f("invoice_number", F.concat(F.lit("INV-"), k.cast("string")), conf(3), F.lit(0)),
        f("total_amount", F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")), conf(7), (k % 4 == 0).cast("int")),
        f("vendor_name", F.concat(F.lit("Trader "), F.col("o_custkey").cast("string")), conf(9), F.lit(0)),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("TASK-"), k.cast("string")).alias("task_id"), F.concat(F.lit("doc_"), (k * 3).cast("string")).alias("document_id"),
        pick(TYPES[:5], F.col("o_custkey")).alias("document_type"), fields.alias("extracted_fields"),
        F.when(k % 4 == 0, F.array(F.lit("total mismatch"))).otherwise(F.array().cast("array<string>")).alias("validation_errors"),
        created.alias("created_at"),
        F.when(status != "pending", F.concat(F.lit("rev_"), (k % 50).cast("string"))).alias("assigned_to"),
        touched.alias("first_touched_at"), resolved.alias("resolution_time"), status.alias("status"), priority.alias("priority"),
        pick(["low_confidence", "validation_error", "missing_required_field", "business_rule_violation", "manual_review"], k).alias("reason"),
        ((F.lit(30) + k % 70) / 100.0).alias("confidence_score"), k.alias("key"),
    )


def reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers from suppliers, each with one specialisation."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("rev_"), s.cast("string")).alias("user_id"), F.col("s_name").alias("name"), s.alias("ord"),
        F.array(pick(TYPES[:5], s)).alias("specializations"), (s % 7).cast("long").alias("current_workload"), (s % 9 != 0).alias("is_available"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer corrections from line items; repeats of a field are ordered by ``pos``."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("TASK-"), F.col("l_orderkey").cast("string")).alias("task_id"),
        pick(FIELDS, F.col("l_linenumber")).alias("field_name"),
        F.when(q % 4 == 0, F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string"))).otherwise(
            F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))).alias("corrected_value"),
        F.when(F.col("l_returnflag") == "A", "typo").alias("reason"),
        F.when(q % 3 != 0, (q % 5 + 1).cast("int")).alias("rating"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + q).alias("pos"),
        F.col("l_shipdate").alias("timestamp"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_events_from(table(spark, sf_dir, "events"))


def task_events_from(events: DataFrame) -> DataFrame:
    """Task life events, batch or stream: one task per user and day; errors are failed attempts."""
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("T"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "DDD")).alias("task_id"),
        F.col("ts"), F.col("event_id"), F.col("user_id"),
        F.when(kind == "error", "attempt_failed").when(kind == "signup", "touched").when(kind == "purchase", "completed")
        .when(kind == "click", "cancel_requested").otherwise("started").alias("event"),
    )


def timed_tasks(events: DataFrame) -> DataFrame:
    """Task events with a zoned time, as watermarks need it, and the task's priority."""
    rows = task_events_from(events)
    return rows.select("task_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event", (F.col("user_id") % 3 + 1).cast("int").alias("priority"))
