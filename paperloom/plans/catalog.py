"""Queries over the fixture tables, each with the same in SQL.

An order stands for an invoice, its line items for line items, a conversation for a document, its
turns for pages, lines of text for OCR blocks, events for the audit log. Compared values are derived
so that checks have both outcomes; money is decimal on both sides.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import audit, classify, extract, ingest, insights, layout, sections, validate, vision
from ..schemas import SECTION_FIELDS, STAGES
from ..settings import Settings
from ..streaming import logs as stream

AS_OF = datetime.date(1998, 8, 2)
S = Settings(as_of=AS_OF)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def dec(c: Column) -> Column:
    return c.cast("decimal(18,2)")


_LINES = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(16,0)) * 0.01 AS DECIMAL(18,2)) AS p, CAST(l_extendedprice AS DECIMAL(18,2)) AS t FROM lineitem"


def lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    cents = F.floor((2 * F.round(F.col("l_extendedprice") * 100).cast("long") + F.col("l_quantity").cast("long")) / (2 * F.col("l_quantity").cast("long")))
    price = dec(cents.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)"))  # half up, in whole cents
    return rows.select("l_orderkey", "l_linenumber", dec(F.col("l_quantity")).alias("q"), price.alias("p"), dec(F.col("l_extendedprice")).alias("t"))


@query(f"SELECT l_orderkey, l_linenumber, q, p, t, abs(q * p - t) > 0.05 AS flagged FROM ({_LINES})")
def line_item_math(spark, d):
    return lines(spark, d).withColumn("flagged", validate.over(F.col("q") * F.col("p"), F.col("t")))


_SUBTOTALS = f"SELECT l_orderkey, CAST(sum(t) AS DECIMAL(18,2)) AS computed, CAST(sum(t) + CASE WHEN l_orderkey % 5 = 0 THEN 1.00 ELSE 0.03 END AS DECIMAL(18,2)) AS stated FROM ({_LINES}) GROUP BY l_orderkey"


def subtotals(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).groupBy("l_orderkey").agg(dec(F.sum("t")).alias("computed"))
    return rows.withColumn("stated", dec(F.col("computed") + F.when(F.col("l_orderkey") % 5 == 0, F.lit("1.00").cast("decimal(18,2)")).otherwise(F.lit("0.03").cast("decimal(18,2)"))))


@query(f"SELECT l_orderkey, computed, stated, abs(computed - stated) > 0.05 AS flagged FROM ({_SUBTOTALS})")
def subtotal_reconcile(spark, d):
    return subtotals(spark, d).withColumn("flagged", validate.over(F.col("computed"), F.col("stated")))


@query(
    f"""WITH m AS (SELECT l_orderkey, count(*) AS line_count, sum(CASE WHEN abs(q * p - t) > 0.05 THEN 1 ELSE 0 END) AS bad_lines FROM ({_LINES}) GROUP BY l_orderkey),
s AS (SELECT l_orderkey, stated, abs(computed - stated) > 0.05 AS bad_subtotal FROM ({_SUBTOTALS}))
SELECT m.l_orderkey, line_count, CAST(bad_lines AS BIGINT) AS bad_lines, stated, bad_subtotal, CASE WHEN bad_lines > 0 OR bad_subtotal THEN 'needs_review' ELSE 'completed' END AS status,
CASE WHEN bad_subtotal THEN 'Invoice subtotal does not match the sum of line items.' WHEN bad_lines > 0 THEN 'Line item total does not match quantity × unit price.' END AS why FROM m JOIN s USING (l_orderkey)"""
)
def invoice_reconciliation(spark, d):
    """Which invoices need review, and why: line math and subtotal from one aggregation by invoice."""
    bad = validate.over(F.col("q") * F.col("p"), F.col("t"))
    rows = lines(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("line_count"), F.count_if(bad).alias("bad_lines"), dec(F.sum("t")).alias("computed"))
    rows = rows.withColumn("stated", dec(F.col("computed") + F.when(F.col("l_orderkey") % 5 == 0, F.lit("1.00").cast("decimal(18,2)")).otherwise(F.lit("0.03").cast("decimal(18,2)"))))
    rows = rows.withColumn("bad_subtotal", validate.over(F.col("computed"), F.col("stated")))
    why = F.when(F.col("bad_subtotal"), "Invoice subtotal does not match the sum of line items.").when(F.col("bad_lines") > 0, "Line item total does not match quantity × unit price.")
    return rows.select("l_orderkey", "line_count", "bad_lines", "stated", "bad_subtotal", F.when(why.isNotNull(), "needs_review").otherwise("completed").alias("status"), why.alias("why"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, strftime(o_orderdate + to_days(CAST(o_orderkey % 40 - 5 AS INTEGER)), '%Y-%m-%d') AS due_date, o_orderkey % 40 < 5 AS late FROM orders")
def date_relationship(spark, d):
    rows = read(spark, d, "orders", "o_orderkey", "o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = rows.select("o_orderkey", day("o_orderdate").alias("invoice_date"), day(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40 - 5).cast("int"))).alias("due_date"))
    return rows.withColumn("late", F.col("due_date") < F.col("invoice_date"))


_TAX = "SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS sub, CAST(CASE WHEN l_orderkey % 2 = 0 THEN round(l_tax * 100, 2) ELSE l_tax END AS DECIMAL(18,4)) AS rate, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(round(l_tax, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS base FROM lineitem"


def taxes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    rate = F.when(F.col("l_orderkey") % 2 == 0, F.round(F.col("l_tax") * 100, 2)).otherwise(F.col("l_tax")).cast("decimal(18,4)")
    return rows.select("l_orderkey", "l_linenumber", dec(F.col("l_extendedprice")).alias("sub"), rate.alias("rate"), dec(dec(F.col("l_extendedprice")) * dec(F.round("l_tax", 2))).alias("base"))


@query(
    f"""SELECT l_orderkey, l_linenumber, sub, rate, tax, CASE WHEN rate > 0 THEN abs(CAST(sub * CASE WHEN rate > 1 THEN rate * 0.01 ELSE rate END AS DECIMAL(18,4)) - tax) > 0.05 END AS flagged
FROM (SELECT *, CAST(base + CASE WHEN l_orderkey % 7 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(18,2)) AS tax FROM ({_TAX}))"""
)
def tax_check(spark, d):
    rows = taxes(spark, d).withColumn("tax", dec(F.col("base") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0).cast("decimal(18,2)")))
    flag = F.when(F.col("rate") > 0, validate.over(validate.tax_expected(F.col("sub"), F.col("rate")).cast("decimal(18,4)"), F.col("tax")))
    return rows.select("l_orderkey", "l_linenumber", "sub", "rate", "tax", flag.alias("flagged"))


@query(
    f"""SELECT l_orderkey, l_linenumber, sub, base AS tax, disc, total, abs(sub + base - disc - total) > 0.05 AS flagged FROM (SELECT *, CAST(sub + base - disc + CASE WHEN l_orderkey % 11 = 0 THEN 0.50 ELSE 0.01 END AS DECIMAL(18,2)) AS total
FROM (SELECT *, CAST(l_orderkey % 3 AS DECIMAL(18,2)) AS disc FROM ({_TAX})))"""
)
def total_check(spark, d):
    rows = taxes(spark, d).withColumn("disc", dec(F.col("l_orderkey") % 3))
    off = F.when(F.col("l_orderkey") % 11 == 0, F.lit("0.50").cast("decimal(18,2)")).otherwise(F.lit("0.01").cast("decimal(18,2)"))
    rows = rows.withColumn("total", dec(F.col("sub") + F.col("base") - F.col("disc") + off))
    return rows.select("l_orderkey", "l_linenumber", "sub", F.col("base").alias("tax"), "disc", "total", validate.over(F.col("sub") + F.col("base") - F.col("disc"), F.col("total")).alias("flagged"))


def long_fields(rows: DataFrame, kind: str = "invoice") -> DataFrame:
    """Rows (document_id, field_ord, field_name, field_value) with what else the validator reads."""
    return rows.select("document_id", F.lit(kind).alias("document_type"), F.col("field_ord").cast("int").alias("field_ord"), "field_name", F.col("field_value").cast("string").alias("field_value"), F.lit(0.9).alias("confidence"), F.lit("model").alias("source"), F.lit("s").alias("section_name"), F.lit(1).alias("page_number"), F.lit(False).alias("fallback_attempted"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS document_id, name AS field_name, 'Required invoice field ''' || name || ''' is missing.' AS message, placeholder FROM (SELECT o_orderkey, unnest(['vendor_name', 'invoice_number', 'invoice_date', 'total']) AS name, unnest([2, 3, 5, 7]) AS k, unnest([false, true, true, true]) AS placeholder FROM orders) WHERE o_orderkey % k = 0")
def required_fields(spark, d):
    """Blank fields (vendor_name) and absent ones, which the validator adds as placeholders."""
    k = F.col("o_orderkey")
    given = [("vendor_name", F.when(k % 2 == 0, " ").otherwise("Vendor"), None), ("invoice_number", k, 3), ("invoice_date", F.date_format("o_orderdate", "yyyy-MM-dd"), 5), ("total", k, 7)]
    parts = F.array_compact(F.array(*(F.when(k % n != 0 if n else F.lit(True), F.struct(F.lit(i).alias("field_ord"), F.lit(name).alias("field_name"), v.cast("string").alias("field_value"))) for i, (name, v, n) in enumerate(given))))
    rows = read(spark, d, "orders", "o_orderkey", "o_orderdate").select(k.cast("string").alias("document_id"), F.explode(parts).alias("f")).select("document_id", "f.*")
    found = validate.validate(long_fields(rows), S).where("validation_status = 'needs_review'")
    return found.select("document_id", "field_name", F.col("validation_message").alias("message"), (F.col("source") == "validation").alias("placeholder"))


@query(
    """SELECT l_orderkey || '/' || l_linenumber AS document_id, count(*) AS n, 'Multiple conflicting values detected for ''supplier'': [''' || string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ''', ''' ORDER BY CAST(l_suppkey AS VARCHAR)) || ''']' AS message
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_suppkey) > 1"""
)
def conflict_detection(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("document_id"), F.col("l_partkey").alias("field_ord"), F.lit("supplier").alias("field_name"), F.col("l_suppkey").alias("field_value"))
    found = validate.validate(long_fields(rows, "unknown"), S).where("validation_status = 'conflict'")
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.first("validation_message").alias("message"))


def invoice_fields(spark: SparkSession, d: str) -> DataFrame:
    """Orders and line items as long rows of fields: what the validator reads."""
    money = lambda c: c.cast("string")
    item = lines(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.max("q").alias("q"), F.max(F.struct("t", "p")).alias("m"))
    item = item.select("l_orderkey", "l_linenumber", "q", F.col("m.p").alias("p"), F.col("m.t").alias("t"))
    parts = F.array(*(F.struct(F.concat(F.lit("line_item_"), F.col("l_linenumber").cast("string"), F.lit(f"_{n}")).alias("field_name"), v.alias("field_value"), (F.col("l_linenumber") * 10 + i).cast("int").alias("field_ord")) for i, (n, v) in enumerate((("quantity", money(F.col("q"))), ("unit_price", money(F.col("p"))), ("line_total", money(F.col("t")))))))
    long = item.select(F.col("l_orderkey").alias("k"), F.explode(parts).alias("f"))
    sums = item.groupBy("l_orderkey").agg(dec(F.sum("t")).alias("s"))
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    due = F.date_add(F.col("o_orderdate").cast("date"), (k % 40 - 5).cast("int"))
    head = [
        ("vendor_name", F.when(k % 50 != 0, F.concat(F.lit("Vendor "), F.col("o_custkey").cast("string")))), ("invoice_number", F.concat(F.lit("INV-"), k.cast("string"))), ("invoice_date", F.date_format("o_orderdate", "dd/MM/yyyy")), ("due_date", F.date_format(due, "yyyy-MM-dd")),
        ("subtotal", (F.col("s") + F.when(k % 5 == 0, 1).otherwise(0).cast("decimal(18,2)")).cast("string")), ("total", (F.col("s") + F.when(k % 5 == 0, 1).otherwise(0).cast("decimal(18,2)")).cast("string")),
    ]
    rows = o.select(k.alias("k"), F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), v.alias("field_value"), F.lit(1000 + i).alias("field_ord")) for i, (n, v) in enumerate(head)))).alias("f"))
    every = long.unionByName(rows)
    return every.select(F.col("k").cast("string").alias("document_id"), F.lit("invoice").alias("document_type"), F.col("f.field_ord").alias("field_ord"), F.col("f.field_name").alias("field_name"), F.col("f.field_value").alias("field_value"), (F.lit(1.0) - (F.col("k") + F.col("f.field_ord")) % 60 / 100).alias("confidence"), F.lit("model").alias("source"), F.lit(False).alias("fallback_attempted"))


_ITEMS = f"SELECT l_orderkey, l_linenumber, max(q) AS q, max(t) AS t, arg_max(p, t * 1000000 + p) AS p FROM ({_LINES}) GROUP BY l_orderkey, l_linenumber"
_STATUS = f"""WITH i AS ({_ITEMS}), m AS (SELECT l_orderkey, sum(CASE WHEN abs(q * p - t) > 0.05 THEN 1 ELSE 0 END) AS bad, count(*) AS n, CAST(sum(t) AS DECIMAL(18,2)) AS s FROM i GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(6 + coalesce(3 * n, 0) AS BIGINT) AS total_fields,
CAST(coalesce(bad, 0) + (o_orderkey % 40 < 5)::INT + (o_orderkey % 50 = 0)::INT + (o_orderkey % 5 = 0 AND s IS NOT NULL)::INT + (s IS NULL)::INT AS BIGINT) AS needs_review_fields FROM orders LEFT JOIN m ON l_orderkey = o_orderkey"""


@query(f"SELECT document_id, total_fields, total_fields - needs_review_fields AS valid_fields, needs_review_fields, CAST(0 AS BIGINT) AS conflict_fields, CASE WHEN needs_review_fields = 0 THEN 'completed' ELSE 'needs_review' END AS status FROM ({_STATUS})")
def document_status_summary(spark, d):
    """The whole validator over all invoices, reduced to counts and a status."""
    return validate.summary(validate.validate(invoice_fields(spark, d), S)).drop("normalized_fields")


_TRIM = "regexp_replace(regexp_replace(CAST({} AS VARCHAR), '0+$', ''), '\\.$', '')"
_LATE = "strftime(o_orderdate + to_days(CAST(o_orderkey % 40 - 5 AS INTEGER)), '%Y-%m-%d')"


@query(
    f"""WITH i AS ({_ITEMS}), m AS (SELECT l_orderkey, CAST(sum(t) AS DECIMAL(18,2)) AS s FROM i GROUP BY l_orderkey), o AS (SELECT * FROM orders LEFT JOIN m ON l_orderkey = o_orderkey),
x AS (SELECT l_orderkey AS k, l_linenumber * 10 + 2 AS ord, 'line_item_' || l_linenumber || '_line_total' AS field_name, 'Line item total does not match quantity × unit price.' AS message, CAST(t AS VARCHAR) AS original_value, {_TRIM.format("t")} AS normalized_value FROM i WHERE abs(q * p - t) > 0.05
UNION ALL SELECT o_orderkey, 1000, 'vendor_name', 'Required invoice field ''vendor_name'' is missing.', NULL, NULL FROM o WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey, 1003, 'due_date', 'Due date is earlier than invoice date.', {_LATE}, {_LATE} FROM o WHERE o_orderkey % 40 < 5
UNION ALL SELECT o_orderkey, 1004, 'subtotal', 'Invoice subtotal does not match the sum of line items.', CAST(s + 1 AS VARCHAR), {_TRIM.format("CAST(s + 1 AS DECIMAL(18,2))")} FROM o WHERE o_orderkey % 5 = 0 AND s IS NOT NULL
UNION ALL SELECT o_orderkey, 1005, 'total', 'Required invoice field ''total'' is missing.', NULL, NULL FROM o WHERE s IS NULL)
SELECT CAST(k AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY k ORDER BY ord) AS INTEGER) AS issue_ord, field_name, 'needs_review' AS status, message, CAST(NULL AS VARCHAR) AS code, original_value, normalized_value FROM x"""
)
def validation_issues(spark, d):
    return validate.issues(validate.validate(invoice_fields(spark, d), S))


_DATE_FORMS = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"), ("MMM dd, yyyy", "%b %d, %Y"), ("MMMM dd, yyyy", "%B %d, %Y"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("dd-MMMM-yyyy", "%d-%B-%Y"), ("yyyy-MMM-dd", "%Y-%b-%d")]


@query("SELECT o_orderkey, " + "CASE CAST(o_orderkey % 13 AS INTEGER) " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (_, f) in enumerate(_DATE_FORMS)) + " ELSE 'not a date' END AS raw, CASE WHEN o_orderkey % 13 < 12 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, o_orderkey % 13 = 12 AS failed FROM orders")
def normalize_date(spark, d):
    rows = read(spark, d, "orders", "o_orderkey", "o_orderdate")
    raw = F.lit("not a date")
    for i, (f, _) in enumerate(_DATE_FORMS):
        raw = F.when(F.col("o_orderkey") % 13 == i, F.date_format("o_orderdate", f)).otherwise(raw)
    return rows.select("o_orderkey", raw.alias("raw")).withColumn("n", N.date(F.col("raw"))).select("o_orderkey", "raw", F.col("n.value").alias("value"), F.col("n.failed").alias("failed"))


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(
    f"""SELECT l_orderkey, l_linenumber, raw, CASE WHEN raw = 'n/k' THEN NULL ELSE regexp_replace(regexp_replace(printf('%d.%02d', c // 100, c % 100), '0+$', ''), '\\.$', '') END AS value FROM (SELECT l_orderkey, l_linenumber, c, CASE CAST(l_orderkey % 6 AS INTEGER)
WHEN 0 THEN printf('%d.%02d', c // 100, c % 100) WHEN 1 THEN '₹ ' || format('{{:,}}', c // 100) || printf('.%02d', c % 100) WHEN 2 THEN format('{{:,}}', c // 100) || printf('.%02d', c % 100) || ' %' WHEN 3 THEN 'USD ' || printf('%d.%02d', c // 100, c % 100)
WHEN 4 THEN '€' || replace(format('{{:,}}', c // 100), ',', '.') || printf(',%02d', c % 100) ELSE 'n/k' END AS raw FROM (SELECT l_orderkey, l_linenumber, {_CENTS} AS c FROM lineitem))"""
)
def normalize_number(spark, d):
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, cents = F.floor(c / 100).cast("long"), F.lpad((c % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    k = F.col("l_orderkey") % 6
    plain = F.concat(whole.cast("string"), F.lit("."), cents)
    raw = (
        F.when(k == 0, plain).when(k == 1, F.concat(F.lit("₹ "), grouped, F.lit("."), cents)).when(k == 2, F.concat(grouped, F.lit("."), cents, F.lit(" %"))).when(k == 3, F.concat(F.lit("USD "), plain))
        .when(k == 4, F.concat(F.lit("€"), F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), cents)).otherwise("n/k")
    )
    return rows.select("l_orderkey", "l_linenumber", raw.alias("raw")).withColumn("value", N.number(F.col("raw"))["value"])


@query("SELECT c_custkey, raw, CASE CAST(c_custkey % 7 AS INTEGER) WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN 'GBP' WHEN 5 THEN 'JPY' ELSE 'CHF' END AS value FROM (SELECT c_custkey, CASE CAST(c_custkey % 7 AS INTEGER) WHEN 0 THEN '₹100' WHEN 1 THEN 'dollars' WHEN 2 THEN '$ 5' WHEN 3 THEN '12 eur' WHEN 4 THEN '£' WHEN 5 THEN 'jpy' ELSE 'chf' END AS raw FROM customer)")
def normalize_currency(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["₹100", "dollars", "$ 5", "12 eur", "£", "jpy", "chf"])), (F.col("c_custkey") % 7 + 1).cast("int"))
    return read(spark, d, "customer", "c_custkey").select("c_custkey", raw.alias("raw")).withColumn("value", N.currency(F.col("raw"))["value"])


_MAILS = "SELECT c_custkey, CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN '  \"' || replace(c_name, '#', '.') || '@Example.COM\" ' WHEN 1 THEN '<' || lower(replace(c_name, '#', '_')) || '@mail.example.org>' WHEN 2 THEN replace(c_name, '#', '') || '@' ELSE '  ' END AS raw FROM customer"


def mails(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey") % 4, lambda to: F.replace(F.col("c_name"), F.lit("#"), F.lit(to))
    raw = F.when(k == 0, F.concat(F.lit('  "'), name("."), F.lit('@Example.COM" '))).when(k == 1, F.concat(F.lit("<"), F.lower(name("_")), F.lit("@mail.example.org>"))).when(k == 2, F.concat(name(""), F.lit("@"))).otherwise("  ")
    return read(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", raw.alias("raw"))


@query(f"SELECT c_custkey, value, value IS NULL OR regexp_full_match(value, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS ok FROM (SELECT c_custkey, nullif(lower(trim(raw, ' \"''<>')), '') AS value FROM ({_MAILS}))")
def email_validate(spark, d):
    return mails(spark, d).select("c_custkey", N.email(F.col("raw"))["value"].alias("value")).withColumn("ok", validate.email_ok(F.col("value")))


_PHONES = "SELECT c_custkey, CASE CAST(c_custkey % 3 AS INTEGER) WHEN 0 THEN '+1 (555) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 1 THEN 'ext. ' || CAST(c_custkey AS VARCHAR) ELSE '4000 1234 5678 ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS raw FROM customer"


@query(f"SELECT c_custkey, value, length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AS ok FROM (SELECT c_custkey, CASE WHEN starts_with(raw, '+') THEN '+' ELSE '' END || regexp_replace(raw, '[^0-9]', '', 'g') AS value FROM ({_PHONES}))")
def phone_validate(spark, d):
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("+1 (555) "), F.lpad(n, 7, "0"))).when(k == 1, F.concat(F.lit("ext. "), n)).otherwise(F.concat(F.lit("4000 1234 5678 "), F.lpad(n, 6, "0")))
    return read(spark, d, "customer", "c_custkey").select("c_custkey", N.phone(raw)["value"].alias("value")).withColumn("ok", validate.phone_ok(F.col("value")))


_SPACES = "[\\s\\x0B\\x{00A0}]"


@query(f"SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(text, '^{_SPACES}+|{_SPACES}+$', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g'), '{_SPACES}+', ' ', 'g'), '') AS value FROM documents")
def normalize_text(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", N.text(F.col("text"))["value"].alias("value"))


_NAMES = SECTION_FIELDS["invoice", "line_items"]


@query(
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY item, i) AS INTEGER) AS field_ord, 'line_item_' || item || '_' || {_NAMES}[i] AS field_name,
CASE i WHEN 2 THEN CAST(q AS VARCHAR) WHEN 3 THEN CAST(p AS VARCHAR) WHEN 5 THEN CAST(t AS VARCHAR) END AS field_value, CASE WHEN i IN (2, 3, 5) THEN 'number' ELSE 'null' END AS value_kind
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t, q, p) AS item, unnest(range(1, {len(_NAMES) + 1})) AS i FROM ({_LINES}))"""
)
def field_unpivot(spark, d):
    """Answers about the line items of every invoice, unpivoted by the extractor."""
    item = F.create_map(*(x for n, c in (("quantity", "q"), ("unit_price", "p"), ("line_total", "t")) for x in (F.lit(n), F.col(c).cast("string"))))
    told = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t", "q", "p", F.to_json(item).alias("j")))).alias("a"))
    key = F.col("l_orderkey").cast("string")
    body = F.concat(F.lit('{"items": ['), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]}"))
    answers = told.select(key.alias("document_id"), F.lit("extraction").alias("stage"), F.lit("items").alias("item_key"), body.alias("response_json"), F.lit(None).cast("string").alias("error"))
    found = told.select(key.alias("document_id"), F.lit("invoice").alias("document_type"), F.lit("items").alias("section_id"), F.lit(1).alias("section_ord"), F.lit("line_items").alias("section_name"), F.lit(1).alias("page_number"), F.lit("long enough").alias("text"))
    return extract.fields(found, answers).select("document_id", "field_ord", "field_name", "field_value", "value_kind")


def turns(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations", "conv_id", "turn", "text")
    return rows.select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS document_id, regexp_replace(string_agg('--- PAGE ' || (turn + 1) || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn + 1, text), '^\\s+|\\s+$', '', 'g') AS full_text, count(*) AS page_count FROM conversations GROUP BY conv_id")
def page_text_assembly(spark, d):
    return layout.document_texts(turns(spark, d))


@query("SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page_number FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 3 OR r <= 2 OR r = n")
def page_selection(spark, d):
    return classify.select_pages(turns(spark, d).select("document_id", "page_number"))


_WORDS = """SELECT doc_id, line, word, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) - 1 AS ord, pos FROM (SELECT doc_id, line, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT doc_id, generate_subscripts(l, 1) AS line, string_split(unnest(l), ' ') AS words FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents as OCR tokens: x from the place in the line, y from the line, confidence by key."""
    rows = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("pos", "text"))
    i = lambda c: c.cast("int")
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), (F.col("line") * 100_000 + F.col("pos")).alias("token_ord"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), i(F.col("line") + 1).alias("line_num"),
        i(F.col("pos") * 10).alias("left"), i(F.col("line") * 30).alias("top"), F.lit(8).alias("width"), F.lit(20).alias("height"), (F.pmod(F.col("doc_id") + F.col("pos"), F.lit(101))).cast("string").alias("conf"), "text",
    )


_BLOCKS = f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS block_index, text, confidence, x, y, width, height FROM (
SELECT doc_id, line, string_agg(regexp_replace(word, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), ' ' ORDER BY pos) AS text, round(avg((doc_id + pos - 1) % 101), 2) AS confidence, CAST(min((pos - 1) * 10) AS INTEGER) AS x, CAST(min((line - 1) * 30) AS INTEGER) AS y,
CAST(max((pos - 1) * 10 + 8) - min((pos - 1) * 10) AS INTEGER) AS width, 20 AS height FROM ({_WORDS}) WHERE regexp_replace(word, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') <> '' GROUP BY doc_id, line)"""


@query(f"SELECT document_id, block_index, text, confidence, x, y, width, height FROM ({_BLOCKS})")
def tokens_to_lines(spark, d):
    return layout.lines(tokens(spark, d)).select("document_id", "block_index", "text", "confidence", "bbox.*")


@query(f"SELECT document_id, count(*) AS block_count, CAST(1 AS BIGINT) AS page_count, CAST((2 * sum(CAST(round(confidence * 100) AS BIGINT)) + count(confidence)) // (2 * count(confidence)) AS DOUBLE) / 100 AS average_confidence FROM ({_BLOCKS}) GROUP BY document_id")
def ocr_metrics(spark, d):
    return layout.metrics(layout.lines(tokens(spark, d)))


@query(f"SELECT document_id, min(x) AS x, min(y) AS y, CAST(greatest(1, max(x + width) - min(x)) AS INTEGER) AS width, CAST(greatest(1, max(y + height) - min(y)) AS INTEGER) AS height FROM ({_BLOCKS}) GROUP BY document_id")
def bbox_union(spark, d):
    rows = layout.lines(tokens(spark, d)).select("document_id", "bbox.*")
    return rows.groupBy("document_id").agg(layout.union_box(1).alias("b")).select("document_id", "b.*")


@query(f"SELECT document_id, block_index, CAST(greatest(0, x - 25) AS INTEGER) AS x, CAST(greatest(0, y - 25) AS INTEGER) AS y, CAST(least(800, x + width + 25) - greatest(0, x - 25) AS INTEGER) AS width, CAST(least(1000, y + height + 25) - greatest(0, y - 25) AS INTEGER) AS height FROM ({_BLOCKS}) WHERE least(800, x + width + 25) > greatest(0, x - 25) AND least(1000, y + height + 25) > greatest(0, y - 25)")
def crop_clamp(spark, d):
    rows = layout.lines(tokens(spark, d)).select("document_id", "block_index", layout.crop_box(F.col("bbox"), F.lit(800), F.lit(1000)).alias("c"))
    return rows.where("c IS NOT NULL").select("document_id", "block_index", "c.*")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' WHEN doc_id % 100 < 70 THEN 'unknown' WHEN doc_id % 3 = 1 THEN 'invoice' ELSE 'onboarding_form' END AS document_type, doc_id % 3 <> 0 AND doc_id % 100 < 70 AS below_threshold, CASE WHEN doc_id % 3 <> 0 AND doc_id % 100 < 70 THEN 'Confidence (' || printf('%.2f', (doc_id % 100) / 100.0) || ') was below threshold (0.70); marked as unknown.' ELSE lang END AS evidence FROM documents")
def classify_threshold(spark, d):
    kind = F.element_at(F.array(F.lit("unknown"), F.lit("invoice"), F.lit("onboarding_form")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = read(spark, d, "documents", "doc_id", "lang").select(F.col("doc_id").cast("string").alias("document_id"), kind.alias("raw_document_type"), (F.col("doc_id") % 100 / 100).alias("confidence"), F.array("lang").alias("evidence"))
    return classify.apply_threshold(rows, S).select("document_id", "document_type", "below_threshold", F.element_at("evidence", -1).alias("evidence"))


@query("SELECT CAST(user_id AS VARCHAR) AS document_id, event_id, CASE WHEN event_type = 'view' THEN 'line_items' WHEN event_type = 'click' THEN 'notes' WHEN event_type = 'purchase' THEN 'tax_information' ELSE 'unknown' END AS section_name FROM events WHERE user_id % 2 = 0")
def section_whitelist(spark, d):
    name = F.element_at(F.create_map(*map(F.lit, ["view", "line_items", "click", "notes", "purchase", "tax_information", "signup", "sign_up", "error", "personal_information"])), F.col("event_type"))
    rows = read(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").cast("string").alias("document_id"), "event_id", name.alias("section_name"))
    types = read(spark, d, "events", "user_id").distinct().select(F.col("user_id").cast("string").alias("document_id"), F.when(F.col("user_id") % 2 == 0, "invoice").otherwise("unknown").alias("document_type"))
    return sections.hold_to_whitelist(rows, types).select("document_id", "event_id", "section_name")


def doubtful(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    m = F.element_at(F.array(*map(F.lit, ["Email format is invalid.", "Invoice total does not match calculated.", "Due date is earlier than invoice date.", "Could not parse numeric value from 'x'", "ok"])), (k % 5 + 1).cast("int"))
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("total").alias("field_name"), F.when(k % 9 != 0, dec(F.col("l_extendedprice")).cast("string")).alias("field_value"), (F.lit(1.0) - k % 50 / 100).alias("confidence"), F.when(k % 2 == 0, "needs_review").otherwise("valid").alias("validation_status"), m.alias("validation_message"), (k % 13 == 0).alias("fallback_attempted"))


_DOUBT = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_orderkey * 7 + l_linenumber AS k FROM lineitem"


@query(
    f"""SELECT l_orderkey, l_linenumber, k, reason FROM (SELECT l_orderkey, l_linenumber, k, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 50 > 30 THEN 'Low OCR confidence (' || printf('%.2f', (100 - k % 50) / 100.0) || ' < 0.70)' WHEN k % 2 <> 0 THEN NULL
WHEN k % 9 = 0 THEN 'Missing value flagged during validation: ' || m WHEN k % 5 IN (1, 2) THEN NULL WHEN k % 5 IN (0, 3) THEN 'OCR format/corruption issue: ' || m END AS reason
FROM (SELECT *, CASE CAST(k % 5 AS INTEGER) WHEN 0 THEN 'Email format is invalid.' WHEN 1 THEN 'Invoice total does not match calculated.' WHEN 2 THEN 'Due date is earlier than invoice date.' WHEN 3 THEN 'Could not parse numeric value from ''x''' ELSE 'ok' END AS m FROM ({_DOUBT}))) WHERE reason IS NOT NULL"""
)
def vision_candidates(spark, d):
    return vision.candidates(doubtful(spark, d), S).select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"), F.col("candidate_reason").alias("reason"))


@query(
    f"""SELECT l_orderkey, l_linenumber, k, CASE WHEN k % 6 = 0 THEN 'unreadable' WHEN k % 9 <> 0 AND k % 6 IN (1, 2) THEN 'agreed' WHEN k % 9 = 0 OR (k % 50 > 30 AND k % 4 <> 0) THEN 'recovered' ELSE 'conflict' END AS action_taken,
CASE WHEN k % 6 = 0 THEN CASE WHEN k % 9 <> 0 THEN v END WHEN k % 9 <> 0 AND k % 6 IN (1, 2) THEN v WHEN k % 9 = 0 OR (k % 50 > 30 AND k % 4 <> 0) THEN CASE WHEN k % 6 = 1 THEN v WHEN k % 6 = 2 THEN '$ ' || v ELSE '9' || v END ELSE v END AS field_value
FROM (SELECT l_orderkey, l_linenumber, k, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM ({_DOUBT}))"""
)
def vision_evaluate(spark, d):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("k", k).withColumn("row", F.monotonically_increasing_id())
    v = dec(F.col("l_extendedprice")).cast("string")
    none = {c: F.lit(None).cast(t) for c, t in (("ocr_value", "string"), ("ocr_confidence", "double"), ("validation_message", "string"))}
    asked = rows.select(
        "row", "l_orderkey", "l_linenumber", "k", F.when(F.col("k") % 9 != 0, v).alias("field_value"), (F.lit(1.0) - F.col("k") % 50 / 100).alias("confidence"), F.lit("model").alias("source"), F.lit("valid").alias("validation_status"), F.lit("asked").alias("candidate_reason"), F.struct(F.lit(1)).alias("crop"),
        F.when(F.col("k") % 6 == 0, F.lit(None)).when(F.col("k") % 6 == 1, v).when(F.col("k") % 6 == 2, F.concat(F.lit("$ "), v)).otherwise(F.concat(F.lit("9"), v)).alias("_v"), F.when(F.col("k") % 4 == 0, 0.5).otherwise(0.9).alias("_c"),
    ).withColumns(none)
    return vision.outcome(asked, S).select("l_orderkey", "l_linenumber", "k", "action_taken", "field_value")


@query("SELECT p_partkey, CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS agree FROM part")
def values_agree(spark, d):
    price = dec(F.col("p_retailprice")).cast("string")
    k = F.col("p_partkey") % 5
    other = F.when(k == 0, F.concat(F.lit(" $"), price)).when(k == 1, F.concat(price, F.lit(" "))).when(k == 2, (dec(F.col("p_retailprice")) + F.lit("0.03").cast("decimal(18,2)")).cast("string")).when(k == 3, (dec(F.col("p_retailprice")) + F.lit("1.00").cast("decimal(18,2)")).cast("string")).otherwise("")
    return read(spark, d, "part", "p_partkey", "p_retailprice").select("p_partkey", N.values_agree(price, other).alias("agree"))


_NAMES = ["vendor_tax_id", "account_number", "vendor_name", "id_doc_1_document_number", "total"]


@query("SELECT s_suppkey, name, CASE WHEN trim(v) = '' THEN NULL WHEN name IN ('vendor_tax_id', 'account_number', 'id_doc_1_document_number') THEN '[PRESENT - SENSITIVE VALUE PROTECTED]' ELSE v END AS shown FROM (SELECT s_suppkey, ['vendor_tax_id', 'account_number', 'vendor_name', 'id_doc_1_document_number', 'total'][CAST(s_suppkey % 5 AS INTEGER) + 1] AS name, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name END AS v FROM supplier)")
def mask_sensitive(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "supplier", "s_suppkey", "s_name").select("s_suppkey", name.alias("field_name"), F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name")).alias("field_value"), F.lit(None).cast("string").alias("normalized_value"))
    return rows.select("s_suppkey", F.col("field_name").alias("name"), insights.display(S).alias("shown"))


@query(
    """SELECT o_orderkey, 'Pay invoice totaling USD ' || format('{:,}', c // 100) || printf('.%02d', c % 100) || ' to ' || c_name AS action, due AS due_date, CASE WHEN due <= DATE '1998-08-09' THEN 'high' ELSE 'medium' END AS priority,
CASE WHEN due < DATE '1998-08-02' THEN 'Payment is overdue since ' || strftime(due, '%Y-%m-%d') || '.' WHEN due <= DATE '1998-08-09' THEN 'Payment due date (' || strftime(due, '%Y-%m-%d') || ') is approaching within 7 days.' ELSE 'Invoice payable by due date ' || strftime(due, '%Y-%m-%d') || '.' END AS reason
FROM (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due FROM orders) JOIN customer ON c_custkey = o_custkey WHERE c > 0"""
)
def payment_actions(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    total = (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    rows = o.join(read(spark, d, "customer", "c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    a = insights.payment(total, F.date_add(F.col("o_orderdate").cast("date"), 30), F.lit(None).cast("string"), F.col("c_name"), S)
    return rows.select("o_orderkey", a.alias("a")).where("a IS NOT NULL").select("o_orderkey", "a.action", "a.due_date", "a.priority", "a.reason")


_ISSUES = f"SELECT l_orderkey, CASE WHEN bad_lines > 0 THEN 'line_total' ELSE 'subtotal' END AS f, CASE WHEN bad_lines > 0 THEN 'Line item total does not match quantity × unit price.' ELSE 'Required value missing' END AS m FROM (SELECT l_orderkey, sum(CASE WHEN abs(q * p - t) > 0.05 THEN 1 ELSE 0 END) AS bad_lines FROM ({_LINES}) GROUP BY l_orderkey)"


@query(f"SELECT l_orderkey, CASE WHEN f = 'line_total' THEN 'Resolve calculation discrepancy on ''line_total''' ELSE 'Obtain missing required information for ''subtotal''' END AS action, 'high' AS priority, 'rule_based' AS source, m AS reason FROM ({_ISSUES})")
def issue_actions(spark, d):
    bad = F.count_if(validate.over(F.col("q") * F.col("p"), F.col("t"))) > 0
    rows = lines(spark, d).groupBy("l_orderkey").agg(bad.alias("b"))
    rows = rows.select("l_orderkey", F.when(F.col("b"), "line_total").otherwise("subtotal").alias("f"), F.when(F.col("b"), "Line item total does not match quantity × unit price.").otherwise("Required value missing").alias("m"))
    a = insights.issue_action(F.col("f"), F.lit("needs_review"), F.col("m"), F.lit(None).cast("string"))
    return rows.select("l_orderkey", a.alias("a")).select("l_orderkey", "a.action", "a.priority", "a.source", "a.reason")


def new_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    said = F.concat(F.lit("Check part "), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "!").otherwise(""))
    return rows.select(F.col("l_orderkey").cast("string").alias("document_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"), said.alias("action"), F.lit("medium").alias("priority"), F.lit(None).cast("date").alias("due_date"), F.lit("rule_based").alias("source"), F.lit(None).cast("string").alias("reason")).distinct()


_FIRST = """SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord) AS INTEGER) AS action_ord, action, key FROM (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY ord, action) AS r FROM (
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber * 1000000 + l_partkey AS ord, 'Check part ' || l_partkey % 3 || CASE WHEN l_linenumber % 2 = 0 THEN '!' ELSE '' END AS action, 'checkpart' || l_partkey % 3 AS key FROM lineitem)) WHERE r = 1"""


@query(f"SELECT document_id, action_ord, action FROM ({_FIRST}) WHERE action_ord <= 2")
def action_dedup_topk(spark, d):
    return insights.first_of_key(new_actions(spark, d), Settings(as_of=AS_OF, max_actions=2)).select("document_id", "action_ord", "action")


@query(
    f"""WITH n AS ({_FIRST}), o AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'check PART ' || o_orderkey % 4 AS action, 'checkpart' || o_orderkey % 4 AS key, CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 'completed' WHEN 1 THEN 'dismissed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'user' ELSE 'ai' END AS source FROM orders)
SELECT n.document_id, n.action, coalesce(o.status, 'pending') AS status FROM n LEFT JOIN o ON n.document_id = o.document_id AND n.key = o.key UNION ALL SELECT document_id, action, status FROM o WHERE (source = 'user' OR status IN ('completed', 'in_progress')) AND NOT EXISTS (SELECT 1 FROM n WHERE n.document_id = o.document_id AND n.key = o.key)"""
)
def action_reconcile(spark, d):
    k = F.col("o_orderkey")
    old = read(spark, d, "orders", "o_orderkey").select(
        k.cast("string").alias("document_id"), F.lit(1).alias("action_ord"), k.cast("string").alias("action_id"), F.concat(F.lit("check PART "), (k % 4).cast("string")).alias("action"), F.lit("low").alias("priority"), F.lit(None).cast("date").alias("due_date"),
        F.element_at(F.array(F.lit("completed"), F.lit("dismissed"), F.lit("pending")), (k % 3 + 1).cast("int")).alias("status"), F.when(k % 5 == 0, "user").otherwise("ai").alias("source"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    return insights.reconcile(insights.first_of_key(new_actions(spark, d), S), old).select("document_id", "action", "status")


def logs(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").otherwise("completed")
    return read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props").select(F.col("user_id").cast("string").alias("document_id"), F.get(F.array(*map(F.lit, STAGES)), F.coalesce(k, F.lit(0)) % 3).alias("stage"), status.alias("status"), F.date_trunc("day", "ts").alias("created_at"))


_LOGS = f"SELECT CAST(user_id AS VARCHAR) AS document_id, {STAGES}[coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 3 + 1] AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'completed' END AS status, date_trunc('day', ts) AS created_at FROM events"


@query(
    f"""SELECT document_id, stage, status, created_at, log_rows FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS log_rows,
row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, list_position({STAGES}, stage) DESC, status <> 'started' DESC, status DESC) AS r FROM ({_LOGS})) WHERE r = 1"""
)
def latest_status(spark, d):
    return audit.latest_status(logs(spark, d))


@query(
    f"""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS document_id, {STAGES}[CAST(event_id % {len(STAGES)} AS INTEGER) + 1] AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'completed' END AS status, event_id FROM events),
last AS (SELECT document_id, stage, arg_max(status, event_id) AS s FROM l GROUP BY document_id, stage), d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS document_id, user_id % 3 = 0 AS unknown FROM events)
SELECT d.document_id, CAST(i - 1 AS INTEGER) AS step, {STAGES}[i] AS stage, CASE WHEN unknown AND i - 1 > {STAGES.index("classification")} THEN 'skipped' WHEN s = 'started' THEN 'active' ELSE coalesce(s, 'pending') END AS state
FROM (SELECT *, unnest(range(1, {len(STAGES) + 1})) AS i FROM d) d LEFT JOIN last ON last.document_id = d.document_id AND last.stage = {STAGES}[i]"""
)
def stage_stepper(spark, d):
    rows = read(spark, d, "events", "event_id", "user_id", "event_type")
    key = F.col("user_id").cast("string").alias("document_id")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").otherwise("completed")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % len(STAGES) + 1).cast("int"))
    documents = rows.select(key, F.when(F.col("user_id") % 3 == 0, "unknown").otherwise("invoice").alias("document_type")).distinct()
    return audit.stepper(documents, rows.select(key, stage.alias("stage"), status.alias("status"), F.col("event_id").alias("created_at")))


@query(f"SELECT stage, status, count(*) AS n, count(DISTINCT document_id) AS documents FROM ({_LOGS}) GROUP BY stage, status")
def audit_counts(spark, d):
    return audit.counts(logs(spark, d))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_windowed(spark, d):
    return stream.windowed_counts(read(spark, d, "events", "ts", "event_type"), "1 hour", "1 hour", "ts", "event_type")


@query("SELECT p_partkey, p_name, p_partkey % 2 = 0 AS valid FROM part WHERE (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e')) AND p_partkey % 2 = 0")
def field_search_filter(spark, d):
    rows = read(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", "p_name", F.col("p_name").alias("field_name"), F.col("p_type").alias("field_value"), F.lit(None).cast("string").alias("normalized_value"), F.when(F.col("p_partkey") % 2 == 0, "valid").otherwise("conflict").alias("validation_status"))
    return ingest.search(rows, "E", "valid").select("p_partkey", "p_name", (F.col("validation_status") == "valid").alias("valid"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'unsupported extension' WHEN page_id % 9 = 0 THEN 'unsupported type' WHEN page_id % 10 = 0 THEN 'empty file' WHEN page_id % 11 = 0 THEN 'file too large' END AS reject_reason, 'my_file_' || page_id || ['.pdf', '.PNG', '.jpg', '.exe'][CAST(page_id % 4 AS INTEGER) + 1] AS safe_name FROM pages")
def upload_checks(spark, d):
    k = F.col("page_id")
    name = F.concat(F.lit("C:\\in\\my file "), k.cast("string"), F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".jpg", ".exe"])), (k % 4 + 1).cast("int")))
    size = F.when(k % 10 == 0, 0).when(k % 11 == 0, 10 * 1024 * 1024 + 1).otherwise(500)
    rows = read(spark, d, "pages", "page_id").select("page_id", k.cast("string").alias("document_id"), name.alias("filename"), F.when(k % 9 == 0, "text/plain").otherwise("image/jpg").alias("mime_type"), size.alias("file_size"))
    return ingest.check_uploads(rows, S).select("page_id", "reject_reason", "safe_name")


_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]
_SIZED = "SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS u FROM (SELECT doc_id, CAST(n_chars AS BIGINT) * [1, 1000, 1000000, 1000000000][CAST(doc_id % 4 AS INTEGER) + 1] AS n FROM documents)"


@query(f"SELECT doc_id, n, CASE WHEN n <= 0 OR n IS NULL THEN '0 Bytes' ELSE regexp_replace(regexp_replace((h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0'), '0+$', ''), '\\.$', '') || ' ' || {_UNITS}[u + 1] END AS shown FROM (SELECT *, (200 * CAST(n AS HUGEINT) + (1::HUGEINT << (10 * u))) // (2 * (1::HUGEINT << (10 * u))) AS h FROM ({_SIZED}))")
def format_bytes(spark, d):
    rows = read(spark, d, "documents", "doc_id", "n_chars")
    times = F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 1000, 1_000_000, 1_000_000_000))), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select("doc_id", (F.col("n_chars").cast("long") * times).alias("n")).withColumn("shown", T.bytes_title(F.col("n")))
