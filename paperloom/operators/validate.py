"""Validation of extracted fields: normal forms, conflicts, formats and business rules, over all documents at once.

Every rule computes its own flag; the last rule that speaks decides a field's status, in the order
base, conflict, format, required, dates, line math, subtotal, tax, total. Rules on a name look at the
last field of that name (field_ord). Fields are shuffled once, by document, and sorted once; conflicts, facts
and line items are windows over that order, and placeholders come out of a document's first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.text import blank
from ..schemas import REQUIRED_INVOICE
from ..settings import DEFAULT, Settings

EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
_LINE = r"^line_item_(\d+)_(quantity|unit_price|line_total)$"
_AMOUNTS = ["subtotal", "tax_amount", "discount", "total"]
_NO_CONTACT = "At least one contact method (email or phone) is required."


def email_ok(v: Column) -> Column:
    return v.isNull() | (v == "") | v.rlike(EMAIL)


def phone_ok(v: Column) -> Column:
    return v.isNull() | (v == "") | F.length(F.regexp_replace(v, "[^0-9]", "")).between(7, 15)


def money(c: Column) -> Column:
    return c.try_cast("decimal(18,2)")


def over(a: Column, b: Column, s: Settings = DEFAULT) -> Column:
    """Whether two amounts differ by more than the tolerance; null if either is."""
    return F.abs(a - b) > F.lit(s.rounding_tolerance).cast("decimal(18,2)")


def tax_expected(subtotal: Column, rate: Column) -> Column:
    """A rate above 1 is percent, otherwise a fraction."""
    return subtotal * F.when(rate > 1, (rate / 100)).otherwise(rate)


def normalize_fields(fields: DataFrame) -> DataFrame:
    """The fields with normalized_value, _lname (the name in lower case, made once: Spark's lower is slow) and what normalisation says of the value."""
    made = fields.withColumn("_lname", F.lower("field_name")).withColumn("_kind", N.kind_of(F.col("_lname"))).withColumn("_n", N.field_of(F.col("_kind"), F.col("field_value")))
    base = F.when(F.col("field_value").isNull() | ~F.col("_n.failed"), "valid").otherwise("needs_review")
    return made.withColumns({"normalized_value": F.col("_n.value"), "_base": base, "_base_message": F.when(base != "valid", F.coalesce("_n.message", F.lit("Field format is invalid or ambiguous.")))}).drop("_n", "_kind")


#: Fields of one name; their line number follows from the name, so rows in order of document, line and name serve all windows.
_NAMED = ("document_id", "_idx", "_lname")


def _several(s: Settings) -> Column:
    """Whether a document's fields of one name have several normal forms."""
    name = F.col("_lname")
    out = name.startswith("line_item_") | name.startswith("agreement_") | name.startswith("identity_doc_")
    if not s.legacy:
        out = out | name.startswith("id_doc_")
    named = Window.partitionBy(*_NAMED)
    return ~out & (F.min("normalized_value").over(named) < F.max("normalized_value").over(named))


def _rule(flags: dict[int, Column]) -> Column:
    """The last rule that speaks, or -1."""
    out = F.lit(-1)
    for i, hit in sorted(flags.items()):
        out = F.when(F.coalesce(hit, F.lit(False)), i).otherwise(out)
    return out


def validate(fields: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The fields with normalized_value, validation_status and validation_message, and placeholders for what is missing.

    What a window finds is held against its rules before the next one: rows stay narrow, and no step has so many
    expressions that its code is too long to be compiled."""
    columns = [c for c in fields.columns if c not in ("normalized_value", "validation_status", "validation_message")]
    document, line, named = Window.partitionBy("document_id"), Window.partitionBy("document_id", "_idx"), Window.partitionBy(*_NAMED)
    name, order, normal, last = F.col("_lname"), F.col("field_ord"), F.col("normalized_value"), F.col("_last")
    invoice, onboarding = F.col("document_type") == "invoice", F.col("document_type") == "onboarding_form"
    is_line = name.startswith("line_item_")
    rows = normalize_fields(fields)
    rows = rows.withColumns({c: F.when(is_line, F.regexp_extract(name, _LINE, i)).otherwise("") for c, i in (("_idx", 1), ("_prop", 2))})
    rows = rows.repartition("document_id").sortWithinPartitions(*_NAMED)  # the only sort: every window's order is a part of it
    # nothing is listed where all are alike
    listed = F.when(F.col("_several"), F.array_sort(F.collect_set("normalized_value").over(named)))
    amount = F.when(name.isin(*_AMOUNTS) | (F.col("_prop") != ""), money(normal))
    rows = rows.withColumns({"_several": _several(s), "_last": order.eqNullSafe(F.max(order).over(named)), "_amount": amount}).withColumn("_values", listed)
    part = lambda p: F.max_by(F.when(F.col("_prop") == p, F.col("_amount")), F.when(F.col("_prop") == p, order)).over(line)
    rows = rows.withColumns({f"_p_{p}": part(p) for p in ("quantity", "unit_price", "line_total")})
    empty = blank(F.col("field_value"))
    own = {  # of a field by itself and its line
        0: F.col("_several"), 1: name.contains("email") & ~email_ok(normal), 2: name.contains("phone") & ~phone_ok(normal), 3: invoice & last & name.isin(REQUIRED_INVOICE) & empty,
        5: invoice & last & (F.col("_prop") == "line_total") & over(F.col("_p_quantity") * F.col("_p_unit_price"), F.col("_p_line_total"), s), 9: onboarding & last & (name == "full_name") & empty,
    }
    rows = rows.withColumns({"_own": _rule(own), "_empty": empty, "_at": F.monotonically_increasing_id()}).drop("_p_quantity", "_p_unit_price", "_p_line_total")
    fact = lambda n, of: F.max_by(F.when(name == n, of), F.when(name == n, order)).over(document)
    facts = {f"f_{n}": fact(n, F.col("_amount")) for n in _AMOUNTS} | {f"f_{n}": fact(n, normal) for n in ("invoice_date", "due_date", "tax_rate")}
    facts |= {f"e_{n}": fact(n, F.col("_empty")) for n in ("email", "phone", "vendor_name", "invoice_number", "invoice_date", "total", "full_name")}
    rows = rows.withColumns(facts | {"_lines": F.sum(F.when(last & (F.col("_prop") == "line_total"), F.col("_amount"))).over(document), "_first": F.min("_at").over(document) == F.col("_at")})
    f, has = lambda n: F.col(f"f_{n}"), lambda n: F.col(f"e_{n}").isNotNull()
    rate, zero = f("tax_rate").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,2)")
    neither = F.coalesce(F.col("e_email"), F.lit(True)) & F.coalesce(F.col("e_phone"), F.lit(True))
    tax = F.when(rate > 0, over(tax_expected(f("subtotal"), rate).cast("decimal(18,4)"), f("tax_amount"), s))
    total = over(f("subtotal") + F.coalesce(f("tax_amount"), zero) - F.coalesce(f("discount"), zero), f("total"), s)
    held = {  # of a field and its document
        4: invoice & (name == "due_date") & (f("due_date") < f("invoice_date")), 6: invoice & (name == "subtotal") & over(F.col("_lines"), f("subtotal"), s), 7: invoice & (name == "tax_amount") & tax,
        8: invoice & (name == "total") & total, 10: onboarding & neither & ((name == "email") | (~has("email") & (name == "phone"))),
    }
    said = [*((invoice & ~has(n), n, "invoice_metadata", f"Required invoice field '{n}' is missing.") for n in REQUIRED_INVOICE)]
    said += [(onboarding & ~has("full_name"), "full_name", "personal_information", "Required full name is missing."), (onboarding & neither & ~has("email") & ~has("phone"), "email", "contact_information", _NO_CONTACT)]
    absent = F.concat(*(F.when(hit, F.array(F.lit(i))).otherwise(F.array().cast("array<int>")) for i, (hit, *_) in enumerate(said)))
    one = F.array(F.lit(-1))
    every = F.when(F.col("_first"), F.concat(one, absent)).otherwise(one)
    rows = rows.withColumn("_rule", F.when(last, F.greatest("_own", _rule(held))).otherwise(F.col("_own")))
    rows = rows.select(*columns, "normalized_value", "_base", "_base_message", "_lname", "_values", "_rule", f("tax_rate").alias("_rate"), F.explode(every).alias("_absent"))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    messages = [
        text("Multiple conflicting values detected for '", F.col("field_name"), "': ['", F.array_join("_values", "', '"), "']"), "Email format is invalid.", "Phone number must contain between 7 and 15 digits.",
        text("Required invoice field '", name, "' is missing."), "Due date is earlier than invoice date.", "Line item total does not match quantity × unit price.", "Invoice subtotal does not match the sum of line items.",
        text("Tax amount does not match expected tax from rate (", F.col("_rate"), "%)."), "Invoice total does not match subtotal + tax - discount.", "Required full name is missing.", _NO_CONTACT,
    ]
    message = F.col("_base_message")
    for i, why in enumerate(messages):
        message = F.when(F.col("_rule") == i, why).otherwise(message)
    status = F.when(F.col("_rule") < 0, F.col("_base")).when(F.col("_rule") == 0, "conflict").otherwise("needs_review")
    rows = rows.withColumns({"validation_status": status, "validation_message": message})
    absent = F.col("_absent")
    pick = lambda at: F.get(F.array(*(F.lit(x[at]) for x in said)), absent)
    made = {"document_id": F.col("document_id"), "document_type": F.col("document_type"), "field_ord": 1_000_000 + absent, "field_name": pick(1), "confidence": F.lit(1.0), "source": F.lit("validation"), "section_name": pick(2), "page_number": F.lit(1), "fallback_attempted": F.lit(False), "validation_status": F.lit("needs_review"), "validation_message": pick(3)}
    out = [*columns, "normalized_value", "validation_status", "validation_message"]
    return rows.select(*(F.col(c) if c in ("document_id", "document_type") else F.when(absent < 0, F.col(c)).otherwise(made.get(c, F.lit(None)).cast(rows.schema[c].dataType)).alias(c) for c in out))


def summary(validated: DataFrame) -> DataFrame:
    """Counts by document, and the status that they give it."""
    c = lambda st: F.count_if(F.col("validation_status") == st)
    out = validated.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if(F.coalesce(F.col("validation_status"), F.lit("valid")) == "valid").alias("valid_fields"), c("needs_review").alias("needs_review_fields"),
        c("conflict").alias("conflict_fields"), F.count("normalized_value").alias("normalized_fields"),
    )
    return out.withColumn("status", F.when((F.col("needs_review_fields") == 0) & (F.col("conflict_fields") == 0), "completed").otherwise("needs_review"))


def issues(validated: DataFrame) -> DataFrame:
    """Fields that are not valid, in field order."""
    w = Window.partitionBy("document_id").orderBy("field_ord")
    bad = validated.where(F.coalesce(F.col("validation_status"), F.lit("valid")) != "valid")
    return bad.select("document_id", F.row_number().over(w).alias("issue_ord"), "field_name", F.col("validation_status").alias("status"), F.col("validation_message").alias("message"), F.lit(None).cast("string").alias("code"), F.col("field_value").alias("original_value"), "normalized_value")
