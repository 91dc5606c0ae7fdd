"""Every rule of validation, on small documents."""

import pytest

from paperloom.operators import validate as V

SCHEMA = "document_id string, document_type string, field_ord int, field_name string, field_value string, confidence double, source string, section_name string, page_number int, fallback_attempted boolean"


def fields(spark, docs):
    """docs: {id: (type, {name: value} or [(name, value)])}"""
    rows = []
    for d, (kind, values) in docs.items():
        for i, (n, v) in enumerate(values.items() if isinstance(values, dict) else values):
            rows.append((d, kind, i, n, v, 0.95, "model", "s", 1, False))
    return spark.createDataFrame(rows, SCHEMA)


CLEAN = {
    "vendor_name": "Acme Corp", "invoice_number": "INV-2026-001", "invoice_date": "01/09/2026", "due_date": "15/09/2026", "line_item_1_description": "Cloud Hosting", "line_item_1_quantity": "2.0", "line_item_1_unit_price": "100.0",
    "line_item_1_line_total": "200.0", "subtotal": "₹200.00", "tax_rate": "18%", "tax_amount": "36.00", "discount": "0", "total": "₹236.00",
}
HEAD = {"vendor_name": "A", "invoice_number": "1", "invoice_date": "2026-09-01"}
FORM = {"full_name": "Jane Doe", "email": "jane@x.org"}
CASES = {
    "clean": ("invoice", CLEAN, {}),
    "line": ("invoice", HEAD | {"line_item_1_quantity": "2.0", "line_item_1_unit_price": "100.0", "line_item_1_line_total": "250.0", "total": "250"}, {"line_item_1_line_total": "Line item total does not match quantity × unit price."}),
    "subtotal": ("invoice", HEAD | {"line_item_1_line_total": "100", "line_item_2_line_total": "200", "line_item_3_line_total": "300", "subtotal": "700.00", "total": "700"}, {"subtotal": "Invoice subtotal does not match the sum of line items."}),
    "total": ("invoice", HEAD | {"subtotal": "1000.00", "tax_amount": "180.00", "discount": "0.00", "total": "1500.00"}, {"total": "Invoice total does not match subtotal + tax - discount."}),
    "tax": ("invoice", HEAD | {"subtotal": "100", "tax_rate": "18", "tax_amount": "20", "total": "120"}, {"tax_amount": "Tax amount does not match expected tax from rate (18%)."}),
    "fraction": ("invoice", HEAD | {"subtotal": "100", "tax_rate": "0.18", "tax_amount": "18.05", "total": "118"}, {}),
    "late": ("invoice", HEAD | {"invoice_date": "2026-09-20", "due_date": "2026-09-10", "total": "1"}, {"due_date": "Due date is earlier than invoice date."}),
    "optional": ("invoice", HEAD | {"total": "1", "notes": None, "purchase_order_number": None}, {}),
    "missing": ("invoice", {"vendor_name": "A", "invoice_date": "2026-09-01", "total": "1"}, {"invoice_number": "Required invoice field 'invoice_number' is missing."}),
    "blank": ("invoice", HEAD | {"vendor_name": " ", "total": "1"}, {"vendor_name": "Required invoice field 'vendor_name' is missing."}),
    "bad mail": ("onboarding_form", {"full_name": "D", "email": "someone@"}, {"email": "Email format is invalid."}),
    "bad phone": ("onboarding_form", FORM | {"phone": "123"}, {"phone": "Phone number must contain between 7 and 15 digits."}),
    "form": ("onboarding_form", FORM | {"date_of_birth": "15/08/1995", "phone": "+1 (555) 234-5678", "joining_date": "01-Sep-2026"}, {}),
    "no name": ("onboarding_form", {"email": "a@b.co"}, {"full_name": "Required full name is missing."}),
    "no contact": ("onboarding_form", {"full_name": "D", "phone": ""}, {"phone": "At least one contact method (email or phone) is required."}),
    "none at all": ("onboarding_form", {"full_name": "D"}, {"email": "At least one contact method (email or phone) is required."}),
    "unknown": ("unknown", {"total": "x"}, {"total": "Could not parse numeric value from 'x'"}),
}


@pytest.fixture(scope="module")
def checked(spark):
    return V.validate(fields(spark, {d: (k, v) for d, (k, v, _) in CASES.items()})).cache()


def test_rules(checked):
    found = {d: {} for d in CASES}
    for r in V.issues(checked).collect():
        assert r.status == "needs_review"
        found[r.document_id][r.field_name] = r.message
    assert found == {d: w for d, (_, _, w) in CASES.items()}


def test_summary(checked):
    by = {r.document_id: r for r in V.summary(checked).collect()}
    assert (by["clean"].status, by["clean"].valid_fields, by["clean"].total_fields) == ("completed", 13, 13)
    assert all(by[d].status == ("needs_review" if w else "completed") for d, (_, _, w) in CASES.items())
    assert by["missing"].total_fields == 4


def test_values_stay(checked):
    rows = {r.field_name: r for r in checked.where("document_id = 'clean'").collect()}
    assert all(rows[n].field_value == v for n, v in CLEAN.items())
    assert (rows["invoice_date"].normalized_value, rows["total"].normalized_value) == ("2026-09-01", "236")


def test_again_is_the_same(checked):
    again = V.validate(checked.where("source <> 'validation'"))
    key = lambda df: sorted((r.document_id, r.field_name, r.normalized_value or "", r.validation_status, r.validation_message or "") for r in df.collect())
    assert key(again) == key(checked)


def test_conflicts(spark):
    docs = {
        "two": ("invoice", [*HEAD.items(), ("total", "1"), ("po", "INV-1001"), ("PO", "INV-1002")]), "same": ("invoice", [*HEAD.items(), ("total", "1"), ("po", "INV-1001"), ("po", "INV-1001")]),
        "ids": ("onboarding_form", [*FORM.items(), ("id_doc_1_document_number", "1"), ("id_doc_1_document_number", "2")]),
    }
    bad = V.issues(V.validate(fields(spark, docs))).collect()
    assert {(r.document_id, r.field_name, r.status) for r in bad} == {("two", "po", "conflict"), ("two", "PO", "conflict")}
    assert bad[0].message.endswith("': ['INV-1001', 'INV-1002']")


def test_rules_use_the_last_of_a_name(spark):
    docs = {"d": ("invoice", [*HEAD.items(), ("total", "5"), ("subtotal", "9"), ("subtotal", "5")])}
    assert {r.field_name for r in V.issues(V.validate(fields(spark, docs))).collect()} == {"subtotal"}
    assert {r.status for r in V.issues(V.validate(fields(spark, docs))).collect()} == {"conflict"}


def test_empty(spark):
    none = fields(spark, {"x": ("invoice", CLEAN)}).limit(0)
    assert V.validate(none).count() == 0 and V.summary(V.validate(none)).count() == 0


def test_no_step_is_too_long_to_be_compiled(spark):
    """The JVM interprets methods of more than 8000 bytes, whatever Spark makes of them."""
    df = V.issues(V.validate(fields(spark, {d: (k, v) for d, (k, v, _) in CASES.items()})))
    plan = df._jdf.queryExecution()
    assert plan.executedPlan().executeCollect()
    made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan.executedPlan())
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sizes and max(sizes) <= 8000, sizes
    assert plan.executedPlan().toString().count("Window [") <= 8  # three and that of issues, in the plan as it was and as it ran
