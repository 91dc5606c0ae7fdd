"""Answers against the schemas of their sections, bisected batches, and the ledger of answers."""

import json

import pytest

from paperloom.operators import answers, extract

GOOD = {
    "vendor_information": ['{}', '{"vendor_name": null, "odd": [1]}', '{"vendor_name": {"value": "x", "confidence": 1, "source_text": null}}', '{"vendor_name": {"confidence": "0.5"}}', '{"vendor_name": {"value": null, "confidence": true}}'],
    "tax_information": ['{"total": {"value": "12.50"}}', '{"total": {"value": 1e3, "confidence": 0.0}}', '{"total": {"value": false}}', '{"total": {"value": " 7 "}}'],
    "line_items": ['{"items": []}', '{}', '{"items": [{"quantity": 2, "description": "a", "confidence": 0.25, "source_text": "s"}, {}]}'],
    "agreements": ['{"agreements": [{"accepted": true}, {"accepted": "Yes"}, {"accepted": 0}, {"accepted": null}]}'],
}
BAD = [
    ("vendor_information", None, "$", "empty answer"), ("vendor_information", " ", "$", "empty answer"), ("vendor_information", "no json", "$", "no JSON"), ("vendor_information", '{"vendor_name": ', "$", "no JSON"), ("vendor_information", "[1]", "$", "object expected"),
    ("vendor_information", "null", "$", "object expected"), ("vendor_information", '{"vendor_name": "x"}', "$.vendor_name", "object expected"), ("vendor_information", '{"vendor_email": {"value": 7}}', "$.vendor_email.value", "text expected"),
    ("vendor_information", '{"vendor_email": {"value": ["a"]}}', "$.vendor_email.value", "text expected"), ("vendor_information", '{"vendor_email": {"confidence": 1.7}}', "$.vendor_email.confidence", "not from 0 to 1"),
    ("vendor_information", '{"vendor_email": {"confidence": "high"}}', "$.vendor_email.confidence", "number expected"), ("vendor_information", '{"vendor_email": {"source_text": {}}}', "$.vendor_email.source_text", "text expected"),
    ("tax_information", '{"total": {"value": "12 EUR"}}', "$.total.value", "number expected"), ("tax_information", '{"total": {"value": [12]}}', "$.total.value", "number expected"), ("line_items", '{"items": null}', "$.items", "list expected"),
    ("line_items", '{"items": {"quantity": 1}}', "$.items", "list expected"), ("line_items", '{"items": [{}, 3]}', "$.items[1]", "object expected"), ("line_items", '{"items": [{"quantity": 1}, {"quantity": "two"}]}', "$.items[1].quantity", "number expected"),
    ("line_items", '{"items": [{"confidence": -0.1}]}', "$.items[0].confidence", "not from 0 to 1"), ("agreements", '{"agreements": [{"accepted": "maybe"}]}', "$.agreements[0].accepted", "truth value expected"), ("agreements", '{"agreements": [{"accepted": 2}]}', "$.agreements[0].accepted", "truth value expected"),
]
TYPE = {"agreements": "onboarding_form"}


def sections_of(spark, rows):
    kinds = "document_id string, document_type string, section_id string, section_ord int, section_name string, page_number int, text string"
    return spark.createDataFrame([(d, TYPE.get(n, "invoice"), s, o, n, 1, "long enough") for d, s, o, n in rows], kinds)


def told_of(spark, rows):
    return spark.createDataFrame([(d, "extraction", s, j, e) for d, s, j, e in rows], "document_id string, stage string, item_key string, response_json string, error string")


def test_schema(spark):
    rows = [(n, j, None, None) for n, all_ in GOOD.items() for j in all_] + BAD
    sections = sections_of(spark, [(str(i), "s", 1, n) for i, (n, *_) in enumerate(rows)])
    told = told_of(spark, [(str(i), "s", j, None) for i, (_, j, *_) in enumerate(rows)])
    got = {int(r.document_id): r for r in extract.checked(sections, told).collect()}
    for i, (_, j, path, message) in enumerate(rows):
        assert (got[i].error_path, got[i].error) == (path, path and f"{path}: {message}"), rows[i]
        assert got[i].response_json == (None if path else j)


def test_all_errors_in_order(spark):
    told = told_of(spark, [("1", "s", json.dumps({"vendor_tax_id": {"confidence": 2}, "vendor_name": {"value": 1, "confidence": 9}}), None)])
    row = extract.checked(sections_of(spark, [("1", "s", 1, "vendor_information")]), told).first()
    assert [e.path for e in row.errors] == ["$.vendor_name.value", "$.vendor_name.confidence", "$.vendor_tax_id.confidence"]


def test_a_failed_section_takes_no_other_with_it(spark):
    sections = sections_of(spark, [("1", "a", 1, "vendor_information"), ("1", "b", 2, "notes"), ("1", "c", 3, "line_items"), ("1", "d", 4, "notes"), ("2", "a", 1, "vendor_information"), ("3", "a", 1, "notes")])
    told = told_of(spark, [("1", "a", "no json", None), ("1", "b", '{"notes": {"value": "first"}}', None), ("1", "c", '{"items": [{"quantity": "x"}]}', None), ("1", "d", '{"notes": {"value": "last"}}', None), ("2", "a", None, "timeout")])
    got = {r.document_id: r for r in extract.counters(sections, told, extract.fields(sections, told)).collect()}
    assert [(got[d].sections_processed, got[d].failed_sections, got[d].total_fields) for d in "123"] == [(2, ["vendor_information", "line_items"], 2), (0, ["vendor_information"], 0), (0, ["notes"], 0)]
    data = {(r.document_id, r.section_name): r.section_data for r in extract.section_data(sections, told).collect()}
    assert data == {("1", "notes"): '{"notes": {"value": "last"}}'}


def test_checked_once(spark):
    """Answers that were checked aren't checked again."""
    sections, told = sections_of(spark, [("1", "a", 1, "notes")]), told_of(spark, [("1", "a", '{"notes": {"value": "x"}}', None)])
    once = extract.checked(sections, told)
    assert extract.checked(sections, once) is once
    assert answers.check(extract.gate(sections), told.limit(0)).count() == 0
    assert [r.field_value for r in extract.fields(sections, once).collect()] == ["x"]


@pytest.mark.parametrize("kind,count,values", [("identity_documents", "documents", {"document_type": "Passport", "document_number": "X1"}), ("agreements", "agreements", {"agreement_type": "NDA", "accepted": True})])
def test_lists_of_forms(spark, kind, count, values, monkeypatch):
    monkeypatch.setitem(TYPE, kind, "onboarding_form")
    told = told_of(spark, [("1", "s", json.dumps({count: [values, {}]}), None)])
    got = {r.field_name: r.field_value for r in extract.fields(sections_of(spark, [("1", "s", 1, kind)]), told).collect()}
    prefix = {"identity_documents": "id_doc", "agreements": "agreement"}[kind]
    assert {k: v for k, v in got.items() if v} == {f"{prefix}_1_{k}": str(v).lower() if v is True else v for k, v in values.items()}
    assert len(got) == 2 * len([k for k in got if k.startswith(f"{prefix}_1_")])


def test_answers_are_parsed_once_for_their_fields(spark):
    """Neither again for what the filter let through, nor through paths that differ by row."""
    made = extract.fields(sections_of(spark, [("1", "s", 1, "vendor_information")]), told_of(spark, [("1", "s", '{"vendor_name": {"value": "x"}}', None)]))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert made.where("field_value = 'x'").count() == 1
