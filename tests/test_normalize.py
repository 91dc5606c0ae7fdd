"""Normal forms against values worked out by hand and against small specifications."""

import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


DATES = {
    "2026-09-01": "2026-09-01", "2026/9/1": "2026-09-01", "01/09/2026": "2026-09-01", "25-12-2025": "2025-12-25", "1.9.2026": "2026-09-01", "12/25/2025": "2025-12-25", "01 Sep 2026": "2026-09-01",
    "1  September 2026": "2026-09-01", "Sep 1, 2026": "2026-09-01", "September 01, 2026": "2026-09-01", "01-Sep-2026": "2026-09-01", "01-SEPTEMBER-2026": "2026-09-01", "2026-sep-01": "2026-09-01", ' "01/09/2026". ': "2026-09-01",
    "13/2.2026": "2026-02-13", "2/13-2026": "2026-02-13", "01/09/26": None, "01/01/1800": None, "soon": None, "2026-13-01": None, "31/31/2026": None,
}


def test_dates(spark):
    got = column(spark, list(DATES), N.date)
    assert [g.value for g in got] == list(DATES.values())
    assert [g.failed for g in got] == [v is None for v in DATES.values()]
    by = dict(zip(DATES, got, strict=True))
    assert by["2026-13-01"].message == "Invalid date value: 2026-13-01"
    assert by["soon"].message == "Ambiguous or unrecognized date format: 'soon'"


def test_dates_round_trip(spark):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(days=37 * i) for i in range(300)]
    for pattern in ("%Y-%m-%d", "%d/%m/%Y", "%d %b %Y", "%B %d, %Y", "%d-%B-%Y"):
        assert [g.value for g in column(spark, [d.strftime(pattern) for d in days], N.date)] == [d.isoformat() for d in days]


NUMBERS = {
    "₹ 1,25,000.50": "125000.5", "₹236.00": "236", "18%": "18", "$1,234.5": "1234.5", "1.234,56": "1234.56", "12,34": "12.34", "1234,50": "123450", "1,234": "1234", "(42.10)": "-42.1", "-7": "-7", "USD 5": "5", "Rs. 9.99": "9.99",
    "100 USD": None, "abc": None, "1_000": None, "1d": None, "NaN": None, "": None, "1e3": "1000", ".5": "0.5",
}


def test_numbers(spark):
    got = column(spark, list(NUMBERS), N.number)
    assert dict(zip(NUMBERS, (g.value for g in got), strict=True)) == NUMBERS
    assert all(g.failed == (g.value is None) for g in got)


def test_other_kinds(spark):
    assert [g.value for g in column(spark, ["  JANE.DOE@EXAMPLE.COM  ", '"<a@b.co>"', " "], N.email)] == ["jane.doe@example.com", "a@b.co", None]
    assert [g.value for g in column(spark, ["+1 (555) 234-5678", "'98 765'", "none"], N.phone)] == ["+15552345678", "98765", None]
    assert [g.value for g in column(spark, ["₹1", "dollars", "5 eur", "chf", None], N.currency)] == ["INR", "INR", "EUR", "CHF", None]
    assert [g.value for g in column(spark, ["  'a \t b'\n", "''", None], N.text)] == ["a b", None, None]
    assert column(spark, ["Pay: Invoice #1!"], N.action_key) == ["payinvoice1"]


@pytest.mark.parametrize(("name", "kind"), [("candidate_name", "date"), ("line_item_1_unit_price", "number"), ("Currency", "currency"), ("vendor_email", "email"), ("emergency_phone", "phone"), ("notes", "text"), ("price_total", "number")])
def test_kinds(spark, name, kind):
    assert column(spark, [name], N.field_kind) == [kind]


def test_values_agree(spark):
    rows = spark.createDataFrame([("$1,200.00", "1200.00", True), ("1200.00", "1200.04", True), ("1200.00", "1200.10", False), ("ACME corp", "Acme-Corp", True), ("1.2.3", "1.2.4", False), (None, "x", False), (" ", " ", False)], "a string, b string, w boolean")
    assert [r[0] == r[1] for r in rows.select(N.values_agree(F.col("a"), F.col("b")), "w").collect()] == [True] * 7


def test_titles(spark):
    assert column(spark, ["line_item_2_unit_price", "vendor_taxID"], T.field_title) == ["Unit Price", "Vendor TaxID"]
    rows = spark.createDataFrame([(0,), (500,), (1536,), (10 * 1024 * 1024,)], "n long")
    assert [r[0] for r in rows.select(T.bytes_title(F.col("n"))).collect()] == ["0 Bytes", "500 Bytes", "1.5 KB", "10 MB"]
