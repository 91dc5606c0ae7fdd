"""Normalisation of field values as column expressions; values themselves are never changed.

Each function returns a struct (value, failed, message): the normal form or null, and why there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, squeeze, strip, strip_chars

# What names a currency, in the order of precedence, and the codes.
CURRENCIES = [("₹", "INR"), ("INR", "INR"), ("RS", "INR"), ("RS.", "INR"), ("$", "USD"), ("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP"), ("¥", "JPY"), ("JPY", "JPY")]
# Shape and pattern of accepted dates, in the order of precedence.
DATES = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"), (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"), (r"\d{1,2} [A-Za-z]+ \d{4}", "d MMMM yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"), (r"[A-Za-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy"), (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"), (r"\d{1,2}-[A-Za-z]+-\d{4}", "d-MMMM-yyyy"),
    (r"\d{4}-[A-Za-z]{3}-\d{1,2}", "yyyy-MMM-d"),
]
# Which names are of which kind, by substring.
DATE_NAMES = ["invoice_date", "due_date", "date_of_birth", "joining_date", "issue_date", "expiry_date", "date"]
NUMBER_NAMES = ["subtotal", "tax_amount", "tax_rate", "discount", "total", "quantity", "unit_price", "line_total"]
NUMBER_ENDS = ["_quantity", "_unit_price", "_price", "_line_total", "_total"]
EMAIL_NAMES = ["vendor_email", "customer_email", "email"]
PHONE_NAMES = ["vendor_phone", "customer_phone", "phone"]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _result(value: Column, failed: Column | None = None, message: Column | None = None) -> Column:
    return F.struct(value.cast("string").alias("value"), (failed if failed is not None else F.lit(False)).alias("failed"), (message if message is not None else F.lit(None)).cast("string").alias("message"))


def _any(name: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def date(v: Column) -> Column:
    """ISO date; day before month where both read, years from 1900 to 2100."""

    def parsed(text: Column) -> Column:
        bounded = lambda d: let(d, lambda x: F.when(F.year(x).between(1900, 2100), x))
        tries = [bounded(F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))) for shape, pattern in DATES]
        part = lambda i: F.regexp_extract(text, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", i)
        number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
        two = lambda i: F.lpad(part(i), 2, "0")
        mixed = F.when((number(1) <= 12) & (number(2) > 12), F.concat_ws("-", part(3), two(1), two(2))).otherwise(F.concat_ws("-", part(3), two(2), two(1)))
        return F.coalesce(*tries, bounded(F.try_to_timestamp(mixed, F.lit("yyyy-MM-dd")).cast("date")))

    def of(raw: Column) -> Column:
        iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
        found = F.when(iso, F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date")).otherwise(let(squeeze(raw), parsed))
        said = F.when(iso, F.concat(F.lit("Invalid date value: "), raw)).otherwise(F.concat(F.lit("Ambiguous or unrecognized date format: '"), raw, F.lit("'")))
        return let(found, lambda x: F.when(x.isNotNull(), _result(F.date_format(x, "yyyy-MM-dd"))).otherwise(_result(F.lit(None), F.lit(True), said)))

    return F.when(blank(v), _result(F.lit(None))).otherwise(let(strip_chars(strip(v), "\"'.,;"), of))


def number_value(v: Column) -> Column:
    """The number as double, or null."""

    def point(s: Column) -> Column:
        comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
        parts = F.split(s, ",")
        decimal_comma = (F.size(parts) == 2) & (F.length(F.element_at(parts, -1)) == 2) & (F.length(parts[0]) <= 3)
        to_point, without = F.replace(s, F.lit(","), F.lit(".")), F.replace(s, F.lit(","), F.lit(""))
        return F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(without)).when(comma > 0, F.when(decimal_comma, to_point).otherwise(without)).otherwise(s)

    def signed(s: Column) -> Column:
        paren = s.rlike(r"^\(.*\)$")
        bare = F.when(paren, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(F.regexp_replace(s, "^-", ""))
        n = let(let(bare, point), lambda x: F.when(x.rlike(_NUMBER), x.try_cast("double")))
        return let(n, lambda x: F.when(paren | s.startswith("-"), -x).otherwise(x))

    return let(F.regexp_replace(F.regexp_replace(v, r"[₹$€£¥%\s ]", ""), r"^(?i:inr|usd|eur|gbp|rs\.?)", ""), signed)


def canonical(n: Column) -> Column:
    """A whole number without a point, others with at most two decimals."""
    two = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", n), "0+$", ""), r"\.$", "")
    return F.when(n.isNull(), F.lit(None).cast("string")).when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(two)


def number(v: Column) -> Column:
    said = F.concat(F.lit("Could not parse numeric value from '"), v, F.lit("'"))
    made = let(let(number_value(v), canonical), lambda n: _result(n, n.isNull(), F.when(n.isNull(), said)))
    return F.when(v.isNull(), _result(F.lit(None))).otherwise(made)


def currency_code(v: Column) -> Column:
    up, out = F.upper(v), F.lit(None).cast("string")
    for mark, code in reversed(CURRENCIES):
        out = F.when(up.contains(mark), code).otherwise(out)
    return out


def text_value(v: Column) -> Column:
    return let(squeeze(strip_chars(strip(v), "\"'")), lambda x: F.when(blank(x), F.lit(None).cast("string")).otherwise(x))


def text(v: Column) -> Column:
    return _result(text_value(v))


def currency(v: Column) -> Column:
    return _result(F.coalesce(currency_code(v), F.upper(text_value(v))))


def email(v: Column) -> Column:
    return let(strip(F.lower(strip_chars(strip(v), "\"'<>"))), lambda x: _result(F.when(x == "", F.lit(None)).otherwise(x)))


def phone(v: Column) -> Column:
    s = strip_chars(strip(v), "\"'")
    digits = F.regexp_replace(s, "[^0-9]", "")
    return _result(F.when(digits == "", F.lit(None)).otherwise(F.concat(F.when(s.startswith("+"), "+").otherwise(""), digits)))


def kind_of(n: Column) -> Column:
    """date, number, currency, email, phone or text, by the field's name in lower case."""
    ends = F.lit(False)
    for e in NUMBER_ENDS:
        ends = ends | n.endswith(e)
    return F.when(_any(n, DATE_NAMES), "date").when(_any(n, NUMBER_NAMES) | ends, "number").when(n == "currency", "currency").when(_any(n, EMAIL_NAMES), "email").when(_any(n, PHONE_NAMES), "phone").otherwise("text")


def field_kind(name: Column) -> Column:
    """The kind by the name in any case."""
    return kind_of(F.lower(name))


#: Values that are their own normal form, or nearly so: numerals of at most 15 digits, two behind the point; dates; words with single spaces between.
_PLAIN_NUMBER, _PLAIN_DATE, _PLAIN_TEXT = r"^-?([1-9][0-9]{0,12}(\.[0-9]{1,2})?|0)$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[A-Za-z0-9._#/-]+( [A-Za-z0-9._#/-]+)*$"


def field_of(kind: Column, value: Column) -> Column:
    """The normal form of a value of a kind. Plain values, nearly all there are, take expressions that Spark compiles; the rest go through lambdas, which it doesn't."""
    rest = F.when(kind == "date", date(value)).when(kind == "number", number(value)).when(kind == "currency", currency(value)).when(kind == "email", email(value)).when(kind == "phone", phone(value)).otherwise(text(value))
    numeral = F.when(F.instr(value, ".") > 0, F.regexp_replace(value, r"\.?0+$", "")).when(value == "-0", "0").otherwise(value)
    return (
        F.when(value.isNull(), _result(F.lit(None))).when((kind == "number") & value.rlike(_PLAIN_NUMBER), _result(numeral))
        .when((kind == "date") & value.rlike(_PLAIN_DATE) & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(), _result(value)).when((kind == "text") & value.rlike(_PLAIN_TEXT), _result(value)).otherwise(rest)
    )


def field(name: Column, value: Column) -> Column:
    """The normal form of a field's value by the kind that its name has."""
    return let(field_kind(name), lambda kind: field_of(kind, value))


def action_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def values_agree(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Whether two readings mean the same: as text, without marks and spaces, or as numbers."""
    bare = lambda c: F.lower(F.regexp_replace(strip(c), "[₹$€£¥,\\s\\u00A0\\-_/.:;\"']", ""))
    num = lambda c: let(F.regexp_replace(c, r"[^\d.]", ""), lambda x: F.when(x.rlike(_NUMBER), x.try_cast("double")))
    alike = let(F.struct(bare(a).alias("a"), bare(b).alias("b")), lambda x: (x["a"] != "") & (x["a"] == x["b"]))
    same = (F.lower(strip(a)) == F.lower(strip(b))) | alike | F.coalesce(F.abs(num(a) - num(b)) <= tolerance, F.lit(False))
    return F.when(blank(a) | blank(b), F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))
