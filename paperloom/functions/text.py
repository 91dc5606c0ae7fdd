"""Column functions on text that behave alike for all white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: an expression that names another many times would repeat it as often."""
    return F.transform(F.array(value), use)[0]


_SPACE = r"[\s ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Without these characters at both ends; chars is the inside of a character class."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}+", " ")


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def shortened(c: Column, most: int, marker: str) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def title(c: Column) -> Column:
    """Parts between underscores with their first letter in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def section_title(c: Column) -> Column:
    return title(c)


def field_title(c: Column) -> Column:
    return title(F.regexp_replace(c, r"^(line_item|id_doc|agreement)_\d+_", ""))


def bytes_title(c: Column) -> Column:
    """0 Bytes, 1.5 KB, ...: two decimals at most."""
    unit = F.floor((F.log2(F.greatest(c, F.lit(1))) / 10)).cast("int")
    value = F.round(c / F.pow(F.lit(1024.0), unit), 2)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")
    return F.when(F.coalesce(c, F.lit(0)) <= 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), F.get(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB", "TB"])), F.least(unit, F.lit(4)))))
