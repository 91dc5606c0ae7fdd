"""Answers of models about sections, held against the schema of their section.

A section's answer is an object with an entry for each of its fields (value, confidence, source text), or,
for sections that hold a list, an object with that list, whose items carry the fields themselves. An
answer is checked as a VARIANT: what isn't JSON, a value of another type, or a confidence outside of 0 to
1 fails its section and no other. Every error has a path into the answer. The rules on types
are those of the schemas that answers are asked with: text is text only; a number may be a number,
a numeral or a truth value; a truth value may also be 0, 1 or one of TRUTHS; null and what is absent are
no errors; fields that the schema doesn't name are left alone. Names occurring twice in an object are an
error of the whole answer.

Checks are expressions over one row: nothing is shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schemas import LIST_SECTIONS, NUMBER_FIELDS

#: Texts that stand for truth values.
TRUTHS = ["true", "false", "t", "f", "yes", "no", "y", "n", "on", "off", "1", "0"]
NUMERAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ERRORS = "array<struct<path:string,message:string>>"


def _object(x: Column) -> Column:
    """The members of a value that is an object, else null. Members are looked up in this map: a path that differs by row is parsed for every row and member."""
    return F.try_variant_get(x, "$", "map<string,variant>")


def _list(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _absent(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _seen(x: Column) -> Column:
    """A value with its kind and text. As lambdas evaluate what they name each time, whatever is named often is bound to a variable by let."""
    return let(x, lambda v: F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")))


def _wrong(x: Column, want: Column) -> Column:
    """What is wrong with a value that should be text, number, share (a number from 0 to 1) or truth; null: nothing."""

    def of(s: Column) -> Column:
        kind, text = s["kind"], s["text"]
        value = F.when(_number(kind), text.try_cast("double")).when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when((kind == "STRING") & text.rlike(NUMERAL), F.trim(text).try_cast("double"))
        truth = (kind == "BOOLEAN") | F.coalesce(_number(kind) & value.isin(0.0, 1.0), F.lit(False)) | ((kind == "STRING") & F.lower(text).isin(TRUTHS))
        figure = let(value, lambda n: F.when(n.isNull(), "number expected").when((want == "share") & ~n.between(0.0, 1.0), "not from 0 to 1"))
        return F.when(_absent(kind), None).when(want == "truth", F.when(~truth, "truth value expected")).otherwise(figure)

    told = F.when(~F.schema_of_variant(x).isin("STRING", "VOID"), "text expected")
    return F.when(want == "text", told).otherwise(let(_seen(x), of))


def _kind_of(name: Column) -> Column:
    return F.when(name.isin(NUMBER_FIELDS), "number").when(name == "accepted", "truth").otherwise("text")


def _parts(at: Column, members: Column, parts: Column) -> Column:
    """Errors in the members of an object: parts is an array of (name, kind)."""
    given = F.filter(parts, lambda p: F.map_contains_key(members, p["name"]))  # what is absent is no error
    told = F.transform(given, lambda p: F.struct(F.concat(at, F.lit("."), p["name"]).alias("path"), _wrong(F.try_element_at(members, p["name"]), p["kind"]).alias("message")))
    return F.filter(told, lambda e: e["message"].isNotNull())


def _one(path: Column, message: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(message).alias("message")))


def _part(name: Column, kind: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("kind"))


def errors(answer: Column, names: Column, list_key: Column) -> Column:
    """All errors of an answer (text) about a section with these fields; list_key: where its list is, or null."""
    none = F.array().cast(ERRORS)
    tail = F.array(_part(F.lit("confidence"), F.lit("share")), _part(F.lit("source_text"), F.lit("text")))

    def single(members: Column) -> Column:
        def of(name: Column) -> Column:
            at = F.concat(F.lit("$."), name)
            parts = F.concat(F.array(_part(F.lit("value"), _kind_of(name))), tail)

            def told(x: Column) -> Column:
                return let(_object(x), lambda inside: F.when(inside.isNotNull(), _parts(at, inside, parts)).when(F.schema_of_variant(x) == "VOID", none).otherwise(_one(at, "object expected")))

            return let(F.try_element_at(members, name), told)

        return F.flatten(F.transform(F.filter(names, lambda n: F.map_contains_key(members, n)), of))

    def many(members: Column) -> Column:
        at = F.concat(F.lit("$."), list_key)

        def of(item: Column, i: Column, parts: Column) -> Column:
            here = F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
            return let(_object(item), lambda inside: F.when(inside.isNull(), _one(here, "object expected")).otherwise(_parts(here, inside, parts)))

        def told(items: Column) -> Column:
            parts = F.concat(F.transform(names, lambda n: _part(n, _kind_of(n))), tail)
            every = let(parts, lambda p: F.flatten(F.transform(items, lambda item, i: of(item, i, p))))
            return F.when(items.isNull(), _one(at, "list expected")).otherwise(every)

        return F.when(F.map_contains_key(members, list_key), let(_list(F.try_element_at(members, list_key)), told)).otherwise(none)

    def whole(v: Column) -> Column:
        def told(members: Column) -> Column:
            root = F.when(list_key.isNull(), single(members)).otherwise(many(members))
            return F.when(members.isNull(), _one(F.lit("$"), "object expected")).otherwise(root)

        return F.when(v.isNull(), _one(F.lit("$"), "no JSON")).otherwise(let(_object(v), told))

    # the parsed answer is a lambda's variable, so that it is parsed once
    told = let(F.try_parse_json(answer), whole)
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", _one(F.lit("$"), "empty answer")).otherwise(told).cast(ERRORS)


def list_key(section_name: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (where, _) in LIST_SECTIONS.items():
        out = F.when(section_name == name, where).otherwise(out)
    return out


def _held(asked: DataFrame, responses: DataFrame) -> tuple[DataFrame, Column]:
    """The sections asked about with the answers about them, and the errors of these."""
    told = responses.where("stage = 'extraction'").select("document_id", F.col("item_key").alias("section_id"), "stage", "response_json", "error")
    return asked.join(told, ["document_id", "section_id"]), F.when(F.col("error").isNull(), errors(F.col("response_json"), F.col("names"), list_key(F.col("section_name"))))


def passed(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """The sections whose answers have no errors, with response_json; errors are counted once, in the filter."""
    rows, found = _held(asked, responses)
    return rows.where(F.size(found) == 0).drop("stage", "error")


def check(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """The answers about the sections asked about (document_id, section_id, section_name, names): document_id, stage, item_key, response_json,
    error, error_path, errors. An answer with errors counts as none: its error is that of the provider, or else its first one."""
    rows, found = _held(asked, responses)
    rows = rows.withColumn("errors", found)
    first = F.get("errors", F.lit(0))
    good = F.coalesce(F.size("errors") == 0, F.lit(False))
    return rows.select(
        "document_id", "stage", F.col("section_id").alias("item_key"), F.when(good, F.col("response_json")).alias("response_json"),
        F.coalesce("error", F.concat(first["path"], F.lit(": "), first["message"])).alias("error"), first["path"].alias("error_path"), F.coalesce("errors", F.array().cast(ERRORS)).alias("errors"),
    )
