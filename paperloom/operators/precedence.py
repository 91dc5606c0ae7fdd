"""What several stages have left of a document, the best one first.

Each level (validation before extraction before the table) has at most a text or a list a document. A document's
whole list comes from its best level: the first that isn't missing and isn't corrupt. A level that is there but
empty counts: a validation without fields isn't replaced by an extraction. States tell missing, corrupt and
empty apart. Where a corrupt level must not be passed over (`stop`), the document's source is 'corrupt'.

One shuffle, by document: the best level is a partial aggregate (min_by rank), so of a document's lists in one
task only the best one is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(artifacts: DataFrame, items: str, kind: str) -> DataFrame:
    """document_id, state, items out of texts (document_id, body): `items` names the list, kind is the type of its rows."""
    v, whole = F.try_parse_json("body"), F.from_json("body", f"struct<`{items}`: array<{kind}>>")
    shape = F.schema_of_variant(F.try_variant_get(v, f"$.{items}", "variant"))
    rows = artifacts.select("document_id", "body", F.schema_of_variant(v).alias("_root"), shape.alias("_list"), F.coalesce(whole[items], F.array().cast(f"array<{kind}>")).alias("items"))
    broken = ~F.coalesce(F.col("_root").startswith("OBJECT"), F.lit(False)) | ~(F.col("_list").isNull() | F.col("_list").startswith("ARRAY") | (F.col("_list") == "VOID"))
    return rows.select("document_id", F.when(broken, "corrupt").when(F.size("items") == 0, "empty").otherwise("ok").alias("state"), F.when(~broken, F.col("items")).alias("items"))


def table(rows: DataFrame, order: str, kind: str) -> DataFrame:
    """document_id, state, items out of the rows of a table, in order."""
    found = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*(c for c in rows.columns if c != "document_id")).cast(f"{kind}").alias("r")))), lambda x: x["r"])
    return rows.groupBy("document_id").agg(found.alias("items")).select("document_id", F.lit("ok").alias("state"), "items")


def merge(documents: DataFrame, levels: list[tuple[str, DataFrame]], stop: tuple[str, ...] = ()) -> DataFrame:
    """document_id, source (the level's name, 'corrupt', or 'none'), states (by level), items, for each of the documents."""
    every = None
    for rank, (name, rows) in enumerate(levels):
        good = F.col("state") != "corrupt"
        use = F.when(good | F.lit(name in stop), F.struct(F.lit(rank).alias("rank"), F.when(good, name).otherwise("corrupt").alias("source")))
        part = rows.select("document_id", F.lit(rank).alias("_rank"), use.alias("_use"), "state", "items")
        every = part if every is None else every.unionByName(part)
    state = lambda rank: F.coalesce(F.max(F.when(F.col("_rank") == rank, F.col("state"))), F.lit("missing"))
    best: Column = F.min_by(F.struct("_use.source", "items"), F.when(F.col("_use").isNotNull(), F.col("_rank")))
    one = every.groupBy("document_id").agg(best.alias("b"), *(state(k).alias(f"_s{k}") for k in range(len(levels))))
    rows = documents.select("document_id").distinct().join(one, "document_id", "left")
    states = F.map_from_arrays(F.array(*(F.lit(n) for n, _ in levels)), F.array(*(F.coalesce(f"_s{k}", F.lit("missing")) for k in range(len(levels)))))
    items = F.coalesce("b.items", F.array().cast(every.schema["items"].dataType))
    return rows.select("document_id", F.coalesce("b.source", F.lit("none")).alias("source"), states.alias("states"), items.alias("items"))
