"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. A ledger has a row for each blob and rule
(name@version) that has been scanned, with what it found; a scan reads only blobs with pairs that
the ledger lacks, one version of each, and evaluates only those rules. Findings are then joined
back to every path and version that holds the blob, however many they are. Only rows of the rules
in force count: a rule whose version changed is scanned anew, and what its old version or a retired
rule found stays in the ledger unused. A pair that the ledger holds twice (a repeated or concurrent
scan) counts once.

All steps are DataFrame expressions: a pattern's matches and the text between them, both from the
same leftmost scan, give every match its place.

Defined results: null text is the empty text, which is a blob like any other; a path may be null or
have any number of versions, equal ones included; a ledger that is missing or empty means that
everything is scanned; places are in code points, the end exclusive; an empty table gives an empty
result; other columns, also ones named as those made here, are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import own_folder

from . import common as C

#: Kind, pattern, version, a literal without which no match is possible (or none), the group that counts and its least length. Order is the rank of kinds among spans of equal start.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, None, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 1, "AKIA", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 1, None, 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, "PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, "eyJ", 0, 1),
    ("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 1, "gh", 0, 1),
    ("login", r"://[^/\x20:@]+:[^/\x20:@]+@", 1, "://", 0, 1),
]
BASE = ["assign", "access", "hex"]
_SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"
LEDGER = f"blob string, rule string, spans {_SPANS}"
#: Matches that are placed in one go: lists grow by appending within a block and over blocks, so the work on n matches is n * (BLOCK + n / BLOCK).
BLOCK = 512


def spans(text: Column, rank: int, rule: tuple) -> Column:
    """Where a rule matches: an array of (start, rank, kind, end); no match, no work beyond the search."""
    kind, pattern, _, literal, group, least = rule
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), counts.alias("c")), lambda x: F.struct(F.length(x["g"]).cast("long").alias("g"), F.length(x["m"]).cast("long").alias("m"), F.length(x["c"]).alias("c")))
    blocks = lambda parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    last = lambda starts: F.element_at(starts, -1)
    begins = lambda made: F.aggregate(made, F.array(F.lit(0).cast("long")), lambda acc, b: F.array_append(acc, last(acc) + F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x["g"] + x["m"])))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["g"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + x["g"] + x["m"]).alias("end"), x["c"].alias("c"))).alias("out"))
    empty = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long,c:int>>")
    inside = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step)["out"]
    # what is used twice is a lambda's variable, so that it is evaluated once
    one = lambda made: F.flatten(F.transform(F.arrays_zip(made.alias("b"), F.slice(begins(made), 1, F.size(made)).alias("at")), lambda x: inside(x["b"], x["at"])))
    kept = F.transform(F.filter(F.flatten(F.transform(F.array(parts), lambda p: F.flatten(F.transform(F.array(blocks(p)), one)))), lambda x: x["c"] >= least), lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"]))
    can = text.rlike(pattern) if literal is None else text.contains(literal) & text.rlike(pattern)
    return F.when(can, kept).otherwise(F.array()).cast(_SPANS)


def named(rule: tuple) -> str:
    return f"{rule[0]}@{rule[2]}"


def blobs(versions: DataFrame, path: str, *keep: str) -> DataFrame:
    """The path of every version, what tells paths apart in a scan, its blob (the SHA-256 of the text), and the text if kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = versions.select(F.col(path).alias("_at"), F.xxhash64(path).alias("_path"), text.alias("_text"), F.sha2(text.cast("binary"), 256).alias("blob"))
    return made.select("_at", "_path", "blob", *keep)


def scan(versions: DataFrame, path: str, ledger: DataFrame | None = None, rules: list[tuple] = RULES, digests: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rule, spans) for the pairs that the ledger lacks. digests: blobs() of the versions, if already written."""
    every = F.array(*(F.lit(named(r)) for r in rules))
    own = blobs(versions, path) if digests is None else digests
    chosen = own.groupBy("blob").agg(F.min("_path").alias("_path"))  # one path of each blob, combined before the shuffle
    if ledger is None:
        chosen = chosen.withColumn("todo", every)
    else:
        seen = ledger.where(F.col("rule").isin([named(r) for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
        chosen = chosen.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")
    texts = blobs(versions, path, "_text").drop("_at").join(chosen, ["_path", "blob"]).select("blob", F.col("_text").alias("text"), "todo")
    found = F.array(*(F.struct(F.lit(named(r)).alias("rule"), F.when(F.array_contains("todo", named(r)), spans(F.col("text"), i, r)).alias("spans")) for i, r in enumerate(rules)))
    return texts.select("blob", found.alias("found")).dropDuplicates(["blob"]).select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.spans").where("spans IS NOT NULL")


def findings(versions: DataFrame, path: str, ledger: DataFrame, rules: list[tuple] = RULES, digests: DataFrame | None = None) -> DataFrame:
    """One row of each version: its path, blob and the spans that the rules in force have in the ledger, sorted."""
    pairs = ledger.where(F.col("rule").isin([named(r) for r in rules]) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(named(r)), F.lit(i))))  # the rank in this list of rules, whatever it was when the pair was scanned
    placed = F.transform("spans", lambda x: F.struct(x["start"], F.element_at(rank, F.col("rule")).alias("rank"), x["kind"], x["end"]))
    done = pairs.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("spans"))
    own = (blobs(versions, path) if digests is None else digests).select("_at", "_path", "blob")
    return C.attach(own, done, "blob", by="_path", how="left").select(F.col("_at").alias(path), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def update(versions: DataFrame, path: str, ledger_path: str, rules: list[tuple] = RULES) -> DataFrame:
    """Scan what is new, append it to the ledger (a parquet folder, made if it is missing) and return the findings of all versions."""
    spark = versions.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    digests = C.written(blobs(versions, path))
    scan(versions, path, spark.read.schema(LEDGER).parquet(ledger_path) if there else None, rules, digests).write.mode("append").parquet(ledger_path)
    return findings(versions, path, spark.read.schema(LEDGER).parquet(ledger_path), rules, digests)


def joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of their places, and all places of every row. Without a ledger to go on with, a new one is made in the shared folder."""
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    ledger_path = ledger_path or f"{own_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = update(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", ledger_path)
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def query(spark, sf_dir):
    return secrets(C.table(spark, sf_dir, "documents"))
