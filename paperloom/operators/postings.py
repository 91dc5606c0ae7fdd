"""Which texts hold which strings, by postings of runs of characters.

A string that is sought has the runs of GRAM characters in it (itself where it is shorter). Its rarest
run gives the candidates, which are then compared; a string with a run that no text has is held by none.
Rows grow with the lengths of the texts and with the candidates, not with texts times strings. A scope is
a list of columns, such as document and page, within which texts are sought; it may be empty.

Defined results: null and empty strings hold nothing and are held by nothing; a null in the scope meets
nothing; repeated strings of a scope are one; characters are code points, line ends are characters like
others; strings without a scope are compared over all texts.

Rows that come dealt by the one column of their scope are not shuffled again by holding(). Spark keeps rows
where they are for a union and a group of it, but not for a join by more columns than they are dealt by, so
what has to meet is grouped (met()); a group is held at once, so a run's texts in a scope and a text's strings are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3

#: Where no more runs than these are sought in a scope, its texts are asked for each of them and post what they have; else they post all their runs.
FEW = 64


def _runs(text: Column, n: int) -> Column:
    # the last dot steps over a whole code point, so no run begins with half of one, which no text would hold
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def grams(text: Column, lengths: Column | None = None) -> Column:
    """What a text is found by: its distinct runs of 1 to GRAM characters, or of those `lengths` alone."""
    wanted = lambda n: _runs(text, n) if lengths is None else F.when(F.array_contains(lengths, n), _runs(text, n)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*(wanted(n) for n in range(1, GRAM + 1))))


def key_grams(text: Column) -> Column:
    """What a string is sought by: its distinct runs of GRAM characters, or itself where it has fewer."""
    return F.when(F.length(text) < GRAM, F.array(text)).otherwise(_runs(text, GRAM))


def postings(texts: DataFrame, scope: list[str]) -> DataFrame:
    """scope, gram and _id of texts (scope, _id, text; _lengths, where only runs of those are sought; _few, where no others than these are, or null)."""
    lengths = F.col("_lengths") if "_lengths" in texts.columns else None
    runs = grams(F.col("text"), lengths)
    if "_few" in texts.columns:
        runs = F.when(F.col("_few").isNotNull(), F.filter("_few", lambda g: F.col("text").contains(g))).otherwise(runs)
    return texts.select(*scope, "_id", F.explode(runs).alias("gram"))


def bucket(gram: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(of)).cast("int")


def sought_runs(sought: DataFrame, scope: list[str], *along: str) -> DataFrame:
    """scope, sought, `along`, gram of all runs by which strings are sought, _of: how many a string has."""
    return sought.select(*scope, "sought", *along, key_grams(F.col("sought")).alias("_g")).select(*scope, "sought", *along, F.size("_g").alias("_of"), F.explode("_g").alias("gram"))


def candidates(sought: DataFrame, posted: DataFrame, scope: list[str], buckets: int | None = None) -> DataFrame:
    """scope, sought and _id of the texts that have the rarest run of a string; strings with a run that nothing has are left out.
    With `buckets`, posted has a column bucket of the run's bucket, by which its files may be pruned."""
    by = [*scope, "gram"]
    parts = sought_runs(sought, scope)
    if buckets:
        by, parts = [*by, "bucket"], parts.withColumn("bucket", bucket(F.col("gram"), buckets))
    often = posted.join(parts.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rarest = parts.join(often, by).groupBy(*scope, "sought", "_of").agg(F.count(F.lit(1)).alias("_found"), F.min(F.struct("_n", *by)).alias("_r")).where("_found = _of")
    return rarest.select("sought", *(F.col("_r")[c].alias(c) for c in by)).join(posted, by).select(*scope, "sought", "_id")


def named(texts: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct texts (scope, text) with _id, a hash: texts that share one are candidates together and told apart by comparison."""
    return texts.select(*scope, "text").where("text <> ''").distinct().withColumn("_id", F.xxhash64("text"))


def met(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a joined with b by columns that are never null, both left where they are if they are dealt by some of these."""
    packed = lambda rows, name: rows.select(*by, F.struct(*(c for c in rows.columns if c not in by)).alias(name))
    both = packed(a, "_a").unionByName(packed(b, "_b"), allowMissingColumns=True)
    lists = both.groupBy(*by).agg(F.collect_list("_a").alias("_a"), F.collect_list("_b").alias("_b")).where((F.size("_a") > 0) & (F.size("_b") > 0))
    return lists.select(*by, "_b", F.explode("_a").alias("_a")).select(*by, "_a", F.explode("_b").alias("_b")).select(*by, "_a.*", "_b.*")


def _met_candidates(sought: DataFrame, posted: DataFrame, scope: list[str]) -> DataFrame:
    """candidates() of sought (scope, sought, _own), which goes along, with rows left where they are. The texts of each run of a string are held until its rarest is known."""
    packed = F.when(F.col("sought").isNotNull(), F.struct("sought", "_own", "_of"))
    every = sought_runs(sought, scope, "_own").unionByName(posted, allowMissingColumns=True).groupBy(*scope, "gram").agg(F.collect_list(packed).alias("_s"), F.collect_list("_id").alias("_ids"))
    parts = every.where((F.size("_s") > 0) & (F.size("_ids") > 0)).select(*scope, "gram", "_ids", F.explode("_s").alias("_s")).select(*scope, "_s.*", "gram", "_ids")
    rarest = parts.groupBy(*scope, "sought", "_of").agg(F.count(F.lit(1)).alias("_found"), F.min_by(F.struct("_ids", "_own"), F.struct(F.size("_ids"), "gram")).alias("_r")).where("_found = _of")
    return rarest.select(*scope, "sought", "_r._own", F.explode("_r._ids").alias("_id"))


def holding(sought: DataFrame, texts: DataFrame, scope: list[str], along: tuple[list[str], list[str]] = ((), ())) -> DataFrame:
    """scope, sought, text: each pair of a string (scope, sought) and a text (scope, text) that holds it. With columns `along`, those of sought and those of texts, each pair of rows."""
    known = lambda rows, *c: rows.select(*scope, *c).dropna(subset=[*scope, c[0]]).where(F.col(c[0]) != "")
    strings, rows = known(sought, "sought", *along[0]), known(texts, "text", *along[1]).withColumn("_id", F.xxhash64("text"))
    own, all_ = strings.groupBy(*scope, "sought").agg(F.collect_list(F.struct(*along[0]) if along[0] else F.lit(None).cast("int")).alias("_own")), rows.select(*scope, "text", "_id").distinct()
    runs = sought_runs(strings, scope).groupBy(*scope).agg(F.collect_set("gram").alias("_g"))
    runs = runs.select(*scope, F.when(F.size("_g") <= FEW, F.col("_g")).alias("_few"), F.array_distinct(F.transform("_g", lambda g: F.length(g))).alias("_lengths"))
    asked = all_.join(runs, scope) if scope else all_.crossJoin(F.broadcast(runs))
    held = met(_met_candidates(own, postings(asked, scope), scope), rows if along[1] else all_, [*scope, "_id"]).where(F.col("text").contains(F.col("sought")))
    return held.select(*scope, "sought", "text", *along[1], F.explode("_own").alias("_own")).select(*scope, "sought", "text", *along[1], "_own.*") if along[0] else held.select(*scope, "sought", "text")
