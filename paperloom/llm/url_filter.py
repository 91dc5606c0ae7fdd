"""URL filters: host rules first, and link-graph propagation for what no rule decides.

Trust spreads from hosts with pages that the rules allow, by personalised PageRank along the links
between hosts; distrust spreads from hosts with pages that the rules block, along the reversed links
(who links to bad hosts is suspect). Both are counted in pages: each such page is one unit of mass on
its host, so verdicts don't depend on how many pages there are elsewhere. Links are counted by pair of hosts before
anything else, so the graph has host pairs, not pages. A host is blocked if its distrust exceeds
both a floor and its trust times a factor; hosts that neither reaches are allowed.

Defined results: a null url and one without "://" have empty host and path and are allowed unless a
rule fits; of rules that fit, the longest wins, then the first in the list; html that is null or has
no absolute links adds no links; an empty table gives an empty result; rows that repeat a page_id
are judged each on their own; other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (verdict, host and path) of the rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Steps go on until no host's score moves by more than TOLERANCE of itself (of FLOOR, if it is less). What is left to move
#: shrinks by DAMPING a step, so STEPS is never reached below some 10^20 pages; beyond it is an error.
DAMPING, STEPS, TOLERANCE = 0.85, 400, 1e-6
#: A host is blocked with distrust above FLOOR (in pages) and above FACTOR times its trust.
FLOOR, FACTOR = 1e-6, 1.0
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s<>]+)"""


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, lower(F.regexp_extract(F.substring_index(F.substr(url, F.instr(url, "://") + 3), "/", 1), r"^[^?#]*", 0))), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The number of the rule that decides, or null."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), -i)):  # the longest is tested first
        where, at = rules[i][1].partition("/")[0], "/" + rules[i][1].partition("/")[2]
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(at)
        out = F.when(fits, i).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """a, b, n: how many links lead from one host to another."""
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))
    ends = pages.where("host <> ''").select(F.col("host").alias("a"), found.alias("to")).select("a", host(F.regexp_replace("to", "^//", "http://")).alias("b"))
    return ends.where("b <> '' AND a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: host, score; edges a, b, n and seeds host, mass. What a host without links holds goes back to the seeds."""
    total = edges.groupBy("a").agg(F.sum("n").alias("all"))
    shares = C.written(edges.join(total, "a").select(F.col("a").alias("host"), "b", (F.col("n") / F.col("all")).alias("share")))
    now = C.written(seeds.select("host", F.col("mass").alias("score")))
    whole = now.agg(F.sum("score")).first()[0] or 1.0
    if shares.isEmpty() or now.isEmpty():
        return now
    for _ in range(steps):
        flow = now.join(shares, "host").groupBy(F.col("b").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        back = seeds.select("host", (F.col("mass") / whole).alias("seed"))
        moved = flow.agg(F.sum("flow")).first()[0] or 0.0
        new = flow.join(back, "host", "full_outer").select("host", (damping * F.coalesce("flow", F.lit(0.0)) + (whole - damping * moved) * F.coalesce("seed", F.lit(0.0))).alias("score"))
        new = C.written(new)
        change = new.join(now.withColumnRenamed("score", "old"), "host", "full_outer").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))) / F.greatest("score", F.lit(FLOOR)))).first()[0] or 0.0
        C.forget(now)
        now = new
        if change < tolerance:
            C.forget(shares)
            return now
    raise RuntimeError(f"scores still move by {change} after {steps} steps")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, floor: float = FLOOR, factor: float = FACTOR) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust of every row."""
    url = F.col("url").cast("string")
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit("")
    base = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), html.alias("html"))
    fit = F.col("fit")
    own = base.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    allows = F.coalesce(fit.isin([i for i, r in enumerate(rules) if r[0] == "allow"]), F.lit(False))
    hosts = C.written(own.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(allows).alias("good"), F.count_if(fit.isNotNull() & ~allows).alias("bad")))

    def seeds(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(F.col(column) > 0).select("host", F.col(column).cast("double").alias("mass"))

    edges = C.written(links(own.select("host", "html")))
    trust = propagate(edges, seeds(hosts, "good")).withColumnRenamed("score", "trust")
    distrust = propagate(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"), seeds(hosts, "bad")).withColumnRenamed("score", "distrust")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    marks = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", zero("trust"), zero("distrust"))
    out = C.attach(own.drop("html"), marks, "host", by="page_id", how="left").select("page_id", "host", "path", "fit", zero("trust"), zero("distrust"))
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (v, r) in enumerate(rules):
        verdict, rule = F.when(fit == i, v).otherwise(verdict), F.when(fit == i, r).otherwise(rule)
    method = F.when((F.col("distrust") > floor) & (F.col("distrust") > factor * F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "trust", "distrust")


def query(spark, sf_dir):
    return judge(C.table(spark, sf_dir, "pages")).drop("trust", "distrust")
