"""Mixing sources to target weights with soft membership.

A table of labelled documents (doc_id, domain) trains a multinomial naive Bayes classifier over the
words of a text, lower-cased and hashed to PLACES; it gives every document a posterior over the domains
that have a target, also those whose own domain is missing or wrong. Words are not independent, so the
evidence of a text is counted as that of a number of words at most; that number is the one under which a
held-out fifth of the labelled documents is likeliest, each word of a text having its share. With rate r a document counts r times, so a domain's expected tokens are the sum
of rate, tokens and posterior over all documents. Nonnegative rates minimise the squared distance of these
totals from the targets, plus DAMPING times how far rates are from 1 (weighted by tokens), which decides
between rates that do equally well: so rates stay as near to 1 as the targets allow, and where no rates
meet the targets, totals come as near as nonnegative least squares do (but for the damping's share). It is a
projected gradient method in its lazy form: steps accumulate in an unprojected point, which is one number
a domain (g), and a document's rate is the projection max(0, 1 - posterior . g). A step is one
aggregation over all documents, which gives the gradient and the curvature of the documents whose rate is
above 0; the gradient is scaled by the curvature and shortened until the objective descends. With more than
MOST_CURVED domains the curvature's bound is used, domain by domain. The fit ends when the gradient
is a TOLERANCE of all tokens; the point whose totals are nearest to the targets is returned, so a fit
is never worse than rates of 1.

Only DataFrame expressions are used; what reaches the driver is one row of sums over all documents,
of a size set by the number of domains, and once the counts of PLACES by domain.

Defined results: null and empty texts have no tokens and the prior as posterior; labels that are
null or contradict each other are left out; without labels there is one domain, REST, and rates
are 1; domains without a target are one class together, REST, and get none (rates of pure members go
to 0); characters of scripts without spaces are words; target weights of domains without labelled
documents can't be met and are dropped, the rest scaled up; targets that no rates meet are
approached as far as least squares do, the rest is told by Fit.missed and a warning; a very long text is
one row like others; rows that repeat a doc_id are documents
of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PLACES = 4096
#: What is between words; after each character of scripts without spaces a word ends.
BETWEEN = r"[^\p{L}\p{M}]+|(?<=[\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF])"
#: Labelled documents that training takes at most, those with the smallest hash of doc_id; the class of all domains without a target.
MOST_LABELLED, REST = 50_000, "(rest)"
#: Words that a text's evidence may count as, to choose from; the first where nothing is labelled.
EVIDENCE = (60.0, 7.5, 15.0, 30.0, 120.0, 240.0, 480.0, 1e12)
#: Aggregations at most; the gradient's length, in shares of all tokens, that ends the fit; the weight of rates' distance from 1.
STEPS, TOLERANCE, DAMPING = 300, 1e-6, 1e-6
#: Domains whose curvature is summed pair by pair.
MOST_CURVED = 24
#: Share of all tokens that may be missed without a warning.
MISS = 0.01
#: Target weights of the registered query, by language.
TARGETS = {"en": 0.40, "de": 0.25, "fr": 0.20, "es": 0.15}


def _places(text: Column) -> Column:
    """The place of each word."""
    words = F.array_remove(F.split(F.lower(text), BETWEEN), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int"))


@dataclass
class Model:
    """By class: log priors and log probabilities of PLACES; and the words that a text's evidence counts as at most."""

    priors: dict[str, float]
    logs: dict[str, list[float]]
    evidence: float = EVIDENCE[0]

    @property
    def names(self) -> list[str]:
        return list(self.priors)


@dataclass
class Fit:
    """The dual point, and the totals of every class reached and wanted."""

    g: list[float]
    reached: list[float]
    wanted: list[float]

    @property
    def missed(self) -> float:
        """The share of wanted tokens that is missed."""
        return sum(abs(a - b) for a, b in zip(self.reached, self.wanted, strict=True)) / max(1.0, sum(self.wanted))


def _logs(counts: list[float]) -> list[float]:
    whole = sum(counts)
    return [round(math.log(x / whole), 9) for x in counts]


def _evidence(logs: list[float]) -> Column:
    """The sum of the logs of all words in _places."""
    table = F.split(F.lit(",".join(map(repr, logs))), ",").cast("array<double>")
    return F.aggregate("_places", F.lit(0.0), lambda s, x: s + F.get(table, x))


def _words(limit: float) -> Column:
    """How far a text's evidence counts."""
    return F.least(F.lit(1.0), limit / F.greatest(F.size("_places"), F.lit(1)))


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = MOST_LABELLED) -> Model:
    """The classifier of these domains and the rest. docs: C.keyed rows."""
    clear = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other").select("doc_id", "domain")
    sample = C.at_most(clear, most)
    own = F.when(F.col("domain").isin(domains), F.col("domain")).otherwise(REST) if domains else F.lit(REST)
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    rows = C.written(docs.select("doc_id", "text").join(sample, "doc_id").select(own.alias("domain"), held.alias("held"), _places(F.col("text")).alias("_places")))
    size = {(r["domain"], r["held"]): r["count"] for r in rows.groupBy("domain", "held").count().collect()}
    names = sorted({d for d, _ in size})
    if not names:
        return Model({REST: 0.0}, {REST: [math.log(1 / PLACES)] * PLACES})
    counts = {(n, h): [0] * PLACES for n in names for h in (False, True)}
    for r in rows.select("domain", "held", F.explode("_places").alias("place")).groupBy("domain", "held", "place").count().toLocalIterator():  # PLACES by class at most
        counts[r["domain"], r["held"]][r["place"]] += r["count"]
    n = sum(size.values())
    priors = {d: math.log((size.get((d, False), 0) + size.get((d, True), 0)) / n) for d in names}
    made = Model(priors, {d: _logs([1.0 + a + b for a, b in zip(counts[d, False], counts[d, True], strict=True)]) for d in names})
    if len(names) > 1 and any(h for _, h in size) and all(size.get((d, False)) for d in names):
        tried = rows.where("held").select("domain", "_places", *(_evidence(_logs([1.0 + x for x in counts[d, False]])).alias(f"e{k}") for k, d in enumerate(names)))
        losses = []
        for i, limit in enumerate(EVIDENCE):
            scores = [F.lit(priors[d]) + _words(limit) * F.col(f"e{k}") for k, d in enumerate(names)]
            top = F.greatest(*scores)
            mine = sum((F.when(F.col("domain") == d, s).otherwise(0.0) for d, s in zip(names, scores, strict=True)), F.lit(0.0))
            losses.append(F.sum(top + F.log(sum((F.exp(s - top) for s in scores), F.lit(0.0))) - mine).alias(f"l{i}"))
        loss = tried.agg(*losses).first()
        made.evidence = min(zip(loss, EVIDENCE, strict=True))[1]
    return made


def profiles(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns to keep of C.keyed rows, tokens, and the posterior q0, q1, ... in the order of the model."""
    rows = rows.select(*keep, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), _places(F.col("text")).alias("_places"))
    rows = rows.select(*keep, "tokens", *(F.round(F.lit(model.priors[d]) + _words(model.evidence) * _evidence(model.logs[d]), 9).alias(f"s{k}") for k, d in enumerate(model.names)))
    scores = [F.col(f"s{k}") for k in range(len(model.names))]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    rows = rows.select(*keep, "tokens", *(F.exp(s - top).alias(f"e{k}") for k, s in enumerate(scores)))
    whole = sum((F.col(f"e{k}") for k in range(len(scores))), F.lit(0.0))
    return rows.select(*keep, "tokens", *((F.col(f"e{k}") / whole).alias(f"q{k}") for k in range(len(scores))))


def rate(g: list[float]) -> Column:
    return F.greatest(F.lit(0.0), 1 - sum((F.col(f"q{k}") * F.lit(x) for k, x in enumerate(g)), F.lit(0.0)))


def fit(made: DataFrame, targets: list[float], budget: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Rates for these targets, by class; budget: tokens in all (as many as there are, if None)."""
    n = len(targets)
    pairs = [(k, m) for k in range(n) for m in range(k, n)] if n <= MOST_CURVED else []

    def sums(g: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Totals by class, half the weighted squares of the rates, and the curvature of the documents above 0."""
        r, t = F.col("_r"), F.col("tokens")
        rows = made.select("tokens", *(f"q{k}" for k in range(n)), rate(g.tolist()).alias("_r"))
        above = F.when(r > 0, t)
        found = rows.agg(*(F.sum(r * t * F.col(f"q{k}")) for k in range(n)), F.sum(t * r * r) / 2, *(F.sum(above * F.col(f"q{k}") * F.col(f"q{m}")) for k, m in pairs)).first()
        values = np.array([float(x or 0.0) for x in found])
        curve = np.zeros((n, n))
        for (k, m), x in zip(pairs, values[n + 1 :], strict=True):
            curve[k, m] = curve[m, k] = x
        return values[:n], values[n], curve

    g = np.zeros(n)
    start, half, curve = sums(g)
    have = np.array([t if s > 0 else 0.0 for t, s in zip(targets, start, strict=True)])
    whole = start.sum()
    if have.sum() == 0 or whole == 0:
        return Fit(g.tolist(), start.tolist(), start.tolist())
    want = have / have.sum() * (budget or whole)
    # everything in shares of all tokens; half the squared rates + g . want + damping |g|^2 / 2 is convex, and its gradient is damping g - miss
    objective = lambda g, half: half / whole + g @ want / whole + DAMPING * (g @ g) / 2
    best, reached, now = (float(((start - want) ** 2).sum()), g, start), start, objective(g, half)
    used, open_ = 1, start > 0
    while used < steps:
        down = DAMPING * g - (reached - want) / whole
        down[~open_] = 0.0
        if np.abs(down).max() <= tolerance * DAMPING or np.abs(down).sum() <= tolerance and np.abs(reached - want).sum() <= tolerance * whole:
            break
        bend = curve / whole + DAMPING * np.eye(n) if pairs else np.diag(start / whole + DAMPING)
        step = np.linalg.solve(bend, down)
        length, moved = 1.0, False
        while used < steps and length > 1e-9:
            trial = g - length * step
            totals, half, curve_there = sums(trial)
            used += 1
            value = objective(trial, half)
            if value <= now - 1e-4 * length * (down @ step):
                moved = True
                break
            length /= 2
        if not moved:
            break
        flat = now - value <= 1e-13 * max(1.0, abs(now))
        g, reached, now, curve = trial, totals, value, curve_there
        far = float(((reached - want) ** 2).sum())
        if far < best[0]:
            best = (far, g, reached)
        if flat:
            break
    return Fit(best[1].tolist(), best[2].tolist(), want.tolist())


def fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> tuple[Model, Fit, DataFrame]:
    """The classifier, the fit, and the written profiles by doc_id and row key."""
    rows = C.keyed(docs)
    with C.scratch(docs.sparkSession):
        model = train(rows, labelled, list(targets))
    made = C.written(profiles(rows, model, "doc_id", *C.ROW))
    fit_ = fit(made, [targets.get(n, 0.0) for n in model.names], budget)
    if fit_.missed > MISS:
        warnings.warn(f"the mixture misses its targets by {fit_.missed:.3f} of all tokens: {dict(zip(model.names, fit_.reached, strict=True))}", stacklevel=2)
    return model, fit_, made


def copies(rate: Column, doc_id: Column) -> Column:
    """The rate rounded up or down, with the chance of its fraction, by a hash of doc_id."""
    toss = F.pmod(F.xxhash64(doc_id.cast("long"), F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + F.when(toss < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior (by domain), rate, copies of every row."""
    model, found, made = fitted(docs, labelled, targets, budget)
    names = model.names
    posterior = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.round(f"q{k}", 6) for k in range(len(names)))))
    likeliest = F.array_max(F.array(*(F.struct(F.col(f"q{k}").alias("q"), F.lit(-k).alias("rank"), F.lit(n).alias("name")) for k, n in enumerate(names))))["name"]
    rows = made.select("doc_id", "tokens", likeliest.alias("domain"), posterior.alias("posterior"), F.round(rate(found.g), 6).alias("rate"))
    return rows.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """The rows of docs, each as often as its copies say, with its columns."""
    _, found, made = fitted(docs, labelled, targets, budget)
    often = made.select(*C.ROW, copies(F.round(rate(found.g), 6), F.col("doc_id")).alias("_n")).groupBy(*C.ROW).agg(F.max("_n").alias("_n"))
    return C.keep_rows(docs, often, "_n")


def languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as domain."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("domain")).join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")


def query(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return mix(docs, languages(docs, C.table(spark, sf_dir, "labels")), TARGETS).withColumn("posterior", F.to_json("posterior"))
