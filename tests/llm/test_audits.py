"""Decontamination, filter audit and source divergence against brute force, with the cases that tables may hold."""

import collections
import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontamination, divergence, filter_audit

KINDS = "doc_id long, text string, lang string, source string"


def words(n, seed, vocab=3000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocab, n))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def clashing(docs, *names):
    for name in names:
        docs = docs.withColumn(name, F.lit(7))
    return docs


# decontamination

ITEMS = [(1, words(25, 1)), (2, words(12, 2).upper()), (2, words(11, 3)), (3, "Zß ÉTÉ one"), (4, "solo"), (5, ""), (6, None), (None, words(10, 4)), (10, words(25, 1)), (7, "a b a b a b a b a b a b")]


def contaminated():
    a, b, c = (x.split() for x in (words(25, 1), words(12, 2), words(11, 3)))
    long = words(200_000, 9)
    assert len(long) > 1 << 20
    return [
        (1, " ".join(["x", *a[3:20], "y"])), (2, "...".join(b).title()), (2, "\n".join(c)), (3, " ".join(a[:9])), (4, "zß\tÉtÉ-ONE"), (5, "zß été one SOLO"), (6, None), (7, ""),
        (8, " ".join(a[5:15] + a[5:15])), (8, " ".join(a[5:15] + a[5:15])), (None, words(10, 4)), (None, "nothing"), (9, "a b " * 30), (11, long + " " + " ".join(a) + " " + long), (12, "Solo-solo_SOLO4"), (13, "... ---"),
    ]


def windows_of(text, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def brute_windows(text, items):
    by = collections.defaultdict(set)
    for i, t in items:
        for w in windows_of(t):
            by[w].add("" if i is None else str(i))
    sizes = {len(w) for w in by}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for n in sizes:
        for i in range(len(w) - n + 1):
            if (x := tuple(w[i : i + n])) in by:
                hit |= set(range(i, i + n))
                found |= by[x]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.fixture
def folder(spark, tmp_path):
    def put(**tables):
        for name, rows in tables.items():
            rows.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


@pytest.mark.parametrize("most", [decontamination.MOST_ROWS, 7])
def test_windows(spark, folder, monkeypatch, most):
    """Overlaps, short items, shared windows, upper case, ids that are null or repeated, long texts; in one block of prefixes and in many."""
    monkeypatch.setattr(decontamination, "MOST_ROWS", most)
    docs = clashing(spark.createDataFrame(contaminated(), "doc_id long, text string"), "shingle", "words", "at", "_k", "_h", "spans", "item_id", "n")
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"), "words", "off", "shingle", "n", "_at")
    got = decontamination.query(spark, folder(documents=docs, benchmark=items)).collect()
    want = [(i, *brute_windows(t, ITEMS)) for i, t in contaminated()]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got))) == sorted(map(str, want))
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_no_windows(spark, folder):
    docs, items = spark.createDataFrame(contaminated(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not any(r.items for r in decontamination.judge(docs, items.limit(0)).collect())
    assert decontamination.judge(docs.limit(0), items).count() == 0
    assert decontamination.query(spark, folder(documents=docs.limit(0), benchmark=items.limit(0))).count() == 0


def test_share_of_a_window(spark):
    """Below share 1, a place counts with enough aligned shingles; prefixes miss none of them."""
    rng = np.random.default_rng(5)
    items = [(i, words(14, 50 + i, 40)) for i in range(12)]
    docs = []
    for i in range(60):
        w = words(30, 900 + i, 40).split() + items[i % 12][1].split() + words(30, 1900 + i, 40).split()
        w[int(rng.integers(30, 44))] = "edit"
        docs.append((i, " ".join(w)))
    for share in (1.0, 0.6, 0.3):
        want = set()
        for d, text in docs:
            w = text.split()
            for item, t in items:
                for win in windows_of(t):
                    for at in range(len(w) - len(win) + 1):
                        alike = sum(w[at + k : at + k + 3] == list(win[k : k + 3]) for k in range(len(win) - 2))
                        if alike >= int(np.ceil((len(win) - 2) * share)):
                            want.add((d, str(item), at, at + len(win)))
        made = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), share=share)
        assert {(r["_k"], r.item_id, r.begin, r.end) for r in made.collect()} == want and (share == 1 or want)


def test_clean(spark):
    docs = clashing(spark.createDataFrame(contaminated(), "doc_id long, text string"), "_c0", "_k")
    kept = decontamination.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (x for x in contaminated() if not brute_windows(x[1], ITEMS)[1])))


# filter audit

RULES = {"A": lambda t, w: len(w) < 200, "B": lambda t, w: 100 * len(set(w)) < 50 * len(w), "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": lambda t, w: bool(re.search(r"[#$%&*|]", t))}


def audited():
    rng, out = np.random.default_rng(3), []
    for i in range(80):
        t = words(int(rng.choice([5, 150, 250, 400])), i, int(rng.choice([20, 4000])))
        t = t.upper() if rng.random() < 0.3 else t
        t += " #" if rng.random() < 0.3 else ""
        out.append((i, t, [None, "", "en", "de"][i % 4], "s"))
    out += [(100 + i, out[7 * (i % 3)][1], "en", "s") for i in range(20)]  # groups of copies
    out += [(5, out[0][1], "de", "s"), (5, out[0][1], "de", "s"), (None, out[0][1], "en", "s"), (None, None, None, None), (200, None, "en", "s"), (201, "", "en", "s"), (202, " \t\n", "en", "s"), (203, "é" * 300_000 + " A" * 500_000, "fr", "s")]
    return out


LABELS = [(i, i % 3 % 2, i % 2) for i in range(0, 210, 2)] + [(None, 1, 1), (5, None, 1), (5, 1, None), (8, 1, 1), (8, 0, 0)]


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = collections.defaultdict(lambda: [0] * 7)
    for i, t, lang, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {f for f, rule in RULES.items() if rule(t or "", w)} | ({"E"} if i is not None and i > first[t or ""] else set())
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order):
                row = out[lang or "", order, k + 1]
                here = f in fails and not gone
                row[2] += f in fails and gone
                gone |= here
                row[0] += not gone
                row[1] += here
                row[3] += fails == {f}
                row[4] += here and i in good
                row[5] += here and i in toxic
    for (part, order, k), row in out.items():
        row[6] = sum(out[part, o, o.index(order[k - 1]) + 1][1] for o in map("".join, permutations("ABCDE")))
    return dict(out)


@pytest.mark.parametrize("parts", [filter_audit.MOST_PARTS, 1])
def test_filter_audit(spark, folder, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "MOST_PARTS", parts)
    docs = clashing(spark.createDataFrame(audited(), KINDS), "part", "fails", "digest", "good", "words", "first", "_salt")
    labels = clashing(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), "good", "text")
    got = filter_audit.query(spark, folder(documents=docs.repartition(3), labels=labels)).collect()
    made = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in got}
    assert len(got) == len(made) and made == brute_audit(audited(), LABELS)


def test_filter_audit_of_nothing(spark, folder):
    docs, labels = spark.createDataFrame(audited(), KINDS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


# divergence


def spoken():
    rng, out = np.random.default_rng(8), []
    for i in range(240):
        vocab = [f"{'abcdefghij'[int(x) % 10]}{'é' if x % 3 else 'q'}{'klmnopqrst'[int(x) // 10 % 10]}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 100]
        vocab = [v.upper() if k % 5 == 0 else v for k, v in enumerate(vocab)]
        out.append((i, " 4\x00,".join(vocab), ["en", "fr", None, ""][int(rng.integers(4))], f"s{int(rng.zipf(1.5)) % 7}"))
    out += [(1, None, "en", "silent"), (2, "", "xx", "a"), (3, "alone", "xx", None), (None, "twice twice", "yy", "b"), (4, "1234 ...", "xx", "")] + [(5, "same same words", "en", "s1")] * 12
    return [*out, (6, "w x " * 300_000, "en", "long")]


def brute_divergence(docs, least=10, top=10):
    df, counts, groups = (collections.defaultdict(collections.Counter) for _ in range(3))
    for _, t, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))
        df[lang or ""].update(set(terms))
        groups[lang or ""][source or ""] += 1
        counts[lang or "", source or ""].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def p(c, v=v, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(sum((counts[lang, s] for s in sources), collections.Counter()))
        by = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            said = {"pair": [(sum(f(by[s][t], by[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(by[s][t], q[t]), t) for t in kept if counts[lang, s][t] and by[s][t] > q[t]]}
            for part, rows in said.items():
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, folder, monkeypatch, small):
    """In one block of terms and sources, and in many."""
    if small:
        for name, value in {"MOST_BYTES": 200, "SOURCES": 2, "TERMS": 5, "MOST_HELD": 20, "MOST_CELLS": 50}.items():
            monkeypatch.setattr(divergence, name, value)
    docs = clashing(spark.createDataFrame(spoken(), KINDS), "term", "n", "p", "group", "part", "rank", "block", "terms", "_salt")
    at = folder(documents=docs.repartition(3))
    made = divergence.audit(spark.read.parquet(f"{at}/documents.parquet")) if not small else divergence.audit(docs)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(spoken())
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_is_exact(spark):
    """Counts whose products exceed 64 bits."""
    rows = spark.createDataFrame([(10**12, 3 * 10**12, 7), (0, 0, 1), (10**12, 10**12, 1)], "n long, whole long, terms long")
    got = [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("whole"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (whole + 2 * v) for n, whole, v in ((10**12, 3 * 10**12, 7), (0, 0, 1), (10**12, 10**12, 1))]
