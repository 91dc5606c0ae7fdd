"""Operators on corpora against brute force, on small tables: nulls, empty and long texts, ties, copies, extra columns."""

import collections
import hashlib
import json
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import blocked, common, exact_dedup, jaccard_join, mixing, packing, paragraph_dedup, quality, secret_scan, suffix_dedup, toxicity, url_filter

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed, vocab=3000):
    return " ".join(f"w{x}é" if x % 7 == 0 else f"w{x}" for x in np.random.default_rng(seed).integers(0, vocab, n))


def made():
    """Texts with copies, near copies in a chain, shared passages, and odd cases."""
    base, passage = words(200, 1).split(), words(90, 2)
    out = [None, "", "  \n\t", "one two", "One  TWO", "a", words(6000, 3), "word " * 900, "x" * 3000, "é" * 500, "Straße — ¿qué?\r\n中文 text\x00", "line\n" * 40]
    out += [" ".join(base)] * 6 + [" ".join(base) + " "]
    for k in range(8):
        near = list(base)
        for j in range(k + 1):
            near[(17 * j + 5 * k) % 200] = f"edit{k}x{j}"
        out.append(" ".join(near))
    for k in range(6):
        out.append(words(60, 100 + k) + ".\n" + passage + ".\n" + words(50, 200 + k))
    out += [words(120, 300 + k) for k in range(12)]
    return out


@pytest.fixture(scope="module")
def texts():
    return made()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(3 * i, t, "en", "s", 0) for i, t in enumerate(texts)], KINDS).withColumn("keep_id", F.lit("clash")).withColumn("sid", F.lit(1)).cache()


def test_exact_dedup(docs, texts):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in texts]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    want = {}
    for t, g in groups.items():
        keep = min(g, key=lambda i: (-len(texts[i] or ""), i))
        for i in g:
            want[3 * i] = (3 * keep, len(g), i == keep, hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()} == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, w in want.items() if w[2])


def test_exact_dedup_with_clashing_identifiers(spark):
    """Chunks whose 64 bits are the same are told apart by their digests."""
    a, b = hashlib.sha256(b"a").digest(), hashlib.sha256(b"b").digest()
    rows = spark.createDataFrame([(1, 0, 1, "x", [7], [a]), (2, 0, 1, "y", [7], [b]), (3, 0, 1, "x", [7], [a])], exact_dedup._SCHEMA)
    keep = exact_dedup.recipes
    exact_dedup.recipes = lambda _: rows
    try:
        assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
    finally:
        exact_dedup.recipes = keep


def test_suffix_dedup(docs, texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = {}
    for k, b in enumerate(raw):
        keep = np.ones(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                keep[i : i + 400] = False
        rest = np.frombuffer(b, np.uint8)[keep].tobytes()
        runs = int((np.append(True, keep)[:-1] & ~keep).sum())
        want[3 * k] = (len(b), len(b) - len(rest), runs, hashlib.sha256(rest).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()} == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(docs, texts):
    sets = [shingles(t) for t in texts]
    group = components(len(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    want = {3 * i: (len(s), 3 * group[i]) for i, s in enumerate(sets)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (200, 200), (301, 300), (301, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 300: 300, 301: 300}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(packing.tokenizer_path()), {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[3 * i, k] = (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))
    rows = packing.pack(docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 4096
    assert len(by) <= sum(w[1] for w in want.values()) / 4096 + 2


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 51, rng.integers(1, 200)).tolist(), reverse=True)
        gaps = []
        for n in sizes:
            fits = [g for g in range(len(gaps)) if gaps[g] >= n]
            if fits:
                g = min(fits, key=lambda g: gaps[g])
                gaps[g] -= n
            else:
                gaps.append(50 - n)
        got = packing.sweep(dict(collections.Counter(sizes)), 50)
        assert sum(m[2] for m in got) == len(sizes) and max(m[3] + -(-m[2] // m[4]) for m in got) == len(gaps)


def test_quality(docs, texts, spark):
    def base(t):
        w = WORD.findall(t or "")
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, dup = set(), 0
        for x in (t or "").split("\n"):
            if WORD.search(x):
                dup += x in lines
                lines.add(x)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)

    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: (*(r[c] for c in quality.BASE), r.base_failed) for r in quality.quality_rules(docs, labels).collect()}
    assert got == {3 * i: base(t) for i, t in enumerate(texts)}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in got.items() if not v[-1])


def test_quality_cutoffs_hold_their_limit():
    assert quality.binomial_tail(2, 10, 0.3) == pytest.approx(sum(__import__("math").comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    row = {"stratum": "en", "good": 2000} | {f"good_m_{i}": k for i, k in enumerate((0, 2, 5, 300))} | {f"bad_m_{i}": k for i, k in enumerate((3, 9, 9, 80))}
    assert quality.choose([row], {"m": [0.9, 0.5, 0.3, 0.1]}, 0.02, 0.05) == {("en", "m"): 0.5}
    assert quality.choose([row | {"good": 20}], {"m": [0.9, 0.5, 0.3, 0.1]}) == {}


def test_quality_learns_from_every_label(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_LABELLED", 100, raising=False)
    of = "id AS doc_id, CASE WHEN id % 3 = 0 THEN 'en' END AS stratum, 100L AS n_words, 500L AS word_chars, CASE WHEN id % 5 = 0 THEN 400L ELSE 0L END AS n_symbols, 0L AS n_dup_lines, 0L AS n_repeat_words, 10L AS n_lines, 5L AS n_upper, false AS base_failed"
    measured = spark.range(9000).selectExpr(*of.split(", "))
    labels = spark.range(9000).selectExpr("id AS doc_id", "CAST(id % 5 <> 0 AS INT) AS quality")
    assert {(r._s, r._m_symbols) for r in quality.learn(measured, labels).collect()} == {("en", 0.7), (None, 0.7)}
    got = quality.judge(measured, labels).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 7200, False: 1800}


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1500):
        w, bad = words(80, 5000 + i).split(), bool(rng.random() < 0.3)
        for k in rng.choice(80, 4, replace=False) if bad else []:
            w[k] = str(rng.choice(["awful", "nasty", "vile", "rotten"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame([*rows, (9999, None, "en", "s", 0)], KINDS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [
        (1, "http://WWW.Example.com/en/1?q", link("good.org"), "allow", "www.example.com/en/"), (2, "https://m.example.com/en/2", None, "block", "example.com/en/"), (3, "http://x.net/es/1#t", "", "block", "net/es/"), (4, "http://good.org/a", link("friend.org"), "allow", None),
        (5, "http://shady.org/a", link("x.net"), "block", None), (6, None, None, "allow", None), (7, "no scheme", "", "allow", None), (8, "http://com?x", "", "allow", None), (9, "http://far.org", "", "allow", None), (9, "http://x.com/", "", "allow", "com/"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    got = collections.Counter((r.page_id, r.verdict, r.rule) for r in url_filter.judge(df).collect())
    assert got == collections.Counter((p[0], p[3], p[4]) for p in pages)
    by = {r.page_id: (r.host, r.path) for r in url_filter.judge(df).collect() if r.page_id != 9}
    assert (by[1], by[3], by[6], by[8]) == (("www.example.com", "/en/1"), ("x.net", "/es/1"), ("", ""), ("com", ""))


def test_urls_whatever_the_size(spark):
    schema = "page_id long, url string, html string"
    small = [(1, "http://shady.org/a", '<a href="http://bad.net/x">'), (2, "http://bad.net/es/1", ""), (3, "http://part.net/es/1", ""), (4, "http://part.net/a", ""), (5, "http://part.net/b", ""), (6, "http://far.org/", "")]
    large = spark.range(1000, 1_501_000).select(F.col("id").alias("page_id"), F.lit("http://big.net/es/1").alias("url"), F.lit("").alias("html"))
    few = spark.createDataFrame(small, schema)
    got = {r.page_id: r.verdict for r in url_filter.judge(few.unionByName(large)).where("page_id < 1000").collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_paragraphs(docs, texts):
    units = [(i, j, w) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n")) if len(w := tuple(WORD.findall(x.translate(LOW)))) >= paragraph_dedup.LEAST_WORDS]
    sets = [{u[2][k : k + 5] for k in range(len(u[2]) - 4)} for u in units]
    group = components(len(units), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    want = collections.Counter(3 * u[0] for k, u in enumerate(units) if group[k] != k)
    got = {r.doc_id: r for r in paragraph_dedup.paragraph_dedup(docs).collect()}
    assert {d: r.n_paragraphs for d, r in got.items() if r.n_paragraphs} == dict(want) and len(got) == len(texts)
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[3 * i]
        cut = [(r.spans[k], r.spans[k + 1]) for k in range(0, len(r.spans), 2)]
        rest = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(raw)], strict=True))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest())
    bands, rows = paragraph_dedup.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


@pytest.mark.parametrize("n", [44, 45, 60, 100])
def test_passages_anywhere(spark, n):
    """Equal runs of 45 words or more are cut out to their last word, with and without sentence ends and line ends; shorter ones stay."""
    passage = words(n, 500)
    hard = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    ends = lambda t: ". ".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    whole = [words(150, 600 + k) + " " + passage + " " + words(140, 700 + k) for k in range(6)]
    texts = whole[:3] + [hard(t, 7) for t in whole[3:]] + [words(150, 800), ends(words(90, 801)) + " " + ends(passage), ends(words(70, 802)) + " " + ends(passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], KINDS)
    got = {r.doc_id: r for r in paragraph_dedup.paragraph_dedup(docs).collect()}
    cut = lambda i: [texts[i].encode()[a:b].decode().split() for a, b in zip(got[i].spans[::2], got[i].spans[1::2], strict=True)]
    gone = [] if n < paragraph_dedup.LEAST_PASSAGE else [passage.split()]
    assert [cut(i) for i in range(7)] == [[], *[gone] * 5, []]
    assert cut(7) == [] and cut(8) in ([], [ends(passage).split()]) and (n < paragraph_dedup.LEAST_PASSAGE or cut(8))
    assert [got[i].n_passages for i in range(7)] == [0, *[len(gone)] * 5, 0]


def test_text_that_repeats_itself(spark):
    texts = ["tick\ntock " * 80, words(100, 900)]
    got = {r.doc_id: r for r in paragraph_dedup.paragraph_dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], KINDS)).collect()}
    assert 0 < got[0].n_removed < got[0].n_bytes and got[1].n_removed == 0


def test_mixing(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(300):
        bag = ["the when how", "que ñandu quien"][i % 3 == 0].split()
        rows.append((i, " ".join(rng.choice(bag, 50)), ["en", "es"][i % 3 == 0], "s", 0))
    docs = spark.createDataFrame([*rows, (1000, None, None, "s", 0)], KINDS).withColumn("tokens", F.lit("clash"))
    labelled = docs.where("doc_id < 200").select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labelled, {"en": 0.25, "es": 0.75}).collect()
    total = {d: sum(r.rate * r.tokens * r.posterior[d] for r in got) for d in ("en", "es")}
    assert total["es"] / sum(total.values()) == pytest.approx(0.75, abs=0.002) and min(r.rate for r in got) >= 0 and len(got) == 301
    assert np.mean([r.domain == ["en", "es"][r.doc_id % 3 == 0] for r in got if r.doc_id < 300]) > 0.99
    out = mixing.mixed(docs, labelled, {"en": 0.25, "es": 0.75})
    assert out.columns == docs.columns and collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_reads_capitals_and_any_words(spark):
    rng = np.random.default_rng(3)
    bags = {"law": "court judge claim", "sea": "boat wave fish", "ru": "это было там", "zh": "海 山 水", "few": "lamp chair desk"}
    rows = [(i, " ".join(rng.choice(bags[d].split(), 40)), d, "s", 0) for i, d in enumerate(list(bags)[:4] * 30)]
    rows += [(200 + i, t.upper(), d, s, n) for i, (_, t, d, s, n) in enumerate(rows)] + [(900, bags["few"] * 5, "few", "s", 0)]
    docs = spark.createDataFrame(rows, KINDS)
    labelled = docs.where("doc_id < 100 OR doc_id = 900").select("doc_id", F.col("lang").alias("domain"))
    got = {r.doc_id: r for r in mixing.mix(docs, labelled, {"law": 0.5, "few": 0.5}).collect()}
    assert all(got[i].domain == (d if d in ("law", "few") else mixing.REST) for i, _, d, _, _ in rows)
    assert got[900].rate > 1 > got[1].rate


def test_mixing_with_many_domains(spark):
    names = [f"d{k}" for k in range(30)]
    word = lambda k: "qx" + "abcdefghij"[k // 10] + "klmnopqrst"[k % 10]
    rows = [(100 * j + k, " ".join([word(k), word(k) * 2] * 20), n, "s", 0) for j in range(6) for k, n in enumerate(names)]
    docs = spark.createDataFrame(rows, KINDS)
    got = mixing.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")), {n: 10.0 + k for k, n in enumerate(names)}).collect()
    assert all(r.domain == f"d{r.doc_id % 100}" for r in got)
    assert all(r.rate == pytest.approx(30 * (10 + r.doc_id % 100) / sum(range(10, 40)), rel=0.01) for r in got)


def test_mixing_is_the_least_change_that_meets_the_targets(spark):
    """Against Newton's method on the same posteriors: the rates nearest to 1 with these totals."""
    rng = np.random.default_rng(8)
    vocab = ["the when how it".split(), "que el it pan".split()]
    rows = [(i, " ".join(rng.choice(vocab[i % 2] if rng.random() < 0.8 else vocab[1 - i % 2], 1)[0] for _ in range(int(rng.integers(3, 40)))), "ab"[i % 2], "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, KINDS)
    labelled = docs.where("doc_id < 100").select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labelled, {"a": 0.2, "b": 0.8}).collect()
    q = np.array([[r.posterior["a"], r.posterior["b"]] for r in got])
    t, g = np.array([r.tokens for r in got], float), np.zeros(2)
    want = np.array([0.2, 0.8]) * (t[:, None] * q).sum()
    for _ in range(200):
        r = np.maximum(0, 1 - q @ g)
        jac = -(q * (t * (r > 0))[:, None]).T @ q
        g = g - np.linalg.solve(jac, (q * (r * t)[:, None]).sum(0) - want)
    assert np.abs(np.maximum(0, 1 - q @ g) - [r.rate for r in got]).max() < 0.01


def test_mixing_says_what_it_misses(spark):
    docs = spark.createDataFrame([(i, "same words here", "ab"[i % 2], "s", 0) for i in range(20)], KINDS)
    with pytest.warns(UserWarning, match="misses its targets"):
        _, fit, _ = mixing.fitted(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"a": 0.9, "b": 0.1})
    assert fit.missed > 0.5


def nearest(a, want, rounds=200_000):
    """The squared distance that nonnegative least squares reach, by an accelerated projected gradient in plain arrays."""
    step = 1 / np.linalg.eigvalsh(a @ a.T).max()
    r = y = np.ones(a.shape[1])
    best, k = np.inf, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - want)))
        far = ((a @ new - want) ** 2).sum()
        if far > best:
            k, y = 1.0, new
        else:
            best, more = far, (1 + np.sqrt(1 + 4 * k * k)) / 2
            y, k = new + (k - 1) / more * (new - r), more
        r = new
    return best


@pytest.mark.parametrize("case", ["absent", "poor", "alike"])
def test_mixing_on_unreachable_targets(spark, case):
    """As near to the targets as nonnegative least squares, and never worse than rates of 1."""
    rng = np.random.default_rng(4)
    q = {"absent": lambda n: rng.beta(0.3, 90, n), "poor": lambda n: rng.uniform(0.0, 0.2, n), "alike": lambda n: np.full(n, 0.5)}[case](96)
    tokens = rng.integers(1, 200, 96)
    made = spark.createDataFrame([(int(t), float(x), float(1 - x)) for t, x in zip(tokens, q, strict=True)], "tokens long, q0 double, q1 double")
    a = np.array([tokens * q, tokens * (1 - q)])
    want = np.array([0.73, 0.27]) * tokens.sum()
    found = mixing.fit(made, [0.73, 0.27])
    far, ones = ((np.array(found.reached) - want) ** 2).sum(), ((a.sum(1) - want) ** 2).sum()
    rates = np.maximum(0, 1 - np.stack([q, 1 - q], 1) @ found.g)
    assert np.allclose(a @ rates, found.reached) and far <= ones
    assert far <= 1.01 * nearest(a, want, 20_000)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KINDS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (exact_dedup.exact_dedup(docs), suffix_dedup.remove_repeats(docs), mixing.mix(docs, mixing.languages(docs, labels), mixing.TARGETS), packing.pack(docs), quality.quality_rules(docs, labels), jaccard_join.jaccard_components(docs), url_filter.judge(pages), paragraph_dedup.paragraph_dedup(docs), secret_scan.secrets(docs), toxicity.toxicity(docs, labels)):
        assert out.count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, words(150, 9), "en", "s", 0)] * 2 + [(1, words(150, 10), "en", "s", 0), (None, "x", None, None, None)], KINDS)
    assert exact_dedup.exact_dedup(docs).count() == 4 and jaccard_join.jaccard_components(docs).count() == 4 and packing.pack(docs).count() == 4
    assert sorted(r.n_removed > 0 for r in suffix_dedup.remove_repeats(docs).collect()) == [False, False, True, True]


def test_pipeline(spark, tmp_path, texts):
    rows = [(i, t, "en" if i % 2 else "es", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, d))
        assert i == 4 or docs.columns == [x.split(" ")[0] for x in KINDS.split(", ")]
        if i == 2:
            kept = {r.doc_id for r in docs.collect()}
    good = [i for i, t in enumerate(texts) if len(WORD.findall(t or "")) >= 20 and i not in (7, 11)]
    sets = {i: shingles(texts[i]) for i in good}
    group = components(len(good), lambda a, b: 100 * len(sets[good[a]] & sets[good[b]]) >= 80 * len(sets[good[a]] | sets[good[b]]))
    assert len(kept) == len(set(group)) and docs.count() > 0 and docs.where("`offset` + length > 4096").count() == 0


def test_sql_of_exact_dedup(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cursor = con.execute(entry.oracle_sql()["op1_exact_dedup"])
    names = [c[0] for c in cursor.description]
    want = sorted(json.dumps(dict(zip(names, r, strict=True)), sort_keys=True) for r in cursor.fetchall())
    assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in entry.queries()["op1_exact_dedup"](spark, d).collect()) == want
