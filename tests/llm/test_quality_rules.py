"""Counts against the definitions, estimates against plain numpy, and accuracy against the labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctpulse.llm import quality as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, v int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "é ß\n\né ß\n x\x1fy", "## a|b <c>\n" * 40, "w\x0b" * 70, "x " * 200_000]


def random_text(rng, n):
    return "".join(rng.choice(["ab", "cd ", "é", " ", "\n", "#", "1", "Z. ", "\r", "ef gh ij\n"]) for _ in range(n))


def test_counts_follow_the_definitions(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *(random_text(rng, rng.randrange(300)) for _ in range(150))]
    docs = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), "x", 1, "y") for i, t in enumerate(texts)]
    docs += [docs[5], (None, *docs[6][1:])]
    rows = Q.quality(spark.createDataFrame(docs, SCHEMA).repartition(3), prior_rows=5).collect()
    got = sorted([(r.doc_id, *(r[c] for c in Q.COUNTS), r.base_failed) for r in rows], key=repr)
    assert got == sorted([(d[0], *brute(d[1])) for d in docs], key=repr)
    assert not any(r.kept and r.base_failed for r in rows)
    assert Q.keep_sound(spark.createDataFrame(docs, SCHEMA), prior_rows=5).count() == sum(r.kept for r in rows)


def test_chi_square():
    assert Q.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert Q.chi2_quantile(0.975, 7) == pytest.approx(16.012764, abs=1e-5)
    assert Q.chi2_below(5.0, 2) == pytest.approx(1 - np.exp(-2.5))


def test_estimate_withstands_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(1)
    mix = np.tril(rng.normal(size=(7, 7))) * 0.3 + np.eye(7) * 0.5
    bulk = rng.normal(size=(4000, 7)) @ mix.T + 2
    far = rng.normal(size=(1000, 7)) * 0.1 + 30
    rows = [("en", "a", x.tolist()) for x in np.concatenate([bulk, far])] + [("en", "few", x.tolist()) for x in bulk[:20]]
    rows = [(*r, [1e-6] * 7) for r in rows]
    found = Q.estimates(spark.createDataFrame(rows, "lang string, source string, v array<double>, e array<double>").repartition(4)).collect()
    assert len(found) == 2
    for r in found:
        assert np.abs(np.array(r.centre) - 2).max() < 0.2
        assert np.abs(Q._square(np.array(r.cov)) - mix @ mix.T).max() < 0.25 * np.abs(mix @ mix.T).max()


def exact_distances(v, e, groups, part=Q.PART):
    """Plain numpy: concentration steps on sorted rows, two starts, reweighting, shrinkage over (source, language, all)."""
    p = v.shape[1]

    def fit(x, error):
        def moments(y, share):
            m = y.mean(axis=0)
            return m, (y - m).T @ (y - m) / len(y) * share / Q.chi2_below(Q.chi2_quantile(share, p), p + 2)

        def far(m, cov):
            return np.einsum("ij,ij->i", x - m, np.linalg.solve(cov + np.diag(error), (x - m).T).T)

        h, best = int(np.ceil(part * len(x))), None
        iqr = (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
        for m, cov in ((np.median(x, axis=0), np.diag(iqr**2)), (x.mean(axis=0), np.diag(x.var(axis=0)))):
            low = np.inf
            while True:
                m2, cov2 = moments(x[np.argsort(far(m, cov), kind="stable")[:h]], min(h / len(x), 1 - 1e-9))
                det = np.linalg.slogdet(cov2 + np.diag(error))[1]
                if not det < low - Q.SETTLED:
                    break
                low, m, cov = det, m2, cov2
            best = min(best or (np.inf,), (low, m, cov), key=lambda b: b[0])
        return moments(x[far(*best[1:]) <= Q.chi2_quantile(Q.REWEIGHT, p)], Q.REWEIGHT)

    levels = [("all",) * len(v), [g[0] for g in groups], groups]
    out = np.zeros(len(v))
    for g in set(groups):
        now = None
        for level in levels:
            own = [i for i, other in enumerate(level) if other == level[groups.index(g)]]
            est = fit(v[own], e[own].mean(axis=0))
            now = est if now is None else Q.shrunk(est, now, len(own))
        for i in (i for i, other in enumerate(groups) if other == g):
            moved = v[i] - now[0]
            out[i] = moved @ np.linalg.solve(now[1] + np.diag(e[i]), moved)
    return out


def test_verdicts_against_plain_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = Q.base_statistics(docs).filter("NOT base_failed")
    vectors = [F.array(*(F.expr(x).cast("double") for x in of.values())).alias(n) for n, of in (("v", Q.STATISTICS), ("e", Q.SAMPLING))]
    rows = counted.select("doc_id", "lang", "source", *vectors).collect()
    exact = exact_distances(np.array([r.v for r in rows]), np.array([r.e for r in rows]), [(r.lang, r.source) for r in rows])
    got = {r.doc_id: r.kept for r in Q.quality(docs).filter("NOT base_failed").collect()}
    limit = Q.chi2_quantile(1 - Q.REJECT, 7)
    clear = [(r.doc_id, d <= limit) for r, d in zip(rows, exact) if not 0.7 * limit < d < 1.4 * limit]
    assert len(clear) > 0.97 * len(rows) and {kept for _, kept in clear} == {True, False}
    assert all(got[i] == kept for i, kept in clear)


def plain_text(rng, n=400):
    """Unlike words in lines of ten, a capital at the start of each."""
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 10))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 10]).capitalize() + "." for i in range(0, n, 10))


def test_each_statistic_can_reject_by_itself(spark):
    rng = random.Random(4)
    bulk = [plain_text(rng) for _ in range(300)]
    lines = plain_text(rng, 400).split("\n")
    changed = {
        "word_length": " ".join("".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(400)),
        "symbols": plain_text(rng).replace(" ", " # ", 60),
        "upper": plain_text(rng).upper(),
        "digits": re.sub("[aeio]", "7", plain_text(rng)),
        "marks": plain_text(rng).replace(" ", ", ", 250),
        "dup_lines": "\n".join([lines[0]] * 9 + lines[9:]),  # within the base rule for repeated words
        "repeats": "\n".join([*lines[:30], " ".join(lines[:8])]),
    }
    texts = [*bulk, *changed.values()]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.quality(df).collect()}
    assert {n: got[len(bulk) + k] for k, n in enumerate(changed)} == {n: (False, False) for n in changed}
    assert sum(got[i] == (False, True) for i in range(len(bulk))) >= 299


def test_no_step_at_any_group_size(spark):
    """One more row changes a group's estimate by little, whatever its size."""
    a, b = (np.ones(7), np.eye(7)), (np.zeros(7), 4 * np.eye(7))
    for n in (1, 49, 50, 199, 200, 1000):
        (c0, s0), (c1, s1) = Q.shrunk(a, b, n), Q.shrunk(a, b, n + 1)
        assert np.abs(c1 - c0).max() < 0.03 and np.abs(s1 - s0).max() < 0.1


def test_accuracy_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.quality(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = rows.join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r.kept): r["count"] for r in found}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.quality(df).count() == 0 and Q.keep_sound(df).count() == 0
