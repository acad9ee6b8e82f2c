"""Quality rules: robust multivariate outliers among text statistics.

Every text becomes a short vector of transformed statistics. Per language and source, a minimum-covariance-determinant
estimate gives the centre and spread of the bulk; a text whose Mahalanobis distance from it is too large is rejected.

The estimate is made by concentration steps over all documents: each step finds the part of a group that lies
nearest by the current estimate and estimates anew from it. A step is one aggregation: rows are binned by their
distance, sums and products are added up per group and bin, and the nearest bins that make up the wanted part are
combined. A group of any size is pre-aggregated where its rows lie and reduced to its bins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctpulse.llm.words import word_blocks
from acctpulse.session import staged

MIN_WORDS, WINDOW = 50, 3
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_digits", "n_marks", "n_lines"]
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)

#: The vector: mean word length (log), and square roots of shares, which evens out their sampling error.
STATISTICS = {
    "word_length": "ln(greatest(word_chars, 1) / greatest(n_words, 1))",
    "symbols": "sqrt(n_symbols / greatest(word_chars, 1))",
    "upper": "sqrt(n_upper / greatest(word_chars, 1))",
    "digits": "sqrt(n_digits / greatest(word_chars, 1))",
    "marks": "sqrt(n_marks / greatest(word_chars, 1))",
    "dup_lines": "sqrt(n_dup_lines / greatest(n_lines, 1))",
    "repeats": "sqrt(n_repeat_words / greatest(n_words, 1))",
}
#: Sampling variance of each statistic in a text of its length: the square root of a share of n units that come in clumps of c
#: varies by c / (4 n) even where the share is the same. Clumps: a number or key counts as one run of digits, a repeated window of
#: words as the words of both its copies.
CLUMPS = {"symbols": 2, "upper": 2, "digits": 16, "marks": 2, "dup_lines": 1, "repeats": 2 * WINDOW}
_UNITS = {"dup_lines": "n_lines", "repeats": "n_words"}
SAMPLING = {"word_length": "1 / (4 * greatest(n_words, 1))"} | {
    name: f"{clump} / (4 * greatest({_UNITS.get(name, 'word_chars')}, 1))" for name, clump in CLUMPS.items()
}
PART, REWEIGHT, REJECT = 0.75, 0.975, 1e-4
# Rows that the language's estimate counts for beside a group's own; steps end when the log determinant falls by less.
PRIOR_ROWS, SETTLED, MOST_STEPS = 50, 1e-3, 100
# Groups with a thousandth of all rows or more are spread over so many tasks each.
LARGE_GROUPS, SALTS = 1000, 64
_P = len(STATISTICS)
_BINS = 4


def text_counts(data: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` and ``MORE`` of a text in UTF-8."""
    data = data or b""
    seen = np.zeros(256, np.int64)
    for at in range(0, len(data), 1 << 20):
        seen += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - at), at), minlength=256)
    hashes = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in word_blocks(data)]
    words = np.concatenate(hashes)
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(data) - seen[128:192].sum() - seen[_SPACES].sum()
    upper, digits, symbols = seen[65:91].sum(), seen[48:58].sum(), seen[_SYMBOLS].sum()
    marks = seen[33:127].sum() - upper - digits - symbols - seen[97:123].sum()
    found = (len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), upper, digits, marks, len(lines))
    return tuple(int(x) for x in found)


def repeat_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, given a 64-bit hash per word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = words[:n].copy()
    for k in range(1, window):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed >> np.uint64(29)) ^ words[k : k + n]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(mixed, twice)
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= hit
    return int(covered.sum())


def base_statistics(docs: DataFrame) -> DataFrame:
    """Counts of every text, with ``lang``, ``source`` and a hash of the text to find its row again."""
    names = [*COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(t.as_py()) for t in batch.column(4)], np.int64).reshape(-1, len(names))
            arrays = [*batch.columns[:4], *(pa.array(counts[:, i]) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "source", "text_hash", *names])

    columns = [F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string")]
    rows = docs.select(*columns, F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("data"))
    kind = "doc_id bigint, lang string, source string, text_hash bigint, " + ", ".join(f"{c} bigint" for c in names)
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")
    return rows.mapInArrow(run, kind).withColumn("base_failed", failed)


def chi2_below(x: float, p: int) -> float:
    """Distribution function of chi-square with ``p`` degrees of freedom, by the series of the incomplete gamma."""
    if x <= 0:
        return 0.0
    a, x = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi2_below(high, p) < q and high < 1e4:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, p) < q else (low, middle)
    return high


_LOWER = np.tril_indices(_P)


def _whitener(cov: np.ndarray) -> list[float]:
    """Lower triangle of ``W`` with ``|W (x - centre)|`` the Mahalanobis distance."""
    return np.linalg.inv(np.linalg.cholesky(cov))[_LOWER].tolist()


def _square(lower: np.ndarray) -> np.ndarray:
    """Symmetric matrix of a lower triangle."""
    out = np.zeros((_P, _P))
    out[_LOWER] = lower
    return out + np.tril(out, -1).T


def concentrated(bins: pd.DataFrame, part: float | None = None, within: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of a group's nearest ``part`` of rows, or of those ``within`` a squared distance, from its bins."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy(float)
    inside = np.cumsum(n) - n < part * n.sum() if part else bins["bin"].to_numpy() <= math.floor(math.log(within) * _BINS)
    if not inside.any():
        inside[0] = True
    taken = n[inside].sum()
    sums = np.stack(bins["sums"].to_numpy())[inside].sum(axis=0)
    mean = sums[:_P] / taken
    cov = _square(sums[_P:] / taken) - np.outer(mean, mean)
    # Rounding may leave a spread of nothing slightly below nothing.
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    cov = (vectors * np.maximum(values, 0)) @ vectors.T
    # A normal bulk cut at a distance looks too narrow by a known factor.
    share = min(taken / n.sum(), 1 - 1e-9) if part else REWEIGHT
    return mean, cov * share / chi2_below(chi2_quantile(share, _P), _P + 2)


def _step(part: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One concentration step of a group and start; a step that no longer lowers the determinant is not taken and settles it."""

    def step(bins: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(now) or not len(bins):
            return now
        old = now.iloc[0]
        mean, cov = concentrated(bins, part=part)
        cov = cov + np.diag(old["error"])
        logdet = float(np.linalg.slogdet(cov)[1])
        settled = not logdet < old["logdet"] - SETTLED
        if settled:
            return now.assign(settled=True)
        return now.assign(centre=[mean.tolist()], whiten=[_whitener(cov)], logdet=[logdet])

    return step


def _reweighted(bins: pd.DataFrame) -> pd.DataFrame:
    mean, cov = concentrated(bins, within=chi2_quantile(REWEIGHT, _P))
    return pd.DataFrame({"key": [bins["key"].iloc[0]], "n": [int(bins["n"].sum())], "centre": [mean.tolist()], "cov": [cov[_LOWER].tolist()]})


def shrunk(own: tuple, prior: tuple, rows: float, prior_rows: float = PRIOR_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of a group that its language's count for as ``prior_rows`` further rows of."""
    (centre, cov), (other, spread) = own, prior
    w = rows / (rows + prior_rows)
    apart = centre - other
    return w * centre + (1 - w) * other, w * cov + (1 - w) * spread + w * (1 - w) * np.outer(apart, apart)


def _shrink(prior_rows: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                levels = [(np.array(e["centre"]), _square(np.array(e["cov"]))) for e in (row.e2, row.e1, row.e0)]
                now = levels[0]
                for level, e in zip(levels[1:], (row.e1, row.e0)):
                    now = shrunk(level, now, e["n"], prior_rows)
                out.append((row.key, now[0].tolist(), now[1][_LOWER].tolist()))
            yield pd.DataFrame(out, columns=["key", "centre", "cov"])

    return run


_STATE = "key string, n bigint, start int, error array<double>, centre array<double>, whiten array<double>, logdet double, settled boolean"
_ESTIMATE = "key string, n bigint, centre array<double>, cov array<double>"


def _distance2() -> F.Column:
    """Squared Mahalanobis distance of ``v`` by ``centre`` and ``whiten``."""
    moved = [F.col("v")[i] - F.col("centre")[i] for i in range(_P)]
    rows, at = [], 0
    for i in range(_P):
        y = sum((F.col("whiten")[at + j] * moved[j] for j in range(1, i + 1)), F.col("whiten")[at] * moved[0])
        rows.append(y * y)
        at += i + 1
    return sum(rows[1:], rows[0])


def _level(lang, source, level: int) -> F.Column:
    kept = [lang.alias("lang")] * (level < 2) + [source.alias("source")] * (level < 1)
    return F.to_json(F.struct(F.lit(level).alias("level"), *kept))


def _salted(keyed: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keyed`` with a salt that spreads the rows of large groups, and ``(key, salts)`` of those groups.

    A group is large from a thousandth of all rows on. A row is in three groups, so there are at most 3,000 of them, which
    bounds what is broadcast.
    """
    large = F.col("n") >= keyed.count() / (3 * LARGE_GROUPS)
    hot = staged(starts.filter("start = 0").filter(large).select("key", F.lit(SALTS).alias("salts")), "large")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("salts"))).cast("int")
    return keyed.join(F.broadcast(hot), "key", "left").withColumn("salt", salt).drop("salts"), hot


def _bins(keyed: DataFrame, hot: DataFrame, now: DataFrame, *by: str) -> DataFrame:
    """Counts, sums and products of every group's rows by their distance from its estimate, combined in the map tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    spread = now.select("key", *by, "centre", "whiten").join(F.broadcast(hot), "key", "left").select("key", *by, "centre", "whiten", salts)
    binned = keyed.join(spread, ["key", "salt"])
    binned = binned.withColumn("bin", F.floor(F.log(F.greatest(_distance2(), F.lit(1e-6))) * _BINS))
    return binned.groupBy("key", *by, "bin").agg(F.count("*").alias("n"), F.array(*map(F.sum, _products())).alias("sums"))


def _products() -> list[F.Column]:
    v = [F.col("v")[i] for i in range(_P)]
    return v + [v[i] * v[j] for i, j in zip(*(x.tolist() for x in _LOWER))]


def _starts(keyed: DataFrame) -> DataFrame:
    """Two starts per group: medians and quartile spreads, and the plain mean and covariance. ``error`` is the mean sampling variance."""
    quarters = [F.percentile_approx(F.col("v")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000) for i in range(_P)]
    errors = [F.avg(F.col("e")[i]) for i in range(_P)]
    summed = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.array(*quarters).alias("q"), F.array(*errors).alias("error"), F.array(*map(F.sum, _products())).alias("sums")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                q, error, sums = np.stack(row.q), np.array(row.error), np.array(row.sums) / row.n
                robust = np.square((q[:, 2] - q[:, 0]) / 1.349)
                plain = np.diag(_square(sums[_P:]) - np.outer(sums[:_P], sums[:_P]))
                for start, (centre, spread) in enumerate(((q[:, 1], robust), (sums[:_P], np.maximum(plain, 0)))):
                    out.append((row.key, row.n, start, error.tolist(), centre.tolist(), _whitener(np.diag(spread + error)), math.inf, False))
            yield pd.DataFrame(out, columns=["key", "n", "start", "error", "centre", "whiten", "logdet", "settled"])

    return summed.mapInPandas(run, _STATE)


def estimates(rows: DataFrame, part: float = PART, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """``key, centre, cov`` (lower triangle) for every language and source of ``rows`` (``lang, source, v, e``).

    ``v`` is a text's vector and ``e`` the sampling variances of its statistics. Concentration steps run from two starts until
    the determinant falls no more, and the smaller one is kept. A group's mean sampling variance is added to its covariance
    in the steps, so that a statistic that is the same in the bulk does not make it singular. Few rows say little about a
    spread in several dimensions: the language's estimate counts as ``prior_rows`` further rows of every source, and that of
    all rows as as many of every language.
    """
    keys = F.explode(F.array(*(_level(F.col("lang"), F.col("source"), k) for k in range(3)))).alias("key")
    keyed = rows.select("v", "e", keys)
    now = staged(_starts(keyed), "starts")
    keyed, hot = _salted(keyed, now)
    for _ in range(MOST_STEPS):
        moving = now.filter("NOT settled")
        if moving.isEmpty():
            break
        sums = _bins(keyed, hot, moving.withColumnRenamed("start", "of_start"), "of_start")
        paired = sums.groupBy("key", "of_start").cogroup(now.groupBy("key", "start"))
        now = staged(paired.applyInPandas(_step(part), _STATE), "estimates")
    else:
        raise RuntimeError(f"estimates did not settle within {MOST_STEPS} steps")
    best = now.groupBy("key").agg(F.min_by(F.struct("centre", "whiten"), F.struct("logdet", "start")).alias("b")).select("key", "b.*")
    found = staged(_bins(keyed, hot, best).groupBy("key").applyInPandas(_reweighted, _ESTIMATE), "reweighted")
    groups = rows.select("lang", "source").distinct()
    groups = groups.select(*(_level(F.col("lang"), F.col("source"), k).alias(f"k{k}") for k in range(3)))
    for k in range(3):
        groups = groups.join(found.select(F.col("key").alias(f"k{k}"), F.struct("n", "centre", "cov").alias(f"e{k}")), f"k{k}")
    named = groups.select(F.col("k0").alias("key"), "e0", "e1", "e2")
    return named.mapInPandas(_shrink(prior_rows), "key string, centre array<double>, cov array<double>")


def _judged(rows: DataFrame) -> DataFrame:
    """``distance2`` of every row from its group, by the group's covariance and its own sampling variances."""
    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("distance2", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = dict(zip(names, batch.columns))
            have = np.array(table["centre"].is_valid()) & ~np.array(table["base_failed"])
            found = np.full(batch.num_rows, np.nan)
            at = np.nonzero(have)[0]
            if len(at):
                take = pa.array(at)
                v, e, centre, lower = (np.stack(table[c].take(take).to_numpy(zero_copy_only=False)) for c in ("v", "e", "centre", "cov"))
                cov = np.zeros((len(at), _P, _P))
                cov[:, _LOWER[0], _LOWER[1]] = cov[:, _LOWER[1], _LOWER[0]] = lower
                cov[:, np.arange(_P), np.arange(_P)] += e
                moved = v - centre
                found[at] = np.einsum("ij,ij->i", moved, np.linalg.solve(cov, moved[:, :, None])[:, :, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=~have)], names=[*names, "distance2"])

    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, part: float = PART, reject: float = REJECT, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``distance2`` and ``text_hash`` for every row.

    Texts that fail the base rules (under 50 words, or over half of the words in repeated windows) are rejected and not
    part of the estimates. The others are kept if their squared distance is within the ``1 - reject`` quantile of
    chi-square; a text's own sampling variances, by its length, are part of the spread it may have. Null and empty texts have
    no words and fail. A null language or source is a group of its own. Repeated rows count and are returned each. No rows give
    no rows. Other columns are not read.
    """
    rows = staged(base_statistics(docs), "counts")
    vectors = [F.array(*(F.expr(x).cast("double") for x in of.values())).alias(n) for n, of in (("v", STATISTICS), ("e", SAMPLING))]
    passed = rows.filter("NOT base_failed").select("lang", "source", *vectors)
    found = staged(estimates(passed, part, prior_rows), "found")
    keyed = rows.select("doc_id", *COUNTS, "base_failed", "text_hash", _level(F.col("lang"), F.col("source"), 0).alias("key"), *vectors)
    judged = _judged(keyed.join(found, "key", "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(1 - reject, _P), F.lit(False))
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance2", "text_hash")


def keep_sound(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns, under any names.

    Rows are found again by id (null or not) and the text's hash, so repeated rows stay as often as they were. Null and empty
    texts are dropped. No rows give no rows.
    """
    sound = quality(docs, **options).filter("kept").select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    on = rows["k"].eqNullSafe(sound["k"]) & (rows["h"] == sound["h"])
    return rows.join(sound, on, "left_semi").select("row.*")
