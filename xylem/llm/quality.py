"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Each document's counts become a vector of transformed statistics. For each (lang, source) the minimum covariance determinant
(MCD) is sought from several starting subsets at once by concentration steps: distances to the present centre and scatter, the H share of
nearest documents, their mean and covariance, again, until no determinant changes; the start with the least determinant is the
estimate. A step is two aggregations over all documents (a mergeable quantile of distances, sums of products), so no
group is ever gathered; only its moments are. A document is rejected when its Mahalanobis distance under the final, consistent and
reweighted estimate passes a chi-square limit.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.text import flat, shingle_hashes, slices, span_hashes, word_bounds
from xylem.session import Workspace

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the vector, and the least standard deviation that each is granted: where most documents agree (no symbols, no
#: repeats), the scatter would be singular and any deviation infinitely far. In units of these, no direction has a variance below one.
#: That of symbols is about one in a text of 150 words.
STATS = {"log_words": 0.5, "word_length": 0.5, "symbols": 0.08, "dup_lines": 0.1, "repeats": 0.08}
#: Share of documents in the MCD subset; most concentration steps; change of a log-determinant below which a group is settled.
H, STEPS, SETTLED = 0.75, 12, 0.01
#: Documents that the mean over all groups, and the mean scatter within groups, count as in each group's: its own moments prevail as it grows
#: past these.
SHRINK = 25
#: A document this unlikely (chi-square tail) is an outlier.
TAIL = 1e-9

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text of a string column."""
    raw, offs = flat(column)
    starts, ends, first = word_bounds(raw, offs)
    docs = len(offs) - 1
    if not len(raw):
        return {c: np.zeros(docs, np.int64) for c in COUNTS}
    space = np.ones(len(raw), bool)
    if len(starts):
        edge = np.zeros(len(raw) + 1, np.int8)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        space = np.cumsum(edge[:-1]) == 0
    upto = lambda flags: np.r_[0, np.cumsum(flags)][offs]
    chars = np.diff(upto(~space & ((raw & 0xC0) != 0x80)))
    symbols = np.diff(upto(_SYMBOL[raw]))
    # lines
    begin = np.unique(np.r_[offs[:-1], np.flatnonzero(raw == 10) + 1])
    begin = begin[begin < len(raw)]
    stop = np.r_[begin[1:], len(raw)]
    doc = np.searchsorted(offs, begin, "right") - 1
    stop -= raw[stop - 1] == 10
    has = np.r_[0, np.cumsum(~space)]
    full = has[stop] > has[begin]
    begin, stop, doc = begin[full], stop[full], doc[full]
    dup = np.bincount(doc[_repeated(doc, span_hashes(raw, begin, stop), docs)[1]], minlength=docs) if len(begin) else np.zeros(docs, np.int64)
    # windows of three words
    words = np.diff(first)
    repeat = np.zeros(docs, np.int64)
    h, at = shingle_hashes(span_hashes(raw, starts, ends), first, 3)
    if len(h):
        doc = np.repeat(np.arange(docs), np.diff(at))
        window = np.flatnonzero(_repeated(doc, h, docs)[0] & (words[doc] >= 3))
        covered = np.zeros(len(starts) + 1, bool)
        place = first[doc[window]] + window - at[doc[window]]
        for j in range(3):
            covered[place + j] = True
        repeat = np.diff(np.r_[0, np.cumsum(covered[:-1])][first])
    return dict(zip(COUNTS, (words, chars, symbols, dup, repeat)))


def _repeated(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags: items that occur twice or more in their document, and those equal to an earlier one there."""
    bits = np.uint64(max(docs - 1, 1).bit_length())
    codes, keys = pd.factorize((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    first = np.full(len(keys), len(codes))
    np.minimum.at(first, codes, np.arange(len(codes)))
    return np.bincount(codes)[codes] > 1, first[codes] < np.arange(len(codes))


def _count(batches):
    for batch in batches:
        for s in slices(batch):
            c = counts(s.column("text"))
            rest = [x for x in s.schema.names if x != "text"]
            yield pa.record_batch([*[s.column(x) for x in rest], *[pa.array(c[x].astype(np.int64)) for x in COUNTS]], names=[*rest, *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, COUNTS, base_failed) per row of ``docs``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", "lang", "source").schema)
    out = docs.select("doc_id", "lang", "source", "text").mapInArrow(_count, f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_stats(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    stats = {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "dup_lines": F.col("n_dup_lines") / (F.col("n_dup_lines") + words / 10),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return df.withColumns({f"x{i}": stats[s] for i, s in enumerate(STATS)})


P = len(STATS)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_cdf(x: float, p: int) -> float:
    """Regularised lower gamma function by its series."""
    if x <= 0:
        return 0.0
    a, x = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * exp(-x + a * log(x) - lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def consistency(share: float, p: int) -> float:
    """By what the covariance of the nearest ``share`` of normal vectors is too small."""
    return chi2_cdf(chi2_quantile(share, p), p + 2) / share


_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}_{j}" for i, j in _PAIRS]]


def mean_and_scatter(sums: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of _SUMS; with ``within``, products are of deviations already."""
    n = np.maximum(sums[:, 0], 1)
    mean = sums[:, 1 : 1 + P] / n[:, None]
    cov = np.zeros((len(sums), P, P))
    for k, (i, j) in enumerate(_PAIRS):
        cov[:, i, j] = cov[:, j, i] = sums[:, 1 + P + k] / n - (0 if within else mean[:, i] * mean[:, j])
    return mean, cov


def floored(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and log-determinant of scatters with at least the variances of STATS in every direction."""
    unit = np.outer(list(STATS.values()), list(STATS.values()))
    w, v = np.linalg.eigh(cov / unit)
    w = np.maximum(w, 1.0)
    return np.einsum("gik,gk,gjk->gij", v, 1 / w, v) / unit, np.log(w).sum(1)


def _estimate(scale: float, every: dict[int, list[float]]):
    """Moments of each group and start to centre ``m*``, inverse scatter ``w*`` (its upper triangle) and ``logdet``; ``every`` has each start's _SUMS over all groups, products within them."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            sums = f[_SUMS].to_numpy(float)
            mean, cov = mean_and_scatter(sums)
            all_mean, all_cov = mean_and_scatter(np.array([every[k] for k in f["start"]], float), within=True)
            own = sums[:, 0] / (sums[:, 0] + SHRINK)
            mean = own[:, None] * mean + (1 - own)[:, None] * all_mean
            cov = own[:, None, None] * cov + (1 - own)[:, None, None] * all_cov
            inv, logdet = floored(cov / scale)
            out = f[["start", "g_lang", "g_source"]].copy()
            for i in range(P):
                out[f"m{i}"] = mean[:, i]
            for i, j in _PAIRS:
                out[f"w{i}_{j}"] = inv[:, i, j] * (1 if i == j else 2)
            out["logdet"] = logdet
            yield out

    return run


_ESTIMATE = ", ".join(["start int", "g_lang string", "g_source string", *[f"m{i} double" for i in range(P)], *[f"w{i}_{j} double" for i, j in _PAIRS], "logdet double"])


def _moments(rows: DataFrame, inside) -> DataFrame:
    """_SUMS over each group's and start's documents that are ``inside``."""
    take = lambda c: F.coalesce(F.sum(F.when(inside, c)), F.lit(0.0))
    return rows.groupBy("start", F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(
        F.count(F.when(inside, 1)).cast("double").alias("n"), *[take(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)], *[take(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _PAIRS]
    )


def _with(rows: DataFrame, of_groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what ``of_groups`` (g_lang, g_source, ...) says of their group; a saved table, so that a large group's rows can be split."""
    return rows.join(of_groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), how).drop("g_lang", "g_source")


def _located(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance to their group's centre, for each of its starts."""
    diff = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    d2 = sum((F.col(f"w{i}_{j}") * diff[i] * diff[j] for i, j in _PAIRS), F.lit(0.0))
    return _with(rows, estimate, how).withColumn("d2", d2)


def estimates(fit: DataFrame, work: Workspace) -> DataFrame:
    """The reweighted MCD estimate of each group of ``fit`` (lang, source, x*)."""

    def estimate(moments: DataFrame, scale: float, name: str) -> DataFrame:
        moments = work.save(moments, f"moments-{name}")
        within = {f"q{i}_{j}": F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.greatest("n", F.lit(1.0)) for i, j in _PAIRS}
        # one row per start
        every = {r["start"]: [r[c] for c in _SUMS] for r in moments.groupBy("start").agg(*[F.sum(within.get(c, F.col(c))).alias(c) for c in _SUMS]).collect()}
        return work.save(moments.mapInPandas(_estimate(scale, every), _ESTIMATE), f"estimate-{name}")

    groups = [F.col("lang").alias("g_lang"), F.col("source").alias("g_source")]
    middle = work.save(fit.groupBy(*groups).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 2000).alias(f"c{i}") for i in range(P)]), "middle")
    z = [(F.col(f"x{i}") - F.col(f"c{i}")[1]) / F.greatest((F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349, F.lit(float(s))) for i, s in enumerate(STATS.values())]
    # starts: near the medians as an ellipsoid, as a box and by the sum of deviations; all documents; a half by hash
    subsets = [
        sum((x * x for x in z), F.lit(0.0)) <= chi2_quantile(H, P), F.greatest(*[F.abs(x) for x in z]) <= 1.5, sum((F.abs(x) for x in z), F.lit(0.0)) <= P * 0.8,
        F.lit(True), F.xxhash64(*[f"x{i}" for i in range(P)]) % 2 == 0,
    ]
    rows = _with(fit, middle).withColumn("in", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), c.alias("inside")) for k, c in enumerate(subsets)]))).select("lang", "source", *[f"x{i}" for i in range(P)], "in.*")
    present, change = estimate(_moments(rows, F.col("inside")), consistency(H, P), "start"), None
    for k in range(STEPS):
        far = _located(fit, present)
        limit = work.save(far.groupBy(*groups, F.col("start").alias("s")).agg(F.percentile_approx("d2", H, 2000).alias("limit")), f"limit{k}")
        near = _with(far, limit).where(F.col("start") == F.col("s"))
        last, present = present, estimate(_moments(near, F.col("d2") <= F.col("limit")), consistency(H, P), str(k))
        was = last.select(F.col("start").alias("s"), F.col("g_lang").alias("l"), F.col("g_source").alias("t"), F.col("logdet").alias("was"))
        both = present.join(was, (F.col("start") == F.col("s")) & F.col("g_lang").eqNullSafe(F.col("l")) & F.col("g_source").eqNullSafe(F.col("t")))
        change = both.agg(F.max(F.abs(F.col("logdet") - F.col("was"))).alias("c")).first()["c"]
        if change is None or change < SETTLED:
            break
    best = present.groupBy("g_lang", "g_source").agg(F.min_by(F.struct(*[c for c in present.columns if not c.startswith("g_")]), F.struct("logdet", "start")).alias("b"))
    best = work.save(best.select("g_lang", "g_source", "b.*"), "best")
    # reweighted: all documents within the 97.5 % limit
    inside = _moments(_located(fit, best).withColumn("start", F.lit(0)), F.col("d2") <= chi2_quantile(0.975, P))
    return estimate(inside, consistency(0.975, P), "final")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, distance) per row of ``docs`` (doc_id, text, lang, source).

    Documents that fail the base limits are rejected and take no part in the estimates. Null text has no words. Null lang and source are
    groups like others. Each group's estimate is drawn towards that over all groups with the weight of SHRINK documents, at every
    size. Repeated rows count each. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "quality")
    rows = with_stats(work.save(document_counts(docs), "counts"))
    final = estimates(rows.where("NOT base_failed").select("lang", "source", *[f"x{i}" for i in range(P)]), work)
    out = _located(rows, final, "left")
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_quantile(1 - TAIL, P))
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), F.coalesce("d2", F.lit(0.0)).alias("distance2"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all columns of ``docs``."""
    named = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("lang", "source").alias("g")).alias("key"))
    good = judged(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("lang", "source").alias("g")).alias("doc_id"), "text", "lang", "source")).where("kept")
    good = good.select(F.col("doc_id.doc_id").alias("d"), F.col("doc_id.h").alias("h"), F.col("doc_id.g").alias("g")).distinct()
    return named.join(good, F.col("key.doc_id").eqNullSafe(F.col("d")) & (F.col("key.h") == F.col("h")) & (F.col("key.g") == F.col("g")), "left_semi").select("row.*")
