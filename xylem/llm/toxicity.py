"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives; a sample of all text is unlabelled, toxic documents among it. With the class prior p, the risk of
a linear scorer is p R+(P) + max(0, R-(U) - p R-(P)): the unlabelled risk is corrected for the positives that it holds, and
never goes below nothing, which would mean overfitting. Features are the distinct words (runs of letters) of a text and their beginnings, kept by
full 64-bit hash, so that no unseen word shares a weight by chance. Training is numpy in one task on a bounded sample; the scorer is
a short table of weights, sparse by soft thresholding.
"""

from __future__ import annotations

import base64
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.sampling import bounded_sample
from xylem.llm.text import LOWER, flat, slices, span_hashes, word_bounds

#: Bounds of the training sample: confirmed toxic, confirmed clean (these only set the threshold) and unlabelled documents (drawn from all), the first by the hash of their ids.
MAX_POSITIVE, MAX_CLEAN, MAX_UNLABELLED = 3000, 3000, 5000
#: Beginnings of words, in bytes, that are features besides whole words; documents of the sample that a feature must occur in.
PREFIXES, LEAST_DOCS = (5, 6, 7, 9), 3
#: Standard errors by which a feature must be more common in positive than in unlabelled documents.
SURPRISE = 4.5
#: Parts of the confirmed documents, each scored by weights learned without it, that the threshold is set on.
FOLDS = 3
THRESHOLD = 0.7


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def word_features(column: pa.Array):
    """(hashes of the slice's distinct words: one row each, whole word then PREFIXES; document and word number of each distinct pair; documents)."""
    raw, offs = flat(column)
    raw = LOWER[raw]
    if len(raw):  # capitals of Latin-1: the second byte after 0xC3
        raw[1:] += np.uint8(32) * ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))
    starts, ends, first = word_bounds(np.where(_LETTER[raw], raw, np.uint8(32)), offs)
    docs = len(offs) - 1
    codes, keys = pd.factorize(span_hashes(raw, starts, ends))
    where = np.zeros(len(keys), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    a, b = starts[where], ends[where]
    hashes = [keys.astype(np.uint64)]
    for k in PREFIXES:
        h = span_hashes(raw, a, np.minimum(a + k, b)) ^ np.uint64(k)
        hashes.append(np.where(b - a > k, h, np.uint64(0)))
    doc = np.repeat(np.arange(docs), np.diff(first))
    pairs = np.asarray(pd.unique(doc * max(len(keys), 1) + codes))
    return np.stack(hashes), pairs // max(len(keys), 1), pairs % max(len(keys), 1), docs


def _sample_features(batches):
    """(role, drawn, sorted distinct feature hashes) of each document."""
    for batch in batches:
        for s in slices(batch):
            h, doc, word, docs = word_features(s.column("text"))
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(docs + 1))
            out = []
            for d in range(docs):
                mine = h[:, word[order[cuts[d] : cuts[d + 1]]]].ravel()
                out.append(np.ascontiguousarray(mine[mine != 0]).tobytes())
            yield pa.record_batch([s.column("role"), s.column("drawn"), pa.array(out, pa.binary())], names=["role", "drawn", "features"])


def learn(roles: np.ndarray, rows: list[np.ndarray], prior: float, unlabelled: np.ndarray, rounds: int = 200, rate: float = 0.05, l1: float = 2e-5) -> dict:
    """Weights by the non-negative risk from positives (role 1) and the rows flagged ``unlabelled``; a row can be both."""
    positive = roles == 1
    nothing = {"keys": np.zeros(0, np.uint64), "w": np.zeros(0), "b": -3.0}
    if not positive.any() or not unlabelled.any():
        return nothing
    # screening: features that occur in surely more of the positive documents than of the unlabelled
    count = lambda which: np.unique(np.concatenate([np.unique(rows[i]) for i in np.flatnonzero(which)]), return_counts=True)
    keys, n_pos = count(positive)
    other, n_un = count(unlabelled)
    at = np.minimum(np.searchsorted(other, keys), max(len(other) - 1, 0))
    n_un = np.where(other[at] == keys, n_un[at], 0) if len(other) else np.zeros(len(keys))
    n1, n2 = positive.sum(), unlabelled.sum()
    rate_all = (n_pos + n_un + 0.5) / (n1 + n2 + 1)
    surprise = (n_pos / n1 - n_un / n2) / np.sqrt(rate_all * (1 - rate_all) * (1 / n1 + 1 / n2))
    keys = keys[(n_pos >= LEAST_DOCS) & (surprise >= SURPRISE)]
    doc, at = _known(keys, rows)
    w, b = np.zeros(len(keys)), -1.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for k in range(1, rounds + 1):
        z = b + np.bincount(doc, w[at], len(rows))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        negative = loss_neg[unlabelled].mean() - prior * loss_neg[positive].mean()
        g = np.zeros(len(rows))
        if negative >= 0:
            g[positive] = -prior / positive.sum()  # of p R+ - p R-: the sigmoids cancel
            g[unlabelled] += s[unlabelled] / unlabelled.sum()
        else:  # step back where the corrected risk is negative
            g[positive] = prior * s[positive] / positive.sum()
            g[unlabelled] -= s[unlabelled] / unlabelled.sum()
        grad = np.r_[np.bincount(at, g[doc], len(keys)), g.sum()]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate / (np.sqrt(v[:-1] / (1 - 0.999**k)) + 1e-6), 0)
        b -= step[-1]
    keep = w != 0
    return {"keys": keys[keep], "w": w[keep], "b": float(b)}


def _known(keys: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place in ``keys`` of each feature of the rows that is there."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat_ = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    if not len(keys):
        return doc[:0], np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, flat_), len(keys) - 1)
    ok = keys[at] == flat_
    return doc[ok], at[ok]


def train(roles: np.ndarray, rows: list[np.ndarray], prior: float, drawn: np.ndarray | None = None) -> dict:
    """``roles``: 1 positive, 0 clean, -1 unlabelled; ``rows``: feature hashes, counted as often as they occur; ``prior``: the share of toxic text.

    ``drawn`` flags the unlabelled set, which stands for all text: labels do not take a document out of it. Without it, the set is role -1.
    The score 0.7 is put where confirmed documents are told apart best by weights that were learned without them, in FOLDS parts.
    """
    unlabelled = roles == -1 if drawn is None else drawn
    model = learn(roles, rows, prior, unlabelled)
    known = np.flatnonzero(roles >= 0)
    if not len(model["w"]) or not (roles == 0).any():
        return model
    z = np.zeros(len(rows))
    for part in range(FOLDS):
        mine = known[np.arange(len(known)) % FOLDS == part]
        rest = np.setdiff1d(np.arange(len(rows)), mine)
        without = learn(roles[rest], [rows[i] for i in rest], prior, unlabelled[rest])
        doc, at = _known(without["keys"], [rows[i] for i in mine])
        z[mine] = without["b"] + np.bincount(doc, without["w"][at], len(mine))
    positive = roles == 1
    weigh = np.where(positive, prior / positive.sum(), (1 - prior) / (roles == 0).sum())
    order = known[np.argsort(-z[known], kind="stable")]
    tp, fp = np.cumsum(weigh[order] * positive[order]), np.cumsum(weigh[order] * ~positive[order])
    f1 = np.where(np.r_[z[order[1:]] < z[order[:-1]], False], 2 * tp / (tp + fp + prior), 0.0)  # a cut lies between different scores
    best = int(f1.argmax())
    cut = (z[order[best]] + z[order[best + 1]]) / 2 if f1[best] > 0 else z[order[0]] + 1
    return model | {"b": model["b"] + float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)}


def _fit(prior: float):
    def run(frames):
        held = [(r, d, np.frombuffer(x, np.uint64)) for f in frames for r, d, x in zip(f["role"], f["drawn"], f["features"])]
        model = train(np.array([r for r, _, _ in held]), [x for _, _, x in held], prior, drawn=np.array([d for _, d, _ in held], bool))
        out = io.BytesIO()
        np.savez(out, **model)
        yield pd.DataFrame({"model": [base64.b64encode(out.getvalue()).decode()]})

    return run


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The scorer, from labels (doc_id, toxic) that are not held out. Only its weights come to the driver."""
    pick = lambda df, n: bounded_sample(df.select("doc_id"), n, "doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    prior = min(max(share if share is not None else 0.1, 0.01), 0.5)
    positive, clean = known.where("toxic = 1"), known.where("toxic = 0")
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    role = lambda df, n, r: pick(df, n).select("doc_id", F.lit(r).alias("role"), F.lit(r == -1).alias("drawn"))
    # the unlabelled set is drawn from all documents, so that the prior's share of it is toxic; those of them that are also confirmed have both parts
    roles = role(positive, MAX_POSITIVE, 1).union(role(clean, MAX_CLEAN, 0)).union(role(others, MAX_UNLABELLED, -1))
    # at most MAX_POSITIVE + MAX_CLEAN + MAX_UNLABELLED ids of 8 bytes: this side may always be broadcast
    roles = roles.groupBy("doc_id").agg(F.max("role").alias("role"), F.max("drawn").alias("drawn")).withColumnRenamed("doc_id", "of")
    sample = docs.join(F.broadcast(roles), F.col("doc_id") == F.col("of"))
    # one text of each id, however many rows repeat it
    sample = sample.groupBy("of").agg(F.min_by(F.struct("role", "drawn", "text"), F.xxhash64("text")).alias("one")).select("one.*")
    rows = sample.mapInArrow(_sample_features, "role int, drawn boolean, features binary").repartition(1).mapInPandas(_fit(prior), "model string").first()
    with np.load(io.BytesIO(base64.b64decode(rows["model"]))) as z:
        return {k: z[k] for k in z.files}


def scores(column: pa.Array, model: dict) -> np.ndarray:
    """Score of each text."""
    h, doc, word, docs = word_features(column)
    keys, w = model["keys"], model["w"]
    total = np.zeros(h.shape[1])
    if len(keys):
        for row in h:
            at = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
            total += np.where(keys[at] == row, w[at], 0.0)
    z = float(model["b"]) + np.bincount(doc, total[word], docs)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _score(model: dict):
    def run(batches):
        for batch in batches:
            for s in slices(batch):
                yield pa.record_batch([s.column("doc_id"), pa.array(scores(s.column("text"), model))], names=["doc_id", "score"])

    return run


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    Null text is empty and scores as a text without features. A null doc_id is not held out and never learned from. Without
    toxic labels every score is low. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    out = docs.mapInArrow(_score(fit(docs, labels)), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
