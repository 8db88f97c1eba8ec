"""Secret scans: plain patterns, and a linear-chain conditional random field (CRF) over the tokens of each text.

Tokens are tagged begin, inside or outside of a secret from their shape, the words and signs beside them and features of the whole file.
The field is trained here, on a bounded sample of documents whose pattern matches are the labels, with made-up secrets put into some of
them, so that it also learns forms that the patterns miss. Decoding is exact Viterbi: a token whose inside and begin scores are below
outside by more than any change of transitions can make up is outside on every best path, so only the runs between such tokens
need the recursion.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.sampling import bounded_sample
from xylem.llm.text import LOWER, flat, slices, span_hashes

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("pass", "secret", "token", "api")
#: Documents that the field is trained on at most, chosen by the hash of their ids; of them, those that get a made-up secret.
TRAIN_DOCS, PLANTED_SHARE = 1500, 0.3
#: Chunks of their tokens that it is trained on at most, with secrets and without, chosen by hash from the whole texts.
TRAIN_CHUNKS, TRAIN_PLAIN = 1500, 2500
SEED = 5
#: Words that name secrets, for the feature of neighbouring words (fixed values).
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "access_key", "auth", "credential", "private_key", "client_secret", "bearer")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in code points, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def values(text: str) -> list[tuple[int, int]]:
    """Spans of the secret values within the pattern matches, as training labels."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [m.span() for m in HEX.finditer(text)]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# byte classes: 0 space, 1 lower, 2 upper, 3 digit, 4 inside a token (+ / _ - .), 5 other ASCII sign, 6 part of a longer character
_KIND = np.full(256, 5, np.uint8)
_KIND[128:] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[43, 45, 46, 47, 95]] = 4
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True
FEATURES = (
    "bias sign has_digit digits_many long8 long16 long24 long32 long40 hex upper_digit mixed_case mixed_digit_runs only_letters non_ascii dotted "
    "after_equals after_quote after_name near_name before_quote after_long begins_akia digit_file sign_file short_file"
).split()


def tokens(raw: np.ndarray, offs: np.ndarray):
    """Start and end of each token (a run of token bytes, or of other signs), and each document's first token."""
    kind = _KIND[raw]
    group = np.array([0, 1, 1, 1, 1, 2, 1], np.uint8)[kind]
    cut = np.ones(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = group[1:] != group[:-1]
    cut[offs] = True
    edges = np.flatnonzero(cut)
    full = group[edges[:-1]] != 0
    starts, ends = edges[:-1][full], edges[1:][full]
    return starts, ends, np.searchsorted(starts, offs), kind


def features(raw: np.ndarray, offs: np.ndarray):
    """A 0/1 matrix (tokens x FEATURES) with the tokens' bounds and each document's first token."""
    starts, ends, first, kind = tokens(raw, offs)
    n, length = len(starts), ends - starts
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))

    def count(flags):
        c = np.r_[0, np.cumsum(flags, dtype=np.int32)]
        return c[ends] - c[starts], c

    lower, _ = count(kind == 1)
    upper, _ = count(kind == 2)
    digit, digits = count(kind == 3)
    sign, signs = count(kind == 5)
    wide, _ = count(kind == 6)
    hexes, _ = count(_HEX[raw])
    dots, _ = count(raw == 46)
    flips, _ = count(np.r_[False, (kind[1:] == 3) != (kind[:-1] == 3)] if len(raw) else np.zeros(0, bool))
    is_sign = sign > 0
    equals, _ = count((raw == 61) | (raw == 58))
    quotes, _ = count((raw == 34) | (raw == 39))
    names = np.isin(span_hashes(LOWER[raw], starts, ends), _name_hashes())
    size = np.diff(offs)[doc] + 1
    word = ~is_sign

    def back(x, k):
        """x of the token k before, in the same document."""
        out = np.zeros(n, bool)
        if n > k:
            out[k:] = x[:-k] & (doc[k:] == doc[:-k])
        return out

    ahead = np.zeros(n, bool)
    if n > 1:
        ahead[:-1] = (quotes[1:] > 0) & (doc[1:] == doc[:-1])
    eq = equals > 0
    after_equals = back(eq & is_sign, 1) | back(eq & is_sign, 2) & back(is_sign, 1)
    columns = {
        "bias": np.ones(n, bool), "sign": is_sign, "has_digit": word & (digit > 0), "digits_many": word & (digit * 4 > length), "long8": word & (length >= 8), "long16": word & (length >= 16),
        "long24": word & (length >= 24), "long32": word & (length >= 32), "long40": word & (length >= 40), "hex": (hexes == length) & (digit > 0), "upper_digit": (upper + digit == length) & (digit > 0) & (upper > 0),
        "mixed_case": (upper > 1) & (lower > 0), "mixed_digit_runs": flips > 4, "only_letters": lower + upper + wide == length, "non_ascii": wide > 0, "dotted": dots > 0,
        "after_equals": word & after_equals, "after_quote": word & back((quotes > 0) & is_sign, 1), "after_name": word & (back(names, 2) | back(names, 3) & back(is_sign, 1)), "near_name": word & (back(names, 1) | back(names, 4) | back(names, 5)),
        "before_quote": word & ahead, "after_long": back(word & (length >= 16) & (digit > 0), 1), "begins_akia": _begins(raw, starts, length, b"AKIA"),
        "digit_file": (np.diff(digits[offs])[doc] * 20 > size), "sign_file": (np.diff(signs[offs])[doc] * 8 > size), "short_file": size < 600,
    }
    return columns, starts, ends, first


def _begins(raw, starts, length, what: bytes):
    ok = length >= len(what)
    for j, b in enumerate(what):
        ok = ok & (raw[np.minimum(starts + j, len(raw) - 1)] == b) if len(raw) else ok
    return ok


def _name_hashes():
    global _NAMES
    if _NAMES is None:
        raw, offs = flat(pa.array(NAMES))
        _NAMES = span_hashes(raw, offs[:-1], offs[1:])
    return _NAMES


_NAMES = None


# ---- training


def _logsum(x, axis):
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


def train(x: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> dict:
    """Maximum-likelihood weights by forward-backward and Adam: x (chunks, T, features), y tags 0 outside, 1 begin, 2 inside."""
    n, T, f = x.shape
    w, a = np.zeros((f, 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    gold = np.eye(3)[y] * mask[..., None]
    pair = np.zeros((3, 3))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1)
    for k in range(1, rounds + 1):
        e = x @ w
        alpha, beta = np.empty((T, n, 3)), np.zeros((T, n, 3))
        alpha[0] = e[:, 0]
        for t in range(1, T):
            step = e[:, t] + _logsum(alpha[t - 1][:, :, None] + a, 1)
            alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
        for t in range(T - 2, -1, -1):
            step = _logsum(a[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1, None], step, 0.0)
        z = _logsum(alpha[-1], 1)
        p = np.exp(np.clip(alpha + beta - z[None, :, None], -60, 0)).transpose(1, 0, 2) * mask[..., None]
        gw = np.einsum("ntf,ntk->fk", x, p - gold) / n + decay * w
        ga = -pair / n + decay * a
        for t in range(T - 1):
            m = alpha[t][:, :, None] + a[None] + (e[:, t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]
            ga += (np.exp(np.clip(m, -60, 0)) * both[:, t, None, None]).sum(0) / n
        for v, g, i in ((w, gw, 0), (a, ga, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            v -= rate * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.99**k)) + 1e-8)
    return {"w": w.tolist(), "a": a.tolist()}


def planted(text: str, rng: random.Random) -> tuple[str, tuple[int, int]]:
    """The text with a made-up secret after some word, and where its value lies."""
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    signs = rng.choice(kinds)
    value = "".join(rng.choice(signs) for _ in range(rng.choice((20, 24, 32, 40, 44))))
    quote = rng.choice(("", '"', "'"))
    lead = rng.choice(NAMES) + quote * rng.randrange(2) + rng.choice(("=", ": ", " = ", ":", " ")) + quote
    cuts = [m.start() for m in re.finditer(r" ", text)] or [len(text)]
    at = rng.choice(cuts)
    head = text[:at] + " " + lead
    return head + value + quote + text[at:], (len(head), len(head) + len(value))


def _chunk_hashes(text: str, n: int) -> np.ndarray:
    """Hashes of a text's ``n`` chunks."""
    start = np.frombuffer(hashlib.blake2b(text.encode(), digest_size=8).digest(), np.uint64)
    z = start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def examples(texts, T: int = 48, plain_per_secret: int = 6, most: int = TRAIN_CHUNKS, most_plain: int = TRAIN_PLAIN):
    """Chunks of T tokens as (x, y, mask): of those with secrets and those without, the ``most`` and ``most_plain`` with the smallest hashes."""
    rng = random.Random(SEED)
    with_, without, n_with, number = [], [], 0, 0
    for text in texts:
        if not text:
            continue
        hashed, spans = text, values(text)
        if rng.random() < PLANTED_SHARE:
            text, span = planted(text, rng)
            spans = [*values(text), span]
        column = pa.array([text])
        raw, offs = flat(column)
        columns, starts, ends, _ = features(raw, offs)
        if not len(starts):
            continue
        at = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # where each character begins
        y = np.zeros(len(starts), np.int64)
        for a, b in sorted(spans, key=lambda s: s[1] - s[0]):
            i, j = np.searchsorted(ends, at[a], "right"), np.searchsorted(starts, at[b], "left")
            if i < j:
                y[i:j] = 2
                y[i] = 1
        cuts = np.arange(0, len(y), T)
        secret = np.logical_or.reduceat(y > 0, cuts)
        n_with += int(secret.sum())
        hashes = _chunk_hashes(hashed, len(cuts)).tolist()
        for k, h in enumerate(hashes):
            pool, bound = (with_, most) if secret[k] else (without, most_plain)
            if len(pool) < bound or pool and h < -pool[0][0]:
                part = slice(cuts[k], cuts[k] + T)
                number += 1
                chunk = (-h, number, np.stack([columns[f][part] for f in FEATURES], 1), y[part].copy())
                (heapq.heappush if len(pool) < bound else heapq.heapreplace)(pool, chunk)
    with_, without = ([c[2:] for c in sorted(pool, key=lambda c: (-c[0], c[1]))] for pool in (with_, without))
    chunks = with_ + without[: max(200, plain_per_secret * n_with)]
    x, y, mask = np.zeros((len(chunks), T, len(FEATURES))), np.zeros((len(chunks), T), np.int64), np.zeros((len(chunks), T), bool)
    for i, (cx, cy) in enumerate(chunks):
        x[i, : len(cy)], y[i, : len(cy)], mask[i, : len(cy)] = cx, cy, True
    return x, y, mask


#: Tags everything as outside: what an empty sample teaches.
_NOTHING = {"w": [[5.0, -5.0, -5.0], *[[0.0] * 3] * (len(FEATURES) - 1)], "a": [[0.0] * 3] * 3}


def _fit(most: int, most_plain: int):
    def run(frames):
        x, y, mask = examples((t for f in frames for t in f["text"]), most=most, most_plain=most_plain)
        yield pd.DataFrame({"model": [json.dumps(train(x, y, mask) if len(x) else _NOTHING)]})

    return run


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, most: int = TRAIN_CHUNKS, most_plain: int = TRAIN_PLAIN) -> dict:
    """The field's weights, trained in one task on ``train_docs`` documents at most and, of their chunks, ``most`` with secrets and ``most_plain`` without; only weights come to the driver."""
    sample = bounded_sample(docs, train_docs, "doc_id", seed=SEED)
    return json.loads(sample.select("text").coalesce(1).mapInPandas(_fit(most, most_plain), "model string").first()["model"])


# ---- decoding


def viterbi(e: list, a: list) -> list[int]:
    """Best tags of a run with scores ``e``, with outside tokens or an end on either side."""
    back, s = [], list(e[0])
    s = [s[j] + a[0][j] for j in range(3)]
    for row in e[1:]:
        step = [max(range(3), key=lambda i: s[i] + a[i][j]) for j in range(3)]
        back.append(step)
        s = [s[step[j]] + a[step[j]][j] + row[j] for j in range(3)]
    tag = max(range(3), key=lambda i: s[i] + a[i][0])
    out = [tag]
    for step in reversed(back):
        tag = step[tag]
        out.append(tag)
    return out[::-1]


def tagged(raw: np.ndarray, offs: np.ndarray, model: dict) -> list[tuple[int, int, int]]:
    """(document, start, end) in bytes of each span that the field tags."""
    w, a = np.array(model["w"]), model["a"]
    w = w - w[:, :1]
    columns, starts, ends, first = features(raw, offs)
    score = np.zeros((2, len(starts)), np.float32)
    for f, weights in zip(FEATURES, w):
        for k in (0, 1):
            score[k] += columns[f] * np.float32(weights[k + 1])
    least = max(a[p][t] + a[t][q] - a[p][0] - a[0][q] for p in range(3) for t in (1, 2) for q in range(3))
    unsure = np.flatnonzero(score.max(0) >= -least) if len(starts) else np.zeros(0, np.int64)
    if not len(unsure):
        return []
    doc = np.searchsorted(first, unsure, "right") - 1
    breaks = np.flatnonzero((np.diff(unsure) != 1) | (np.diff(doc) != 0)) + 1
    out = []
    for run in np.split(np.arange(len(unsure)), breaks):
        at = unsure[run]
        tags = viterbi([(0.0, float(x), float(y)) for x, y in score[:, at].T], a)
        start = None
        for i, tag in zip([*at, None], [*tags, 0]):
            if start is not None and tag != 2:
                out.append((int(doc[run[0]]), int(starts[start]), int(ends[last])))
                start = None
            if tag and start is None:
                start = i
            last = i
    return out


def outside(x: int, y: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of x to y that lie outside the ``base`` spans, which are in order of their starts."""
    out = []
    for a, _, b in base:
        if a < y and x < b:
            if x < a:
                out.append((x, a))
            x = b
    return [*out, (x, y)] if x < y else out


def _scan(model: dict):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            for s in slices(batch):
                raw, offs = flat(s.column("text"))
                more: dict[int, list] = {}
                for d, a, b in tagged(raw, offs, model):
                    more.setdefault(d, []).append((a - int(offs[d]), b - int(offs[d])))
                rows = []
                for d, text in enumerate(s.column("text").to_pylist()):
                    base = base_spans(text or "")
                    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                    spans = list(base)
                    if d in more:
                        data = text.encode()
                        for a, b in more[d]:
                            x = len(data[:a].decode("utf-8", "ignore"))
                            y = x + len(data[a:b].decode("utf-8", "ignore"))
                            spans += [(p, 3, q) for p, q in outside(x, y, base)]
                        spans.sort()
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.record_batch([s.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    return run


def scan(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs`` (doc_id, text).

    Null text is empty; a document without spans has an empty string. Of a span that the field
    tags, the parts outside the patterns' spans are added: what is added never overlaps a pattern's.
    Repeated rows are scanned each. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_scan(fit(docs, train_docs)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
