"""Removal of long repeated byte strings, from positional suffix sorting of candidate passages.

Inserting one symbol of every document each round into one Burrows-Wheeler transform takes as many passes over the collection as its
longest document has bytes. So the columns are cut short first, without losing a repeat:

1. Winnowing. Each window of LENGTH bytes names its smallest K-gram hash (the leftmost on ties), its seed. Equal windows have equal seeds
   at equal places, so a window whose seed's hash occurs once repeats nowhere. A run of windows with one seed is a segment.
2. Segments with the same seed hash are aligned at the seed. Equal segments are counted by hash and go on as one; if there are two or
   more, all of their windows repeat.
3. Column-wise construction: each round one symbol of every aligned segment is inserted; the order of segments by reversed prefix (the
   positional Burrows-Wheeler transform) and the starts of common stretches with the neighbour are updated from the last round's.
   A window ending in this column repeats when its stretch with a neighbour is LENGTH or longer. Batches of whole seed
   groups pass through a task one after another, bounded in memory.
4. A seed with more than GROUP_MOST different segments is refined before it is gathered: the places of its windows are halved, and windows
   of a half share more than the seed, up to all bytes when one place is left. Each segment goes on as two shorter ones with these longer
   seeds; those of GROUP_MOST segments at most meet in step 3, equal ones are settled, the others are halved again.
5. Bytes under a repeated window are cut from the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.text import _BYTE, _Powers, flat, mix, slices
from xylem.session import Workspace

LENGTH, K = 400, 160
#: Segments of a batch, about; most different segments of a seed that meet in one task; bytes of a text taken at once.
BATCH, GROUP_MOST, PART = 4096, 8192, 1 << 18

_U = np.uint64
_POSITION = 23


def hash_spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, from the running sum of ``running``."""
    down = _Powers.of(len(total))[1]
    with np.errstate(over="ignore"):
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def running(raw: np.ndarray) -> np.ndarray:
    up = _Powers.of(len(raw) + 1)[0]
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return total


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    block = full.reshape(-1, w)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def seeds(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K):
    """(document, hash of the seed, hash of the segment, seed, first window, last window) of each segment; places in the slice."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    total = running(raw)
    grams = np.arange(len(raw) - k + 1)
    h = hash_spans(total, grams, grams + k)
    key = (h >> _U(_POSITION) << _U(_POSITION)) | grams.astype(np.uint64)
    best = (sliding_min(key, length - k + 1) & _U((1 << _POSITION) - 1)).astype(np.int64)
    inside = np.zeros(len(best) + 1, np.int8)
    sizes = np.diff(offs)
    long = sizes >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(window):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    seed = best[window]
    new = np.flatnonzero(np.r_[True, (np.diff(seed) != 0) | (np.diff(window) != 1)])
    j0, j1, p = window[new], window[np.r_[new[1:], len(window)] - 1], seed[new]
    doc = np.searchsorted(offs, j0, "right") - 1
    return doc, h[p], hash_spans(total, j0, j1 + length), p, j0, j1


def _seed_rows(length: int, k: int):
    names = ["doc_id", "h", "fp", "seg", "p", "j0", "j1"]

    def run(batches):
        for batch in batches:
            for s in slices(batch, most=PART):
                raw, offs = flat(s.column("text"))
                for at in range(0, max(len(raw), 1), PART) if s.num_rows == 1 else (0,):  # a very long text in overlapping parts
                    part, ends = (raw[at : at + PART + length - 1], None) if s.num_rows == 1 else (raw, offs)
                    ends = np.array([0, len(part)]) if ends is None else ends
                    doc, fp, seg, p, j0, j1 = seeds(part, ends, length, k)
                    own = pa.array(doc)
                    base = ends[doc] - at
                    yield pa.record_batch([s.column("doc_id").take(own), s.column("h").take(own), pa.array(fp.view(np.int64)), pa.array(seg.view(np.int64)), *[pa.array(x - base) for x in (p, j0, j1)]], names=names)

    return run


def columns_repeated(matrix: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For aligned rows (symbols below 256; -1 where a row has none) in groups: whether the window from each column on repeats in another row of its group.

    One symbol of every row is inserted each round. ``order`` holds the rows by group and reversed prefix, ``start`` the column from
    which each has been equal to the row before it.
    """
    n, width = matrix.shape
    out = np.zeros((n, max(width - length + 1, 0)), bool)
    order = np.argsort(group, kind="stable")
    g = np.cumsum(np.r_[0, np.diff(group[order]) != 0]).astype(np.int64)  # groups stay together: ranks by place
    start = np.zeros(n + 1, np.int32)
    start[:-1][np.r_[True, np.diff(g) != 0]] = width + 1
    start[n] = width + 1
    for column in range(width):
        symbol = matrix[order, column].astype(np.int64)
        turn = np.argsort(g * 512 + symbol + 1, kind="stable")
        same = np.r_[False, (g[turn[1:]] == g[turn[:-1]]) & (symbol[turn[1:]] == symbol[turn[:-1]]) & (symbol[turn[1:]] >= 0)]
        new = np.full(n + 1, column + 1, np.int32)
        if same.any():
            # the latest start between the two in the old order
            spans = np.empty(2 * int(same.sum()), np.int64)
            spans[::2], spans[1::2] = turn[:-1][same[1:]] + 1, turn[1:][same[1:]] + 1
            new[:-1][same] = np.maximum.reduceat(start, spans)[::2]
        order, start = order[turn], new
        if column >= length - 1:
            near = start <= column - length + 1
            hit = near[:-1] | near[1:]
            hit[-1] = near[n - 1]
            out[order[hit], column - length + 1] = True
    return out


def _aligned(length: int, k: int):
    """Batches of whole seed groups, from rows ordered by seed hash, to (of_fp, of_seg, repeated windows relative to the seed)."""
    reach = length - k

    def solve(rows):
        fps = np.array([r[0] for r in rows], np.int64)
        matrix = np.full((len(rows), reach + length), -1, np.int16)
        for i, (*_, before, data) in enumerate(rows):
            matrix[i, reach - before : reach - before + len(data)] = np.frombuffer(data, np.uint8)
        hits = columns_repeated(matrix, fps, length)
        out = []
        for r, row in zip(rows, hits):
            edge = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
            if len(edge):
                out.append((r[1], r[2], (edge - reach).astype(np.int32).tobytes()))
        return pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["of_fp", "of_seg", "ranges"])

    def run(batches):
        rows: list = []
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("fp", "of_fp", "of_seg", "before", "data")]):
                if len(rows) >= BATCH and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    return run


_PART = "fp long, seg long, of_fp long, of_seg long, before int, data binary, low int, high int, ranges binary"


def _halves(length: int):
    """Each segment, whose windows are at places ``low`` to ``high`` from its seed, as those of either half, with the hash of all that the half's windows share as seed."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], np.uint8)
                total, n, before = running(data), len(data), r["before"]
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    first, last = max(low, -before), min(high, n - before - length)
                    if first <= last:
                        spans = np.array([[high, low + length], [first, last + length]]) + before
                        shared, own = hash_spans(total, spans[:, 0], spans[:, 1])
                        mark = mix(np.array([r["fp"], low, first], np.int64).view(np.uint64))
                        with np.errstate(over="ignore"):
                            fp = mix(shared + mark[:1] + mark[1:2] * _U(3))[0]
                            seg = mix(own + mark[2:] * _U(3))[0]
                        piece = data[first + before : last + before + length].tobytes()
                        out.append((fp.view(np.int64), seg.view(np.int64), r["of_fp"], r["of_seg"], -first, piece, low, high, np.array([first, last + 1], np.int32).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _PART.split(", ")])

    return run


def _fetch(length: int):
    """The bytes of each wanted segment of a text."""

    def run(batches):
        for batch in batches:
            for s in slices(batch):
                raw, offs = flat(s.column("text"))
                rows = []
                for d, wanted in enumerate(s.column("wanted").to_pylist()):
                    for x in wanted:
                        a, b = int(offs[d]) + x["j0"], int(offs[d]) + x["j1"] + length
                        rows.append((x["fp"], x["seg"], x["p"] - x["j0"], raw[a:b].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["fp", "seg", "before", "data"])

    return run


def _cut(length: int, keep: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def run(batches):
        for batch in batches:
            for s in slices(batch):
                raw, offs = flat(s.column("text"))
                rows = []
                for d, found in enumerate(s.column("found").to_pylist()):
                    own = raw[offs[d] : offs[d + 1]]
                    n, removed, spans = len(own), 0, 0
                    if found:
                        edge = np.zeros(n + 1, np.int32)
                        for x in found:
                            if x["ranges"] is None:  # all windows of the segment
                                pairs = np.array([[x["j0"], x["j1"] + 1]])
                            else:
                                pairs = np.frombuffer(x["ranges"], np.int32).reshape(-1, 2).astype(np.int64) + x["p"]
                            np.add.at(edge, pairs[:, 0], 1)
                            np.add.at(edge, pairs[:, 1] - 1 + length, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed, spans = int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                        own = own[~gone]
                    data = own.tobytes()
                    rows.append((n, removed, spans, hashlib.sha256(data).hexdigest(), data if keep else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch([s.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, keep_bytes: bool = True, group_most: int = GROUP_MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: the bytes that stay, where ``keep_bytes``) per row of ``docs`` (doc_id, text).

    Null text is empty. Rows that repeat id and text are each other's repeats. What stays is bytes: a cut can fall within a character. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "repeats")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = work.save(texts.mapInArrow(_seed_rows(length, k), "doc_id long, h long, fp long, seg long, p long, j0 long, j1 long"), "seeds")
    # counts are tables of their own: joined straight to the rows that they count, they would share their partitions, and those of a hot
    # seed could not be split. merge: the same plan at any size
    often = work.save(found.groupBy(F.col("fp").alias("f")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    open_ = work.save(found.join(often.hint("merge"), F.col("fp") == F.col("f")).drop("f", "n"), "open")
    work.drop(found)
    first = F.min(F.struct("doc_id", "h", "p", "j0", "j1")).alias("one")
    segments = work.save(open_.groupBy("fp", "seg").agg(F.count(F.lit(1)).alias("copies"), first), "segments")
    kinds = work.save(segments.groupBy(F.col("fp").alias("f")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    wanted = segments.join(kinds, F.col("fp") == F.col("f")).select("fp", "seg", "kinds", "one.*")
    by_doc = wanted.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("t")).agg(F.collect_list(F.struct("fp", "seg", "p", "j0", "j1")).alias("wanted"))
    chosen = texts.hint("merge").join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")))
    data = work.save(chosen.select("text", "wanted").mapInArrow(_fetch(length), "fp long, seg long, before int, data binary").dropDuplicates(["fp", "seg"]), "data")
    columns = ["fp", "seg", "of_fp", "of_seg", "before", "data", "low", "high"]
    own = data.withColumns({"of_fp": F.col("fp"), "of_seg": F.col("seg"), "low": F.lit(k - length), "high": F.lit(0)})
    sized = own.join(kinds, F.col("fp") == F.col("f")).select(*columns, "kinds")
    found_ranges, out_kinds, level = [], "of_fp long, of_seg long, ranges binary", 0
    while True:
        few = sized.where(F.col("kinds") <= group_most).select("fp", "of_fp", "of_seg", "before", "data").repartition("fp").sortWithinPartitions("fp")
        found_ranges.append(few.mapInArrow(_aligned(length, k), out_kinds))
        many = sized.where((F.col("kinds") > group_most) & (F.col("low") < F.col("high"))).select(*columns)
        if not many.head(1):
            break
        level += 1
        parts = work.save(many.mapInArrow(_halves(length), _PART), f"parts{level}")
        same = work.save(parts.groupBy("fp", "seg").agg(F.count(F.lit(1)).alias("copies")), f"same{level}")
        twice = same.where("copies > 1").select(F.col("fp").alias("f"), F.col("seg").alias("s"))
        found_ranges.append(parts.join(twice, (F.col("fp") == F.col("f")) & (F.col("seg") == F.col("s")), "left_semi").select("of_fp", "of_seg", "ranges"))
        # equal segments are settled for all that have them; one of them goes on, for others to meet
        kinds = work.save(same.groupBy(F.col("fp").alias("f")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), f"kinds{level}")
        sized = work.save(parts.join(kinds, F.col("fp") == F.col("f")).select(*columns, "kinds").dropDuplicates(["fp", "seg"]), f"open{level}")
    ranges = found_ranges[0]
    for more in found_ranges[1:]:
        ranges = ranges.union(more)
    # one row per segment, with at most as many ranges as a seed has places
    joined = F.aggregate(F.collect_list("ranges"), F.lit(b""), lambda a, x: F.concat(a, x))
    ranges = work.save(ranges.groupBy(F.col("of_fp").alias("f"), F.col("of_seg").alias("s")).agg(joined.alias("ranges")), "ranges")
    whole = segments.where("copies > 1").select(F.col("fp").alias("f"), F.col("seg").alias("s"), F.lit(None).cast("binary").alias("ranges"))
    partly = ranges.join(whole.select("f", "s"), ["f", "s"], "left_anti")
    marks = whole.union(partly.select("f", "s", "ranges"))
    hit = open_.join(marks.hint("merge"), (F.col("fp") == F.col("f")) & (F.col("seg") == F.col("s")))
    hit = hit.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "p", "j0", "j1", "ranges").distinct()
    per_doc = hit.groupBy("d", "t").agg(F.collect_list(F.struct("p", "j0", "j1", "ranges")).alias("found"))
    out = texts.hint("merge").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left").select("doc_id", "text", "found")
    return out.mapInArrow(_cut(length, keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary")


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    return cut_repeats(docs.select("doc_id", "text"), keep_bytes=False).drop("text")
