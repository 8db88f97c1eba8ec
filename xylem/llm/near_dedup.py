"""Near-duplicate documents by MinHash.

1. Texts of equal words are one unit from the start: copies never meet in a bucket.
2. Each unit's shingles pass bands * rows universal hashes ((a x + b) mod 2^64, high bits); the minima, ``rows`` at a time, are
   band keys. Units that share a key of a band are candidates; each bucket is a star around its smallest unit, never all pairs.
3. Connected components of these stars (alternating large-star and small-star) are clusters: every link lies within one.
4. In a cluster, signatures are compared first; pairs whose agreement could belong to a link are confirmed on full shingle sets.
   Clusters are cut into blocks of bounded size by hash, and units are compared within their block. Clusters of one block are done. In a
   larger one a unit of each linked set stands for it in a next round of blocks, until a round leaves more than half of them: so linked
   sets grow together without pairs of blocks.
5. Linked sets are components, but for links that buckets with units of several components can still hide. There, units outside the
   cluster's largest component, in blocks, meet all blocks that share such a bucket; units of one component are not compared again, and
   alternating stars join the components that such links connect. Work grows with a cluster's size times its units outside the largest
   component.

At the least similarity the bands miss a link with a chance below 3e-7, and a cluster compares more than its buckets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.text import LOWER, flat, shingle_hashes, slices, span_hashes, word_bounds
from xylem.session import Workspace

#: Bits of a shingle's hash; the other bits of a word number the documents of a slice.
HASH_BITS = 54
#: Units and bytes of shingles that a block holds, about.
BLOCK_UNITS, BLOCK_BYTES = 256, 8 << 20


@dataclass(frozen=True)
class Settings:
    """Links are sets of shingles of ``words`` words with denominator * intersection >= numerator * union.

    ``bands`` and ``rows`` are to miss a link with a chance below 1e-6.
    """

    words: int = 3
    numerator: int = 85
    denominator: int = 100
    bands: int = 32
    rows: int = 6

    @property
    def least_agreement(self) -> float:
        """Agreement of signatures from which a pair goes on to the full sets: six standard deviations below the limit."""
        s = self.numerator / self.denominator
        return s - 6 * (s * (1 - s) / (self.bands * self.rows)) ** 0.5


#: Five words and a similarity of 0.8, for use without other demands.
FIVE_WORDS = Settings(words=5, numerator=80, bands=40, rows=5)

_RNG = np.random.default_rng(85)
_A = _RNG.integers(1 << 63, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1 << 63, size=1024, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int):
    """(distinct shingle hashes, ascending within each document; the documents' offsets; each document's digest of its words).

    A document without words has no shingles; its digest is empty.
    """
    raw, offs = flat(column)
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offs)
    words = span_hashes(raw, starts, ends)
    h, at = shingle_hashes(words, first, k)
    docs = len(offs) - 1
    # document number and the top HASH_BITS of the hash in one sortable word
    shift = np.uint64(HASH_BITS)
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(at))
    both = np.sort((doc << shift) | (h >> (np.uint64(64) - shift)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    offsets = np.searchsorted(both >> shift, np.arange(docs + 1, dtype=np.uint64))
    sets = both & ((np.uint64(1) << shift) - np.uint64(1))
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else b"" for a, b in zip(first, first[1:])]
    return sets, offsets, digests


def signatures(sets: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """That many minima (32 bits) of each non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), hashes), np.uint32)
    if len(starts):
        x = sets & np.uint64(0xFFFFFFFF)
        t = np.empty_like(x)
        with np.errstate(over="ignore"):
            for i in range(hashes):
                np.multiply(x, _A[i], out=t)
                t += _B[i]
                out[:, i] = np.minimum.reduceat(t, starts) >> np.uint64(32)
    return out



def _slices(batch):
    for s in slices(batch):
        for k in range(0, s.num_rows, 1 << (64 - HASH_BITS)):
            yield s.slice(k, 1 << (64 - HASH_BITS))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = sig.reshape(-1, bands, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + parts[:, :, j] * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _units(how: Settings):
    """(row columns, unit, n_shingles, bands) of each document."""

    def run(batches):
        for batch in batches:
            for s in _slices(batch):
                sets, offsets, digests = shingle_sets(s.column("text"), how.words)
                n = np.diff(offsets)
                keys = band_keys(signatures(sets, offsets, how.bands * how.rows), how.bands, how.rows)
                at = np.zeros(len(n) + 1, np.int32)
                at[1:] = np.cumsum(n > 0) * how.bands
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).ravel()))
                rest = [c for c in s.schema.names if c != "text"]
                yield pa.record_batch([*[s.column(c) for c in rest], pa.array(digests, pa.binary()), pa.array(n.astype(np.int64)), lists], names=[*rest, "unit", "n_shingles", "bands"])

    return run


def _sets(how: Settings):
    """(unit, signature, set) of candidate documents."""

    def run(batches):
        for batch in batches:
            for s in _slices(batch):
                sets, offsets, digests = shingle_sets(s.column("text"), how.words)
                full = np.flatnonzero(np.diff(offsets) > 0)
                sig = signatures(sets, offsets, how.bands * how.rows)
                out = [sets[offsets[i] : offsets[i + 1]].tobytes() for i in full]
                yield pa.record_batch([pa.array([digests[i] for i in full], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(out, pa.binary())], names=["unit", "sig", "items"])

    return run


def linked_forest(sigs: list[np.ndarray], sets: list[np.ndarray], how: Settings, left: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (with ``left`` and ``group``, of the links of left sets with sets of other groups)."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    sig = np.stack(sigs)
    items, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(df > 1) - 1
    width = int((df > 1).sum())
    bits = np.zeros((n, -(-max(width, 1) // 8)), np.uint8)
    at = 0
    for i, x in enumerate(sets):
        mine = inverse[at : at + len(x)]
        at += len(x)
        row = np.zeros(bits.shape[1] * 8, bool)
        row[column[mine[df[mine] > 1]]] = True
        bits[i] = np.packbits(row)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    numerator, denominator = how.numerator, how.denominator
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        if left is not None:
            others = others[(left[i] | left[i + 1 :]) & (group[i + 1 :] != group[i])]
        small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[denominator * small >= numerator * large]
        if not len(others):
            continue
        others = others[(sig[others] == sig[i]).mean(1) >= how.least_agreement]
        if not len(others):
            continue
        inter = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
        union = sizes[i] + sizes[others] - inter
        for j in others[denominator * inter >= numerator * union]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _standing(how: Settings):
    """(root, u, v) of each unit of a block (root, unit, sig, items): v stands for all that are linked with u in the block."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("unit")
        units = f["unit"].tolist()
        at = list(range(len(units)))
        if len(units) > 1:
            for i, j in linked_forest([np.frombuffer(x, np.uint32) for x in f["sig"]], [np.frombuffer(x, np.uint64) for x in f["items"]], how):
                while at[i] != i:
                    i = at[i]
                while at[j] != j:
                    j = at[j]
                at[max(i, j)] = min(i, j)
            for k in range(len(at)):
                at[k] = at[at[k]]  # those before k are settled
        return pd.DataFrame({"root": f["root"].to_numpy(), "u": units, "v": [units[i] for i in at]})

    return run


def _crossing(how: Settings):
    """(u, v): links of a cell's ``minor`` units with units of other components (unit, comp, minor, sig, items)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("minor", ascending=False, kind="stable").drop_duplicates("unit")
        units = f["unit"].tolist()
        links = linked_forest([np.frombuffer(x, np.uint32) for x in f["sig"]], [np.frombuffer(x, np.uint64) for x in f["items"]], how, f["minor"].to_numpy(bool), pd.factorize(f["comp"])[0]) if len(f) > 1 else []
        return pd.DataFrame({"u": [units[i] for i, _ in links], "v": [units[j] for _, j in links]})

    return run


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the smallest node reachable; large-star and small-star alternate until all are stars.

    A node's smallest neighbour is a partial aggregate, dealt anew before it is joined back to the node's edges: joined straight to what it
    was made of, it would share that side's partitions, which adaptive execution could not split where a node has very many edges.
    """

    def smallest(e: DataFrame) -> DataFrame:
        # concat: an expression that changes nothing, but of whose partitioning the planner knows nothing either
        return e.groupBy("u").agg(F.min("v").alias("m")).select(F.concat("u", F.lit(b"")).alias("n"), "m")

    e = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    while True:
        # large-star: larger neighbours of u go to the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both).select("n", F.least("n", "m").alias("m"))
        large = both.where("v > u").join(m, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.save(large, f"{name}-large")
        work.drop(e)
        # small-star: u and its smaller neighbours go to the smallest of these
        m = smallest(large)
        joined = large.join(m, F.col("u") == F.col("n"))
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = work.save(e, f"{name}-small")
        work.drop(large)
        # stars: each node points at one other, which points at none
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").head(1):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _renamed(linked: DataFrame, names: DataFrame) -> DataFrame:
    """``linked`` (node, root) with roots u as ``names`` (u, v) has them."""
    return linked.join(names, F.col("root") == F.col("u"), "left").select("node", F.coalesce("v", "root").alias("root"))


def _share(size):
    """Blocks for rows with that many bytes each."""
    return F.greatest(F.ceil(F.count(size) / BLOCK_UNITS), F.ceil(F.coalesce(F.sum(size), F.lit(0)) / BLOCK_BYTES)).cast("int")


def _in_blocks(units: DataFrame, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """``units`` (unit, root, items, ...) with ``blocks`` and ``blk``, and (c, blocks) of the clusters of more than one block."""
    size = work.save(units.groupBy(F.col("root").alias("c")).agg(_share(F.octet_length("items")).alias("blocks")), f"{name}-sizes")
    out = units.join(size, F.col("root") == F.col("c")).drop("c").withColumn("blk", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    return out, size.where("blocks > 1")


def _linked(sets: DataFrame, bucketed: DataFrame, how: Settings, work: Workspace) -> DataFrame:
    """(node, root) of every unit of a cluster, root the same for all that are linked, from ``sets`` (unit, root: its cluster, sig, items) and its buckets."""
    columns = ["root", "blk", "unit", "sig", "items"]

    def round_(units: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        placed, large = _in_blocks(units, work, name)
        return work.save(placed.select(*columns).groupBy("root", "blk").applyInPandas(_standing(how), "root binary, u binary, v binary"), name), large

    stands, large = round_(sets, "standing")
    linked = stands.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if not large.head(1):
        return linked
    wide = work.save(sets.join(large.select("c"), F.col("root") == F.col("c"), "left_semi"), "wide")
    alone = stands.join(large.select("c"), F.col("root") == F.col("c"), "left_semi").where("u = v").select("u")
    left, least = alone.count(), large.count()
    while left > least:
        stands, _ = round_(wide.join(alone, F.col("unit") == F.col("u"), "left_semi"), "standing")
        linked = _renamed(linked, stands.select("u", "v"))
        alone = stands.where("u = v").select("u")
        before, left = left, alone.count()
        if 2 * left > before:
            break
    linked = work.save(linked, "linked")
    # what is left: buckets of several components
    named = linked.withColumnsRenamed({"node": "l_node", "root": "comp"})
    comps = wide.select("unit", "root").distinct().join(named, F.col("unit") == F.col("l_node")).select("unit", "root", "comp")
    comps = work.save(comps, "components")
    seen = bucketed.select("band", "key", "unit").join(comps, "unit")
    mixed = work.save(seen.groupBy("band", "key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("band", "key"), "mixed")
    if not mixed.head(1):
        return linked
    most = comps.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("root").alias("c")).agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
    most = work.save(most, "most")
    seen = work.save(seen.join(mixed, ["band", "key"]).join(most, F.col("root") == F.col("c")).select("band", "key", "unit", "root", "comp", (F.col("comp") != F.col("most")).alias("minor")), "open")
    # cells of a block of units outside the largest component and a block of any; both by hash
    units = seen.select("unit", "root", "comp", "minor").distinct()
    units = work.save(units.join(wide.select("unit", "sig", "items"), "unit"), "open-units")
    size = F.octet_length("items")
    count = work.save(units.groupBy(F.col("root").alias("c")).agg(_share(size).alias("n_all"), _share(F.when(F.col("minor"), size)).alias("n_minor")), "cell-sizes")
    block = lambda n: F.pmod(F.xxhash64("unit"), F.col(n)).cast("int")
    where = seen.join(count, F.col("root") == F.col("c")).select("band", "key", "root", "minor", F.when(F.col("minor"), block("n_minor")).alias("i"), block("n_all").alias("j"))
    here, there = where.where("minor").select("band", "key", "root", "i").distinct(), where.select("band", "key", "j").distinct()
    cells = work.save(here.join(there, ["band", "key"]).select("root", "i", "j").distinct(), "cells")
    full = units.join(count, F.col("root") == F.col("c"))
    full = work.save(full.select("root", "unit", "comp", "minor", F.when(F.col("minor"), block("n_minor")).alias("mine"), block("n_all").alias("any"), "sig", "items"), "cell-units")
    columns, pair = ["root", "i", "j", "unit", "comp", "minor", "sig", "items"], "u binary, v binary"
    left = full.where("minor").join(cells.withColumnRenamed("i", "mine"), ["root", "mine"]).withColumnRenamed("mine", "i").select(*columns)
    right = full.join(cells.withColumnRenamed("j", "any"), ["root", "any"]).withColumnRenamed("any", "j").withColumn("minor", F.lit(False)).select(*columns)
    more = work.save(left.union(right).groupBy("root", "i", "j").applyInPandas(_crossing(how), pair), "crossing")
    if not more.head(1):
        return linked
    # links of units join components as wholes
    ends = more.join(comps.select(F.col("unit").alias("a"), F.col("comp").alias("x")), F.col("u") == F.col("a")).join(comps.select(F.col("unit").alias("b"), F.col("comp").alias("y")), F.col("v") == F.col("b"))
    joined = components(ends.select(F.col("x").alias("u"), F.col("y").alias("v")), work, "crossing")
    return _renamed(linked, joined.select(F.col("node").alias("u"), F.col("root").alias("v")))


def grouped(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """The columns of ``docs`` but text, with n_shingles, component_id, unit and group (null without words), one row per row of ``docs`` (doc_id, text, ...).

    Texts without words are linked with nothing, each
    other included; their unit is empty. Null ids sort last and are not an id: a component of null ids alone has a null
    component_id. Rows that repeat a doc_id are rows like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    rows = work.save(docs.select(*rest, "text").mapInArrow(_units(how), f"{kinds}, unit binary, n_shingles long, bands array<long>"), "units")
    units = rows.where("n_shingles > 0").groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    keyed = work.save(units.select("unit", F.posexplode("bands").alias("band", "key")), "bands")
    # buckets of two or more: counted without units, as most bands stand alone; then as stars
    shared = work.save(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "key"), "shared")
    bucketed = work.save(keyed.join(shared, ["band", "key"]).select("band", "key", "unit"), "buckets")
    work.drop(keyed)
    centres = work.save(bucketed.groupBy("band", "key").agg(F.min("unit").alias("centre")), "centres")
    edges = bucketed.join(centres, ["band", "key"]).select(F.col("unit").alias("u"), F.col("centre").alias("v")).distinct()
    clusters = components(edges, work, "clusters")
    members = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())
    # full sets of the candidates, from the text of one document each
    chosen = units.select("unit", "doc_id").join(members, F.col("unit") == F.col("node"), "left_semi").select(F.col("doc_id").alias("of")).distinct()
    # rows that repeat a doc_id can have other texts: the unit tells them apart again below
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets(how), "unit binary, sig binary, items binary").join(members, F.col("unit") == F.col("node"))
    sets = work.save(sets.select("unit", "root", "sig", "items"), "sets")
    linked = _linked(sets, bucketed, how, work)
    # smallest doc_id of each group
    full = rows.drop("bands").join(linked, F.col("unit") == F.col("node"), "left").withColumn("group", F.when(F.col("n_shingles") > 0, F.coalesce("root", "unit"))).drop("node", "root")
    least = units.select("unit", "doc_id").join(linked, F.col("unit") == F.col("node"), "left").groupBy(F.coalesce("root", "unit").alias("g")).agg(F.min("doc_id").alias("component_id"))
    least = work.save(least, "least")  # a table of its own, so that a large group's rows can be split
    out = full.join(least, F.col("group") == F.col("g"), "left")
    return out.select(*rest, "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "unit", "group")


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    return grouped(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, how: Settings = FIVE_WORDS) -> DataFrame:
    """One row of ``docs`` for each group, and every row without words, with all columns of ``docs``."""
    named = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    good = grouped(named.drop("row"), how).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # of a group's rows that repeat its smallest doc_id, the smallest unit stays; of equal words, one text
    good = good.groupBy(F.col("doc_id").alias("d"), "group").agg(F.min(F.struct("unit", "h"))["h"].alias("t")).select("d", "t").distinct()
    return named.drop("text").join(good, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left_semi").select("row.*")
