"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts become pieces of at most CAPACITY tokens; only their lengths matter from there on. Pieces that fill a sequence alone are
settled. The others fall into problems of bounded size, each evolved on ISLANDS islands at once. Individuals are whole
packings. Crossover injects well-filled bins of one parent whole into the other, drops the bins there that hold an injected
piece again, and best-fits the pieces so displaced; mutation breaks up badly filled bins. After each epoch an island's elite
moves to the next island. Every level deals its pieces to problems by hash. What is left in badly filled bins of all problems is
packed again in a next level, until one problem holds the rest, a level saves no bin or no packing of the rest can have fewer.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.text import slices
from xylem.llm.tokens import Encoder, crc, tokenizer_path
from xylem.session import Workspace

CAPACITY = 4096
#: Pieces in a problem; islands of a problem; epochs; generations in an epoch; packings on an island.
PROBLEM, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 2, 2, 8, 6
#: Noise in the order of pieces from which an island's packings begin, by best fit.
NOISES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5)
#: Bins filled to less than this share go to the next level.
WELL_FILLED = 0.999
SEED = 11


class Packing:
    """Bins of piece numbers; ``room[r]`` has the bins with r tokens left and ``mask`` a bit for each r that has any."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []
        self.room: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        if r := self.left[b]:
            self.room.setdefault(r, []).append(b)
            self.mask |= 1 << r

    def add_bin(self, pieces: list[int]) -> None:
        self.bins.append(list(pieces))
        self.left.append(self.capacity - sum(self.lengths[i] for i in pieces))
        self._offer(len(self.bins) - 1)

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece goes to the bin that it leaves the least room in, or to a new one."""
        for i in pieces:
            size = self.lengths[i]
            if fits := self.mask >> size:
                r = size + (fits & -fits).bit_length() - 1
                b = self.room[r].pop()
                if not self.room[r]:
                    self.mask ^= 1 << r
                self.bins[b].append(i)
                self.left[b] -= size
                self._offer(b)
            else:
                self.bins.append([i])
                self.left.append(self.capacity - size)
                self._offer(len(self.bins) - 1)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins as unequally filled as can be."""
        return -len(self.bins), sum((self.capacity - x) ** 2 for x in self.left) / self.capacity**2

    def labels(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, pieces in enumerate(self.bins):
            for i in pieces:
                out[i] = b
        return out


def descending(lengths: list[int], pieces, rng: random.Random | None = None, noise: float = 0.0) -> list[int]:
    return sorted(pieces, key=lambda i: (-lengths[i] * (1 + noise * rng.random() if rng else 1), i))


def fresh(lengths: list[int], capacity: int, rng: random.Random, noise: float) -> Packing:
    p = Packing(lengths, capacity)
    p.best_fit(descending(lengths, range(len(lengths)), rng, noise))
    return p


def from_labels(lengths: list[int], capacity: int, labels) -> Packing:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(labels):
        groups.setdefault(b, []).append(i)
    p = Packing(lengths, capacity)
    for pieces in groups.values():
        p.add_bin(pieces)
    return p


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Some of ``b``'s best-filled bins whole, the bins of ``a`` that share no piece with them, and best fit for the rest."""
    ranked = sorted(range(len(b.bins)), key=lambda k: b.left[k])
    most = max(1, len(ranked) // 2)
    chosen = [k for k in ranked[:most] if rng.random() < 0.5] or ranked[:1]
    child, taken = Packing(a.lengths, a.capacity), set()
    for k in chosen:
        child.add_bin(b.bins[k])
        taken.update(b.bins[k])
    displaced = []
    for pieces in a.bins:
        if taken.isdisjoint(pieces):
            child.add_bin(pieces)
        else:
            displaced += [i for i in pieces if i not in taken]
    child.best_fit(descending(a.lengths, displaced))
    return child


def mutate(a: Packing, rng: random.Random) -> Packing:
    """Break up the worst-filled bins and a few others."""
    ranked = sorted(range(len(a.bins)), key=lambda k: -a.left[k])
    broken = set(ranked[: max(1, len(ranked) // 50)]) | {rng.randrange(len(ranked)) for _ in range(max(1, len(ranked) // 20))}
    child, displaced = Packing(a.lengths, a.capacity), []
    for k, pieces in enumerate(a.bins):
        if k in broken:
            displaced += pieces
        else:
            child.add_bin(pieces)
    rng.shuffle(displaced)
    child.best_fit(descending(a.lengths, displaced, rng, 0.3))
    return child


def evolve(lengths: list[int], population: list[Packing], rng: random.Random, generations: int, size: int, capacity: int) -> list[Packing]:
    least = -(-sum(lengths) // capacity)
    population = sorted(population, key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(population[0].bins) <= least:
            break
        children = []
        for _ in range(max(1, size // 2)):
            a, b = rng.sample(population, 2) if len(population) > 1 else (population[0], population[0])
            children.append(crossover(a, b, rng))
        children.append(mutate(population[0], rng))
        population = sorted(population + children, key=Packing.fitness, reverse=True)[:size]
    return population


def pack(lengths: list[int], capacity: int = CAPACITY, seed: int = SEED) -> list[int]:
    """Bin of each piece, on one island: the algorithm without Spark."""
    rng = random.Random(seed)
    population = [fresh(lengths, capacity, rng, n) for n in (0.0, *NOISES[1:])]
    return evolve(lengths, population, rng, EPOCHS * GENERATIONS, POPULATION, capacity)[0].labels()


#: More than the bins of a problem; with the problem's number it makes a sequence's.
_BINS = 1 << 14
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches):
        for batch in batches:
            for s in slices(batch):
                ids, offs = Encoder.of(path).encode(s.column("text"))
                n = -(-np.diff(offs) // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
                start = piece * capacity
                end = np.minimum(start + capacity, np.diff(offs)[doc])
                at = offs[:-1][doc]
                crcs = [crc(ids[a:b]) for a, b in zip(at + start, at + end)]
                yield pa.record_batch([s.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _problems(size: int, level: int):
    """Rows of (doc_id, piece, start, length, ids_crc32) in problems of at most ``size`` pieces, one row each."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        from pyspark import TaskContext

        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal held, n, k
            t = pa.Table.from_batches(held).combine_chunks()
            problem = (level << 40) | (part << 12) | k
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)) for c in names]
            held, n, k = [], 0, k + 1
            return pa.record_batch([pa.array([problem], pa.int64()), *lists], names=["problem", *names])

        for batch in batches:
            batch = batch.select(names)
            while batch.num_rows:
                part_of = batch.slice(0, size - n)
                held.append(part_of)
                n += part_of.num_rows
                batch = batch.slice(part_of.num_rows)
                if n == size:
                    yield close()
        if n:
            yield close()

    return run


def _epoch(capacity: int, generations: int, size: int):
    """One epoch on each row's island: (problem, island, lengths, population, migrant) to the same with ``elite`` and its fitness."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rng = random.Random(f"{SEED} {r['problem']} {r['island']} {r['epoch']}")
                lengths = r["lengths"]
                if r["population"]:
                    population = [from_labels(lengths, capacity, x) for x in r["population"]]
                    if r["migrant"]:
                        population.append(from_labels(lengths, capacity, r["migrant"]))
                else:
                    noises = [0.0 if r["island"] == 0 else NOISES[0], *(NOISES[k % len(NOISES)] for k in range(1, size))]
                    population = []
                    for x in noises:  # more only where the first leaves room for them
                        population.append(fresh(lengths, capacity, rng, x))
                        if len(population[-1].bins) <= -(-sum(lengths) // capacity):
                            break
                population = evolve(lengths, population, rng, generations, size, capacity)
                bins, fill = population[0].fitness()
                labels = [p.labels() for p in population]
                yield pa.record_batch([pa.array([x], t) for x, t in ((r["problem"], pa.int64()), (r["island"], pa.int32()), (lengths, pa.list_(pa.int32())), (labels, pa.list_(pa.list_(pa.int32()))), (labels[0], pa.list_(pa.int32())), (-bins, pa.int64()), (fill, pa.float64()))], names=["problem", "island", "lengths", "population", "elite", "bins", "fill"])

    return run


def _placed(capacity: int, least: int):
    """Rows of one problem and its best packing to pieces with sequence_id, offset and whether the bin is to be kept."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lists = [batch.column(c)[k].values for c in names]
                length, label = lists[3].to_numpy(), np.asarray(batch.column("elite")[k].values)
                order = np.argsort(label, kind="stable")
                ends = np.cumsum(length[order])
                first = np.r_[True, np.diff(label[order]) != 0]
                begin = (ends - length[order])[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
                offset = np.empty(len(order), np.int64)
                offset[order] = ends - length[order] - begin
                fill = np.bincount(label, length)[label]
                problem = batch.column("problem")[k].as_py()
                number = problem * _BINS + label.astype(np.int64)
                yield pa.record_batch([*lists, pa.array(number), pa.array(offset), pa.array(fill >= least)], names=[*names, "sequence_id", "offset", "kept"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, problem: int = PROBLEM, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """The contract's columns, one row per piece of ``docs`` (doc_id, text).

    Null or empty text is one piece of the end id alone. Rows that repeat a doc_id are packed each for itself. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = work.save(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or tokenizer_path(), capacity), _PIECE), "pieces")
    full = pieces.where(F.col("length") >= capacity).select(*names, F.lit(0).cast("long").alias("offset"), F.monotonically_increasing_id().alias("k"))
    settled = [full.select(*names, (F.lit(-1).cast("long") - F.col("k")).alias("sequence_id"), "offset")]
    rest, level, held, bins = pieces.where(F.col("length") < capacity).select(*names), 0, None, 0
    n = rest.count()
    lists = "doc_id array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>"
    while True:
        last = n <= problem
        # dealt in turn and ordered by hash: which pieces meet does not follow the order of files
        rest = rest.coalesce(1) if last else rest.repartition(-(-n // (problem * 8))).sortWithinPartitions(F.xxhash64(*names, F.lit(level)))
        problems = work.save(rest.mapInArrow(_problems(problem, level), f"problem long, {lists}"), f"problems{level}")
        state = problems.select("problem", F.col("length").cast("array<int>").alias("lengths")).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        state = state.withColumn("population", F.lit(None).cast("array<array<int>>")).withColumn("migrant", F.lit(None).cast("array<int>"))
        for epoch in range(epochs):
            state = state.withColumn("epoch", F.lit(epoch)).select("problem", "island", "epoch", "lengths", "population", "migrant")
            state = work.save(state.mapInArrow(_epoch(capacity, generations, population), "problem long, island int, lengths array<int>, population array<array<int>>, elite array<int>, bins long, fill double"), f"epoch{level}-{epoch}")
            if epoch + 1 < epochs:
                moved = state.select(F.col("problem").alias("p"), ((F.col("island") + 1) % islands).alias("i"), F.col("elite").alias("migrant"))
                state = state.join(moved, (F.col("problem") == F.col("p")) & (F.col("island") == F.col("i")), "left").select("problem", "island", "lengths", "population", "migrant")
        best = state.groupBy("problem").agg(F.min_by("elite", F.struct("bins", -F.col("fill"), "island")).alias("elite"))
        placed = problems.join(best, "problem").mapInArrow(_placed(capacity, int(WELL_FILLED * capacity)), f"{_PIECE}, sequence_id long, offset long, kept boolean")
        placed = work.save(placed, f"placed{level}")
        first, poor = F.col("offset") == 0, ~F.col("kept")
        total, left, n, size = placed.agg(F.count(F.when(first, 1)), F.count(F.when(first & poor, 1)), F.count(F.when(poor, 1)), F.coalesce(F.sum(F.when(poor, F.col("length"))), F.lit(0))).first()
        if held is not None and total >= bins:  # new mates saved no bin: the bins of the level before stay
            settled.append(held)
            break
        if last or left <= -(-size // capacity):  # one problem held all, or no packing of the rest has fewer bins
            settled.append(placed.drop("kept"))
            break
        settled.append(placed.where("kept").drop("kept"))
        held, bins = placed.where("NOT kept").drop("kept"), left
        rest, level = held.select(*names), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out
