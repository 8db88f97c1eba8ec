"""Token-id output: each shard one wavelet matrix in a compressed file.

A shard holds the ids of consecutive documents (ascending doc_id), in as many bit planes as its highest id has bits. Planes run from the
highest bit; each orders the ids stably by the bits before it. A plane is kept in blocks of BLOCK bits, each compressed by itself, with
the count of ones before each block: access, rank and select open only the blocks that they touch.

File: shards end to end, each ``XWM1``, byte length of the rest (u64), header length (u32), header (JSON), then the sections
``docs`` (ids, i64; null flags; token counts, u64), ``ranks`` (u64 per block and plane), ``sizes`` (u32 per block) and the blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.blobs import read_blobs, write_blobs
from xylem.llm.text import slices
from xylem.llm.tokens import Encoder, crc, tokenizer_path
from xylem.session import Workspace

MAGIC = b"XWM1"
#: Bits of a block; most bits of an id, which is what the contract's 32-bit words hold.
BLOCK, MOST_BITS = 1 << 15, 32
#: A shard is closed when it has so many ids; a document is never divided.
SHARD_TOKENS = 1 << 21


def build(ids: np.ndarray, doc_ids: list, counts: np.ndarray, part: int, chunk: int) -> bytes:
    """The bytes of one shard."""
    pack = zstandard.ZstdCompressor(level=1)
    bits_of = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    if bits_of > MOST_BITS or len(ids) and ids.min() < 0:
        raise ValueError(f"ids of a shard must be below 2 ** {MOST_BITS}")
    cur = ids.astype(np.uint16 if bits_of <= 16 else np.uint32)
    blocks, ranks, sizes, zeros = [], [], [], []
    for bit in range(bits_of - 1, -1, -1):
        ones = (cur >> bit & 1).astype(bool)
        bits = np.packbits(ones)
        for k in range(0, len(bits), BLOCK // 8):
            raw = bits[k : k + BLOCK // 8].tobytes()
            blocks.append(min(pack.compress(raw), b"\0" + raw, key=len))
            sizes.append(len(blocks[-1]))
        starts = np.arange(0, len(ones), BLOCK)
        ranks.append(np.r_[0, np.cumsum(np.add.reduceat(ones, starts, dtype=np.int64))[:-1]] if len(ones) else np.zeros(0, np.int64))
        zeros.append(int(len(ones) - ones.sum()))
        cur = np.concatenate([cur[~ones], cur[ones]])
    docs = pack.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + counts.astype("<u8").tobytes())
    rank = pack.compress(np.concatenate(ranks).astype("<u8").tobytes())
    size = pack.compress(np.array(sizes, "<u4").tobytes())
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits_of, "part": part, "chunk": chunk, "zeros": zeros, "sections": [len(docs), len(rank), len(size)]}).encode()
    rest = len(head).to_bytes(4, "little") + head + docs + rank + size + b"".join(blocks)
    return MAGIC + len(rest).to_bytes(8, "little") + rest


def shards(content) -> Iterator[WaveletMatrix]:
    """The shards of one file."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if view[at : at + 1] == b"\n":
            at += 1
            continue
        if bytes(view[at : at + 4]) != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        n = int.from_bytes(view[at + 4 : at + 12], "little")
        if at + 12 + n > len(view):
            raise ValueError(f"the shard at byte {at} is cut short")
        yield WaveletMatrix(view[at + 12 : at + 12 + n])
        at += 12 + n


class WaveletMatrix:
    """A shard: ``access(i)``, ``rank(token, i)``, ``count(token)``, ``select(token, k)``, ``decode()``."""

    def __init__(self, view: memoryview):
        n = int.from_bytes(view[:4], "little")
        self.head = json.loads(bytes(view[4 : 4 + n]))
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        at, parts, self._zstd = 4 + n, [], zstandard.ZstdDecompressor()
        for size in self.head["sections"]:
            parts.append(self._zstd.decompress(view[at : at + size]))
            at += size
        d = self.head["docs"]
        null = np.frombuffer(parts[0], np.uint8, d, 8 * d)
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(parts[0], "<i8", d), null)]
        self.counts = np.frombuffer(parts[0], "<u8", d, 9 * d).astype(np.int64)
        self.per = -(-self.n // BLOCK)
        self.ranks = np.frombuffer(parts[1], "<u8").astype(np.int64).reshape(self.bits, self.per)
        sizes = np.frombuffer(parts[2], "<u4").astype(np.int64)
        self._at = at + np.r_[0, np.cumsum(sizes)]
        self._view, self._open = view, {}

    def _bytes(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per + block
        raw = self._view[self._at[k] : self._at[k + 1]]
        raw = raw[1:] if raw[0] == 0 else self._zstd.decompress(raw)
        return np.frombuffer(raw, np.uint8)

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self._open:
            if len(self._open) >= 256:
                self._open.clear()
            self._open[plane, block] = np.unpackbits(self._bytes(plane, block))
        return self._open[plane, block]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, at = divmod(i, BLOCK)
        return int(self.ranks[plane, block]) + int(self._block(plane, block)[:at].sum())

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, i // BLOCK)[i % BLOCK])
            ones = self._ones(plane, i)
            token = token << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, min(i, self.n)
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones(plane, low), self._ones(plane, high)
            low, high = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.bits - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def _select(self, plane: int, bit: int, k: int) -> int:
        before = self.ranks[plane] if bit else np.arange(self.per) * BLOCK - self.ranks[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(plane, block)[: self.n - block * BLOCK] == bit)[k - before[block]])

    def decode(self) -> np.ndarray:
        """All ids: planes are undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            bits = np.unpackbits(np.concatenate([self._bytes(plane, b) for b in range(self.per)]), count=self.n).astype(bool) if self.n else np.zeros(0, bool)
            up, z = np.empty(self.n, kind), self.zeros[plane]
            up[~bits] = cur[:z]
            up[bits] = cur[z:] | kind(1 << (self.bits - 1 - plane))
            cur = up
        return cur


def _writer(path: str, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        part, chunk, held = TaskContext.get().partitionId(), 0, []
        kind = pa.schema([("blob", pa.binary())])

        def close():
            nonlocal chunk, held
            ids = np.concatenate([x[0] for x in held])
            blob = build(ids, [d for x in held for d in x[1]], np.concatenate([x[2] for x in held]), part, chunk)
            held, chunk = [], chunk + 1
            return pa.record_batch([pa.array([blob], pa.binary())], schema=kind)

        size = 0
        for batch in batches:
            for s in slices(batch):
                ids, offs = Encoder.of(path).encode(s.column("text"))
                held.append((ids, s.column("doc_id").to_pylist(), np.diff(offs)))
                size += len(ids)
                if size >= shard_tokens:
                    yield close()
                    size = 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of ``docs`` (doc_id, text) as wavelet matrices, in ascending doc_id order over the shards.

    Null doc_ids come first; rows that repeat a doc_id follow each other by the hash of their text. Null or empty text is the
    end id alone. Documents are dealt by range of doc_id and that hash, so shards are written at once by many tasks, also where many rows have
    one id or none.
    """
    tokenizer = tokenizer or tokenizer_path()
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    write_blobs(ranged.mapInArrow(_writer(tokenizer, shard_tokens), "blob binary"), path)


def _reader(batches):
    names = ["part", "chunk", "nth", "doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for content in batch.column("content"):
            for w in shards(content.as_buffer()):
                ids, ends = w.decode(), np.cumsum(w.counts)
                d = len(w.counts)
                starts = ends - w.counts
                crcs = [crc(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.record_batch([pa.array([w.head["part"]] * d, pa.int64()), pa.array([w.head["chunk"]] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array(w.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(w.counts, pa.int64()), pa.array(crcs, pa.int64())], names=names)


def read_tokens(spark, path: str) -> DataFrame:
    """(part, chunk, nth, doc_id, start in its shard, n_tokens, ids_crc32) of every document in the files at ``path``."""
    return read_blobs(spark, path).mapInArrow(_reader, "part long, chunk long, nth long, doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns: ``docs`` written as shards and read back; ``start`` counts the ids of all documents before.

    An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "tokens")
    path = work.path("shards")
    write_tokens(docs, path, tokenizer)
    read = work.save(read_tokens(docs.sparkSession, path), "read")
    # one row per shard meets in the window: a few in a GB of text
    sums = read.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("size"))
    order = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "chunk", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    return read.join(sums, ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
