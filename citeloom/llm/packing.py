"""Packing documents into sequences of at most ``window`` tokens by Karmarkar-Karp multiway differencing.

A document is cut into full windows, each a sequence of its own, and a rest; the rest is cut into grains and a
last bit. Pieces gather in chunks of about ``bins`` windows. In a chunk every piece starts as a partial partition
with one loaded bin; the two partitions with the largest spread are merged, the fullest bin of one with the
emptiest of the other, until one partition is left, whose bins are the sequences. If any bin exceeds the
window, the window count rises by one and the differencing runs again.

Most of it happens in the task that tokenises, in bounded memory: a chunk never exceeds ``bins`` windows, and no key, source or copy
group can gather in one task. A task's last chunk, whose windows would not be full, is left over: the leftovers of all tasks (seven
numbers a piece, no text) are dealt by hash over as few tasks as hold ``DEAL`` windows each and are packed there in a second step, so
that padding does not grow with the number of input partitions. Sequence ids are the step, the
partition's number and a count in it, so a retried task gives the same ids.

Defined results: a null or empty text is one piece with only the end id; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns are ignored. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import pick, stored

WINDOW = 2048
GRAIN = 512
BINS = 128
DEAL = 1024
END_ID = 1
VOCABULARY = "byte_bpe_50k"


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """m bins of piece numbers with near-equal sums (largest differencing method)."""
    n = len(sizes)
    left, right = [np.full(n, -1)], [np.full(n, -1)]  # nodes of the merge forest; the first n are pieces
    count = n
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        sums, other = s1 + s2[::-1], n2[::-1]
        both = (n1 >= 0) & (other >= 0)
        nodes = np.where(n1 >= 0, n1, other)
        k = int(both.sum())
        if k:
            left.append(n1[both])
            right.append(other[both])
            nodes[both] = np.arange(count, count + k)
            count += k
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, nodes))
        tie += 1
    lo, hi = np.concatenate(left).tolist(), np.concatenate(right).tolist()
    out = []
    for root in heap[0][3].tolist() if heap else []:
        stack, found = [root] if root >= 0 else [], []
        while stack:
            x = stack.pop()
            if x < n:
                found.append(x)
            else:
                stack += (hi[x], lo[x])
        out.append(sorted(found))
    return out


def pack_chunk(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Bins of at most window tokens; each piece fits a window."""
    m = max(1, -(-sum(sizes) // window))
    while True:
        bins = differencing(sizes, m)
        if all(sum(sizes[i] for i in b) <= window for b in bins):
            return [b for b in bins if b]
        m += 1


def cuts(n: int, window: int = WINDOW, grain: int = GRAIN) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full windows, and of its other pieces."""
    full = [(s, window) for s in range(0, n - n % window, window)]
    at, rest = n - n % window, []
    while at < n:
        rest.append((at, min(grain, n - at)))
        at += rest[-1][1]
    return full, rest


def tokeniser(name: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Ids as the vocabulary's .json file gives them; the rank file of the same vocabulary yields them several times faster.

    A text with a special token's string goes to the .json tokeniser, which maps it to the special id.
    """
    import tiktoken
    from tokenizers import Tokenizer

    vocab = import_module("public_tokenizers")
    with open(vocab.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if "<|" in text:
            if not slow:
                slow.append(Tokenizer.from_file(vocab.path(f"{name}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return encode


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class _Chunks:
    """Pieces that wait for their chunk, and rows that are ready."""

    def __init__(self, window: int, bins: int, base: int):
        self.window, self.bins, self.base = window, bins, base
        self.used = self.load = 0
        self.waiting: list[tuple] = []
        self.ready: list[tuple] = []

    def whole(self, piece: tuple) -> None:
        self.ready.append((*piece, self.base + self.used, 0))
        self.used += 1

    def add(self, piece: tuple) -> None:
        if self.load + piece[2] > self.bins * self.window:
            self.close()
        self.waiting.append(piece)
        self.load += piece[2]

    def close(self) -> None:
        for b in pack_chunk([w[2] for w in self.waiting], self.window) if self.waiting else []:
            at = 0
            for i in b:
                self.ready.append((*self.waiting[i], self.base + self.used, at))
                at += self.waiting[i][2]
            self.used += 1
        self.waiting, self.load = [], 0

    def leave(self) -> None:
        """What waits goes out without a sequence."""
        self.ready += [(*w, None, None) for w in self.waiting]
        self.waiting, self.load = [], 0

    def rows(self) -> pa.RecordBatch:
        columns = zip(*self.ready, strict=True) if self.ready else [[]] * 7
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)
        self.ready = []
        return out


def packer(window: int, grain: int, bins: int, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokeniser(vocabulary)
        chunks = _Chunks(window, bins, TaskContext.get().partitionId() << 36)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                full, rest = cuts(len(ids), window, grain)
                piece = [(doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in full + rest]
                for p in piece[: len(full)]:
                    chunks.whole(p)
                for p in piece[len(full) :]:
                    chunks.add(p)
                if len(chunks.ready) >= 20_000:
                    yield chunks.rows()
        chunks.leave()
        yield chunks.rows()

    return run


def repacker(window: int, bins: int):
    """Packs pieces that are only numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(window, bins, (1 << 62) + (TaskContext.get().partitionId() << 36))
        for b in batches:
            for piece in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                chunks.add(piece)
            if len(chunks.ready) >= 20_000:
                yield chunks.rows()
        chunks.close()
        yield chunks.rows()

    return run


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    grain: int = GRAIN,
    bins: int = BINS,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence."""
    if not 0 < grain <= window:
        raise ValueError("a grain must fit a window")
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    first = stored(rows.mapInArrow(packer(window, grain, bins, vocabulary, end_id), SCHEMA), "pieces")
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, tokens // (DEAL * window))
    # a piece's place in its document tells copies apart as little as its id does, so equal rows are numbered by what reads them
    dealt = left.withColumn("turn", F.monotonically_increasing_id()).repartition(tasks, "turn").sortWithinPartitions("doc_id", "start", "ids_crc32", "turn")
    return first.where("sequence_id is not null").union(dealt.drop("turn").mapInArrow(repacker(window, bins), SCHEMA))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
