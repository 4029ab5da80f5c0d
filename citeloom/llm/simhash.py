"""SimHash near-duplicates with pigeonhole keys and pivot distance tables.

Fingerprints that differ in at most three bits are linked. Candidates share two of five bit blocks (three
flipped bits leave two blocks untouched). Inside a bucket a table of Hamming distances to fixed reference
fingerprints is computed once; by the triangle inequality a pair whose table rows differ by more than the
radius in any coordinate cannot be linked and is dropped before the XOR that verifies the rest. A bucket
with more than ``SPLIT`` fingerprints is dealt anew by five of eight blocks of its other 38 bits, which
bounds any bucket by 2^15 distinct fingerprints whatever the corpus holds; nothing is capped. A bucket gives a
spanning forest of its links, not all pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows come out
as often as they came in; rows whose doc_id is null take part, and a component's id is its smallest
non-null doc_id (null if it has none). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import batch_of, carried, carrying, pick, row_key, stored, text_bytes
from citeloom.llm.graph import components

RADIUS = 3
SPLIT = 2048
#: (shift, width) of the blocks that a key is made of.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot%d" % i) for i in range(12)], dtype=np.uint64)


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if set in more than half of the hashes of the k-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    if len(words) < k:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], seed) for s, e in spans], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, k: int = 3) -> DataFrame:
    """Adds fp long, the fingerprint of column text, and drops text; the other columns pass through."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in text_bytes(b.column(len(kept)))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(fps.view(np.int64))], names=[*kept, "fp"]
            )

    rows = rows.select(*kept, "text")
    schema = rows.select(*kept).schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


def _blocks(fp: Column, blocks: list[tuple[int, int]], take: int, tag: int) -> Column:
    """An array of keys: which blocks were taken, and their bits."""
    keys = []
    for i, chosen in enumerate(combinations(blocks, take)):
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(tag + i).alias("c"), fp.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*keys)


def _rest(taken: tuple) -> list[int]:
    """Masks of eight blocks of the bits outside the taken ones."""
    bits = [b for b in range(64) if not any(s <= b < s + w for s, w in taken)]
    cuts = np.array_split(np.array(bits), 8)
    return [sum(1 << int(b) for b in c) for c in cuts]


def _subkeys(fp: Column, c: Column) -> Column:
    """For a split bucket: five of eight blocks of the bits that its key leaves open."""
    out = None
    for i, taken in enumerate(combinations(BLOCKS, 2)):
        masks = []
        for chosen in combinations(_rest(taken), 5):
            m = sum(chosen)
            masks.append(m - ((m >> 63) << 64))
        arr = F.array(*[F.struct(F.lit(j).alias("s"), fp.bitwiseAND(F.lit(m)).alias("w")) for j, m in enumerate(masks)])
        out = F.when(c == i, arr) if out is None else out.when(c == i, arr)
    return out


def _forest(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span each group's linked fingerprints; rows are sorted by group."""
    n = len(fp)
    first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, n])
    left = np.repeat(start + size, size) - np.arange(n) - 1  # rows after this one in its group
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    parent = np.arange(n)
    edges: list[tuple[int, int]] = []
    rows, shift = np.flatnonzero(left >= 1), 1
    while len(rows):
        i, j = rows, rows + shift
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        for p in range(table.shape[1]):  # the pivot filter: each coordinate thins the pairs further
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        if near.any():
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                ra, rb = a, b
                while parent[ra] != ra:
                    ra = parent[ra]
                while parent[rb] != rb:
                    rb = parent[rb]
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        shift += 1
        rows = rows[left[rows] >= shift]
    return edges


def _bucket_links(radius: int):
    def run(batches):
        keep_fp, keep_g = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(fp, g):
            e = _forest(fp.view(np.uint64), g, radius)
            i, j = (np.array([x[k] for x in e], np.int64) for k in (0, 1))
            return batch_of(["a", "b"], [pa.int64()] * 2, [fp[i], fp[j]])

        for b in batches:
            fp = np.r_[keep_fp, b.column(0).to_numpy(zero_copy_only=False)]
            g = np.r_[keep_g, b.column(1).to_numpy(zero_copy_only=False)]
            if not len(fp):
                continue
            cut = int(np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[-1])  # the last group may go on
            keep_fp, keep_g = fp[cut:], g[cut:]
            if cut:
                yield done(fp[:cut], g[:cut])
        if len(keep_fp):
            yield done(keep_fp, keep_g)

    return run


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between distinct values of column fp that connect just what links of at most radius connect."""
    if radius > 3:
        raise ValueError("the keys hold for at most three bits")
    keyed = fps.select("fp", F.explode(_blocks(F.col("fp"), BLOCKS, 2, 0)).alias("key"))
    keyed = keyed.select("fp", F.col("key.c").alias("c"), F.col("key.v").alias("v"))
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    both = keyed.join(sizes, ["c", "v"])
    small = both.where(F.col("n") <= split).select("fp", F.xxhash64("c", "v").alias("g"))
    large = both.where(F.col("n") > split).select("fp", "c", "v", F.explode(_subkeys(F.col("fp"), F.col("c"))).alias("k"))
    large = large.select("fp", F.xxhash64("c", "v", "k.s", "k.w").alias("g"))
    grouped = small.union(large)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(n, "g").sortWithinPartitions("g", "fp").mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(rows: DataFrame, k: int = 3, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Rows (doc_id, text and any more) without text, plus fp and component_id, the smallest doc_id reachable over links."""
    rows = stored(fingerprints(rows, k), "fps")
    return rows.join(component_ids(rows, radius, split), "fp")


def component_ids(rows: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(fp, root long, component_id) for every distinct fp of rows (doc_id, fp)."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    comp = components(links(distinct, radius, split))
    rooted = distinct.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(of_root, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, k: int = 3, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with the columns of docs: the least by (doc_id, nulls last; hash of text).

    Of repeated rows (equal id and text) one stays.
    """
    keyed = pick(docs, doc_id="doc_id", text="text").select("doc_id", "text", *row_key())
    near = near_duplicates(keyed, k, radius)
    order = F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "_k1", "_k2")
    best = near.groupBy("root").agg(F.min(order).alias("b"), F.count("*").alias("n"))
    same = near.groupBy("_k1", "_k2").agg(F.count("*").alias("_same"))
    best = best.select("b._k1", "b._k2").join(same, ["_k1", "_k2"])
    packed = carrying(docs, "doc_id", "text")
    kept = packed.select("row", *row_key()).join(best, ["_k1", "_k2"])
    once = kept.where("_same = 1").select("row", "_k1", "_k2")
    return carried(once.union(kept.where("_same > 1").dropDuplicates(["_k1", "_k2"]).select("row", "_k1", "_k2")), docs)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = near_duplicates(pick(docs, doc_id="doc_id", text="text"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near.select("doc_id", hexed.alias("fingerprint"), "component_id")
