"""Exact top-k by integer inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; blocks of at most ``BLOCK`` vectors are
annuli of one pivot. With r the distance of a query to the pivot, a vector of the annulus [a, b] is at least
max(0, r - b, a - r) away (triangle inequality), so its inner product with the query is at most
(|q|^2 + |v|^2 - that^2) / 2. A query block first searches its most promising annuli, which gives a
floor for its k-th score; block pairs under the floor are dropped before any vector moves, and the rest
are expanded in order of their bound until it falls below what each query already holds. Pivots are the only
sample (``PIVOTS`` vectors, the first by hash); every vector is indexed and every pair is either scored or
excluded by the bound, so the result is exact.

Blocks keep any group bounded: a third of all vectors may be equal, they only fill more blocks. A query's
answers are k rows per block pair at most, merged by a top-k aggregate.

Defined results: vectors that are null or hold null or non-finite components take no part; a score beyond 64 bits becomes the nearest long; vectors meet only those of equal length; a query whose
length no other vector has gives no rows; ties go to the smaller vec_id; rows that repeat a vec_id are
vectors of their own, and a query among them is answered once for each such row (a null vec_id is
never a query and is ranked last among ties). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import pick, stored

PIVOTS = 16
BLOCK = 1024
QUERY_BLOCK = 256
SCALE = 256
TOP = 5
SLACK = 1e-9
_FAR = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, dim, x array<double>, whole numbers) of the vectors that take part; uid names the row."""
    rows = pick(vectors, vec_id="vec_id", e="embedding")
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  a double beyond 2^53 is whole
    most = 1.7976931348623157e308
    x = F.transform("e", lambda v: whole(F.greatest(F.least(F.lit(float(scale)) * v.cast("double"), F.lit(most)), F.lit(-most))))
    good = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = rows.where(F.col("e").isNotNull()).where(good)
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.size("e").alias("dim"), x.alias("x")
    )


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most n vectors, the first by hash, by their length."""
    got = vectors.select("dim", "x").orderBy(F.xxhash64("vec_id", "x"), "uid").limit(n).collect()
    return {d: np.array([r["x"] for r in got if r["dim"] == d], np.float64) for d in {r["dim"] for r in got}}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.float64)


def keyed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (the nearest pivot; the origin for lengths without one) and dist."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            cell, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = _matrix(b.column("x").take(pa.array(at)), int(d))
                p = pivots.get(int(d), np.zeros((1, int(d))))
                gap = np.maximum((m * m).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * m @ p.T, 0)
                cell[at] = gap.argmin(1)
                dist[at] = np.sqrt(gap.min(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])

    return vectors.mapInArrow(run, "uid long, vec_id long, dim int, x array<double>, cell int, dist double")


def _bytes(m: np.ndarray) -> bytes:
    """Four bytes a component where they hold all of them, else eight."""
    return (m.astype(np.int32) if not m.size or np.abs(m).max() < 2.0**31 else m).tobytes()


def _of_bytes(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _scores(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; those beyond 64 bits become the nearest long."""
    top = float(np.abs(m).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, m.shape[1])
    if top < 2.0**53:
        return np.rint(m @ x.T).astype(np.int64)
    if top < 2.0**63:
        return m.astype(np.int64) @ x.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(m) @ exact(x).T, 1 - _FAR, _FAR).astype(np.int64)


_BLOCKS = "block long, dim int, cell int, low double, high double, norm double, n int, uids binary, ids binary, x binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Annuli: runs of at most size rows of one (dim, cell) in order of dist, packed into one row each."""
    rows = rows.select("dim", "cell", "dist", "uid", F.coalesce("vec_id", F.lit(_FAR)).alias("vec_id"), "x")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "dim", "cell", "dist", "uid").sortWithinPartitions("dim", "cell", "dist", "uid")

    def run(batches):
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0

        def packed(part: pa.Table):
            nonlocal count
            dims, cells = part["dim"].to_numpy(), part["cell"].to_numpy()
            cut = np.flatnonzero((dims[1:] != dims[:-1]) | (cells[1:] != cells[:-1])) + 1
            out = []
            for a, z in zip(np.r_[0, cut], np.r_[cut, len(dims)], strict=True):
                for s in range(int(a), int(z), size):
                    p = part.slice(s, min(size, int(z) - s)).combine_chunks()
                    m = _matrix(p["x"].combine_chunks(), int(dims[s]))
                    dist = p["dist"].to_numpy()
                    out.append(
                        (base + count, int(dims[s]), int(cells[s]), dist[0], dist[-1], float((m * m).sum(1).max()), len(p),
                         p["uid"].to_numpy().tobytes(), p["vec_id"].to_numpy().tobytes(), _bytes(m))
                    )
                    count += 1
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.int32(), *[pa.binary()] * 3]
            cols = list(zip(*out, strict=True)) or [[]] * 10
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        held: list = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 8 * size:
                yield packed(pa.Table.from_batches(held))
                held = []
        if held:
            yield packed(pa.Table.from_batches(held))

    return stored(rows.mapInArrow(run, _BLOCKS), "blocks")


def _ranges(queries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """For each query block and pivot of its length: the range of its queries' distances to it."""

    def run(batches):
        for b in batches:
            out = []
            for qb, dim, n, x in zip(*(b.column(c).to_pylist() for c in ("block", "dim", "n", "x")), strict=True):
                m = _of_bytes(x, n, dim) if dim else np.zeros((1, 0))
                for i, p in enumerate(pivots.get(dim, np.zeros((1, dim)))):
                    r = np.sqrt(np.maximum(((m - p) ** 2).sum(1), 0))
                    out.append((qb, dim, i, float(r.min()), float(r.max())))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["qb", "dim", "cell", "near", "far"]
            )

    return queries.select("block", "dim", "n", "x").mapInArrow(run, "qb long, dim int, cell int, near double, far double")


def _search(pairs: DataFrame, index: DataFrame, queries: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """(qb, quid, query_id, vec_id, uid, score): each query's best k over the index blocks paired with its block."""
    q = queries.select(F.col("block").alias("qb"), "dim", F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    v = index.select(F.col("block").alias("vb"), "cell", "low", "high", "norm", "uids", "ids", "x")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.select("qb", "vb", "bound").join(v, "vb").join(q, "qb")
    both = both.repartition(parts, "qb").sortWithinPartitions("qb", F.desc("bound"), "vb")

    def run(batches):
        now, state = None, None

        def result():
            qid, quid, ids, uids, score, _, _ = state
            got = ids.shape[1]
            cols = [np.repeat(quid, got), np.repeat(qid, got), ids.ravel(), uids.ravel(), score.ravel()]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cols[0]), now)), *map(pa.array, cols)], names=["qb", "quid", "query_id", "vec_id", "uid", "score"]
            )

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("qb", "dim", "cell", "low", "high", "norm")}
                if r["qb"] != now:
                    if state is not None:
                        yield result()
                    now, dim = r["qb"], r["dim"]
                    quid = np.frombuffer(b.column("q_uids")[i].as_py(), np.int64)
                    qid = np.frombuffer(b.column("q_ids")[i].as_py(), np.int64)
                    m = _of_bytes(b.column("q_x")[i].as_py(), len(quid), dim)
                    p = pivots.get(dim, np.zeros((1, dim)))
                    gaps = np.sqrt(np.maximum((m * m).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * m @ p.T, 0))
                    none = np.zeros((len(quid), 0), np.int64)
                    state = (qid, quid, none, none, none, m, gaps)
                qid, quid, ids, uids, score, m, gaps = state
                away = np.maximum(np.maximum(gaps[:, r["cell"]] - r["high"], r["low"] - gaps[:, r["cell"]]), 0)
                both_norms = (m * m).sum(1) + r["norm"]
                best = (both_norms - away**2) / 2 + 1 + SLACK * both_norms  # more than rounding can take away
                live = ~(best < (score[:, k - 1] if score.shape[1] >= k else -np.inf))  # not a number: no bound
                if not live.any():
                    continue  # no annulus after this one need be opened for these queries either way
                vuid = np.frombuffer(b.column("uids")[i].as_py(), np.int64)
                vid = np.frombuffer(b.column("ids")[i].as_py(), np.int64)
                new = _scores(m, _of_bytes(b.column("x")[i].as_py(), len(vuid), m.shape[1]))
                low = -_FAR
                new[quid[:, None] == vuid[None]] = low
                alls = np.concatenate([score, new], axis=1)
                alli = np.concatenate([ids, np.broadcast_to(vid, new.shape)], axis=1)
                allu = np.concatenate([uids, np.broadcast_to(vuid, new.shape)], axis=1)
                if alls.shape[1] > k:  # rows over the k-th score first, so that the sort is of few
                    edge = -np.partition(-alls, k - 1, axis=1)[:, k - 1]
                    wide = int((alls >= edge[:, None]).sum(1).max())
                    if wide < alls.shape[1]:
                        top = np.argpartition(-alls, wide - 1, axis=1)[:, :wide]
                        alls, alli, allu = (np.take_along_axis(y, top, 1) for y in (alls, alli, allu))
                order = np.lexsort((allu, alli, -alls), axis=1)[:, :k]
                score, ids, uids = (np.take_along_axis(y, order, 1) for y in (alls, alli, allu))
                state = (qid, quid, ids, uids, score, m, gaps)
        if state is not None:
            yield result()

    found = both.mapInArrow(run, "qb long, quid long, query_id long, vec_id long, uid long, score long")
    return found.where(F.col("score") > -_FAR)


def search(
    vectors: DataFrame, is_query, k: int = TOP, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) where is_query holds, against all others."""
    base = stored(scaled(vectors), "vectors")
    chosen = choose_pivots(base, pivots)
    rows = stored(keyed(base, chosen), "keyed")
    index = blocks(rows, block)
    queries = blocks(rows.where(is_query & F.col("vec_id").isNotNull()), query_block)
    spans = _ranges(queries, chosen)
    q = queries.select(F.col("block").alias("qb"), F.col("norm").alias("q_norm"))
    away = F.greatest(F.col("near") - F.col("high"), F.col("low") - F.col("far"), F.lit(0.0))
    meta = index.select(F.col("block").alias("vb"), "dim", "cell", "low", "high", "norm", "n")
    norms = F.col("q_norm") + F.col("norm")
    bound = (norms - away * away) / 2 + 1 + norms * SLACK
    pairs = spans.join(q, "qb").join(meta, ["dim", "cell"]).select("qb", "vb", "n", bound.alias("bound"))
    pairs = stored(pairs, "pairs")
    order = Window.partitionBy("qb").orderBy(F.desc("bound"), "vb")
    first = pairs.withColumn("r", F.row_number().over(order)).where("r <= 2")
    seen = _search(first, index, queries, chosen, k)
    size = queries.select(F.col("block").alias("qb"), F.col("n").alias("n_q"))
    # the floor of a block is the least k-th score of its queries, if all of them have k
    kth = Window.partitionBy("quid").orderBy(F.desc("score"))
    floor = seen.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k)
    floor = floor.groupBy("qb").agg(F.min("score").alias("floor"), F.count("*").alias("got")).join(size, "qb").where("got = n_q")
    left = pairs.join(floor.select("qb", "floor"), "qb", "left").where("floor is null or bound >= floor")
    found = _search(left, index, queries, chosen, k)
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") < _FAR, F.col("vec_id")).alias("vec_id"), "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)
