"""Exact removal of long repeated substrings, by longest-previous-factor arrays over groups that anchors form.

Texts are UTF-8 bytes and matches have at least ``LENGTH`` bytes. A window is a string of LENGTH bytes; its anchor is
its least 64-byte gram by hash (leftmost among equals), so equal windows have equal anchors at equal offsets. The
windows in a row with one anchor form a site, whose context is all their bytes. Then, with no text moved:

* an anchor that occurs once has no repeated window;
* a context that occurs twice or more is repeated throughout.

Only sites whose anchor has other contexts are open. Their distinct contexts are cut from the texts and brought
together by anchor, where a suffix array is built over them. Scanning it with a stack of previous and next
smaller positions gives each window its longest previous factor (and, mirrored, its longest next one): LENGTH or more means
an earlier (later) copy. An anchor with more than ``HOT`` distinct contexts is not brought together: its windows
are counted by 128-bit hash instead, with partial sums, which finds the same. So no task holds an unbounded group.

``keep="none"`` removes every byte that a repeated window covers; ``keep="first"`` leaves each window's first occurrence
by (doc_id, nulls last; hash of the text; position).

Defined results: null and empty texts, and texts under LENGTH bytes, lose nothing; rows equal in doc_id and text are
copies of each other (with ``keep="first"`` they count as one document and stay or go together); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import pick, row_key, stored, text_bytes
from citeloom.llm.lines import maybe_in

LENGTH = 200
GRAM = 64
HOT = 4000
PIECE = 1 << 19  # window starts handled at a time; must stay under 2^20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each place."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(values)
    pad = -n % width
    v = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    right = np.minimum.accumulate(v, axis=1).ravel()
    left = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def find_sites(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Sites of texts that lie end to end: (text number, first window, windows, anchor hash) as arrays.

    ends: where each text ends. Windows never cross from a text to the next.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 20) - 1)
    places = np.arange(len(h), dtype=np.uint64)
    best = sliding_least((h & ~low) | places, length - gram + 1)
    at = (best & low).astype(np.int64)
    start = np.arange(len(at))
    text = np.searchsorted(ends, start, side="right")
    good = start + length <= ends[text]
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]] & good
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.r_[(new[1:] | ~good[1:]), True] & good) + 1
    return text[first], first, stop - first, h[at[first]]


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in order of the length bytes there (equal ones by place), and whether each equals the one before.

    Prefix doubling: ranks of 8 bytes, then of 16, 32 ... up to length.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    span = 8
    while span < length:
        step = min(span, length - span)
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        pair = rank * (n + 2) + follow
        span += step
        if span == length:
            pair = pair[starts]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    if len(rank) == n and span == 8:
        rank = rank[starts]
    order = np.argsort(rank, kind="stable")
    same = np.zeros(len(starts), bool)
    same[1:] = rank[order][1:] == rank[order][:-1]
    return order, same


def longest_previous_factors(order: list[int], lcp: list[int]) -> list[int]:
    """LPF of each place: the longest match of what starts there with what starts at a smaller place.

    order: places in suffix order; lcp[i]: common prefix of order[i-1] and order[i]. The stack holds, from each
    entry up, the previous smaller place in suffix order; a place that is popped has met its next smaller one.
    """
    out = [0] * (max(order, default=-1) + 1)
    stack: list[tuple[int, int]] = []
    for place, common in [*zip(order, lcp, strict=True), (-1, 0)]:
        while stack and place < stack[-1][0]:
            top, before = stack.pop()
            out[top] = max(before, common)
            common = min(before, common)
        stack.append((place, common))
    return out


def repeated(data: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: has what starts there an equal earlier, and an equal later, in the order of rank?

    rank: distinct numbers that order the starts.
    """
    order, same = suffix_order(data, starts, length)
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    among = same | np.r_[same[1:], False]  # the rest has no neighbour of common prefix length
    places, common = order[among], np.where(same[among], length, 0).tolist()
    if len(places):
        where = np.argsort(np.argsort(rank[places])).tolist()
        back = [len(where) - 1 - w for w in where]
        earlier[places] = np.array(longest_previous_factors(where, common))[where] >= length
        later[places] = np.array(longest_previous_factors(back, common))[back] >= length
    return earlier, later


def sites(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, _k1, _k2, ws, n, a, c): each site's first window, number of windows, anchor and context hash."""

    def made(part, out):
        data = np.frombuffer(b"".join(x for _, _, x in part), np.uint8)
        ends = np.cumsum([len(x) for _, _, x in part])
        text, first, n, a = find_sites(data, ends, length, gram)
        raw = data.tobytes()
        h = xxhash.xxh3_64_intdigest
        c = np.array([h(raw[s:e]) for s, e in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)], np.uint64)
        rows = np.array([r for r, _, _ in part], np.int64)
        shift = np.array([s for _, s, _ in part], np.int64) - np.r_[0, ends[:-1]]
        out.append((rows[text], first + shift[text], n, a.view(np.int64), c.view(np.int64)))

    def run(batches):
        for b in batches:
            out, part, load = [], [], 0
            for i, t in enumerate(text_bytes(b.column(3))):
                for s in range(0, max(len(t) - length + 1, 0), PIECE):
                    piece = t[s : s + PIECE + length - 1]
                    if load + len(piece) > PIECE + length and part:
                        made(part, out)
                        part, load = [], 0
                    part.append((i, s, piece))
                    load += len(piece)
            if part:
                made(part, out)
            if out:
                row, ws, n, a, c = (np.concatenate(x) for x in zip(*out, strict=True))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), *map(pa.array, (ws, n.astype(np.int32), a, c))],
                    names=["doc_id", "_k1", "_k2", "ws", "n", "a", "c"],
                )

    rows = docs.select("doc_id", "_k1", "_k2", "text")
    return stored(rows.mapInArrow(run, "doc_id long, _k1 long, _k2 int, ws long, n int, a long, c long"), "sites")



def _cut(docs: DataFrame, open_sites: DataFrame, length: int) -> DataFrame:
    """open_sites (a, c, m, times, at) with the bytes of their contexts, cut from the texts."""
    lists = open_sites.groupBy("at._k1", "at._k2").agg(F.collect_list(F.struct("a", "m", "times", "at")).alias("of"))
    lists = stored(lists, "open")
    thin, test = maybe_in(docs, "_k1", lists.select(F.col("_k1").alias("id")))
    texts = thin.where(test).select("_k1", "_k2", "text").join(lists, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])

    def run(batches):
        for b in batches:
            for t, of in zip(b.column(0), b.column(1), strict=True):
                raw = t.as_py().encode()
                of = of.values if hasattr(of, "values") else of
                rows = [(x["a"], x["m"], x["times"], x["at"]) for x in of.to_pylist()]
                bytes_ = [raw[p["ws"] : p["ws"] + p["n"] + length - 1] for *_, p in rows]
                cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], bytes_]
                types = [pa.int64(), pa.int64(), pa.int64(), of.type.field("at").type, pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["a", "m", "times", "at", "bytes"]
                )

    at = open_sites.schema["at"].dataType.simpleString()
    return stored(texts.select("text", "of").mapInArrow(run, f"a long, m long, times long, at {at}, bytes binary"), "contexts")


def _spans(flag: np.ndarray, base: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the flagged windows cover; base is the first window's place."""
    edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
    return [(base + int(s), base + int(e) - 1 + length) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def _group_marks(cut: DataFrame, length: int, first: bool) -> DataFrame:
    """(_k1, _k2, s, e) of what the suffix arrays of the anchors' contexts find."""

    def solve(rows):
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        begin = np.cumsum([0] + [len(r[3]) for r in rows[:-1]])
        starts = np.concatenate([b + np.arange(r[2]["n"]) for b, r in zip(begin.tolist(), rows, strict=True)])
        owner = np.repeat(np.arange(len(rows)), [r[2]["n"] for r in rows])
        at = [(r[2]["none"], r[2]["doc_id"] or 0, r[2]["_k1"], r[2]["_k2"], r[2]["ws"]) for r in rows]
        # windows come in the order of their document and place in it
        turn = np.empty(len(rows), np.int64)
        turn[sorted(range(len(rows)), key=at.__getitem__)] = np.arange(len(rows))
        rank = turn[owner] * (1 << 32) + (starts - begin[owner])
        earlier, later = repeated(data, starts, rank, length)
        hit = earlier if first else earlier | later
        out, k = [], 0
        for r in rows:
            n, p = r[2]["n"], r[2]
            if first or r[1] == 1:
                out += [(p["_k1"], p["_k2"], s, e) for s, e in _spans(hit[k : k + n], p["ws"], length)]
            k += n
        return out

    def batch(out):
        cols = list(zip(*out, strict=True)) or [[]] * 4
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["_k1", "_k2", "s", "e"])

    def run(batches):
        held, load = [], 0
        for b in batches:
            for a, times, at, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if load > PIECE and a != held[-1][0]:  # an anchor's contexts are never parted
                    yield batch(solve(held))
                    held, load = [], 0
                held.append((a, times, at, raw))
                load += len(raw)
        if held:
            yield batch(solve(held))

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.select("a", "times", "at", "bytes").repartition(parts, "a").sortWithinPartitions("a")
    return rows.mapInArrow(run, "_k1 long, _k2 int, s long, e long")


def _hot_marks(cut: DataFrame, length: int, first: bool) -> DataFrame:
    """The same for anchors with very many contexts, by counting hashes of windows."""

    def run(batches):
        h = xxhash.xxh3_128_intdigest
        for b in batches:
            for times, at, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = at["n"]
                d = [h(raw[i : i + length]) for i in range(n)]
                cols = [
                    pa.array([(x >> 64) - (1 << 63) for x in d], pa.int64()), pa.array([(x & ((1 << 64) - 1)) - (1 << 63) for x in d], pa.int64()),
                    pa.array([times] * n, pa.int64()), pa.array([at["none"]] * n, pa.bool_()), pa.array([at["doc_id"]] * n, pa.int64()),
                    pa.array([at["_k1"]] * n, pa.int64()), pa.array([at["_k2"]] * n, pa.int32()), pa.array(range(at["ws"], at["ws"] + n), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "times", "none", "doc_id", "_k1", "_k2", "s"])

    w = cut.select("times", "at", "bytes").mapInArrow(
        run, "x long, y long, times long, none boolean, doc_id long, _k1 long, _k2 int, s long"
    )
    place = F.struct("none", "doc_id", "_k1", "_k2", "s")
    if first:
        w = stored(w, "windows")
        least = w.groupBy("x", "y").agg(F.min(place).alias("least"), F.count("*").alias("k")).where("k > 1")
        hit = w.join(least, ["x", "y"]).where(place != F.col("least"))
    else:
        w = stored(w, "windows")
        many = w.groupBy("x", "y").agg(F.count("*").alias("k")).where("k > 1").select("x", "y")
        hit = w.where("times = 1").join(many, ["x", "y"])
    return hit.select("_k1", "_k2", "s", (F.col("s") + length).alias("e"))


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: str = "none") -> DataFrame:
    """(_k1, _k2, spans): byte ranges to remove of each document (doc_id, text, _k1, _k2); they may overlap."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    first = keep == "first"
    all_sites = sites(docs, length, gram)
    anchors = all_sites.groupBy("a").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1")
    anchors = stored(anchors.select("a", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    thin, test = maybe_in(all_sites, "a", anchors.select(F.col("a").alias("id")))
    shared = thin.where(test).drop("_part", "_map", "_at").join(anchors, "a")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2", "ws", "n")
    shared = stored(shared.select("a", "c", "mixed", place.alias("at")), "shared")
    end = F.col("at.ws") + F.col("at.n") - 1 + length
    span = [F.col("at._k1"), F.col("at._k2"), F.col("at.ws").alias("s"), end.alias("e")]
    if first:
        contexts = shared.groupBy("a", "c", "mixed").agg(F.count("*").alias("times"), F.min("at").alias("least"))
        contexts = stored(contexts, "classes")
        whole = shared.join(contexts.where("times > 1").drop("mixed"), ["a", "c"]).where("at <> least").select(*span)
        open_sites = contexts.where("mixed").select("a", "c", "times", F.col("least").alias("at"))
    else:
        mixed = shared.where("mixed")
        contexts = stored(mixed.groupBy("a", "c").agg(F.count("*").alias("times"), F.min("at").alias("at")), "classes")
        again = mixed.join(contexts.where("times > 1").select("a", "c"), ["a", "c"])
        whole = shared.where("not mixed").select(*span).union(again.select(*span))
        open_sites = contexts
    sizes = open_sites.groupBy("a").agg(F.count("*").alias("m"))
    cut = _cut(docs, open_sites.join(sizes, "a"), length)
    marks = _group_marks(cut.where(F.col("m") <= hot), length, first).union(_hot_marks(cut.where(F.col("m") > hot), length, first))
    spans = whole.union(marks).distinct()
    return spans.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: str = "first") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of docs (doc_id, text).

    kept is the text without the removed bytes (a character that is cut becomes U+FFFD); the hash is of the bytes.
    """
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", "text", *row_key())
    spans = stored(removed_spans(rows, length, gram, hot, keep), "spans")
    thin, test = maybe_in(rows, "_k1", spans.select(F.col("_k1").alias("id")))
    cols = ["doc_id", "text", "spans"]
    hit = thin.where(test).drop("_part", "_map", "_at").join(spans, ["_k1", "_k2"], "left").select(cols)
    rest = thin.where(~test).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def run(batches):
        for b in batches:
            out = []
            for t, of in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                gone = merge([(x["s"], x["e"]) for x in of or []])
                kept, at = [], 0
                for s, e in gone:
                    kept.append(t[at:s])
                    at = e
                left = b"".join([*kept, t[at:]])
                out.append((len(t), len(t) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return hit.union(rest).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs, keep="none").drop("kept")
