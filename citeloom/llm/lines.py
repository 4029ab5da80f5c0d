"""Fuzzy line dedup in DataFrame operations only: shared anchors, SimHash, edit similarity, components.

A line is normalised (lower case, punctuation to spaces, runs of space to one); lines with equal norms are one
node. Two nodes are linked if they are candidates and their norms' edit similarity (1 - distance / longer length) is 0.8 or more.

Candidates share an anchor. By the pigeonhole principle a few edits leave most stretches of a line whole; anchors are
two neighbours among the eight least hashes of its runs of three words; lines of few words have the same of runs of six
characters, and lines below ten characters themselves and all they are with one character left out. Blocks of a SimHash,
with which the method was named, do not serve as keys: lines of edit similarity 0.8 differ in up to 22 of 64 bits, and blocks forgive
three. The SimHash of all words instead thins the candidates: more than ``RADIUS`` different bits end a pair before
its edit distance is computed, where both lines have ``FEW`` words or more. Of few words a fingerprint says little; there a
bitmap of the line's pairs of neighbouring characters does it without any loss, repeats counted (the second "th" has a bit of its own): an edit takes
away two pairs at most, so k edits leave at most 2 k bits of one line unset in the other. Lines of more than ``MAPPED`` characters have no bitmap and pass.
Lines that share a long passage pass both; most of them differ too much near one of their ends already, which ends a pair without loss as well
(``_ends_allow``).

In a bucket every node is compared with one of its nodes; the
components of these links are found, and then only members of different components of a bucket are compared, so a bucket of
thousands of variants costs about one comparison each, and components come out exactly
as if all pairs had been compared. What many members of a bucket share without being similar, as a passage in different lines, is still
compared pair by pair, which grows with the square of their number; such a bucket is dealt over tasks in blocks, and only pairs that the ends allow
become rows. Of each connected group one line stays: the first by
(doc_id, nulls last; hash of the text; position). Lines without a letter or digit always stay.

What is broadcast is a bitmap of at most 2^27 bits, which only thins what a join then decides.

Defined results: a null or empty text has no removable line and comes out as an empty text; rows equal in doc_id and
text count as one document and get the same result; a table without rows gives none; other columns may have any names and pass through.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import carried, carrying, dropped, row_key, stored
from citeloom.llm.graph import components
from citeloom.llm.quality import let

SIMILARITY = 0.8
PUNCTUATION = "\t\x0b\x0c\r.,;:!?\"'()[]{}|*#$%&<>-_/\\=+~^`@"
#: Least hashes a line keeps; from so many words on it has runs of words, below so many runs of characters, below TINY characters omissions.
LEAST, WORDS, FEW, TINY = 8, 5, 13, 10
#: Words of a run, characters of a run, and bits in which the fingerprints of a candidate pair may differ.
RUN, GRAM, RADIUS = 3, 6, 20
#: Bits of a sum, longs of a bitmap of character pairs, and characters of a line up to which it has one.
LANE, MAPS, MAPPED = 31, 16, 512
MAX_BITS = 27
#: Lengths of ends that are compared before whole lines, as (a, b, c) for a * edits + b * lengths' difference + c.
ENDS = ((2.0, -2.0, 20), (1.5, 0.0, 0))
#: Characters of a line up to which its text goes into its buckets, and members of a bucket that meet in one block.
CARRIED, BLOCK = 2_000, 128
#: Pairs whose texts are on disk at once: so many a node, and so many at least.
AT_ONCE, AT_LEAST = 2, 500_000
#: Occurrences of a group from which on its rows are dealt over SALTS tasks.
HOT, SALTS = 2_000, 64


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, _k1, _k2, pos, id, norm) of every line with a letter or digit, stored."""
    flat = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[ {re.escape(PUNCTUATION)}]+", " ")
    rows = docs.select("doc_id", *row_key(), F.posexplode(F.split(flat, "\n")).alias("pos", "line"))
    norm = F.trim("line")
    rows = rows.select("doc_id", "_k1", "_k2", "pos", norm.alias("norm")).where("norm <> ''")
    return stored(rows.select("doc_id", "_k1", "_k2", "pos", F.xxhash64("norm").alias("id"), "norm"), "lines")


def _least_pairs(parts: DataFrame, width: int) -> DataFrame:
    """(id, keys) of rows (id, part), part an array: two neighbours among the least hashes of runs of width elements.

    The hashes fall into LEAST classes by their last bits and each class keeps its least; neighbours skip empty classes. Rows are
    exploded, so that hashes and minima stay in generated code, and copies of a line are one row after the first sums.
    """
    runs = parts.where(F.size("part") >= width).select("id", "part", F.posexplode("part").alias("i", "first"))
    runs = runs.where(F.col("i") <= F.size("part") - width)
    h = F.xxhash64("first", *[F.get("part", F.col("i") + j) for j in range(1, width)])
    runs = runs.select("id", h.alias("h"))
    kind = F.col("h").bitwiseAND(F.lit(LEAST - 1))
    least = runs.groupBy("id").agg(*[F.min(F.when(kind == j, F.col("h"))).alias(f"m{j}") for j in range(LEAST)])
    some = F.array_compact(F.array(*[f"m{j}" for j in range(LEAST)]))
    pairs = lambda m: F.when(F.size(m) == 1, m).otherwise(F.zip_with(F.slice(m, F.lit(2), F.size(m)), F.slice(m, F.lit(1), F.size(m) - 1), lambda x, y: F.xxhash64(x, y)))
    return least.select("id", let(some, pairs).alias("keys"))


def anchors(lines: DataFrame) -> DataFrame:
    """(id, keys) of the nodes, stored; a node may have several rows."""
    norm = F.col("norm")
    words = lines.select("id", F.split("norm", " ").alias("part"))
    by_words = _least_pairs(words.where(F.size("part") >= WORDS), RUN)
    few = words.where(F.size("part") < FEW).select("id", F.split(F.array_join("part", " "), "").alias("part"))
    by_chars = _least_pairs(few, GRAM)
    without = lambda i: F.xxhash64(F.concat(F.substring(norm, F.lit(1), i), F.substring(norm, i + 2, F.lit(TINY))))
    tiny = lines.where(F.length("norm") < TINY).select("id", F.concat(F.array(F.xxhash64("norm")), F.transform(F.sequence(F.lit(0), F.length("norm") - 1), without)).alias("keys"))
    return stored(by_words.union(by_chars).union(tiny.distinct()), "anchors")


def fingerprints(norms: DataFrame) -> DataFrame:
    """(id, size, words, fp, g) of each distinct line: its code points, its words, and 62 bits, each set if set in more than half of the words' hashes.

    Bits are summed two to a long, which stays in generated code and holds for lines of any length. g are the longs of
    the bitmap of character pairs of a line of few words; null for others. A pair's number among its equals is told by their order.
    """
    ones = 1 | (1 << LANE)
    split = norms.select("id", F.length("norm").alias("size"), F.split("norm", " ").alias("part"))
    words = split.select("id", "size", F.explode("part").alias("w")).select("id", "size", F.xxhash64("w").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(ones))).alias(f"s{j}") for j in range(LANE)]
    per = words.groupBy("id", "size").agg(F.count("*").alias("n"), *sums)
    low = (1 << LANE) - 1
    fp = F.lit(0).cast("long")
    for j in range(LANE):
        for lane in (0, 1):
            of = F.shiftright(f"s{j}", LANE * lane).bitwiseAND(F.lit(low)) if lane == 0 else F.shiftrightunsigned(f"s{j}", LANE)
            fp = fp.bitwiseOR(F.when(of * 2 > F.col("n"), F.lit(1 << (j + LANE * lane))).otherwise(F.lit(0).cast("long")))
    few = split.where((F.size("part") < FEW) & F.col("size").between(2, MAPPED)).select("id", F.split(F.array_join("part", " "), "").alias("c"))
    two = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda x, y: F.concat(x, y))
    few = few.select("id", F.sort_array(two).alias("two")).select("id", "two", F.posexplode("two").alias("i", "pair"))
    few = few.select("id", F.xxhash64("pair", F.col("i") - F.array_position("two", F.col("pair"))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    maps = [F.bit_or(F.when(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(MAPS - 1)) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"g{j}") for j in range(MAPS)]
    grams = few.groupBy("id").agg(*maps).select(F.col("id").alias("few"), F.array(*[f"g{j}" for j in range(MAPS)]).alias("g"))
    own = per.select("id", "size", F.col("n").alias("words"), fp.alias("fp"))
    return own.join(grams, F.col("id") == F.col("few"), "left").drop("few")


def _bitmap(ids: DataFrame) -> tuple[DataFrame, int]:
    """Which of 2^bits hash values the longs of column id have; 2^bits is about 16 a row, 2^27 at most."""
    bits = max(15, min(MAX_BITS, (16 * max(1, ids.count())).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    return ids.select(F.shiftright(at, 15).alias("_part"), at.bitwiseAND(F.lit(32767)).alias("at")).groupBy("_part").agg(
        F.bitmap_construct_agg("at").alias("_map")
    ), bits


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """rows with a condition that holds for every row whose key is among ids (and for a few others)."""
    table, bits = _bitmap(ids)
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    low = at.bitwiseAND(F.lit(32767)).cast("int")
    rows = rows.withColumn("_at", low).join(
        F.broadcast(table), F.shiftright(at, 15) == F.col("_part"), "left"
    )  # at most 2^12 rows of 4 KB
    bit = F.expr("shiftright(cast(conv(hex(substring(_map, shiftright(_at, 3) + 1, 1)), 16, 10) as int), _at & 7) & 1")
    return rows, F.coalesce(bit, F.lit(0)) == 1


def _near(sa: str, sb: str, similarity: float = SIMILARITY) -> Column:
    """Lengths that the edit similarity allows."""
    longest = F.greatest(F.col(sa), F.col(sb))
    return F.abs(F.col(sa) - F.col(sb)) <= F.floor(longest * F.lit(1 - similarity) + F.lit(1e-9))


def _most(one: Column, other: Column, similarity: float) -> Column:
    """Edits that two lengths allow."""
    return F.floor(F.greatest(one, other) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def _ends_allow(a: Column, b: Column, most: Column) -> Column:
    """False only for strings with more than ``most`` edits between them, and for most of these.

    An edit distance never grows where both strings lose as many characters at their ends, or at their starts (it never falls along a diagonal
    of its table). So starts and ends of suitable lengths are compared, shorter ones first, which costs a part of the whole table.
    """
    apart, least = F.abs(F.length(a) - F.length(b)), F.least(F.length(a), F.length(b))
    allowed = F.lit(True)
    for edits, less, more in ENDS:
        lost = F.greatest(F.lit(0), least - F.ceil(most * F.lit(edits) + apart * F.lit(less)).cast("int") - F.lit(more))
        start = lambda x: F.substring(x, F.lit(1), F.length(x) - lost)  # noqa: E731, B023
        end = lambda x: F.substring(x, lost + 1, F.length(x))  # noqa: E731, B023
        for part in (start, end):
            allowed = allowed & (F.call_function("levenshtein", part(a), part(b), most) >= 0)
    return allowed


def _shared(a: Column, b: Column, at_end: bool) -> Column:
    """How many characters two different strings begin (end) with in common: a binary search over substrings."""
    part = (lambda x, n: F.substring(x, -n, n)) if at_end else (lambda x, n: F.substring(x, F.lit(1), n))
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(29, -1, -1)]), lambda step: step <= F.length(a))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(part(a, n + step) == part(b, n + step), n + step).otherwise(n))


def _within(a: Column, b: Column, most: Column) -> Column:
    """Is the edit distance of two different strings at most ``most``?

    What both begin and end with costs no edits, so only the middles are compared. Similar lines are mostly found by an edit
    script over words, whose cost is never below the distance and which is far cheaper: equal words go on in both, a
    word that the other side's next one equals is inserted or left out, and other words are exchanged. Only where the script costs too
    much the whole distance decides. The steps are bound by ``let``: as columns of their own the optimiser would write each into the next.
    """
    bound = lambda x, y, k: F.struct(x.alias("a"), y.alias("b"), k.alias("most"))
    after = lambda x, n: F.substring(x, n + 1, F.length(x))
    until = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    state = lambda i, j, cost: F.struct(i.alias("i"), j.alias("j"), cost.alias("cost"))
    long = lambda word: F.coalesce(F.length(word), F.lit(0)) + 1

    def script(w: Column) -> Column:
        """(i, j, cost) goes on until both lists of words end or it costs too much."""

        def step(s: Column, _: Column) -> Column:
            p, q = F.get(w["a"], s["i"]), F.get(w["b"], s["j"])
            drop, add = F.get(w["a"], s["i"] + 1) == q, p == F.get(w["b"], s["j"] + 1)
            return (
                F.when(s["cost"] > w["most"], s).when(p == q, state(s["i"] + 1, s["j"] + 1, s["cost"])).when(p.isNull() & q.isNull(), s)
                .when(q.isNull() | drop, state(s["i"] + 1, s["j"], s["cost"] + long(p)))
                .when(p.isNull() | add, state(s["i"], s["j"] + 1, s["cost"] + long(q)))
                .otherwise(state(s["i"] + 1, s["j"] + 1, s["cost"] + F.levenshtein(p, q)))
            )

        steps = F.sequence(F.lit(1), F.size(w["a"]) + F.size(w["b"]))
        return F.aggregate(steps, state(F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["cost"]) <= w["most"]

    def decide(x: Column) -> Column:
        short = F.greatest(F.length(x["a"]), F.length(x["b"])) <= x["most"]  # exchanging all of the middle is cheap enough
        return short | let(bound(F.split(x["a"], " "), F.split(x["b"], " "), x["most"]), script) | (
            _ends_allow(x["a"], x["b"], x["most"]) & (F.call_function("levenshtein", x["a"], x["b"], x["most"]) >= 0)
        )

    def tail(x: Column) -> Column:
        return let(_shared(x["a"], x["b"], True), lambda n: let(bound(until(x["a"], n), until(x["b"], n), x["most"]), decide))

    return let(_shared(a, b, False), lambda n: let(bound(after(a, n), after(b, n), most), tail))


def buckets(lines: DataFrame) -> DataFrame:
    """(key, id, rep): each node under its keys that other nodes share, with one node of the bucket, which is its own rep.

    The rep is the least by an order that differs from key to key, so that a dense group meets several. Counting comes first, with partial
    sums, so that copies and unique keys never gather; only rows of shared keys are brought together.
    """
    turned = F.col("id").bitwiseXOR(F.xxhash64("key"))
    keyed = anchors(lines).select("id", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min(turned).alias("least"), F.max(turned).alias("most")).where("least <> most")
    shared = stored(ends.select("key", F.col("least").bitwiseXOR(F.xxhash64("key")).alias("rep")), "shared")
    thin, test = maybe_in(keyed, "key", shared.select(F.col("key").alias("id")))
    return stored(thin.where(test).select("key", "id").distinct().join(shared, "key"), "buckets")


def _similar(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose norms are similar enough; pairs and norms are stored tables.

    Two texts a pair are far more than the pair, and pairs grow faster than the input. So they are taken in turns of about ``AT_ONCE``
    pairs a node, and the shuffle files of a turn go with its end.
    """
    turns = max(1, math.ceil(pairs.count() / max(AT_LEAST, AT_ONCE * norms.count())))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
    return reduce(DataFrame.union, [_similar_of(pairs.where(turn == i) if turns > 1 else pairs, norms, similarity) for i in range(turns)])


def _similar_of(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    left, right = norms.toDF("a", "na"), norms.toDF("b", "nb")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(left, "a").join(right, "b").repartition(parts, "a", "b")  # small in bytes, not in work: neither coalesced nor led by a node of many pairs
    most = _most(F.length("na"), F.length("nb"), similarity)
    return stored(both.where(_within(F.col("na"), F.col("nb"), most)).select("a", "b"), "links")


def _promising(one: str, other: str, similarity: float) -> Column:
    """Lengths and fingerprints that do not speak against a pair."""
    apart = F.bit_count(F.col(f"{one}.fp").bitwiseXOR(F.col(f"{other}.fp"))) > RADIUS
    few = F.least(F.col(f"{one}.words"), F.col(f"{other}.words")) < FEW
    most = 2 * F.floor(F.greatest(F.col(f"{one}.size"), F.col(f"{other}.size")) * F.lit(1 - similarity) + F.lit(1e-9))
    lost = lambda x, y: sum(F.bit_count(F.get(f"{x}.g", F.lit(j)).bitwiseAND(F.bitwise_not(F.get(f"{y}.g", F.lit(j))))) for j in range(MAPS))
    unlike = F.coalesce(F.greatest(lost(one, other), lost(other, one)) > most, F.lit(False))  # null: no bitmap
    return _near(f"{one}.size", f"{other}.size", similarity) & F.when(few, ~unlike).otherwise(~apart)


def _apart_in_buckets(open_: DataFrame, light: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """(id1, id2) of members of different components of a bucket whose fingerprints and ends allow them; each pair once, under the least key they share.

    A bucket's members are dealt into blocks of about ``BLOCK``, and each two blocks meet in a task of their own. Of two components one at least is
    not the rep's, which is where most of a dense bucket is.
    """
    keys = open_.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    text = norms.select("id", F.when(F.length("norm") <= CARRIED, F.col("norm")).alias("norm"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    split = open_.groupBy("key").agg(blocks(F.count_if(~F.col("in_main"))).alias("n1"), blocks(F.count("*")).alias("n2"))
    rows = open_.join(split, "key").join(keys, "id").join(light, "id").join(text, "id")
    own = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "id", "root", "in_main", "keys", "x", "norm"]
    one = rows.where(~F.col("in_main")).select(*cols, own("n1").alias("i"), every("n2").alias("j"))
    two = rows.select(*cols, every("n1").alias("i"), own("n2").alias("j"))
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = lambda d, k: d.toDF("key", *[f"{c}{k}" for c in cols[1:]], "i", "j").repartition(parts, "key", "i", "j")  # noqa: E731  by work, not by bytes
    once = (F.col("in_main2") | (F.col("id1") < F.col("id2"))) & (F.col("root1") != F.col("root2"))
    least = F.col("key") == F.array_min(F.array_intersect("keys1", "keys2"))
    ends = F.coalesce(_ends_allow(F.col("norm1"), F.col("norm2"), _most(F.col("x1.size"), F.col("x2.size"), similarity)), F.lit(True))  # null: too long to be carried
    return named(one, 1).join(named(two, 2), ["key", "i", "j"]).where(once & _promising("x1", "x2", similarity) & least & ends).select("id1", "id2")


def links(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) that connect just the nodes that links connect."""
    b = buckets(lines)
    ids = stored(b.select("id").distinct(), "ids")
    thin, test = maybe_in(lines.select("id", "norm"), "id", ids)
    norms = stored(thin.where(test).select("id", "norm").join(ids, "id").dropDuplicates(["id"]), "norms")
    f = stored(fingerprints(norms), "line-fps")
    light = f.select("id", F.struct("size", "words", "fp", "g").alias("x"))
    pair = [F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")]
    with_rep = b.where("id <> rep").select(F.col("rep").alias("id1"), F.col("id").alias("id2")).distinct()
    with_rep = with_rep.join(light.toDF("id1", "x1"), "id1").join(light.toDF("id2", "x2"), "id2").where(_promising("x1", "x2", similarity))
    near = stored(with_rep.select(*pair).distinct(), "pairs")
    first = _similar(near, norms, similarity)
    # what is connected by now needs no more links: only members of different components of a bucket meet
    comp = stored(components(first), "parts")
    placed = b.join(comp, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"), (F.col("id") == F.col("rep")).alias("is_rep"))
    placed = stored(placed, "placed")
    main = F.max(F.when(F.col("is_rep"), F.col("root"))).alias("main")
    loose = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), main).where("lo <> hi and n > 2").select("key", "main")
    open_ = stored(placed.join(loose, "key").select("key", "id", "root", (F.col("root") == F.col("main")).alias("in_main")), "open")
    far = stored(_apart_in_buckets(open_, light, norms, similarity).select(*pair).distinct(), "pairs")
    second = _similar(far, norms, similarity)
    dropped(b, ids, norms, f, placed, open_, near, far)
    return first.union(second)


def removed_lines(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(_k1, _k2, gone): positions of each document's lines that are not their group's first occurrence."""
    comp = components(links(lines, similarity))
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2", "pos").alias("at")
    thin, test = maybe_in(lines.select("id", at), "id", comp.select(F.col("node").alias("id")))
    some, rest = thin.where(test).select("id", "at"), thin.where(~test).select("id", "at")
    some = some.join(comp, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("id"), "at")
    occ = stored(some.union(rest), "groups")
    first = occ.groupBy("id").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
    first = stored(first, "firsts")
    # a group with very many occurrences is dealt over tasks; both sides ask the same bitmap
    hot = first.where(F.col("n") > HOT).select("id")
    few, hit = maybe_in(occ, "id", hot)
    few = few.select("id", "at", F.when(hit, F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    top, hit = maybe_in(first.select("id", "first"), "id", hot)
    top = top.select("id", "first", F.explode(F.when(hit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    gone = few.join(top, ["id", "salt"]).where("at <> first").select("at._k1", "at._k2", "at.pos")
    return gone.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("gone"))


def cut(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, text, lines, removed) of each row of docs: its columns, its text cut down to the lines that stay, and counts of lines."""
    packed = carrying(docs, "doc_id", "text")
    lines = occurrences(packed)
    gone = stored(removed_lines(lines, similarity), "gone")
    keyed, test = maybe_in(packed.select("*", *row_key()), "_k1", gone.select(F.col("_k1").alias("id")))
    text = F.coalesce("text", F.lit(""))
    count = F.size(F.split(text, "\n")).cast("long").alias("lines")
    same = keyed.where(~test).select("row", text.alias("text"), count, F.lit(0).cast("long").alias("removed"))
    hit = keyed.where(test).select("row", "text", "_k1", "_k2").join(gone, ["_k1", "_k2"], "left")
    kept = let(
        F.split(text, "\n"),
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"
        ),
    )
    new = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return same.union(hit.select("row", new.alias("text"), count, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed")))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with its columns, text cut down to the lines that stay."""
    return carried(cut(docs, similarity), docs, text=F.col("text"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut(docs).select(
        "row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with cut texts and n_chars, if there, to match; documents whose every line went are dropped.

    A document that had no removable line at all stays as it is.
    """
    d = cut(docs).where(~((F.col("removed") > 0) & (F.translate("text", PUNCTUATION + "\n ", "") == "")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return carried(d, docs, **new)
