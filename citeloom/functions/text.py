"""Text expressions: folding, tokens, title keys, stems. All are built-in Spark functions but the folding of any script."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MAX_QUERY = 4096
PARTICLES = ("the", "of", "and", "a", "an", "de", "del", "la", "los", "y")
TYPE_WORDS = (
    "act", "acts", "adjournal", "byelaws", "bylaws", "code", "declaration", "determination", "direction",
    "directions", "instrument", "measure", "order", "orders", "regulation", "regulations", "resolution", "rule",
    "rules", "scheme", "schemes", "sederunt", "statute", "warrant",
)
ACRONYM_SKIP = (
    *("the", "of", "and", "a", "an", "at", "for", "to", "in", "on", "with", "etc", "from", "by"),
    *("against", "into", "under", "upon", "or"),
)
STOP = tuple(
    sorted(
        {
            *("a", "an", "the", "this", "that", "these", "those", "such", "it", "its", "they", "them", "their", "who", "whom"),
            *("and", "or", "not", "if", "than", "then", "there", "so"),
            *("at", "by", "for", "from", "in", "into", "of", "on", "to", "under", "upon", "with", "as"),
            *("am", "is", "are", "was", "were", "be", "been", "being", "has", "have", "does", "do", "did"),
            *("any", "but", "can", "may", "must", "shall", "should", "will", "would", "what", "when", "where", "which", "why", "how"),
        }
        - {"am", "so"}
    )
)
#: In the order in which they are tried; what is left must have four letters.
SUFFIXES = (
    "ational", "ations", "ation", "atory", "ments", "ment", "ions", "ion", "ings", "ing", "ies", "ied", "ed", "ory", "ive", "y",
)
IRREGULAR = {"children": "child", "men": "man", "people": "person", "women": "woman"}
YEAR = r"(1[2-9][0-9]{2}|20[0-9]{2})"


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case, white space to spaces: what folding does to ASCII text."""
    return F.translate(F.lower(text), "\t\n\r\x0b\x0c", "     ")


_DASHES = "‐‑‒–—―−﹘﹣－"
_SINGLE, _DOUBLE = "‘’‚‛′", "“”„‟″"
#: Cyrillic, Greek and Latin letters that look like plain ones.
_ALIKE = dict(
    zip(
        "авекмнорстухіјѕԁɡһӏ"
        "αορεικντυχ",
        "abekmhopctyxijsdghlaopeikvtux",
        strict=True,
    )
)


@lru_cache(maxsize=8192)
def fold_letter(ch: str) -> str:
    for group, plain in ((_DASHES, "-"), (_SINGLE, "'"), (_DOUBLE, '"')):
        if ch in group:
            return plain
    if ch.isspace():
        return " "
    parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch).casefold())
    return "".join(_ALIKE.get(c, c) for c in parts if not unicodedata.combining(c))


@lru_cache(maxsize=8192)
def _simple_letter(ch: str) -> str | None:
    """What folding leaves of a letter that becomes one letter, else null."""
    got = fold_letter(ch)
    return got if len(got) == 1 else None


def _folded(text: str) -> tuple[str, np.ndarray]:
    """Folded text and its places as 32-bit integers; letters are looked up once for each kind."""
    kinds = {c: _simple_letter(c) for c in set(text)}
    if None not in kinds.values():
        return text.translate({ord(c): p for c, p in kinds.items() if c != p}), np.arange(len(text), dtype=np.int32)
    pieces = [fold_letter(c) for c in text]
    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
    return "".join(pieces), np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)


def fold_string(text: str) -> tuple[str, list[int]]:
    """Folded text and, for each of its characters, the place in text it came from."""
    folded, origin = _folded(text)
    return folded, origin.tolist()


def _folded_all(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    folded, places, ends = [], [np.empty(0, np.int32)], [0]
    for t in texts:
        f, origin = _folded(t) if t is not None else (None, places[0])
        folded.append(f)
        places.append(origin)
        ends.append(ends[-1] + len(origin))
    absent = pa.array(np.array([t is None for t in texts], bool))
    return pa.array(folded, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(places)), mask=absent)


def fold_any(text: Column) -> Column:
    """struct(text, origin): full folding of any script, with the map back to the original places. For short texts; ``fold_rows`` is for any."""

    def run(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(_folded_all(text.to_pylist())), ["text", "origin"])

    return F.arrow_udf(run, StructType().add("text", "string").add("origin", ArrayType(IntegerType())), ArrowUDFType.SCALAR)(text)


#: Characters whose foldings and places a task holds at once, but for a longer single text.
FOLDED_AT_ONCE = 1 << 20


def fold_batches(text: str, others: list[str]):
    """A map over Arrow batches: the other columns with (folded, origin) of text, in pieces of ``FOLDED_AT_ONCE`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            piece = np.cumsum(pc.fill_null(pc.utf8_length(b.column(text)), 0).to_numpy(zero_copy_only=False)) // FOLDED_AT_ONCE
            starts = [0, *(np.flatnonzero(np.diff(piece)) + 1), b.num_rows] if b.num_rows else []
            for start, stop in pairwise(starts):
                part = b.slice(start, stop - start)
                columns = [*[part.column(c) for c in others], *_folded_all(part.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "folded", "origin"])

    return run


def fold_rows(rows: DataFrame, text: str) -> DataFrame:
    """rows with (folded, origin) of a text column in its place, as ``fold_any`` gives them.

    Places are four bytes a character, and many texts fill an Arrow batch; so rows come back in pieces.
    """
    others = [c for c in rows.columns if c != text]
    more = [StructField("folded", StringType()), StructField("origin", ArrayType(IntegerType()))]
    return rows.select(*others, text).mapInArrow(fold_batches(text, others), StructType([*rows.select(*others).schema.fields, *more]))


def tokens(folded: Column) -> Column:
    """Runs of letters, runs of digits and single other characters."""
    return F.regexp_extract_all(folded, F.lit(r"\p{L}+|[0-9]+|\S"), F.lit(0))


def split_year(title: Column) -> Column:
    """struct(title, year): a last year between 1200 and 2099 is taken off; none: null."""
    pattern = rf"^(.*?)[\s,]*\(?{YEAR}\)?\s*$"
    head = F.trim(F.regexp_extract(title, pattern, 1))
    year = F.regexp_extract(title, pattern, 2)
    has = (year != "") & (head != "")
    return F.struct(F.when(has, head).otherwise(F.trim(title)).alias("title"), F.when(has, year.cast("int")).alias("year"))


def title_words(title: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(fold(title), "&", " and "), "'", "")
    words = F.regexp_extract_all(cleaned, F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*PARTICLES))


def title_key(words: Column, year: Column) -> Column:
    base = F.array_join(words, " ")
    return F.when(year.isNull(), base).otherwise(F.concat(base, F.lit("|"), year.cast("string")))


def core_words(words: Column) -> Column:
    """Without a last word that names a kind of instrument."""
    return F.when(F.element_at(words, -1).isin(*TYPE_WORDS), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)


def title_variants(title: Column) -> Column:
    """At most four keys of a title: with and without its year, with and without its type word."""
    note = r"(?i)\s*\(\s*(?:expired|repealed|revoked|lapsed|annulled|not approved)[^()]*\)\s*$"
    none = F.lit(None).cast("int")

    def keys(p: Column) -> Column:
        words, year = title_words(p["title"]), p["year"]

        def made(w: Column) -> Column:
            core = core_words(w)
            usable = (F.size(core) > 0) & F.exists(core, lambda x: ~x.rlike("^[0-9]+$"))
            all_keys = F.array(
                title_key(w, year), title_key(w, none), F.when(usable, title_key(core, year)), F.when(usable, title_key(core, none))
            )
            return F.array_distinct(F.filter(all_keys, lambda k: k.isNotNull() & (k != "")))

        return F.when(F.size(words) > 0, let(words, made)).otherwise(F.array().cast("array<string>"))

    return let(split_year(F.regexp_replace(title, note, "")), keys)


def wordset_key(words: Column, year: Column) -> Column:
    """Order-free key; null without a year or with fewer than two different words."""
    distinct = F.array_sort(F.array_distinct(words))
    return F.when(year.isNotNull() & (F.size(distinct) >= 2), F.concat(F.array_join(distinct, " "), F.lit("|"), year.cast("string")))


def acronym_keys(title: Column) -> Column:
    """Initials of an Act's title under three policies for small words, each with the year."""

    def forms(p: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(fold(p["title"]), "&", " and "), "'", "")
        words = F.regexp_extract_all(cleaned, F.lit(r"\p{L}+|[0-9]+"), F.lit(0))

        def made(w: Column) -> Column:
            ok = p["year"].isNotNull() & (F.size(w) >= 2) & (F.element_at(w, -1) == "act") & ~F.exists(w, lambda x: x.rlike("^[0-9]+$"))
            picks = [w, F.filter(w, lambda x: ~x.isin(*PARTICLES)), F.filter(w, lambda x: ~x.isin(*ACRONYM_SKIP))]
            initials = [F.array_join(F.transform(k, lambda x: F.left(x, F.lit(1))), "") for k in picks]
            tagged = [F.when(F.length(i) >= 2, i) for i in initials] + [
                F.when(F.length(i) >= 4, F.substring(i, F.lit(1), F.length(i) - 1)) for i in initials
            ]
            keys = F.transform(
                F.filter(F.array(*tagged), lambda x: x.isNotNull()), lambda x: F.concat(x, F.lit("|"), p["year"].cast("string"))
            )
            return F.when(ok, F.array_sort(F.array_distinct(keys))).otherwise(F.array().cast("array<string>"))

        return let(words, made)

    return let(split_year(title), forms)


def delete_variants(word: Column) -> Column:
    """All strings that one or two deletions leave of word."""

    def once(w: Column) -> Column:
        return F.when(
            F.length(w) > 1,
            F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))),
        ).otherwise(F.array().cast("array<string>"))

    return let(once(word), lambda one: F.array_distinct(F.concat(one, F.flatten(F.transform(one, once)))))


def stem(word: Column) -> Column:
    n = F.length(word)
    out = F.when(word.rlike("^[0-9]+$"), word)
    for many, one in IRREGULAR.items():
        out = out.when(word == many, F.lit(one))
    out = out.when(word.endswith("ssal") & (n >= 7), F.substring(word, F.lit(1), n - 2))
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (n - len(s) >= 4), F.substring(word, F.lit(1), n - len(s)))
    out = out.when((n >= 5) & word.rlike("(s|x|z|ch|sh)es$"), F.substring(word, F.lit(1), n - 2))
    plain = F.when(word.endswith("s") & ~word.endswith("ss") & (n >= 4), F.substring(word, F.lit(1), n - 1)).otherwise(word)
    bare = plain.endswith("e") & (F.length(plain) >= 5)
    return out.otherwise(F.when(bare, F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain))


def index_words(text: Column) -> Column:
    """Words that become index terms, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP))


def terms(text: Column) -> Column:
    """Index terms in order, repeats kept."""
    return F.transform(index_words(text), stem)


def mostly_capitals(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(False)).otherwise(F.regexp_count(text, F.lit(r"\p{Lu}")) > letters * 0.6)


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


ROMAN = {roman(i): i for i in range(1, 400)}


def from_roman(numeral: Column) -> Column:
    """1 to 399, canonical numerals only; else null."""
    table = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.get(F.transform(F.array(F.lower(numeral)), lambda r: F.try_element_at(table, r)), F.lit(0))
