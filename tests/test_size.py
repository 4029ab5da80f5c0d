"""What only larger tables show: numbers beyond six digits, texts that fill a task."""

import pyarrow as pa

from citeloom.functions import coords as C
from citeloom.functions import text as T
from citeloom.functions import uris as U
from citeloom.operators import discovery as D
from citeloom.operators import evaluation as V
from citeloom.operators import routing
from citeloom.plans import discovery_queries as Q


def test_numbers_of_a_large_book(spark):
    want = {"uk/ukpga/1997/3000001/s5": True, "uk/ukpga/1997/1000000": True, "uk/ukpga/1997/0000001/s5": False, "uk/ukpga/1997/3000001/_x": False}
    rows = spark.createDataFrame([(c,) for c in want], "c string")
    assert {r["c"]: r["ok"] for r in rows.select("c", C.parse(rows.c).isNotNull().alias("ok")).collect()} == want
    assert {c: U.valid(c) for c in want} == want


def test_folding_of_whole_texts(spark):
    """Pieces of a batch come back in order, a text longer than a piece, nulls and empty ones included."""
    texts = ["Straße – № 1", None, "", "x" * T.FOLDED_AT_ONCE, "áB", "q" * 700_000, "r" * 700_000, "ﬁn"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r["id"]: (r["folded"], r["origin"]) for r in T.fold_rows(rows, "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == ((None, None) if t is None else T.fold_string(t))


def test_folding_holds_few_characters_at_once(monkeypatch):
    """A batch of many texts is folded in pieces."""
    sizes = []
    real = T._folded_all
    monkeypatch.setattr(T, "_folded_all", lambda texts: sizes.append(sum(map(len, texts))) or real(texts))
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["y" * 100_000] * 50})
    pieces = list(T.fold_batches("text", ["id"])([batch]))
    assert max(sizes) <= T.FOLDED_AT_ONCE + 100_000 and sum(p.num_rows for p in pieces) == 50


def test_postings_of_asked_terms_only(spark):
    """The queries' terms are picked before counting, and each different word is stemmed once."""
    rows = [(1, ["claims", "claim", "other"], ["claiming"]), (2, ["other"], []), (3, ["claim"] * 70, None)]
    fields = spark.createDataFrame(rows, "doc_id long, heading array<string>, body array<string>")
    fields = fields.selectExpr("doc_id", "heading", "array() crossheading", "array() structure", "array() title", "body")
    only = spark.createDataFrame([("claim",), ("claim",), ("none",)], "term string")
    got = D.postings(fields, only, T.stem).select("term", "doc_id", "heading", "body").collect()
    assert sorted(map(tuple, got)) == [("claim", 1, 2, 1), ("claim", 3, 63, 0)]


def test_gold_of_short_passages(spark, tmp_path):
    """Passages of any number of words find their documents."""
    docs = [(1, "a bc\nd e f"), (2, "xbc\nd ey"), (3, "nothing"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(1, "bc\nd e"), (2, "c\nd"), (3, "f"), (4, "a bc\nd e f"), (5, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, Q.gold_docs(spark, str(tmp_path)).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]


def test_titles_with_many_bearers(spark):
    """Keys as an array give what keys as rows give: each provision meets its title once; a fit of two sets of keys names none."""
    sets = [("a", ["k", "k|1"]), ("b", ["k", "k|2"]), ("c", ["k", "k|2"]), ("d", ["z"])]
    sets = spark.createDataFrame(sets, "instrument_id string, keys array<string>")
    held = [("a", "s1", "a/s1", 1), ("b", "s2", "b/s2", 1), ("c", "s2", "c/s2", 1), ("a", "s3", "a/s3", 2), ("b", "s4", "b/s4", 1), ("a", "s4", "a/s4", 1), ("c", "s5", "c/s5", 1), ("c", "s3", "c/s3", 1)]
    held = spark.createDataFrame(held, "instrument_id string, tail string, coordinate string, copies int")
    cited = spark.createDataFrame([(k, f"s{i}") for k in ("k", "k|1", "k|2", "z", "none") for i in range(1, 7)], "key string, tail string")
    rows = sets.selectExpr("explode(keys) key", "instrument_id")
    got = sorted(map(tuple, routing.exact_titles(cited, sets, held).collect()), key=str)
    assert got == sorted(map(tuple, routing.exact_titles(cited, rows, held).collect()), key=str)
    told = {(r[0], r[1]): r[3] for r in got if r[3]}
    assert told == {("k", "s1"): "a/s1", ("k|1", "s1"): "a/s1", ("k|1", "s4"): "a/s4", ("k|2", "s4"): "b/s4", ("k", "s5"): "c/s5", ("k|2", "s5"): "c/s5", ("k", "s3"): "c/s3", ("k|2", "s3"): "c/s3"}


def test_first_bearers(spark):
    """Only the first few of equal title and year can be offered."""
    titles = spark.createDataFrame([(f"i{n}", t, y) for n in range(9) for t, y in (("x act", 1), ("x act", 2))], "instrument_id string, title string, year int")
    got = sorted(map(tuple, routing.first_bearers(titles, 2).collect()))
    assert got == [("i0", "x act", 1), ("i0", "x act", 2), ("i1", "x act", 1), ("i1", "x act", 2)]


def test_title_keys_are_made_once(spark):
    """Instruments of one title share its folded keys, former titles too."""
    book = [("uk/ukpga/1996/1", "Théft Act 1996", 1996, "1", ["Old Thing Act 1990"]), ("uk/ukpga/1996/2", "Théft Act 1996", 1996, "2", None), ("uk/ukpga/1996/3", None, 1996, "3", None)]
    book = spark.createDataFrame(book, "coordinate string, title string, year int, number string, former array<string>")
    assert routing._title_keys(spark.createDataFrame([("Théft Act 1996",)], "t string")).count() == 1
    facts = routing.facts_table(book, spark.createDataFrame([("uk/ukpga/1996/1/s1",)], "coordinate string"))
    got = {(r["kind"], r["key"]): r["values"] for r in facts.collect()}
    both = ["uk_ukpga_1996_1", "uk_ukpga_1996_2"]
    assert got["title", "theft act|1996"] == both and got["title", "old thing act|1990"] == both[:1]
    assert got["word", "theft"] == ["2", *both] and ("wordset", "act theft|1996") not in got and got["top", "uk/ukpga/1996/1/s/1"] == ["uk/ukpga/1996/1/s1"]


def test_division_by_many_values(spark, monkeypatch):
    """More values than a long has bits, repeats and nulls; rows are dealt over as many tasks as they need."""
    monkeypatch.setattr(V, "AT_ONCE", 20)
    wanted = spark.createDataFrame([("q", i) for i in range(130)] + [("q", 3), ("one", 7), ("one", None), ("none", None)], "query string, v int")
    rows = [("all", i) for i in range(130)] * 2 + [("less", i) for i in range(129)] + [("less", 5), ("less", None)]
    got = V.divided(spark.createDataFrame(rows, "k string, v int"), wanted, ["k"], "v")
    assert sorted(map(tuple, got.collect())) == [("one", "all"), ("one", "less"), ("q", "all")]
    assert got.rdd.getNumPartitions() > 4


def test_all_postings_are_dealt_by_document(spark, monkeypatch):
    """Tasks that count every posting get a bounded number of documents; a repeated id is one document."""
    monkeypatch.setattr(D, "DOCS_AT_ONCE", 10)
    none = ("array() crossheading", "array() structure", "array() title", "array('b') body")
    fields = spark.range(95).selectExpr("id doc_id", "array('a', 'a') heading", *none).union(spark.range(1).selectExpr("id doc_id", "array('a') heading", *none))
    post = D.postings(fields)
    assert post.where("term = 'a' and doc_id = 0").first()["heading"] == 3
    assert post.count() == 190 and post.rdd.getNumPartitions() == 10
