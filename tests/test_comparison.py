"""Comparison operators on small frames with hand-made answers."""

from pyspark.sql import functions as F

from citeloom.functions import reading as R
from citeloom.operators import comparison as K
from citeloom.operators.routing import facts_table
from citeloom.operators.tables import stored

BOOK = [("uk/ukpga/1996/18", "Employment Rights Act 1996", 1996, "18"), ("uk/ukpga/1996/23", "Arbitration Act 1996", 1996, "23"), ("uk/ukpga/2010/15", "Equality Act 2010", 2010, "15")]


def book(spark):
    return spark.createDataFrame(BOOK, "coordinate string, title string, year int, number string")


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_written_forms(spark):
    t = lambda *a: one(spark, K.citation_text(*[F.lit(x) for x in a]))
    assert t("Theft Act", 1968, "c. 60", "s. 1") == "Theft Act 1968 (c. 60) s. 1" and t("Theft Act 1968", 1968, "", "") == "Theft Act 1968"
    assert t("", 0, "SI 2011/3006", "art. 2") == "SI 2011/3006 art. 2"
    o = lambda c: one(spark, K.official_citation(F.lit(c)))
    assert [o("uk/ukpga/1996/18"), o("uk/ukpga/Vict/60-61/6"), o("uk/wsi/2013/2729")] == ["1996 c. 18", "Vict 60-61 c. 6", "SI 2013/2729 (W.)"]
    w = lambda c: one(spark, K.written_provision(F.lit(c)))
    assert tuple(w("s124/1ZA")) == ("section 124(1ZA)", "s. 124(1ZA)") and tuple(w("sch2/para3/1")) == ("paragraph 3(1) of Schedule 2", "Sch. 2 para. 3(1)") and w("ptX") is None
    assert one(spark, K.unit_of(F.lit("sch1/para2/a"))) == "sch1/para2" and one(spark, K.unit_of(F.lit("pt1"))) is None
    cut = one(spark, K.option_cut(F.array(*[F.lit(60)] * 10)))
    assert cut["per"] == 17 and abs(cut["kept"] - 16 / 60) < 1e-9
    rows = spark.createDataFrame([("uk/ukpga/1996/18/s1", "s1", "ukpga", "Employment Rights Act 1996", 1996, 18)], "coordinate string, tail string, series string, title string, year int, number int")
    q = K.phrased(rows, 1).first()["query"]
    assert "1" in q and ("Employment Rights Act 1996" in q or "1996 c. 18" in q) and "{" not in q and q[0] in "SEUW1"


def test_answers_choices_and_costs(spark):
    out = spark.createDataFrame(
        [("a", '{"outcome":"found","citations":[{"title":"Equality Act","year":2010,"provision":"s. 13","coordinate":"uk/ukpga/2010/15"},{"coordinate":"bad"}]}'), ("b", '{"outcome":"odd"}'), ("c", '{"outcome":"nothing"}')],
        "row_id string, output string",
    )
    read = {r["row_id"]: r for r in K.read_answers(out, {"found": R.BOUNDED, "nothing": R.UNRESOLVED}).collect()}
    assert (read["a"]["status"], read["a"]["coordinates"], read["a"]["malformed"]) == (R.BOUNDED, ["uk/ukpga/2010/15"], ["bad"])
    assert read["b"]["status"] is None and read["c"]["coordinates"] == []
    facts = stored(facts_table(book(spark), spark.createDataFrame([("uk/ukpga/2010/15/s13",)], "coordinate string")), "facts")
    got = {r["row_id"]: (r["status"], r["coordinates"]) for r in K.resolved_extractions(K.read_answers(out, {"found": R.BOUNDED}), facts).collect()}
    assert got["a"] == (R.BOUNDED, ["uk/ukpga/2010/15/s13"]) and got["c"] == (R.UNRESOLVED, [])
    rows = spark.createDataFrame([("a", R.BOUNDED, ["uk/ukpga/2010/15"]), ("b", R.NO_INSTRUMENT, []), ("c", R.OUTSIDE, [])], "row_id string, expected_status string, expected array<string>")
    o = K.outcomes(rows, K.read_answers(out, {"found": R.BOUNDED, "nothing": R.UNRESOLVED}), "own")
    m = {r["slice"]: r for r in K.existence(o).collect()}
    assert (m["all"]["rows"], m["knowable"]["rows"], m["all"]["as_expected"], m["all"]["bound_on_invented"]) == (3, 2, 1, 0)
    asked = rows.withColumn("gold", K.gold_instruments(F.col("expected_status"), F.col("expected"))).where("gold is not null")
    asked = asked.withColumn("series", F.lit("ukpga")).withColumn("year", F.lit(2009))
    c = {r["row_id"]: r for r in K.choices(asked, book(spark), 2, 5).collect()}
    assert len(c["a"]["options"]) == 3 and c["a"]["right"][0].startswith("option_") and c["b"]["right"] == ["none"]
    key = {o["id"]: o["key"] for o in c["a"]["options"]}
    assert c["a"]["right"] == [key["uk_ukpga_2010_15"]]
    ans = K.choices(asked, book(spark), 2, 5).withColumn("count", F.lit(2)).withColumn("picked", F.lit("none"))
    s = K.choice_accuracy(ans).first()
    assert (s["questions"], s["correct"], s["correct_none"], s["correct_real"], s["unusable"]) == (2, 1, 1, 0, 0)
    calls = spark.createDataFrame([("g", True, 100, 10), ("g", False, None, None)], "system string, ok boolean, tokens_in int, tokens_out int")
    u = K.usage(calls, {"g": (2.0, 10.0)}).first()
    assert (u["calls"], u["failed"], u["cost"]) == (1, 1, 0.0003)


def test_point_in_time(spark):
    v = spark.createDataFrame([("c/1", "2020-01-01", "2021-01-01", "£1"), ("c/1", "2021-01-01", None, "£2")], "coordinate string, f string, t string, amount string")
    v = v.select("coordinate", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "amount")
    rows = [(1, R.BOUNDED, ["c/1"], "as at 1 June 2020"), (2, R.BOUNDED, ["c/1"], "in 2020"), (3, R.AMBIGUOUS, [], "as at 1 June 2020"), (4, R.BOUNDED, ["c/2"], "as at 1 June 2020"), (5, R.BOUNDED, ["c/1"], "1.1.2019"), (6, R.BOUNDED, ["c/1"], "2021-01-01")]
    q = spark.createDataFrame(rows, "query_id int, status string, coordinates array<string>, temporal_hint string")
    got = {r["query_id"]: (r["answer"], r["amount"]) for r in K.point_in_time(q, v).collect()}
    assert got == {1: ("FOUND", "£1"), 2: ("IMPRECISE_DATE", None), 3: ("NOT_BOUND", None), 4: ("NOT_COVERED", None), 5: ("NO_ROW", None), 6: ("FOUND", "£2")}


def test_small_operators(spark):
    c = spark.createDataFrame([("s", f"r{i // 5}", "x" if i != 7 else "y", True) for i in range(10)], "system string, row_id string, answer string, ok boolean")
    d = K.determinism(c).first()
    assert (d["rows"], d["changed"]) == (2, 1)
    s = spark.createDataFrame([("a", 1, 100, 10), ("a", 2, 200, 30), ("b", 1, 100, 5)], "class string, sample int, chars int, ns int")
    assert [r["class"] for r in K.worst(s).collect()] == ["a", "b"] and K.doubling(s).first()["ratio"] == 3.0
    assert one(spark, K.audit(F.lit("It was  £5"), F.array(F.lit("£5")), F.array(F.lit("£4")))) == "pass"
    old = spark.createDataFrame([("k", "v", "q"), ("l", "w", "q")], "id string, seen string, query string")
    new = spark.createDataFrame([("k", None, "q"), ("l", None, "other")], "id string, seen string, query string")
    assert {r["id"]: r["seen"] for r in K.carried_over(new, old, "id", "seen", ["query"]).collect()} == {"k": "v", "l": None}
    seek = spark.createDataFrame([("a", "Theft Act 1968", 200, False), ("b", "Odd Act 1968", 200, False), ("c", "x", 404, True), ("d", "y", None, False)], "row_id string, title string, status int, by_number boolean")
    found = spark.createDataFrame([("a", "The Theft Act 1968"), ("b", "Other Act 1968")], "row_id string, title string")
    assert {r["row_id"]: r["absent"] for r in K.absent(seek, found).collect()} == {"a": False, "b": True, "c": True, "d": None}
    p = K.paired_order(spark.range(20).withColumnRenamed("id", "pair"), 3)
    assert p.count() == 40 and p.where("place = 0").select("side").distinct().count() == 2
    plan = spark.createDataFrame([("a", "s", 1), ("b", "s", 1)], "key string, system string, rep int")
    log = spark.createDataFrame([("a", True), ("b", False)], "key string, ok boolean")
    assert tuple(K.progress(plan, log).first()) == ("s", 1, 2, 1)
    t = spark.createDataFrame([("theft act|1968", "i")], "key string, instrument_id string")
    b = spark.createDataFrame([("Theft Act 1968", "full"), ("Theft Act 1968", "metadata_only")], "title string, structure string")
    assert K.sampleable(b, t).count() == 1
    calls = spark.createDataFrame([(3, [10, 10, 10], True, False, 50), (3, [60] * 10, False, False, None)], "count int, lengths array<int>, fits boolean, collapsed boolean, tokens int")
    r = K.cut_report(calls).first()
    assert (r["calls"], r["not_fitting"], r["tokens_p50"]) == (2, 1, 50)
