"""Orders made here: parsed, chained into a valid-time table, and checked."""

from pyspark.sql import functions as F

from citeloom.operators.comparison import invented_title
from citeloom.sources import orders

NS = 'xmlns="http://www.legislation.gov.uk/namespaces/legislation" xmlns:ukm="http://www.legislation.gov.uk/namespaces/metadata" xmlns:dc="http://purl.org/dc/elements/1.1/"'
DAYS = {2019: ("6th April 2019", "2019-04-06"), 2020: ("6th April 2020", "2020-04-06")}


def order(year, old, new, revokes, told=None):
    said, day = DAYS[year]
    group = lambda title, text: f"<P1group><Title>{title}</Title><P1><Text>{text}</Text></P1></P1group>"
    return (
        f'<Legislation {NS} IdURI="http://www.legislation.gov.uk/id/uksi/{year}/1"><ukm:Metadata><dc:title>The Employment Rights (Increase of Limits) Order {year}</dc:title>'
        f'<ukm:Made Date="{year}-02-01"/><ukm:ComingIntoForce><ukm:DateTime Date="{told or day}"/></ukm:ComingIntoForce></ukm:Metadata><Body>'
        + group("Citation and commencement", f"This Order comes into force on {said}.")
        + group("Revocation", f"The Employment Rights (Increase of Limits) Order {revokes} is revoked.")
        + group("Transitional provisions", "Old sums stay for earlier events.")
        + f"</Body><Schedules><tr><td>1</td><td>Section 124(1) of the 1996 Act</td><td>limit</td><td>{old}</td><td>{new}</td></tr></Schedules></Legislation>"
    ).encode()


def test_chain(spark):
    make = lambda *xs: orders.parsed(spark.createDataFrame([(str(i), x) for i, x in enumerate(xs)], "path string, content binary"))
    one = {"124": "uk/ukpga/1996/18/s124"}
    good = make(order(2019, "£80", "£86", 2018), order(2020, "£86", "£88", 2019))
    rows = sorted((str(r["valid_from"]), str(r["valid_to"]), r["amount"], r["si"]) for r in orders.limits(good, one).collect())
    assert rows == [("2019-04-06", "2020-04-06", "£86", "uk/uksi/2019/1"), ("2020-04-06", "None", "£88", "uk/uksi/2020/1")]
    assert orders.problems(good, one).count() == 0
    bad = make(order(2019, "£80", "£86", 2018), order(2020, "£85", "£88", 2017), b"<x/>", order(2020, "a", "b", 2019, "2020-04-07"))
    assert sorted(r["error"] is None for r in bad.collect()) == [False, False, True, True]
    assert {r["problem"] for r in orders.problems(bad, one).collect()} == {"old_amount", "not_revoked", "revokes_unknown"}
    assert {r["problem"] for r in orders.problems(good).collect()} == {"target_missing"}


def test_invented_title(spark):
    q = spark.createDataFrame([("see the Odd Act 1999, and the Marchwood Order 2022 s.4",), ("nothing",)], "q string")
    got = [r["t"] for r in q.select(invented_title(F.col("q")).alias("t")).collect()]
    assert (got[0]["title"], got[0]["year"]) == ("and the Marchwood Order 2022", 2022) and got[1] is None
