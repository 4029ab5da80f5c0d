"""Documents, records, feeds, sinks and streams on small inputs made here."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from citeloom.functions import uris as U
from citeloom.functions.dates import hint_date
from citeloom.operators import sweep, tables
from citeloom.operators.routing import facts_table
from citeloom.sources import clml, records, sinks
from citeloom.streaming import routes

ID = "http://www.legislation.gov.uk/id/"
NS = 'xmlns="http://www.legislation.gov.uk/namespaces/legislation" xmlns:ukm="http://www.legislation.gov.uk/namespaces/metadata" xmlns:dc="http://purl.org/dc/elements/1.1/"'


def doc(path="ukpga/1996/18", body="", title="Employment Rights Act 1996", year="1996", number="18", category="primary", meta=""):
    kind = "PrimaryMetadata" if category == "primary" else "SecondaryMetadata"
    return (
        f'<Legislation {NS} IdURI="{ID}{path}"><ukm:Metadata><dc:title>{title}</dc:title><ukm:{kind}><ukm:DocumentClassification>'
        f'<ukm:DocumentCategory Value="{category}"/><ukm:DocumentMainType Value="X"/><ukm:DocumentStatus Value="revised"/></ukm:DocumentClassification>'
        f'<ukm:Year Value="{year}"/><ukm:Number Value="{number}"/></ukm:{kind}>{meta}</ukm:Metadata><Body>{body}</Body>'
        f'<Commentaries><Commentary id="c1"><Para><Text>By <Citation id="n1" URI="{ID}ukpga/2010/15">Equality Act 2010</Citation></Text></Para></Commentary></Commentaries></Legislation>'
    ).encode()


SECTION = (
    f'<Part IdURI="{ID}ukpga/1996/18/part/X"><Number>Part X</Number><Pblock><Title>Dismissal</Title><P1group><Title>Limit</Title><P1 IdURI="{ID}ukpga/1996/18/section/124"><Pnumber>124</Pnumber><P1para>'
    f'<Text>The amount under <Citation id="a1" URI="{ID}ukpga/2010/15/section/124">section 124 of the 2010 Act</Citation>—</Text>'
    f'<P2 IdURI="{ID}ukpga/1996/18/section/124/1ZA"><Pnumber>1ZA</Pnumber><P2para><Text>first<CommentaryRef Ref="c1"/> words</Text></P2para></P2>'
    f'<P2 IdURI="{ID}ukpga/1996/18/section/124/1ZA"><Pnumber>1ZA</Pnumber><P2para><Text>again</Text></P2para></P2>'
    f"<Text>shall not exceed it.</Text></P1para></P1></P1group></Pblock>"
    f'<P1 IdURI="{ID}ukpga/1996/18/section/125" Status="Repealed"><Pnumber>125</Pnumber><P1para><BlockAmendment><P1 IdURI="{ID}ukpga/1996/18/section/9"><Text>quoted <Citation URI="{ID}uksi/2011/3006">S.I. 2011/3006</Citation></Text></P1></BlockAmendment></P1para></P1></Part>'
    f'<Versions><Version/><Version/></Versions><P1 IdURI="{ID}ukpga/1999/1/section/1"><Text>not ours</Text></P1>'
)


def test_document():
    got = clml.parse(doc(body=SECTION))
    p = {x["coordinate"].removeprefix("uk/ukpga/1996/18/"): x for x in got["provisions"]}
    assert list(p) == ["ptX", "s124", "s124/1ZA", "s125"]
    assert (p["s124"]["title"], p["s124"]["crossheading"], p["s124"]["number_label"], p["s124"]["parent"]) == ("Limit", "Dismissal", "124", "uk/ukpga/1996/18")
    assert p["s124"]["text"] == "The amount under section 124 of the 2010 Act—" and p["s124"]["text_after"] == "shall not exceed it."
    assert p["s124/1ZA"]["text"] == "first words" and p["s125"]["repealed"] and p["s125"]["text"] == "quoted S.I. 2011/3006"
    assert p["s124/1ZA"]["source_url"].endswith("section/124/1ZA")
    i = got["instrument"]
    assert i["groups"] == {"ptX": ["s124", "s125"]} and i["duplicated_provisions"] == ["uk/ukpga/1996/18/s124/1ZA"] and i["alternative_versions"] == 2
    c = {x["text"]: x for x in got["citations"]}
    first = c["section 124 of the 2010 Act"]
    assert first["target_coordinate"] == "uk/ukpga/2010/15/s124" and first["context"][slice(*first["span"])] == first["text"]
    assert c["S.I. 2011/3006"]["in_amendment"] and c["Equality Act 2010"]["in_commentary"] and not first["in_commentary"]


def test_identity_and_titles():
    i = clml.parse(doc("ukpga/Geo3/41/63", title="House of Commons Act 1801 (repealed)", year="1801", number="63"))["instrument"]
    assert (i["coordinate"], i["title"], i["repealed"], i["structure"]) == ("uk/ukpga/Geo3/41/63", "House of Commons Act 1801", True, "metadata_only")
    meta = f'<ukm:UnappliedEffect AffectedURI="{ID}ukpga/1996/18"><ukm:AffectedTitle>Old Name Act 1996</ukm:AffectedTitle><ukm:AffectedTitle>Employment Rights Act 1996</ukm:AffectedTitle></ukm:UnappliedEffect>'
    assert clml.parse(doc(meta=meta))["instrument"]["other_titles"] == ["Old Name Act 1996"]


@pytest.mark.parametrize("bad", [b"<not-xml", b"<Legislation/>", doc("ukpga/1996"), doc("ukpga/1996/18/s1"), doc(year="twenty"), b'<!DOCTYPE x [<!ENTITY a "b">]><x/>'])
def test_unusable_documents(bad):
    with pytest.raises(clml.BadDocument):
        clml.parse(bad)


def test_addresses():
    assert U.coordinate_of("https://www.legislation.gov.uk/ukpga/1996/18/section/124/1ZA/2010-01-01") == "uk/ukpga/1996/18/s124/1ZA"
    assert U.coordinate_of("http://www.legislation.gov.uk/id/wsi/2013/2729/contents") == "uk/wsi/2013/2729" and U.coordinate_of("http://example.org/") is None
    for tail in (["s124", "1ZA", "a"], ["sch", "para3"], ["pt2A", "ch1"], ["sch13", "parab"]):
        assert U.tail_of(U.path_of(tail).split("/")) == tail
    assert U.tail_of(["crossheading"]) is None and U.tail_of(["section"]) is None and U.tail_of(["section", "1", "and"]) is None


def test_scan_to_routes(spark, tmp_path):
    for name, content in {"a": doc(body=SECTION), "b": doc("ukpga/2010/15", title="Equality Act 2010", year="2010", number="15"), "c": b"broken"}.items():
        d = tmp_path / "raw" / name
        d.mkdir(parents=True)
        (d / "x.xml.gz").write_bytes(gzip.compress(content))
    docs = tables.stored(clml.scan(spark, str(tmp_path / "raw")), "docs")
    assert sorted(r["status"] for r in docs.collect()) == ["failed", "ok", "ok"]
    rep = clml.report(docs).first()
    assert (rep["documents"], rep["failed"], rep["structured"], rep["provisions"], rep["citations"], rep["collisions"]) == (3, 1, 1, 4, 4, 0)
    book, prov, cites = clml.instruments(docs), clml.provisions(docs), clml.citations(docs)
    assert book.columns[0] == "coordinate" and prov.count() == 4 and cites.count() == 4
    primary = book.withColumn("primary", F.col("authority_type") == "PRIMARY_ACT").withColumnRenamed("duplicated_provisions", "duplicated")
    facts = facts_table(primary, prov)
    coords = prov.select("coordinate").union(book.select("coordinate"))
    out = {r["outcome"]: r["n"] for r in sweep.sweep(sweep.bucket(cites).drop("split"), facts, coords).collect()}
    assert sum(out.values()) <= 2 and set(out) <= {"correct", "ambiguous", "dropped", "miss", "wrong_provision", "false_abstention"}
    index = sinks.write_index({"coordinates": coords.select(F.lower("coordinate").alias("key"), "coordinate").distinct()}, str(tmp_path / "index"))
    assert tables.verify(spark, index, 1, 1) == []
    spark.createDataFrame([("zz", "zz")], "key string, coordinate string").write.mode("append").parquet(index[0]["path"])
    assert tables.verify(spark, index, 1, 2)[0].startswith("format version") and len(tables.verify(spark, index, 1, 1)) == 2
    assert tables.prefix(spark.read.parquet(index[0]["path"]), "uk/ukpga/1996/18/s124").count() == 2


def test_clause():
    text = "Words inserted (1.1.2000) by Employment Rights Act 1996 (c. 18), s. 1; other"
    at = text.index("Employment")
    part, a, b = sweep.clause(text, at, at + 26)
    assert part == "Employment Rights Act 1996 (c. 18), s. 1" and part[a:b] == "Employment Rights Act 1996"


def test_seals_and_files(spark, tmp_path):
    rows = records.sealed(spark.createDataFrame([(1, "a"), (2, None)], "n int, t string"))
    assert records.broken_seals(rows).count() == 0 and records.broken_seals(rows.withColumn("t", F.lit("z"))).count() == 2
    (tmp_path / "log.jsonl").write_text('{"key":"a","ok":false,"error":"HTTP 529"}\n{"key":"b","ok":true}\n{"key":"c","ok":false,"error":"bad input"}\n{"key":"d","o')
    log = records.calls(spark, str(tmp_path / "log.jsonl"))
    assert sorted(r["key"] for r in log.collect()) == ["a", "b", "c"]
    plan = spark.createDataFrame([(k,) for k in "abce"], "key string")
    assert sorted(r["key"] for r in records.to_do(plan, log).collect()) == ["a", "e"]
    old = spark.createDataFrame([("x", "1"), ("y", "1")], "name string, sha256 string")
    new = spark.createDataFrame([("x", "2"), ("z", "1")], "name string, sha256 string")
    assert {(r["name"], r["change"]) for r in records.seal_differences(old, new).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    jobs = records.job_plan(spark.createDataFrame([("r1",), ("r2",), ("r3",)], "row_id string"), ["s", "t"], [3, 10], 2, 2, 7)
    assert jobs.count() == 16 and jobs.select("key").distinct().count() == 16


def test_catalogue(spark, tmp_path):
    page = (
        f'<feed><link rel="next" href="http://x/2"/><entry><id>{ID}asp/2010/13</id><title>Justice &amp; Licensing Act 2010 (repealed)</title></entry>'
        '<entry><id>tag:odd</id><title>T</title><ukm:Year Value="1948"/><ukm:Number Value="7"/></entry><entry><id>tag:none</id></entry></feed>'
    )
    pages = spark.createDataFrame([(1, page, "uksi")], "page int, body string, series string")
    feed = records.feed_entries(pages)
    got = {r["coordinate"]: (r["title"], r["repealed"], r["year"], r["number"]) for r in feed.collect()}
    assert got == {"uk/asp/2010/13": ("Justice & Licensing Act 2010", True, 2010, 13), "uk/uksi/1948/7": ("T", False, 1948, 7)}
    assert records.next_page(pages).first()["url"] == "http://x/2"
    (tmp_path / "l.jsonl").write_text('{"coordinate":"uk/asp/2010/13","series":"asp","year":2010,"number":13}\n{"coordinate":"nonsense","year":1,"number":1}\n')
    both = records.merged_catalogue([feed, records.listing(spark, str(tmp_path / "l.jsonl"), "listing")])
    assert {(r["coordinate"], r["source"]) for r in both.collect()} == {("uk/asp/2010/13", "atom-feed"), ("uk/uksi/1948/7", "atom-feed")}
    q = spark.createDataFrame([("ukpga", "1950", "3", "A"), ("ukpga", "1970", "3", "B"), ("uksi", "x", "1", "C")], "series string, year string, number string, title string")
    assert [r["coordinate"] for r in records.queue(q, "queue").collect()] == ["uk/ukpga/1970/3"]
    book = spark.createDataFrame([("uk/wsi/1948/7",)], "coordinate string")
    assert [r["coordinate"] for r in records.not_indexed(both, book).collect()] == ["uk/asp/2010/13"]
    (tmp_path / "a.toml").write_text('[[alias]]\ntarget = "uk/ukpga/1996/18"\nforms = ["ERA \'96", "E.R.A. 1996"]\nsalient = true\n')
    assert records.aliases(str(tmp_path / "a.toml")) == [("era 96", "uk/ukpga/1996/18", True), ("e r 1996", "uk/ukpga/1996/18", True)]


def test_batteries(spark):
    rows = [("uk-typo-0001", "q one", "ROUTE_BOUNDED", ["c"], "dev"), ("uk-typo-0002", "q two", "ROUTE_BOUNDED", [], "dev"), ("uk-typo-0002", "Q ONE ", "ROUTE_UNRESOLVED", ["c"], "dev"), ("bad", "q", "ROUTE_AMBIGUOUS", None, None)]
    df = spark.createDataFrame(rows, "id string, query string, expected_status string, expected_coordinates array<string>, split string")
    assert {r["problem"] for r in records.battery_problems(df, "typo").collect()} == {"bound_without_coordinates", "coordinates_without_bound", "repeated_id", "repeated_query", "id"}
    assert [r["id"] for r in records.numbered(df.drop("id"), "x", ["query"]).collect()] == ["uk-x-0001", "uk-x-0002", "uk-x-0003", "uk-x-0004"]
    lines = spark.createDataFrame([(f"{i}. search {i}",) for i in range(1, 51)] + [("text",)], "value string")
    assert records.searches(lines).count() == 50
    with pytest.raises(ValueError):
        records.searches(lines.where("value not like '7.%'"))
    assert records.noise(spark, 2, 400).where(F.length("text") == 400).count() == 26


def test_dates(spark):
    hints = {"as at 1 April 1996": "1996-04-01", "on 6th Sept. 2020": "2020-09-06", "March 3rd, 2001": "2001-03-03", "1.3.2007": "2007-03-01", "2010-02-28": "2010-02-28", "31.2.2007": "IMPRECISE_DATE", "1 May 1999 or 2 May 1999": "AMBIGUOUS", "1 May 1999 and 1.5.1999": "1999-05-01", "in 1999": "IMPRECISE_DATE", "long ago": "NO_DATE", None: "NO_DATE"}
    df = spark.createDataFrame(list(hints.items()), "hint string, want string").select("*", hint_date(F.col("hint")).alias("h"))
    for r in df.collect():
        assert str(r["h"]["day"] or r["h"]["status"]) == r["want"], r["hint"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    assert sinks.markdown(df, ["k"]).first()["text"] == "| k | n |\n| --- | --- |\n| a | – |\n| b | 2 |"
    sinks.write_lines(df.orderBy("k"), str(tmp_path / "l"), "k", "n")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"k":"a"}', '{"k":"b","n":2}']
    with pytest.raises(ValueError, match="repeated_key"):
        tables.write_sorted(df.select(F.lit("x").alias("key")), str(tmp_path / "t"))
    r = spark.createDataFrame([("secret query", "ROUTE_UNRESOLVED", True, "too_complex", "s"), ("other", "ROUTE_BOUNDED", True, None, "s")], "query_text string, status string, citation_signal boolean, reason string, index_snapshot string")
    [m] = sinks.misses(r).collect()
    assert m["query"] is None and m["query_length"] == 12 and "secret" not in json.dumps(m.asDict())
    assert sinks.seal({"a": df}) == sinks.seal({"a": df.orderBy(F.desc("k")).repartition(3)})


def test_streams(spark, tmp_path):
    book = spark.createDataFrame([("uk/ukpga/1996/18", "Employment Rights Act 1996", 1996, "18")], "coordinate string, title string, year int, number string")
    facts = tables.stored(facts_table(book, spark.createDataFrame([("uk/ukpga/1996/18/s1",)], "coordinate string")), "facts")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Employment Rights Act 1996 s. 1"), (2, "nothing")], "id long, text string").write.json(src)
    stream = spark.readStream.schema("id long, text string").json(src)
    routes.route_stream(stream, facts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["id"]: r["coordinates"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ["uk/ukpga/1996/18/s1"], 2: []}
    turns = str(tmp_path / "turns")
    spark.createDataFrame([(7, 1, ["c1"]), (7, 3, ["c3"]), (7, 2, None), (8, 1, None)], routes.TURNS).coalesce(1).write.json(turns)
    q = routes.carried_context(spark.readStream.schema(routes.TURNS).json(turns)).writeStream.format("memory").queryName("turns_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["conv_id"], r["turn"], r["context"]) for r in spark.table("turns_out").collect() if r["context"]) == [(7, 2, ["c1"]), (7, 3, ["c1"])]
