"""Comparing systems on labelled rows: answers made alike, choices, costs, repeats, point-in-time answers, sampled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import coords as C
from citeloom.functions import dates
from citeloom.functions import reading as R
from citeloom.functions import text as T
from citeloom.operators import evaluation as V
from citeloom.operators import routing

# Written forms of provisions and queries, the option that names nothing, limits of a model's option head.
LONG = {"s": ("section", "s."), "reg": ("regulation", "reg."), "art": ("article", "art."), "rule": ("rule", "r.")}
ACT_FORMS = ("{long} of the {title}", "{title}, {short}", "{short} {title}", "What does {long} of the {title} provide?", "Under {long} of the {title}, what applies?")
ACT_NUMBER_FORMS = ("{title} ({year} c. {number}), {short}", "{year} c. {number}, {short}")
SI_FORMS = ("{long} of the {title}", "{title}, {short}", "What does {long} of the {title} say?")
SI_NUMBER_FORMS = ("{title} (S.I. {year}/{number}), {short}", "{short} of S.I. {year}/{number}")
NONE = "none"
HEAD, OPTION, RESERVE, LEAST = 192, 48, 16, 4
MOST_TITLE_WORDS = 20
# End of the fixed values.


def citation_text(title: Column, year: Column, number: Column, provision: Column) -> Column:
    """One extracted citation written out for routing; empty parts are left out, and a year that the title has."""
    e = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = F.when((F.coalesce(year, F.lit(0)) == 0) | F.contains(e(title), year.cast("string")), e(title)).otherwise(F.concat(e(title), F.lit(" "), year.cast("string")))
    told = F.when((e(number) != "") & (named != ""), F.concat(F.lit("("), e(number), F.lit(")"))).otherwise(e(number))
    return F.array_join(F.filter(F.array(named, told, e(provision)), lambda x: F.trim(x) != ""), " ")


def official_citation(coordinate: Column) -> Column:
    """What is shown beside a title: ``1996 c. 18``, ``Vict 60-61 c. 6``, ``SI 2011/3006 (W.)``."""
    seg = F.split(coordinate, "/")
    series, a, b = (F.get(seg, F.lit(i)) for i in (1, 2, 3))
    act = F.when(a.rlike("^[0-9]"), F.concat(a, F.lit(" c. "), b)).otherwise(F.concat(a, F.lit(" "), b, F.lit(" c. "), F.get(seg, F.lit(4))))
    mark = F.when(series == "wsi", " (W.)").when(series == "nisi", " (N.I.)").otherwise("")
    return F.when(series == "ukpga", act).otherwise(F.concat(F.lit("SI "), a, F.lit("/"), F.element_at(seg, -1), mark))


def gold_instruments(status: Column, coordinates: Column) -> Column:
    """Instruments that a right choice may name: none of them where the law is invented or nothing is cited; null where there is no answer."""
    ids = F.array_distinct(F.transform(coordinates, lambda c: C.parse(c)["instrument_id"]))
    empty = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(coordinates, empty)) > 0, ids).when(status.isin(R.NO_INSTRUMENT, R.UNRESOLVED), empty)


def read_answers(answers: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """answers (row_id, output: JSON with outcome and citations) with status, coordinates and malformed ones set aside."""
    o = F.from_json("output", "outcome string, citations array<struct<title:string,year:int,number:string,provision:string,coordinate:string>>")
    names = F.create_map(*[F.lit(x) for p in statuses.items() for x in p])
    rows = answers.withColumn("o", o).withColumn("status", F.try_element_at(names, F.col("o.outcome")))
    none = F.array().cast("array<string>")
    told = F.filter(F.transform(F.coalesce("o.citations", F.array().cast(rows.schema["o"].dataType["citations"].dataType)), lambda c: F.trim(c["coordinate"])), lambda c: c != "")
    good = F.array_distinct(F.filter(told, lambda c: C.parse(c).isNotNull()))
    bad = F.filter(told, lambda c: C.parse(c).isNull())
    usable = F.col("status").isNotNull()
    return rows.select(
        *answers.columns, "status", F.when(usable, good).otherwise(none).alias("coordinates"), F.when(usable, bad).otherwise(none).alias("malformed"),
        F.col("o.citations").alias("citations"),
    )


def resolved_extractions(answers: DataFrame, facts: DataFrame, setting: R.Setting = R.Setting()) -> DataFrame:
    """(row_id, status, coordinates): each extracted citation is routed by itself and the most cautious decides; no citation: unresolved."""
    each = answers.select("row_id", F.explode("citations").alias("c"))
    text = citation_text(F.col("c.title"), F.col("c.year"), F.col("c.number"), F.col("c.provision"))
    routed = routing.route(each.select("row_id", text.alias("text")).where("text <> ''"), facts, setting)
    order = F.array(*map(F.lit, R.ACTIONS))
    offered = F.when(F.size("coordinates") > 0, F.col("coordinates")).otherwise(F.transform("candidates", lambda c: c["coordinate"]))
    per = routed.groupBy("row_id").agg(F.min(F.array_position(order, F.col("status"))).alias("r"), F.array_distinct(F.flatten(F.collect_list(offered))).alias("coordinates"))
    out = answers.select("row_id").distinct().join(per, "row_id", "left")
    return out.select("row_id", F.coalesce(F.element_at(order, F.col("r").cast("int")), F.lit(R.UNRESOLVED)).alias("status"), F.coalesce("coordinates", F.array().cast("array<string>")).alias("coordinates"))


def outcomes(rows: DataFrame, routed: DataFrame, reading: str) -> DataFrame:
    """Battery rows (row_id, expected_status, expected) with what a reading bound, offered first, and whether it is as expected."""
    j = rows.join(routed.select("row_id", F.coalesce("status", F.lit(R.UNRESOLVED)).alias("status"), "coordinates"), "row_id", "left")
    status = F.coalesce("status", F.lit(R.UNRESOLVED))
    none = F.array().cast("array<string>")
    bound = F.when(status == R.BOUNDED, F.coalesce("coordinates", none)).otherwise(none)
    right = (status == F.col("expected_status")) & ((status != R.BOUNDED) | (F.array_sort(bound) == F.array_sort(F.coalesce("expected", none))))
    return j.select(*rows.columns, F.lit(reading).alias("reading"), status.alias("status"), bound.alias("bound"), F.when(status == R.AMBIGUOUS, F.get("coordinates", F.lit(0))).alias("first_offer"), right.alias("as_expected"))


def existence(o: DataFrame) -> DataFrame:
    """Per reading and slice (all rows, and without rows that turn on coverage): rows, as expected, bound on invented law, abstained, real law refused."""
    sliced = o.withColumn("slice", F.explode(F.when(F.col("expected_status") == R.OUTSIDE, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("knowable")))))
    invented, real = F.col("expected_status") == R.NO_INSTRUMENT, F.col("expected_status") == R.BOUNDED
    refused = F.col("status").isin(R.NO_INSTRUMENT, R.NO_PROVISION)
    return sliced.groupBy("reading", "slice").agg(
        F.count("*").alias("rows"), F.count_if("as_expected").alias("as_expected"), F.count_if(invented).alias("invented"),
        F.count_if(invented & (F.col("status") == R.BOUNDED)).alias("bound_on_invented"), F.count_if(invented & (F.col("status") == R.NO_INSTRUMENT)).alias("strict_abstention"),
        F.count_if(real & refused).alias("false_abstention"),
    )


def choices(rows: DataFrame, book: DataFrame, count: int, seed: int) -> DataFrame:
    """(row_id, options array<struct<key,id,title>>, right array<string>): the right instruments and their nearest in year of the series.

    rows: row_id, gold (see gold_instruments), series, year (what distractors resemble). Each (series, year) offers its
    first ``count`` by hash, so a hot year sends few rows. The option "none" comes last and is right where gold is empty.
    """
    label = F.concat("title", F.lit(" ("), official_citation(F.col("coordinate")), F.lit(")"))
    b = book.select(F.translate("coordinate", "/", "_").alias("id"), F.get(F.split("coordinate", "/"), F.lit(1)).alias("series"), F.col("year").alias("y"), label.alias("title"))
    few = Window.partitionBy("series", "y").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    pool = b.withColumn("r", F.row_number().over(few)).where(F.col("r") <= 2 * count).drop("r")
    right = rows.select("row_id", F.explode("gold").alias("id")).join(b, "id").select("row_id", "id", "title", F.lit(True).alias("right"), F.lit(0).alias("gap"))
    near = rows.join(pool, "series").where(~F.array_contains("gold", F.col("id")))
    near = near.select("row_id", "id", "title", F.lit(False).alias("right"), F.abs(F.col("y") - F.col("year")).alias("gap"))
    w = Window.partitionBy("row_id").orderBy(F.desc("right"), "gap", F.xxhash64(F.lit(seed), "row_id", "id"), "id")
    some = right.union(near).withColumn("r", F.row_number().over(w)).where(F.col("r") <= count)
    turn = F.struct(F.xxhash64(F.lit(seed), "row_id", "id", F.lit(count)).alias("turn"), "id", "title", "right")
    per = some.groupBy("row_id").agg(F.array_sort(F.collect_list(turn)).alias("o"))
    shown = F.transform("o", lambda x, i: F.struct(F.concat(F.lit("option_"), i.cast("string")).alias("key"), x["id"].alias("id"), x["title"].alias("title")))
    last = F.array(F.struct(F.lit(NONE).alias("key"), F.lit(NONE).alias("id"), F.lit("None of these").alias("title")))
    keys = F.filter(F.transform("o", lambda x, i: F.when(x["right"], F.concat(F.lit("option_"), i.cast("string")))), lambda k: k.isNotNull())
    j = rows.select("row_id", "gold").join(per, "row_id").withColumn("k", keys)
    j = j.where((F.size("gold") == 0) | (F.size("k") > 0))  # a row whose right instrument cannot be offered has no question
    return j.select("row_id", F.concat(shown, last).alias("options"), F.when(F.size("gold") == 0, F.array(F.lit(NONE))).otherwise(F.col("k")).alias("right"))


def question(options: Column, query: Column, instructions: str) -> Column:
    lines = F.array_join(F.transform(options, lambda o: F.concat(F.lit("  "), o["key"], F.lit(": "), o["title"])), "\n")
    return F.concat(F.lit(instructions + "\n\nOptions:\n"), lines, F.lit("\n\nText: "), query)


def picked(output: Column) -> Column:
    return F.get_json_object(output, "$.choice")


def choice_accuracy(answers: DataFrame) -> DataFrame:
    """Per option count, of answers (count, options, right, picked): right ones over all, real and none rows, and unusable picks."""
    ok = F.coalesce(F.array_contains("right", F.col("picked")), F.lit(False))
    none = F.array_contains("right", NONE)
    known = F.coalesce(F.exists("options", lambda o: o["key"] == F.col("picked")), F.lit(False))
    return answers.groupBy("count").agg(
        F.count("*").alias("questions"), F.count_if(ok).alias("correct"), F.count_if(~none).alias("real"), F.count_if(~none & ok).alias("correct_real"),
        F.count_if(none).alias("none_rows"), F.count_if(none & ok).alias("correct_none"), F.count_if(none & ~ok).alias("picked_when_none"), F.count_if(~known).alias("unusable"),
    )


def usage(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Per system: calls, failures, mean tokens and cost; calls has system, ok, tokens_in, tokens_out; prices a million tokens in and out."""
    cost = F.lit(None).cast("double")
    for name, (a, b) in prices.items():
        cost = F.when(F.col("system") == name, (F.col("tokens_in") * a + F.col("tokens_out") * b) / 1e6).otherwise(cost)
    ok = F.col("ok")
    return calls.groupBy("system").agg(
        F.count_if(ok).alias("calls"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("tokens_in"))), 1).alias("tokens_in_mean"),
        F.round(F.avg(F.when(ok, F.col("tokens_out"))), 1).alias("tokens_out_mean"), F.round(F.sum(F.when(ok, cost)), 6).alias("cost"),
    )


def progress(plan: DataFrame, log: DataFrame) -> DataFrame:
    """(system, rep, planned, done) of a plan (key, system, rep) against a log."""
    done = log.where("ok").select("key").distinct().withColumn("done", F.lit(1))
    return plan.join(done, "key", "left").groupBy("system", "rep").agg(F.count("*").alias("planned"), F.count("done").alias("done"))


def determinism(calls: DataFrame, repeats: int = 5) -> DataFrame:
    """(system, rows, changed): rows with exactly so many answers, and those with different ones."""
    per = calls.where("ok").groupBy("system", "row_id").agg(F.count("*").alias("n"), F.countDistinct("answer").alias("d"), F.count_if(F.col("answer").isNull()).alias("x"))
    kinds = F.col("d") + F.when(F.col("x") > 0, 1).otherwise(0)  # a missing answer is an answer of its own
    return per.where(F.col("n") == repeats).groupBy("system").agg(F.count("*").alias("rows"), F.count_if(kinds > 1).alias("changed"))


def option_cut(lengths: Column, head: int = HEAD) -> Column:
    """struct(per, kept): tokens left to each option when the head overruns (else null), and the share of tokens kept."""
    capped = F.transform(lengths, lambda n: F.least(n, F.lit(OPTION)) + 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x.cast("int"))
    n = F.greatest(F.size(lengths), F.lit(1))
    per = F.when(F.lit(head) - total(capped) < RESERVE, F.greatest(F.lit(LEAST), F.floor(F.lit(head - RESERVE) / n)).cast("int"))
    left = F.transform(capped, lambda c: F.least(c, F.coalesce(per, c)) - 1)
    return F.struct(per.alias("per"), F.when(total(lengths) == 0, 1.0).otherwise(total(left) / total(lengths)).alias("kept"))


def cut_report(calls: DataFrame) -> DataFrame:
    """Per option count, of calls (count, lengths, fits, collapsed, tokens): fitting and collapsed ones, median tokens and share kept."""
    made = calls.withColumn("kept", F.round(option_cut(F.col("lengths"))["kept"], 6))
    base = made.groupBy("count").agg(F.count("*").alias("calls"), F.count_if(~F.col("fits")).alias("not_fitting"), F.count_if(F.col("fits") & F.col("collapsed")).alias("collapsed"))
    half = lambda c, df: V.nearest_rank(df, ["count"], c, {f"{c}_p50": 0.5}).select("count", f"{c}_p50")
    return base.join(half("kept", made), "count").join(half("tokens", made.where("fits")), "count", "left")


def worst(samples: DataFrame) -> DataFrame:
    """(class, worst, sample) of timed samples (class, sample, ns), the worst class first."""
    top = samples.groupBy("class").agg(F.max(F.struct("ns", "sample")).alias("m"))
    return top.select("class", F.col("m.ns").alias("worst"), F.col("m.sample").alias("sample")).orderBy(F.desc("worst"), "class")


def doubling(samples: DataFrame) -> DataFrame:
    """(class, chars, ratio): best time at a length over best time at half of it."""
    best = samples.groupBy("class", "chars").agg(F.min("ns").alias("ns"))
    half = best.select("class", (F.col("chars") * 2).alias("chars"), F.col("ns").alias("half"))
    return best.join(half, ["class", "chars"]).select("class", "chars", (F.col("ns") / F.col("half")).alias("ratio"))


def repeated_answers(passes: DataFrame) -> DataFrame:
    """(probe, passes, answers) of rows (probe, pass, answer): how many different answers a probe had."""
    return passes.groupBy("probe").agg(F.countDistinct("pass").alias("passes"), F.countDistinct("answer").alias("answers"))


def audit(answer: Column, must: Column, must_not: Column) -> Column:
    """pass if a wanted reading stands in the answer, else fail if a superseded one does, else not_captured."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    has = lambda ts: F.exists(ts, lambda t: F.contains(plain(answer), plain(t)))
    return F.when(has(must), "pass").when(has(must_not), "fail").otherwise("not_captured")


def point_in_time(routed: DataFrame, versions: DataFrame) -> DataFrame:
    """routed (query_id, status, coordinates, temporal_hint) as (query_id, coordinate, day, answer status, amount, valid_from).

    One bound coordinate, one date, one row; otherwise the status says what is missing. versions: coordinate, valid_from, valid_to, amount.
    """
    one = F.when((F.col("status") == R.BOUNDED) & (F.size("coordinates") == 1), F.get("coordinates", F.lit(0)))
    h = routed.select("query_id", one.alias("coordinate"), dates.hint_date(F.col("temporal_hint")).alias("h"))
    q = h.select("query_id", "coordinate", F.col("h.day").alias("day"), F.col("h.status").alias("problem"))
    covered = versions.select("coordinate").distinct().withColumn("covered", F.lit(True))
    found = V.valid_at(q.where("coordinate is not null and day is not null").select("query_id", "coordinate", "day"), versions, "coordinate", "day")
    j = q.join(covered, "coordinate", "left").join(found.select("query_id", F.col("status").alias("found"), "amount", "valid_from"), "query_id", "left")
    status = F.when(F.col("coordinate").isNull(), "NOT_BOUND").when(F.col("day").isNull(), F.col("problem")).when(F.col("covered").isNull(), "NOT_COVERED").otherwise(F.col("found"))
    return j.select("query_id", "coordinate", "day", status.alias("answer"), "amount", "valid_from")


def sampleable(book: DataFrame, titles: DataFrame) -> DataFrame:
    """Instruments with structure, a title of at most 20 words and a full title that names them alone."""
    key = F.get(T.title_variants(F.col("title")), F.lit(0))
    alone = titles.groupBy("key").agg(F.count("*").alias("n")).where("n = 1").select("key")
    fit = book.where((F.col("structure") == "full") & (F.size(F.split(F.trim("title"), r"\s+")) <= MOST_TITLE_WORDS)).withColumn("key", key)
    return fit.join(alone, "key", "left_semi").drop("key")


def written_provision(tail: Column) -> Column:
    """struct(long, short) of a tail such as s124/1ZA or sch2/para3/1; null where it is not phrased."""
    pattern = r"^(s|reg|art|rule)([0-9]{1,4}[A-Z]{0,3})((?:/[0-9A-Za-z]{1,4}){0,2})$"
    unit, n = F.regexp_extract(tail, pattern, 1), F.regexp_extract(tail, pattern, 2)
    brackets = lambda x: F.array_join(F.transform(F.filter(F.split(x, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("("), s, F.lit(")"))), "")
    subs = brackets(F.regexp_extract(tail, pattern, 3))
    name = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in LONG.items() for x in (k, v[i])]), unit)
    one = F.struct(F.concat(name(0), F.lit(" "), n, subs).alias("long"), F.concat(name(1), F.lit(" "), n, subs).alias("short"))
    pattern2 = r"^sch([0-9]{1,3}[A-Z]?)/para([0-9]{1,3}[A-Z]?)((?:/[0-9A-Za-z]{1,4}){0,1})$"
    sch, para, more = F.regexp_extract(tail, pattern2, 1), F.regexp_extract(tail, pattern2, 2), brackets(F.regexp_extract(tail, pattern2, 3))
    two = F.struct(F.concat(F.lit("paragraph "), para, more, F.lit(" of Schedule "), sch).alias("long"), F.concat(F.lit("Sch. "), sch, F.lit(" para. "), para, more).alias("short"))
    return F.when(unit != "", one).when(sch != "", two)


def phrased(rows: DataFrame, seed: int) -> DataFrame:
    """rows (coordinate, tail, series, title, year, number) with query: the provision cited in a form chosen by hash."""
    w = rows.withColumn("w", written_provision(F.col("tail"))).where("w is not null")
    calendar = F.col("coordinate").rlike("^uk/[a-z]+/[0-9]{4}/")
    arr = lambda xs: F.array(*map(F.lit, xs))
    si = F.col("series").isin("uksi", "wsi", "nisi")
    forms = F.when(si, F.when(calendar, arr(SI_FORMS + SI_NUMBER_FORMS)).otherwise(arr(SI_FORMS))).when(
        calendar & (F.col("series") == "ukpga"), arr(ACT_FORMS + ACT_NUMBER_FORMS)
    ).otherwise(arr(ACT_FORMS))
    form = F.get(forms, F.pmod(F.xxhash64(F.lit(seed), "coordinate"), F.size(forms)).cast("int"))
    title = F.when(si, F.regexp_replace("title", "^The ", "")).otherwise(F.col("title"))
    text = form
    for name, value in {"long": F.col("w.long"), "short": F.col("w.short"), "title": title, "year": F.col("year").cast("string"), "number": F.col("number").cast("string")}.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return w.select(*rows.columns, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))).alias("query"))


def unit_of(tail: Column) -> Column:
    """The section-level unit that a tail lies in: its outermost section, article, regulation, rule or schedule paragraph; null if none."""
    seg = F.split(tail, "/")
    place = F.array_position(F.transform(seg, lambda s: s.rlike("^(s|art|reg|rule|para)[0-9A-Z]")), True).cast("int")
    return F.when(place > 0, F.array_join(F.slice(seg, F.lit(1), place), "/"))


def carried_over(rows: DataFrame, before: DataFrame, key: str, value: str, same: list[str]) -> DataFrame:
    """rows with value taken from before where the row of that key agrees in all of same (null agrees with null)."""
    old = before.select(F.col(key).alias("_k"), F.col(value).alias("_v"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(same)])
    agree = F.col(key) == F.col("_k")
    for i, c in enumerate(same):
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return rows.join(old, agree, "left").withColumn(value, F.coalesce("_v", value)).select(rows.columns)


def absent(searches: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, absent): searched titles (row_id, title with its year, status, found by number?) that no result (row_id, title) has.

    A search by number is absent on 400, 404 and 410. Null where nothing is cached (status null).
    """
    key = lambda c: F.get(T.title_variants(F.col(c)), F.lit(0))
    hit = results.select("row_id", key("title").alias("k")).distinct()
    j = searches.withColumn("k", key("title")).join(hit.withColumn("hit", F.lit(True)), ["row_id", "k"], "left")
    out = F.when(F.col("status").isNull(), F.lit(None).cast("boolean")).when(F.col("by_number"), F.col("status").isin(400, 404, 410)).otherwise((F.col("status") == 200) & F.col("hit").isNull())
    return j.select("row_id", out.alias("absent"))


def cached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """urls with the cached body, null where the cache has none; the cache is keyed by SHA-256 of the address."""
    return urls.join(cache, F.sha2("url", 256) == F.col("url_sha256"), "left").drop("url_sha256")


def paired_order(pairs: DataFrame, seed: int) -> DataFrame:
    """pairs (pair) twice, as first and second call, each pair's order and place by hash."""
    flip = F.pmod(F.xxhash64(F.lit(seed), "pair", F.lit("flip")), F.lit(2)) == 1
    sides = F.when(flip, F.array(F.lit("floor"), F.lit("route"))).otherwise(F.array(F.lit("route"), F.lit("floor")))
    return pairs.select("pair", F.xxhash64(F.lit(seed), "pair").alias("turn"), F.posexplode(sides).alias("place", "side"))


def revalidated(candidates: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Candidates that the book still has."""
    return candidates.join(coordinates.select("coordinate").distinct(), "coordinate", "left_semi")


def invented_title(query: Column) -> Column:
    """struct(title, year) of the last title with a type word and a year in a query; null if there is none."""
    pattern = F.lit(r"(?i)([^,;]*?\b(?:act|order|regulations|rules)\s+(\d{4}))\b")
    found = [F.try_element_at(F.regexp_extract_all(query, pattern, F.lit(g)), F.lit(-1)) for g in (1, 2)]
    has = F.size(F.regexp_extract_all(query, pattern, F.lit(1))) > 0
    return F.when(has, F.struct(F.trim(found[0]).alias("title"), found[1].cast("int").alias("year")))
