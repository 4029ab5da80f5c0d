"""The one calendar date of a phrase, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import let

# How months are written, and the four written forms of a date.
MONTHS = "january february march april may june july august september october november december".split()
SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sept": 9, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_MONTH = "|".join([*MONTHS, *sorted(SHORT, key=len, reverse=True)])
#: (pattern, the groups of year, month and day)
FORMS = (
    (rf"(?<![a-z\d])(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?,?\s+(\d{{4}})(?!\d)", (3, 2, 1)),
    (rf"(?<![a-z])({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)", (3, 1, 2)),
    (r"(?<![\d.])(\d{1,2})\s*[./]\s*(\d{1,2})\s*[./]\s*(\d{4})(?!\d)", (3, 2, 1)),
    (r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", (1, 2, 3)),
)
# End of the fixed values.


def _month(name: Column) -> Column:
    table = {m: i + 1 for i, m in enumerate(MONTHS)} | SHORT
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), name), F.expr("cast(null as int)"))


def _day(x: Column) -> Column:
    month = F.when(x["m"].rlike("^[0-9]+$"), x["m"].try_cast("int")).otherwise(_month(x["m"]))
    return F.concat_ws("-", F.lpad(x["y"], 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(x["d"], 2, "0")).try_cast("date")


def hint_date(text: Column) -> Column:
    """struct(day date, status string): the day if the text has one date; else NO_DATE, IMPRECISE_DATE or AMBIGUOUS. Null: NO_DATE."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = []
    for pattern, (y, m, d) in FORMS:
        hits = [F.regexp_extract_all(low, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((y, "y"), (m, "m"), (d, "d"))]
        every.append(F.transform(F.arrays_zip(*hits), _day))
    days = F.array_distinct(F.filter(F.concat(*every), lambda x: x.isNotNull()))
    year = low.rlike(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)")

    def of(found: Column) -> Column:
        status = F.when(F.size(found) > 1, "AMBIGUOUS").when((F.size(found) == 0) & year, "IMPRECISE_DATE").when(F.size(found) == 0, "NO_DATE")
        return F.struct(F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("day"), status.alias("status"))

    return let(days, of)


def day_before(day: Column) -> Column:
    return F.date_sub(day, 1)


def answer_text(status: Column, amount: Column, provision: Column, day: Column, valid_from: Column, valid_to: Column, source: Column) -> Column:
    """A figure only where exactly one row was found."""
    until = F.when(valid_to.isNull(), "until replaced").otherwise(F.concat(F.lit("to "), day_before(valid_to).cast("string")))
    found = F.concat(amount, F.lit(". "), provision, F.lit(", as at "), day.cast("string"), F.lit(": set by "), source, F.lit(", in force "), valid_from.cast("string"), F.lit(" "), until, F.lit("."))
    return F.when(status == "FOUND", found).otherwise(F.concat(F.lit("No figure: "), status, F.lit(".")))
