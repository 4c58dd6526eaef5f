"""Dates in texts of mixed forms: which form a value has, which date it is, and whether a column holds dates alone.

Each value is read on its own: year first; month first, and day first where the first number can't be a month; month names;
compact digits; with or without a time of day and a zone. A column holds dates if every value that is not blank is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Names of months and days as they stand in texts, and words that stand for no date.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
         "|nov(?:ember)?|dec(?:ember)?)")
WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\\s+)?"
BLANKS = ["", "nat", "nan", "none", "null"]

CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?\s*(am|pm)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?$"
TIME = r"(?i)(?:(?<=\d)[Tt]|\s+)" + CLOCK
#: Forms of the part before the time: name, pattern, and where year, month and day stand in it (0: the first of its period).
FORMS = [
    ("year_first", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", (1, 2, 3)),
    ("numbers", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", (3, 1, 2)),
    ("numbers", r"^(\d{2})(\d{2})(\d{2})$", (3, 1, 2)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    ("year", r"^(\d{4})$", (1, 0, 0)),
    ("year_month", r"^(\d{4})[-/](\d{1,2})$", (1, 2, 0)),
    ("year_month", r"^(\d{1,2})[-/](\d{4})$", (2, 1, 0)),
    ("named", rf"(?i)^{WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{MONTH}[\s,-]+(\d{{4}}|\d{{2}})$", (3, 2, 1)),
    ("named", rf"(?i)^{WEEKDAY}{MONTH}[\s-]+(\d{{1,2}})(?:st|nd|rd|th)?,?[\s-]+(\d{{4}})$", (3, 1, 2)),
    ("named", rf"(?i)^{MONTH}[\s-]+(\d{{4}})$", (2, 1, 0)),
    ("named", rf"(?i)^(\d{{4}})[\s-]+{MONTH}$", (1, 2, 0)),
]


def _number(text: Column) -> Column:
    """A number from up to four digits, or the place of a month's name."""
    name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(text, F.lit(3)))).cast("int")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(name)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none such."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    usual = year.between(1678, 2261) & month.between(1, 12) & day.between(1, 31)
    return F.when(usual, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value worked out once, whatever number of times it is used."""
    return F.element_at(F.transform(F.array(value), build), 1)


def read_date(value: Column) -> Column:
    """(form, date, zoned) of a text; form and date are null where it is no date. ``numbers`` becomes month_first or
    day_first: the month stands first unless only the day can."""
    return _bound(F.trim(F.regexp_replace(value, r"\s+", " ")), lambda text: _bound(
        F.struct(text.alias("text"), F.regexp_replace(text, TIME, "").alias("body")), lambda s: _read(s["text"], s["body"])))


def _read(text: Column, body: Column) -> Column:
    clock = [F.regexp_extract(text, TIME, i) for i in range(1, 6)]
    timed = F.regexp_like(text, F.lit(TIME))
    hour, minute, second = (F.when(c != "", c.try_cast("int")) for c in clock[:3])
    most = F.when(clock[3] == "", 23).otherwise(12)
    right = ~timed | ((hour <= most) & (minute <= 59) & (F.coalesce(second, F.lit(0)) <= 59))
    none = F.lit(None)
    form, date = none.cast("string"), none.cast("date")
    for name, pattern, places in reversed(FORMS):
        year, month, day = (_number(F.regexp_extract(body, pattern, p)) if p else F.lit(1) for p in places)
        year = F.when(year < 100, year + 2000).otherwise(year)
        found = _date(year, month, day)
        here = F.regexp_like(body, F.lit(pattern))
        if name == "numbers":
            swapped = F.when(month > 12, _date(year, day, month))
            label = F.when(found.isNotNull(), "month_first").when(swapped.isNotNull(), "day_first")
            found = F.coalesce(found, swapped)
        else:
            label = F.when(found.isNotNull(), name)
        form, date = F.when(here, label).otherwise(form), F.when(here, found).otherwise(date)
    alone = F.regexp_like(text, F.lit("(?i)^" + CLOCK)) & ~timed  # a time of day without a date
    first = [F.regexp_extract(text, "(?i)^" + CLOCK, i).try_cast("int") for i in (1, 2)]
    form = F.when(alone & (first[0] <= 23) & (first[1] <= 59), "time").otherwise(form)
    return F.struct(F.when(right, form).alias("form"), F.when(right, date).alias("date"),
                    (right & form.isNotNull() & (clock[4] != "")).alias("zoned"))


def is_blank(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(BLANKS)


def date_forms(counts: DataFrame) -> DataFrame:
    """``counts``: column, value, copies. (column, form, zoned, distinct_values, rows); form is blank, other, or a form of dates.
    One pass over the distinct values."""
    read = counts.withColumn("_d", read_date(F.col("value")))
    form = F.when(is_blank(F.col("value")), "blank").otherwise(F.coalesce("_d.form", F.lit("other")))
    return (read.select("column", form.alias("form"), F.col("_d.zoned").alias("zoned"), "copies")
            .groupBy("column", "form", "zoned").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("copies").alias("rows")))
