"""Dates with a precision, and the three orders in which a record's date is chosen."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _month(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for k in dict.fromkeys((m, m[:3])) for x in (k, i)])
    word = F.lower(F.regexp_replace(F.trim(c), r"\.$", ""))
    return F.coalesce(F.try_element_at(names, word), word.try_cast("int"))


def parse_date_parts(year: Column, month: Column, day: Column) -> Column:
    """struct(value, precision) of text parts: months by number or English name; impossible dates and years give null."""
    m, d = F.when(F.trim(F.coalesce(month, F.lit(""))) != "", month), F.when(F.trim(F.coalesce(day, F.lit(""))) != "", day)
    number = F.when(m.isNull(), F.lit(1)).otherwise(_month(m))
    of_month = F.when(m.isNull() | d.isNull(), F.lit(1)).otherwise(F.trim(d).try_cast("int"))
    text = F.format_string("%04d-%02d-%02d", F.trim(year).try_cast("int"), number, of_month)
    value = F.when(F.trim(year).rlike(r"^\d{4}$") & number.between(1, 12) & of_month.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))
    precision = F.when(m.isNull(), "year").when(d.isNull(), "month").otherwise("day")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), precision.alias("precision")))


_FULL = r"^\s*(\d{4})(?:[-/ ](\d{1,2}|[A-Za-z]{3,9})(?:[-/ ](\d{1,2}))?)?\s*$"


def parse_flexible_date(c: Column) -> Column:
    """`YYYY`, `YYYY-MM`, `YYYY Mon DD` and the like; of other text the first lone four-digit year."""
    part = lambda i: F.regexp_extract(c, _FULL, i)
    year = F.regexp_extract(c, r"\b(\d{4})\b", 1)
    none = F.lit(None).cast("string")
    return F.when(c.rlike(_FULL), parse_date_parts(part(1), part(2), part(3))).otherwise(parse_date_parts(F.when(year != "", year), none, none))


def earliest(*cols: Column) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def dedup_date() -> Column:
    return F.coalesce("first_date", "published_date", "updated_date")


def display_date() -> Column:
    return F.coalesce("updated_date", "published_date", "first_date")


def retention_date() -> Column:
    return F.when(F.col("record_type") == "clinical_trial", F.coalesce("updated_date", "published_date", "first_date")).otherwise(
        F.coalesce("electronic_published_date", "published_date", "first_date", "updated_date")
    )


def in_last_days(c: Column, as_of: date | str, n: int) -> Column:
    """The last n days up to and with as_of."""
    end = F.lit(str(as_of)).cast("date")
    return c.between(F.date_sub(end, n - 1), end)
