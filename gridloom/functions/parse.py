"""Parsing of timestamps, numbers, settlement periods, labels and names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted timestamp layouts, tried in this order.
TS_FORMATS = (
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss XXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
)
# Accepted settlement date layouts.
DATE_FORMATS = (
    "dd-MMM-yyyy",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "dd-MMM-yyyy HH:mm:ss",
)
# Pattern of ISO dates and the share of them that rules day-first out.
ISO_LIKE = r"^\s*\d{4}-\d{2}-\d{2}([ T].*)?\s*$"
DAYFIRST_SHARE = 0.7
NUMBER_LIKE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$"


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def timestamp_multi(text: str | Column, formats: Sequence[str] = TS_FORMATS, dayfirst: bool = True) -> Column:
    """First format that parses wins, then any other usual layout; null when none does.

    A format is tried only on texts of its shape: a failed parse raises an exception inside
    Spark and costs far more than a match against a short pattern.
    """
    text = F.trim(_c(text))
    named = [F.when(_may_be(text, f) & text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(*named, general_timestamp(text, dayfirst))


def general_timestamp(text: Column, dayfirst: bool = True) -> Column:
    """Layouts beyond the named ones: fractions of a second, days and months of one digit, zones without a colon, times
    without seconds, month names. Dates with slashes or ending in the year are read day-first or month-first."""
    order = "$3-$2-$1$4" if dayfirst else "$3-$1-$2$4"
    plain = F.regexp_replace(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(.*)$", order)
    plain = F.regexp_replace(plain, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    plain = F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?) ?([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    usual = plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?( ?(Z|UTC|[+-]\d{2}:\d{2}))?)?$")
    month = F.regexp_replace(text, r"^(\d)([ -])", "0$1$2")
    layouts = ("dd-MMM-yyyy", "dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "dd MMM yyyy", "dd MMM yyyy HH:mm:ss")
    named = [F.when(month.rlike(_shape(f)), F.try_to_timestamp(F.initcap(month), F.lit(f))) for f in layouts]
    return F.coalesce(F.when(usual, plain.try_cast("timestamp")), *named)


def _may_be(text: Column, layout: str) -> Column:
    """Whether a text has a length of the layout and its first mark in the same place: one pattern at most is then matched."""
    plain = layout.replace("'", "")
    size = len(plain.replace("XXX", ""))
    zone = ("XXX" in layout) * 1
    mark = next(i for i, c in enumerate(plain) if not c.isalpha())
    lengths = [size + 1, size + 6] if zone else [size]
    return F.length(text).isin(lengths) & (F.substring(text, mark + 1, 1) == plain[mark])


def _shape(layout: str) -> str:
    """Pattern of the texts a layout can match."""
    out, i = "", 0
    while i < len(layout):
        letter = layout[i]
        run = len(layout[i:]) - len(layout[i:].lstrip(letter))
        if letter == "'":
            end = layout.index("'", i + 1)
            out += re.escape(layout[i + 1 : end])
            run = end + 1 - i
        elif letter == "M" and run == 3:
            out += "[A-Za-z]{3}"
        elif letter == "X":
            out += r"(Z|[+-]\d{2}:\d{2})"
        elif letter.isalpha():
            out += rf"\d{{{run}}}"
        else:
            out += re.escape(letter) * run
        i += run
    return f"^{out}$"


def date_multi(text: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return timestamp_multi(text, formats)


def settlement_instant(date: str | Column, period: str | Column) -> Column:
    """Start of a half-hour settlement period; periods below 1 or missing count as 1."""
    day = _c(date)
    number = F.greatest(F.coalesce(_c(period).try_cast("double").try_cast("int"), F.lit(1)), F.lit(1))
    return day.cast("timestamp") + F.make_dt_interval(mins=(number - 1) * 30)


def plain_number(text: str | Column) -> Column:
    """Text as double, invalid becomes null; only texts that look like numbers are converted,
    since a failed conversion raises an exception inside Spark."""
    text = F.trim(_c(text))
    return F.when(text.rlike(NUMBER_LIKE), text.try_cast("double"))


def number(text: str | Column) -> Column:
    """Trim, drop thousands separators, invalid becomes null."""
    return plain_number(F.replace(_c(text), F.lit(","), F.lit("")))


def dayfirst_share(df: DataFrame, column: str) -> float:
    """Share of the non-null values that look like ISO dates."""
    share = df.where(F.col(column).isNotNull()).agg(F.avg(F.col(column).rlike(ISO_LIKE).cast("int"))).first()[0]
    return 0.0 if share is None else float(share)


def parse_detected(df: DataFrame, column: str, name: str) -> DataFrame:
    """Parse dates day-first when fewer than 70 % of the values look like ISO dates."""
    dayfirst = dayfirst_share(df, column) < DAYFIRST_SHARE
    slashed = ("dd/MM/yyyy", "dd-MM-yyyy") if dayfirst else ("MM/dd/yyyy", "MM-dd-yyyy")
    return df.withColumn(name, timestamp_multi(column, ("yyyy-MM-dd", *slashed), dayfirst))


def month_label(text: str | Column) -> Column:
    """``Apr-23`` as the first of that month; years 69 to 99 belong to the last century.

    Other texts are tried as full dates.
    """
    label = F.trim(_c(text))
    found = F.when(label.rlike(_shape("MMM-yy")), F.try_to_timestamp(label, F.lit("MMM-yy")))
    earlier = F.add_months(found, -1200).cast("timestamp")
    return F.coalesce(F.when(F.year(found) >= 2069, earlier).otherwise(found), timestamp_multi(text))


def fiscal_start(text: str | Column) -> Column:
    """1 April of the first four-digit year in a financial-year label."""
    year = F.nullif(F.regexp_extract(_c(text), r"((19|20)\d{2})", 1), F.lit("")).cast("int")
    return F.make_date(year, F.lit(4), F.lit(1))


def year_in_name(name: str | Column) -> Column:
    found = F.nullif(F.regexp_extract(_c(name), r"((19|20)\d{2})", 1), F.lit(""))
    return F.coalesce(found, F.lit("unknown"))


def infer_year(df: DataFrame, group: str, date_text: str, name: str, order: str) -> DataFrame:
    """Year per group: the first value that parses as a date, else a year in the name."""
    parsed = timestamp_multi(date_text)
    first = F.min_by(F.year(parsed), F.when(parsed.isNotNull(), F.col(order)))
    return df.groupBy(group).agg(
        F.coalesce(first.cast("string"), F.min(year_in_name(name))).alias("inferred_year")
    )


def nominal_kv(site: str | Column) -> Column:
    """Voltage named in a site label, 33 where none is."""
    found = F.nullif(F.regexp_extract(_c(site), r"(?i)(\d{2,3})\s*k\s*v", 1), F.lit(""))
    return F.coalesce(found.cast("int"), F.lit(33))


def slug(text: str | Column, joiner: str = "_", fallback: str = "unknown") -> Column:
    """Lower case, everything else joined; ``fallback`` when nothing is left."""
    body = F.regexp_replace(F.lower(F.trim(_c(text))), "[^a-z0-9]+", joiner)
    bare = F.regexp_replace(body, f"^{joiner}+|{joiner}+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(fallback))


def iso_z(ts: str | Column) -> Column:
    return F.coalesce(F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def file_month(name: str | Column) -> Column:
    """Sortable key of a monthly file named ``f-<year>-<month>``; null for other names."""
    year = F.nullif(F.regexp_extract(_c(name), r"f-(\d{4})-(\d{1,2})", 1), F.lit("")).cast("int")
    month = F.nullif(F.regexp_extract(_c(name), r"f-(\d{4})-(\d{1,2})", 2), F.lit("")).cast("int")
    return year * 100 + month


def money(value: str | Column, digits: int = 0) -> Column:
    """Pounds with thousands separators; blank for null."""
    value = _c(value)
    sign = F.when(value < 0, "-").otherwise("")
    return F.coalesce(F.concat(F.lit("£"), sign, F.format_number(F.abs(value), digits)), F.lit(""))
