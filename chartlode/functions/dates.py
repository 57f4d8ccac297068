"""Dates and periods. Column in, Column out; now and today are always arguments."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartlode.functions.text import let

# Russian month names, by their beginnings.
MONTHS = ("янв", "фев", "мар", "апр", "ма", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")


def parse_date(x: Column) -> Column:
    """SC-50. ISO date or time, dd.mm.yyyy with or without a time, dd/mm/yyyy, or day, Russian month and year; else null."""
    s = F.trim(x)
    t = lambda v, f: F.try_to_timestamp(v, F.lit(f)).cast("timestamp_ntz")
    iso = F.coalesce(t(F.translate(F.substring(s, 1, 19), "T", " "), "yyyy-MM-dd HH:mm:ss"), t(s, "yyyy-MM-dd"))
    month = F.lower(F.regexp_extract(s, r"(?U)^\d{1,2}\s+(\p{L}+)\s+\d{4}", 1))
    number = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(MONTHS, 1))):
        number = F.when(month.startswith(name) & (F.lit(k) != 5) | ((F.lit(k) == 5) & month.rlike("^ма[йя]")), F.lit(k)).otherwise(number)
    named = t(F.concat_ws("-", F.regexp_extract(s, r"(\d{4})", 1), number.cast("string"), F.regexp_extract(s, r"^(\d{1,2})", 1)), "yyyy-M-d")
    numeric = F.coalesce(t(s, "d.M.yyyy HH:mm"), t(s, "d.M.yyyy"), t(s, "d/M/yyyy"))
    return F.coalesce(iso, numeric, F.when(number.isNotNull(), named))


def strict_date(x: Column) -> Column:
    """SC-51. yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy, else null."""
    t = lambda f: F.try_to_timestamp(x, F.lit(f)).cast("date")
    return F.coalesce(t("yyyy-MM-dd"), t("dd.MM.yyyy"), t("dd/MM/yyyy"))


def preset(name: str, today: Column) -> Column:
    """SC-52. First day of month (one month back), 3m, year; null (open) for all."""
    back = {"month": -1, "3m": -3, "year": -12}.get(name)
    return F.lit(None).cast("date") if back is None else F.add_months(today, back)


def period(x: Column) -> Column:
    """SC-53. (from, to) of `YYYY-MM` or `YYYY-MM-DD`, to its last second."""
    first = F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.concat(x, F.lit("-01")), F.lit("yyyy-MM-dd"))).cast("date")
    last = F.when(F.length(x) == 7, F.last_day(first)).otherwise(first)
    return F.struct(first.cast("timestamp_ntz").alias("from"), F.timestamp_add("SECOND", F.lit(86_399), last.cast("timestamp_ntz")).alias("to"))


def age(born: Column, on: Column) -> Column:
    """SC-54. Completed years."""
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(on) - F.year(born) - before.cast("int")


# Words after `дата` and words by themselves that a visit's date follows, and what marks a date of birth.
DATED = ("исследования", r"исслед\.?", "при[её]ма", "осмотра", "визита", "записи", "проведения")
VISITS = ("исследован[иея]", "при[её]м", "осмотр")
BIRTH = ("рожд", "birth", r"д\.?\s*р\.?")


def visit_date(text: Column) -> Column:
    """SC-55. A labelled date, else the first date that has no word of birth from 40 characters before to 10 after it."""
    labels = [rf"дата\s+{w}" for w in DATED] + [rf"{w}(?:\s+от|от)?" for w in VISITS]
    label = rf"(?iU)(?:{'|'.join(labels)})[\s:]+(\d\d?[/.]\d\d?[/.]\d\d(?:\d\d?)?)"
    dated = r"(\b\d{1,2}[./]\d{1,2}[./]\d{4}\b)"

    def visit(t: Column) -> Column:
        labelled = let(F.regexp_extract(t, label, 1), lambda s: F.when(s != "", padded_date(s)))

        def step(acc: Column, d: Column) -> Column:
            # Each date's place is looked for after the one before it; after the first that stands by itself none is.
            near = lambda at: F.substr(t, F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40)) + F.length(d) + 10)
            plain = lambda at: F.when(~near(at).rlike("(?iU)" + "|".join(BIRTH)), padded_date(d))
            seen = let(F.call_function("locate", d, t, acc["next"]), lambda at: F.struct((at + F.length(d)).alias("next"), plain(at).alias("day")))
            return F.when(acc["day"].isNotNull(), acc).otherwise(seen)

        start = F.struct(F.lit(1).alias("next"), F.lit(None).cast("date").alias("day"))
        return F.coalesce(labelled, F.aggregate(F.regexp_extract_all(t, F.lit(dated), F.lit(1)), start, step, lambda acc: acc["day"]))

    return let(text, visit)


def padded_date(x: Column) -> Column:
    """The date that x is once padded(), which has only one form; null if there is no such day."""
    return F.try_to_timestamp(padded(x), F.lit("dd.MM.yyyy")).cast("date")


def padded(x: Column) -> Column:
    """dd.mm.yyyy of a date with one-digit parts, slashes or a two-digit year."""
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    whole = lambda p: F.concat_ws(".", F.lpad(F.get(p, F.lit(0)), 2, "0"), F.lpad(F.get(p, F.lit(1)), 2, "0"), year(F.get(p, F.lit(2))))
    return let(F.split(F.translate(x, "/", "."), r"\."), whole)


def same_day(a: Column, b: Column) -> Column:
    """SC-56."""
    return F.to_date(a) == F.to_date(b)


def day_bounds(day: datetime.date) -> tuple[Column, Column]:
    """First moment of a day and of the next."""
    return F.lit(day).cast("timestamp_ntz"), F.lit(day + datetime.timedelta(days=1)).cast("timestamp_ntz")
