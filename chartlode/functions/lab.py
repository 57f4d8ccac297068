"""Laboratory values, references and lines. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"
# Heads and foots of a form, which are no results.
NOISE_NAMES = ("исследование", "результат", "результаты", "единицы", "значения", "референс", "норма", "комментарии", "комментарий", "исполнитель", "внимание", "страница", "пол", "возраст", "врач", "дата", "описание бланка результатов", "-", "—", "%", "п/з", "в п/зр.")
NOISE_STARTS = ("дата ", "перейти на ", "результаты исследований не являются", "внимание!", "* результат", "инз:", "www.")


def to_float(x: Column) -> Column:
    """SC-30. A number with a comma or a dot; null if it is none."""
    return F.translate(x, ",", ".").try_cast("double")


def lab_value(x: Column) -> Column:
    """SC-31. (num, text): a leading number without what follows; an operator or anything else is text; nothing for a blank."""
    s = F.trim(x)
    lead, signed = F.nullif(F.regexp_extract(s, f"^({NUMBER})", 1), F.lit("")), F.substring(s, 1, 1).isin("<", ">", "≤", "≥")
    return F.struct(F.when(~signed, to_float(lead)).alias("num"), F.when((s != "") & (signed | lead.isNull()), s).alias("text"))


def reference(x: Column) -> Column:
    """SC-32. (low, high, op, text) of a whole reference, digits apart by spaces joined first."""
    s = F.regexp_replace(F.trim(x), r"(?<=[0-9])\s+(?=[0-9])", "")
    part = lambda pattern, k: F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))
    # Which pattern is tried is seen by the first character.
    upper, lower = (F.coalesce(F.substring(s, 1, 1).isin(*signs), F.lit(False)) for signs in (("<", "≤"), (">", "≥")))
    span, bound = rf"^({NUMBER})\s*[-–—]\s*({NUMBER})$", part(rf"^[<≤>≥]\s*({NUMBER})$", 1)
    known = F.when(upper | lower, bound.isNotNull()).otherwise(part(span, 1).isNotNull())
    return F.struct(
        F.when(lower, to_float(bound)).when(~upper, to_float(part(span, 1))).alias("low"),
        F.when(upper, to_float(bound)).when(~lower, to_float(part(span, 2))).alias("high"),
        F.when(upper & bound.isNotNull(), "<").when(lower & bound.isNotNull(), ">").alias("op"),
        F.when((s != "") & ~known, s).alias("text"),
    )


def reference_in_text(x: Column) -> Column:
    """SC-33. (low, high) from the first range anywhere in a text, else from the first upper or lower bound."""
    positive = r"[0-9]+(?:[.,][0-9]+)?"
    part = lambda pattern, k: to_float(F.nullif(F.regexp_extract(x, pattern, k), F.lit("")))
    span = rf"({positive})\s*[-–—]\s*({positive})"
    ranged = x.rlike(span)
    upper = part(rf"[<≤]\s*({positive})", 1)
    return F.struct(F.when(ranged, part(span, 1)).when(upper.isNull(), part(rf"[>≥]\s*({positive})", 1)).alias("low"), F.when(ranged, part(span, 2)).otherwise(upper).alias("high"))


def status(value: Column, low: Column, high: Column) -> Column:
    """SC-34. low, high, normal (bounds included) or unknown."""
    return F.when(value.isNull() | (low.isNull() & high.isNull()), "unknown").when(value < low, "low").when(value > high, "high").otherwise("normal")


def marker(value: Column, low: Column, high: Column) -> Column:
    """SC-35. An arrow for a value outside its bounds, else ''."""
    return F.when(value < low, "↓").when(value > high, "↑").otherwise("")


def position(value: Column, low: Column, high: Column) -> Column:
    """SC-36. Place on a scale of 0..100 on which the bounds are 25 and 75; null unless they span something."""
    span = high - low
    return F.when((span > 0) & value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 25 + 50 * (value - low) / span)))


def number_tokens(x: Column) -> Column:
    """SC-37. Numbers of a text in order, a comma as a dot, `.0` at the end cut."""
    found = F.regexp_extract_all(x, F.lit(r"(?<![0-9.,])(-?[0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(F.translate(s, ",", "."), r"\.0$", ""))


def looks_like_reference(x: Column) -> Column:
    """SC-38."""
    return x.rlike(rf"^(?:{NUMBER}\s*[-–—]\s*{NUMBER}|[<≤>≥]\s*{NUMBER})$")


def looks_like_number(x: Column) -> Column:
    """SC-38."""
    return F.trim(x).rlike("^-?[0-9]")


def unmerge(value: Column, most: float = 15) -> Column:
    """SC-39. A value whose digits ran together: tenths until it is most or less."""
    return value / F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.ceil(F.log10(F.greatest(value, F.lit(1e-9)) / most)).cast("double")))


def unit_mismatch(match_status: Column, unit: Column, expected: Column) -> Column:
    """SC-42. Null unless the name matched and both sides have a unit; else whether the unit is none of the expected."""
    from chartlode.functions.text import canonical_unit

    return F.when((match_status == "matched") & unit.isNotNull() & (F.size(expected) > 0), ~F.array_contains(F.transform(expected, canonical_unit), canonical_unit(unit)))


def rate(tokens: Column, seconds: Column) -> Column:
    """SC-44. Tokens a second, null without time or tokens."""
    return F.when((seconds > 0) & (tokens > 0), F.round(F.round(tokens / seconds, 6), 2))


def near(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """SC-46. Equal but for the tolerance; false if either is null."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def is_noise(line: Column) -> Column:
    """The text rule of FLT-11 alone: an empty line, or over 100 characters of prose without a digit."""
    return (F.trim(line) == "") | ((F.length(line) > 100) & ~line.rlike("[0-9]"))


def is_noise_row(name: Column, value_num: Column, value_text: Column, unit: Column, low: Column, high: Column) -> Column:
    """FLT-11. Heads, foots, prose and placeholders among a form's results."""
    from chartlode.functions.text import name_key

    key = F.coalesce(name_key(name), F.lit(""))
    starts = F.lit(False)
    for s in NOISE_STARTS:
        starts = starts | F.lower(F.trim(name)).startswith(s)
    empty = value_num.isNull() & F.coalesce(F.trim(value_text), F.lit("")).isin("", "—", "-", "–") & (F.coalesce(unit, F.lit("")) == "") & low.isNull() & high.isNull()
    return (key == "") | key.isin(*NOISE_NAMES) | starts | (value_num.isNull() & (F.length(F.trim(name)) > 100)) | empty
