"""Scalar columns of the news engine: dates, ratios, text pieces. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits: years accepted in dates, least size of a topic's input, chunk sizes.
YEARS, TOPIC_MIN_CHARS, TOPIC_MIN_WORDS = (1900, 2100), 30, 5
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_WORDS, WORD_OVERLAP = 3000, 400, 450, 100


def moment(when: Column, kind: str = "string") -> Column:
    """``when`` as a timestamp, null where it is none. ``kind``: the column's type; dates and timestamps aren't parsed."""
    return when.cast("timestamp") if kind in ("date", "timestamp", "timestamp_ntz") else F.try_to_timestamp(when.cast("string"))


def _stated(year: Column | None, month: Column | None) -> Column:
    """The first day of a plausible year and month, else null."""
    if year is None or month is None:
        return F.lit(None).cast("date")
    y, m = (c.cast("string").try_cast("double").cast("int") for c in (year, month))
    return F.when(m.between(1, 12) & y.between(*YEARS), F.make_date(y, m, F.lit(1)))


def month_start(when: Column, year: Column | None = None, month: Column | None = None, kind: str = "string") -> Column:
    """The first day of the month of ``when``; without a date, of a plausible year and month; or null."""
    return F.coalesce(F.to_date(F.date_trunc("month", moment(when, kind))), _stated(year, month))


def effective_date(when: Column, year: Column | None = None, month: Column | None = None, kind: str = "string") -> Column:
    """``when`` itself as a timestamp; without a date, the first day of a plausible year and month; or null."""
    return F.coalesce(moment(when, kind), _stated(year, month).cast("timestamp"))


def number_or_zero(value: Column, kind: str) -> Column:
    """``value`` as a number of type ``kind``; 0 for null, NaN and what is no number."""
    x = value.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)).cast(kind)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def stripped(text: Column) -> Column:
    """Without white space of any alphabet at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"(?U)\s+", " ")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def without_links(text: Column) -> Column:
    """Links, what is left of broken ones, and mail addresses removed, each for a space."""
    out = F.regexp_replace(text, r"(?i)https?://\S+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)www\.\S+", " "), r"(?i)(?:https?|htt)\S+", " ")
    return without_addresses(out)


def without_addresses(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\S+@\S+", " ")


def share_arabic(text: Column) -> Column:
    """Letters of the Arabic blocks over all characters but spaces; 0 for an empty or null text."""
    letters, solid = F.length(F.regexp_replace(text, r"[^\u0600-\u06FF\u0750-\u077F]", "")), F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(solid > 0, letters / solid), F.lit(0.0))


def country_ids(listed: Column, default: int | None = None) -> Column:
    """Whole numbers of a comma-separated list; bad parts go; ``default`` stands for an empty list."""
    parts = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda p: stripped(p).try_cast("int")), lambda i: i.isNotNull())
    return parts if default is None else F.when(F.size(parts) == 0, F.array(F.lit(default))).otherwise(parts)


def char_chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))


def word_chunks(text: Column, size: int = CHUNK_WORDS, overlap: int = WORD_OVERLAP) -> Column:
    """The text itself up to ``size`` words, else word windows; one starts at each stride, up to the last word."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")))


def topic_ready(text: Column) -> Column:
    t = stripped(F.coalesce(text, F.lit("")))
    return (F.length(t) >= TOPIC_MIN_CHARS) & (F.size(F.split(t, r"(?U)\s+")) >= TOPIC_MIN_WORDS)


def predicted_label(response: Column, one_word: bool) -> Column:
    """The label after ``true_prediction:`` in a model's answer, or null."""
    got = F.regexp_extract(response, r"(?i)true_prediction:\s*" + (r"(\w+)" if one_word else r"(.*)"), 1)
    return F.when(got != "", stripped(got))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(0.0)


def _beyond(x: Column, times: float, whole: Column) -> Column:
    """``x * times - whole`` with the right sign, 0 only if it is exactly 0: ``x`` is split into halves of 26 bits,
    whose products with a small factor are exact."""
    far = x * F.lit(134217729.0)
    high = far - (far - x)
    return (high * F.lit(times) - whole) + (x - high) * F.lit(times)


def fixed(x: Column, digits: int) -> Column:
    """A figure below 1,000,000 in size with so many decimals (one at least), rounded by its exact binary value, ties to even."""
    unit = float(10**digits)
    v = F.abs(x.cast("double"))
    guess = F.floor(v * F.lit(unit)).cast("double")
    low = F.when(_beyond(v, unit, guess) < 0, guess - 1).otherwise(guess)
    side = _beyond(v, 2 * unit, 2 * low + 1)
    units = (low + F.when((side > 0) | ((side == 0) & (low % 2 == 1)), 1.0).otherwise(0.0)).cast("long")
    text = F.format_string(f"%d.%0{digits}d", F.floor(units / F.lit(unit)).cast("long"), units % F.lit(10**digits))
    return F.concat(F.when(x < 0, "-").otherwise(""), text)
