"""Posted texts as times (survey D1-D7). Every function takes the moment it speaks of; nothing reads the clock.

The session's time zone is UTC; a listing's clock is Berlin's, its business date Moscow's. Wall-clock times that
a change of summer time skips or repeats are read as Spark reads them, the earlier offset first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BERLIN, MOSCOW = "Europe/Berlin", "Europe/Moscow"
# How dates and times are written.
_ISO = r"\b(\d{4})-(\d{2})-(\d{2})(?:[T\s](\d{2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:?\d{2})?)?"
_DATE = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s*(\d{1,2}):(\d{2}))?\b"
_CLOCK = r"\b(\d{1,2}):(\d{2})\b"


def micros(at: Column | str) -> Column:
    """Microseconds of a moment; one without a zone is read in the session's."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _berlin(y: Column, m: Column, d: Column, hh: Column, mm: Column) -> Column:
    """UTC of a wall-clock time; null where there is no such time."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = F.concat(pad(y, 4), F.lit("-"), pad(m, 2), F.lit("-"), pad(d, 2), F.lit(" "), pad(hh, 2), F.lit(":"), pad(mm, 2), F.lit(":00"))
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), BERLIN)


def _relative_day(text: Column, moment: Column) -> Column:
    """The Berlin date of a text with heute or gestern."""
    today = F.to_date(F.from_utc_timestamp(moment, BERLIN))
    return F.when(F.lower(text).contains("gestern"), F.date_sub(today, 1)).when(F.lower(text).contains("heute"), today)


def with_posted(df: DataFrame, text: str, moment: str) -> DataFrame:
    """Df with posted_at (UTC, of texts with a clock), age_minutes at the moment, and day_moscow.

    An explicit date counts as it stands; heute and gestern go by Berlin's day, and with a clock by the Moscow day of that time.
    Steps are columns of their own, so that nothing is parsed twice.
    """
    parts = df.withColumn("_raw", F.trim(F.regexp_replace(text, r"\s+", " ")))
    parts = parts.withColumns({f"_i{i}": _part(F.col("_raw"), _ISO, i) for i in (0, 1, 2, 3, 4, 7)} | {f"_d{i}": _part(F.col("_raw"), _DATE, i) for i in range(1, 6)})
    parts = parts.withColumn("_day", _relative_day(F.col("_raw"), F.col(moment)))
    iso = F.regexp_replace(F.replace(F.col("_i0"), F.lit("T"), F.lit(" ")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso_at = F.when(F.col("_i4").isNull(), None).when(F.col("_i7").isNotNull(), F.try_to_timestamp(iso)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(iso), BERLIN))
    date_at = F.when(F.col("_d4").isNotNull(), _berlin(*[F.col(f"_d{i}") for i in (3, 2, 1, 4, 5)]))
    clock = [_part(F.col("_raw"), _CLOCK, i) for i in (1, 2)]
    relative_at = _berlin(F.year("_day"), F.month("_day"), F.dayofmonth("_day"), *clock)
    parts = parts.withColumn("posted_at", F.coalesce(iso_at, F.when(F.col("_d3").isNotNull(), date_at).otherwise(relative_at)))
    iso_day = F.try_to_date(F.concat_ws("-", "_i1", "_i2", "_i3"), "yyyy-MM-dd")
    date_day = F.try_to_date(F.concat_ws("-", "_d3", F.lpad("_d2", 2, "0"), F.lpad("_d1", 2, "0")), "yyyy-MM-dd")
    by_clock = F.to_date(F.from_utc_timestamp("posted_at", MOSCOW))
    day = F.when(F.col("_i4").isNotNull() & F.col("posted_at").isNotNull(), by_clock).when(F.col("_i1").isNotNull(), iso_day).when(F.col("_d3").isNotNull(), date_day).when(F.col("_day").isNotNull(), F.coalesce(by_clock, F.col("_day")))
    age = F.greatest((micros(moment) - micros("posted_at")) / 6e7, F.lit(0.0))
    return parts.withColumns({"age_minutes": age, "day_moscow": day}).drop("_raw", "_day", *[f"_i{i}" for i in (0, 1, 2, 3, 4, 7)], *[f"_d{i}" for i in range(1, 6)])


def sort_moment(text: Column, first_seen_at: Column, as_of: Column) -> Column:
    """`Heute HH:MM` on the day of as_of, else when the row was first seen, else as_of (UTC)."""
    pattern = r"(?i)Heute\s*,?\s*(\d{1,2}):(\d{2})"
    today = F.to_date(F.from_utc_timestamp(as_of, BERLIN))
    at = _berlin(F.year(today), F.month(today), F.dayofmonth(today), _part(text, pattern, 1), _part(text, pattern, 2))
    return F.coalesce(at, first_seen_at, as_of)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, at least 0."""
    return F.greatest(F.floor((micros(b) - micros(a)) / 6e7), F.lit(0))


def age_days(day: Column, as_of: Column) -> Column:
    """Days back from as_of's Moscow date, 0 to 4."""
    return F.greatest(F.least(F.datediff(F.to_date(F.from_utc_timestamp(as_of, MOSCOW)), day), F.lit(4)), F.lit(0))


def cutoff(period: str, as_of: Column) -> Column | None:
    """the moment that 1h, 3h or 6h go back to; no limit for others."""
    hours = {"1h": 1, "3h": 3, "6h": 6}.get(period)
    return as_of - F.expr(f"INTERVAL {hours} HOURS") if hours else None
