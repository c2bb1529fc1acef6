"""Limits, metrics, formats and dates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crawl sizes by name, the default, the most that is served without a talk, and what larger services offer.
TIERS = [("lite", 1), ("quick", 10), ("site", 100), ("deep", 1000)]
DEFAULT_PAGES, MOST_PAGES, PARITY_PAGES = 10, 1000, 50_000


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def number(x: Column) -> Column:
    """A number out of text; null for what isn't a finite one. An empty text is 0."""
    s = F.trim(x.cast("string"))
    n = F.when(s == "", F.lit(0.0)).otherwise(s.try_cast("double"))
    return F.when(~F.isnan(n) & ~n.isin(float("inf"), float("-inf")), n)


def clamp(x: Column, low: int, high: int, lacking: int) -> Column:
    """x as a whole number from low to high; `lacking` if it isn't a number."""
    n = number(x)
    return F.when(n.isNull(), F.lit(lacking)).otherwise(F.least(F.greatest(half_up(n), F.lit(low)), F.lit(high))).cast("long")


def page_limit(x: Column, default: int = DEFAULT_PAGES, most: int = MOST_PAGES) -> Column:
    return clamp(x, 1, most, default)


def clamp_low(x: Column, low: int, high: int) -> Column:
    """Batches and targets: what isn't a number counts as the least."""
    return clamp(x, low, high, low)


def clamp_high(x: Column, most: int) -> Column:
    """Inventory limits: what isn't a number counts as the most."""
    return clamp(x, 1, most, most)


def tier(x: Column) -> Column:
    pages = page_limit(x)
    out = F.lit("custom")
    for name, size in TIERS:
        out = F.when(pages == size, name).otherwise(out)
    return out


def parity_gap(x: Column) -> Column:
    return F.greatest(PARITY_PAGES - page_limit(x), F.lit(0)).cast("long")


def mean1(total: Column, count: Column) -> Column:
    """An average to one decimal; 0 of nothing."""
    return F.when(count == 0, F.lit(0.0)).otherwise(half_up(total / count * 10) / 10)


def percent(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(half_up(F.coalesce(part, F.lit(0)) / whole * 100))


def _fixed(x: Column, digits: int) -> Column:
    """x, not negative, with no decimal or one, rounded by its exact binary value, exact halves upwards.

    4.85 is a little less than its decimal and becomes 4.8. Where x is the double next to a half, its exact distance is
    the error of 20 * x against the half's whole number, from an exact sum of 16 * x and 4 * x."""
    x = x.cast("double")
    if not digits:
        return half_up(x).cast("string")
    k = F.floor(x * 10)
    half = (k + 0.5) / 10
    u, v = x * 16, x * 4
    s = u + v
    error = (u - (s - (s - u))) + (v - (s - u))
    up = F.when(x == half, (s - (2 * k + 1)) + error >= 0).otherwise(x > half)
    n = k + up.cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def byte_size(x: Column) -> Column:
    """Bytes as B, KB or MB."""
    n = F.coalesce(x, F.lit(0))
    return (
        F.when(n <= 0, "0 B")
        .when(n < 1024, F.concat(half_up(n).cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(half_up(n / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(_fixed(n / (1024 * 1024), 1), F.lit(" MB")))
    )


def metric(x: Column) -> Column:
    """Milliseconds as ms, from a second on as seconds; empty if not positive."""
    return F.when(F.coalesce(x, F.lit(0.0)) <= 0, "").when(x >= 1000, F.concat(_fixed(x / 1000, 1), F.lit("s"))).otherwise(F.concat(half_up(x).cast("string"), F.lit("ms")))


def _short(x: Column) -> Column:
    """A number with one decimal, without it where that is 0."""
    return F.regexp_replace(_fixed(x, 1), r"\.0$", "")


def _positive(x: Column) -> Column:
    return F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def share(x: Column) -> Column:
    """A share in percent, one decimal where it is needed."""
    return F.concat(_short(half_up(_positive(x) * 1000) / 10), F.lit("%"))


def place(x: Column) -> Column:
    """An average position, one decimal where it is needed; n/a if not positive."""
    return F.when(_positive(x) == 0, "n/a").otherwise(_short(half_up(_positive(x) * 10) / 10))


def grouped(x: Column) -> Column:
    """A count with thousands marks."""
    return F.format_number(half_up(_positive(x)), 0)


def brief_share(x: Column) -> Column:
    """A share in growth briefs: whole percents, one decimal below 1 %."""
    n = F.coalesce(x.cast("double"), F.lit(0.0))
    return F.concat(F.when((n > 0) & (n < 0.01), _fixed(n * 100, 1)).otherwise(_fixed(n * 100, 0)), F.lit("%"))


def brief_place(x: Column) -> Column:
    """A position in growth briefs: one decimal up to ten."""
    n = _positive(x)
    return F.when(n == 0, "unknown").when(n < 10, _fixed(n, 1)).otherwise(_fixed(n, 0))


def speed_class(score: Column) -> Column:
    return F.when(score.isNull(), "").when(score >= 90, "fast").when(score >= 75, "good").when(score >= 50, "needs-improvement").otherwise("poor")


def badge_tone(score: Column) -> Column:
    return F.when(score.isNull(), "pending").when(score >= 90, "good").when(score >= 70, "ok").otherwise("needs work")


def check_interval(days: Column) -> Column:
    """Days between two scheduled audits: 7, 14 or 30."""
    n = number(days)
    return F.when(n <= 7, 7).when(n <= 14, 14).when(n.isNull(), 7).otherwise(30).cast("int")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def down_for(seconds: Column) -> Column:
    """How long an outage has lasted, in words: at least a minute, hours up to two days."""
    minutes = F.greatest(F.lit(1), half_up(seconds / 60.0))
    hours = half_up(minutes / 60.0)
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return F.when(minutes < 60, some(minutes, "minute")).when(hours < 48, some(hours, "hour")).otherwise(F.concat(half_up(hours / 24.0).cast("string"), F.lit(" days")))


def spark_x(nth: Column, points: Column, width: int = 560) -> Column:
    """Place of the nth (from 0) of a trend's points on a line of that width, one decimal."""
    return _fixed(nth * (F.lit(float(width)) / (points - 1)), 1)


def spark_y(score: Column, height: int = 120) -> Column:
    """Height of a score from 0 to 100 in a trend, with a margin of 8, one decimal."""
    return _fixed(height - 8 - F.greatest(F.lit(0), F.least(F.lit(100), score)) / 100.0 * (height - 16), 1)
