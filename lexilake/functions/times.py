"""Column functions over epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
MINUTE_PACE, PER_ITEM = 18, 1.05


def backoff(attempts: Column, base_ms: int = 1000, cap_ms: int = 900_000) -> Column:
    return F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1))).cast("bigint")


def next_midnight(ms: Column) -> Column:
    return (F.floor(ms / DAY_MS) + 1) * DAY_MS


def eta_ms(items: Column, budget_today: Column, daily: Column, resets_at: Column, now: Column) -> Column:
    """Time to drain the rest over day budgets; null where the daily budget is none."""
    per_item = 60_000 / MINUTE_PACE * PER_ITEM
    today = F.floor(F.greatest(F.lit(0), budget_today) / PER_ITEM)
    left = items - today
    full_day = F.greatest(F.lit(1), F.floor(daily / PER_ITEM))
    days = F.floor(left / full_day)
    later = F.ceil(F.greatest(F.lit(0), resets_at - now) + days * DAY_MS + (left - days * full_day) * per_item)
    return F.when(items <= 0, 0).when(daily <= 0, None).when(items <= today, F.ceil(items * per_item)).otherwise(later).cast("bigint")


def duration(ms: Column) -> Column:
    """The two largest units of a duration."""
    d, h, m = F.floor(ms / DAY_MS), F.floor(ms % DAY_MS / 3_600_000), F.floor(ms % 3_600_000 / 60_000)
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit)))
    parts = F.slice(F.filter(F.array(part(d, "d"), part(h, "h"), part(m, "m")), lambda x: x.isNotNull()), 1, 2)
    return F.when(ms.isNull(), "unknown").when(ms <= 0, "done").when(ms < 60_000, "<1m").otherwise(F.array_join(parts, " "))


def compact(n: Column) -> Column:
    """1.2K, 3.4M, 5B, 6.7T: one decimal, and the next unit where rounding reaches it."""
    out = n.cast("string")
    for power, unit in ((3, "K"), (6, "M"), (9, "B"), (12, "T")):
        short = F.round(n.cast("decimal(38,6)") / 10**power, 1)
        out = F.when(n.cast("decimal(38,6)") >= 10**power - (0 if power == 3 else 5 * 10 ** (power - 5)), F.concat(F.regexp_replace(short.cast("string"), r"\.0+$|(\.[1-9])0+$", "$1"), F.lit(unit))).otherwise(out)
    return out


def day_bound(value: Column, end: bool) -> Column:
    """Epoch time of the first or last millisecond of a ``yyyy-mm-dd`` day; null for anything else."""
    day = F.try_to_date(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd")
    return F.unix_millis(day.cast("timestamp")) + (DAY_MS - 1 if end else 0)
