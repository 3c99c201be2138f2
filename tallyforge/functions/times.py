"""Time rules: peak hours at a fixed offset and the local day start."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak pricing runs Monday to Friday, 09-12 and 14-18 o'clock, at UTC+8.
PEAK_OFFSET_HOURS = 8
PEAK_HOURS = [(9, 12), (14, 18)]
PEAK_WEEKDAYS = 5


def peak_tier(ts_ms: Column) -> Column:
    """``peak`` or ``offpeak``. Integer arithmetic, so the session time zone plays no part."""
    hours = F.floor((ts_ms + F.lit(PEAK_OFFSET_HOURS * 3_600_000)) / F.lit(3_600_000.0)).cast("bigint")
    hour = F.pmod(hours, F.lit(24))
    # Day 0 of the epoch was a Thursday: 3 when Monday is 0.
    weekday = F.pmod(F.floor(hours / F.lit(24.0)).cast("bigint") + 3, F.lit(7))
    in_hours = F.lit(False)
    for first, last in PEAK_HOURS:
        in_hours = in_hours | ((hour >= first) & (hour < last))
    return F.when((weekday < PEAK_WEEKDAYS) & in_hours, F.lit("peak")).otherwise(F.lit("offpeak"))


def local_day_start_ms(now_ms: int, tz: str = "UTC") -> int:
    """Epoch ms of local midnight; ``now_ms`` itself when midnight is skipped or doubled that day."""
    zone = ZoneInfo(tz)
    now = datetime.fromtimestamp(now_ms // 1000, timezone.utc).astimezone(zone)
    midnight = datetime(now.year, now.month, now.day, tzinfo=zone)
    if midnight.utcoffset() != midnight.replace(fold=1).utcoffset():
        return now_ms
    return int((midnight - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))
