"""Days that begin at four in the morning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_STARTS_AT = 4


def day_key(ts: Column, starts_at: int = DAY_STARTS_AT) -> Column:
    return F.to_date(ts - F.expr(f"INTERVAL {starts_at} HOURS"))
