"""Zone-free time expressions on epoch-millisecond ``bigint`` columns.

All bucketing is integer arithmetic on milliseconds; nothing here depends on the session
time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DAY_MS

_EPOCH_DATE = _dt.date(1970, 1, 1)


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ms_from_ntz(col) -> Column:
    """Epoch ms of a ``timestamp_ntz`` (truncating sub-millisecond digits)."""
    return F.timestamp_diff("MILLISECOND", _epoch_ntz(), _c(col))


def ntz_from_ms(col) -> Column:
    """``timestamp_ntz`` (UTC wall clock) of epoch ms, independent of the session zone."""
    return F.timestamp_add("MILLISECOND", _c(col), _epoch_ntz())


def event_time(col) -> Column:
    """``timestamp`` of epoch ms; the type ``withWatermark`` requires."""
    return F.timestamp_millis(_c(col))


def bucket_start(col, width_ms: int) -> Column:
    """Floor of ``ts`` to a multiple of ``width_ms`` (F1); floor also for negative ts."""
    ts = _c(col)
    return ts - F.pmod(ts, F.lit(int(width_ms)).cast("bigint"))


def day_index(col) -> Column:
    """Whole UTC days since 1970-01-01 of epoch ms (integer floor)."""
    ts = _c(col)
    return ((ts - F.pmod(ts, F.lit(DAY_MS).cast("bigint"))) / F.lit(DAY_MS)).cast("int")


def day_of(col) -> Column:
    """UTC ``date`` of epoch ms (F2 + F3); the ``dt`` partition value."""
    return F.date_add(F.lit(_EPOCH_DATE), day_index(col))


def day_floor_ms(ts_ms: int) -> int:
    """Driver-side: epoch ms of the UTC midnight at or before ``ts_ms``."""
    return ts_ms - (ts_ms % DAY_MS)


def date_of_ms(ts_ms: int) -> _dt.date:
    """Driver-side UTC date of epoch ms (for partition predicates)."""
    return _EPOCH_DATE + _dt.timedelta(days=ts_ms // DAY_MS)
