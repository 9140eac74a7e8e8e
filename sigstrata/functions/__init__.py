"""Scalar column expressions and argument checks."""

from .args import int_arg, layer_arg, nullable_int, nullable_num, num, time_range
from .labels import box_label, channel_label, detail_rows, time_text
from .time import (bucket_start, date_of_ms, day_floor_ms, day_index, day_of, event_time, ms_from_ntz,
                   ntz_from_ms)

__all__ = [
    "bucket_start", "date_of_ms", "day_floor_ms", "day_index", "day_of", "event_time", "ms_from_ntz",
    "ntz_from_ms", "box_label", "channel_label", "detail_rows", "time_text", "int_arg", "layer_arg",
    "nullable_int", "nullable_num", "num", "time_range",
]
