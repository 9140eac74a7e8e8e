"""DataFrame operators over signal relations."""

from .downsample import downsample, lttb_picks, minmax_preselect, point_budget
from .filters import after_cursor, at_or_after, before, in_range, range_condition
from .index import top_k_per_group, with_row_index
from .joins import bounded_broadcast, with_channel_names
from .quantiles import group_quantiles
from .reads import (assign_pages, next_cursor, overview, rollup, rollup_from_rollup, signal_page,
                    signal_range)
from .stats import attach_outliers, boxplot, histogram, outliers

__all__ = [
    "downsample", "lttb_picks", "minmax_preselect", "point_budget", "after_cursor", "at_or_after",
    "before", "in_range", "range_condition", "top_k_per_group", "with_row_index", "bounded_broadcast",
    "with_channel_names", "group_quantiles", "assign_pages", "next_cursor", "overview", "rollup",
    "rollup_from_rollup", "signal_page", "signal_range", "attach_outliers", "boxplot", "histogram",
    "outliers",
]
