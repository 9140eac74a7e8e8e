"""Viewport rules and composite plans."""

from .panels import BoxPanel, boxplot_panel, signal_series
from .viewport import (drill, drill_boxes, pick_bucket_ms, pick_layer, quick_range, slide_to, zoom,
                       zoom_columns)

__all__ = ["BoxPanel", "boxplot_panel", "signal_series", "drill", "drill_boxes", "pick_bucket_ms", "pick_layer",
           "quick_range", "slide_to", "zoom", "zoom_columns"]
