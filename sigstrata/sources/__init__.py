"""Sources, sinks and table maintenance."""

from .adapters import (channel_dictionary, ensure_channels, event_signals, lineitem_signals, read_table,
                       signals_from_events, signals_from_lineitem, to_signals)
from .delivery import iter_frames
from .ingest import encode_rows, parse_rows
from .store import ArchiveResult, SignalStore

__all__ = [
    "channel_dictionary", "ensure_channels", "event_signals", "lineitem_signals", "read_table",
    "signals_from_events", "signals_from_lineitem", "to_signals", "iter_frames", "encode_rows", "parse_rows",
    "ArchiveResult", "SignalStore",
]
