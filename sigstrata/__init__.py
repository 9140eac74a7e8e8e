"""sigstrata: time-series signal analytics on Spark DataFrames.

Narrow ``(ts, channel_id, value)`` signals, a minute/hour rollup pyramid, hot/cold archive
behind one relation, and viewport operators (range reads, keyset pages, box plots, IQR
outliers, histograms, MinMax + LTTB downsampling).
"""

__version__ = "0.1.0"
