"""Fixed schemas and constants of the signal store.

Time is epoch milliseconds in a ``bigint``; ``dt`` is the derived UTC day used as the
Hive partition key of every stored layer.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Layer bucket widths and day length in milliseconds.
SECOND_MS = 1_000
MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

LAYERS = ("L0", "L1", "L2")
LAYER_BUCKET_MS = {"L1": MINUTE_MS, "L2": HOUR_MS}

CHANNEL_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

SIGNAL_SCHEMA = T.StructType([
    T.StructField("ts", T.LongType(), False),
    T.StructField("channel_id", T.IntegerType(), False),
    T.StructField("value", T.DoubleType(), False),
])

ROLLUP_SCHEMA = T.StructType([
    T.StructField("ts", T.LongType(), False),
    T.StructField("channel_id", T.IntegerType(), False),
    T.StructField("avg_v", T.DoubleType(), True),
    T.StructField("min_v", T.DoubleType(), True),
    T.StructField("max_v", T.DoubleType(), True),
    T.StructField("n", T.LongType(), True),
])

DT_FIELD = T.StructField("dt", T.DateType(), True)

# On-disk schemas include the partition column so reads never infer anything.
SIGNAL_STORED_SCHEMA = T.StructType(SIGNAL_SCHEMA.fields + [DT_FIELD])
ROLLUP_STORED_SCHEMA = T.StructType(ROLLUP_SCHEMA.fields + [DT_FIELD])

BOX_COLUMNS = ("gk", "low", "q1", "median", "q3", "high", "n")
