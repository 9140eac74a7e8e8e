"""External row payloads (S6): ``{"rows": [[ts, channel_id, value], ...]}`` messages.

Works on batch and streaming DataFrames alike: the message column is parsed with
``from_json``, rows are exploded, fields are cast with ``try_cast``; anything missing,
non-numeric, non-finite or of the wrong arity goes to the reject output with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "struct<rows: array<array<string>>>"


def encode_rows(sig: DataFrame, col: str = "message") -> DataFrame:
    """One message per signal row, in the wire form (used to replay tables as payloads)."""
    triple = F.array(F.col("ts").cast("string"), F.col("channel_id").cast("string"), F.col("value").cast("string"))
    return sig.select(F.to_json(F.struct(F.array(triple).alias("rows"))).alias(col))


def parse_rows(raw: DataFrame, col: str = "message") -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``: typed ``ts, channel_id, value`` rows and ``raw_row, reason``."""
    msgs = raw.select(F.from_json(F.col(col), MESSAGE_SCHEMA).alias("m"), F.col(col).alias("_raw"))
    # a message with no rows is fine and gives none
    rows = (msgs.select(F.explode_outer("m.rows").alias("r"), "_raw",
                        F.coalesce(F.size("m.rows") == 0, F.lit(False)).alias("_empty"))
            .filter(~F.col("_empty")))
    ts = F.expr("try_cast(get(r, 0) AS BIGINT)")
    ch = F.expr("try_cast(get(r, 1) AS INT)")
    val = F.expr("try_cast(get(r, 2) AS DOUBLE)")
    typed = rows.select("r", "_raw", ts.alias("ts"), ch.alias("channel_id"), val.alias("value"))
    reason = (F.when(F.col("r").isNull(), F.lit("unparsable message"))
              .when(F.size("r") != 3, F.lit("expected 3 fields"))
              .when(F.col("ts").isNull(), F.lit("bad ts"))
              .when(F.col("channel_id").isNull(), F.lit("bad channel_id"))
              .when(F.col("value").isNull() | F.isnan("value")
                    | F.col("value").isin(float("inf"), float("-inf")), F.lit("bad value")))
    checked = typed.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).select("ts", "channel_id", "value")
    rejected = checked.filter(F.col("reason").isNotNull()).select(
        F.coalesce(F.to_json("r"), F.col("_raw")).alias("raw_row"), "reason")
    return good, rejected
