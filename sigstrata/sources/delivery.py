"""Result delivery in bounded frames.

Every partition is packed into Arrow batches on the executors; the driver fetches them partition
by partition (never the whole result at once) and re-cuts them into tables of at most
``frame_rows`` rows, the frame size the reference transports (65,536 rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed value: rows per transport frame.
FRAME_ROWS = 65_536


def iter_frames(df: DataFrame, frame_rows: int = FRAME_ROWS) -> Iterator[pa.Table]:
    """Yield the rows of ``df`` in order as Arrow tables of at most ``frame_rows`` rows.

    All frames have the schema of ``df``; an empty result is one empty frame.
    """
    schema = to_arrow_schema(df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["frame"])

    held, sent = schema.empty_table(), False
    for row in df.mapInArrow(pack, "frame binary").toLocalIterator(prefetchPartitions=True):
        held = pa.concat_tables([held, pa.ipc.open_stream(row["frame"]).read_all().cast(schema)])
        while held.num_rows >= frame_rows:
            yield held.slice(0, frame_rows)
            held, sent = held.slice(frame_rows), True
    if held.num_rows or not sent:
        yield held
