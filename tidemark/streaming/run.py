"""Starting streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def run_stream(
    stream: DataFrame | DataStreamWriter, checkpoint: str,
    sink: Callable[[DataFrame, int], None] | None = None,
    trigger: str | None = "5 seconds", name: str | None = None, mode: str = "append",
) -> StreamingQuery:
    """Start a stream with its own checkpoint folder.

    ``sink`` is a ``foreachBatch`` writer for a plain DataFrame; a writer such as
    ``write_topic`` returns is started as it is.  ``trigger`` is the interval
    between micro-batches; None takes what there is and stops.  A restarted
    query resumes from ``checkpoint``; restarting is left to the cluster.
    """
    writer = stream.writeStream if isinstance(stream, DataFrame) else stream
    if sink is not None:
        writer = writer.foreachBatch(sink)
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if trigger is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=trigger)
    return writer.start()
