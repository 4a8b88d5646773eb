"""Progress of batch and stream queries, told to callbacks while Spark does the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``df``, and a function that gives its measures (aggregates) once an action has run; nothing is computed twice."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in measures.items()]), lambda: seen.get


def on_progress(spark: SparkSession, tell: Callable[[str, int, int], None]) -> StreamingQueryListener:
    """Call ``tell`` (query, batch, rows) after each batch of a stream; the listener can be taken off again."""

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            tell(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
