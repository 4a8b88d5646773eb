"""Token streams: server-sent events that arrive in parts, cut anywhere.

Parts of a stream are rows (stream, at, part) with ``at`` counting from 0. What is left of a
line when a batch ends is kept in Spark's state with the stream, as are parts that came before
their turn; lines are read when their end has come. A run that is broken off, or that ends, goes
on from the state in its checkpoint. A line that never ends says nothing, and nothing is read
after the end mark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEAD, END = "data: ", "[DONE]"
PROVIDER, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def content_of(line: str) -> str | None:
    """What a line says; None for comments, blank lines, what isn't JSON and what has no content."""
    bare = line.strip()
    if not bare.startswith(LEAD):
        return None
    try:
        return json.loads(bare[len(LEAD) :])["choices"][0]["delta"]["content"] or None
    except (ValueError, LookupError, TypeError):
        return None


def is_end(line: str) -> bool:
    return line.strip() == LEAD + END


class TokenLines(StatefulProcessor):
    """Contents of whole lines, numbered within their stream."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "open string, next long, said long, over boolean, early long")
        self.early = handle.getMapState("early", "at long", "part string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, next_, said, over, waiting = self.place.get() if self.place.exists() else ("", 0, 0, False, 0)
        if over:
            return
        came = {}
        for frame in rows:
            came.update(zip(frame["at"].tolist(), frame["part"].tolist()))
        if waiting:  # each look into the map is a call of Spark's, so there is none unless parts wait
            held = {at: part for (at,), (part,) in self.early.iterator()}
            came = held | came
        else:
            held = {}
        parts = []
        while next_ in came:
            parts.append(came.pop(next_) or "")
            next_ += 1
        gone = [at for at in held if at < next_]
        if gone and len(gone) == len(held):
            self.early.clear()
        else:
            for at in gone:
                self.early.removeKey((at,))
        waits = {at: part or "" for at, part in came.items() if at > next_}
        for at, part in waits.items():
            if held.get(at) != part:
                self.early.updateValue((at,), (part,))
        if not parts:
            self.place.update((open_, next_, said, over, len(waits)))
            return
        *lines, open_ = (open_ + "".join(parts)).split("\n")
        found = []
        for line in lines:
            if is_end(line):
                over, open_ = True, ""
                if waits:
                    self.early.clear()
                    waits = {}
                break
            content = content_of(line)
            if content is not None:
                found.append(content)
        self.place.update((open_, next_, said + len(found), over, len(waits)))
        if found:
            yield pd.DataFrame({key_name: [value] * len(found) for key_name, value in zip(self.keys, key)} | {"at": range(said, said + len(found)), "content": found})

    def close(self) -> None:
        pass


def lines_schema(parts: DataFrame, stream: str) -> T.StructType:
    return T.StructType([parts.schema[stream], T.StructField("at", T.LongType()), T.StructField("content", T.StringType())])


def token_lines(parts: DataFrame, stream: str) -> DataFrame:
    """A streaming table (stream, at, content) of what the lines of each stream say, in order of ``at``."""
    schema = lines_schema(parts, stream)
    grouped = parts.select(stream, "at", "part").groupBy(stream)
    return grouped.transformWithStateInPandas(TokenLines([stream]), outputStructType=schema, outputMode="Append", timeMode="None")


@contextmanager
def keyed_state(spark: SparkSession):
    """The store that keeps several values for a key, set while a stream is started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
