"""Structured Streaming over segments: the functions of the batch side, unchanged.

A row is a segment, so nothing has to be kept between rows. Where a segment arrives in parts, parts
are gathered by key until one ends with NUL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.streamops import Segment, apply


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def process(stream: DataFrame, step: Segment, column: str = "stream") -> DataFrame:
    return apply(stream, step, column)


def write(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append to files once for each micro-batch, until all input there is has been read."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def gather(parts: DataFrame, key: str = "doc_id", order: str = "part", text: str = "text") -> DataFrame:
    """(key, segment) of parts that come by key: a segment is whole when a NUL ends it."""

    def work(id_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values(order)
        *whole, rest = (held + "".join(rows[text].fillna(""))).split("\0")
        state.update((rest,))
        if whole:
            yield pd.DataFrame({key: [id_[0]] * len(whole), "segment": whole})

    kind = dict(parts.dtypes)[key]
    return parts.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, segment string", "rest string", "append", GroupStateTimeout.NoTimeout)
