"""New records as a stream: repeats dropped within a watermark, then validated and matched batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching


def without_repeats(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Each key once within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def match_stream(stream: DataFrame, records: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, search: matching.Search = matching.Search(), **columns: str) -> StreamingQuery:
    """Every batch of probes is matched against the records; ``sink`` gets the matches and the batch's number."""

    def batch(probes: DataFrame, number: int) -> None:
        sink(matching.find_matches(probes, records, search, **columns), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
