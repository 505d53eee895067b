"""Streaming forms: weekly counts, de-duplication, a stateful rate limiter, wave flushing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Monday 5 January 1970: windows of seven days start on Mondays from there.
WEEK_OFFSET = "4 days"


def weekly_counts(events: DataFrame, key: str, at: str = "ts", late: str = "7 days") -> DataFrame:
    """Counts by key and ISO week; works on streams and on tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, "7 days", startTime=WEEK_OFFSET), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.to_date("window.start").alias("week_start"), "n")


def first_seen(entries: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once within the watermark."""
    return entries.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def rate_limited(calls: DataFrame, window: float, most: int) -> DataFrame:
    """calls (key, at in seconds) with `allowed`; the state of a key is the times of its last allowed calls, `most` at the utmost."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values("at", kind="stable")
            allowed = []
            for t in pdf["at"]:
                log = [s for s in log if t - s < window]
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(t)
            yield pdf.assign(allowed=allowed)[["key", "at", "allowed"]]
        state.update((log,))

    return calls.groupBy("key").applyInPandasWithState(run, "key string, at double, allowed boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def in_waves(stream: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, rows: int = 512) -> StreamingQuery:
    """Hands micro-batches to flush, of which each is written as one; the checkpoint makes the run resumable. rows bounds no batch that
    the source can't cut; file sources are cut by maxFilesPerTrigger."""
    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
