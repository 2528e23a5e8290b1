"""Extensions on streams: scoring pairs as they arrive, and metrics of a log stream by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions import records as R


def score_stream(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes left, right, match, match_confidence of a stream of pairs; score adds prob. Each batch is written under its number, so a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        match = R.decide(F.col("prob"), threshold)
        out = score(batch).select("left", "right", match.alias("match"), R.confidence(F.col("prob"), match).alias("match_confidence"))
        out.write.mode("overwrite").json(f"{sink}/batch={number}")

    return pairs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window start, key, n, mean of a stream or table; on a stream, rows later than `late` are left out and state is bounded."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
