"""Extension: gap-merged sessions of an event stream, the streaming counterpart of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, start, end, events)``: events of a key less than ``gap`` apart; works on batches and streams.

    On a stream the watermark closes a session once no event may join it; state is
    one open session a key and the gap.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
