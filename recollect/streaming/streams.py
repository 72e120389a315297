"""Structured Streaming forms of the batch operators: quiet sessions, dedup, exchanges, incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.schemas import STABILITY_SECONDS
from recollect.sources.store import Store


def quiet_sessions(events: DataFrame, time: str = "ts", key: str = "user_id", seconds: int = STABILITY_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions closed by a quiet period: key, started, ended, n. On a stream, only closed ones come out in append mode."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", by: str = "event_type", lateness: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("started"), by, "n", F.round("total", 4).alias("total"))


def dedup(events: DataFrame, keys: list[str], time: str = "ts", within: str = "1 hour", blocklist: DataFrame | None = None) -> DataFrame:
    """First sight of each key, within the watermark on a stream; keys of a static blocklist never pass."""
    if blocklist is not None:
        events = events.join(blocklist, keys, "left_anti")
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def exchanges(turns: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """Exchanges of live sessions: conv_id, exchange_index, user, assistant.

    turns: conv_id, turn, role, text. The open exchange of a session is its state; it comes out
    when the user speaks again or the session has been idle; without an idle time (for runs over
    what is available) only the former.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, user, answers = state.get if state.exists else (-1, None, "")
        out = []
        if state.hasTimedOut:
            if user is not None:
                out.append((key[0], index, user, answers))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("turn")
            for role, text in zip(rows["role"], rows["text"], strict=True):
                text = (text or "").strip()
                if role == "user" and len(text) >= 3:
                    if user is not None:
                        out.append((key[0], index, user, answers))
                    index, user, answers = index + 1, text, ""
                elif role == "assistant" and user is not None and text:
                    answers = f"{answers} {text}".strip()
            state.update((index, user, answers))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "exchange_index", "user", "assistant"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, exchange_index int, user string, assistant string", "exchange_index int, user string, assistant string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def refresh_into(stream: DataFrame, store: Store, table: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Merge whatever has arrived into a store's table by its key, and stop.

    The store keeps the number of the stream's last batch (under `name`, the checkpoint's path by
    default) in the version that the batch made. If a run ends between that version and the
    checkpoint, the batch comes again and is passed by. A file stream sees new files only; files
    changed in place need the batch comparison.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(table, batch, stream=(name or checkpoint, number))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
