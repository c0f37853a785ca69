"""The chat log as a stream: windowed counts, sessions, de-duplication and answered questions, with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def marked(events: DataFrame, late: str | None) -> DataFrame:
    """Events with a watermark; None leaves one that is set already."""
    return events.withWatermark("ts", late) if late else events


def hourly(events: DataFrame, late: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of each window; rows later than `late` are left out when streaming."""
    counted = marked(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of each user's sessions."""
    counted = marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str | None = "10 minutes") -> DataFrame:
    """Each event once, as far as repeats come within the watermark."""
    return marked(events, late).dropDuplicatesWithinWatermark([key])


class Pairing(StatefulProcessor):
    """Keeps a conversation's last turn: a user's turn and the next one are a pair, and a question left alone has no answer."""

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "turn long, at long, role string, text string")

    def pair(self, key, last: tuple, answer: str | None) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "turn": [last[0]], "question": [last[3]], "answer": pd.Series([answer], dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        new = pd.concat(list(rows)).sort_values("turn")
        for turn, at, role, text in zip(new["turn"].tolist(), (new["ts"].astype("int64") // 10 ** {"ns": 6, "us": 3, "ms": 0}[new["ts"].dt.unit]).tolist(), new["role"], new["text"]):
            if last and turn <= last[0]:  # a repeat, or too late for its place
                continue
            if last and last[2] == "user":
                yield self.pair(key, last, text)
            last = (turn, at, role, text)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(last)
        self.handle.registerTimer(last[1] + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        if last[2] == "user":
            yield self.pair(key, last, None)

    def close(self) -> None:
        pass


def answered(turns: DataFrame, late: str | None = "10 minutes", wait: int = 3_600_000) -> DataFrame:
    """(conv_id, turn, question, answer) of a stream of turns (conv_id, turn, ts, role, text), as soon as a user's turn is followed by another.

    A question that `wait` milliseconds of the watermark have passed since has a null answer, and its conversation is forgotten.
    Turns of a conversation come in order, but for those of one batch; repeats and turns from before the last one are left out. The
    state is one turn a conversation, in the store that the session names (it must be the RocksDB one), and survives restarts.
    """
    kept = marked(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "ts", "role", "text"), late)
    kind = dict(turns.dtypes)["conv_id"]
    return kept.groupBy("conv_id").transformWithStateInPandas(Pairing(wait), f"conv_id {kind}, turn long, question string, answer string", "Append", "EventTime")


def append_log(answers: DataFrame, path: str, checkpoint: str):
    """Append a stream of answers to a table; exactly once, by the checkpoint."""
    return answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
