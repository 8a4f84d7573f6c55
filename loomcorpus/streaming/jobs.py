"""Streams of turns, events and documents. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, seq long, score int, stage string, important string, mood string, revision long"
#: State of the kind that the stateful operators here need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Engagement(StatefulProcessor):
    """A key's turns by their seq, so that one which comes late changes those after it; a revision,
    which counts the triggers that changed the key; and when the key expires."""

    def __init__(self, positive: list[str], low: list[str], comfort: list[str], start: int, bands: Sequence[tuple[int, str]], keep_ms: int):
        self.positive, self.low, self.comfort, self.first, self.bands, self.keep_ms = positive, low, comfort, start, bands, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "seq long", "gain int, important string, mood string")
        self.about = handle.getValueState("about", "revision long, until long")

    def turn(self, text: str, reply: str) -> tuple[int, str | None, str]:
        """What a turn adds to the score, what of it is important, and its mood."""
        glad, sad = (any(w in text for w in words) for words in (self.positive, self.low))
        gain = 1 + 2 * glad + (sad and any(w in reply for w in self.comfort))
        return gain, text[:120] if len(text) > 20 and (glad or sad) else None, "glad" if glad else "low" if sad else "steady"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, latest = {}, 0
        for r in pd.concat(list(rows)).itertuples():
            new[int(r.seq)] = self.turn(r.text or "", r.reply or "")
            latest = max(latest, int(pd.Timestamp(r.at).timestamp() * 1000))
        turns = {k[0]: tuple(v) for k, v in self.turns.iterator()} if self.turns.exists() else {}
        turns |= new
        for seq, turn in new.items():
            self.turns.updateValue((seq,), turn)
        revision, until = self.about.get() if self.about.exists() else (0, 0)
        if latest + self.keep_ms > until:
            if until:
                self.handle.deleteTimer(until)
            until = latest + self.keep_ms
            self.handle.registerTimer(until)
        self.about.update((revision + 1, until))
        score, important, out = self.first, None, []
        for seq in sorted(turns):
            gain, said, mood = turns[seq]
            score, important = min(100, score + gain), said or important
            if seq >= min(new):
                stage = [label for least, label in self.bands if score >= least][-1]
                out.append((key[0], seq, score, stage, important, mood, revision + 1))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.about.clear()
        yield pd.DataFrame(columns=[x.split()[0] for x in _OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_engagement(
    turns: DataFrame, *, positive: Iterable[str], low: Iterable[str], comfort: Iterable[str], start: int = 20, bands=((0, "new"), (25, "known"), (50, "close")),
    delay: str = "30 days", keep: timedelta = timedelta(days=365),
) -> DataFrame:
    """Rows (key, seq, text, reply, at) in; out, the key's score, stage, last important turn and mood
    after each turn that a trigger brings, and again after those that follow it, with a higher
    revision. ``settled`` keeps the last revision of each. A key is forgotten when the watermark is
    ``keep`` beyond its last turn, and begins anew if it comes back. The session needs STORE; the
    output mode is update."""
    work = Engagement(list(positive), list(low), list(comfort), start, tuple(bands), int(keep.total_seconds() * 1000))
    return turns.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(work, _OUT, "Update", "EventTime")


def settled(rows: DataFrame) -> DataFrame:
    """The last revision of each (key, seq)."""
    rest = [c for c in rows.columns if c not in ("key", "seq", "revision")]
    return rows.groupBy("key", "seq").agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select("key", "seq", "_r.*")


def stream_dedup(docs: DataFrame, text: Column, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first document of each content. With an event time, state is dropped after a delay."""
    keyed = docs.withColumn("digest", F.sha2(text.cast("binary"), 256))
    if event_time is None:
        return keyed.dropDuplicates(["digest"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def daily(events: DataFrame, time: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Events and their sum per key and day (UTC); a day is closed when the delay has passed."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    late = events.withWatermark(time, delay) if events.isStreaming else events
    g = late.groupBy(F.window(time, "1 day").alias("_w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.to_date(F.col("_w.start")).alias("day"), key, "n", "total")


def stream_every_nth(rows: DataFrame, n: int) -> DataFrame:
    """Every n-th row (key, seq) of each key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        pdf = pd.concat(list(batches)).sort_values("seq")
        place = seen + 1 + pd.RangeIndex(len(pdf))
        state.update((seen + len(pdf),))
        yield pdf.loc[place % n == 0, ["key", "seq"]]

    return rows.groupBy("key").applyInPandasWithState(run, "key string, seq long", "seen long", "append", GroupStateTimeout.NoTimeout)
