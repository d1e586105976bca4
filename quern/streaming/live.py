"""Voice and answer streams with state of their own: event-time timers, pieces in order, state that runs out.

Each processor gives for any split of its rows into micro-batches, in any order within the watermark, what its batch form in
streaming.session or operators.ask gives for all rows at once. State lies in RocksDB, so a key may hold many rows and a restarted query goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators import ask
from quern.streaming.session import SETTLE_MS, WAKE_MS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    """spark with the state store that the processors need; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class WakeWindows(StatefulProcessor):
    """Utterances wait until no wake that they could belong to can come any more, and are then given the latest in their window or dropped."""

    def __init__(self, window_ms: int, settle_ms: int) -> None:
        self.window, self.settle = window_ms, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wakes = handle.getListState("wakes", "at long")
        self.waiting = handle.getListState("waiting", "start long, stop long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            wake = frame["kind"] == "wake"
            if wake.any():
                self.wakes.appendList([(int(t),) for t in frame.loc[wake, "at_ms"]])
            for r in frame[~wake].itertuples(index=False):
                self.waiting.appendValue((int(r.at_ms), int(r.stop_ms), r.text))
                self.handle.registerTimer(int(r.at_ms) + self.settle + 1)
            for t in frame.loc[wake, "at_ms"]:
                self.handle.registerTimer(int(t) + self.window + self.settle + 1)  # to forget it
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        wakes, waiting = [w[0] for w in self.wakes.get()], list(self.waiting.get())
        ready = [w for w in waiting if w[0] + self.settle < now]
        if ready:
            self.waiting.put([w for w in waiting if w[0] + self.settle >= now]) if len(ready) < len(waiting) else self.waiting.clear()
        kept = [w for w in wakes if w + self.window + self.settle >= now]
        if len(kept) < len(wakes):
            self.wakes.put([(w,) for w in kept]) if kept else self.wakes.clear()
        out = []
        for start, stop, text in ready:
            inside = [w for w in wakes if start - self.window <= w <= start + self.settle]
            if inside:
                out.append((key[0], start, stop, text, max(inside)))
        yield pd.DataFrame(out, columns=["device", "start_ms", "stop_ms", "text", "wake_ms"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def requests(events: DataFrame, window_ms: int = WAKE_MS, settle_ms: int = SETTLE_MS, lateness: str = "10 seconds") -> DataFrame:
    """session.requests() for a stream of events (device, kind: wake or utterance, at_ms, stop_ms, text), as soon as the watermark has settled them.

    Events may come in any order within the lateness; later ones are dropped. A wake that comes after its utterance, but belongs before it, releases it.
    """
    prepared(events.sparkSession)
    timed = events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", lateness)
    return timed.groupBy("device").transformWithStateInPandas(
        WakeWindows(window_ms, settle_ms), outputStructType="device string, start_ms long, stop_ms long, text string, wake_ms long", outputMode="Append", timeMode="EventTime"
    )


class InOrder(StatefulProcessor):
    """Hands the rows of a key on by their seq, from `first` on without gaps, whatever order they come in; fold() makes what comes out of them.

    What waits behind a gap is forgotten after ttl_ms on the machine's clock, if that is given. Rows that come twice count once.
    """

    columns: tuple[str, ...] = ()

    def __init__(self, first: int = 1, ttl_ms: int | None = None) -> None:
        self.first, self.ttl = first, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, memory string")
        self.held = handle.getMapState("held", "seq long", "row string", self.ttl)

    def fold(self, memory: dict, seq: int, row: dict) -> list[tuple]:
        """What comes out once this row is next; memory is what the key remembers."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.place.get()
        at, memory = (self.first, {}) if known is None else (known[0], json.loads(known[1]))
        new = {}
        for frame in rows:
            for row in frame.to_dict("records"):
                if row["seq"] >= at:
                    new.setdefault(int(row["seq"]), {c: v.item() if hasattr(v, "item") else v for c, v in row.items()})
        out = []
        while (row := new.pop(at, None)) is not None or self.held.containsKey((at,)):
            if row is None:
                row = json.loads(self.held.getValue((at,))[0])
                self.held.removeKey((at,))
            out += [(key[0], *made) for made in self.fold(memory, at, row)]
            at += 1
        for seq, row in new.items():
            if not self.held.containsKey((seq,)):
                self.held.updateValue((seq,), (json.dumps(row),))
        self.place.update((at, json.dumps(memory)))
        yield pd.DataFrame(out, columns=self.columns) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class Transcripts(InOrder):
    columns = ("device", "seq", "text", "ready_ms")

    def fold(self, memory: dict, seq: int, row: dict) -> list[tuple]:
        memory["ready"] = max(memory.get("ready", row["done_ms"]), row["done_ms"])
        return [(seq, row["text"], memory["ready"])]


def in_order(pieces: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """session.in_order() for a stream of transcripts (device, seq from 1, done_ms, text): each as soon as all before it are there."""
    prepared(pieces.sparkSession)
    return pieces.groupBy("device").transformWithStateInPandas(Transcripts(1, ttl_ms), outputStructType="device string, seq long, text string, ready_ms long", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class SpotterResets(InOrder):
    columns = ("stream", "seq")

    def __init__(self, delay: int) -> None:
        super().__init__(0)
        self.delay = delay

    def fold(self, memory: dict, seq: int, row: dict) -> list[tuple]:
        if row["speech"]:
            memory["last"] = seq
        return [(seq,)] if not row["speech"] and seq - memory.get("last", seq) == self.delay else []


def reset_frames(frames: DataFrame, delay: int = 8) -> DataFrame:
    """session.reset_frames() for a stream of frames (stream, seq from 0, speech)."""
    prepared(frames.sparkSession)
    return frames.groupBy("stream").transformWithStateInPandas(SpotterResets(delay), outputStructType="stream string, seq long", outputMode="Append", timeMode="None")


class ShownTokens(InOrder):
    """Pieces of an answer are held for as long as what has come is a beginning of the marker or begins with it, and come out together once neither is so."""

    columns = ("ask_id", "seq", "token", "held")

    def __init__(self, marker: str) -> None:
        super().__init__(1)
        self.marker = marker

    def fold(self, memory: dict, seq: int, row: dict) -> list[tuple]:
        if memory.get("open"):
            return [(seq, row["token"], False)]
        memory["said"] = (memory.get("said", "") + row["token"]).lstrip(" ")[: len(self.marker)]
        held = memory.setdefault("held", [])
        if self.marker.startswith(memory["said"]):
            held.append([seq, row["token"]])
            return []
        memory["open"] = True
        out = [(s, t, True) for s, t in held] + [(seq, row["token"], False)]
        memory.pop("held")
        memory.pop("said")
        return out


def shown_tokens(tokens: DataFrame, marker: str = ask.NO_EVIDENCE) -> DataFrame:
    """ask.shown_tokens() for a stream of pieces (ask_id, seq from 1, token): the rows that are shown, held ones with the piece that released them."""
    prepared(tokens.sparkSession)
    return tokens.groupBy("ask_id").transformWithStateInPandas(ShownTokens(marker), outputStructType="ask_id long, seq long, token string, held boolean", outputMode="Append", timeMode="None")


class LoadedSpans(StatefulProcessor):
    """Spans of a key's uses that lie at most idle_ms apart; a span comes out, and its state goes, once the watermark has passed its end."""

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "start long, last long, uses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(t), 1) for frame in rows for t in frame["at_ms"]]
        joined: list[tuple[int, int, int]] = []
        for start, last, uses in sorted([*self.spans.get(), *new]):
            if joined and start - joined[-1][1] <= self.idle:
                joined[-1] = (joined[-1][0], max(last, joined[-1][1]), joined[-1][2] + uses)
            else:
                joined.append((start, last, uses))
        self.spans.put(joined)
        for _, last, _ in joined:
            self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, spans = timerValues.getCurrentWatermarkInMs(), [tuple(s) for s in self.spans.get()]
        over = [s for s in spans if s[1] + self.idle < now]
        if over:
            left = [s for s in spans if s not in over]
            self.spans.put(left) if left else self.spans.clear()
        yield pd.DataFrame([(key[0], a, b + self.idle, n) for a, b, n in over], columns=["model", "start_ms", "stop_ms", "uses"]) if over else pd.DataFrame()

    def close(self) -> None:
        pass


def loaded_spans(uses: DataFrame, idle_ms: int = 120_000, lateness: str = "10 seconds") -> DataFrame:
    """session.loaded_spans() for a stream of uses (model, at_ms)."""
    prepared(uses.sparkSession)
    timed = uses.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", lateness)
    return timed.groupBy("model").transformWithStateInPandas(LoadedSpans(idle_ms), outputStructType="model string, start_ms long, stop_ms long, uses long", outputMode="Append", timeMode="EventTime")
