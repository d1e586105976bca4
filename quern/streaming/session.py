"""Voice requests as streams: wake windows over utterances, and a conversation state machine.

Both are folds over one key's events in order, used by batches (grouped) and by Structured Streaming
(applyInPandasWithState) alike; the state is a handful of values for each key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROMPT_MS, FOLLOW_MS, WAKE_MS, SETTLE_MS = 8000, 10_000, 8000, 500
LONE_WORD_MS = (300, 1500)


class State(NamedTuple):
    phase: str = "idle"  # idle, prompting, awaiting, working, following
    deadline: int = 0


class Event(NamedTuple):
    """type: wake, utterance, files_shown, finished, dismiss or tick; kind: of an utterance, as functions.intent names it."""

    at: int
    type: str
    kind: str = ""
    pick: str = ""
    reveal: bool = False


def step(state: State, e: Event) -> tuple[State, list[str]]:
    """The next state and what to do. Deadlines have passed when the time is strictly beyond them."""
    idle = State()
    late = state.deadline and e.at > state.deadline
    if e.type == "dismiss":
        return idle, ["close"]
    if e.type == "wake":
        return (state, []) if state.phase == "working" else (State("prompting", e.at + PROMPT_MS), ["show_prompt"])
    if e.type == "tick":
        if state.phase in ("prompting", "awaiting") and late:
            return idle, ["close"]
        return (idle, []) if state.phase == "following" and late else (state, [])
    if state.phase == "working":
        if e.type == "files_shown":
            return State("following", e.at + FOLLOW_MS), [f"expect:{FOLLOW_MS}"]
        return (idle, []) if e.type == "finished" else (state, [])
    if e.type != "utterance" or state.phase == "idle":
        return state, []
    request = {"file": "find_files", "question": "ask"}.get(e.kind)
    if state.phase in ("prompting", "awaiting"):
        if e.kind == "refuse":
            return idle, ["close"]
        if e.kind == "agree":
            return State("awaiting", e.at + PROMPT_MS), ["show_await", f"expect:{PROMPT_MS}"]
        return (State("working"), [request]) if request else (state, [])
    if e.pick:
        return State("following", e.at + FOLLOW_MS), [f"select:{e.pick}", f"expect:{FOLLOW_MS}"]
    if e.reveal:
        return state, ["reveal", f"expect:{max(0, state.deadline - e.at)}"]
    if e.kind == "refuse":
        return idle, ["close"]
    return (State("working"), [request]) if request else (state, [f"expect:{max(0, state.deadline - e.at)}"])


def played(state: State, events: list[Event]) -> tuple[State, list[tuple[int, str, str]]]:
    """The state after the events in order of time, and (at, phase, actions) of each."""
    out = []
    for e in sorted(events):
        state, actions = step(state, e)
        out.append((e.at, state.phase, ",".join(actions)))
    return state, out


def _events(frame: pd.DataFrame) -> list[Event]:
    rows = frame[["at", "type", "kind", "pick", "reveal"]].fillna({"kind": "", "pick": "", "reveal": False})
    return [Event(int(r.at), r.type, r.kind, r.pick, bool(r.reveal)) for r in rows.itertuples(index=False)]


OUT = "session string, at long, phase string, actions string"


def sessions_batch(events: DataFrame) -> DataFrame:
    """(session, at, phase, actions) of events (session, at, type, kind, pick, reveal). A session is one person's requests: small."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = played(State(), _events(frame))[1]
        return pd.DataFrame([(frame["session"].iloc[0], *r) for r in rows], columns=["session", "at", "phase", "actions"])

    return events.groupBy("session").applyInPandas(run, OUT)


def sessions_stream(events: DataFrame, timers: bool = True) -> DataFrame:
    """The same for a stream, with the state kept between micro-batches; idle states are dropped.

    With timers a prompt that nobody answers, or a wait for a follow-up, ends by itself once its deadline has passed on the
    clock of the machine; event times are taken to be of that clock. Without, a tick among the events ends it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = State(*json.loads(group.get[0])) if group.exists else State()
        late = [Event(state.deadline + 1, "tick")] if group.hasTimedOut else []
        state, rows = played(state, [*late, *(e for f in frames for e in _events(f))])
        if state.phase == "idle":
            if group.exists:
                group.remove()
        else:
            group.update((json.dumps(state),))
            if timers and state.deadline:
                group.setTimeoutDuration(max(1, state.deadline + 1 - group.getCurrentProcessingTimeMs()))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "at", "phase", "actions"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return events.groupBy("session").applyInPandasWithState(run, OUT, "state string", "append", timeout)


def dispatched(actions: DataFrame, requests_: DataFrame, results: DataFrame, folders: DataFrame, most: int = 5) -> DataFrame:
    """(session, at, kind, shown) of requests (session, at, query_id, folder) whose action is to find files: at most `most` names.

    A request for folders shows the folders that match (query_id, folder, place), or, if none does, those of its results
    (query_id, rank, name, folder), each once.
    """
    asked = actions.where("actions = 'find_files'").select("session", "at").join(requests_.withColumnRenamed("folder", "wants_folder"), ["session", "at"])
    listed = lambda rows, place: rows.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col("said")))), lambda x: x["said"]), 1, most).alias("said"))
    names = listed(results.where(F.col("rank") <= most).withColumn("said", F.col("name")), "rank").withColumnRenamed("said", "names")
    parents = listed(results.groupBy("query_id", F.col("folder").alias("said")).agg(F.min("rank").alias("rank")), "rank").withColumnRenamed("said", "parents")
    matched = listed(folders.withColumn("said", F.col("folder")), "place").withColumnRenamed("said", "matched")
    both = asked.join(names, "query_id", "left").join(parents, "query_id", "left").join(matched, "query_id", "left")
    kind = F.when(~F.col("wants_folder"), "files").when(F.col("matched").isNotNull(), "folders").otherwise("parent folders")
    shown = F.when(kind == "files", F.col("names")).when(kind == "folders", F.col("matched")).otherwise(F.col("parents"))
    return both.select("session", "at", kind.alias("kind"), F.coalesce(shown, F.array().cast("array<string>")).alias("shown"))


def in_order(pieces: DataFrame) -> DataFrame:
    """Transcripts (device, seq, done_ms, text) with ready_ms: a piece is handed on when it and all before it are done."""
    from pyspark.sql import Window

    order = Window.partitionBy("device").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieces.withColumn("ready_ms", F.max("done_ms").over(order))


def loaded_spans(uses: DataFrame, idle_ms: int = 120_000) -> DataFrame:
    """(model, start_ms, stop_ms, uses): a model is unloaded when it hasn't been used for idle_ms. uses: (model, at_ms)."""
    from pyspark.sql import Window

    order = Window.partitionBy("model").orderBy("at_ms")
    new = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(order) > idle_ms).cast("int"), F.lit(1))
    return uses.withColumn("new", new).withColumn("span", F.sum("new").over(order)).groupBy("model", "span").agg(F.min("at_ms").alias("start_ms"), (F.max("at_ms") + idle_ms).alias("stop_ms"), F.count("*").alias("uses")).drop("span")


def reset_frames(frames: DataFrame, delay: int = 8) -> DataFrame:
    """(stream, seq) at which a word spotter is reset: `delay` frames after speech (stream, seq, speech) ends, unless it goes on before."""
    from pyspark.sql import Window

    order = Window.partitionBy("stream").orderBy("seq")
    quiet = frames.withColumn("last", F.max(F.when(F.col("speech"), F.col("seq"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return quiet.where(~F.col("speech") & (F.col("seq") - F.col("last") == delay)).select("stream", "seq")


def requests(wakes: DataFrame, utterances: DataFrame, window_ms: int = WAKE_MS, settle_ms: int = SETTLE_MS) -> DataFrame:
    """Utterances (device, start_ms, stop_ms, text) within the window after a wake (device, at_ms), or up to the settling time before a late one.

    One row an utterance, with its nearest wake: the last one before it, settling time included, found in one walk over both in order of time. Stretches
    of a device as long as a wake can reach are groups of their own; a wake is in its stretch and the next, so work grows with the rows and no device is one task.
    """
    from pyspark.sql import Window

    reach = window_ms + settle_ms + 1
    stretch = F.col("t") - F.pmod("t", F.lit(reach).cast("long"))
    heard = wakes.where("device is not null").select("device", F.col("at_ms").cast("long").alias("t"), F.col("at_ms").alias("wake_ms")).where("t is not null")
    heard = heard.select("device", "t", "wake_ms", F.explode(F.array(stretch, stretch + reach)).alias("stretch"))
    said = utterances.where("device is not null and start_ms is not null").select("device", "start_ms", "stop_ms", "text", (F.col("start_ms") + settle_ms).cast("long").alias("t"))
    both = said.withColumn("stretch", stretch).withColumn("said", F.lit(True)).unionByName(heard.withColumn("said", F.lit(False)), allowMissingColumns=True).repartition("device", "stretch")
    order = Window.partitionBy("device", "stretch").orderBy("t", "said").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a wake comes before what is said at its time
    near = both.withColumn("wake_ms", F.last("wake_ms", ignorenulls=True).over(order)).where(F.col("said") & (F.col("start_ms") <= F.col("wake_ms") + window_ms))
    return near.groupBy("device", "stretch", "start_ms", "stop_ms", "text").agg(F.max("wake_ms").alias("wake_ms")).drop("stretch")


def second_chances(utterances: DataFrame) -> DataFrame:
    """Utterances as short as a lone word, which may be a wake word that was missed."""
    length = F.col("stop_ms") - F.col("start_ms")
    return utterances.where((length >= LONE_WORD_MS[0]) & (length <= LONE_WORD_MS[1]))


def valid_frames(frames: DataFrame, size: int = 1600) -> DataFrame:
    """Frames of the right length with finite samples."""
    finite = F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frames.where((F.size("samples") == size) & finite)


def utterance_runs(frames: DataFrame, threshold: float = 0.02, gap_frames: int = 4, least_frames: int = 3, most_frames: int | None = 150) -> DataFrame:
    """(stream, first, last) runs of loud frames (stream, seq, level) with pauses below gap_frames: gaps and islands.

    Runs of more than most_frames are cut into pieces of so many; pieces and runs of fewer than least_frames are dropped.
    """
    from pyspark.sql import Window

    loud = frames.where(F.col("level") >= threshold)
    order = Window.partitionBy("stream").orderBy("seq")
    marked = loud.withColumn("new", F.coalesce((F.col("seq") - F.lag("seq").over(order) > gap_frames).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(order)).groupBy("stream", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    if most_frames is not None:
        pieces = runs.select("stream", "last", F.explode(F.sequence("first", "last", F.lit(most_frames).cast(runs.schema["first"].dataType))).alias("first"))
        runs = pieces.withColumn("last", F.least("last", F.col("first") + (most_frames - 1)))
    return runs.where(F.col("last") - F.col("first") + 1 >= least_frames).select("stream", "first", "last")
