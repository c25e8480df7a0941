"""The index queue as keyed state (ST-1, ST-3) and the completion watcher (ST-8), both with timers.

A key (database, document, version) has at most one job: queued or active. What happens to it comes as events

* ``request``: a job is wanted, in mode ``full`` or ``deferred`` (scans are read later), ``rerun`` if it must follow an active one;
* ``started``, ``finished``, ``failed``: what a worker tells of it;
* ``cancel``: a queued job goes.

and leads to actions that workers read: ``queue`` (with a mode and a reason), ``upgrade`` of a queued job to the full mode,
``drop``. A deferred job that has finished is queued again in the full mode when nothing has been asked for its key for a
while. State is a few values a key; a restart goes on from the checkpoint, and each action is told once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE, QUEUED, ACTIVE = "idle", "queued", "active"
#: phase, mode of the job, whether it must run again, whether in full mode, when a deferred job is due (milliseconds, 0: never)
NEW = (IDLE, "full", False, False, 0)
STATE = "phase string, mode string, rerun boolean, full boolean, due bigint"
ACTIONS = [("action", "string"), ("mode", "string"), ("reason", "string"), ("seq", "bigint")]


def step(state: tuple, kind: str, mode: str | None, rerun: bool, at: int, wait: int) -> tuple[tuple, list[tuple[str, str, str]]]:
    """The state after an event and the (action, mode, reason) it leads to. at, wait: milliseconds."""
    phase, own, again, full, due = state
    mode = mode or "full"
    if kind == "request":
        if phase == IDLE:
            return (QUEUED, mode, False, False, 0), [("queue", mode, "request")]
        if phase == QUEUED:
            return (phase, "full" if mode == "full" else own, again, full, due), [("upgrade", "full", "request")] if mode == "full" and own != "full" else []
        return (phase, own, again or rerun or mode == "full", full or mode == "full", due), []
    if kind == "started" and phase == QUEUED:
        return (ACTIVE, own, False, False, 0), []
    if kind in ("finished", "failed") and phase == ACTIVE:
        if again:
            own = "full" if full else own
            return (QUEUED, own, False, False, 0), [("queue", own, "rerun")]
        return (IDLE, own, False, False, at + wait if kind == "finished" and own == "deferred" else 0), []
    if kind == "cancel" and phase == QUEUED:
        return NEW, [("drop", own, "cancel")]
    return state, []


def in_order(frames: Iterable[pd.DataFrame], *columns: str) -> list[tuple]:
    """A key's rows of a micro-batch by their last column; plain values, as a key has few rows and a frame costs more than they do."""
    return sorted((r for f in frames for r in zip(*(f[c].array for c in columns))), key=lambda r: r[-1])


def due(state: tuple, now: int) -> tuple[tuple, list[tuple[str, str, str]]]:
    """What an idle key does at a time: a deferred job whose wait is over is queued in the full mode."""
    phase, own, _, _, at = state
    if phase == IDLE and at and at <= now:
        return (QUEUED, "full", False, False, 0), [("queue", "full", "deferred")]
    return state, []


def queue_actions(events: DataFrame, keys: list[str], wait: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST-1, ST-3: (keys, action, mode, reason, seq) of a stream (keys, kind, mode, rerun, ts, seq), in append mode.

    The events of a key in a micro-batch are taken by seq. Timers follow the watermark of ts, which lags by ``delay``: a
    deferred job is queued when the watermark has passed its end by ``wait``. Events later than that are left to the
    watermark. seq of an action is that of the event that led to it, null for a timer.
    """
    millis = int(pd.Timedelta(wait) / pd.Timedelta(milliseconds=1))
    kinds = [(k, events.schema[k].dataType) for k in keys]

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = (tuple(state.get) if state.exists else NEW), []
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            now, made = due(now, max(mark, now[4]))
            out += [(*key, *a, None) for a in made]
        else:
            for kind, mode, rerun, at, seq in in_order(frames, "kind", "mode", "rerun", "ms", "seq"):
                now, made = step(now, kind, mode, bool(rerun), int(at), millis)
                out += [(*key, *a, int(seq)) for a in made]
        state.update(now)
        if now[0] == IDLE and now[4]:
            state.setTimeoutTimestamp(max(now[4], mark + 1))
        if out:
            columns = dict(zip([*keys, *(n for n, _ in ACTIONS)], map(list, zip(*out))))
            yield pd.DataFrame(columns | {"seq": pd.array(columns["seq"], dtype="Int64")})

    schema = T.StructType([*(T.StructField(k, t) for k, t in kinds), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in ACTIONS)])
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.select(*keys, "kind", "mode", F.coalesce("rerun", F.lit(False)).alias("rerun"), "ts", F.unix_millis("ts").alias("ms"), "seq")
    return timed.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def seen(told: str, pending: int, ready: int, error: int) -> tuple[str, str | None]:
    """ST-8: (what was told last, what is told now) for polled counts; a key is silent until it has work."""
    now = "waiting" if pending else "error" if error else "complete" if ready else ""
    if not now or not told and now != "waiting" or now == told:
        return told, None
    return now, now


def watch(polls: DataFrame, keys: list[str]) -> DataFrame:
    """ST-8: (keys, state, seq) whenever the state of a key changes, of a stream of polls (keys, pending, ready, error, seq); each change is told once, restarts included."""
    kinds = [T.StructField(k, polls.schema[k].dataType) for k in keys]

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, out = (state.get[0] if state.exists else ""), []
        for pending, ready, error, seq in in_order(frames, "pending", "ready", "error", "seq"):
            told, now = seen(told, int(pending), int(ready), int(error))
            if now:
                out.append((*key, now, int(seq)))
        state.update((told,))
        if out:
            yield pd.DataFrame(dict(zip([*keys, "state", "seq"], map(list, zip(*out)))))

    schema = T.StructType([*kinds, T.StructField("state", T.StringType()), T.StructField("seq", T.LongType())])
    return polls.select(*keys, "pending", "ready", "error", "seq").groupBy(*keys).applyInPandasWithState(run, schema, "told string", "append", GroupStateTimeout.NoTimeout)
