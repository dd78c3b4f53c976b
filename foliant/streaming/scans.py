"""Scans over streams that never end, with their state kept by Spark.

Rows are (stream_id, pos, value, last): positions count from 0 without gaps, `last` marks the last row of a stream. Rows may
come in any order and in any cutting into batches; one that comes early waits in state for those before it. Steps
that count or keep something (take, drop, bomb_guard, fixed_chunk, count_bytes, merged folds, steps of one's own) run in
one operator as long as they follow each other; maps and filters between them are projections, and what follows those is an
operator of its own. A stream ends with its last row, with a signal, or, if a timeout is given, when nothing has
come for so long; then what steps still hold is given, and a row with the status.

State a stream: the next position, what the steps hold, and the rows that came early. Of an ended stream only the fact
remains, so that rows that come late are passed over."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.plans.scan import LAST, Failed, Scan

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (status, error) of a signal, or None.
Signal = tuple[str, str | None] | None
STOP: Signal = ("stop", None)


class Step:
    """What a step does with one value: (next state, values given, signal); and at the end: (values, signal)."""

    initial: Any = 0

    def step(self, state: Any, v: Any) -> tuple[Any, list, Signal]:
        raise NotImplementedError

    def end(self, state: Any) -> tuple[list, Signal]:
        return [], None


class Take(Step):
    def __init__(self, n: int):
        self.n = n

    def step(self, state: int, v: Any) -> tuple[int, list, Signal]:
        return state + 1, [v] if state < self.n else [], STOP if state + 1 >= self.n else None


class Drop(Step):
    def __init__(self, n: int):
        self.n = n

    def step(self, state: int, v: Any) -> tuple[int, list, Signal]:
        return min(state + 1, max(self.n, 0)), [v] if state >= self.n else [], None


class Bomb(Step):
    def __init__(self, most: int):
        self.most = most

    def step(self, state: int, v: bytes) -> tuple[int, list, Signal]:
        room = self.most - state
        over = len(v) > room
        return state + len(v), [v[:room]] if room > 0 else [], ("failure", f"BombError({self.most + 1},{self.most})") if over else None


class Chunk(Step):
    initial = b""

    def __init__(self, size: int):
        self.size = size

    def step(self, state: bytes, v: bytes) -> tuple[bytes, list, Signal]:
        held = state + bytes(v)
        whole = len(held) - len(held) % self.size
        return held[whole:], [held[i : i + self.size] for i in range(0, whole, self.size)], None

    def end(self, state: bytes) -> tuple[list, Signal]:
        return [state] if state else [], None


class Count(Step):
    def step(self, state: int, v: bytes) -> tuple[int, list, Signal]:
        return state + len(v), [], None

    def end(self, state: int) -> tuple[list, Signal]:
        return [state.to_bytes(8, "big")], None


class Merge(Step):
    """Values are lifted summaries."""

    def __init__(self, merge: Callable[[dict, dict], dict], unit: dict):
        self.merge, self.initial = merge, unit

    def step(self, state: dict, v: Any) -> tuple[dict, list, Signal]:
        one = {k: np.array([state[k]]) for k in state}
        return {k: x[0].item() for k, x in self.merge(one, {k: np.array([v[k]]) for k in state}).items()}, [], None

    def end(self, state: dict) -> tuple[list, Signal]:
        return [state], None


class Own(Step):
    def __init__(self, initial: Any, step: Callable, finish: Callable):
        self.initial, self.own, self.finish = initial, step, finish

    def step(self, state: Any, v: Any) -> tuple[Any, list, Signal]:
        try:
            return *self.own(state, v), None
        except Failed as e:
            return state, e.given, ("failure", e.error)

    def end(self, state: Any) -> tuple[list, Signal]:
        try:
            return self.finish(state), None
        except Failed as e:
            return e.given, ("failure", e.error)


def push(steps: list[Step], states: list, values: list, k: int = 0) -> tuple[list, Signal]:
    """What comes out when values go through steps from k on; states follow. A signal further to the right ends all;
    one to its left has the right brought to its end."""
    if k == len(steps):
        return values, None
    out: list = []
    for v in values:
        states[k], given, signal = steps[k].step(states[k], v)
        more, ended = push(steps, states, given, k + 1)
        out += more
        if ended:
            return out, ended
        if signal:
            more, ended = close(steps, states, k + 1)
            return out + more, ended if signal[0] == "stop" and ended and ended[0] == "failure" else signal
    return out, None


def close(steps: list[Step], states: list, k: int = 0) -> tuple[list, Signal]:
    """What steps from k on still give at the end."""
    if k == len(steps):
        return [], None
    given, signal = steps[k].end(states[k])
    out, ended = push(steps, states, given, k + 1)
    if ended:
        return out, ended
    more, ended = close(steps, states, k + 1)
    return out + more, signal if signal and (signal[0] == "failure" or not ended) else ended


class Runner(StatefulProcessor):
    """Rows (pos, value, gone, last, status, error) of one stream through steps. Rows that are gone keep their
    position. Outputs are numbered from 0; the last row says how the stream ended. Each call asks for the state once and
    writes it once; rows that came early are asked for by position, if there are any."""

    def __init__(self, steps: list[Step], value: T.DataType, timeout: int | None):
        self.steps, self.timeout = steps, timeout
        kinds = ("next long, given long, waiting long, ended boolean, states binary", "pos long", "gone boolean, last boolean, status string, error string")
        self.state_kind, self.pos_kind, rest = map(T._parse_datatype_string, kinds)  # workers can't parse them
        self.row_kind = T.StructType([T.StructField("value", value), *rest.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_kind)
        self.early = handle.getMapState("early", self.pos_kind, self.row_kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        place, given, waiting, ended, held = self.state.get() or (0, 0, 0, False, None)
        if ended:
            return
        states = pickle.loads(bytes(held)) if held is not None else [s.initial for s in self.steps]
        came = {r["pos"]: (r["value"], r["gone"], r["last"], r["status"], r["error"]) for r in rows if r["pos"] >= place}
        out: list = []
        status: Signal = None
        while not status:
            row = came.pop(place, None)
            if row is None and waiting and (row := self.early.getValue((place,))) is not None:
                self.early.removeKey((place,))
                waiting -= 1
            if row is None:
                break
            value, gone, last, told, error = row
            place += 1
            if told is not None:  # an operator before this one says how it ended
                made, ended_by = close(self.steps, states)
                out += made
                status = (told, error) if told == "failure" or not ended_by or (told == "stop" and ended_by[0] != "failure") else ended_by
                break
            if not gone:
                made, status = push(self.steps, states, [value])
                out += made
            if last and not status:
                made, status = close(self.steps, states)
                out += made
                status = status or ("success", None)
        yield from self.told(key, out, given, status)
        if status:
            self.forget(waiting)
            return
        for pos, row in came.items():
            if not (waiting and self.early.containsKey((pos,))):  # else it has come twice
                waiting += 1
            self.early.updateValue((pos,), row)
        self.state.update((place, given + len(out), waiting, False, pickle.dumps(states)))
        self.wait(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        place, given, waiting, ended, held = self.state.get() or (0, 0, 0, True, None)
        if ended:
            return
        out, status = close(self.steps, pickle.loads(bytes(held)))
        yield from self.told(key, out, given, ("failure", f"MissingError({place})") if waiting else status or ("success", None))
        self.forget(waiting)

    def wait(self, timers: Any) -> None:
        if self.timeout is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout)

    def forget(self, waiting: int) -> None:
        if waiting:
            self.early.clear()
        self.state.update((0, 0, 0, True, None))

    @staticmethod
    def told(key: Any, out: list, given: int, status: Signal) -> Iterator[Row]:
        names = ("stream_id", "pos", "value", "gone", "last", "status", "error")
        for k, v in enumerate(out):
            yield Row(**dict(zip(names, (key[0], given + k, v, False, False, None, None), strict=True)))
        if status:
            yield Row(**dict(zip(names, (key[0], given + len(out), None, True, True, *status), strict=True)))

    def close(self) -> None:
        pass


def _stepped(step: tuple, value: T.DataType) -> tuple[Step, T.DataType]:
    """The step and the kind of what it gives."""
    kind, *args = step
    if kind == "stateful":
        return Own(*args[:3]), T._parse_datatype_string(args[3])
    if kind == "merge":
        return Merge(args[1], args[2]), value
    made = {"take": Take, "drop": Drop, "bomb": Bomb, "chunk": Chunk, "count": Count}.get(kind)
    if made is None:
        raise ValueError(f"{kind} can't run over a stream that doesn't end")
    return made(*args), T.BinaryType() if kind in ("chunk", "count") else value


def _groups(steps: list[tuple]) -> list[list[tuple]]:
    """Maps, filters and merged folds each alone, other steps with those that they follow."""
    out: list[list[tuple]] = []
    for step in steps:
        if out and not {step[0], out[-1][0][0]} & {"map", "filter", "merge"}:
            out[-1].append(step)
        else:
            out.append([step])
    return out


def run_stream(rows: DataFrame, scan: Scan, timeout: int | None = None) -> DataFrame:
    """(stream_id, pos, value, status, error): what the scan gives, numbered from 0, and for each stream that ends a row
    at position LAST with its status. rows: (stream_id, pos, value, last), a stream or not. timeout: milliseconds
    after which a stream of which nothing comes has ended; rows that still wait then are a failure."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    none = F.lit(None).cast("string")
    now = rows.select("stream_id", F.col("pos").cast("long").alias("pos"), "value", F.lit(False).alias("gone"), F.coalesce("last", F.lit(False)).alias("last"), none.alias("status"), none.alias("error"))
    there, placed = ~F.col("gone") & F.col("status").isNull(), False
    for group in _groups(scan.steps):
        name, *args = group[0]
        if name == "map":
            now = now.withColumn("value", F.when(there, args[0](F.col("value"))))
            continue
        if name == "filter":
            now = now.withColumn("gone", F.col("gone") | (there & ~F.coalesce(F.when(there, args[0](F.col("value"))), F.lit(False))))
            continue
        if name == "merge":
            now = now.withColumn("value", F.when(there, F.struct(*[c.alias(n) for n, c in args[0](F.col("value")).items()])))
        value, steps = now.schema["value"].dataType, []
        for one in group:
            step, value = _stepped(one, value)
            steps.append(step)
        now, placed = _operator(now, steps, value, timeout), True
        if name == "merge":
            now = now.withColumn("value", F.when(there, args[3](F.col("value"))))
    if not placed:
        now = _operator(now, [], now.schema["value"].dataType, timeout)
    return now.where("not gone or status is not null").select("stream_id", F.when(F.col("status").isNull(), F.col("pos")).otherwise(LAST).alias("pos"), "value", "status", "error")


def _operator(now: DataFrame, steps: list[Step], value: T.DataType, timeout: int | None) -> DataFrame:
    kind = now.schema["value"].dataType
    schema = T.StructType([now.schema["stream_id"], T.StructField("pos", T.LongType()), T.StructField("value", value), *T._parse_datatype_string("gone boolean, last boolean, status string, error string").fields])
    mode = "none" if timeout is None else "processingTime"
    return now.groupBy("stream_id").transformWithState(Runner(steps, kind, timeout), schema, "append", mode)
