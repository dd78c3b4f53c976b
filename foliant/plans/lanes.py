"""Scans compiled to columns of one frame, so that a stream is read once whatever branches.

A lane is a value and whether it is still there, as columns beside (stream_id, pos). Maps and filters are expressions;
steps that count are running sums over the stream; a choice is two lanes that are one again behind it; a fold at the
end is an aggregate. Running sums of a stream share its one shuffle. Where streams may be longer than a task, they are taken
by `prefix.running` instead of a window, so that nothing is gathered by stream.

What ended a stream: the signal at the earliest position; of several at one position that of the step furthest to the
right, since it ends all before the left is asked; of the arms of a branch, a failure before a stop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.plans import prefix

#: Steps that lanes know; those of FOLDS must come last.
STEPS, FOLDS = {"map", "filter", "take", "drop", "bomb", "choice"}, {"aggregate", "count"}

SIGNAL = "struct<at:bigint,step:int,rank:int,status:string,error:string>"


def fits(steps: list[tuple]) -> bool:
    """Whether lanes can run these steps."""
    return all(s[0] in STEPS and (s[0] != "choice" or all(fits(arm.steps) and not folds(arm.steps) for arm in s[1:])) or s[0] in FOLDS and k == len(steps) - 1 for k, s in enumerate(steps))


def folds(steps: list[tuple]) -> bool:
    return bool(steps) and steps[-1][0] in FOLDS


@dataclass
class Lane:
    """value and alive: columns of the frame. signals: expressions of SIGNAL, null where a row raises none. whole:
    whether all rows are alive. Functions aren't asked about rows that are gone."""

    value: Column
    alive: Column
    signals: list[Column] = field(default_factory=list)
    whole: bool = False

    def of(self, f: Callable[[Column], Column]) -> Column:
        return f(self.value) if self.whole else F.when(self.alive, f(self.value))


class Frame:
    """Rows (stream_id, pos, value) to which lanes add columns. long: streams may be longer than a task."""

    def __init__(self, stream: DataFrame, long: bool = False):
        self.rows, self.long, self.made, self.known = stream, long, 0, {}

    def add(self, column: Column) -> Column:
        name = f"__c{self.made}"
        self.made += 1
        self.rows = self.rows.withColumn(name, column)
        return F.col(name)

    def lane(self) -> Lane:
        return Lane(F.col("value"), F.lit(True), whole=True)

    def before(self, amount: Column) -> Column:
        """What amount comes to over the rows before this one."""
        name = f"__c{self.made}"
        self.made += 1
        if self.long:
            self.rows = prefix.running(self.rows, "stream_id", ["pos"], {name: amount})
        else:
            earlier = Window.partitionBy("stream_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
            self.rows = self.rows.withColumn(name, F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast("long"))
        return F.col(name)

    def of_stream(self, least: Column) -> Column:
        """The least value of the stream, on each of its rows."""
        name = f"__c{self.made}"
        self.made += 1
        if self.long:
            found = self.rows.groupBy(F.col("stream_id").alias("__id")).agg(F.min(least).alias(name))
            self.rows = self.rows.join(found, F.col("stream_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        else:
            self.rows = self.rows.withColumn(name, F.min(least).over(Window.partitionBy("stream_id")))
        return F.col(name)


def _signal(when: Column, step: int, status: str, error: str | None = None) -> Column:
    rank = F.lit(0 if status == "failure" else 1)
    made = F.struct(F.col("pos").cast("long").alias("at"), F.lit(-step).alias("step"), rank.alias("rank"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
    return F.when(when, made)


def through(frame: Frame, lane: Lane, steps: list[tuple], first: int = 0, outer: int | None = None) -> Lane:
    """The lane behind steps. What begins alike, step for step the same, is made once. first: the place of the first
    step in its scan; outer: the place of the step that these are an arm of."""
    path: tuple = (id(lane), outer)
    for k, step in enumerate(steps, first):
        place = k if outer is None else outer
        path = (*path, id(step))
        if path not in frame.known:
            frame.known[path] = (_STEP[step[0]](frame, lane, place, *step[1:]), step, lane)
        lane = frame.known[path][0]
    return lane


def _map(frame: Frame, lane: Lane, place: int, f: Callable[[Column], Column]) -> Lane:
    return replace(lane, value=lane.of(f))


def _filter(frame: Frame, lane: Lane, place: int, p: Callable[[Column], Column]) -> Lane:
    return replace(lane, alive=frame.add(F.coalesce(lane.of(p), F.lit(False))), whole=False)


def _number(frame: Frame, lane: Lane) -> Column:
    return frame.before(lane.alive.cast("long"))


def _take(frame: Frame, lane: Lane, place: int, n: int) -> Lane:
    number = _number(frame, lane)
    stop = _signal(lane.alive & (number == max(n, 1) - 1), place, "stop")
    return Lane(lane.value, frame.add(lane.alive & (number < n)), [*lane.signals, stop])


def _drop(frame: Frame, lane: Lane, place: int, n: int) -> Lane:
    number = _number(frame, lane)
    return replace(lane, alive=frame.add(lane.alive & (number >= n)), whole=False)


def _bomb(frame: Frame, lane: Lane, place: int, most: int) -> Lane:
    value = frame.add(lane.value)
    length = F.octet_length(value)
    room = F.lit(most) - frame.before(F.when(lane.alive, length).cast("long"))
    fail = _signal(lane.alive & (room >= 0) & (length > room), place, "failure", f"BombError({most + 1},{most})")
    return Lane(F.substring(value, F.lit(1), F.greatest(room, F.lit(0)).cast("int")), frame.add(lane.alive & (room > 0)), [*lane.signals, fail])


def _choice(frame: Frame, lane: Lane, place: int, one: object, other: object) -> Lane:
    value = frame.add(lane.value)
    arms = []
    for scan, tag in ((one, "left"), (other, "right")):
        arms.append(through(frame, Lane(value[tag], frame.add(lane.alive & F.coalesce(value["tag"] == tag, F.lit(False)))), scan.steps, outer=place))
    a, b = arms
    alive, signals = a.alive | b.alive, a.signals + b.signals
    merged = F.when(a.alive, a.value).otherwise(b.value)
    if signals:
        end = frame.of_stream(F.least(*[s["at"] for s in signals], F.lit(None).cast("long")))
        within = end.isNull() | (F.col("pos") <= end)
        alive, signals = frame.add(alive & within), [F.when(within, s) for s in signals]
    return Lane(merged, alive, lane.signals + signals)


_STEP = {"map": _map, "filter": _filter, "take": _take, "drop": _drop, "bomb": _bomb, "choice": _choice}


def raised(lane: Lane) -> Column:
    """The first signal of a row."""
    if not lane.signals:
        return F.lit(None).cast(SIGNAL)
    return lane.signals[0] if len(lane.signals) == 1 else F.least(*lane.signals)


def folded(lane: Lane, step: tuple) -> Column:
    """A fold at the end, as an aggregate; streams that are emptied give its first value."""
    if step[0] == "count":
        n = F.coalesce(F.sum(F.when(lane.alive, F.octet_length(lane.value))), F.lit(0))
        return F.unhex(F.lpad(F.hex(n), 16, "0"))
    f, zero = step[1:]
    found = f(F.when(lane.alive, lane.value))
    return F.when(F.count(F.when(lane.alive, F.lit(1))) > 0, found).otherwise(zero)
