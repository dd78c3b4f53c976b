"""A scan algebra over ordered streams, compiled to DataFrame operations.

A stream is rows (stream_id, pos, value). A scan compiles to outputs (stream_id, pos, value), what is left
at the end of a stream (the value of a fold, a digest, the last short chunk) and a status for each stream
(success, stop or failure, with an error). Run, the outputs are followed by what is left.

Scans compose with >> (what the first leaves is fed to the second before that ends), run beside each other
with & (pairs of outputs by position; the surplus of the longer side and what is left are dropped) and with
| (values tagged left or right go to one of two scans; the first arm to signal ends both). Adjacent maps fold
into one projection, so that long chains don't grow the plan. Folds, digests and counts of streams that an
earlier step has emptied give their first value."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.functions import digests
from foliant.plans import lanes, prefix

#: Positions of what is left come behind all others.
LAST = 1 << 62

#: Bytes of a long stream that one task digests, and what its last value has beyond.
SPAN = 128 << 20


@dataclass
class Result:
    """outputs: what a run gives. status: one row a stream that came in. both: outputs with the status of their
    stream beside them, (stream_id, pos, value, status, error)."""

    outputs: DataFrame
    status: DataFrame
    both: DataFrame


@dataclass
class _Made:
    """emitted and left: (stream_id, pos, value); left is None if nothing ever is. signals: (stream_id, at, status,
    error) of streams that signal, None if they never do; at: the position that raised it."""

    emitted: DataFrame
    left: DataFrame | None = None
    signals: DataFrame | None = None

    def whole(self) -> DataFrame:
        return self.emitted if self.left is None else self.emitted.unionByName(self.left)


@dataclass
class _Run:
    """ids: of all streams that came in. long: streams may be longer than a task."""

    ids: DataFrame
    long: bool = False

    def before(self, rows: DataFrame, amount: Column) -> tuple[DataFrame, Column]:
        """rows, and what amount comes to over the earlier rows of the stream."""
        frame = lanes.Frame(rows, self.long)
        column = frame.before(amount)
        return frame.rows, column


def _laned(stream: DataFrame, steps: list[tuple], first: int, run: _Run) -> _Made:
    frame = lanes.Frame(stream, run.long)
    lane = lanes.through(frame, frame.lane(), steps, first)
    emitted = frame.rows.where(lane.alive).select("stream_id", "pos", lane.value.alias("value"))
    if not lane.signals:
        return _Made(emitted)
    raised = frame.rows.select("stream_id", lanes.raised(lane).alias("x")).where("x is not null")
    return _Made(emitted, signals=raised.select("stream_id", "x.at", "x.status", "x.error", (-F.col("x.step")).alias("step")))


def _unite(frames: list[DataFrame | None]) -> DataFrame | None:
    there = [f for f in frames if f is not None]
    return reduce(DataFrame.unionByName, there) if there else None


class Scan:
    def __init__(self, steps: list[tuple]):
        self.steps = steps

    def __rshift__(self, other: Scan) -> Scan:
        steps = [*self.steps]
        for step in other.steps:
            if steps and step[0] == steps[-1][0] == "map":
                f, g = steps[-1][1], step[1]
                steps[-1] = ("map", lambda c, f=f, g=g: g(f(c)))
            else:
                steps.append(step)
        return Scan(steps)

    and_then = __rshift__

    def __lshift__(self, other: Scan) -> Scan:
        return other >> self

    compose = __lshift__

    def __and__(self, other: Scan) -> Scan:
        return Scan([("fanout", self, other)])

    def __or__(self, other: Scan) -> Scan:
        return Scan([("choice", self, other)])

    def __mul__(self, other: Scan) -> Scan:
        """Of pairs, the first goes to one scan and the second to the other; their outputs are paired."""
        return (first_of() >> self) & (second_of() >> other)

    def __add__(self, other: Scan) -> Scan:
        """Tagged values go to one of two scans; outputs are tagged by the arm they come from. Both arms must give
        the kinds that to_left and to_right are told."""
        return (self >> inject_left()) | (other >> inject_right())

    def map(self, f: Callable[[Column], Column]) -> Scan:
        return self >> map_(f)

    def contramap(self, f: Callable[[Column], Column]) -> Scan:
        return map_(f) >> self

    def dimap(self, before: Callable[[Column], Column], after: Callable[[Column], Column]) -> Scan:
        return map_(before) >> self >> map_(after)

    def first(self) -> Scan:
        """Of pairs, the first through this scan, paired with the seconds by position."""
        return self * identity()

    def second(self) -> Scan:
        return identity() * self

    def made(self, stream: DataFrame, run: _Run) -> _Made:
        made, signals, k = _Made(stream), [], 0
        while k < len(self.steps):
            n = next((i for i, step in enumerate(self.steps[k:]) if step[0] not in lanes.STEPS or not lanes.fits([step])), len(self.steps) - k)
            if n:  # steps that lanes know go together
                made = _laned(made.whole(), self.steps[k : k + n], k, run)
                signals.append(made.signals)
                k += n
            else:
                made = _COMPILE[self.steps[k][0]](made.whole(), run, *self.steps[k][1:])
                signals.append(None if made.signals is None else made.signals.withColumn("step", F.lit(k)))
                k += 1
        return replace(made, signals=_unite(signals))

    def run(self, stream: DataFrame, long: bool = False) -> Result:
        """The status is that of the first signal; of several at one position, the step furthest to the right has
        raised it. Without a signal it is success. long: streams may be longer than a task; steps that
        count or cut then go by ranges of positions."""
        if lanes.fits(self.steps):
            return _by_lanes(self, stream, long)
        ids = stream.select("stream_id").distinct()
        made = self.made(stream, _Run(ids, long))
        outputs, status = made.whole(), _statuses(ids, made.signals)
        return Result(outputs, status, _beside(outputs, status, "inner"))


def _beside(one: DataFrame, other: DataFrame, how: str = "left", *also: str) -> DataFrame:
    """Joined by stream and the columns of also; a null is a stream too."""
    keys = ["stream_id", *also]
    other = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(Column.__and__, [one[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    return one.join(other, same, how).drop(*[f"__{k}" for k in keys])


def _statuses(ids: DataFrame, signals: DataFrame | None) -> DataFrame:
    if signals is None:
        return ids.select("stream_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    first = F.struct("at", -F.col("step"), F.when(F.col("status") == "failure", 0).otherwise(1))
    worst = signals.groupBy("stream_id").agg(F.min_by(F.struct("status", "error"), first).alias("x"))
    return _beside(ids, worst).select("stream_id", F.coalesce("x.status", F.lit("success")).alias("status"), F.col("x.error").alias("error"))


def _told(signal: Column) -> tuple[Column, Column]:
    return F.coalesce(signal["status"], F.lit("success")).alias("status"), signal["error"].alias("error")


def _by_lanes(scan: Scan, stream: DataFrame, long: bool) -> Result:
    frame, ends = lanes.Frame(stream, long), lanes.folds(scan.steps)
    lane = lanes.through(frame, frame.lane(), scan.steps[:-1] if ends else scan.steps)
    if ends:
        left = frame.rows.groupBy("stream_id").agg(lanes.folded(lane, scan.steps[-1]).alias("value"), F.min(lanes.raised(lane)).alias("__signal"))
        both = left.select("stream_id", F.lit(LAST).alias("pos"), "value", *_told(F.col("__signal")))
        return Result(both.drop("status", "error"), both.select("stream_id", "status", "error"), both)
    status = frame.rows.groupBy("stream_id").agg(F.min(lanes.raised(lane)).alias("__signal")).select("stream_id", *_told(F.col("__signal")))
    outputs = frame.rows.where(lane.alive).select("stream_id", "pos", lane.value.alias("value"))
    if lane.signals:
        signal = frame.of_stream(lanes.raised(lane))
        both = frame.rows.where(lane.alive).select("stream_id", "pos", lane.value.alias("value"), *_told(signal))
    else:
        both = outputs.select("*", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    return Result(outputs, status, both)


# ---- constructors --------------------------------------------------------------------------------


class Failed(Exception):
    """Raised by a step of one's own to fail its stream; `given` still goes on."""

    def __init__(self, error: str, given: list | None = None):
        super().__init__(error)
        self.error, self.given = error, given or []


def identity() -> Scan:
    return Scan([])


def map_(f: Callable[[Column], Column]) -> Scan:
    return Scan([("map", f)])


def const(value: Column) -> Scan:
    """The same value for each that comes."""
    return map_(lambda _: value)


def void() -> Scan:
    return const(F.lit(None).cast("void"))


def filter_(p: Callable[[Column], Column]) -> Scan:
    return Scan([("filter", p)])


def lift_opt(f: Callable[[Column], Column]) -> Scan:
    """f of each value, where it isn't null."""
    return map_(f) >> filter_(lambda v: v.isNotNull())


def lift_chunk(size: int, f: Callable[[Column], Column]) -> Scan:
    """f of arrays of `size` neighbouring values (the last may be shorter), an array, whose elements go on."""
    return Scan([("batches", size, f)])


def stateful(initial: object, step: Callable[[object, object], tuple[object, list]], finish: Callable[[object], list], kind: str) -> Scan:
    """A state of one's own: step gives the next state and values for each that comes, finish those at the end.
    kind: of the values given. Values of one stream come to one task in order, and aren't held there. Either may
    raise Failed: what was given before goes on, the stream fails, and what comes after it isn't read."""
    return Scan([("stateful", initial, step, finish, kind)])


def first_of() -> Scan:
    return map_(lambda v: v["first"])


def second_of() -> Scan:
    return map_(lambda v: v["second"])


def swap() -> Scan:
    return map_(lambda v: F.struct(v["second"].alias("first"), v["first"].alias("second")))


def diag() -> Scan:
    return map_(lambda v: F.struct(v.alias("first"), v.alias("second")))


def keep_first(other: Scan) -> Scan:
    """Each value as it came, as often as `other` gives one beside it."""
    return (identity() & other) >> first_of()


def keep_second(other: Scan) -> Scan:
    return (identity() & other) >> second_of()


def drain_left() -> Scan:
    """Of tagged values those on the right."""
    return filter_(lambda v: v["tag"] == "right") >> map_(lambda v: v["right"])


def inject_left(other: str = "void") -> Scan:
    """Values tagged left; other: the kind of the values on the right."""
    return map_(lambda v: F.struct(F.lit("left").alias("tag"), v.alias("left"), F.lit(None).cast(other).alias("right")))


def inject_right(other: str = "void") -> Scan:
    return map_(lambda v: F.struct(F.lit("right").alias("tag"), F.lit(None).cast(other).alias("left"), v.alias("right")))


def merge() -> Scan:
    """Tagged values of one kind without their tag."""
    return map_(lambda v: F.when(v["tag"] == "left", v["left"]).otherwise(v["right"]))


def mirror() -> Scan:
    return map_(lambda v: F.struct(F.when(v["tag"] == "left", "right").otherwise("left").alias("tag"), v["right"].alias("left"), v["left"].alias("right")))


def test(p: Callable[[Column], Column]) -> Scan:
    """Values tagged left if p holds, else right."""
    return map_(lambda v: F.struct(F.when(p(v), "left").otherwise("right").alias("tag"), F.when(p(v), v).alias("left"), F.when(~F.coalesce(p(v), F.lit(False)), v).alias("right")))


def left(scan: Scan, other: str) -> Scan:
    """Tagged values: those on the left through the scan, the others as they are, all tagged again."""
    return (scan >> inject_left(other)) | inject_right(other)


def right(scan: Scan, other: str) -> Scan:
    return inject_left(other) | (scan >> inject_right(other))


def take(n: int) -> Scan:
    """The first n values, then stop; for n <= 0 none, and stop at the first."""
    return Scan([("take", n)])


def head() -> Scan:
    return take(1)


def drop(n: int) -> Scan:
    return Scan([("drop", n)])


def fold(zero: Column, step: Callable[[Column, Column], Column]) -> Scan:
    """One value, left at the end: the values folded from the left, in order."""
    return Scan([("fold", zero, step)])


def fold_by(lift: Callable[[Column], dict[str, Column]], merge: Callable[[dict, dict], dict], unit: dict[str, object], finish: Callable[[Column], Column]) -> Scan:
    """One value, left at the end: the values, lifted to summaries of named fields, merged in order. merge takes an
    earlier and a later summary, each a dict of NumPy arrays of one length, and must be associative; unit is what
    an empty stream gives; finish makes the value of a summary (a struct). Parts of a stream are merged where
    they lie, so that no stream is gathered."""
    return Scan([("merge", lift, merge, unit, finish)])


def affine(factor: Column, modulus: int, zero: int = 0) -> Scan:
    """acc = (acc * factor + value) mod modulus from zero on: a fold of affine maps, which can be merged.
    The modulus must be less than 2**31."""
    if not 0 < modulus < 1 << 31:
        raise ValueError("the modulus must be positive and less than 2**31")

    def merge(a: dict, b: dict) -> dict:
        return {"times": a["times"] * b["times"] % modulus, "plus": (a["plus"] * b["times"] + b["plus"]) % modulus}

    def lift(v: Column) -> dict[str, Column]:
        return {"times": F.pmod(factor.cast("long"), F.lit(modulus)), "plus": F.pmod(v.cast("long"), F.lit(modulus))}

    return fold_by(lift, merge, {"times": 1, "plus": 0}, lambda x: F.pmod(x["times"] * F.lit(zero % modulus).cast("long") + x["plus"], F.lit(modulus)))


def total(zero: Column | None = None) -> Scan:
    """The sum of the values: a fold that needs no order, and so no list of them."""
    return Scan([("aggregate", F.sum, F.lit(0) if zero is None else zero)])


def hash_(algorithm: str) -> Scan:
    """The hexadecimal digest of the values, taken as bytes one after the other. BLAKE3 has no digest here
    and gives SHA-256, as its name in lower case with a question mark would say."""
    return Scan([("hash", algorithm)])


def count_bytes() -> Scan:
    """The number of bytes, as eight bytes, the highest first."""
    return Scan([("count",)])


def bomb_guard(most: int) -> Scan:
    """Bytes up to `most`; a byte more is a failure."""
    return Scan([("bomb", most)])


def fixed_chunk(size: int) -> Scan:
    """Chunks of `size` bytes; a shorter one is left at the end."""
    if size <= 0:
        raise ValueError("size must be positive")
    return Scan([("chunk", size)])


def fast_cdc(least: int, average: int, most: int) -> Scan:
    return Scan([("cdc", least, average, most)])


def concat(*streams: DataFrame) -> DataFrame:
    """Streams one after the other: the positions of each follow those of the one before, by stream_id."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("__part", F.lit(k)) for k, s in enumerate(streams)])
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("__part", "pos"))
    return rows.select("stream_id", (number - 1).cast("long").alias("pos"), "value")


def _algorithm(name: str) -> str:
    a = name.lower().replace("-", "")
    return a if a in ("md5", "sha1", "sha512") else "sha256"


def digest(column: str | Column, algorithm: str) -> Column:
    a = _algorithm(algorithm)
    c = F.col(column) if isinstance(column, str) else column
    return F.md5(c) if a == "md5" else F.sha1(c) if a == "sha1" else F.sha2(c, 512) if a == "sha512" else F.sha2(c, 256)


# ---- compilation: each step gets the stream and the ids of all streams that came in ---------------


def _left(rows: DataFrame, run: _Run, value: str, zero: Column) -> DataFrame:
    """One value a stream: that of rows, or zero where an earlier step has emptied it."""
    kind = rows.schema[value].dataType
    return _beside(run.ids, rows.select("stream_id", value, F.lit(True).alias("__met"))).select("stream_id", F.lit(LAST).alias("pos"), F.when(F.col("__met"), F.col(value)).otherwise(zero.cast(kind)).alias("value"))


def _batches(stream: DataFrame, run: _Run, size: int, f: Callable[[Column], Column]) -> _Made:
    rows, number = run.before(stream, F.lit(1))
    rows = rows.withColumn("__batch", F.floor(number / size))
    parts = rows.groupBy("stream_id", "__batch").agg(F.min("pos").alias("pos"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("value"))
    given = parts.select("stream_id", F.col("__batch").alias("pos"), f(F.col("value")).alias("value"))
    rows, number = run.before(given, F.size("value"))
    out = rows.select("stream_id", number.alias("__before"), F.posexplode("value").alias("__place", "value"))
    return _Made(out.select("stream_id", (F.col("__before") + F.col("__place")).alias("pos"), "value"))


def _stateful(stream: DataFrame, run: _Run, initial: object, step: Callable, finish: Callable, kind: str) -> _Made:
    value = T._parse_datatype_string(kind)
    schema = T.StructType([stream.schema["stream_id"], T.StructField("pos", T.LongType()), T.StructField("value", value), T.StructField("error", T.StringType())])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids, places, values, errors = [], [], [], []
        current, state, failed = None, None, False
        for batch in batches:
            for i, pos, end, v in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "pos", "__end", "value")), strict=True):
                if current != (i,):
                    current, state, failed = (i,), initial, False
                if failed:
                    continue
                error = None
                try:
                    if end:
                        given = finish(state)
                    else:
                        state, given = step(state, v)
                except Failed as e:
                    given, error, failed = e.given, e.error, True
                rows = [(x, None) for x in given] + ([(None, error)] if failed else [])
                ids += [i] * len(rows)
                places += [pos] * len(rows)
                values += [x for x, _ in rows]
                errors += [e for _, e in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("stream_id").type), pa.array(places, pa.int64()), pa.array(values, to_arrow_type(value)), pa.array(errors, pa.string())], schema.names)
            ids, places, values, errors = [], [], [], []

    ends = run.ids.select("stream_id", F.lit(LAST).alias("pos"), F.lit(None).cast(stream.schema["value"].dataType).alias("value"), F.lit(True).alias("__end"))
    rows = stream.withColumn("pos", F.col("pos").cast("long")).withColumn("__end", F.lit(False)).unionByName(ends)
    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", "pos", "__end")
    made = ordered.select("stream_id", "pos", "__end", "value").mapInArrow(stepped, schema)
    failures = made.where("error is not null").select("stream_id", F.col("pos").alias("at"), F.lit("failure").alias("status"), "error")
    return _Made(made.where("error is null").drop("error"), signals=failures)


def _nothing(stream: DataFrame, kind: T.DataType) -> DataFrame:
    return stream.where("false").select("stream_id", F.col("pos").cast("long").alias("pos"), F.lit(None).cast(kind).alias("value"))


def _only(rows: DataFrame) -> _Made:
    return _Made(_nothing(rows, rows.schema["value"].dataType), rows)


def _fold(stream: DataFrame, run: _Run, zero: Column, step: Callable[[Column, Column], Column]) -> _Made:
    parts = stream.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("parts"))
    return _only(_left(parts.select("stream_id", F.aggregate("parts", zero, lambda a, x: step(a, x["value"])).alias("x")), run, "x", zero))


def merged_runs(columns: dict[str, np.ndarray], lengths: np.ndarray, merge: Callable[[dict, dict], dict]) -> dict[str, np.ndarray]:
    """A summary for each run, neighbours merged pair by pair in all runs at once."""
    while len(lengths) and lengths.max() > 1:
        starts = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        even = np.flatnonzero(place % 2 == 0)
        paired = place[even] + 1 < np.repeat(lengths, (lengths + 1) // 2)
        first, second = even[paired], even[paired] + 1
        both = merge({k: v[first] for k, v in columns.items()}, {k: v[second] for k, v in columns.items()})
        columns = {k: v[even].copy() for k, v in columns.items()}
        for k, v in both.items():
            columns[k][paired] = v
        lengths = (lengths + 1) // 2
    return columns


def _merge(stream: DataFrame, run: _Run, lift: Callable, merge: Callable, unit: dict, finish: Callable) -> _Made:
    """Ranges of (stream, pos) are merged each on its own, then the summaries of a stream, in order of the ranges."""
    names = list(unit)
    lifted = stream.select("stream_id", F.col("pos").cast("long").alias("pos"), *[c.alias(f"__{k}") for k, c in lift(F.col("value")).items()])
    schema = T.StructType([lifted.schema["stream_id"], T.StructField("pos", T.LongType()), *lifted.schema.fields[2:]])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held, kinds = TaskContext.get().partitionId(), None, None, None

        def given(ids: pa.Array, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), part), pa.int64()), *[pa.array(sums[k], t) for k, t in zip(names, kinds[1], strict=True)]], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("stream_id")
            kinds = ids.type, [batch.column(f"__{k}").type for k in names]
            starts = prefix.starts_of_runs(ids)
            lengths = np.diff(np.append(starts, batch.num_rows))
            sums = merged_runs({k: batch.column(f"__{k}").to_numpy(zero_copy_only=False) for k in names}, lengths, merge)
            if key == (ids[0].as_py(),):
                joined = merge(held, {k: v[:1] for k, v in sums.items()})
                for k in names:
                    sums[k][:1] = joined[k]
            elif key is not None:
                yield given(pa.array(list(key), kinds[0]), held)
            if len(starts) > 1:
                yield given(ids.take(pa.array(starts[:-1])), {k: v[:-1] for k, v in sums.items()})
            key, held = (ids[batch.num_rows - 1].as_py(),), {k: v[-1:] for k, v in sums.items()}
        if key is not None:
            yield given(pa.array(list(key), kinds[0]), held)

    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = lifted.repartitionByRange(parts, "stream_id", "pos").sortWithinPartitions("stream_id", "pos").mapInArrow(local, schema)
    whole = summed.repartition("stream_id").sortWithinPartitions("stream_id", "pos").mapInArrow(local, schema)
    value = F.struct(*[F.col(f"__{k}").alias(k) for k in names])
    zero = F.struct(*[F.lit(v).cast(lifted.schema[f"__{k}"].dataType).alias(k) for k, v in unit.items()])
    return _only(_left(whole.select("stream_id", finish(value).alias("x")), run, "x", finish(zero)))


def _aggregate(stream: DataFrame, run: _Run, f: Callable[[str], Column], zero: Column) -> _Made:
    return _only(_left(stream.groupBy("stream_id").agg(f("value").alias("x")), run, "x", zero))


def _hash(stream: DataFrame, run: _Run, algorithm: str) -> _Made:
    """The values of a stream go through its digest in order, one by one."""
    kind = _algorithm(algorithm)
    rows = stream.select("stream_id", "pos", F.col("value").cast("binary").alias("value"))
    longest = rows.groupBy("stream_id").agg(F.sum(F.octet_length("value").cast("long")).alias("n")).agg(F.max("n")).head()[0] if run.long else 0
    if (longest or 0) > SPAN and digests.handed_on(kind):
        made = _hash_by_spans(rows, kind)
    else:
        made = _digested(rows.withColumn("__begun", F.lit(True)), kind).drop("state")
    return _only(_left(made, run, "x", digest(F.lit(b""), algorithm)))


def _digested(rows: DataFrame, kind: str, handed: bool = False) -> DataFrame:
    """(stream_id, x, state): each stream's digest and, where it is to be handed on, the state it ends in. rows:
    (stream_id, pos, value, __begun); where __begun is false, value is the state to begin with."""
    schema = T.StructType([rows.schema["stream_id"], T.StructField("x", T.StringType()), T.StructField("state", T.BinaryType())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(ended: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            made = [(s.hexdigest(), s.state() if handed else None) for _, s in ended]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in ended], of), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.binary())], schema.names)

        begin = digests.Digest if handed else hashlib.new
        key, state, of = None, None, pa.null()
        for batch in batches:
            ended, of = [], batch.column("stream_id").type
            for i, begun, v in zip(batch.column("stream_id").to_pylist(), batch.column("__begun").to_pylist(), batch.column("value"), strict=True):
                if key != (i,):
                    if key is not None:
                        ended.append((key[0], state))
                    key, state = (i,), begin(kind) if begun else begin(kind, v.as_py())
                if begun and v.is_valid:
                    state.update(v.as_buffer())
            yield given(ended, of)
        if key is not None:
            yield given([(key[0], state)], of)

    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", "__begun", "pos")
    return ordered.select("stream_id", "value", "__begun").mapInArrow(digested, schema)


def _hash_by_spans(rows: DataFrame, kind: str) -> DataFrame:
    """(stream_id, x): digests of streams that are longer than a task. A digest can't be put together from those of
    parts, but its state can be handed on: streams are stored by spans of SPAN bytes, and the first spans of all streams
    are digested, then the second ones from the states that those ended in, and so on. A stream's spans follow each
    other; no task reads more of a stream than one of them."""
    spark = rows.sparkSession
    lengths = prefix.running(rows.select("stream_id", "pos", F.octet_length("value").alias("n")), "stream_id", ["pos"], {"at": F.col("n")})
    later = lengths.groupBy("stream_id", F.floor(F.col("at") / SPAN).alias("span")).agg(F.min("pos").alias("first")).where("span > 0")
    # for streams of several spans, where those begin
    firsts = prefix.cut(later.groupBy("stream_id").agg(F.sort_array(F.collect_list("first")).alias("firsts")))
    last = firsts.agg(F.max(F.size("firsts"))).head()[0] or 0
    with prefix.folder(spark) as path:
        spans = _beside(rows, F.broadcast(firsts)).withColumn("span", F.coalesce(F.size(F.filter("firsts", lambda x: x <= F.col("pos"))), F.lit(0)))
        spans.drop("firsts").write.partitionBy("span").parquet(f"{path}/values")
        for k in range(last + 1):
            span = spark.read.schema(rows.schema).parquet(f"{path}/values/span={k}").withColumn("__begun", F.lit(True))
            if k:
                states = spark.read.schema(made.schema).parquet(f"{path}/states/span={k - 1}")
                go_on = _beside(states, F.broadcast(firsts.where(F.size("firsts") >= k)), "inner")
                span = span.unionByName(go_on.select("stream_id", F.lit(None).cast(rows.schema["pos"].dataType).alias("pos"), F.col("state").alias("value"), F.lit(False).alias("__begun")))
            made = _digested(span, kind, handed=True)
            made.write.parquet(f"{path}/states/span={k}")
        ends = spark.read.schema(T.StructType([*made.schema.fields, T.StructField("span", T.IntegerType())])).parquet(f"{path}/states")
        return prefix.cut(ends.groupBy("stream_id").agg(F.max_by("x", "span").alias("x")))


def _count(stream: DataFrame, run: _Run) -> _Made:
    n = F.unhex(F.lpad(F.hex(F.sum(F.octet_length("value"))), 16, "0"))
    return _only(_left(stream.groupBy("stream_id").agg(n.alias("x")), run, "x", F.lit(bytes(8))))


def _chunk(stream: DataFrame, run: _Run, size: int) -> _Made:
    """Each value is cut where chunks end, and the pieces of a chunk, which are no more than `size` bytes, are joined."""
    rows, before = run.before(stream, F.octet_length("value"))
    rows = rows.where(F.octet_length("value") > 0).withColumn("__at", before)
    end = F.col("__at") + F.octet_length("value")
    cells = F.sequence(F.floor(F.col("__at") / size), F.floor((end - 1) / size))
    rows = rows.select("stream_id", "__at", "value", F.explode(cells).alias("pos"))
    begin = F.greatest(F.col("pos") * size - F.col("__at"), F.lit(0))
    piece = F.substring(F.col("value"), begin.cast("int") + 1, ((F.col("pos") + 1) * size - F.col("__at") - begin).cast("int"))
    parts = rows.select("stream_id", "pos", F.struct("__at", piece.alias("piece")).alias("x")).groupBy("stream_id", "pos").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    whole = F.when(F.size("xs") == 1, F.col("xs")[0]["piece"]).otherwise(F.unhex(F.array_join(F.transform("xs", lambda x: F.hex(x["piece"])), "")))
    chunks = parts.select("stream_id", "pos", whole.alias("value"))
    return _Made(chunks.where(F.octet_length("value") == size), chunks.where(F.octet_length("value") < size))


def _joined(stream: DataFrame) -> DataFrame:
    """(stream_id, bytes): the values of a stream, which are bytes, one after the other."""
    parts = stream.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("parts"))
    return parts.select("stream_id", F.array_join(F.transform("parts", lambda x: F.hex(x["value"])), "").alias("hex")).select("stream_id", F.unhex("hex").alias("bytes"))


def _cdc(stream: DataFrame, run: _Run, least: int, average: int, most: int) -> _Made:
    from foliant.operators.chunking import chunks_df
    from foliant.plans import cutting

    if run.long:
        rows, before = run.before(stream, F.octet_length("value"))
        cut = cutting.cut_streams(rows.select("stream_id", before.alias("at"), "value"), least, average, most)
        rows, number = run.before(cut.withColumnRenamed("off", "pos"), F.lit(1))
        return _Made(rows.select("stream_id", number.alias("pos"), "value"))
    rows = chunks_df(_joined(stream).select(F.col("stream_id").alias("file_id"), F.col("bytes").alias("content")), least, average, most, with_bytes=True)
    return _Made(rows.select(F.col("file_id").alias("stream_id"), F.col("chunk_no").cast("long").alias("pos"), F.col("bytes").alias("value")))


def _fanout(stream: DataFrame, run: _Run, one: Scan, other: Scan) -> _Made:
    a, b = one.made(stream, run), other.made(stream, run)

    def numbered(made: _Made, name: str) -> DataFrame:
        rows, number = run.before(made.emitted, F.lit(1))
        return rows.select("stream_id", number.alias("pos"), F.col("value").alias(name))

    out = _beside(numbered(a, "first"), numbered(b, "second"), "inner", "pos").select("stream_id", "pos", F.struct("first", "second").alias("value"))
    return _Made(out, signals=_unite([a.signals, b.signals]))


def _choice(stream: DataFrame, run: _Run, one: Scan, other: Scan) -> _Made:
    """An arm's signal ends both: what comes behind its position is read by neither. Positions of arms are those
    of the stream as long as no step in them numbers anew."""

    def arms(rows: DataFrame) -> tuple[_Made, _Made]:
        return tuple(s.made(rows.where(F.col("value")["tag"] == tag).withColumn("value", F.col("value")[tag]), run) for s, tag in ((one, "left"), (other, "right")))

    a, b = arms(stream)
    signals = _unite([a.signals, b.signals])
    if signals is not None:
        ends = signals.groupBy("stream_id").agg(F.min("at").alias("__at"))
        a, b = arms(_beside(stream, ends).where(F.col("__at").isNull() | (F.col("pos") <= F.col("__at"))).drop("__at"))
        first = _beside(signals, ends, "inner").where("at = __at").drop("__at")
        signals = first
    return _Made(a.emitted.unionByName(b.emitted), _unite([a.left, b.left]), signals)


_COMPILE = {"batches": _batches, "stateful": _stateful, "fold": _fold, "merge": _merge, "aggregate": _aggregate, "hash": _hash, "count": _count, "chunk": _chunk, "cdc": _cdc, "fanout": _fanout, "choice": _choice}


def flow(stream: DataFrame, **named: Column | Scan) -> DataFrame:
    """Several results over one stream: a row for each stream_id with an aggregate, or what a scan leaves at its
    end, under each name. Scans that end in a sum or count share one reading, and what they begin with in
    common is made once; the others are joined."""
    frame, lane = lanes.Frame(stream), None
    out: dict[str, Column] = {}
    for name, scan in named.items():
        if not isinstance(scan, Scan):
            out[name] = scan
        elif lanes.fits(scan.steps) and lanes.folds(scan.steps):
            lane = lane or frame.lane()
            out[name] = lanes.folded(lanes.through(frame, lane, scan.steps[:-1]), scan.steps[-1])
    made = frame.rows.groupBy("stream_id").agg(*[c.alias(k) for k, c in out.items()] or [F.lit(1).alias("__one")])
    ids = stream.select("stream_id").distinct()
    for name, scan in named.items():
        if name not in out:
            rest = scan.made(stream, _Run(ids))
            made = _beside(made, (rest.emitted if rest.left is None else rest.left).select("stream_id", F.col("value").alias(name)))
    return made.select("stream_id", *named)
