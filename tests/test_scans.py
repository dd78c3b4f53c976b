"""Scans in batch, over long streams and over streams with state: all against one plain reading of the algebra."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import fastcdc
from foliant.plans import cutting, prefix, scan
from foliant.streaming import scans as stream_scans
from foliant.streaming import sinks

ROWS = "stream_id long, pos long, value binary, last boolean"


def streams(seed, n=12, longest=14):
    rng = random.Random(seed)
    out = {i: [bytes([65 + rng.randrange(4)]) * rng.randrange(7) for _ in range(rng.randrange(1, longest))] for i in range(n)}
    out[None] = [b"of", b"none"]
    return out


def rows_of(held, seed=0):
    rows = [(i, p, v, p == len(vs) - 1) for i, vs in held.items() for p, v in enumerate(vs)]
    random.Random(seed).shuffle(rows)
    return rows


def outputs(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["stream_id"] is None, r["stream_id"] or 0, r["pos"])):
        out[r["stream_id"]].append(bytes(r["value"]) if isinstance(r["value"], (bytes, bytearray)) else r["value"])
    return dict(out)


def statuses(df):
    return {r["stream_id"]: (r["status"], r["error"]) for r in df.collect()}


# Plain steps: each a function from (values, ended) to (values out with the place of what made each, signal place, signal).


class Plain:
    """One step at a time over a whole stream, value by value, as the algebra says."""

    def __init__(self, *steps):
        self.steps = steps

    def run(self, values):
        states = [dict(n=0, held=b"") for _ in self.steps]

        def one(k, v):
            name, arg = self.steps[k]
            s = states[k]
            if name == "double":
                return [v + v], None
            if name == "long_only":
                return ([v] if len(v) > arg else []), None
            if name == "take":
                s["n"] += 1
                return ([v] if s["n"] <= arg else []), ("stop", None) if s["n"] >= arg else None
            if name == "drop":
                s["n"] += 1
                return ([v] if s["n"] > arg else []), None
            if name == "bomb":
                room = arg - s["n"]
                s["n"] += len(v)
                return ([v[:room]] if room > 0 else []), ("failure", f"BombError({arg + 1},{arg})") if len(v) > room else None
            s["held"] += v
            whole = [s["held"][i : i + arg] for i in range(0, len(s["held"]) - len(s["held"]) % arg, arg)]
            s["held"] = s["held"][len(s["held"]) - len(s["held"]) % arg :]
            return whole, None

        def feed(k, values):
            if k == len(self.steps):
                return list(values), None
            out = []
            for v in values:
                given, signal = one(k, v)
                more, ended = feed(k + 1, given)
                out += more
                if ended:
                    return out, ended
                if signal:
                    more, ended = end(k + 1)
                    return out + more, ended if ended and ended[0] == "failure" and signal[0] == "stop" else signal
            return out, None

        def end(k):
            if k == len(self.steps):
                return [], None
            left = [states[k]["held"]] if self.steps[k][0] == "chunk" and states[k]["held"] else []
            out, ended = feed(k + 1, left)
            if ended:
                return out, ended
            more, ended = end(k + 1)
            return out + more, ended

        out, signal = feed(0, values)
        if not signal:
            more, signal = end(0)
            out += more
        return out, signal or ("success", None)


MAKE = {"double": lambda _: scan.map_(lambda v: F.concat(v, v)), "long_only": lambda n: scan.filter_(lambda v: F.octet_length(v) > n), "take": scan.take, "drop": scan.drop, "bomb": scan.bomb_guard, "chunk": scan.fixed_chunk}
PLANS = [
    [("take", 3)],
    [("take", 0)],
    [("drop", 2), ("take", 2), ("double", 0)],
    [("bomb", 9), ("long_only", 2), ("take", 2)],
    [("long_only", 1), ("drop", 1), ("bomb", 12), ("take", 3)],
    [("take", 3), ("bomb", 8)],
    [("double", 0), ("bomb", 15), ("chunk", 4)],
    [("chunk", 5), ("take", 2), ("drop", 1)],
    [("take", 4), ("take", 2), ("bomb", 100)],
]


def composed(plan):
    whole = scan.identity()
    for name, arg in plan:
        whole = whole >> MAKE[name](arg)
    return whole


@pytest.mark.parametrize("plan", PLANS, ids=lambda p: "-".join(f"{n}{a}" for n, a in p))
@pytest.mark.parametrize("long", [False, True])
def test_batch_scans_follow_the_algebra(spark, plan, long):
    held = streams(len(plan))
    df = spark.createDataFrame(rows_of(held), ROWS).drop("last")
    want = {i: Plain(*plan).run(vs) for i, vs in held.items()}
    r = composed(plan).run(df, long=long)
    assert outputs(r.outputs) == {i: out for i, (out, _) in want.items() if out}
    assert statuses(r.status) == {i: signal for i, (_, signal) in want.items()}


def test_streams_with_state_follow_the_algebra(spark, tmp_path):
    """Rows in any order and cutting, several operators in a row."""
    held = streams(5)
    rows = rows_of(held, 3)
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for n, plan in enumerate((PLANS[3], PLANS[6], PLANS[7])):
        source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        got = sinks.drained(stream_scans.run_stream(source, composed(plan)), f"{tmp_path}/out{n}")
        want = {i: Plain(*plan).run(vs) for i, vs in held.items()}
        assert outputs(got.where("status is null")) == {i: out for i, (out, _) in want.items() if out}
        assert statuses(got.where("status is not null")) == {i: signal for i, (_, signal) in want.items()}


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    """Stopped in the midst of its streams and started again from its checkpoint."""
    held = streams(6)
    rows = sorted(rows_of(held), key=lambda r: -r[1])  # last positions come first
    plan, out = composed([("bomb", 14), ("chunk", 3)]), f"{tmp_path}/out"
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        got = sinks.drained(stream_scans.run_stream(source, plan), out)
    want = {i: Plain(("bomb", 14), ("chunk", 3)).run(vs) for i, vs in held.items()}
    assert outputs(got.where("status is null")) == {i: o for i, (o, _) in want.items() if o}
    assert statuses(got.where("status is not null")) == {i: s for i, (_, s) in want.items()}


def test_streams_that_never_end_are_ended_by_time(spark, tmp_path):
    rows = [(1, 0, b"abc", False), (1, 1, b"de", False), (2, 1, b"late", True)]  # 2 never gets its first row
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    made = stream_scans.run_stream(source, scan.fixed_chunk(4), timeout=1)
    query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    got = spark.createDataFrame([], made.schema)
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if any(p.suffix == ".parquet" for p in (tmp_path / "out").glob("*")):
                got = spark.read.schema(made.schema).parquet(f"{tmp_path}/out")
                if got.where("status is not null").count() == 2:
                    break
    finally:
        query.stop()
    assert outputs(got.where("status is null")) == {1: [b"abcd", b"e"]}
    assert statuses(got.where("status is not null")) == {1: ("success", None), 2: ("failure", "MissingError(0)")}


def test_a_failing_step_gives_what_it_had(spark):
    def step(state, v):
        if v == b"C":
            raise scan.Failed("C met", [b"last"])
        return state + 1, [v]

    own = scan.stateful(0, step, lambda n: [str(n).encode()], "binary")
    held = {1: [b"A", b"B", b"C", b"A"], 2: [b"A"]}
    df = spark.createDataFrame(rows_of(held), ROWS)
    r = own.run(df.drop("last"))
    want = {1: [b"A", b"B", b"last"], 2: [b"A", b"1"]}
    assert outputs(r.outputs) == want
    assert statuses(r.status) == {1: ("failure", "C met"), 2: ("success", None)}
    states = [0]
    assert stream_scans.push([stream_scans.Own(0, step, lambda n: [])], states, held[1]) == ([b"A", b"B", b"last"], ("failure", "C met"))


def test_what_is_raised_first_ends_a_stream(spark):
    """And at one position the step further to the right."""
    df = spark.createDataFrame([(1, k, b"xx", k == 4) for k in range(5)], ROWS).drop("last")
    assert statuses((scan.bomb_guard(5) >> scan.take(2)).run(df).status) == {1: ("stop", None)}
    assert statuses((scan.bomb_guard(3) >> scan.take(2)).run(df).status) == {1: ("stop", None)}  # both at the second
    assert statuses((scan.bomb_guard(3) >> scan.take(3)).run(df).status) == {1: ("failure", "BombError(4,3)")}


def test_values_that_are_gone_are_not_computed(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 5)], "stream_id long, pos long, value long")
    plan = scan.filter_(lambda v: v != 0) >> scan.map_(lambda v: F.lit(100) / v)
    assert outputs(plan.run(df).outputs) == {1: [20.0]}


def scans_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_branches_read_the_stream_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 as stream_id", "id as pos", "id as value").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    nested = scan.test(lambda v: v % 2 == 0) >> (scan.take(2) | (scan.test(lambda v: v % 3 == 0) >> (scan.drop(1) | scan.take(3))))
    assert scans_of(nested.run(df).both) == 1
    common = scan.filter_(lambda v: v % 2 == 0) >> scan.drop(1)
    made = scan.flow(df, n=F.count(F.lit(1)), a=common >> scan.total(), b=common >> scan.map_(lambda v: v * 10) >> scan.total(), c=common >> scan.take(2) >> scan.total())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert scans_of(made) == 1 and plan.count("Window [") == 2  # the numbers behind drop and take, each once
    for r in made.collect():
        values = [v for v in range(100) if v % 7 == r["stream_id"]]
        even = [v for v in values if v % 2 == 0][1:]
        assert (r["n"], r["a"], r["b"], r["c"]) == (len(values), sum(even), 10 * sum(even), sum(even[:2]))


def test_a_long_stream_is_spread_over_tasks(spark):
    rows = spark.range(200_000).selectExpr("cast(1 as long) as stream_id", "id as pos", "id % 10 as value")
    made = prefix.running(rows, "stream_id", ["pos"], {"n": F.lit(1), "s": F.col("value")}, parts=8)
    assert made.where("n <> pos or s <> (pos div 10) * 45 + (pos % 10) * (pos % 10 - 1) div 2").count() == 0
    sizes = sorted(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]


@pytest.mark.parametrize("n, key", [(5000, "id div 900"), (5000, "id % 3"), (300, "id"), (0, "id"), (4000, "if(id < 2000, null, 1)"), (1000, "cast(id div 400 as string)")])
def test_running_sums(spark, n, key):
    rows = spark.range(n).selectExpr(f"{key} as g", "id as pos", "if(id % 5 = 0, null, id * 7 % 13) as v", "cast(id as string) as t")
    got = prefix.running(rows, "g", ["pos"], {"rn": F.lit(1), "before": F.col("v")}, parts=7)
    held, want = defaultdict(lambda: [0, 0]), {}
    for r in rows.orderBy("pos").collect():
        want[r["pos"]] = tuple(held[r["g"]])
        held[r["g"]] = [held[r["g"]][0] + 1, held[r["g"]][1] + (r["v"] or 0)]
    assert {r["pos"]: (r["rn"], r["before"]) for r in got.collect()} == want
    assert got.columns == ["g", "pos", "v", "t", "rn", "before"]


def test_folds_that_merge(spark):
    """A merge that doesn't commute, over streams that lie across partitions."""
    rng = random.Random(2)
    held = {i: [rng.randrange(1000) for _ in range(rng.choice([1, 2, 3000]))] for i in range(8)}
    df = spark.createDataFrame([(i, p, v) for i, vs in held.items() for p, v in enumerate(vs)], "stream_id long, pos long, value long").repartition(5)
    want = {}
    for i, vs in held.items():
        a = 7
        for v in vs:
            a = (a * 31 + v) % 1000003
        want[i] = [a]
    assert outputs(scan.affine(F.lit(31), 1000003, zero=7).run(df).outputs) == want
    first_last = scan.fold_by(lambda v: {"first": v, "last": v, "n": F.lit(1).cast("long")}, lambda a, b: {"first": a["first"], "last": b["last"], "n": a["n"] + b["n"]}, {"first": -1, "last": -1, "n": 0}, lambda x: x["first"] * 10_000_000 + x["last"] * 10_000 + x["n"])
    assert outputs(first_last.run(df).outputs) == {i: [vs[0] * 10_000_000 + vs[-1] * 10_000 + len(vs)] for i, vs in held.items()}
    emptied = scan.filter_(lambda v: v > 10_000) >> scan.affine(F.lit(31), 1000003, zero=7)
    assert outputs(emptied.run(df).outputs) == {i: [7] for i in held}


def test_sinks_count_each_row_once(spark, tmp_path):
    """A batch that runs again replaces what it had written."""
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path, seen = f"{tmp_path}/out", []

    def source():
        return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def then(batch, number):
        seen.append((number, batch.count()))
        if number == 1 and len(seen) == 2:
            raise RuntimeError("lost")

    counts = {"n": F.count(F.lit(1)), "s": F.sum("id")}
    with pytest.raises(Exception, match="lost"):
        sinks.counted_sink(source(), path, counts, then).awaitTermination()
    sinks.counted_sink(source(), path, counts, then).awaitTermination()
    assert seen == [(0, 10), (1, 10), (1, 10), (2, 10)]
    assert sinks.taken(spark, path, "id long, batch long").agg(F.count("*"), F.sum("id")).head()[:] == (30, 435)
    assert sinks.counted(spark, path).agg(F.sum("n"), F.sum("s")).head()[:] == (30, 435)


def test_long_streams_are_cut_as_short_ones(spark, monkeypatch):
    """Blocks much smaller than a stream, bytes without any place to cut included."""
    monkeypatch.setattr(cutting, "BLOCK", 3000)
    monkeypatch.setattr(cutting, "FAN", 3)
    rng = random.Random(4)
    held = {1: rng.randbytes(60_000), 2: bytes(20_000), 3: b"ab" * 20_000 + rng.randbytes(3001), 4: b"x", None: rng.randbytes(2999), 5: b"", 6: rng.randbytes(9000)}
    rows = []
    for i, b in held.items():
        at = p = 0
        while at < len(b) or p == 0:
            n = rng.choice([1, 10, 500, 5000])
            rows.append((i, p, b[at : at + n]))
            at, p = at + n, p + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id long, pos long, value binary")
    r = scan.fast_cdc(64, 256, 1024).run(df, long=True)
    want = {}
    for i, b in held.items():
        ends = fastcdc.cuts(b, 64, 256, 1024)
        want |= {i: [b[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]} if ends else {}
    assert outputs(r.outputs) == want
    assert r.outputs.where("octet_length(value) > 1024").count() == 0


@pytest.mark.parametrize("name", ["SHA-256", "SHA-512", "SHA-1", "MD5"])
def test_digests_of_long_streams_go_from_task_to_task(spark, monkeypatch, name):
    """Streams of many spans and of one, a value longer than spans, empty and null values: no task reads more of a stream
    than a span, its last value and a state; nothing is left in the shared folder."""
    monkeypatch.setattr(scan, "SPAN", 1000, raising=False)
    rng = random.Random(7)
    held = {1: [rng.randbytes(rng.randrange(300)) for _ in range(60)], 2: [b"x"], 3: [], None: [rng.randbytes(150) for _ in range(30)], 5: [b"a", rng.randbytes(5000), b"", None, b"b"], 6: [None], 7: [bytes(1000), b"c"]}
    rows = [(i, p, v) for i, vs in held.items() for p, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id long, pos long, value binary")
    read, digested = [], scan._digested

    def spied(rows, kind, handed=False):
        read.append(max(r["n"] or 0 for r in rows.groupBy("stream_id").agg(F.sum(F.octet_length("value")).alias("n")).collect()))
        return digested(rows, kind, handed)

    monkeypatch.setattr(scan, "_digested", spied)
    got = scan.hash_(name).run(df, long=True).outputs
    want = {i: [hashlib.new(name.lower().replace("-", ""), b"".join(v or b"" for v in vs)).hexdigest()] for i, vs in held.items() if vs}
    assert outputs(got) == want == outputs(scan.hash_(name).run(df).outputs)
    assert len(read) > 5 and max(read[:-1]) <= 1000 + 5000 + 216 and sorted(read[:-1])[-2] <= 1000 + 300 + 216
    path = spark._jvm.org.apache.hadoop.fs.Path(prefix.shared_folder(spark))
    assert not [f for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if f.getPath().getName().startswith("held-")]


@pytest.mark.parametrize("sizes", [(64, 256, 1024), (4096, 16384, 65536), (1, 1, 5), (3, 8, 64), (100, 128, 128), (256, 256, 1024)])
def test_ends_of_chunks_from_any_start(sizes):
    rng = random.Random(1)
    for data in (rng.randbytes(rng.choice([1, 50, 5000, 70_000])), bytes(3000), rng.randbytes(9000)):
        cutter = fastcdc.Cutter(data, *sizes)
        assert cutter.chain(0, len(data))[1:] == fastcdc.cuts(data, *sizes)
        start = rng.randrange(len(data))
        ends = fastcdc.cuts(data[start:], *sizes)
        assert int(cutter.ends(np.array([start]))[0]) == start + ends[0]
