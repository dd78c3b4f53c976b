"""Near copies of embeddings by sorted projection passes.

Vectors are ordered lexicographically by the concatenated signs of random projections, anew in each
pass, and compared with their neighbours in bounded windows; verified pairs of all passes are united.

So that a group of very many near vectors needs no comparison of all its pairs, the first passes form
balls: a vector joins the leader it meets in its window if it lies within half the threshold's angle,
and then, by the triangle inequality, it is linked with all others of the ball. Later passes look for
links between balls. A found pair of balls is settled for each member by the same inequality against
the other ball's centre and radius where that decides, and else by comparison with the ball's members
in blocks. Counts of links are exact for all pairs of balls found; the passes decide recall, and their
number grows with that of the vectors so that it stays. Windows go on over borders of partitions.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of
different lengths with each other. Null ids are kept and link like others, with a null component.
Repeated rows count as other vectors. Other columns are not read; an empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import components, cut, map_batches, pieces_for

BLOCK, SLICE = 512, 2048  # vectors of a ball, and vectors that ask, in one task
SLACK = 1e-9  # for rounding, in cosines and angles


def unit(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def keys(m: np.ndarray, seed: int) -> list[bytes]:
    """The signs of 64 random projections, as bytes that sort like the bit strings."""
    planes = np.random.default_rng([seed, m.shape[1]]).standard_normal((m.shape[1], 64))
    return [x.tobytes() for x in np.packbits(m @ planes > 0, axis=1)]


def by_length(raw: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in raw])
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def keyed(df: DataFrame, seeds: list[int], columns: list[str], schema: str) -> DataFrame:
    """df, a row for each seed, with pass and key."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("vector").to_pylist()
        out = []
        for seed in seeds:
            key: list[bytes] = [b""] * len(raw)
            for rows in by_length(raw):
                for r, k in zip(rows.tolist(), keys(unit([raw[i] for i in rows]), seed), strict=True):
                    key[r] = k
            out.append(pa.table([*(batch.column(c) for c in columns), pa.array([seed] * len(raw), pa.int32()), pa.array(key, pa.binary())], [*columns, "pass", "key"]))
        return pa.concat_tables(out).combine_chunks().to_batches()[0]

    return map_batches(df.select(*columns), kernel, f"{schema}, pass int, key binary")


def in_order(df: DataFrame, parts: int) -> DataFrame:
    name = "id" if "id" in df.columns else "leader"  # equal keys are split
    return df.repartitionByRange(parts, "pass", "key", name).sortWithinPartitions("pass", "key", name)


def led(df: DataFrame, kind: str, near: float, window: int) -> DataFrame:
    """(id, leader, leader_vector): in the given order, each vector with the nearest of the last `window`
    leaders if its cosine is `near` or more; else it leads itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        recent: list[bytes] = []
        m: dict[int, np.ndarray] = {}
        for batch in batches:
            leader, vector = [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                x = np.frombuffer(v, np.float64)
                x = x / math.sqrt(float(x @ x))
                d = len(x)
                held = m.setdefault(d, np.zeros((0, d)))
                same = [k for k, b in enumerate(recent) if len(b) == len(v)]
                best = -1
                if len(held):
                    c = held @ x
                    k = int(c.argmax())
                    if c[k] >= near:
                        best = same[k]
                if best < 0:
                    ids.append(i)
                    recent.append(v)
                    m[d] = np.concatenate([held, x[None]])
                    if len(ids) > window:
                        old = len(recent[0]) // 8
                        m[old] = m[old][1:]
                        ids.pop(0)
                        recent.pop(0)
                    leader.append(i)
                    vector.append(v)
                else:
                    leader.append(ids[best])
                    vector.append(recent[best])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leader, batch.column("id").type), pa.array(vector, pa.binary())], ["id", "leader", "leader_vector"])

    return df.select("id", "vector").mapInArrow(run, f"id {kind}, leader {kind}, leader_vector binary")


def passes_for(n: int, cosine: float, window: int, least: int, miss: float = 0.004) -> int:
    """Passes, `least` at least, after which a pair at the threshold has been missed with a chance of `miss`.

    The pair's signs agree in one projection with a chance of 1 - angle / pi, others' with one of a half, so
    about (window / n) ** rho is the chance that it lies within a window of one pass."""
    agree = 1 - math.acos(cosine) / math.pi
    met_once = min(1.0, window / max(n, 1)) ** -math.log2(agree)
    return least if met_once >= 1 else max(least, math.ceil(math.log(miss) / math.log1p(-met_once)))


def balls_met(raw: list[bytes], leaders: list, cosine: float, window: int) -> set[tuple]:
    """Pairs of leaders, the smaller first, of which two members within `window` places have the cosine or more."""
    names = np.unique(np.array(leaders))
    ball = np.searchsorted(names, np.array(leaders))
    found: set[tuple[int, int]] = set()
    for rows in by_length(raw):
        m, b = unit([raw[i] for i in rows]), ball[rows]
        for at in range(0, len(rows), window):
            block = slice(at, at + window)
            back = slice(max(0, at - window), at + window)
            i, j = np.nonzero((m[block] @ m[back].T >= cosine - SLACK) & (b[block][:, None] != b[back][None, :]))
            x, y = b[block][i], b[back][j]
            found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
    return {(names[x].item(), names[y].item()) for x, y in found}


def met(df: DataFrame, kind: str, cosine: float, window: int) -> DataFrame:
    """(a, b): pairs of balls of which two members within `window` places have the cosine or more.

    The first and last `window` rows of each partition are given on and met across its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before_v, before_l, ids = TaskContext.get().partitionId(), [], [], pa.int64()

        def out(pairs: list[tuple], border: int | None, raw: list[bytes], leaders: list) -> pa.RecordBatch:
            n, k = len(pairs), len(raw)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs] + [None] * k, ids), pa.array([y for _, y in pairs] + [None] * k, ids), pa.array([None] * n + [border] * k, pa.int32()), pa.array([None] * n + ([part] * k), pa.int32()), pa.array([None] * n + list(range(k)), pa.int32()), pa.array([None] * n + leaders, ids), pa.array([None] * n + raw, pa.binary())], ["a", "b", "border", "part", "place", "leader", "vector"])

        head = 0
        for batch in batches:
            ids = batch.column("leader").type
            own_v, own_l = batch.column("vector").to_pylist(), batch.column("leader").to_pylist()
            raw, leaders = before_v + own_v, before_l + own_l
            yield out(sorted(balls_met(raw, leaders, cosine, window)), part, own_v[: window - head], own_l[: window - head])
            head = min(window, head + len(own_v))
            before_v, before_l = raw[-window:], leaders[-window:]
        yield out([], part + 1, before_v, before_l)

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        pairs = sorted(balls_met(table.column("vector").to_pylist(), table.column("leader").to_pylist(), cosine, window))
        ids = table.column("leader").type
        return pa.table([pa.array([x for x, _ in pairs], ids), pa.array([y for _, y in pairs], ids)], ["a", "b"])

    every = cut(df.select("leader", "vector").mapInArrow(run, f"a {kind}, b {kind}, border int, part int, place int, leader {kind}, vector binary"))
    edges = every.where("border is not null").select("border", "part", "place", "leader", "vector")
    return every.where("a is not null").select("a", "b").unionByName(edges.groupBy("border").applyInArrow(across, f"a {kind}, b {kind}")).distinct()


def against_ball(cosine: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Settles a member against another ball: verdict 1 linked with all, 0 with none, null undecided."""
    reach = math.acos(cosine)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, o = batch.column("vector").to_pylist(), batch.column("other_vector").to_pylist()
        radius = batch.column("radius").to_numpy()
        verdict: list[int | None] = []
        for x, y, r in zip(v, o, radius, strict=True):
            if len(x) != len(y):
                verdict.append(0)
                continue
            a, b = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
            angle = math.acos(min(1.0, max(-1.0, float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)))))
            verdict.append(1 if angle + r <= reach - 1e-7 else 0 if angle - r > reach + 1e-7 else None)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "leader", "vector", "other", "weight")), pa.array(verdict, pa.int32())], ["id", "leader", "vector", "other", "weight", "verdict"])

    return kernel


def counted(cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Members of one ball's block (is_ball) against vectors of other balls: each one's summed weight of links."""

    def run(table: pa.Table) -> pa.Table:
        is_ball = np.array(table.column("is_ball").to_pylist())
        raw, weight = table.column("vector").to_pylist(), table.column("weight").to_numpy()
        total = np.zeros(len(raw), np.int64)
        for rows in by_length(raw):
            asks, holds = rows[~is_ball[rows]], rows[is_ball[rows]]
            if len(asks) and len(holds):
                h, w = unit([raw[i] for i in holds]), weight[holds]
                for at in range(0, len(asks), 256):
                    part = asks[at : at + 256]
                    total[part] = (unit([raw[i] for i in part]) @ h.T >= cosine) @ w
        keep = np.flatnonzero(total)
        take = pa.array(keep)
        return pa.table([table.column("id").take(take), table.column("leader").take(take), table.column("other").take(take), pa.array(total[keep])], ["id", "leader", "other", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, passes: int = 16, window: int = 128, per_partition: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    half = math.sqrt((1 + cosine) / 2) + SLACK  # cosine of half the threshold's angle

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes | None] = []
        for v in batch.column(1).to_pylist():
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                out.append((x / top).tobytes() if np.isfinite(top) and top > 0 else None)  # scaled, so that squares neither overflow nor vanish
            else:
                out.append(None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in out], pa.binary())], ["id", "vector", "copy"])

    source = vectors.select(id_col, vector_col)
    rows = cut(map_batches(source, clean, f"id {kind}, vector binary, copy binary").withColumn("row", F.monotonically_increasing_id()))
    # one vector of each group of exact copies goes on; its number is a row's, so that null or repeated ids do no harm
    classes = cut(rows.where("copy is not null").groupBy("copy").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("vector").alias("vector")))
    n = classes.count()
    parts = pieces_for(n, per_partition)
    passes = passes_for(n, cosine, window, passes)
    points = classes.select("id", "vector")

    first = led(in_order(keyed(points, [1], ["id", "vector"], "id long, vector binary"), parts), "long", half, window)
    members = cut(first.join(classes.select("id", "vector", "weight"), "id"))
    for seed in (2, 3):  # balls of other partitions that could be one
        leaders = members.select(F.col("leader").alias("id"), F.col("leader_vector").alias("vector")).groupBy("id").agg(F.first("vector").alias("vector"))
        over = led(in_order(keyed(leaders, [seed], ["id", "vector"], "id long, vector binary"), pieces_for(n, 4 * per_partition)), "long", half, window).where("id <> leader")
        over = over.select(F.col("id").alias("leader"), F.col("leader").alias("new"), F.col("leader_vector").alias("new_vector"))
        moved = members.join(over, "leader", "left")
        members = cut(map_batches(moved.select("id", "leader", "leader_vector", "vector", "weight", "new", "new_vector"), lambda batch: reassigned(batch, half), "id long, leader long, leader_vector binary, vector binary, weight long"))

    balls = cut(map_batches(members, angles, "leader long, angle double, weight long, least long, leader_vector binary").groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("size"), F.first("leader_vector").alias("center")))
    posted = keyed(members.select("leader", "vector"), list(range(11, 11 + passes)), ["leader", "vector"], "leader long, vector binary")
    pairs = cut(met(in_order(posted, pieces_for(n * passes, 4 * per_partition)), "long", cosine, window).distinct())
    both = pairs.union(pairs.select("b", "a")).toDF("leader", "other")
    asked = members.select("id", "leader", "vector", "weight").join(both, "leader").join(balls.select(F.col("leader").alias("other"), F.col("center").alias("other_vector"), "radius", "total"), "other")
    settled = cut(map_batches(asked.select("id", "leader", "vector", "other", "weight", "other_vector", "radius"), against_ball(cosine), "id long, leader long, vector binary, other long, weight long, verdict int"))
    whole = settled.where("verdict = 1").join(balls.select(F.col("leader").alias("other"), "total"), "other").select("id", "leader", "other", F.col("total").alias("n"))
    # the rest is compared in tasks of one block of a ball's different vectors and one slice of those that ask
    undecided = settled.where("verdict is null")
    sides = undecided.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).join(balls.select(F.col("leader").alias("other"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "other")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    asks = undecided.join(sides, "other").withColumn("block", every("blocks")).withColumn("slice", one("slices")).withColumn("is_ball", F.lit(False))
    held = members.select(F.col("leader").alias("other"), "id", "vector", "weight").join(sides, "other")
    holds = held.withColumn("block", one("blocks")).withColumn("slice", every("slices")).withColumn("leader", F.col("other")).withColumn("is_ball", F.lit(True))
    columns = ["id", "leader", "vector", "other", "weight", "block", "slice", "is_ball"]
    exact = asks.select(*columns).unionByName(holds.select(*columns)).groupBy("other", "block", "slice").applyInArrow(counted(cosine), "id long, leader long, other long, n long")
    found = cut(whole.unionByName(exact))
    linked = components(found.select(F.col("leader").alias("a"), F.col("other").alias("b"))).toDF("leader", "group")
    more = found.groupBy("id").agg(F.sum("n").alias("more"))
    grouped = members.select("id", "leader").join(classes.select("id", "least"), "id").join(linked, "leader", "left").withColumn("group", F.coalesce("group", "leader"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component"))
    of_class = grouped.join(least, "group").join(balls.select("leader", "total"), "leader").join(more, "id", "left").select("id", (F.col("total") - 1 + F.coalesce("more", F.lit(0))).alias("n"), "component")
    result = rows.select(F.col("id").alias(id_col), "copy").join(classes.select("copy", "id").join(of_class, "id").drop("id"), "copy", "left")
    component = F.coalesce("component", id_col)
    return result.select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


def cosines(a: list[bytes], b: list[bytes | None]) -> list[float]:
    out = []
    for x, y in zip(a, b, strict=True):
        if y is None or len(x) != len(y):
            out.append(-2.0)
        else:
            p, q = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
            out.append(float(p @ q) / math.sqrt(float(p @ p) * float(q @ q)))
    return out


def reassigned(batch: pa.RecordBatch, near: float) -> pa.RecordBatch:
    """Members whose leader has found a leader of its own go over to that one if it is near enough."""
    go = np.array(cosines(batch.column("vector").to_pylist(), batch.column("new_vector").to_pylist())) >= near
    mask = pa.array(go)
    pick = lambda new, old: pa.compute.if_else(mask, batch.column(new), batch.column(old))
    return pa.RecordBatch.from_arrays([batch.column("id"), pick("new", "leader"), pick("new_vector", "leader_vector"), batch.column("vector"), batch.column("weight")], ["id", "leader", "leader_vector", "vector", "weight"])


def angles(batch: pa.RecordBatch) -> pa.RecordBatch:
    c = np.clip(cosines(batch.column("vector").to_pylist(), batch.column("leader_vector").to_pylist()), -1, 1)
    return pa.RecordBatch.from_arrays([batch.column("leader"), pa.array(np.arccos(c)), batch.column("weight"), batch.column("id"), batch.column("leader_vector")], ["leader", "angle", "weight", "least", "leader_vector"])
