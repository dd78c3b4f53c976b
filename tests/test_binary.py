"""Decoders of binary streams, the row form by columns, and objects looked up by number."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliant.functions import decoders as d
from foliant.functions import files, rowcodec, rowcodec_columns, structure
from foliant.functions import objects as o
from foliant.operators import binary, decode

ROOT = o.dictionary(Root=o.ref(1))


def outcome(decoder, data):
    r = decoder.decode(data)
    return r.values, r.at, r.error, r.short


def test_reading_once_and_many_times():
    assert outcome(d.once(d.uint(8)), b"ab") == ([97], 8, None, None)
    assert outcome(d.many(d.uint(16)), b"abcde")[:2] == ([0x6162, 0x6364], 32)
    assert outcome(d.once(d.uint(16)), b"a") == ([], 0, None, "8 bits more are needed")
    assert outcome(d.once(d.uint(16)).strict(), b"a")[2] == "8 bits more are needed"
    small = d.uint(8).where(lambda x: x < 100, "large")
    assert outcome(d.many(small), b"ab\xff") == ([97, 98], 16, "large", None)
    assert outcome(d.try_many(small) + d.many(d.uint(8)), b"ab\xff") == ([97, 98, 255], 24, None, None)
    assert outcome(d.try_once(small) + d.once(d.uint(8)), b"\xff") == ([255], 8, None, None)


def test_composition():
    assert outcome(d.emits(1, 2) + d.EMPTY + d.emits(3), b"") == ([1, 2, 3], 0, None, None)
    assert outcome(d.emits(1) + d.fails("no") + d.emits(2), b"") == ([1], 0, "no", None)
    assert outcome(d.isolate(16, d.once(d.uint(8))) + d.once(d.uint(8)), b"abc") == ([97, 99], 24, None, None)
    assert outcome(d.ignore(8) + d.many(d.uint(4)), b"a\x12") == ([1, 2], 16, None, None)
    counted = d.once(d.uint(8)).flat_map(lambda n: d.isolate(8 * n, d.many(d.uint(8))))
    assert outcome(counted + d.once(d.raw(1)), b"\x02abc") == ([97, 98, b"c"], 32, None, None)
    assert outcome(d.many(d.sized(d.uint(8))).map(len), b"\x01a\x00\x02bc")[0] == [1, 0, 2]
    assert outcome(d.once(d.constant(b"PDF")), b"PNG")[2] == "not b'PDF'"
    assert outcome(d.once(d.together(d.integer(8), d.uint(16, little=True), d.floating(32))), b"\xff\x01\x02\x3f\x80\x00\x00")[0] == [(-1, 513, 1.0)]


def test_fixed_values_equal_the_general_way(spark):
    rng = random.Random(1)
    rows = [(i, bytes(rng.randrange(256) for _ in range(rng.randint(0, 11)))) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "file_id long, content binary")
    for codec, kind in ((d.uint(8), "int"), (d.integer(32), "int"), (d.uint(16, little=True), "int")):
        fast = {(r.file_id, r.pos): r.value for r in binary.decoded_values(df, d.many(codec), kind).collect()}
        slow = {(i, k): v for i, b in rows if b is not None for k, v in enumerate(d.many(codec).decode(b).values)}
        assert fast == slow


def test_byte_scans(spark):
    df = spark.createDataFrame([(0, bytearray(b"abc")), (1, bytearray(b"")), (2, None), (3, bytearray(b"\xff"))], "file_id long, content binary")
    got = binary.ByteScan().map(lambda x: x + 1).map(lambda x: x * 2).sums(df)
    assert {r.file_id: (r.n, r.total) for r in got.collect()} == {0: (3, 594), 1: (0, 0), 2: (0, 0), 3: (1, 512)}


def test_rows_by_columns_equal_rows_one_by_one():
    fields = [("a", T.LongType(), False), ("b", T.StringType(), True), ("c", T.DecimalType(12, 2), True), ("d", T.BooleanType(), True), ("e", T.DoubleType(), True), ("f", T.BinaryType(), False), ("g", T.ShortType(), True)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    rng = random.Random(2)
    maybe = lambda v: None if rng.random() < 0.2 else v
    rows = [{"a": rng.randint(-(10**12), 10**12), "b": maybe("é" * rng.randint(0, 4)), "c": maybe(Decimal(rng.randint(-(10**6), 10**6)).scaleb(-2)), "d": maybe(rng.random() < 0.5), "e": maybe(rng.random()), "f": bytes(rng.randint(0, 5)), "g": maybe(rng.randint(-5, 5))} for _ in range(300)]
    batch = pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))
    made = rowcodec_columns.encode(batch.slice(7), schema)
    assert made.to_pylist() == [rowcodec.encode(r, schema) for r in rows[7:]]
    assert rowcodec_columns.decode(made.slice(3, 100), schema, batch.schema).to_pylist() == rows[10:110]
    assert rowcodec_columns.encode(batch.slice(0, 0), schema).to_pylist() == []


def test_lookups(spark):
    page = files.simple_page(b"BT (x) Tj ET")
    df = spark.createDataFrame([(0, bytearray(files.build(page, ROOT))), (1, bytearray(b"junk")), (2, None)], "file_id long, content binary")
    assert [(r.file_id, r.obj_num, bytes(r.payload or b"")) for r in decode.object_numbers(df, [4, 5, 9]).collect()] == [(0, 4, b"BT (x) Tj ET"), (0, 5, b"")]
    assert [(r.obj_num, bytes(r.payload)) for r in decode.object_numbers(df, [4], raw=True).collect()] == [(4, b"BT (x) Tj ET")]
    assert [r.obj_num for r in decode.page_number(df, 0).collect()] == [3] and decode.page_number(df, 1).count() == 0
    assert '"/Page"' in decode.page_object(df, 0).head().prim_json
    assert [(r.place, r.text) for r in decode.streams_of_page(df, 0).collect()] == [(0, "BT (x) Tj ET")]
    opened = {r.file_id: (r.objects, len(r.pages)) for r in decode.opened_df(df).collect()}
    assert opened == {0: (5, 1), 1: (0, 0)}


def test_wrong_lengths():
    good = files.build(files.simple_page(b"BT (x) Tj ET"), ROOT)
    for bad in (b"/Length 1", b"/Length 99999", b"/Length 13"):
        raw = good.replace(b"/Length 12", bad)
        assert raw != good and structure.page_texts(files.decode(raw).objects)[0][2] == "x"
    cut = good[: good.index(b"endstream")]
    assert files.decode(cut.replace(b"/Length 12", b"/Length 99999")).unparsed > 0


def nested_schema():
    shape = T.StructType([T.StructField("circle", T.StructType([T.StructField("r", T.DoubleType(), False)])), T.StructField("text", T.StringType()), T.StructField("sizes", T.ArrayType(T.LongType(), False))])
    inner = T.StructType([T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType(), True), False), T.StructField("price", T.DecimalType(12, 2))])
    return T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("shape", shape, False, {"variant": True}),
            T.StructField("maybe", shape, True, {"variant": True}),
            T.StructField("inner", inner),
            T.StructField("list", T.ArrayType(inner, True)),
            T.StructField("numbers", T.ArrayType(T.IntegerType(), False), False),
            T.StructField("deep", T.ArrayType(T.ArrayType(T.ShortType(), True), False), False),
            T.StructField("map", T.MapType(T.StringType(), T.ArrayType(T.LongType(), False), True)),
            T.StructField("fixed", T.MapType(T.IntegerType(), T.DoubleType(), False), False),
            T.StructField("flag", T.BooleanType()),
        ]
    )


def nested_rows(n, seed):
    rng = random.Random(seed)
    some = lambda f, p=0.2: None if rng.random() < p else f()
    text = lambda: "".join(rng.choice("aé€𝄞") for _ in range(rng.randrange(5)))
    many = lambda f, k=4: [f() for _ in range(rng.randrange(k))]
    number = lambda: rng.randrange(-(1 << 40), 1 << 40)
    inner = lambda: {"name": some(text), "tags": many(lambda: some(text)), "price": some(lambda: Decimal(rng.randrange(-9999, 9999)).scaleb(-2))}

    def shape():
        which = rng.randrange(3)
        return {"circle": {"r": rng.random()} if which == 0 else None, "text": text() if which == 1 else None, "sizes": many(number) if which == 2 else None}

    return [
        {
            "id": number(),
            "shape": shape(),
            "maybe": some(shape),
            "inner": some(inner),
            "list": some(lambda: many(lambda: some(inner), 6)),
            "numbers": many(lambda: rng.randrange(1 << 30), 9),
            "deep": many(lambda: many(lambda: some(lambda: rng.randrange(99)))),
            "map": some(lambda: {f"k{i}": some(lambda: many(number)) for i in range(rng.randrange(4))}),
            "fixed": {i: rng.random() for i in range(rng.randrange(4))},
            "flag": some(lambda: rng.random() < 0.5),
        }
        for _ in range(n)
    ]


def plain(rows):
    """Rows with maps as dicts."""
    return [r | {k: None if r[k] is None else dict(r[k]) for k in ("map", "fixed")} for r in rows]


def test_nested_rows_by_columns():
    schema = nested_schema()
    target = to_arrow_schema(schema)
    for n, seed in ((200, 1), (1, 2), (0, 3)):
        rows = nested_rows(n, seed)
        batch = pa.RecordBatch.from_pylist([r | {k: None if r[k] is None else list(r[k].items()) for k in ("map", "fixed")} for r in rows], schema=target)
        made = rowcodec_columns.encode(batch, schema)
        assert made.to_pylist() == [rowcodec.encode(r, schema) for r in rows]
        assert plain(rowcodec_columns.decode(made, schema, target).to_pylist()) == rows
        if n > 20:
            assert rowcodec_columns.encode(batch.slice(7, 20), schema).to_pylist() == made.to_pylist()[7:27]
            assert plain(rowcodec_columns.decode(made.slice(5, 9), schema, target).to_pylist()) == rows[5:14]


def test_what_has_no_form():
    with pytest.raises(ValueError, match="allows none"):
        rowcodec_columns.encode(pa.RecordBatch.from_pylist([{"x": None}], schema=pa.schema([("x", pa.int64())])), T.StructType([T.StructField("x", T.LongType(), False)]))
    with pytest.raises(TypeError, match="no binary form"):
        rowcodec_columns.encode(pa.RecordBatch.from_pylist([], schema=pa.schema([("x", pa.date32())])), T.StructType([T.StructField("x", T.DateType(), False)]))


def test_kernels_hold_a_slice_of_a_batch(spark, monkeypatch):
    """Steps are asked about a slice of a batch at a time, and rows of unlike sizes come out whole and in order."""
    from foliant.functions import batches

    most = batches.PORTION

    def small(values):
        assert len(values) <= most
        return values + 1

    df = spark.range(0, 40, 1, 1).selectExpr("id as file_id", "cast(repeat('a', 1 + cast(id as int) * 9000) as binary) as content")
    rows = {r.file_id: (r.n, r.total) for r in binary.ByteScan().map(small).sums(df).collect()}
    assert rows == {i: (1 + i * 9000, 98 * (1 + i * 9000)) for i in range(40)}
    batch = pa.record_batch({"i": list(range(9)), "x": [b"", b"a" * 100, None, b"b" * 5000, b"c" * 30, b"d" * 30, b"", b"e" * 900, b"f"]})
    parts = list(batches.sliced([batch, batch.slice(0, 0)], 200))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows < 2 or p.nbytes <= 200 for p in parts)
