"""Operators on Spark, with cases the registered queries don't cover."""

import os
import time

import pytest
from pyspark.sql import functions as F

from foliant import queries
from foliant.functions import files
from foliant.functions import objects as o
from foliant.operators import checks, decode, policy, write
from foliant.plans import scan
from foliant.sources import binary
from foliant.streaming.files import chunked_events


def frame(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "file_id long, content binary")


def page(**kw):
    return files.simple_page(b"BT (x) Tj ET", **kw)


ROOT = o.dictionary(Root=o.ref(1))


def test_nulls_empty_and_garbage(spark):
    df = frame(spark, None, b"", b"no pdf", files.build(page(), ROOT))
    assert {r.file_id: (r.objects, r.unparsed_bytes) for r in decode.meta_df(df).collect()} == {1: (0, 0), 2: (0, 6), 3: (5, 0)}
    assert [r.text for r in decode.page_text_df(decode.decoded_df(df)).collect()] == ["x"]
    assert decode.decoded_df(df.limit(0)).count() == 0


def test_large_payloads_come_in_parts(spark):
    objects = page()
    objects[3] = (4, 0, o.dictionary(), bytes(i & 255 for i in range(2500)))
    rows = decode.events_df(frame(spark, files.build(objects, ROOT)), inline_max_bytes=1000).orderBy("seq").collect()
    parts = [r for r in rows if r.kind.startswith("stream")]
    assert [r.kind for r in parts] == ["stream_start", "stream_bytes", "stream_bytes", "stream_bytes", "stream_end"]
    assert b"".join(bytes(r.payload) for r in parts[1:-1]) == objects[3][3]


def test_elements_and_faults(spark):
    objects = page()
    objects += [(6, 0, o.dictionary(Author=o.text(b"a")), None), (7, 0, o.array(o.num(1)), None), (8, 0, o.dictionary(Font=o.dictionary()), None), (9, 0, o.dictionary(Subtype=o.name("Image"), Filter=o.name("DCTDecode"), Width=o.num(1)), b"jpg"), (10, 0, o.dictionary(Type=o.name("Page")), None)]
    decoded = decode.decoded_df(frame(spark, files.build(objects, ROOT)))
    kinds = {r.obj_num: (r.kind, r.error) for r in decode.elements_df(decoded).collect()}
    assert kinds[6] == ("info", None) and kinds[7] == ("array", None) and kinds[8] == ("font_resource", None) and kinds[9] == ("content_image", None) and kinds[10] == ("page", "MediaBox")
    assert [(r.extension, bytes(r.bytes)) for r in decode.image_files(decoded).collect()] == [("jpg", b"jpg")]


def faults(spark, objects, trailer=ROOT):
    rows = frame(spark, files.build(objects, trailer))
    return {(r.kind, r.owner, r.target) for r in checks.validate_df(decode.decoded_df(rows), decode.meta_df(rows)).collect()}


def test_validation(spark):
    assert faults(spark, page()) == set()
    assert faults(spark, page(), o.dictionary()) == {("NoRoot", None, None)}
    assert faults(spark, page(), o.dictionary(Root=o.ref(9))) == {("NoCatalog", None, 9)}
    cyclic = page()
    cyclic[1] = (2, 0, o.updated(cyclic[1][2], Kids=o.array(o.ref(3), o.ref(2))), None)
    assert faults(spark, cyclic) == {("PageTreeCycle", 2, 2)}
    listed = page()
    listed[2] = (3, 0, o.updated(listed[2][2], Contents=o.array(o.ref(6))), None)
    assert faults(spark, [*listed, (6, 0, o.array(o.ref(4), o.ref(50)), None)]) == {("ContentMissing", 3, 50)}
    wrong = page()
    wrong[1] = (2, 0, o.updated(wrong[1][2], Kids=o.array(o.ref(5))), None)
    assert faults(spark, wrong) == {("InvalidPageTreeObject", 2, 5)}


def test_contents_in_nested_lists(spark):
    """Lists of references are followed to their end, however deep; a list that holds itself ends there."""
    listed = page()
    listed[2] = (3, 0, o.updated(listed[2][2], Contents=o.array(o.ref(6))), None)
    chain = [(k, 0, o.array(o.ref(k + 1)), None) for k in range(6, 18)]
    assert faults(spark, [*listed, *chain, (18, 0, o.array(o.ref(4), o.ref(50)), None)]) == {("ContentMissing", 3, 50)}
    assert faults(spark, [*listed, (6, 0, o.array(o.ref(4), o.ref(6)), None)]) == {("ContentTooDeep", 3, 6)}


def test_streams_that_earlier_steps_empty(spark):
    s = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 9)], "stream_id long, pos long, value long")
    small = scan.filter_(lambda v: v < 3)
    seeded = (small >> scan.fold(F.lit(7).cast("long"), lambda a, v: a + v)).run(s).outputs.collect()
    assert {r.stream_id: r.value for r in seeded} == {0: 10, 1: 7}
    assert {r.stream_id: r.value for r in (small >> scan.total()).run(s).outputs.collect()} == {0: 3, 1: 0}
    # what arms leave at the end isn't paired
    assert (scan.total() & scan.total()).run(s).outputs.count() == 0
    assert {r.value.first for r in (scan.identity() & scan.total()).run(s).outputs.collect()} == set()
    either = (scan.map_(lambda v: v * 2) + scan.map_(lambda v: -v))
    tagged = scan.test(lambda v: v > 1) >> either
    assert sorted((r.value.tag, r.value.left, r.value.right) for r in tagged.run(s).outputs.collect()) == [("left", 4, None), ("left", 18, None), ("right", None, -1)]


def test_policies(spark):
    js = page(catalog={"Names": o.dictionary(JavaScript=o.dictionary()), "AA": o.dictionary(S=o.name("JavaScript"))})
    embedded = [*page(), (6, 0, o.dictionary(Type=o.name("EmbeddedFile")), b"e"), (7, 0, o.dictionary(Subtype=o.name("FileAttachment")), None)]
    composite = [*page(), (6, 0, o.dictionary(DescendantFonts=o.array(o.ref(5))), None)]
    rows = frame(spark, files.build(js, ROOT), files.build(embedded, ROOT), files.build(composite, ROOT), b"junk")
    decoded, meta = decode.decoded_df(rows).cache(), decode.meta_df(rows).cache()
    run = lambda p: sorted((r.file_id, r.kind, r.obj_num, r.detail) for r in policy.violations_df(decoded, meta, p).collect())
    assert run(policy.PASS) == []
    assert run(policy.ban_javascript()) == [(0, "JavaScript", 1, "AA"), (0, "JavaScript", 1, "Names.JavaScript")]
    assert run(policy.ban_embedded_files() & policy.ban_file_attachments()) == [(1, "EmbeddedFile", 6, None), (1, "FileAttachment", 7, None)]
    assert run(policy.deny_fonts("Helvetica"))[-2:] == [(2, "DeniedFont", 5, "Helvetica")] * 2
    assert [r[0] for r in run(policy.reject("no"))] == [0, 1, 2]
    assert [r[0] for r in run(policy.if_else(policy.object_count_at_least(6), policy.reject("large"), policy.reject("small")))] == [0, 1, 2]
    assert run(policy.any_of(policy.ban_javascript(), policy.PASS)) == []
    assert [r[0] for r in run(policy.check("embeds", F.col("has_embedded_file")))] == [1]


def test_xref_gaps_are_free(spark):
    rows = spark.createDataFrame([(1, 0, 3, 0, 10, b"x" * 10), (1, 1, 5, 0, 7, b"y" * 7), (1, 2, 3, 0, 4, b"z" * 4)], "file_id long, seq int, obj_num long, gen int, size long, bytes binary")
    got = {r.obj_num: (r.offset, r.in_use) for r in write.xref_df(write.offsets_df(rows, 100)).collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (0, False), 3: (117, True), 4: (0, False), 5: (110, True)}


def test_scan_composition(spark):
    s = spark.createDataFrame([(0, i, i) for i in range(5)] + [(1, 0, 9)], "stream_id long, pos long, value long")
    r = (scan.drop(1) >> scan.map_(lambda v: v * 2) >> scan.take(2)).run(s)
    assert sorted((x.stream_id, x.value) for x in r.outputs.collect()) == [(0, 2), (0, 4)]
    assert {x.stream_id: x.status for x in r.status.collect()} == {0: "stop", 1: "success"}
    b = spark.createDataFrame([(0, i, bytearray(b"ab" * 8)) for i in range(4)], "stream_id long, pos long, value binary")
    guarded = (scan.bomb_guard(16) >> scan.hash_("sha-256")).run(b)
    import hashlib

    assert guarded.outputs.head().value == hashlib.sha256(b"ab" * 8).hexdigest()
    assert guarded.status.head().asDict() == {"stream_id": 0, "status": "failure", "error": "BombError(17,16)"}
    assert scan.fixed_chunk(24).run(b).outputs.count() == 3
    long_chain = scan.identity()
    for _ in range(300):
        long_chain = long_chain >> scan.map_(lambda v: v)
    assert len(long_chain.steps) == 1


def test_files_in_and_out(spark, tmp_path):
    rows = frame(spark, b"%PDF-1.4 a", b"bb")
    assert binary.write_files(rows, str(tmp_path)) == 12
    assert sorted(os.listdir(tmp_path)) == ["0.pdf", "1.pdf"]
    got = binary.read_files(spark, str(tmp_path))
    assert sorted(bytes(r.content) for r in got.collect()) == [b"%PDF-1.4 a", b"bb"]
    assert binary.stream_files(spark, str(tmp_path)).isStreaming


def test_stream_of_chunks(spark, tmp_path):
    raw = files.build(page(), ROOT)
    parts = [raw[i : i + 100] for i in range(0, len(raw), 100)]
    schema = "file_id string, chunk_no long, bytes binary, last boolean"
    for k in (0, 1):
        half = [("f", i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts) if (i >= len(parts) // 2) == bool(k)]
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chunked_events(stream).writeStream.format("memory").queryName("chunked").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.kind, r.obj_num) for r in spark.table("chunked").orderBy("seq").collect()]
    want = [(e.kind, e.number) for e in files.events(raw)]
    assert got == want


@pytest.mark.parametrize("name", ["pdf_roundtrip_text", "pdf_object_streams", "pdf_validate", "pdf_validate_kinds", "pdf_compare_kinds", "pdf_rewrite_state", "cdc_chunks", "scan_signals", "binary_records"])
def test_queries_equal_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    want = c.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, d).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: None if v is None or str(v) in ("<NA>", "nan") else int(v) if isinstance(v, float) and v == int(v) else v
    rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_chunks_of_odd_documents(spark, tmp_path):
    """Ids that are null or come twice, texts that are null or empty: a row for each."""
    import duckdb

    rows = [(1, "a" * 5000), (1, "a" * 5000), (1, "b" * 300), (2, ""), (2, None), (2, ""), (3, " "), (3, "\0"), (None, "x"), (None, "é€"), (None, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(queries.ORACLE["cdc_chunks"]).fetchall()
    got = queries.QUERIES["cdc_chunks"](spark, str(tmp_path)).select("doc_id", "total", "sha256", "within").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
