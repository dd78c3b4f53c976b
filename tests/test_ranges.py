"""Files by ranges and files from parts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.sources import ranges
from foliant.streaming import sinks

PARTS = "file_id string, off long, bytes binary"


def files(n=10):
    rng = random.Random(n)
    return {f"a{i}": rng.randbytes([0, 1, 1000, 5000, 20_000][i % 5]) for i in range(n)} | {"sub/b": rng.randbytes(3000)}


def parts(spark, held, size=700):
    rows = [(n, o, b[o : o + size]) for n, b in held.items() for o in range(0, max(1, len(b)), size)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, PARTS).repartition(3)


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["file_id"], r["off"])):
        assert len(out.get(r["file_id"], b"")) == r["off"]
        out[r["file_id"]] = out.get(r["file_id"], b"") + bytes(r["bytes"])
    return out


def all_files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_written_files_come_back_by_ranges(spark, tmp_path):
    held, folder = files(), f"{tmp_path}/f"
    ranges.write_parts(parts(spark, held), folder, ".bin")
    assert all_files(folder) == sorted(f"{n}.bin" for n in held)
    rows = ranges.read_ranges(spark, f"file:{folder}", glob="*.bin", chunkSize=512, stretch=2000, opening=0)
    got = rows.collect()
    assert joined(got) == {f"{n}.bin": b for n, b in held.items()}
    assert sum(r["last"] for r in got) == len(held)
    assert max(len(r["bytes"]) for r in got) == 512
    assert rows.select(F.spark_partition_id()).distinct().count() > 20  # stretches of one file are tasks of their own
    small = ranges.read_ranges(spark, folder, glob="*.bin", opening=10_000, stretch=50_000)
    assert joined(small.collect()) == joined(got) and small.select(F.spark_partition_id()).distinct().count() < 6
    assert ranges.read_ranges(spark, f"{tmp_path}/none").count() == 0


def test_a_stream_has_each_file_once(spark, tmp_path):
    held, folder, out = files(), f"{tmp_path}/f", f"{tmp_path}/out"
    some = {n: b for n, b in held.items() if n < "a5"}
    for now in (some, {n: b for n, b in held.items() if n not in some}, {}):
        if now:
            ranges.write_parts(parts(spark, now), folder)
        got = sinks.drained(ranges.stream_ranges(spark, folder, chunkSize=4096), out)
    assert joined(got.collect()) == held


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    held, folder = files(), f"{tmp_path}/f"
    ranges.write_parts(parts(spark, {"old": b"kept"}), folder)
    broken = parts(spark, held).withColumn("bytes", F.when(F.col("file_id") == "a4", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="broken"):
        ranges.write_parts(broken, folder)
    assert all_files(folder) == ["old"]
    with pytest.raises(Exception, match="follow each other"):  # not in order of files
        ranges.register(spark)
        mixed = spark.createDataFrame([("a", 0, b"1"), ("b", 0, b"2"), ("a", 1, b"3")], PARTS).coalesce(1)
        mixed.write.format("parts").mode("append").option("path", folder).save()
    assert all_files(folder) == ["old"]


def test_jobs_in_one_folder_leave_each_other_alone(spark, tmp_path):
    folder = f"{tmp_path}/f"
    one, other = ranges.PartWriter(folder, ""), ranges.PartWriter(folder, "")
    store, base = ranges.filesystem(folder)
    for w in (one, other):
        store.create_dir(f"{w._staging(base)}/0-0", recursive=True)
        with store.open_output_stream(f"{w._staging(base)}/0-0/{w.job}") as f:
            f.write(b"x")
    assert ranges.read_ranges(spark, folder).count() == 0  # nothing is seen before its job ends
    one.abort([None])
    other.commit([ranges.Written(f"{other._staging(base)}/0-0", [other.job]), None])
    assert all_files(folder) == [other.job]
