"""Ranged reads and sinks of many tasks: files above 2 GB, range errors, many tasks a file, failed tasks."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from bitloom.sources import media as M
from bitloom.sources import placed, ranged

from .test_media import box, ivf, mp4, table


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    ranged.register(spark)


def sparse_ivf(path, sizes):
    """Frames of these sizes; large ones are holes that end in a byte."""
    with open(path, "wb") as f:
        f.write(b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 320, 240, 30, 1, len(sizes), 0))
        for i, n in enumerate(sizes):
            f.write(struct.pack("<IQ", n, 10 * i))
            f.seek(n - 1, 1)
            f.write(bytes([i + 1]))


def test_frames_of_a_file_above_two_gigabytes(spark, tmp_path):
    path = str(tmp_path / "large.ivf")
    sparse_ivf(path, [5, 900_000_000, 900_000_000, 900_000_000, 7, 9])
    assert os.path.getsize(path) > 2**31
    frames = spark.read.format("ivf_frames").load(path)
    got = frames.where("sample_index >= 4").orderBy("sample_index").collect()
    assert [(r["sample_index"], r["pts"], r["size"], bytes(r["data"])) for r in got] == [(4, 40, 7, bytes(6) + b"\5"), (5, 50, 9, bytes(8) + b"\6")]
    assert got[0]["offset"] > 2**31 and got[0]["error"] is None
    only = spark.read.format("ivf_frames").option("first", 4).option("last", 4).load(path)
    assert [(r["sample_index"], len(r["data"])) for r in only.collect()] == [(4, 7)]
    index = ranged.index_frames(spark.createDataFrame([(path,)], "path string"))
    small = ranged.read_ranges(index.drop("error").where("size < 100")).orderBy("sample_index").collect()
    assert [(r["sample_index"], bytes(r["data"])[-1]) for r in small] == [(0, 1), (4, 5), (5, 6)]


def test_range_errors_and_truncation(spark, tmp_path):
    whole = ivf([bytes([i]) * 40 for i in range(20)])
    (tmp_path / "a.ivf").write_bytes(whole)
    (tmp_path / "b.ivf").write_bytes(whole[:-1])
    (tmp_path / "c.ivf").write_bytes(b"DKIX")
    read = lambda **options: sorted((os.path.basename(r["path"]), r["sample_index"], r["error"] is None) for r in spark.read.format("ivf_frames").options(**options).load(str(tmp_path)).collect())
    assert read() == [("a.ivf", i, True) for i in range(20)] + [("b.ivf", i, True) for i in range(19)]
    assert set(read(onTruncated="error")) - set(read()) == {("b.ivf", 19, False), ("c.ivf", 0, False)}
    assert read(first=18, last=21) == [("a.ivf", 18, True), ("a.ivf", 19, True), ("a.ivf", 20, False), ("b.ivf", 18, True), ("b.ivf", 19, False), ("c.ivf", 0, False)]
    only = spark.read.format("ivf_frames").load(str(tmp_path / "a.ivf"))
    for where, want in (("sample_index = 3", [3]), ("sample_index > 17", [18, 19]), ("sample_index in (2, 5)", [2, 5]), ("sample_index between 4 and 5", [4, 5]), ("sample_index < 1 and pts >= 0", [0])):
        assert sorted(r["sample_index"] for r in only.where(where).collect()) == want
    ranges = spark.createDataFrame([(str(tmp_path / "a.ivf"), 0, 4), (str(tmp_path / "a.ivf"), len(whole) - 2, 3), (None, 0, 1), (str(tmp_path / "a.ivf"), None, 1)], "path string, offset long, size long")
    got = ranged.read_ranges(ranges).collect()
    assert sorted((r["data"] is None, r["error"] is None) for r in got) == [(False, True), (True, False), (True, False), (True, False)]
    with pytest.raises(ValueError):
        ranged.read_ranges(ranges.withColumn("data", F.lit(1)))


def test_many_tasks_a_file(spark, tmp_path):
    (tmp_path / "a.ivf").write_bytes(ivf([bytes([i]) * 1000 for i in range(50)]))
    frames = spark.read.format("ivf_frames").option("splitBytes", 10_000).load(str(tmp_path / "a.ivf"))
    assert frames.select(F.spark_partition_id().alias("p")).distinct().count() == 5
    assert [r["sample_index"] for r in frames.orderBy("sample_index").collect()] == list(range(50))
    placed_at = ranged.index_frames(spark.createDataFrame([(str(tmp_path / "a.ivf"),)], "path string"))
    parts = ranged.read_ranges(placed_at.drop("error"), split=5_000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_samples_of_a_large_mp4_file(spark, tmp_path):
    """Sample data beyond 2 GB in a file whose boxes are read one by one."""
    n = lambda *x: struct.pack(f">{len(x)}I", *x)
    path, frames, hole = str(tmp_path / "large.mp4"), [b"\x12\x00", b"\x0a\x03\1\2\3"], 2_400_000_000
    stsd = box(b"stsd", n(0, 1), box(b"av01", bytes(24), struct.pack(">HH", 64, 48), bytes(50), box(b"av1C", b"\x81\0\0\0")))
    stbl = box(b"stbl", stsd, box(b"stsz", n(0, 0, 2, 2, 5)), box(b"co64", n(0, 1), struct.pack(">Q", 24 + hole)), box(b"stsc", n(0, 1, 1, 2, 1)))
    moov = box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", n(0, 0), b"vide", bytes(12)), box(b"minf", stbl))))
    with open(path, "wb") as f:
        f.write(box(b"ftyp") + struct.pack(">I4sQ", 1, b"mdat", 16 + hole + 7))
        f.seek(hole, 1)
        f.write(b"".join(frames) + moov)
    found = ranged.ranged_boxes(spark.createDataFrame([(path,)], "path string"))
    chosen = M.first_av1_track(M.tracks(found)).select("path", "track")
    samples = M.mp4_samples(found).join(chosen, ["path", "track"], "left_semi")
    got = ranged.read_ranges(samples).orderBy("sample_index").collect()
    assert [bytes(r["data"]) for r in got] == frames and got[0]["offset"] == 24 + hole
    small = mp4(frames)
    (tmp_path / "small.mp4").write_bytes(small)
    by_rows = sorted(map(tuple, M.boxes(table(spark, small)).drop("path").collect()), key=str)
    assert sorted(map(tuple, ranged.ranged_boxes(spark.createDataFrame([(str(tmp_path / "small.mp4"),)], "path string")).drop("path").collect()), key=str) == by_rows


def test_exclusive_sums(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("n"))
    got = {r["o"]: r["s"] for r in placed.exclusive_sums(rows, "k", "o", F.col("n"), "s", block=16).collect()}
    assert got == {o: sum(p * 7 % 11 for p in range(o) if p % 3 == o % 3) for o in range(1000)}


def test_many_tasks_write_one_file(spark, tmp_path):
    from bitloom.sources import writers

    planes = [bytes((7 * k + f) % 256 for k in range(5 * 3 + 2 * 3 * 2)) for f in range(60)]
    data = b"YUV4MPEG2 W5 H3 F30:1 Ip A1:1 C420jpeg\n" + b"".join(b"FRAME\n" + p for p in planes)
    frames = M.y4m_frames(table(spark, data, data)).repartition(7)
    folder = str(tmp_path / "out")
    placed.write_placed(placed.y4m_parts(frames).repartition(7), folder)
    placed.write_placed(placed.yuv_parts(frames), folder)
    assert sorted(os.listdir(folder)) == ["f0.y4m", "f0.yuv", "f1.y4m", "f1.yuv"]
    want = {r["path"]: bytes(r["content"]) for r in writers.y4m_bytes(frames).collect()}
    assert (tmp_path / "out/f0.y4m").read_bytes() == want["f0"] == data and (tmp_path / "out/f1.y4m").read_bytes() == want["f1"]
    assert (tmp_path / "out/f0.yuv").read_bytes() == b"".join(planes)
    samples = spark.createDataFrame([("v/x.mp4", i, 3 * i, bytearray([i] * (i % 5))) for i in range(40)], "path string, sample_index int, pts long, data binary").repartition(4)
    placed.write_placed(placed.stream_parts(samples), folder)
    assert (tmp_path / "out/x.obu").read_bytes() == b"".join(bytes([i] * (i % 5)) for i in range(40))
    placed.write_placed(placed.ivf_parts(samples, width=320, height=240), folder)
    back = spark.read.format("ivf_frames").load(f"{folder}/x.ivf").orderBy("sample_index").collect()
    assert [(r["sample_index"], r["pts"], bytes(r["data"])) for r in back] == [(i, 3 * i, bytes([i] * (i % 5))) for i in range(40)]
    head = M.ivf_headers(M.files(spark, f"{folder}/x.ivf")).first()
    assert (head["codec"], head["width"], head["height"], head["frame_count"], head["timebase_den"]) == ("AV01", 320, 240, 40, 30)


def test_failed_writes_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(40, numPartitions=4).select(F.lit("a").alias("name"), F.col("id").alias("offset"), F.expr("cast('x' as binary)").alias("data"))
    with pytest.raises(Exception, match="wrong"):
        placed.write_placed(rows.withColumn("data", F.expr("if(offset = 37, cast(raise_error('wrong') as binary), data)")), folder)
    assert os.listdir(folder) == []
    with pytest.raises(Exception, match="placed"):
        placed.write_placed(rows.where("offset <> 11"), folder)
    assert os.listdir(folder) == []
    placed.write_placed(rows, folder)
    assert os.listdir(folder) == ["a"] and (tmp_path / "out/a").read_bytes() == b"x" * 40
    with pytest.raises(Exception, match="a"):
        placed.write_placed(rows, folder)
    placed.write_placed(rows.limit(3), folder, overwrite=True)
    assert (tmp_path / "out/a").read_bytes() == b"xxx"
    with pytest.raises(Exception, match="file name"):
        placed.write_placed(rows.withColumn("name", F.lit("../b")), folder)
