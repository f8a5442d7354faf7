from bitloom.operators import headers as H
from bitloom.sources import media as M
from bitloom.streaming import session as S


def units(spark, *payloads):
    rows = [("f", i, bytearray(p)) for i, p in enumerate(payloads)]
    return M.units(spark.createDataFrame(rows, "path string, sample_index int, data binary"))


GOLDEN = bytes.fromhex("0A0B00000024CF7F0DBFFF3008")


def test_golden_sequence_header(spark):
    (r,) = H.sequence_headers(units(spark, GOLDEN, b"\x0a\x01\x00")).collect()
    assert (r["profile"], r["width"], r["height"], r["bit_depth"], r["subsampling_x"], r["subsampling_y"]) == (0, 960, 540, 8, 1, 1)
    assert (r["operating_points"], r["level"], r["superblock_128"], r["filter_intra"], r["order_hint_bits"]) == (1, 4, True, True, 7)
    assert (r["superres"], r["cdef"], r["restoration"], r["full_range"], r["film_grain"]) == (False, True, True, False, False)


def test_reduced_still_header(spark):
    bits = "000" "1" "1" "00100" "1001" "1000" + format(319, "010b") + format(239, "09b") + "000" "010" "0" "0" "0" "0" "00" "0" "0"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    (r,) = H.sequence_headers(units(spark, bytes([0x0A, len(data)]) + data)).collect()
    assert (r["width"], r["height"], r["reduced_still"], r["cdef"], r["bit_depth"]) == (320, 240, True, True, 8)
    assert (r["point_levels"], r["display_tick"]) == ([4], None)
    (f,) = H.frame_headers(units(spark, bytes([0x0A, len(data)]) + data + b"\x32\x02\xff\x00")).collect()
    assert (f["frame_type_name"], f["show_frame"], f["show_existing"], f["error_resilient"], f["showable"]) == ("KEY_FRAME", True, False, True, False)


def test_timing_and_operating_points(spark):
    """Timing, a decoder model and two operating points, built bit by bit."""
    bits = "000" "0" "0" "1" + format(1001, "032b") + format(30000, "032b") + "1" "010" "1" "00011" + format(90000, "032b") + "0000000000" "0" "00001"
    bits += format(0x101, "012b") + "01001" "1" "0" + format(0x102, "012b") + "00100" "0"
    bits += "0011" "0011" + format(15, "04b") + format(7, "04b") + "0" "000" "0000" "0" "1" "1" "000" "0" "0" "0" "00" "00"
    data = int(bits.ljust(-(-len(bits) // 8) * 8 + 8, "0"), 2).to_bytes(-(-len(bits) // 8) + 1, "big")
    (r,) = H.sequence_headers(units(spark, bytes([0x0A, len(data)]) + data)).collect()
    assert (r["display_tick"], r["time_scale"], r["ticks_per_picture"], r["decoding_tick"]) == (1001, 30000, 2, 90000)
    assert (r["operating_points"], r["level"], r["point_idcs"], r["point_levels"], r["point_tiers"]) == (2, 9, [0x101, 0x102], [9, 4], [1, 0])
    assert (r["width"], r["height"]) == (16, 8)


def test_frame_headers(spark):
    frame = lambda b: bytes([0x32, 2, b, 0])
    got = H.frame_headers(units(spark, frame(0x10), GOLDEN + frame(0x10), frame(0x30), frame(0x20), b"\x1a\x01\xb0")).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["frame_type_name"], r["show_frame"], r["show_existing"], r["shown_slot"]) for r in got] == [
        (1, "KEY_FRAME", True, False, None), (2, "INTER_FRAME", True, False, None), (3, "INTER_FRAME", False, False, None), (4, None, True, True, 3),
    ]
    assert [r["error_resilient"] for r in got] == [True, False, False, None]
    assert {r["frame_type_name"]: r["count"] for r in H.frame_histogram(H.frame_headers(units(spark, GOLDEN + frame(0x10) + frame(0x30)))).collect()} == {"KEY_FRAME": 1, "INTER_FRAME": 1}


def test_session(spark, tmp_path):
    rows = [(1, i, i == 4) for i in range(7)] + [(2, 0, False)]
    frames = spark.createDataFrame(rows, "session_id long, seq long, force_key boolean")
    batch = [tuple(r) for r in S.packets(frames, 3).orderBy("session_id", "seq").collect()]
    assert [r[1] for r in batch if r[3] and r[0] == 1] == [0, 3, 4, 6]
    assert [r[1] for r in [tuple(x) for x in S.packets(frames, 0).collect()] if r[3] and r[0] == 1] == [0, 4]
    source = str(tmp_path / "in")
    frames.where("seq < 3").coalesce(1).write.parquet(source)
    frames.where("seq >= 3").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 10).parquet(source)
    query = S.packet_stream(stream, 3).writeStream.format("memory").queryName("packets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("packets").collect()) == sorted(batch)
