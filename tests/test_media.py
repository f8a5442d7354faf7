import struct

from bitloom.sources import media as M


def table(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def ivf(frames):
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 320, 240, 30, 1, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(f), i) + f for i, f in enumerate(frames))


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def test_ivf(spark):
    whole = ivf([b"\1\2\3", b"\4\5", b"\6\7\x08\x09"])
    rows = table(spark, whole, whole[:-1], ivf([]), b"DKIX" + whole[4:], b"DKIF")
    heads = {r["path"]: r for r in M.ivf_headers(rows).collect()}
    assert set(heads) == {"f0", "f1", "f2"}
    assert (heads["f0"]["codec"], heads["f0"]["width"], heads["f0"]["height"], heads["f0"]["timebase_num"], heads["f0"]["timebase_den"], heads["f0"]["frame_count"]) == ("AV01", 320, 240, 1, 30, 3)
    got = [(r["path"], r["sample_index"], r["pts"], len(r["data"])) for r in M.ivf_samples(rows).orderBy("path", "sample_index").collect()]
    assert got == [("f0", 0, 0, 3), ("f0", 1, 1, 2), ("f0", 2, 2, 4), ("f1", 0, 0, 3), ("f1", 1, 1, 2)]


def units_of(spark, data):
    rows = spark.createDataFrame([("f", 0, bytearray(data))], "path string, sample_index int, data binary")
    return M.units(rows).orderBy("obu_index").collect()


def test_units(spark):
    got = units_of(spark, bytes.fromhex("1200" "0A03010203" "3202AABB"))
    assert [(r["obu_type"], r["size"], bytes(r["payload"])) for r in got] == [(2, 0, b""), (1, 3, b"\1\2\3"), (6, 2, b"\xaa\xbb")]
    assert units_of(spark, b"") == []


def test_extension_and_damage(spark):
    (r,) = units_of(spark, bytes.fromhex("364801FF"))
    assert (r["obu_type"], r["temporal_id"], r["spatial_id"]) == (6, 2, 1)
    a, b = units_of(spark, bytes.fromhex("1200" "92"))
    assert a["obu_type"] == 2 and a["error"] is None
    assert (b["error_offset"], b["obu_type"]) == (2, None) and "forbidden" in b["error"]
    (c,) = units_of(spark, bytes.fromhex("0A05AA"))
    assert "exceeds" in c["error"]


def test_annexb(spark):
    got = M.annexb_units(table(spark, bytes.fromhex("03020110"), bytes.fromhex("0302011009"))).orderBy("path", "sample_index").collect()
    assert [(r["path"], r["sample_index"], r["obu_type"], r["error"] is None) for r in got] == [("f0", 0, 2, True), ("f1", 0, 2, True), ("f1", 1, None, False)]


def test_mp4_sample_table(spark):
    n = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", box(b"stsz", n(0, 0, 5, 10, 20, 30, 40, 50)), box(b"stco", n(0, 2, 100, 500)), box(b"stsc", n(0, 2, 1, 2, 1, 2, 3, 1)), box(b"stss", n(0, 2, 1, 4)), box(b"ctts", n(0, 2, 2, 5, 1), struct.pack(">i", -3)))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))))
    got = M.mp4_samples(M.boxes(table(spark, data))).orderBy("sample_index").collect()
    assert [r["offset"] for r in got] == [100, 110, 500, 530, 570]
    assert [r["is_sync"] for r in got] == [True, False, False, True, False]
    assert [r["cts_offset"] for r in got] == [5, 5, -3, -3, -3]


def test_sniff(spark):
    rows = table(spark, ivf([]), box(b"ftyp", b"isom"), bytes.fromhex("12000A01FF"), bytes.fromhex("03020110"), b"xx", b"\xff" * 9)
    got = [r["format"] for r in M.sniff(rows).orderBy("path").collect()]
    assert got == ["ivf", "mp4", "obu", "annexb", "unknown", "unknown"]


def test_mp4_constant_sizes_and_counts(spark):
    n = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", box(b"stsz", n(0, 7, 3)), box(b"stco", n(0, 1, 40, 999)), box(b"stsc", n(0, 1, 1, 3, 1, 9, 9, 9)))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))))
    got = M.mp4_samples(M.boxes(table(spark, data))).orderBy("sample_index").collect()
    assert [(r["size"], r["offset"], r["is_sync"]) for r in got] == [(7, 40, True), (7, 47, True), (7, 54, True)]


def mp4(frames):
    """A file with a sound track, a video track of another codec, and one of AV1 that holds frames."""
    n = lambda *x: struct.pack(f">{len(x)}I", *x)
    entry = lambda codec, *more: box(b"stsd", n(0, 1), box(codec, bytes(24), struct.pack(">HH", 64, 48), bytes(50), *more))
    media = lambda handler, stsd, *stbl: box(b"mdia", box(b"mdhd", n(0, 0, 0, 24000, 0)), box(b"hdlr", n(0, 0), handler, bytes(12)), box(b"minf", box(b"stbl", stsd, *stbl)))
    trak = lambda i, *parts: box(b"trak", box(b"tkhd", n(0, 0, 0, i, 0)), media(*parts))
    head = box(b"ftyp", b"isom") + box(b"mdat", b"".join(frames))
    sizes = box(b"stsz", n(0, 0, len(frames), *map(len, frames)))
    video = trak(9, b"vide", entry(b"av01", box(b"av1C", b"\x81\x04\x0c\x00" + b"\x0a\x01\x00")), sizes, box(b"stco", n(0, 1, 12 + 8)), box(b"stsc", n(0, 1, 1, len(frames), 1)))
    return head + box(b"moov", trak(1, b"soun", entry(b"mp4a")), trak(2, b"vide", entry(b"avc1")), video)


def test_tracks_and_sample_data(spark):
    frames = [bytes.fromhex("1200"), bytes.fromhex("0A03010203"), bytes.fromhex("3202AABB")]
    rows = table(spark, mp4(frames))
    found = M.boxes(rows)
    got = M.tracks(found).orderBy("track").collect()
    assert [(r["track_id"], r["handler"], r["codec"], r["timescale"]) for r in got] == [(1, "soun", "mp4a", 24000), (2, "vide", "avc1", 24000), (9, "vide", "av01", 24000)]
    (av1,) = M.first_av1_track(M.tracks(found)).collect()
    assert (av1["track"], av1["width"], av1["height"], bytes(av1["av1_config"]), bytes(av1["config_obus"])) == (3, 64, 48, b"\x81\x04\x0c\x00\x0a\x01\x00", b"\x0a\x01\x00")
    data = M.mp4_sample_data(rows, M.mp4_samples(found).where("track = 3")).orderBy("sample_index").collect()
    assert [bytes(r["data"]) for r in data] == frames


def test_several_sample_entries(spark):
    """The last entry gives the codec, the av01 entry's own boxes the configuration; the four letters elsewhere do not."""
    n = lambda *x: struct.pack(f">{len(x)}I", *x)
    visual = lambda w, h: bytes(24) + struct.pack(">HH", w, h) + bytes(50)
    file = lambda *entries: box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", n(0, 0), b"vide", bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", n(0, len(entries)), *entries))))))
    plain, av1 = box(b"avc1", visual(8, 8)), box(b"av01", visual(64, 48), box(b"pasp", bytes(4) + b"av1C"), box(b"av1C", b"\x81\x04\x0c\x00\x0a"))
    odd = box(b"av01", bytes(24) + struct.pack(">HH", 64, 48) + bytes.fromhex("0617631430") + bytes(45), box(b"av1C", b"\x81\0\0\0"))
    cut = box(b"av01", visual(1, 1)) + struct.pack(">I4s", 900, b"hvc1")
    rows = table(spark, file(plain, av1), file(av1, plain), file(odd), file(), file(cut))
    got = {r["path"]: r for r in M.tracks(M.boxes(rows)).collect()}
    assert {p: (r["codec"], r["width"], r["av1_config"] and bytes(r["av1_config"])) for p, r in got.items()} == {
        "f0": ("av01", 64, b"\x81\x04\x0c\x00\x0a"), "f1": ("avc1", 8, b"\x81\x04\x0c\x00\x0a"), "f2": ("av01", 64, b"\x81\0\0\0"), "f3": (None, None, None), "f4": ("av01", 1, None),
    }
    assert bytes(got["f0"]["config_obus"]) == b"\x0a" and got["f2"]["config_obus"] is None
    assert [r["path"] for r in M.first_av1_track(M.tracks(M.boxes(rows))).collect() if r["path"] == "f0"] == ["f0"]


def test_probing_walks_the_first_unit(spark):
    unit = lambda kind, *body: bytes([kind << 3 | 2, len(body), *body])
    said = {f"t{k}": unit(k, 0, 0) for k in (1, 2, 3, 4, 5, 6, 7, 8, 15)}
    said |= {"t0": unit(0, 0, 0), "t9": unit(9, 0, 0), "beyond": bytes.fromhex("12FFFFFF7F"), "extension": bytes.fromhex("36080100"), "cut": bytes.fromhex("36080700"), "forbidden": bytes.fromhex("92020000")}
    said |= {"nested": bytes.fromhex("0302 0110"), "deep": bytes.fromhex("8401 8201 80 01") + b"\x10" + bytes(200), "long": bytes.fromhex("0405 0110 00"), "zero": bytes.fromhex("0300 0110"), "sized": bytes.fromhex("0302 0112"), "empty": b"", "short": b"\x12\0", "none": None, "endless": b"\xff" * 40, "mp4": bytes(4) + b"wide"}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in said.items()], "path string, content binary")
    got = {r["path"]: r["format"] for r in M.sniff(rows).collect()}
    want = {k: "obu" for k in said if k[0] == "t" and k not in ("t0", "t9")} | {"extension": "obu", "nested": "annexb", "deep": "annexb", "mp4": "mp4"}
    assert got == {k: want.get(k, "unknown") for k in said}


def test_inspect(spark):
    stream = bytes.fromhex("1200" "0A03010203" "3202AABB")
    rows = table(spark, mp4([stream[:2], stream[2:]]), ivf([stream, stream]), stream, bytes.fromhex("03020110"), b"?" * 9)
    got = {(r["path"], r["format"], r["obu_type"]): r["n"] for r in M.inspect(rows).collect()}
    assert got == {("f0", "mp4", 2): 1, ("f0", "mp4", 1): 1, ("f0", "mp4", 6): 1, ("f1", "ivf", 2): 2, ("f1", "ivf", 1): 2, ("f1", "ivf", 6): 2, ("f2", "obu", 2): 1, ("f2", "obu", 1): 1, ("f2", "obu", 6): 1, ("f3", "annexb", 2): 1, ("f4", "unknown", None): None}


def test_units_round_trip(spark):
    from bitloom.sources import writers

    data = bytes.fromhex("1200" "0A03010203" "36480201FF") + bytes([0x32, 0xC8, 0x01]) + bytes(200)
    read = M.units(spark.createDataFrame([("f", 0, bytearray(data)), ("g", 1, bytearray(b"\x12\x00"))], "path string, sample_index int, data binary"))
    assert {r["path"]: bytes(r["data"]) for r in writers.sample_bytes(read).collect()} == {"f": data, "g": b"\x12\x00"}


def test_video_round_trip_and_comparison(spark):
    from bitloom.sources import writers

    planes = [bytes((7 * k + f) % 256 for k in range(5 * 3 + 2 * 3 * 2)) for f in range(2)]
    data = b"YUV4MPEG2 W5 H3 F30:1 Ip A1:1 C420jpeg\n" + b"".join(b"FRAME\n" + p for p in planes)
    frames = M.y4m_frames(table(spark, data, data[:-1], b"YUV4MPEG2 W5\n", b""))
    assert [(r["path"], r["frame"], len(r["y"]), len(r["u"])) for r in frames.orderBy("path", "frame").collect()] == [("f0", 0, 15, 6), ("f0", 1, 15, 6), ("f1", 0, 15, 6)]
    assert {r["path"]: bytes(r["content"]) for r in writers.y4m_bytes(frames).collect()}["f0"] == data
    assert {r["path"]: bytes(r["content"]) for r in writers.yuv_bytes(frames).collect()}["f0"] == b"".join(planes)
    ppm = bytes(writers.ppm_bytes(frames.where("path = 'f0' and frame = 0")).first()["ppm"])
    clip = lambda x: max(0, min(255, x))
    y, u, v = planes[0][:15], planes[0][15:21], planes[0][21:]
    want = b""
    for i in range(15):
        k = i // 5 // 2 * 3 + i % 5 // 2
        a, b = u[k] - 128, v[k] - 128
        want += bytes([clip(y[i] + (91881 * b + 32768 >> 16)), clip(y[i] - (22554 * a + 46802 * b + 32768 >> 16)), clip(y[i] + (116130 * a + 32768 >> 16))])
    assert ppm == b"P6\n5 3\n255\n" + want
    other = bytearray(data)
    other[data.index(b"FRAME\n") + 6 + 7] ^= 3
    got = {(r["path"], r["frame"], r["plane"]): r for r in M.compare_frames(frames, M.y4m_frames(table(spark, bytes(other)))).collect()}
    r = got["f0", 0, "y"]
    assert len(got) == 6 and (r["samples"], r["differing"], r["first_x"], r["first_y"]) == (15, 1, 2, 1) and r["largest"] in (1, 3)
    assert all(r["differing"] == 0 and r["first_x"] is None for k, r in got.items() if k != ("f0", 0, "y"))
