from bitloom.operators.headers import frame_headers
from bitloom.sources import reports

from .test_media import ivf, mp4, table


def test_summary_and_lines(spark):
    """Files of four formats, one broken in its second sample, one of no format."""
    head, key, shown = bytes.fromhex("0A0B00000024CF7F0DBFFF3008"), bytes.fromhex("320210AA"), bytes.fromhex("320230BB")
    stream = b"\x12\x00" + head + key
    files = [mp4([stream, b"\x12\x00" + shown]), ivf([stream, b"\x12\x00" + shown, b"\x32\x09\x00"]), stream, bytes.fromhex("03020110"), b"?" * 9]
    rows = table(spark, *files)
    units = reports.file_units(rows).cache()
    told = reports.summary(rows, units).cache()
    got = {r["path"]: r for r in told.collect()}
    assert {p: (r["format"], r["samples"], r["sync_samples"], r["broken"]) for p, r in got.items()} == {
        "f0": ("mp4", 2, 2, 0), "f1": ("ivf", 3, None, 1), "f2": ("obu", 1, None, 0), "f3": ("annexb", 1, None, 0), "f4": ("unknown", None, None, None),
    }
    assert got["f1"]["units"] == {"SEQUENCE_HEADER": 1, "TEMPORAL_DELIMITER": 2, "FRAME": 2} and got["f3"]["units"] == {"TEMPORAL_DELIMITER": 1}
    assert got["f2"]["frames"] == {"KEY_FRAME": 1} and sum(got["f1"]["frames"].values()) == 2
    assert got["f2"]["width"] is not None and got["f2"]["bit_depth"] == 8 and got["f3"]["width"] is None
    lines = [(r["path"], r["line"]) for r in reports.lines(rows, 2, units, told).orderBy("path", "place").collect()]
    assert ("f4", "format unknown") in lines and sum(p == "f4" for p, _ in lines) == 1
    f1 = [line for p, line in lines if p == "f1"]
    assert f1[0] == "format ivf" and f1[1].startswith("sequence: profile 0, ") and f1[2] == "samples 3" and f1[3] == "units: FRAME 2, SEQUENCE_HEADER 1, TEMPORAL_DELIMITER 2"
    assert "sample 1: FRAME, 2 bytes" in f1 and f1[-1].startswith("sample 2 is broken at 0: payload of 9 bytes")
    assert [line for p, line in lines if p == "f0"][2] == "samples 2, sync 2"
    frames = frame_headers(units.where("error is null"))
    assert [r["shown_index"] for r in reports.first_frames(frames.where("path = 'f1'"), 1).collect()] == [0]
    told.unpersist()
    units.unpersist()
