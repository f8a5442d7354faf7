import random

from bitloom.operators import syntax as X
from bitloom.sources import media as M

GOLDEN = bytes.fromhex("0A0B00000024CF7F0DBFFF3008")


def bits(data, n):
    return int.from_bytes(data, "big") >> (8 * len(data) - n)


def test_headers_read_and_written():
    """Random bits are read as headers, written from their fields and compared bit by bit, slots included."""
    rng, frames = random.Random(7), 0
    for _ in range(400):
        data = rng.randbytes(80)
        io = X.Reader(data)
        try:
            s = X.sequence(io)
        except ValueError:
            continue
        w = X.Writer(io.values)
        X.sequence(w)
        assert w.at == io.at and bits(w.bytes(False), w.at) == bits(data, io.at)
        slots, written = [None] * 8, [None] * 8
        for j in range(8):
            data = rng.randbytes(X.HEADER_BYTES)
            data = bytes([data[0] & 15 | 16]) + data[1:] if j == 0 else data
            io = X.Reader(data)
            try:
                got = X.frame(io, s, slots)
            except ValueError:
                continue
            w = X.Writer(io.values)
            assert X.frame(w, s, written) == got and slots == written
            assert w.at == io.at and bits(w.bytes(False), w.at) == bits(data, io.at)
            frames += 1
    assert frames > 1500


def test_numbers_near_a_reference():
    for limit, reference in ((4096, 17), (4096, -4096), (256, 256), (256, 0)):
        for x in (-limit, -limit + 1, -1, 0, 1, reference, limit - 1, limit):
            w = X.Writer({"x": x})
            w.near("x", limit, reference)
            assert X.Reader(w.bytes(False)).near("x", limit, reference) == x
    for n in range(1, 40):
        for x in range(n):
            w = X.Writer({"x": x})
            w.ns("x", n)
            assert X.Reader(w.bytes(False)).ns("x", n) == x


def test_assigned_references():
    # Hints 10 to 80 by slot, now 45: behind are slots 0 to 3, ahead 4 to 7.
    hints = [10, 20, 30, 40, 50, 60, 70, 80]
    assert X.assign_references(hints, 45, 7, 3, 0) == [3, 2, 1, 0, 4, 5, 7]
    # Nothing ahead; equal hints: the last slot counts as the latest, the first as the earliest.
    assert X.assign_references([5, 5, 5, 5, 6, 6, 1, 1], 9, 7, 4, 0) == [4, 5, 3, 0, 2, 1, 7]
    assert X.assign_references([9] * 8, 9, 7, 0, 0) == [0, 0, 0, 0, 1, 2, 7]


def key_frame():
    """A shown key frame of 960 x 540 under the golden sequence header, field by field."""
    text = "0" "00" "1" "0" "0" "0" "0000011" "0" "0"  # not repeated, key, shown; update, no screen tools, own size not; hint 3; render size; end update
    text += "1" "0" "0"  # uniform tiles, one column and one row
    text += format(100, "08b") + "0" "0" "0" "0"  # quantizer, no deltas, no matrices
    text += "0" "0"  # segments, changing quantizers
    text += format(12, "06b") + format(13, "06b") + format(5, "06b") + format(6, "06b") + "010" "0"  # loop filter
    text += "01" "00" + format(9, "04b") + "11" + format(2, "04b") + "01"  # damping 4, one pair of strengths
    text += "00" "00" "00"  # no restoration
    return text + "1" "0"  # transforms select, not reduced


def test_full_frame_headers(spark):
    text = key_frame()
    payload = int((text + "1").ljust(-(-len(text + "1") // 8) * 8, "0"), 2).to_bytes(-(-len(text + "1") // 8), "big")
    unit = lambda p: bytes([0x1A, len(p)]) + p
    again, early = b"\x90", payload[:6]
    rows = [("f", 0, bytearray(GOLDEN + unit(payload))), ("f", 1, bytearray(unit(again))), ("f", 2, bytearray(unit(early))), ("f", 3, bytearray(unit(payload))), ("g", 0, bytearray(unit(payload)))]
    units = M.units(spark.createDataFrame(rows, "path string, sample_index int, data binary"))
    headers = X.full_frame_headers(units).cache()
    key, repeated, cut, second = headers.orderBy("path", "sample_index").collect()
    assert (key["width"], key["height"], key["render_width"], key["order_hint"], key["refresh"], key["base_q"]) == (960, 540, 960, 3, 255, 100)
    assert (key["tile_columns"], key["tile_rows"], key["lossless"], key["transform_mode"]) == ([0, 240], [0, 136], False, "SELECT")
    assert (key["filter_levels"], key["filter_deltas"], key["cdef_strengths"]) == ([12, 13, 5, 6], X.FIRST_DELTAS, [[9, 4, 2, 1]])
    assert (key["restorations"], key["header_bits"], key["run"]) == (["NONE"] * 3, len(text), 1)
    assert (repeated["show_existing"], repeated["shown_slot"], repeated["frame_type"], repeated["order_hint"]) == (True, 1, 0, 3)
    assert cut["error"] == "out of data" and cut["fields"] is None and second["run"] == 3
    written = {r["sample_index"]: bytes(r["payload"]) for r in X.frame_header_payloads(headers).collect()}
    assert written[0] == payload and written[3] == payload
    (s,) = X.sequence_payloads(X.sequence_fields(units)).collect()
    assert bytes(s["payload"]) == GOLDEN[2:]
    assert [tuple(r)[3:] for r in X.tiles(headers).orderBy("sample_index").collect()] == [(0, 0, 0, 136, 0, 240)] * 2
    headers.unpersist()
    assert X.full_frame_headers(units.limit(0)).count() == 0
