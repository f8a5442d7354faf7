"""Removal of byte strings that repeat across documents, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through THRESHOLD bytes, by their own bytes, in passes from the most significant digit on (a
digit is eight bytes), and only groups that are still equal and hold several documents go on. Equal groups after the
last digit are exactly the repeated windows; nothing is taken as equal that was not compared byte by byte.

Not every suffix needs to be dealt out. Two windows that agree through the threshold hold the same GRAM bytes at the
same place (the largest of the strings inside by a hash that only serves to choose: an anchor), so it is enough to
order the suffixes that begin at anchors, one place in about sixteen, and then the windows around those still equal:

1. In a task's batch, anchors are ordered by their GRAM bytes. Where several documents of the batch share them, the
   surroundings are ordered as well, and windows that repeat a smaller document of the batch are settled at once.
2. The other anchors are dealt out by their GRAM bytes, ordered by them, and leave if one document alone has them.
3. What is left is dealt out once more with all bytes that a window around the anchor can hold. Equal surroundings are
   settled first; for what is left, the windows at each offset are ordered through all of their bytes.

A GRAM that very many places share is dealt out by the bytes beside it too: every window around it holds 15 more on
its right or 16 more on its left, so the places go once to the group of the one and once to that of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_of

THRESHOLD = 50
GRAM = 20
#: Bytes of text that a task works on at once, and that one group of the sort holds the anchors of.
BATCH = 2_000_000
GROUP = 8_000_000
#: Groups of the sort, at least, so that small inputs are spread as well.
LEAST_GROUPS = 96
#: Anchors with equal GRAM bytes from which on these are dealt out by the bytes beside them as well.
HOT = 2_000
#: The same in one batch, after equal surroundings are settled.
HOT_IN_BATCH = 64
RANGES, PLACES = 1, 2
FOUND = "doc_id long, kind int, data binary"
DEALT = "digit long, n int, data binary"
PLACE = np.dtype([("at", "<u4"), ("hot", "u1")])
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _MIX[k]
    x ^= x >> np.uint64(32)
    return x


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of width values."""
    have, size = x, 1
    while 2 * size <= width:
        have, size = pick(have[:-size], have[size:]), 2 * size
    return pick(have[: len(x) - width + 1], have[width - size : width - size + len(x) - width + 1]) if size < width else have


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of integers or byte strings, byte plane by byte plane, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns as arrays of shape (n, width) of bytes."""
    data, out, at = pa.decompress(data, decompressed_size=n * sum(widths), codec="zstd", asbytes=True), [], 0
    for width in widths:
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T))
        at += n * width
    return out


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a run of rows with equal columns begins."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _digit(rows: np.ndarray, at: int) -> np.ndarray:
    """The eight bytes from place at on of rows of bytes, as numbers in the order of the bytes."""
    return np.ascontiguousarray(rows[:, at : at + 8]).view(">u8").reshape(-1).astype(np.uint64)


def _digits(begin: int, end: int) -> list[int]:
    """Where the digits of the bytes from begin to end begin; the last one may overlap the one before."""
    return [*range(begin, end - 8, 8), end - 8]


def radix_pass(rows: np.ndarray, group: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One digit further: rows in order of group and key, with their new group; groups of one document leave."""
    order = np.lexsort((key, group))
    rows, group, key = rows[order], group[order], key[order]
    if not len(rows):
        return rows, group
    new = _runs(group, key)
    group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
    d = doc[rows]
    several = (np.minimum.reduceat(d, begins) < np.maximum.reduceat(d, begins))[group]
    return rows[several], group[several]


def still_equal(context: np.ndarray, digits: list[int], rows: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passes over all digits; only what is still equal to another document's bytes is carried from one to the next."""
    for at in digits:
        if len(rows):
            rows, group = radix_pass(rows, group, _digit(context[rows], at), doc)
    return rows, group


def _repeats(rows: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows in groups, those whose group also holds a smaller document."""
    d = doc[rows]
    smallest = np.minimum.reduceat(d, np.flatnonzero(_runs(group)))[np.unique(group, return_inverse=True)[1]] if len(rows) else d
    return rows[d > smallest]


def _by_document(doc: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each document with its columns' values, interleaved, as binary."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    width = sum(c.itemsize for c in columns)
    data = np.concatenate([np.ascontiguousarray(c[order]).view(np.uint8).reshape(len(c), -1) for c in columns], axis=1).tobytes() if len(doc) else b""
    begins = np.flatnonzero(_runs(doc)) if len(doc) else np.empty(0, int)
    offsets = np.append(begins, len(doc)) * width
    blobs = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc[begins], pa.int64()), pa.array(np.full(len(begins), kind, np.int32)), blobs], ["doc_id", "kind", "data"])


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, those that touch made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start.astype(np.uint32), end.astype(np.uint32)
    # Documents are set apart by more than any place, so that one running maximum serves them all.
    apart = np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 33
    reach = np.maximum.accumulate(end + apart)
    new = np.append(True, (start + apart)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], start[new].astype(np.uint32), (reach - apart)[last].astype(np.uint32)


class Anchors:
    """The anchors of some texts: doc and at (its place in the text), and the bytes around it."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray, at: np.ndarray, threshold: int) -> None:
        self.data, self.text, self.at, self.threshold, self.span = data, text, at, threshold, threshold - GRAM + 1
        self.where = begin[text] + at
        self.left, self.right = np.minimum(at, self.span - 1), np.minimum(size[text] - at, threshold)

    def gram_digits(self, of: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        w = np.lib.stride_tricks.sliding_window_view(self.data, GRAM)[self.where[of]]
        return [_digit(w, k) for k in _digits(0, GRAM)]

    def context(self, of: np.ndarray) -> np.ndarray:
        """The span - 1 bytes before the anchor and threshold from it on; zeros stand for what lies beyond the text."""
        width = self.span - 1 + self.threshold
        rows = np.lib.stride_tricks.sliding_window_view(self.data, width)[self.where[of] - (self.span - 1)].copy()
        k = np.arange(width)
        rows[(k < (self.span - 1 - self.left[of])[:, None]) | (k >= (self.span - 1 + self.right[of])[:, None])] = 0
        return rows


def anchors_of(texts: list[bytes], threshold: int) -> Anchors:
    """The anchors of all windows of threshold bytes: in each the string of GRAM bytes with the largest hash."""
    span = threshold - GRAM + 1
    gap = b"\0" * (threshold + 8)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = len(gap) + np.concatenate([[0], np.cumsum(size + len(gap))[:-1]]).astype(np.int64)
    w = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    g = _mix(w, 0)[: len(w) - 12]
    g += _mix(w[8:], 1)[: len(g)]
    g ^= g >> np.uint64(29)
    g += _mix(w[12:], 2)
    g = _mix(g, 3)
    g ^= g >> np.uint64(29)
    g |= np.uint64(1)
    most = _sliding(g, span, np.maximum)
    inside = np.zeros(len(most) + 1, np.int8)
    fits = size >= threshold
    inside[begin[fits]] += 1
    inside[begin[fits] + size[fits] - threshold + 1] -= 1
    # A place is an anchor if its hash is the largest of some window: the smallest of the largest that it lies in.
    most[np.cumsum(inside[:-1], dtype=np.int8) == 0] = ~np.uint64(0)
    edge = np.full(span - 1, ~np.uint64(0))
    least = _sliding(np.concatenate([edge, most, edge]), span, np.minimum)[: len(g)]
    where = np.flatnonzero(g[: len(least)] == least)
    text = np.searchsorted(begin, where, side="right") - 1
    return Anchors(data, begin, size, text, where - begin[text], threshold)


def settle(doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (in groups of equal GRAM bytes) whose whole surroundings repeat a smaller document's, and the rest.

    Of equal surroundings, those of the smallest document stand for all in what follows.
    """
    rows = np.arange(len(doc))
    rows, group = radix_pass(rows, group, left.astype(np.uint64) * np.uint64(256) + right.astype(np.uint64), doc)
    repeats = _repeats(*still_equal(context, _digits(0, context.shape[1]), rows, group, doc), doc)
    rest = np.ones(len(doc), bool)
    rest[repeats] = False
    return repeats, np.flatnonzero(rest)


def _passed_on(kind: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows by document as one dealt row of digit -kind, if there are any."""
    part = _by_document(doc, kind, *columns)
    if not part.num_rows:
        return []
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_batch(part)
    return [(-kind, part.num_rows, sink.getvalue().to_pybytes())]


def _first_pass(threshold: int, groups: int):
    """Batches of (doc_id, text) to dealt anchors (digit >= 0); what the batch itself finds, by document, has digit -kind."""

    def batch_of(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc_ids = np.array(ids, np.int64)
        found = anchors_of(texts, threshold)
        if not len(found.at):
            return
        doc, words = doc_ids[found.text], found.gram_digits()
        order = np.lexsort(words[::-1])
        new = _runs(*(w[order] for w in words))
        group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        several = (np.minimum.reduceat(doc[order], begins) < np.maximum.reduceat(doc[order], begins))[group]
        shared, of = order[several], group[several]
        out: list[tuple[int, int, bytes]] = []
        left_over = np.ones(len(order), bool)
        if len(shared):
            repeats, rest = settle(doc[shared], found.at[shared], found.left[shared], found.right[shared], found.context(shared), of, threshold)
            left_over[np.flatnonzero(several)[repeats]] = False
            r = shared[repeats]
            out += _passed_on(RANGES, *_merged(doc[r], found.at[r] - found.left[r], found.at[r] + found.right[r]))
        # Where very many are left, it is settled that others are to meet them as hot; one of them tells so.
        many = left_over & (np.bincount(group[left_over], minlength=len(begins))[group] >= HOT_IN_BATCH) & several
        r = order[many]
        out += _passed_on(PLACES, doc[r], found.at[r].astype(np.uint32), np.ones(len(r), np.uint8))
        told = np.zeros(len(order), np.uint8)
        told[np.flatnonzero(many)[_runs(group[many])]] = 1
        go = (left_over & ~many) | (told > 0)
        rows, told = order[go], told[go]
        digit = _group_of(words, rows, groups)
        by = np.argsort(digit, kind="stable")
        digit, rows, told = digit[by], rows[by], told[by]
        for lo, hi in zip(cuts := np.flatnonzero(_runs(digit)), np.append(cuts[1:], len(rows)), strict=True):
            o = rows[lo:hi]
            out.append((int(digit[lo]), int(hi - lo), _pack(*(w[o].astype(">u8") for w in words), doc[o], found.at[o].astype(np.uint32), told[lo:hi])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["digit", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if held and held + len(text) > BATCH:
                    yield from batch_of(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield from batch_of(ids, texts)

    return run


def _group_of(words: list[np.ndarray], rows: np.ndarray, groups: int) -> np.ndarray:
    """The group that bytes are dealt to, even where many begin alike."""
    h = np.zeros(len(rows), np.uint64)
    for k, w in enumerate(words):
        h = _mix(h ^ _mix(w[rows], k % 3), 3)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _second_pass(table: pa.Table) -> pa.Table:
    """All anchors of one group: those whose GRAM bytes several documents hold, by document."""
    blobs, sizes = table.column("data").to_pylist(), table.column("n").to_pylist()
    if table.column("digit")[0].as_py() < 0:
        return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs])
    n_words = len(_digits(0, GRAM))
    parts = [_unpack(d, n, (*[8] * n_words, 8, 4, 1)) for d, n in zip(blobs, sizes, strict=True)]
    *words, doc, at, told = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    words = [w.view(">u8").reshape(-1).astype(np.uint64) for w in words]
    doc, at, told = doc.view("<i8").reshape(-1), at.view("<u4").reshape(-1), told.reshape(-1)
    rows, group = np.arange(len(doc)), np.zeros(len(doc), np.int64)
    others = doc.copy()
    for w in words:  # an anchor that tells of many counts as several documents
        order = np.lexsort((w[rows], group))
        rows, group = rows[order], group[order]
        new = _runs(group, w[rows]) if len(rows) else np.empty(0, bool)
        group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        if len(rows):
            d = others[rows]
            several = (np.minimum.reduceat(d, begins) < np.maximum.reduceat(d, begins)) | (np.maximum.reduceat(told[rows], begins) > 0)
            rows, group = rows[several[group]], group[several[group]]
    hot = (np.bincount(group)[group] >= HOT) | (np.bincount(group, weights=told[rows])[group] > 0) if len(group) else np.empty(0, bool)
    ask = told[rows] == 0
    return pa.Table.from_batches([_by_document(doc[rows[ask]], PLACES, at[rows[ask]], hot[ask].astype(np.uint8))])


def _contexts(threshold: int, groups: int):
    """Batches of (doc_id, text, blobs of places) to dealt surroundings: all that a window around an anchor can hold."""
    span = threshold - GRAM + 1
    right = (span - 1) // 2
    #: By part, the bytes that it is dealt by: GRAM alone, and for hot ones with those on the right or on the left.
    keys = {0: (span - 1, span - 1 + GRAM), 1: (span - 1, span - 1 + GRAM + right), 2: (span - 1 - (right + 1), span - 1 + GRAM)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, text, places = [], [], [], []
            for doc_id, data, blobs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                both = np.frombuffer(b"".join(blobs), PLACE)
                both = both[both["at"].astype(np.int64) + GRAM <= len(data or b"")]
                docs.append(doc_id)
                texts.append(data or b"")
                text.append(np.full(len(both), len(texts) - 1))
                places.append(both)
            both, text = np.concatenate(places), np.concatenate(text)
            gap = b"\0" * (threshold + 8)
            data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
            size = np.array([len(t) for t in texts], np.int64)
            begin = len(gap) + np.concatenate([[0], np.cumsum(size + len(gap))[:-1]]).astype(np.int64)
            out: list[tuple[int, int, bytes]] = []
            for lo in range(0, len(both), 100_000):
                of = slice(lo, lo + 100_000)
                found = Anchors(data, begin, size, text[of], both["at"][of].astype(np.int64), threshold)
                context, doc, hot = found.context(np.arange(len(found.at))), np.array(docs, np.int64)[text[of]], both["hot"][of] > 0
                for part, (a, b) in keys.items():
                    rows = np.flatnonzero(hot if part else ~hot)
                    if not len(rows):
                        continue
                    digit = _group_of([_digit(context, k) for k in _digits(a, b)], rows, groups)
                    by = np.argsort(digit, kind="stable")
                    digit, rows = digit[by], rows[by]
                    for i, j in zip(cuts := np.flatnonzero(_runs(digit)), np.append(cuts[1:], len(rows)), strict=True):
                        o = rows[i:j]
                        columns = doc[o], found.at[o].astype(np.uint32), found.left[o].astype(np.uint8), found.right[o].astype(np.uint8), np.full(len(o), part, np.uint8)
                        out.append((int(digit[i]), len(o), _pack(*columns, context[o])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["digit", "n", "data"])

    return run


def _last_pass(threshold: int):
    """All surroundings of one group: the ranges of windows that a smaller document holds too."""
    span = threshold - GRAM + 1
    width, middle = span - 1 + threshold, span - 1
    right = (span - 1) // 2

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(d, n, (8, 4, 1, 1, 1, width)) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
        doc, at, left, beyond, part, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        doc, at, left, beyond, part = doc.view("<i8").reshape(-1), at.view("<u4").reshape(-1).astype(np.int64), left.reshape(-1).astype(np.int64), beyond.reshape(-1).astype(np.int64), part.reshape(-1)
        rows, group = still_equal(context, _digits(middle, middle + GRAM), np.arange(len(doc)), part.astype(np.int64), doc)
        docs, starts, ends = [], [], []
        if len(rows):
            repeats, rest = settle(doc[rows], at[rows], left[rows], beyond[rows], context[rows], group, threshold)
            r = rows[repeats]
            docs.append(doc[r])
            starts.append(at[r] - left[r])
            ends.append(at[r] + beyond[r])
            rows, group = rows[rest], group[rest]
        # Windows at small offsets hold the bytes on the right, the others those on the left: what shares neither leaves.
        for sides, digits, offsets in (((0, 1), _digits(middle + GRAM - 1, middle + GRAM + right), range(right + 1)), ((0, 2), _digits(middle - right - 1, middle), range(right + 1, span))):
            side = np.isin(part[rows], sides)
            near, of = still_equal(context, digits, rows[side], group[side], doc)
            for offset in offsets:
                fits = (left[near] >= offset) & (beyond[near] >= threshold - offset)
                r = _repeats(*still_equal(context, _digits(middle - offset, middle - offset + threshold), near[fits], of[fits], doc), doc)
                docs.append(doc[r])
                starts.append(at[r] - offset)
                ends.append(at[r] - offset + threshold)
        doc, start, end = _merged(np.concatenate(docs), np.concatenate(starts), np.concatenate(ends))
        return pa.Table.from_batches([_by_document(doc, RANGES, start, end)])

    return run


def find_repeats(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(doc_id, kind, data): byte ranges of each text that repeat threshold bytes of a document with a smaller id.

    docs has the columns key (long, not null) and text first; others are carried to the join of the last pass, so that
    it can share its exchange with a join of docs on doc_id that follows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_of().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(max(LEAST_GROUPS, total // GROUP))
    dealt = rows.where(F.octet_length("text") >= threshold).mapInArrow(_first_pass(threshold, groups), DEALT)
    # What batches found has a digit below 0; it is spread by numbers of its own.
    dealt = dealt.withColumn("digit", F.when(F.col("digit") < 0, -1 - F.pmod(F.xxhash64("data"), F.lit(groups))).otherwise(F.col("digit")))
    found = materialize(dealt.groupBy("digit").applyInArrow(_second_pass, FOUND))
    unclear = found.where(F.col("kind") == PLACES).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("data").alias("__blobs"))
    contexts = docs.join(unclear, key).select(key, "text", "__blobs", *docs.columns[2:]).mapInArrow(_contexts(threshold, groups), DEALT)
    return found.where(F.col("kind") == RANGES).unionByName(contexts.groupBy("digit").applyInArrow(_last_pass(threshold), FOUND))


def covered(found: list[dict], size: int) -> np.ndarray:
    """Begin and end of the maximal removed runs of a text of size bytes, as rows of an array."""
    if not found:
        return np.empty((0, 2), np.int64)
    both = np.minimum(np.frombuffer(b"".join(x["data"] for x in found), "<u4").astype(np.int64).reshape(-1, 2), size)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.append(True, both[1:, 0] > reach[:-1])
    return np.stack([both[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(both)) - 1]], 1)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text: all columns of docs instead, the text cut.

    Null text counts as empty (with_text: stays null). A null doc_id: nothing is removed, and nothing elsewhere for
    its sake. Rows with one doc_id are one document: equal texts lose the same bytes; of different texts under one id
    each also loses, as far as it reaches, what is found in the others. Equal texts under different ids: all but the
    smallest id's are removed wholly, if they have threshold bytes. A cut inside a character drops that character's
    rest from the returned text. A text of any length is worked on whole, at some fifty bytes of memory for each of
    its bytes. Other columns are kept or ignored, whatever their names. Empty input: empty result.
    """
    arrow_batches(docs.sparkSession, 500)
    names = docs.columns if with_text else ["doc_id"]
    rest = [c for c in names if c != "text"]
    known = docs.where("doc_id is not null")
    rows = known.select(F.col("doc_id").cast("long").alias("__id"), "text", *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])
    lists = find_repeats(rows, threshold, "__id").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("kind", "data")).alias("__found"))
    renamed = [F.col(f"__{i}").alias(c) for i, c in enumerate(rest)]
    rows = rows.join(lists, "__id", "left").select(*renamed, "text", "__found")
    rows = rows.union(docs.where("doc_id is null").select(*rest, "text", F.lit(None).cast("array<struct<kind:int,data:binary>>")))
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, texts = [], [], [], [], []
            for text, found in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                data = text or b""
                runs = covered(found or [], len(data))
                runs = runs[runs[:, 1] > runs[:, 0]]
                cuts = [0, *runs.ravel().tolist(), len(data)]
                kept = b"".join(data[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2)) if len(runs) else data
                if with_text:
                    texts.append(None if text is None else kept.decode("utf-8", "ignore"))
                else:
                    sizes.append(len(data))
                    removed.append(len(data) - len(kept))
                    spans.append(len(runs))
                    digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                at_name = {c: batch.column(i) for i, c in enumerate(rest)} | {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([at_name[c] for c in names], names)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    if with_text:
        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
