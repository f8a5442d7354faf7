"""Byte-level BPE encoding and decoding.

A text is cut into words by the pattern. A word's bytes become ids, and Spark's higher-order functions fold the merges
over them: each step joins the leftmost pair with the least rank, found in a literal rank map (pairs of ids to the id
that they merge into, as a perfect hash table in three literal arrays). Decoding concatenates the binary pieces of the ids.

Distinct words are folded once if they are frequent: all words are counted, and the most frequent ones, CACHE at most
and of 64 bytes at most, are encoded first and broadcast. The other words, a few in a hundred, are folded where they stand, each distinct one of
a batch of documents once; so no text and no pair of document and word is ever shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_of

#: Words that are encoded before the documents and broadcast, at most, and their longest.
CACHE = 750_000
LONGEST_CACHED = 64
NONE = 1 << 30


@dataclass(frozen=True)
class Merges:
    """A vocabulary as literals: the id of each byte, the piece of each id, and the perfect hash table of merges.

    The pair (a, b), as a * 65536 + b, lies in slot pmod(xxhash64(pair, shift), len(slots)), where shift is
    shifts[pmod(xxhash64(pair), len(shifts))]; the slot holds pair * 65536 + the id that the pair merges into, or -1.
    """

    byte_ids: tuple[int, ...]
    pieces: tuple[bytes, ...]
    shifts: np.ndarray
    slots: np.ndarray


def _xx(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit numbers, as Spark's xxhash64 of a bigint computes it."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = seed + p[4] + np.uint64(8)
    h = h ^ (rot(value * p[1], 31) * p[0])
    h = rot(h, 27) * p[0] + p[3]
    h = (h ^ (h >> np.uint64(33))) * p[1]
    h = (h ^ (h >> np.uint64(29))) * p[2]
    return h ^ (h >> np.uint64(32))


def _pmod(h: np.ndarray, n: int) -> np.ndarray:
    return (h.view(np.int64) % n).astype(np.int64)


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """Read a file of base64 pieces and ranks; every pair of pieces that together make a piece is a merge."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb").read().splitlines() if line)}
    if max(ranks.values()) > 65535:
        raise ValueError("ids of more than 16 bits do not fit into the merge table")
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    found = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                found[a << 16 | b] = rank
    pairs = np.fromiter(found, np.uint64, len(found))
    held = (pairs << np.uint64(16)).astype(np.int64) + np.fromiter(found.values(), np.int64, len(found))
    first = _xx(pairs, np.full(len(pairs), 42, np.uint64))
    shifts, slots = np.zeros(len(pairs) // 2 + 1, np.int64), np.full(len(pairs) * 3 // 2 + 1, -1, np.int64)
    bucket = _pmod(first, len(shifts))
    size = np.bincount(bucket, minlength=len(shifts))[bucket]
    for n in sorted(set(size.tolist()), reverse=True):  # full buckets first, while many slots are free
        left, shift = np.flatnonzero(size == n), 0
        while len(left):  # a bucket takes the first shift that puts all of its pairs into free slots of their own
            slot = _pmod(_xx(np.full(len(left), shift, np.uint64), first[left]), len(slots))
            wanted = np.bincount(slot, minlength=len(slots))
            bad = np.zeros(len(shifts), bool)
            bad[bucket[left][(slots[slot] >= 0) | (wanted[slot] > 1)]] = True
            good = ~bad[bucket[left]]
            slots[slot[good]] = held[left[good]]
            shifts[bucket[left[good]]] = shift
            left, shift = left[~good], shift + 1
    return Merges(tuple(ranks[bytes([i])] for i in range(256)), tuple(pieces), shifts, slots)


def _literal(values: list, kind: str) -> Column:
    """A literal array, parsed once from text when the plan is made."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Codec:
    """Column expressions of one vocabulary."""

    def __init__(self, merges: Merges) -> None:
        self.byte_ids = _literal(list(merges.byte_ids), "int")
        self.pieces = _literal([base64.b64encode(p).decode() for p in merges.pieces], "binary")
        self.shifts = _literal(merges.shifts.tolist(), "bigint")
        self.slots = _literal(merges.slots.tolist(), "bigint")
        self.n_shifts, self.n_slots = len(merges.shifts), len(merges.slots)

    def ranks(self, pairs: Column) -> Column:
        """For each pair of ids (as one number) the id that they merge into, which is its rank; NONE if they don't."""
        slot = lambda p: F.pmod(F.xxhash64(p, F.get(self.shifts, F.pmod(F.xxhash64(p), F.lit(self.n_shifts)))), F.lit(self.n_slots))
        return F.transform(F.transform(pairs, lambda p: F.struct(p.alias("p"), F.get(self.slots, slot(p)).alias("v"))), lambda x: F.when(F.shiftright(x["v"], 16) == x["p"], x["v"].bitwiseAND(65535).cast("int")).otherwise(F.lit(NONE)))

    def encode(self, word: Column) -> Column:
        """The ids of a word: while a pair merges, the leftmost one of the least rank does."""
        singles = F.transform(F.split(F.decode(word.cast("binary"), "iso-8859-1"), ""), lambda c: F.get(self.byte_ids, F.ascii(c)))
        pair = lambda a, b: F.shiftleft(a.cast("long"), 16) + b

        def fold(ids: Column) -> Column:
            ranks = self.ranks(F.transform(F.slice(ids, 2, F.size(ids)), lambda b, i: pair(F.get(ids, i), b)))
            start = F.struct(ids.alias("ids"), ranks.alias("ranks"))

            def join(s: Column, least: Column, p: Column) -> Column:
                n = F.size(s["ids"])
                left, right = pair(F.get(s["ids"], p - 2), least), pair(least, F.get(s["ids"], p + 1))
                new = F.when((p > 1) & (p + 1 < n), F.array(left, right)).when(p > 1, F.array(left)).when(p + 1 < n, F.array(right)).otherwise(F.array().cast("array<bigint>"))
                return F.struct(
                    F.concat(F.slice(s["ids"], 1, p - 1), F.array(least), F.slice(s["ids"], p + 2, n)).alias("ids"),
                    F.concat(F.slice(s["ranks"], 1, F.greatest(p - 2, F.lit(0))), self.ranks(new), F.slice(s["ranks"], p + 2, n)).alias("ranks"),
                )

            def step(s: Column, _: Column) -> Column:
                return _with(
                    F.array_min(s["ranks"]),
                    lambda least: F.when(F.coalesce(least, F.lit(NONE)) >= NONE, s).otherwise(_with(F.array_position(s["ranks"], least).cast("int"), lambda p: join(s, least, p))),
                )

            return F.aggregate(F.slice(ids, 2, F.size(ids)), start, step, lambda s: s["ids"])

        return _with(singles, fold)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their pieces, one after another; runs of 256 ids first, so that long texts are not copied for each id."""
        join = lambda parts: F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
        runs = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / 256).cast("int"))).otherwise(F.array().cast("array<int>"))
        return join(F.transform(runs, lambda k: join(F.transform(F.slice(ids, 256 * k + 1, F.lit(256)), lambda i: F.get(self.pieces, i)))))


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with a binary column of the bytes that its ids stand for. Null ids: null; no ids: empty; an unknown id: null."""
    return encoded.withColumn(to, F.when(F.col(ids).isNotNull(), Codec(load_merges(path)).decode(F.col(ids))))


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the pattern, with white space and classes as Unicode has them."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(docs: DataFrame, pattern: str, most: int = CACHE) -> DataFrame:
    """The most frequent words of all texts, most at most (as many counts as fit, whole), of LONGEST_CACHED bytes at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([both.field(0), both.field(1)], ["word", "n"])

    parts = docs.select(words_of(text_of(), pattern).alias("words")).mapInArrow(count, "word string, n long")
    counts = parts.where(F.octet_length("word") <= LONGEST_CACHED).groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    least, total = 1, 0
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += words
        if total > most:
            least = n + 1
            break
    return counts.where(F.col("n") >= least).select("word")


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids: ids (array) and decoded (binary) too.

    Null text counts as empty: no ids, hashes of nothing. Special tokens are ordinary text. A null doc_id is kept;
    repeated rows give repeated results; other columns are ignored. Empty input: empty result. A word's cost grows
    with the square of its bytes (slices of arrays), which matters from some ten thousand bytes on.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")  # the driver keeps a text of each plan, literals and all
    codec = Codec(load_merges(path))
    rows = docs.select("doc_id", text_of().alias("text"))

    frequent = frequent_words(rows, pattern, cache).select("word", codec.encode(F.col("word")).alias("ids")).toArrow().combine_chunks()
    words, word_ids = (spark.sparkContext.broadcast(_column(frequent, x)) for x in ("word", "ids"))
    decimals, pieces = (spark.sparkContext.broadcast(x) for x in _by_id(load_merges(path)))
    del frequent

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each batch: ids of documents, their words as places in the broadcast list and the rare words after it."""
        known = words.value
        for batch in batches:
            lists = batch.column(1)
            found = lists.flatten()
            codes = pc.index_in(found, value_set=known)
            rare = found.filter(codes.is_null()).dictionary_encode()
            code = pc.fill_null(codes, 0).to_numpy(zero_copy_only=False).copy()
            code[codes.is_null().to_numpy(zero_copy_only=False)] = rare.indices.to_numpy() + len(known)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([one(batch.column(0)), one(pa.array(offsets, pa.int32())), one(pa.array(code, pa.int32())), one(rare.dictionary)], ["doc_ids", "offsets", "codes", "rare"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, offsets, codes, rare = (batch.column(i)[r].values for i in range(4))
                lists = pa.concat_arrays([word_ids.value, rare.cast(word_ids.value.type)]).take(codes)
                ids, offsets = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py())[offsets.to_numpy()]
                texts, decoded = (_runs(x.value.take(ids), offsets) for x in (decimals, pieces))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                cols = [doc_ids, pa.array(np.diff(offsets), pa.int64()), pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in texts], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                if with_ids:
                    names += ["ids", "decoded"]
                    cols += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids), pa.array([bytes(x) for x in decoded], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    looked = rows.select(F.col("doc_id").cast("long"), words_of(F.col("text"), pattern).alias("words")).mapInArrow(look_up, "doc_ids array<bigint>, offsets array<int>, codes array<int>, rare array<string>")
    folded = looked.select("doc_ids", "offsets", "codes", F.transform("rare", codec.encode).alias("rare"))
    return folded.mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _by_id(merges: Merges) -> tuple[pa.Array, pa.Array]:
    """For each id its decimal text with a blank after it, and its piece."""
    return pa.array([b"%d " % i for i in range(len(merges.pieces))], pa.binary()), pa.array(merges.pieces, pa.binary())


def _runs(values: pa.Array, offsets: np.ndarray) -> list[memoryview]:
    """The bytes of each run of values, which lie one after another in the array's buffer."""
    _, places, data = values.buffers()
    at = np.frombuffer(places, np.int32, len(values) + 1, values.offset * 4)[offsets]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
