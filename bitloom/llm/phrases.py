"""Phrase collocations: n-grams of words by FM-indexes per shard, summed across shards.

A shard is a bounded number of words of one language in one task. Its index holds the words' rotations ordered by
their first DEPTH words, forwards and backwards; a phrase is an interval in both orders. Extending an interval to the
left or right by every word that stands there gives the longer phrases with their counts, so that all n-grams of a
shard up to DEPTH come from DEPTH - 1 extensions of all intervals at once. Counts of shards are summed by Spark, with
no cut before the sum: what is rare in a shard may be frequent in all.

Longer phrases are extended only where both of their parts can be frequent. What is frequent is handed to the second
pass as a Bloom filter of fixed size (FILTER_BITS): it lets through too much, never too little, so counts stay exact
at every size.

Null texts are empty, null languages `und`; repeated rows count again; an empty table gives no rows. A long text is
cut between pieces into several shards, since no phrase crosses pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DEPTH = 3
#: Words of a shard, about: it is closed after the text or stretch of text that reaches this number.
SHARD_WORDS = 200_000
#: Bytes of a long text that are cut into words at once, up to the end of a piece.
STRETCH = 2_000_000
#: Bits of the filter of frequent pairs: 8 MB.
FILTER_BITS = 1 << 26
#: Copies of each part's row in the look-up of parts, so that a part in many phrases is no single task.
SALTS = 16

#: A-Z to a-z, ends of pieces to a byte that UTF-8 never holds, tabs to blanks.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(_ENDS))


def _order(keys: list[np.ndarray], bits: int) -> np.ndarray:
    """Places in the order of the keys, the first one leading."""
    if bits * len(keys) <= 63:
        packed = keys[0].astype(np.int64)
        for k in keys[1:]:
            packed = packed << bits | k
        return np.argsort(packed, kind="stable")
    return np.lexsort(keys[::-1])


class Side:
    """One direction of a shard's index: the word before each rotation, and where that word's rotation stands."""

    def __init__(self, ids: np.ndarray, n_words: int):
        bits = max(1, int(n_words - 1).bit_length())
        order = _order([np.roll(ids, -k) for k in range(DEPTH)], bits)
        self.before = ids[order - 1]
        place = np.empty(len(ids), dtype=np.int64)
        place[np.argsort(self.before, kind="stable")] = np.arange(len(ids))
        self.place = place


class Intervals:
    """Phrases of one length: their words, how often they occur, and where their intervals begin in both orders."""

    def __init__(self, words: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.words, self.count, self.left, self.right = words, count, left, right

    def keep(self, which: np.ndarray) -> Intervals:
        return Intervals(self.words[which], self.count[which], self.left[which], self.right[which])


class Index:
    """A two-way FM-index of a shard: numbered words, 0 standing between pieces and at the end."""

    def __init__(self, ids: np.ndarray, n_words: int):
        self.n_words = n_words
        self.forward, self.backward = Side(ids, n_words), Side(ids[::-1].copy(), n_words)
        count = np.bincount(ids, minlength=n_words)
        begins = np.cumsum(count) - count
        present = np.flatnonzero(count[1:]) + 1
        self.singles = Intervals(present[:, None], count[present], begins[present], begins[present])

    def extend(self, of: Intervals, to_left: bool) -> Intervals:
        """Every phrase with one word more on that side. The order of the other side is kept in step."""
        side, begin, other = (self.forward, of.left, of.right) if to_left else (self.backward, of.right, of.left)
        owner = np.repeat(np.arange(len(begin)), of.count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(of.count) - of.count, of.count) + np.repeat(begin, of.count)
        word = side.before[at].astype(np.int64)
        order = np.argsort(owner * self.n_words + word, kind="stable")
        owner, at, word = owner[order], at[order], word[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        owner, word = owner[first], word[first]
        # The smallest place of a word within an interval leads to where the longer phrase begins; on the other side it
        # begins after all phrases that have a smaller word here.
        extended = side.place[at[first]]
        opens = np.ones(len(owner), dtype=bool)
        opens[1:] = owner[1:] != owner[:-1]
        kept = other[owner] + (first - first[np.maximum.accumulate(np.where(opens, np.arange(len(owner)), 0))])
        words = np.column_stack([word, of.words[owner]] if to_left else [of.words[owner], word])
        out = Intervals(words, count, *((extended, kept) if to_left else (kept, extended)))
        return out.keep(word > 0)


def _stretches(text: str) -> Iterator[bytes]:
    """A text's bytes, folded, in stretches that end where a piece ends."""
    folded, at = text.encode().translate(_FOLD), 0
    while len(folded) - at > STRETCH:
        end = folded.find(b"\xff", at + STRETCH)
        if end < 0:
            break
        yield folded[at:end]
        at = end + 1
    yield folded[at:] if at else folded


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, distinct words from 1 on, numbered words) of each shard; batches are (lang, text)."""
    held: dict[str, list[bytes]] = {}

    def close(lang: str) -> tuple[str, list[bytes], np.ndarray]:
        # The mark between pieces opens every shard and so is number 0.
        coded = pa.array(held.pop(lang), pa.binary()).dictionary_encode()
        return lang, coded.dictionary.to_pylist()[1:], coded.indices.to_numpy()

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            for stretch in _stretches(text or ""):
                words = held.setdefault(lang, [b"\xff"])
                words += stretch.replace(b"\xff", b" \xff ").split()
                words.append(b"\xff")
                if len(words) >= SHARD_WORDS:
                    yield close(lang)
    for lang in list(held):
        yield close(lang)


def _rows(lang: str, names: pa.Array, found: Intervals) -> pa.RecordBatch:
    columns = [names.take(pa.array(found.words[:, k])) for k in range(found.words.shape[1])]
    phrase = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
    n = len(found.count)
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(n, dtype=np.int64))), phrase, pa.array(found.count, pa.int64())], ["lang", "phrase", "n"])


def _names(words: list[bytes]) -> pa.Array:
    return pa.array([b"", *words], pa.binary()).cast(pa.string())


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def _pair_bits(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Two bits of the filter for each pair of words' hashes."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second << np.uint64(31) | second >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return [mixed >> np.uint64(38) & np.uint64(FILTER_BITS - 1), mixed & np.uint64(FILTER_BITS - 1)]


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs of words, and as an empty phrase the number of all words."""
    for lang, words, ids in _shards(batches):
        index, names = Index(ids, len(words) + 1), _names(words)
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([""], pa.string()), pa.array([int((ids > 0).sum())], pa.int64())], ["lang", "phrase", "n"])
        yield _rows(lang, names, index.singles)
        yield _rows(lang, names, index.extend(index.singles, to_left=False))


def _long(frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of three words up to DEPTH whose pairs of neighbouring words all pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(frequent.value, dtype=np.uint8)
        for lang, words, ids in _shards(batches):
            index, names = Index(ids, len(words) + 1), _names(words)
            hashes = _hashes([b"", *words], lang)

            def passes(found: Intervals) -> np.ndarray:
                ok = np.ones(len(found.count), dtype=bool)
                for bit in _pair_bits(hashes[found.words[:, 0]], hashes[found.words[:, 1]]):
                    ok &= (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                return ok

            found = index.extend(index.singles, to_left=False)
            found = found.keep(passes(found))
            for _ in range(2, DEPTH):
                found = index.extend(found, to_left=True)
                found = found.keep(passes(found))
                yield _rows(lang, names, found)

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, bits): the filter's words of 64 bits that these pairs (lang, phrase) set."""
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for batch in batches:
        by: dict[str, list[list[bytes]]] = {}
        for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault(lang, []).append(phrase.encode().split(b" "))
        for lang, pairs in by.items():
            first, second = (_hashes([p[k] for p in pairs], lang) for k in (0, 1))
            for bit in _pair_bits(first, second):
                np.bitwise_or.at(table, (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7))).astype(np.uint8))
    slots = table.view(np.int64)
    at = np.flatnonzero(slots)
    for k in range(0, len(at), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 10_000], pa.int32()), pa.array(slots[at[k : k + 10_000]], pa.int64())], ["slot", "bits"])


def _filter_of(pairs: DataFrame):
    """A broadcast filter of FILTER_BITS bits; its size does not depend on the data."""
    slots = pairs.coalesce(8).mapInArrow(_bits, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(table.tobytes())


def count_phrases(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n, words): single words, and all phrases up to DEPTH words, that occur least times or more.

    The empty phrase (of no words) has the number of all words of a language, if there are least or more.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = lambda df: df.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    rows = "lang string, phrase string, n long"
    short = materialize(total(texts.mapInArrow(_short, rows)).withColumn("words", words))
    frequent = _filter_of(short.where("words = 2").select("lang", "phrase"))
    long = materialize(total(texts.mapInArrow(_long(frequent), rows)).withColumn("words", words))
    return short.unionByName(long)


def _cut(phrase: Column, upto: Column | int | None, begin: int = 1) -> Column:
    words = F.split(phrase, " ")
    return F.array_join(F.slice(words, F.lit(begin), F.size(words) if upto is None else (F.lit(upto) if isinstance(upto, int) else upto)), " ")


def score_phrases(counted: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score): candidates of count_phrases by their lowest-scoring cut.

    Left out: those within a longer candidate that occurs at least share percent as often. Products are decimals of 38 digits: exact for counts below 10^15.
    """
    salt = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SALTS)).cast("int")
    found = counted.where(F.col("words") >= 2).select("lang", "phrase", F.col("n").alias("a"), "words")
    within = found.where(F.col("words") > 2).select("lang", F.explode(F.array(_cut(F.col("phrase"), F.size(F.split("phrase", " ")) - 1), _cut(F.col("phrase"), None, 2))).alias("phrase"), "a")
    longest = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = found.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    parts = counted.where(F.col("words").between(1, DEPTH - 1)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _cut(F.col("phrase"), k).alias("p0"), F.array_join(F.slice(F.split("phrase", " "), k + 1, F.col("words")), " ").alias("p1")))
    rows = found.select("*", salt.alias("salt"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "words", "salt", "c.*")
    for k, name in enumerate("lr"):
        rows = rows.join(parts.select("lang", F.col("part").alias(f"p{k}"), "salt", F.col("f").alias(name)), ["lang", f"p{k}", "salt"])
    exact = rows.withColumn("score", F.expr("cast(cast(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)"))
    best = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def mine_collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first phrases of 2 to 3 words by score, then count, then the phrase: lang, rank, phrase, a, l, r, n, score."""
    counted = count_phrases(docs, least)
    totals = counted.where("words = 0").select("lang", "n")
    scored = score_phrases(counted, share).join(totals, "lang")
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
