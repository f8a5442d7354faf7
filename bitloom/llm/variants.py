"""Spelling variants: words that are one edit apart, found by blocked Gram matrices of letter counts.

An inserted, deleted or replaced letter moves a word's vector of letter counts by a squared distance of 1 or 2. Words
are cut into blocks by their length and by how many of their letters fall into each of a few classes; an edit moves
one letter in, out or between classes, so only neighbouring blocks of equal or adjacent length can hold near words. A
tile is a part of one block against a part of its neighbours: NumPy multiplies the two count matrices, keeps pairs at
a squared distance of two at most and verifies their edit. Large blocks are cut into parts of bounded size by a hash,
so that a tile is bounded and no pair is lost.

Null texts count as empty and give no words; repeated rows count again; an empty table gives no rows. A null doc_id
counts as the empty string before the colon. A very long word is a row like any other: parts are bounded by bytes too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What is lower-cased of a text, and the letters of its words then.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
CLASSES = 4
#: Words of a tile's side, and bytes of it; a side is a block's part, of about so many.
SIDE, SIDE_BYTES = 1024, 4_000_000
#: Pairs that are verified at once.
VERIFIED = 100_000

_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[[ord(c) for c in LETTERS]] = range(len(LETTERS))


def word_counts(docs: DataFrame, least_length: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased, of at least so many code points and occurrences.

    With h the CRC-32 of `<doc_id>:<run>`, a run for which h is a multiple of every loses its letter h mod length.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    runs = docs.select(doc.alias("d"), F.explode(found).alias("r")).select("r", F.crc32(F.concat_ws(":", "d", "r").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("r")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.expr("substring(r, 1, cast(pmod(h, length(r)) as int))"), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _block(word: Column) -> Column:
    """How many letters of each class a word has; their sum is its length."""
    return F.array(*[F.length(word) - F.length(F.translate(word, LETTERS[k::CLASSES], "")) for k in range(CLASSES)])


def _homes(block: Column) -> Column:
    """The blocks that a block's words visit: its own, those of words that lack one letter, and those with one letter in a later class instead."""
    moved = lambda i, j: F.transform(block, lambda c, k: c - F.when(k == i, 1).otherwise(0) + F.when(k == (-1 if j is None else j), 1).otherwise(0))
    others = [F.when(block[i] > 0, moved(i, j)) for i in range(CLASSES) for j in (None, *range(i + 1, CLASSES))]
    return F.concat(F.array(block), F.filter(F.array(*others), lambda b: b.isNotNull()))


def _parts(n: Column, block: Column) -> Column:
    """Parts of a side of n words: bounded by words and by their bytes."""
    length = F.aggregate(block, F.lit(0), lambda a, x: a + x)
    return F.greatest(F.ceil(n / SIDE), F.ceil(n * (length + 1) / SIDE_BYTES), F.lit(1)).cast("int")


def _letters(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), width)


def _profile(codes: np.ndarray) -> np.ndarray:
    n, width = codes.shape
    cells = np.arange(n)[:, None] * len(LETTERS) + _PLACE[codes]
    counts = np.bincount(cells.ravel(), minlength=n * len(LETTERS)).reshape(n, len(LETTERS))
    return counts.astype(np.float32 if width < 2000 else np.float64)


def _near_pairs(ours: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of ours, of theirs) of words one edit apart; theirs are as long as ours, or one letter longer."""
    a, b = _profile(ours), _profile(theirs)
    used = a.any(axis=0) & b.any(axis=0)
    length = lambda x: (x * x).sum(axis=1, keepdims=True)
    # One product gives |a|^2 + |b|^2 - 2ab; letters that only one side has add to the lengths alone.
    distance = np.hstack([-2 * a[:, used], length(a), np.ones_like(a[:, :1])]) @ np.hstack([b[:, used], np.ones_like(b[:, :1]), length(b)]).T
    i, j = np.divmod(np.flatnonzero(distance.ravel() <= 2), len(theirs))
    width, kept = ours.shape[1], np.zeros(len(i), dtype=bool)
    step = max(1, VERIFIED // max(1, width // 32))
    for at in range(0, len(i), step):
        x, y = ours[i[at : at + step]], theirs[j[at : at + step]]
        before = x != y[:, :width]
        if theirs.shape[1] == width:
            kept[at : at + step] = before.sum(axis=1) == 1
        else:
            first = np.where(before.any(axis=1), before.argmax(axis=1), width)
            after = x != y[:, 1:]
            last = np.where(after.any(axis=1), width - 1 - after[:, ::-1].argmax(axis=1), -1)
            kept[at : at + step] = last < first
    return i[kept], j[kept]


def _tile(rows: list[tuple]) -> Iterator[tuple[list, list, list]]:
    """(words, near words, their n) of one tile; rows are (side, word, n), side 0 being home, 1 its own block, 2 others."""
    home = [r for r in rows if r[0] == 0]
    if not home:
        return
    width = len(home[0][1])
    ours = _letters([r[1] for r in home], width)
    for side in (1, 2):
        for more in (0, 1):
            guests = [r for r in rows if r[0] == side and len(r[1]) == width + more]
            if guests:
                i, j = _near_pairs(ours, _letters([r[1] for r in guests], width + more))
                yield [home[k][1] for k in i], [guests[k][1] for k in j], [guests[k][2] for k in j]
                if side == 2:
                    yield [guests[k][1] for k in j], [home[k][1] for k in i], [home[k][2] for k in i]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; one tile is held at a time."""
    at, rows = None, []
    done = lambda: [pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"]) for w, v, n in _tile(rows) if w]
    for batch in batches:
        for tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if tile != at:
                yield from done()
                at, rows = tile, []
            rows.append(row)
    yield from done()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): for all distinct words (word, n) of these letters, every word one edit apart, in both directions.

    Joins are merged: what they meet is larger than Spark estimates from compressed columns and before an explode, and
    grows with the words. The places that a block's words go to are found once a block, so that words are joined before they are copied.
    """
    placed = words.select("word", "n", _block(F.col("word")).alias("block"))
    sizes = placed.groupBy("block").agg(F.count("*").alias("n_home"))
    visits = sizes.select(F.explode(_homes(F.col("block"))).alias("block"), F.col("n_home").alias("n")).groupBy("block").agg(F.sum("n").alias("n_guest"))
    plan = sizes.join(visits.hint("merge"), "block").select("block", _parts(F.col("n_home"), F.col("block")).alias("h"), _parts(F.col("n_guest"), F.col("block")).alias("g"))
    asked = sizes.select(F.col("block").alias("own"), F.explode(_homes(F.col("block"))).alias("block"))
    routes = asked.join(plan.hint("merge"), "block").groupBy("own").agg(F.collect_list(F.struct("block", "h", "g")).alias("routes"))
    part = lambda n, seed: F.pmod(F.xxhash64("word", F.lit(seed)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    routed = placed.withColumnRenamed("block", "own").join(routes.hint("merge"), "own").select("word", "n", "own", F.explode("routes").alias("to")).select("word", "n", "own", "to.*")
    home = routed.where("own = block").select("block", part(F.col("h"), "home").alias("i"), upto(F.col("g")).alias("j"), F.lit(0).alias("side"), "word", "n")
    guests = routed.select("block", upto(F.col("h")).alias("i"), part(F.col("g"), "guest").alias("j"), F.when(F.col("own") == F.col("block"), 1).otherwise(2).alias("side"), "word", "n")
    rows = home.unionByName(guests).select(F.concat_ws(".", F.array_join("block", "."), "i", "j").alias("tile"), "side", "word", "n")
    return rows.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_tiles, "word string, near string, near_n long")


def spelling_forms(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words (word, n) with the near word of largest n, if that n is twice theirs.

    Ties go to the smallest in code-point order. n at least doubles from a word to its form, so that the chain of forms
    of a word has at most log2(n) links; it is followed by doubling.
    """
    words = materialize(words)
    # Strings compare by their UTF-8 bytes, which is code-point order.
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    found = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("b.m") >= 2 * F.col("n"), F.col("b")).alias("b"))
    found = materialize(found.select("word", F.col("b.near").alias("form"), "n", "n_near", (-F.col("b.m")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(math.log2(most) + 2))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = materialize(roots.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """Spelling forms of all words of documents (doc_id, text); other columns are not looked at."""
    return spelling_forms(word_counts(docs.select("doc_id", "text")))
