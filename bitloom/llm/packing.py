"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents become runs of token ids; what fills whole windows is cut off, and the rests are dealt into blocks of about
BLOCK windows. In a block, every piece starts as a partial partition of its own; the two partial partitions with the
largest imbalance are merged again and again, the fullest window of one with the emptiest of the other, until one
partition with nearly equal windows is left. If its fullest window exceeds the capacity, the window count rises.
"""

from __future__ import annotations

import heapq
import json
import math
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_of

CAPACITY = 4096
END = 2
#: Windows of a block, about.
BLOCK = 128
#: Strings between blanks that a task remembers the ids of.
REMEMBERED = 500_000
#: By tokenizer file and its treatment of special tokens: what this worker process has encoded so far, over all of its tasks.
_known: dict[tuple[str, bool], dict[str, bytes]] = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The tokenizer settings under which a text may be encoded string by string between its blanks. White
#: space is dropped and never joined across, and composing or lowering characters never reaches across a blank.
SEPARABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def separable(tokenizer_json: str) -> bool:
    """True if texts of this tokenizer may be encoded string by string; others are encoded whole."""
    settings = json.loads(tokenizer_json)
    added = settings.get("added_tokens") or []
    return all(settings.get(k) == v for k, v in SEPARABLE.items()) and all(x["content"].split() == [x["content"]] and not x["single_word"] and not x["normalized"] for x in added)


def special_names(tokenizer_json: str) -> list[str]:
    """What a text must not be cut or lowered within: the names of special tokens, in lower case."""
    return [x["content"].lower() for x in json.loads(tokenizer_json).get("added_tokens") or []]


#: ASCII symbols that the tokenizer keeps together as one run; the apostrophe can begin a contraction instead.
MARKS = string.punctuation.replace("'", "")
#: Words of one joined text.
JOINED = 256


def _stem(word: str, special: list[str]) -> tuple[str, str]:
    """A string that stands for word before the tokenizer, which lowers case and cuts marks off letters, and its last marks.

    Only words of letters below U+0130 are taken apart: from there on, lower case can add a mark of its own (U+0130),
    which the tokenizer would join with the mark that follows. Words that hold the name of a special token stay as they are.
    """
    if special and any(x in word.lower() for x in special):
        return word, ""
    if not word.isascii() and max(word) >= "\u0130":
        return word, ""
    stem = word.rstrip(MARKS)
    return (stem.lower(), word[len(stem) :]) if stem.isalpha() else (word.lower(), "")


def _list(strings: pa.Array) -> list[str]:
    """The strings as a list; to_pylist takes twenty times as long."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _stems(words: pa.Array, special: list[str]) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """_stem of each of the words: the strings that stand for them, and their last marks."""
    if special:
        pairs = [_stem(w, special) for w in _list(words)]
        return tuple(pa.array([x[i] for x in pairs], pa.large_string()).dictionary_encode() for i in (0, 1))
    stem = pc.utf8_rtrim(words, MARKS)
    odd = pc.match_substring_regex(words, r"[^\x00-\x{12F}]")
    plain = pc.and_not(pc.utf8_is_alpha(stem), odd)
    lower = pc.utf8_lower(pc.if_else(plain, stem, words))
    letters = pc.if_else(plain, pc.utf8_length(stem), pc.utf8_length(words)).to_numpy()
    marks = [w[n:] for w, n in zip(_list(words), letters.tolist(), strict=True)]
    return pc.if_else(odd, words, lower).dictionary_encode(), pa.array(marks, pa.large_string()).dictionary_encode()


def word_ends(tokenizer_json: str) -> np.ndarray | None:
    """For each id, whether it ends a word; None if the tokenizer does not mark its last ids."""
    model = json.loads(tokenizer_json)["model"]
    if not (suffix := model.get("end_of_word_suffix")):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for x, i in model["vocab"].items() if x.endswith(suffix)]] = True
    return ends


def _ids_of_words(words: list[str], tokenizer, ends: np.ndarray) -> dict[str, bytes]:
    """The ids of words of letters, encoded many at once with blanks between them and cut after ids that end a word."""
    found = {}
    parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
    for part, e in zip(parts, tokenizer.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<u4")
        stops = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
        if len(stops) == len(part):
            data = ids.tobytes()
            found.update(zip(part, (data[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
    return found


def token_bytes(texts: list[str], tokenizer, known: dict[str, bytes] | None, ends: np.ndarray | None = None, special: list[str] | None = None) -> list[bytes]:
    """The ids of each text, four bytes each, little-endian; known None: texts are encoded whole.

    Strings between blanks are encoded once and looked up. With ends (see word_ends), words of letters below U+0130,
    which the tokenizer leaves whole, are encoded many at once; other strings one by one. special: what special_names()
    says, where it is known already.
    """
    if known is None:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    column = pa.array(texts, pa.large_string())
    split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
    # Few texts hold such a name; where none does, words need no look of their own.
    asked = special_names(tokenizer.to_str()) if special is None else special
    special = [x for x in asked if any(x in t.lower() for t in (texts if x[0].isalpha() else column.filter(pc.match_substring(column, x[0])).to_pylist()))]
    words = split.flatten().dictionary_encode()
    stems, marks = _stems(words.dictionary, special)
    if len(known) > REMEMBERED:
        known.clear()
    unknown = list({*_list(stems.dictionary), *_list(marks.dictionary)}.difference(known))
    if ends is not None:
        known |= _ids_of_words([x for x in unknown if x.isalpha() and (x.isascii() or max(x) < "\u0130")], tokenizer, ends)
    rest = [x for x in unknown if x not in known]
    for w, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        known[w] = array("I", e.ids).tobytes()
    ids_of = lambda x: pa.array(list(map(known.__getitem__, _list(x.dictionary))), pa.large_binary()).take(x.indices)
    ids = pc.binary_join_element_wise(ids_of(stems), ids_of(marks), pa.scalar(b"", pa.large_binary())).take(words.indices)
    # The ids of all words lie one behind the other; each text has those of its words.
    at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][: len(ids) + 1]
    data = memoryview(ids.buffers()[2] or b"")
    first = np.asarray(split.offsets) - split.offsets[0].as_py()
    return [bytes(data[i:j]) for i, j in pairwise(at[first].tolist())]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int | None = END, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Tokenize every whole text and cut its ids into pieces of at most capacity: whole windows first, then the rest.

    docs has doc_id and text; other columns, whatever their names, are ignored. Null text counts as empty: only the
    end id is left (without an end id, no piece). A null doc_id is kept. Repeated rows give repeated pieces. With
    with_ids, a column ids holds the ids themselves (binary, four bytes each, little-endian). Names of special tokens
    in a text become their ids, as the tokenizer does by itself; with special_as_text they are ordinary text, so that
    no document can write a control id. A text of any length is one row of a batch; its cost is linear. Empty input:
    no pieces.
    """
    arrow_batches(docs.sparkSession, 2000)
    last = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        settings = tokenizer.to_str()
        known = _known.setdefault((tokenizer_path, special_as_text), {}) if separable(settings) else None
        ends, special = word_ends(settings), special_names(settings)
        tokenizer.encode_special_tokens = special_as_text
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).to_pylist(), tokenizer, known, ends, special), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, *([piece] if with_ids else [])))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def difference(sizes: list[int], windows: int) -> list[int]:
    """Window of each size, by multiway differencing into so many windows; ties are broken by the order of merging."""
    heap = []
    for i, x in enumerate(sizes):
        sums, trees = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], trees[0] = x, i
        heap.append((-x if windows > 1 else 0, i, sums, trees))
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # tree len(sizes) + j joins these two
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        sums, trees = a + b[::-1], ta.copy()  # a falls, b reversed rises: opposing imbalances
        other = tb[::-1]
        trees[ta < 0] = other[ta < 0]
        for k in np.flatnonzero((ta >= 0) & (other >= 0)):
            trees[k] = len(sizes) + len(joined)
            joined.append((int(ta[k]), int(other[k])))
        falling = np.argsort(-sums, kind="stable")
        sums, trees = sums[falling], trees[falling]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, trees))
        order += 1
    window = [0] * len(sizes)
    for k, tree in enumerate(heap[0][3].tolist() if heap else []):
        todo = [tree] if tree >= 0 else []
        while todo:
            t = todo.pop()
            if t < len(sizes):
                window[t] = k
            else:
                todo += joined[t - len(sizes)]
    return window


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Window of each size, with as few windows as differencing fills without exceeding the capacity."""
    windows = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        found = difference(sizes, windows)
        if not sizes or np.bincount(found, weights=sizes).max() <= capacity:
            return found
        windows += max(1, windows // 100)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """pieces with sequence_id and offset: every piece in one window of at most capacity ids, without gaps.

    Pieces longer than capacity are refused by token_pieces already. The pieces are first written to the shared
    folder, so that each keeps its block; a block holds about `block` windows whatever the input's size, and repeated
    rows are dealt out over the blocks like others. Columns named sequence_id or offset are replaced.
    """
    rows = materialize(pieces.drop("sequence_id", "offset").withColumn("__row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / capacity / block))
    names = [c for c in rows.columns if c != "__row"]
    # The windows need only a piece's row and length: ids and other columns are joined again afterwards.
    placed = (
        rows.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(blocks)).alias("__block"))
        .groupBy("__block")
        .applyInPandas(lambda key, group: _place(key[0], group, capacity), "__row long, sequence_id long, offset long")
    )
    return rows.join(placed, "__row").select(*names, "sequence_id", "offset")


def _place(block: int, group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The window and offset of each piece of one block.

    Pieces below a 64th of the capacity are first strung together to items of about that size, so that a block has
    some ten thousand items at most, however small its pieces are, and its partial partitions a bounded size.
    """
    group = group.sort_values(["length", "__row"], ascending=[False, True], kind="stable")
    lengths, least = group["length"].to_numpy(), max(1, capacity // 64)
    small = lengths < least
    before = np.cumsum(np.where(small, lengths, 0)) - np.where(small, lengths, 0)
    item = np.where(small, np.count_nonzero(~small) + before // least, np.arange(len(lengths)))
    item = np.unique(item, return_inverse=True)[1]
    sizes = np.bincount(item, weights=lengths).astype(np.int64)
    window = np.array(pack_sizes(sizes.tolist(), capacity), dtype=np.int64)[item]
    out = pd.DataFrame({"__row": group["__row"].to_numpy(), "sequence_id": (int(block) << 32) + window, "length": lengths})
    out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
    return out[["__row", "sequence_id", "offset"]]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """The contract's query: every piece of every document with its place in a sequence."""
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end), capacity)
