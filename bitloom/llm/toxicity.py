"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (with word ends), a window of words the mean of its
words; a linear softmax over two classes judges the window. A document scores as its worst window, so that a few bad
words in a very long text are not averaged away. Misspellings share most n-grams with the words that they come from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_sample, held_out, is_training
from .ngrams import chunks, code_points, ngrams

BITS = 17
ORDERS = (3, 4, 5)
DIM = 4
#: Words of a window; windows overlap by half.
WINDOW = 24
#: Labelled documents of one class that the model is fitted on, at most (in expectation), and windows of each of them.
SAMPLE_PER_CLASS = 1200
SAMPLE_WINDOWS = 500
WORD = re.compile(r"\w+")
#: Words that a task remembers the scores of.
REMEMBERED = 1 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """Because the softmax is linear, a subword's vector acts through one number: gram (by bucket); bias is added once."""

    gram: np.ndarray
    bias: float


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word with its ends marked, and the word of each; every word has some."""
    points, owner = code_points([f"<{w}>" for w in words])
    both = [ngrams(points, owner, n, BITS) for n in ORDERS]
    return np.concatenate([b for b, _ in both]).astype(np.int64), np.concatenate([o for _, o in both])


def _windows(n: int) -> list[tuple[int, int]]:
    """Windows that cover n words side by side; the last one is full if n allows."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [*range(0, n - WINDOW, WINDOW), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def fit(texts: list[str], toxic: list[int], share: float = 0.5, steps: int = 150, rate: float = 0.1, decay: float = 1e-5, least: int = 5, first: int = 10, seed: int = 7) -> ToxicityModel:
    """Fit vectors and softmax together by Adam on whole batches, with weight decay.

    The example of each text is the window that looks worst so far (in the first steps, all of its windows); all
    windows of harmless texts are further examples of class 0. Subwords of fewer than least word occurrences, counted
    once a document, get no vector. Both classes weigh alike while fitting; share, that of class 1 among all labelled
    documents, then moves the bias.
    """
    vocab: dict[str, int] = {}
    tokens, starts, lengths, doc = [], [], [], []
    at = 0
    for d, text in enumerate(texts):
        ids = [vocab.setdefault(w, len(vocab)) for w in WORD.findall(text.lower())]
        for s, e in _windows(len(ids)):
            starts.append(at)
            lengths.append(e - s)
            doc.append(d)
            tokens += ids[s:e]
            at += e - s
    if not tokens or len(set(toxic)) < 2:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -3.0)
    tok, begin, size, doc = np.array(tokens), np.array(starts), np.array(lengths, float), np.array(doc)
    label = np.array(toxic)[doc]
    window = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(tok))))
    bucket, word = _subwords(list(vocab))
    pairs = np.unique(doc[window].astype(np.int64) * len(vocab) + tok) % len(vocab)
    seen = np.bincount(bucket, weights=np.bincount(pairs, minlength=len(vocab))[word], minlength=1 << BITS)
    n_grams = np.bincount(word, minlength=len(vocab))
    bucket, word = bucket[frequent := seen[bucket] >= least], word[frequent]
    used, bucket = np.unique(bucket, return_inverse=True)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (len(used), DIM)), rng.normal(0, 0.5, DIM), np.zeros(1)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        vectors, line, bias = params
        words = np.bincount(word, weights=(vectors @ line)[bucket], minlength=len(vocab)) / n_grams
        z = np.clip(np.add.reduceat(words[tok], begin) / size + bias[0], -30, 30)
        if step <= first:
            weight = np.ones(len(z))
        else:
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, doc, z)
            weight = (z >= worst[doc]).astype(float)
        for c in (0, 1):
            weight[label == c] /= max(1e-9, weight[label == c].sum())
        if step > first:
            weight[label == 0] = 0.7 * weight[label == 0] + 0.3 / (label == 0).sum()
        # The averages are linear: what a window's error says reaches its words, and their subwords, as one number each.
        dz = weight * (1 / (1 + np.exp(-z)) - label)
        dwords = np.bincount(tok, weights=(dz / size)[window], minlength=len(vocab)) / n_grams
        dgram = np.bincount(bucket, weights=dwords[word], minlength=len(used))
        grads = [dgram[:, None] * line + decay * vectors, vectors.T @ dgram, np.array([dz.sum()])]
        for i, (g, (m, v)) in enumerate(zip(grads, moment, strict=True)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[i] = params[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    vectors, line, bias = params
    gram = np.zeros(1 << BITS, np.float32)
    gram[used] = vectors @ line
    return ToxicityModel(gram, float(bias[0] + np.log(share / (1 - share))))


def _drawn_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of more than SAMPLE_WINDOWS windows to that many of their windows, drawn by hash, in order."""
    for batch in batches:
        texts = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = WORD.findall((text or "").lower())
            if len(words) > SAMPLE_WINDOWS * WINDOW:
                starts = sorted(range(0, len(words), WINDOW), key=lambda s: zlib.crc32(f"{doc_id} {s}".encode()))[:SAMPLE_WINDOWS]
                text = " ".join(" ".join(words[s : s + WINDOW]) for s in sorted(starts))
            texts.append(text or "")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["doc_id", "text", "toxic"])


def train_toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents among docs; the sample's ids, at most 2 * per_class or so, are broadcast.

    Rows with a null id or label count for nothing; a document with several labels is toxic if one says so; of rows
    with one id one is taken. The sample's texts reach the driver: 2 * per_class of at most SAMPLE_WINDOWS windows of
    WINDOW words each, so some 200 MB if all were that long.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    sample = bounded_sample(known.join(texts.select("doc_id").distinct(), "doc_id"), "toxic", per_class)
    rows = texts.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "text", "toxic").dropDuplicates(["doc_id"])
    rows = rows.mapInArrow(_drawn_windows, "doc_id long, text string, toxic int").orderBy("doc_id").toArrow()
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), min(max(share, 0.02), 0.5))


def score_texts(model: ToxicityModel, texts: list[str | None], known: dict[str, float] | None = None) -> np.ndarray:
    """The softmax's chance of class 1 in the worst window of each text; a text without words has the bias alone."""
    known = {} if known is None else known
    out = np.empty(len(texts))
    for first, part in chunks([(x or "").lower() for x in texts]):
        split = [WORD.findall(x) for x in part]
        if new := list({w for words in split for w in words if w not in known}):
            if len(known) > REMEMBERED:
                known.clear()
                new = list({w for words in split for w in words})
            bucket, word = _subwords(new)
            known.update(zip(new, (np.bincount(word, weights=model.gram[bucket], minlength=len(new)) / np.bincount(word, minlength=len(new))).tolist(), strict=True))
        for i, words in enumerate(split):
            z = model.bias
            if words:
                total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(known.__getitem__, words), float, len(words)))])
                if len(words) <= WINDOW:
                    z += total[-1] / len(words)
                else:
                    s = np.append(np.arange(0, len(words) - WINDOW, WINDOW // 2), len(words) - WINDOW)
                    z += (total[s + WINDOW] - total[s]).max() / WINDOW
            out[first + i] = z
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def predict_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (doc_id, text), from the whole text alone.

    Null text counts as empty; a null doc_id is kept. Repeated rows are judged alike; there are no ties. Other columns
    are ignored, whatever their names. A text of any length is read whole. Empty input: empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = score_texts(shared.value, batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: fit on rows outside the held-out fold, score every document.

    Null and empty texts have a score like any other. Repeated rows each have a row, and are learned from once each;
    a null doc_id is neither learned from nor held out. A long text is scored by all of its windows. Other columns are
    ignored. Empty input: empty result.
    """
    return predict_toxicity(docs, train_toxicity_model(docs.where(is_training()), labels.where(is_training())))
