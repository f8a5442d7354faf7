"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled documents in the tasks and sums them with Spark; only the
matrix of log-probabilities (languages x orders x 2**BITS) reaches the driver, and is broadcast. Scoring reads whole
texts in Arrow batches, gathers the log-probabilities of their n-grams and sums them by document in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_sample, held_out, is_training
from .ngrams import chunks, code_points, ngrams

BITS = 14
ORDERS = (1, 2, 3)
#: Labelled documents of one language that the model is fitted on, at most (in expectation).
SAMPLE_PER_LANGUAGE = 1500
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """languages, and log-probabilities as an array of shape (orders, 2**BITS, languages)."""

    languages: tuple[str, ...]
    logp: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, bucket, n) of the texts of one task."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, texts in chunks([(x or "").lower() for x in batch.column("text").to_pylist()]):
            points, owner = code_points(texts)
            names = sorted(set(langs[first : first + len(texts)]))
            code = np.array([names.index(x) for x in langs[first : first + len(texts)]])
            for k, n in enumerate(ORDERS):
                b, o = ngrams(points, owner, n, BITS)
                both = np.bincount(code[o] * (1 << BITS) + b, minlength=len(names) << BITS).reshape(len(names), -1)
                for i, x in enumerate(names):
                    held.setdefault(x, np.zeros((len(ORDERS), 1 << BITS), np.int64))[k] += both[i]
    for lang, counts in held.items():
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[k, b], pa.int64())], ["lang", "k", "bucket", "n"])


def train_language_model(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, smoothing: float = 0.5) -> LanguageModel:
    """Fit on the rows (doc_id, text, lang) of labelled whose text and lang are not null.

    Languages have equal prior chances. No labelled row: a model without languages.
    """
    arrow_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sample = bounded_sample(rows, "lang", per_language).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, k int, bucket int, n long").groupBy("lang", "k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    n = np.zeros((len(ORDERS), 1 << BITS, len(langs)))
    n[counts.column("k").to_numpy(), counts.column("bucket").to_numpy(), np.array([at[x] for x in counts.column("lang").to_pylist()], dtype=int)] = counts.column("n").to_numpy()
    total = n.sum(axis=1, keepdims=True) + smoothing * (1 << BITS)
    return LanguageModel(tuple(langs), np.log((n + smoothing) / total).astype(np.float32))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior chance; `und` and 0 without a letter or a language."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return langs, scores
    for first, part in chunks([(x or "").lower() for x in texts]):
        points, owner = code_points(part)
        total = np.zeros((len(part), len(model.languages)))
        for k, n in enumerate(ORDERS):
            b, o = ngrams(points, owner, n, BITS)
            for j in range(len(model.languages)):
                total[:, j] += np.bincount(o, weights=model.logp[k, :, j][b], minlength=len(part))
        best = total.argmax(axis=1)
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, x in enumerate(part):
            if LETTER.search(x):
                langs[first + i], scores[first + i] = model.languages[best[i]], chance[i]
    return langs, scores


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, lang_pred and score, from the text alone.

    Null, empty and letterless texts: `und`, 0. Ties go to the first language in order. Repeated rows are judged
    alike; other columns pass through (columns named like the two new ones are replaced). A text of any length is read
    whole, in parts. Empty input: empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [f"`{lang_pred}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(shared.value, batch.column(at).to_pylist())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, lang_pred, score])

    return docs.mapInArrow(run, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """The contract's query: doc_id, held_out, lang_pred and score of every document.

    Null texts and texts without a letter are `und` with score 0, as are all where nothing was learned. Repeated rows
    each have a row; a null doc_id is neither learned from nor held out. Languages that are equally likely go to the
    first by name. A long text is one row, read whole. Other columns are ignored. Empty input: empty result.
    """
    model = train_language_model(docs.where(is_training()))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
