"""The corpus pipeline: documents in, packed training sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Null texts: the language stage rejects them, the later stages would keep them as empty. Rows with a null doc_id are judged
by language and quality; near-dedup keeps all of them, and nothing is cut from or for them. Repeated rows count as equal documents, of which near-dedup
keeps one. Texts of any length are worked on whole, each as one row. More columns, whatever their names, are carried to
the packing stage. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import langid, near_dedup, packing, quality, suffix_dedup
from bitloom.llm.common import is_training, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those with a letter, and a language that is likelier than all others together.

    The model is learned from the labelled rows of the training fold. Without any labelled row nothing can be told,
    and nothing is rejected.
    """
    model = langid.train_language_model(docs.where(is_training()))
    if not model.languages:
        return docs
    lang, score = (next(x for x in (name + "_" * i for i in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("__lang", "__score"))
    judged = langid.predict_language(docs, model, lang_pred=lang, score=score)
    return judged.where((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules stay; the verdict is joined back by id and text digest."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.keep_one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document holds are cut out of the texts; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs, with_text=True)
    return cut.selectExpr(*[("cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: Models, sampling and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
