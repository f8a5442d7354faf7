"""Quality rules with risk-controlled thresholds.

Each rule compares a ratio with a cutoff. The rules' cutoffs lie on a common ladder, from lenient to strict, and a
stratum's cutoffs are one step of it. A step qualifies if the exact binomial tail says that rejecting so few of the
good documents among the labelled ones would be improbable if all rules together rejected more than a stated rate.
Steps are tested in fixed order, from lenient to strict, until one fails, each at the full level: such a sequence keeps
the chance of any false qualification at that level without dividing it further. Across strata it is divided by their
number (Bonferroni), so that with the stated confidence no stratum loses more good documents than the rate. Where not
even the first step qualifies, the rules reject nothing in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: The ladder: cutoffs of each rule from the most lenient to the strictest step. A ratio above the cutoff is a rejection.
GRID = {
    "symbol_ratio": (0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01),
    "dup_line_ratio": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_ratio": (0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
}
RATE, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def quality_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang", row: bool = False) -> DataFrame:
    """Counts and ratios of every whole text, computed in Spark's own functions.

    Null text counts as a text without words: all counts 0, all ratios 0. Words are runs without ASCII white space.
    Repeated rows give repeated results. A null stratum is the stratum ''. Other columns are ignored, whatever their
    names; with row, a struct __row holds all of them. There are no ties: equal texts have equal counts. The cost of a
    text of n words is that of sorting n hashes.
    """
    t = text_of("__t")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"), (F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")).alias("stratum"), *([F.struct(*docs.columns).alias("__row")] if row else []))
    base = base.withColumn("__w", F.filter(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), lambda w: w != ""))
    base = base.withColumn("__l", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    n = F.size("__w")
    # Hashes of the 3-word windows beside their places, sorted: equal windows are then neighbours.
    base = base.withColumn(
        "__g",
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    twice = F.filter("__g", lambda x, k: (F.get("__g", k - 1)["h"] == x["h"]) | (F.get("__g", k + 1)["h"] == x["h"]))
    base = base.withColumn("__r", F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))
    chars = F.length(F.translate(t, SPACES, ""))
    counted = base.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__r").cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        *(["__row"] if row else []),
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        "*",
        over("n_symbols", "word_chars").alias("symbol_ratio"),
        over("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        over("n_repeat_words", "n_words").alias("repeat_ratio"),
        over("n_upper", "word_chars").alias("upper_ratio"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), as a sum of terms by their recurrence, in logarithms."""
    first = n * F.log1p(F.lit(-rate))
    odds = F.log(F.lit(rate / (1 - rate)))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.cast("double").alias("t"), (a["s"] + F.exp(t)).cast("double").alias("s"))

    return F.aggregate(steps, start, step, lambda a: a["s"])


def risk_controlled_cutoffs(features: DataFrame, labels: DataFrame, rate: float = RATE, delta: float = DELTA, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """Per stratum one cutoff for each rule (null: the rules reject nothing there), and n, k: good labelled rows, rejected ones at each step.

    rate bounds the share of good documents that all rules together reject; delta is the chance that the bound of any
    stratum fails. Labels with a null quality or of unknown documents count for nothing. Documents that fail the base
    rules take no part. The labelled rows are aggregated where they lie; a stratum has one row. A tail is summed over
    at most rate times the good labelled rows of its stratum.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("doc_id")).distinct()
    rows = features.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    steps = range(len(next(iter(grid.values()))))
    rejected = [F.greatest(*[(F.col(m) > cuts[i]).cast("int") for m, cuts in grid.items()]) for i in steps]
    counts = materialize(rows.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.sum(x).cast("long") for x in rejected]).alias("k")))
    level = delta / max(1, counts.count())
    able = F.transform("k", lambda k: F.when(k > F.col("n") * rate, F.lit(1.0)).otherwise(binomial_tail(F.col("n"), k, rate)) <= level)
    step = F.when(F.array_position(able, False) > 0, F.array_position(able, False) - 1).otherwise(F.lit(len(steps))).cast("int")
    chosen = counts.select("stratum", "n", "k", step.alias("step"))
    return chosen.select("stratum", "n", "k", *[F.get(F.array(*map(F.lit, cuts)), F.col("step") - 1).alias(f"cut_{m}") for m, cuts in grid.items()])


def judge(features: DataFrame, cutoffs: DataFrame, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """features with kept: false if base_failed or if a ratio is above its stratum's cutoff."""
    fails = F.lit(False)
    for m in grid:
        fails = fails | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return features.join(cutoffs.drop("n", "k"), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~fails)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, rate: float = RATE, delta: float = DELTA) -> DataFrame:
    """All documents with their counts and the verdict kept. Empty input: empty result; no labels: only base rules."""
    features = materialize(quality_features(docs))
    return judge(features, risk_controlled_cutoffs(features, labels, rate, delta))


def keep_good(docs: DataFrame, labels: DataFrame, rate: float = RATE, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Features are computed once and written with the row that they belong to, so that repeated rows need no key.
    """
    features = materialize(quality_features(docs, row=True))
    return judge(features, risk_controlled_cutoffs(features, labels, rate, delta)).where("kept").select("__row.*")
