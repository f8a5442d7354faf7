"""Interval joins of runs: every place takes what the last run before it says, however many places a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_run_join(points: DataFrame, runs: DataFrame, keys: list[str], place: Column | str, start: Column | str, block: int) -> DataFrame:
    """points with the columns of the last run of their keys that starts at or before their place; null before the first.

    points and runs have the keys; of runs, all other columns are kept, whose names points must not have. place and
    start are whole numbers. Both sides are cut into ranges of block places, so that a key lies in as many tasks as it
    has ranges; which run is still open where a range begins is a small table of one row a range. Each side shuffles
    once, by keys and range. Of several runs that start at one place the one with the largest values counts. Null keys
    match nothing, and points with a null key or place keep their row.
    """
    names = [c for c in runs.columns if c not in keys]
    if clash := set(names) & set(points.columns):
        raise ValueError(f"points have columns {sorted(clash)} already")
    place, start = (F.col(x) if isinstance(x, str) else x for x in (place, start))
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    said = runs.where(known & start.isNotNull()).select(*keys, start.cast("long").alias("__at"), F.struct(*names).alias("__run"))
    said = said.groupBy(*keys, "__at").agg(F.max("__run").alias("__run")).withColumn("__range", F.floor(F.col("__at") / block))
    # What is open where a range begins: the last run of the ranges before it.
    last = said.groupBy(*keys, "__range").agg(F.max_by("__run", "__at").alias("__open"))
    ranges = points.where(known & place.isNotNull()).select(*keys, F.floor(place / block).alias("__range")).distinct()
    both = ranges.join(last, [*keys, "__range"], "full_outer")
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = both.select(*keys, "__range", F.last("__open", ignorenulls=True).over(earlier).alias("__open"))
    # Within a range runs come before points of the same place.
    rows = points.select(*keys, place.cast("long").alias("__at"), F.struct(*points.columns).alias("__point"))
    rows = rows.withColumn("__range", F.floor(F.col("__at") / block)).withColumn("__run", F.lit(None).cast(said.schema["__run"].dataType))
    rows = rows.unionByName(said.withColumn("__point", F.lit(None).cast(rows.schema["__point"].dataType)))
    within = W.partitionBy(*keys, "__range").orderBy("__at", F.col("__run").isNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("__run", F.last("__run", ignorenulls=True).over(within)).where("__point is not null")
    found = F.when(known & F.col("__at").isNotNull(), F.coalesce("__run", "__open"))
    return seen.join(carried, [*keys, "__range"], "left").select("__point.*", *[found[c].alias(c) for c in names])
