"""Sharding by weighted rendezvous hashing of a stable record key.

Every shard draws a score from the hash of (key, shard); the row goes to the shard with the best score. A new shard
can only win rows, so growing the shard count moves rows into the new shard and nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of


def draw(key: Column, salt: Column) -> Column:
    """52 bits of the MD5 of key and salt as text; a null key counts as none."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), salt.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")


def rendezvous_shards(key: Column, *maps: Mapping[int, float]) -> Column:
    """For each map of weights by shard, the shard with the largest weight / -ln(u), u being the hash of (key, shard) in (0, 1).

    A shard draws one hash for all maps. Ties go to the smaller shard. A null key hashes as null: all such rows share
    one shard. The result is an array with a shard for each map.
    """
    shards = sorted({s for m in maps for s in m})
    drawn = F.transform(F.array(*[F.struct(F.lit(int(s)).alias("s"), *[F.lit(float(m.get(s, 0.0))).alias(f"w{i}") for i, m in enumerate(maps)]) for s in shards]), lambda x: F.struct(x.alias("x"), ((draw(key, x["s"]) + 0.5) / float(1 << 52)).alias("u")))
    best = lambda d, i: -F.array_max(F.transform(F.filter(d, lambda y: y["x"][f"w{i}"] > 0), lambda y: F.struct((y["x"][f"w{i}"] / -F.ln(y["u"])).alias("score"), (-y["x"]["s"]).alias("s"))))["s"]
    return F.element_at(F.transform(F.array(drawn), lambda d: F.array(*[best(d, i) for i in range(len(maps))])), 1)


def assign_shards(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard and number the rows of each shard from 0 without gaps.

    Returns key, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard. Null or empty
    text: size 16, crc 0; texts of any length are only hashed. Null key: one common shard. Repeated rows: each keeps a
    slot of its own; ties in the order are between rows that are alike. Other input columns are ignored, whatever
    their names. Empty input: empty result. Under the law `key` the key alone decides, so equal texts with different
    keys lie in different shards: they are no groups that stay together.

    The slots need no group as large as a shard: a shard's rows are dealt into about sqrt(rows) parts by a draw of
    16 bits from key, size and crc (so that rows without a key are dealt out as well), counted, and numbered inside
    their part on top of the counts of the parts before. The order of a shard is that of draw, key, size and crc.
    """
    rows = docs.count()
    parts = min(1 << 16, max(1, math.ceil(rows / max(1, len(weights)) / max(256, math.isqrt(rows)))))
    hashed = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        rendezvous_shards(F.col(key), weights, *([grown] if grown else [])).alias("best"),
    )
    place = F.shiftright(draw(F.col("key"), F.concat_ws(":", "size", "text_crc32")), 36)
    keyed = hashed.select("*", F.get("best", F.lit(0)).cast("int").alias("shard"), place.alias("place")).withColumn("part", F.shiftright(F.col("place") * parts, 16))
    counts = keyed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "part").orderBy("place", "key", "size", "text_crc32")
    return (
        keyed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(bases, ["shard", "part"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("base") + F.col("rank")).cast("long").alias("slot"),
            (F.get("best", F.lit(1)).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        )
    )
