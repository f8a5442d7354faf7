"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in Spark's own functions.

A text's parts are its paragraphs; one of more than LONG characters counts as its sentences, cut also after words of
twelve letters or more, so that a paragraph without marks has parts as well. Where a cut lies depends on the text
beside it alone, so every place of a text weighs alike and an edit changes only the parts that it touches. Each part's
digest is added to three of CELLS cells, which keep a count, the xor of the digests and the xor of their checks. Two
texts' sketches subtract cell by cell; what they share cancels. Peeling takes digests from cells that hold one alone,
until none is left: these are the digests of the parts that the texts do not share. If peeling gets stuck, both
sketches are made again four times as large.

Cells are kept sparse, as a sorted array of those that are not empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

CELLS = 144
#: Paragraphs of more characters are cut into sentences.
LONG = 200
HASHES = 3
#: Sizes are CELLS * 4**0 .. 4**(SIZES - 1); a third of the largest is below 2**20, as a digest has 20 bits for each.
SIZES = 8
ROUNDS = 32
PIECE = r"([.!?]|[^ \n]{12}) +"


def part_digests(text: Column) -> Column:
    """Distinct 60-bit digests of a text's parts, sorted; none for an empty text."""
    pieces = lambda x: F.when(F.length(x) > LONG, F.split(F.regexp_replace(x, PIECE, "$1\n"), "\n", -1)).otherwise(F.array(x))
    parts = F.filter(F.flatten(F.transform(F.split(text, "\n", -1), pieces)), lambda x: F.trim(x) != "")
    return F.sort_array(F.array_distinct(F.transform(parts, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long"))))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _cells_of(k: Column, h: Column, count: Column, size: Column) -> Column:
    """The cells that a digest is added to (count 1) or taken from (-1): one in each third of the sketch, by 20 of its bits."""
    third = F.floor(size / HASHES)
    return F.array(*[F.struct((F.pmod(F.shiftright(k, 20 * j), third) + j * third).cast("long").alias("pos"), count.cast("long").alias("c"), k.alias("k"), h.alias("h")) for j in range(HASHES)])


def _entries(digests: Column, size: Column, count: int) -> Column:
    checked = F.transform(digests, lambda d: F.struct(d.alias("k"), check_of(d).alias("h")))
    return F.flatten(F.transform(checked, lambda d: _cells_of(d["k"], d["h"], F.lit(count), size)))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _merge(entries: Column) -> Column:
    """Entries of one cell added up; cells that come to nothing leave. Linear after the sort: runs are cut out and added."""
    none = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("pos", "c", "k", "h")])
    add = lambda a, e: F.struct(e["pos"].alias("pos"), (a["c"] + e["c"]).alias("c"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["h"].bitwiseXOR(e["h"]).alias("h"))

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (F.get(s, i - 1)["pos"] != e["pos"]), i)), lambda i: i.isNotNull())
        cells = lambda b: F.transform(b, lambda at, i: F.aggregate(F.slice(s, at + 1, F.coalesce(F.get(b, i + 1), F.size(s)) - at), none, add))
        return F.filter(_with(starts, cells), lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))

    return _with(F.sort_array(entries), of)


def sketch(digests: Column, size: Column) -> Column:
    """The sketch of size cells, sparse."""
    return _merge(_entries(digests, size, 1))


def subtract(a: Column, b: Column) -> Column:
    """a - b, cell by cell; both of one size."""
    return _merge(F.concat(a, F.transform(b, lambda x: F.struct(x["pos"].alias("pos"), (-x["c"]).alias("c"), x["k"].alias("k"), x["h"].alias("h")))))


def peel(cells: Column, size: Column) -> Column:
    """struct(left, found): how many cells are left (0: all was recovered), and the digests k with c: 1 of the first text, -1 of the second."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,c:bigint>>").alias("found"), F.lit(True).alias("going"))

    def round_(s: Column, _: Column) -> Column:
        alone = F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == check_of(x["k"])))
        digests = F.array_distinct(F.transform(alone, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"), x["h"].alias("h"))))
        taken = lambda d: F.struct(
            F.when(F.size(d) == 0, s["cells"]).otherwise(_merge(F.concat(s["cells"], F.flatten(F.transform(d, lambda x: _cells_of(x["k"], x["h"], -x["c"], size)))))).alias("cells"),
            F.concat(s["found"], F.transform(d, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c")))).alias("found"),
            (F.size(d) > 0).alias("going"),
        )
        return F.when(~s["going"], s).otherwise(_with(digests, taken))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.struct(F.size(s["cells"]).alias("left"), s["found"].alias("found")))


def differing(ours: Column, theirs: Column, base_ours: Column, base_theirs: Column) -> Column:
    """array(struct(k, c)): the digests that one text has alone (c 1: the first, -1: the second), recovered from sketches.

    base_ours and base_theirs are the sketches of CELLS cells; larger ones are made from the digests until peeling
    succeeds. Null should no size succeed, which needs colliding digests.
    """
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<struct<k:bigint,c:bigint>>").alias("found"))
    sizes = F.array(*[F.lit(CELLS * 4**i).cast("long") for i in range(SIZES)])

    def attempt(s: Column, size: Column) -> Column:
        cells = F.when(size == CELLS, subtract(base_ours, base_theirs)).otherwise(_merge(F.concat(_entries(ours, size, 1), _entries(theirs, size, -1))))
        return F.when(s["done"], s).otherwise(_with(peel(cells, size), lambda x: F.struct((x["left"] == 0).alias("done"), x["found"].alias("found"))))

    return F.aggregate(sizes, start, attempt, lambda s: F.when(s["done"], s["found"]))


def likeness(ours: Column, theirs: Column, base_ours: Column, base_theirs: Column) -> Column:
    """Shared parts over all parts of two texts: what they do not share comes from their sketches.

    Two texts without parts are alike (1). Should no sketch succeed, the digests are compared themselves.
    """
    both = F.size(ours) + F.size(theirs)
    differ = F.coalesce(_with(differing(ours, theirs, base_ours, base_theirs), lambda d: F.when(d.isNotNull(), F.size(d))), both - 2 * F.size(F.array_intersect(ours, theirs)))
    return _with(differ, lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))).cast("double")


def render(cells: Column) -> Column:
    """A sketch as text: place, count and digests of each cell that is not empty, in hexadecimal (checks follow from the digests)."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(".", F.hex(x["pos"]), x["c"].cast("string"), F.hex(x["k"]))), " ")


def with_next_text(docs: DataFrame, per_bucket: int = 2000, most_buckets: int = 4096) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the next document by descending doc_id; after the last, the first.

    Null ids come last; ties follow the text. Ranges of ids with about per_bucket rows each (bounds from approximate
    percentiles; from per_bucket * most_buckets rows on, ranges grow and their sort spills) are ordered by themselves;
    what follows a range is looked up in a table of one row for each range, so of most_buckets + 1 rows at most, which
    is what the window without partitions and the broadcast hold.
    """
    n = docs.count()
    buckets = max(1, min(most_buckets, n // per_bucket))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets + 100)).first()[0] or []
    above = F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<bigint>"), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(most_buckets + 1)).otherwise(above))
    inside = W.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    over = W.orderBy("bucket")
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    heads = heads.select("bucket", F.coalesce(F.lead(F.struct("head")).over(over), F.first(F.struct("head")).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("head"))
    head_texts = rows.join(F.broadcast(heads.select(F.col("head.head").alias("head"), F.col("bucket").alias("after"))), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("after").agg(F.min("text").alias("head_text"))
    return (
        rows.withColumn("following", F.lead("text").over(inside))
        .join(head_texts, F.col("bucket") == F.col("after"), "left")
        .select("doc_id", "text", F.coalesce("following", "head_text").alias("next_text"))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The contract's query: fingerprints of every text and its edited text, and how like they are.

    Null text counts as empty: no cells, an empty fingerprint. Repeated rows are each other's next documents. One
    document alone is its own next one. A long text is one row, cut into parts in one pass. Other columns are ignored. Empty input: empty result.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next_text(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[part_digests(F.col(x)).alias(f"d_{x}") for x in ("text", "edited", "next_text")])
    rows = rows.select("*", *[sketch(F.col(f"d_{x}"), F.lit(CELLS).cast("long")).alias(f"s_{x}") for x in ("text", "edited", "next_text")])
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        render(F.col("s_text")).alias("fingerprint"),
        render(F.col("s_edited")).alias("edited_fingerprint"),
        *[likeness(F.col("d_text"), F.col(f"d_{x}"), F.col("s_text"), F.col(f"s_{x}")).alias(name) for x, name in (("edited", "near_edited"), ("next_text", "near_next"))],
    )
