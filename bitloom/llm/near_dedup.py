"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles are its runs of five words (lower case, without ASCII white space), weighted by (1 + ln tf) * idf
with idf = 1 + ln((1 + N) / (1 + df)). N and df count distinct texts: a text that was copied a thousand times is no
evidence that its shingles are common ones. df is read from hashed counters of a fixed size (a count-min table of two
rows, less what other shingles add on average), so that what is broadcast does not grow; on large corpora the counts
of rare shingles are therefore uncertain by the table's noise, the same for every text that holds them.

HASHES consistent weighted samples make BANDS bands; texts with an equal band are candidates.

Equal texts are one node. In a bucket, every node is paired with up to four representatives only; pairs of bands make finer
buckets with a representative of their own, so that a large bucket yields many different partners and still no more
candidates than a few for each member. All groups are built by combinable minima. First each node's best candidate by its samples is
verified by exact weighted Jaccard similarity; of the other candidates only those that join two components still
matter, and all of these are verified.

Representatives stand for a whole bucket only where its members proved to be one component. The members of every other
bucket are compared without them: two texts of similarity s share one of their rarest shingles, those before the last
s of a text's weight, so that texts with such a shingle in common, of different components and with enough weight left
from that shingle on, are all candidates (prefix filter), and those that could be similar by their samples are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, release, text_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
HASHES = BANDS * ROWS
#: Document counts are kept in two rows of so many hashed counters (2**DF_BITS).
DF_BITS = 21
#: Parts that the counters are summed up in.
DF_PARTS = 64
#: Candidates whose samples agree less often than this differ far too much (0.8 less four deviations).
LEAST_AGREEING = 11
#: Texts with a rare shingle in common are compared in parts of about this many against all.
PART = 1024
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_BASE, _INVERSE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K[1]
    x = (x ^ (x >> np.uint64(29))) * _K[2]
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, sorted by both. Fewer than five words make one shingle."""
    data = "\n".join(x.lower() for x in texts).encode() + b"\n"
    b = np.frombuffer(data, np.uint8)
    white = ((b >= 9) & (b <= 13)) | (b == 32)
    sizes = np.array([len(x.lower().encode()) + 1 for x in texts], np.int64)
    ends_of = np.cumsum(sizes)
    edge = np.diff(white.astype(np.int8), prepend=1)
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    e = e[e > (s[0] if len(s) else 0)][: len(s)]
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(b), _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(b), _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    word = _mix((sums[e] - sums[s]) * back[s])
    text = np.searchsorted(ends_of, s, side="right")
    n = max(0, len(word) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for j in range(WORDS):
        h = h * _K[4] + word[j : j + n] * _K[j]
    whole = text[:n] == text[WORDS - 1 :]
    owner, h = text[:n][whole], _mix(h[whole])
    counts = np.bincount(text, minlength=len(texts))
    if len(short := np.flatnonzero((counts > 0) & (counts < WORDS))):
        first = np.searchsorted(text, short)
        few = [_mix(np.add.reduce(word[f : f + c] * np.array(_K[:c]), keepdims=True) + np.uint64(c))[0] for f, c in zip(first, counts[short], strict=True)]
        owner, h = np.concatenate([owner, short]), np.concatenate([h, np.array(few, np.uint64)])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _counters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each shingle in either row."""
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64), ((h * _K[3]) >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed counts (two rows of a fixed size) of the rows of texts (text) that hold each shingle, and how many rows there are."""
    size = 2 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, 1 << DF_BITS), np.int32), 0
        for batch in batches:
            n += batch.num_rows
            _, h, _ = shingles(batch.column(0).to_pylist())
            for row, at in zip(total, _counters(h), strict=True):
                row += np.bincount(at, minlength=1 << DF_BITS).astype(np.int32)
        parts = [pa.compress(p.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) for p in total.reshape(DF_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(DF_PARTS), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * DF_PARTS, pa.int64())], ["part", "counts", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // DF_PARTS, np.int64)
        for x in table.column("counts").to_pylist():
            planes = np.frombuffer(pa.decompress(x, decompressed_size=4 * len(total), codec="zstd", asbytes=True), np.uint8)
            total += np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(-1)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    schema = "part int, counts binary, n long"
    rows = texts.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).orderBy("part").collect()
    if not rows:
        return np.zeros((2, 1 << DF_BITS), np.uint32), 0
    return np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).reshape(2, -1), rows[0]["n"]


@dataclass(frozen=True)
class Idf:
    """1 + ln((1 + n) / (1 + df)) of shingles; df is the smaller of two counters, less the average counter of its row."""

    df: np.ndarray
    n: int

    def __call__(self, h: np.ndarray) -> np.ndarray:
        a, b = _counters(h)
        return 1 + np.log((1 + self.n) / (1 + np.minimum(self.df[0][a], self.df[1][b])))


def idf_table(counts: np.ndarray, n: int) -> Idf:
    df = counts.astype(np.float32)
    df -= counts.mean(axis=1, keepdims=True).astype(np.float32)
    return Idf(np.clip(np.rint(df, out=df), 1, max(n, 1), out=df), n)


def weights(h: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    return ((1 + np.log(tf)) * idf(h)).astype(np.float32)


def _random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16).astype(np.float32)


def samples(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """HASHES consistent weighted samples of each of n texts (0 where a text has no shingle).

    For each sample a shingle draws r, c and beta by its hash; t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r;
    the shingle with the least a is the sample, together with its t.
    """
    r_of, c_of, b_of = _random_tables()
    out = np.zeros((n, HASHES), np.uint32)
    if not len(h):
        return out
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    lengths = np.diff(np.append(begins, len(owner)))
    log_w = np.log(weight)
    factors = np.random.default_rng(21).integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(HASHES):
        at = (h * factors[k]) >> np.uint64(48)
        r, beta = r_of[at], b_of[at]
        t = np.floor(log_w / r + beta)
        a = c_of[at] - r * (t - beta + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, begins), lengths))
        first = least[np.flatnonzero(np.diff(owner[least], prepend=-1))]
        out[owner[first], k] = (_mix(h[first] + t[first].astype(np.int64).astype(np.uint64) * _K[3]) >> np.uint64(32)).astype(np.uint32)
    return out


def _signatures(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, h, tf = shingles(texts)
            sig = samples(owner, h, weights(h, tf, shared.value), len(texts))
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(HASHES):
                bands[:, k // ROWS] = _mix(bands[:, k // ROWS] + sig[:, k].astype(np.uint64) + np.uint64(0x9E3779B1 * (k + 1)))
            has = np.bincount(owner, minlength=len(texts)) > 0
            lists = [row.tolist() if ok else [] for row, ok in zip(bands.view(np.int64), has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["node", "sig", "bands"])

    return run


def _agreeing(pairs: DataFrame) -> DataFrame:
    """How many of the two signatures' samples agree, compared four bytes at a time."""
    cut = lambda c, i: F.expr(f"substring({c}, {4 * i + 1}, 4)")
    same = sum((cut("sig_a", i) == cut("sig_b", i)).cast("int") for i in range(HASHES))
    return pairs.withColumn("agree", same)


def _similar(shared, similarity: float):
    """Pairs (a, b, text_a, text_b) to those of at least this weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            owner, h, w = [], [], []
            for side in (2, 3):
                o, x, tf = shingles(batch.column(side).to_pylist())
                owner.append(o)
                h.append(x)
                w.append(weights(x, tf, shared.value).astype(float))
            total = sum(np.bincount(o, weights=x, minlength=n) for o, x in zip(owner, w, strict=True))
            o, x, v = np.concatenate(owner), np.concatenate(h), np.concatenate(w)
            order = np.lexsort((x, o))
            o, x, v = o[order], x[order], v[order]
            twin = np.flatnonzero((o[1:] == o[:-1]) & (x[1:] == x[:-1]))
            common = np.bincount(o[twin], weights=np.minimum(v[twin], v[twin + 1]), minlength=n)
            ok = common >= similarity * (total - common) - 1e-9
            ok &= total > 0
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


#: A key that very many rows look up is looked up by so many groups of them at most.
SALTS = 256


def _look_up(rows: DataFrame, key: str, table: DataFrame, column: str) -> DataFrame:
    """rows, which have a column node, with the value of column (null: none) that table (node, column) has for key.

    Rows are dealt out by key and a salt from their node, so that a key which a third of all rows look up does not
    meet in one task; each pair of key and salt fetches the value once.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    slots = salted.select(F.col(key).alias("slot_key"), F.col("salt").alias("slot_salt")).distinct()
    values = slots.join(table.select(F.col("node").alias("slot_key"), F.col(column).alias("found")), "slot_key")
    return salted.join(values, (F.col(key) == F.col("slot_key")) & (F.col("salt") == F.col("slot_salt")), "left").drop("salt", "slot_key", "slot_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, by min-label steps with pointer jumping.

    edges has long columns a and b. The state of every step is written to the shared folder, and that of the step
    before deleted. A component of any size is spread over many tasks: minima combine, and look-ups are salted.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct().withColumnRenamed("a", "node"))
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = _look_up(both, "b", labels, "label").groupBy("node").agg(F.min("found").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        step = _look_up(step, "new", labels, "label").select("node", "label", F.least("new", F.coalesce("found", "new")).alias("new"))
        step = materialize(step)
        release(labels)
        if step.where("label != new").isEmpty():
            release(both)
            return step.select("node", F.col("new").alias("label"))
        labels = step.select("node", F.col("new").alias("label"))


def _stars(keys: DataFrame, draws: int) -> DataFrame:
    """Pairs of each member of a bucket (key, node) with the bucket's representatives, which hashes draw."""
    drawn = [F.min(F.struct(F.xxhash64("node", "key", F.lit(i)).alias("h"), F.col("node").alias("node"))).alias(f"head{i}") for i in range(draws)]
    heads = keys.groupBy("key").agg(F.count("*").alias("n"), *drawn).where("n > 1").select("key", F.array_distinct(F.array(*[f"head{i}.node" for i in range(draws)])).alias("heads"))
    pairs = keys.join(heads, "key").select("node", F.explode("heads").alias("head")).where("node != head")
    return pairs.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))


def _rarest(shared, similarity: float):
    """Rows (node, label, text) to (node, label, shingle, before, total) for the rarest shingles of each text.

    Shingles are ordered by idf and hash; before is the weight of those that are rarer, total that of all. Shingles
    after which less than similarity of the total is left cannot be the first that two similar texts share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, h, tf = shingles(batch.column(2).to_pylist())
            w = weights(h, tf, shared.value).astype(float)
            order = np.lexsort((h, -shared.value(h), owner))
            h, w = h[order], w[order]
            total = np.bincount(owner, weights=w, minlength=batch.num_rows)[owner]
            sums = np.cumsum(w) - w
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            before = sums - np.repeat(sums[begins], np.diff(np.append(begins, len(owner))))
            at = np.flatnonzero(before <= (1 - similarity + 1e-6) * total)
            of = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(h[at].view(np.int64)), pa.array(before[at]), pa.array(total[at])], ["node", "label", "shingle", "before", "total"])

    return run


def _across(members: DataFrame, shared, similarity: float) -> DataFrame:
    """All pairs (a, b) of members (node, label, text) with different labels that can have this similarity."""
    rare = materialize(members.select("node", "label", "text").mapInArrow(_rarest(shared, similarity), "node long, label long, shingle long, before double, total double"))
    mixed = rare.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    rare = rare.join(mixed.select("shingle", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "shingle")
    a = rare.select("shingle", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "before", "total")])
    b = rare.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "before", "total")])
    left = F.least(F.col("total_a") - F.col("before_a"), F.col("total_b") - F.col("before_b"))
    can = left * (1 + similarity) >= (similarity - 1e-6) * (F.col("total_a") + F.col("total_b"))
    met = a.join(b, (a["shingle"] == b["shingle"]) & (a["part"] == b["part"]) & (F.col("node_a") > F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & can)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least doc_id of its class.

    A class is a connected component of links: equal texts, and texts whose weighted Jaccard similarity is at least
    similarity. Texts without a word (null counts as empty) are linked to equal texts only. A null doc_id: class_id is
    that of the equal texts with an id, else null. Repeated rows share a class; of different texts under one id, one
    (the least by its digest) stands for it. Texts of any length are one row of a batch, at some hundred bytes of
    memory for each of their words. Other columns are ignored, whatever their names. Empty input: empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 300)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    digests = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    nodes = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("node")))
    # One row for each distinct text; texts are merged with ids of no proven bound, so that the ids are broadcast at no size.
    heads = nodes.where("node is not null").select("node").distinct()
    whole = rows.withColumnRenamed("doc_id", "node").join(heads.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    whole = materialize(whole)
    shared = spark.sparkContext.broadcast(idf_table(*document_counts(whole)))
    sigs = materialize(whole.select("node", "text").mapInArrow(_signatures(shared), "node long, sig binary, bands array<bigint>"))
    key = lambda *parts: F.xxhash64(*parts)
    coarse = sigs.select("node", F.posexplode("bands").alias("i", "band")).select("node", key("i", "band").alias("key"))
    stars = materialize(_stars(coarse, 4).distinct())
    members = materialize(stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct())
    finer = [(i, (i + d) % BANDS) for d in (1, 2, 3) for i in range(BANDS)]
    fine = (
        sigs.join(members, "node", "left_semi")
        .select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("bands", F.lit(i)).alias("x"), F.get("bands", F.lit(j)).alias("y")) for i, j in finer])).alias("p"))
        .select("node", key("p.i", "p.j", "p.x", "p.y").alias("key"))
    )
    pairs = stars.union(_stars(fine, 1)).distinct()
    a, b = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    alike = lambda these: _agreeing(these.join(a, "a").join(b, "b")).where(F.col("agree") >= LEAST_AGREEING).select("a", "b", "agree")
    pairs = materialize(alike(pairs))
    texts = materialize(whole.join(members.hint("merge"), "node", "left_semi"))
    release(whole)

    def verified(these: DataFrame) -> DataFrame:
        ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")).hint("merge") for x in "ab")
        return these.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(shared, similarity), "a long, b long")

    best = pairs.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = materialize(verified(best))
    labels = components(links)
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    open_ = pairs.join(best, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    links = materialize(links.union(verified(open_.select("a", "b"))))
    labels = components(links)
    # Buckets of several components: two nodes are compared above, of more nodes perhaps not all.
    placed = coarse.join(members, "node", "left_semi").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low != high")
    apart = placed.join(mixed, "key", "left_semi").select("node", "label").distinct()
    across = materialize(alike(_across(texts.join(apart, "node"), shared, similarity)).join(pairs, ["a", "b"], "left_anti"))
    labels = components(links.union(verified(across)))
    classes = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("class_id"))
    return digests.join(classes, "digest").select("doc_id", "class_id")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each class the document with the least id stays, once; rows without an id stay."""
    classes = near_duplicate_classes(docs, similarity)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("id")).distinct()
    once = W.partitionBy("id").orderBy(F.lit(1))
    whole = F.struct(*docs.columns).alias("row")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), whole).join(kept, "id", "left_semi")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
    return rows.unionByName(docs.where("doc_id is null"))
