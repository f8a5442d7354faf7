"""Each operator against brute force on small tables, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bitloom.llm import bpe, common, fingerprints, langid, licenses, near_dedup, packing, quality, sharding, suffix_dedup, toxicity

WORDS = "the of and to in that was with for this over under again still light heavy river stone paper cloud".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def toy():
    rows = [(i, prose(i, 60) + ".\n" + prose(1000 + i, 30)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "x"), (23, rows[3][1]), (24, rows[3][1] + " tail"), (25, "é😀 \n\n  ñ!" * 30), (3, rows[3][1]), (26, "a" * 3000), (27, "   ")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, toy):
    # Columns that clash with names that the operators use.
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2.0, 7) for i, t in toy]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, word string, score double, __id int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_bpe(spark, docs, toy, empty):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True, cache=5), "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    for i, text in toy:
        ids, data = own.encode_ordinary(text or ""), (text or "").encode()
        n, have, sha, decoded, decoded_sha = got[i]
        assert (n, list(have), bytes(decoded)) == (len(ids), ids, data)
        assert sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and decoded_sha == hashlib.sha256(data).hexdigest()
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_decoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = bpe.load_merges(path).pieces
    rows = [(1, [5, 300, 40000]), (2, []), (3, None), (4, [7] * 700 + [1000])]
    got = dict(bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).select("doc_id", "decoded").collect())
    assert got[3] is None and all(bytes(got[i]) == b"".join(pieces[x] for x in ids) for i, ids in rows if ids is not None)


def test_merge_table():
    m = bpe.load_merges(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    held = m.slots[m.slots >= 0]
    assert len(set(held >> 16)) == len(held)
    for v in held[:: len(held) // 500].tolist():
        a, b, c = v >> 32, v >> 16 & 65535, v & 65535
        assert m.pieces[a] + m.pieces[b] == m.pieces[c]


def test_licenses(spark, empty):
    text = prose(1, 200)
    rows = [(1, text), (2, text + "\nReleased under the MIT License.\n" + text), (3, None), (4, ""), (5, "licensed UNDER the apache license version 2.0"), (6, "Released under the"), (None, "Released under the MIT License.")]
    got = {(r[0], r[1]): r[2] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, "mit"): 1.0, (5, "apache-2.0"): 1.0, (None, "mit"): 1.0}
    assert licenses.scan_licenses(empty).count() == 0


def test_whole_licenses(spark):
    whole = ["apache-2.0-text", "gpl-3.0-text", "mpl-2.0-text", "bsd-2-clause-text", "bsd-3-clause-text", "isc-text", "mit-text-whole", "gpl-3.0-header", "lgpl-2.1-header", "mpl-2.0-header"]
    commented = lambda text: "\n".join(f" * // -- {line}" for line in text.splitlines())
    rows = [(i, prose(i, 100) + "\n" + commented(licenses.TEMPLATES[name]) + "\n" + prose(50 + i, 70)) for i, name in enumerate(whole)]
    rows += [(90, licenses.TEMPLATES["gpl-3.0-text"][:9000]), (91, " ".join(licenses.TEMPLATES["isc-text"].split()[:50]))]
    got = {(r[0], r[1]): r[2] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(whole):
        assert got[i, name] >= 0.99
    assert not any(i in (90, 91) and name in whole for i, name in got)


def test_packing(spark, docs, toy, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=64).collect()
    want = {}
    for i, text in toy:
        want[i] = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    seen, windows = {}, {}
    for r in got:
        ids = want[r["doc_id"]]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids)
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        copies = sum(1 for j, _ in toy if j == i)
        assert sum(n for _, n in seen[i]) == copies * len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_tokens_equal_those_of_whole_texts():
    """Strings between blanks against whole texts: all characters that lower case or composition changes, and a sample of the rest, before each mark."""
    import unicodedata
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.separable(tokenizer.to_str())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chars = [c for i, c in enumerate(chars) if i % 97 == 0 or i < 0x600 or c.lower() != c or unicodedata.normalize("NFC", c) != c or unicodedata.combining(c)]
    texts = [" ".join(f"a{c}{m} {c}{m} A{c}b{m}" for m in ",.!?;:") for c in chars]
    texts += ["Maç BİTTİ! KADİ. Bu İYİ, değil?", "ΑΣ. ΣΑΣ, x<|endoftext|>. <|endoftext|>", "x<|endoftext|>. y", "<|ENDOFTEXT|> <|EndOfText|>. <|startoftext|>a", "<|endoftext|", "é<|endoftext|>É## <|endoftext|>'s", "", " ", "\n\n", "it's I'LL. 'd, d'.", "a\u00a0b\u2003c\td\r\ne"]
    texts += ["fin### Fin***, é-é. a'###, 's### x's... ###x, a_b__ ª! º? ", "Größe## ".upper() * 3, " ".join(f"w{'abc'[i % 3]}{'é' * (i % 5)}{'#*$' * (i % 2)}" for i in range(3000))]
    whole = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ends = packing.word_ends(tokenizer.to_str())
    assert packing.token_bytes(texts, tokenizer, {}) == whole
    assert packing.token_bytes(texts, tokenizer, {}, ends) == whole
    other = tokenizer.to_str().replace('"Lowercase"', '"StripAccents"')
    assert not packing.separable(other)
    assert whole[texts.index("x<|endoftext|>. y")] == array("I", [343, 49407, 269, 344]).tobytes()
    # The names of special tokens as ordinary text, where that is asked for.
    tokenizer.encode_special_tokens = True
    plain = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert plain != whole and packing.token_bytes(texts, tokenizer, {}, ends) == plain
    tokenizer.encode_special_tokens = False
    assert packing.token_bytes(["Écoute ça."], tokenizer, None) == packing.token_bytes(["Écoute ça."], tokenizer, {})


def test_a_word_is_encoded_once_whatever_its_case_and_marks():
    """What a worker remembers are stems and marks, not each word in every dress."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ends, known = packing.word_ends(tokenizer.to_str()), {}
    texts = ["Écoute! écoute, ÉCOUTE### écoute", "", "Word word. İ. it's x\tY", "word"]
    assert packing.token_bytes(texts, tokenizer, known, ends) == packing.token_bytes(texts, tokenizer, None)
    assert set(known) == {"écoute", "word", "İ.", "it's", "x\ty", "", "!", ",", "###", "."}
    assert packing.token_bytes([], tokenizer, known, ends) == []


def test_packing_of_tiny_pieces_is_bounded():
    import pandas as pd

    got = packing._place(3, pd.DataFrame({"__row": range(50_000), "length": [1] * 49_000 + [4096] * 3 + [700] * 997}), 4096)
    lengths = dict(zip(range(50_000), [1] * 49_000 + [4096] * 3 + [700] * 997))
    got["length"] = got["__row"].map(lengths)
    sums = got.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 4096 and len(sums) <= 1.25 * sum(lengths.values()) / 4096 and sorted(got["__row"]) == list(range(50_000))
    assert (got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()


def test_differencing_is_near_equal():
    r = random.Random(3)
    sizes = [r.randint(1, 900) for _ in range(300)]
    window = packing.difference(sizes, 40)
    sums = np.bincount(window, weights=sizes, minlength=40)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() < 60
    assert packing.pack_sizes([], 10) == [] and max(np.bincount(packing.pack_sizes(sizes, 1000), weights=sizes)) <= 1000


def test_fingerprints(spark, docs, toy, empty):
    rows = sorted(toy, key=lambda x: (-x[0], x[1] or ""))
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(toy)
    want = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r[x] <= 1 for r in got for x in ("near_edited", "near_next"))
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[23] == by[3] != by[2] and by[20] == by[21] == ""
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_peeling_recovers_differences(spark):
    r = random.Random(5)
    rows = []
    for k in range(30):
        shared = [r.getrandbits(62) for _ in range(40)]
        rows.append((k, shared + [r.getrandbits(62) for _ in range(k)], shared + [r.getrandbits(62) for _ in range(2 * k)]))
    df = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>")
    size = F.lit(fingerprints.CELLS).cast("long")
    near = fingerprints.likeness(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a"), size), fingerprints.sketch(F.col("b"), size))
    for k, got in df.select("k", near.alias("near")).collect():
        assert got == pytest.approx(40 / (40 + 3 * k))


def brute_parts(text):
    parts = set()
    for line in text.split("\n"):
        for part in re.sub(r"([.!?]|[^ \n]{12}) +", "\\1\n", line).split("\n") if len(line) > fingerprints.LONG else [line]:
            if part.strip(" "):
                parts.add(int(hashlib.md5(part.encode()).hexdigest()[:15], 16))
    return parts


def test_fingerprints_weigh_every_place_alike(spark):
    """Likeness and recovered digests against sets of parts, wherever the edit lies."""
    paragraphs = [prose(i, 20) + "." for i in range(10)]
    one = " ".join(prose(i, 12) + "." for i in range(100, 120))
    pairs = [("\n".join(paragraphs), "\n".join([*paragraphs[:k], prose(99, 20) + ".", *paragraphs[k + 1 :]])) for k in range(10)]
    pairs += [(one, one[:400] + " changed here" + one[400:]), (one, "put before " + one), ("", ""), ("", one), (one, one), ("\n".join(prose(i, 5) for i in range(700)), "\n".join(prose(5000 + i, 5) for i in range(700)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    size = F.lit(fingerprints.CELLS).cast("long")
    df = df.select("i", *[fingerprints.part_digests(F.col(x)).alias(x) for x in "ab"]).select("*", *[fingerprints.sketch(F.col(x), size).alias(f"s{x}") for x in "ab"])
    args = [F.col(x) for x in ("a", "b", "sa", "sb")]
    got = {r["i"]: r for r in df.select("i", fingerprints.likeness(*args).alias("near"), fingerprints.differing(*args).alias("d")).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = brute_parts(a), brute_parts(b)
        assert got[i]["near"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1)
        assert {(r["k"], r["c"]) for r in got[i]["d"]} == {(k, 1) for k in x - y} | {(k, -1) for k in y - x}
    assert len({got[i]["near"] for i in range(10)}) == 1 and got[10]["near"] > 0.8 and got[11]["near"] > 0.8


def test_language_id(spark, docs, empty):
    import string

    r = random.Random(1)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, make(string.ascii_lowercase[:10]), "aa") for i in range(40)] + [(100 + i, make(string.ascii_lowercase[8:20]), "bb") for i in range(40)]
    rows += [(200, None, "aa"), (201, "123 !!", "bb"), (202, make("abc"), None), (203, "", "aa")]
    got = by_id(langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "lang_pred", "score", "held_out")
    assert all(got[i][0] == lang for i, _, lang in rows[:80])
    assert got[200][:2] == got[201][:2] == got[203][:2] == ("und", 0.0) and got[202][0] == "aa"
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, (_, _, h) in got.items())
    assert langid.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 80).split()
        if i % 3 == 0:
            words[i % 70 : i % 70] = ["grumblefool", "snarkbeast"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(900, None), (901, ""), (902, prose(902, 60) + " grumblefoool snarkbeasts")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = by_id(toxicity.score_toxicity(d, lab), "score", "predicted", "held_out")
    held = [i for i, _ in labels if got[i][2]]
    assert sum(got[i][1] == (i % 3 == 0) for i in held) / len(held) > 0.9
    assert got[902][1] == 1 and 0 <= got[900][0] <= 1 and 0 <= got[901][0] <= 1
    assert toxicity.score_toxicity(empty, lab).count() == 0


def test_near_duplicates(spark, docs, toy, empty):
    got = {}
    for r in near_dedup.near_duplicate_classes(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert got[3] == got[23] == got[24] == {3} and got[20] == got[21] == {20}
    assert all(got[i] == {i} for i in (0, 1, 2, 4, 5, 22, 25, 26))
    assert near_dedup.near_duplicate_classes(empty).count() == 0
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _ in toy} - {21, 23, 24})


def test_near_duplicates_with_a_common_template(spark):
    template = " ".join(f"t{i}" for i in range(200))
    own = lambda key, n: " ".join(f"{key}x{i}" for i in range(n))
    rows = [(i, f"{template} {own(f's{i}', 46)}") for i in range(300)]
    for i in range(60):
        rows += [(1000 + 2 * i + j, f"{template} {own(f'p{i}', 90)} {own(f'q{i}{j}', 8)}") for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    owner, h, tf = near_dedup.shingles([t for _, t in rows])
    df = dict(zip(*np.unique(h, return_counts=True)))
    exact = [1 + math.log((1 + len(rows)) / (1 + df[x])) for x in h]
    idf = near_dedup.idf_table(*near_dedup.document_counts(docs))
    assert np.isclose(idf(h), exact).mean() > 0.99
    bags = [dict(zip(h[owner == i].tolist(), ((1 + np.log(tf)) * exact)[owner == i].tolist())) for i in range(len(rows))]

    def similarity(a, b):
        common = sum(min(w, b[x]) for x, w in a.items() if x in b)
        return common / (sum(a.values()) + sum(b.values()) - common)

    linked = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if similarity(bags[i], bags[j]) >= 0.8]
    assert len(linked) == 60
    got = by_id(near_dedup.near_duplicate_classes(docs), "class_id")
    assert sum(got[a] == got[b] for a, b in linked) >= 58
    assert len(set(got.values())) >= len(rows) - 60


def test_consistent_sampling_estimates_similarity():
    a = prose(7, 400).split()
    b = a[:300] + prose(8, 100).split()
    owner, h, tf = near_dedup.shingles([" ".join(a), " ".join(b)])
    weight = near_dedup.weights(h, tf, lambda h: np.ones(len(h)))
    sides = [dict(zip(h[owner == k].tolist(), weight[owner == k].tolist())) for k in (0, 1)]
    common = sum(min(v, sides[1].get(x, 0)) for x, v in sides[0].items())
    exact = common / (sum(map(lambda s: sum(s.values()), sides)) - common)
    sig = near_dedup.samples(owner, h, weight, 2)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.3


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (12, 2), (7, 7)], "a long, b long")
    got = dict(map(tuple, near_dedup.components(edges).collect()))
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 12: 2, 8: 8, 9: 8}
    star = spark.range(1, 3000).selectExpr("id as a", "if(id % 2 = 0, 0, id - 1) as b")
    assert {r["label"] for r in near_dedup.components(star).collect()} == {0}
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """A passage that many documents hold between differing neighbours, in several batches and groups."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "HOT_IN_BATCH", 3)
    monkeypatch.setattr(suffix_dedup, "BATCH", 900)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    common, tails = word(44), [word(30) for _ in range(3)]
    rows = [(i, word(40) + r.choice(tails)[: r.randint(0, 30)] + common + r.choice(tails)[: r.randint(0, 30)] + word(20)) for i in range(70)]
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_repeats(rows)
    assert got == want and 10 < sum(n > 0 for _, n, _, _ in want.values()) < 70


def test_a_very_long_text(spark):
    """One text of a million bytes beside a short one that it repeats."""
    r = random.Random(4)
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(90_000))
    docs = spark.createDataFrame([(1, long[500_000:500_200]), (2, long), (3, long + " end")], "doc_id long, text string")
    got = by_id(suffix_dedup.remove_repeats(docs), "n_removed", "n_spans")
    assert got == {1: (0, 0), 2: (200, 1), 3: (len(long), 1)}
    near = by_id(near_dedup.near_duplicate_classes(docs), "class_id")
    assert near == {1: (1,), 2: (2,), 3: (2,)}
    quick = by_id(fingerprints.fingerprint_documents(docs.where("doc_id = 1")), "near_next")
    assert quick == {1: (1.0,)}


def test_sharding(spark, docs, toy, empty):
    def draw(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)

    equal = {s: 1.0 for s in range(7)}
    got = sharding.assign_shards(docs, equal, equal | {7: 1.0}).collect()
    assert len(got) == len(toy)
    for r in got:
        text = dict(toy)[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["shard"] == max(range(7), key=lambda s: draw(r["doc_id"], s)) and r["grown_shard"] == max(range(8), key=lambda s: draw(r["doc_id"], s))
        assert r["grown_shard"] in (r["shard"], 7)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign_shards(empty, equal).count() == 0
    weighted = {0: 1.0, 1: 3.0, 2: 0.0}
    got = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign_shards(got, weighted).collect()
    score = lambda i, s: weighted[s] / -math.log((draw(i, s) + 0.5) / 2**52)
    assert all(r["shard"] == max((0, 1), key=lambda s: score(r["doc_id"], s)) for r in rows) and 0.71 < sum(r["shard"] for r in rows) / 4000 < 0.79
    nameless = sharding.assign_shards(spark.range(500).selectExpr("cast(null as bigint) as doc_id", "cast(id % 90 as string) as text"), equal).collect()
    assert len({r["shard"] for r in nameless}) == 1 and sorted(r["slot"] for r in nameless) == list(range(500))


def test_quality(spark, docs, toy, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(None, 0), (99, None)], "doc_id long, quality int")
    got = {}
    for r in quality.apply_quality_rules(docs, labels).collect():
        got[r["doc_id"]] = r
    for i, text in toy:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        places = {}
        for k in range(len(words) - 2):
            places.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeat = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeat))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and not (r["base_failed"] and r["kept"])
    assert quality.apply_quality_rules(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in toy if got[i]["kept"])


def test_cutoffs_are_risk_controlled(spark):
    """Steps of each stratum against brute force: strata where all, some and no steps qualify, and the correction for their number."""
    grid = {"a": (0.9, 0.6, 0.3), "b": (0.8, 0.5, 0.2)}
    r = random.Random(8)
    rows, labels, i = [], [], 0
    for stratum, n, high in (("clean", 2000, 0.0), ("some", 2000, 0.012), ("close", 1000, 0.01), ("dirty", 2000, 0.05), ("few", 150, 0.0)):
        for _ in range(n):
            i += 1
            bad = r.random() < high
            rows.append((i, stratum, r.choice([0.55, 0.7]) if bad else r.random() * 0.25, r.random() * 0.15, False))
            labels.append((i, 1))
    rows += [(i + 1, "clean", 1.0, 1.0, True), (i + 2, "unlabelled", 0.95, 0.0, False)]
    labels += [(i + 1, 1), (1, None), (None, 1), (2, 0), (2, 1)]
    features = spark.createDataFrame(rows, "doc_id long, stratum string, a double, b double, base_failed boolean")
    cutoffs = quality.risk_controlled_cutoffs(features, spark.createDataFrame(labels, "doc_id long, quality int"), 0.02, 0.05, grid)
    got = {x["stratum"]: x for x in cutoffs.collect()}

    def tail(n, k, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))

    known = {x for x, q in labels if q == 1}
    by = {}
    for x in rows:
        if x[0] in known and not x[4]:
            by.setdefault(x[1], []).append(x)
    steps = {}
    for stratum, these in by.items():
        steps[stratum] = 0
        for k in range(3):
            rejected = sum(x[2] > grid["a"][k] or x[3] > grid["b"][k] for x in these)
            if tail(len(these), rejected, 0.02) > 0.05 / len(by):
                break
            steps[stratum] = k + 1
    assert {s: (x["cut_a"], x["cut_b"]) for s, x in got.items()} == {s: (grid["a"][k - 1], grid["b"][k - 1]) if k else (None, None) for s, k in steps.items()}
    assert steps["clean"] == 3 and steps["few"] == 0 and len(set(steps.values())) >= 3
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(features, cutoffs, grid).collect()}
    assert kept[i + 2] and not kept[i + 1]


def test_binomial_tail(spark):
    import math

    for n, k, p in ((50, 0, 0.1), (50, 3, 0.1), (400, 9, 0.02)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def brute_repeats(rows, threshold=50):
    least, out = {}, {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - threshold + 1):
            least[data[k : k + threshold]] = min(least.get(data[k : k + threshold], i), i)
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - threshold + 1):
            if least[data[k : k + threshold]] < i:
                gone[k : k + threshold] = b"\1" * threshold
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, toy, empty):
    assert by_id(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(toy)
    r = random.Random(2)
    rows = [(0, "\0" * 60 + "x" * 60), (1, "x" * 60 + "\0" * 60), (2, "b" * 49), (3, "b" * 49), (4, "c" * 50), (5, "c" * 50)]
    rows += [(10 + i, "".join(r.choice("ab") for _ in range(r.randint(0, 9))) * r.randint(1, 30) + "".join(r.choice("abc") for _ in range(40))) for i in range(120)]
    df = spark.createDataFrame(rows + [(None, "c" * 80)], "doc_id long, text string")
    got = by_id(suffix_dedup.remove_repeats(df), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got.pop(None)[:3] == (80, 0, 0)
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.remove_repeats(docs, with_text=True).columns == docs.columns


def test_shared_folder_is_the_session_setting(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
