"""Spelling variants, collocations and main text against brute force, with nulls, ties, long texts, copies and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import main_text, phrases, variants
from bitloom.llm.page_layouts import Layout

COLUMNS = "doc_id long, text string, lang string, source string, n long, word string, phrase string, tile int, block string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    stems = ["".join(r.choice("abeiorst") for _ in range(r.randint(4, 8))) for _ in range(60)]
    stems += ["größe", "grosse", "ÀÉÎõü", "naïve", "café", "Ñandú", "aaaaaa", "aaaaa", "aaaaaaa", "listen", "silent", "enlist"]

    def word():
        w = r.choice(stems[: r.randint(1, len(stems))])
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", r.choice("aeéx"), w[k] + r.choice("sße")]) + w[k + 1 :]
        return w.upper() if r.random() < 0.1 else w

    def text(n):
        return "".join(word() + r.choice(["  ", " ", " ", " ", " ", "\t", ", ", ".", "\n", "-", " 7 ", " "]) for _ in range(n))

    found = [(i, text(r.randint(0, 120)), r.choice(["en", "fr", None])) for i in range(60)]
    found += [(100, None, "en"), (101, "", "en"), (102, " .;  ", None), (3, found[3][1], found[3][2]), (3, found[3][1], found[3][2]), (None, found[4][1], "fr"), (105, "kettle " * 3 + "kettles " * 7 + "kettlest " * 20, "en"), (103, "z" * 5000 + " " + "z" * 4999, "de"), (104, ("z" * 5000 + " ") * 3 + ("z" * 4999 + "! ") * 7, "de")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "w", "p", 2, "b") for i, t, lang in rows], COLUMNS)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    fold, count = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 5
    n = {w: c for w, c in count.items() if c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def test_spelling_variants(docs, rows, monkeypatch):
    want = brute_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())
    read = lambda: {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(docs).collect()}
    assert read() == want
    # Many parts of a block: no pair is lost between them.
    monkeypatch.setattr(variants, "SIDE", 2)
    assert read() == want


def test_no_table_of_words_is_broadcast(spark, docs):
    """Spark estimates tables of words by their compressed size before an explode, far too low to broadcast them."""
    plans = [variants.near_words(variants.word_counts(docs)), variants.group_variants(docs)]
    for plan in (p._jdf.queryExecution().executedPlan().toString() for p in plans):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_words_of_any_shape():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abà") for _ in range(r.choice((5, 6)))) for _ in range(400)})
    short, long = [w for w in words if len(w) == 5], [w for w in words if len(w) == 6]
    for a, b in ((short, short), (short, long), (long, long)):
        i, j = variants._near_pairs(variants._letters(a, len(a[0])), variants._letters(b, len(b[0])))
        assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x, v in enumerate(a) for y, w in enumerate(b) if one_edit(v, w)]


def brute_phrases(rows, least=10, share=50, top=2000):
    fold, counts, total = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(fold)):
            words = tuple(w for w in re.split(r"[ \t]+", piece) if w)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang or "und", Counter()).update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= share * a and p in (q[:2], q[1:]) for q, b in f.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations(spark, rows):
    r = random.Random(9)
    said = "The the of OF a une é ça x7 -- new york new haven".split()
    more = [(200 + i, "".join(said[min(r.randrange(14), r.randrange(14))] + r.choice("   \t .,\n") for _ in range(90)), r.choice(["en", "en", "fr", None])) for i in range(80)]
    more += [(300 + i, f"a{i} go to town. {i}" * 3, "en") for i in range(12)]
    rows = rows + more
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "w", "p", 2, "b") for i, t, lang in rows], COLUMNS)
    want = brute_phrases(rows)
    assert brute_phrases([]) == [] and phrases.mine_collocations(docs.limit(0)).count() == 0
    assert len(want) > 50 and {x[0] for x in want} >= {"en", "fr", "und"}
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    read = lambda: sorted(tuple(r[c] for c in names) for r in phrases.mine_collocations(docs).collect())
    assert read() == want


def test_counts_of_small_shards_add_up(spark, rows):
    """Shards of a few words, texts cut into stretches, and a full filter give the same counts."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for _, _, lang in rows]), pa.array([t or "" for _, t, _ in rows])], ["lang", "text"])

    def counted(run):
        total = Counter()
        for b in run(iter([batch])):
            for lang, phrase, n in zip(*(c.to_pylist() for c in b.columns)):
                total[lang, phrase] += n
        return total

    class Full:
        value = b"\xff" * (phrases.FILTER_BITS // 8)

    whole = counted(phrases._short), counted(phrases._long(Full))
    before = phrases.SHARD_WORDS, phrases.STRETCH
    try:
        phrases.SHARD_WORDS, phrases.STRETCH = 50, 100
        assert (counted(phrases._short), counted(phrases._long(Full))) == whole
    finally:
        phrases.SHARD_WORDS, phrases.STRETCH = before
    assert max(whole[1].values()) > 10


def test_intervals_are_kept_in_step():
    r = np.random.default_rng(3)
    ids = np.concatenate([[0], r.integers(0, 6, 500), [0]])
    index = phrases.Index(ids, 6)
    text = ids.tolist()
    for first, second in ((True, True), (True, False), (False, True), (False, False)):
        found = index.extend(index.extend(index.singles, first), second)
        want = Counter(tuple(text[i : i + 3]) for i in range(len(text) - 2) if 0 not in text[i : i + 3])
        assert {tuple(w): n for w, n in zip(found.words.tolist(), found.count.tolist())} == want
    lexed = phrases._order([ids, np.roll(ids, -1)], 40)
    assert (lexed == phrases._order([ids, np.roll(ids, -1)], 3)).all()


PAGES = {
    1: ("<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class='ad'>Buy now.</div><article><h1>A  title</h1><p><b>One &amp; two&nbsp;&lt;three&gt;<br><p>Four</p></article><footer>&copy; x</footer>", "A title One & two <three> Four"),
    2: ("<body><div class='top-menu'><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id='main-content'><h1>Title</h1><p>First <i>par</i>t, with some words in it.</p><div class='ad-box'>Shoes!</div><p>Second, and last.</p><script>var x = '<p>no</p>';</script></div><div class='comments'><h3>2 comments</h3><div class='comment'><p>Nice story, really.</p></div></div><div class='cookie-notice'>We use cookies.</div></body>", "Title First part, with some words in it. Second, and last."),
    3: (None, ""),
    4: ("", ""),
    5: ("Only text.", "Only text."),
    6: ("<article>Cut <b>short &am", "Cut short &am"),
    7: ("<article><p>x</p></article>", "x"),
    8: ("<div>" * 3000 + "<p>deep" + "</div>" * 10, "deep"),
}


@pytest.fixture(scope="module")
def model():
    return main_text.train_main_text_model()


def test_main_text(spark, model):
    rows = [(i, f"http://a/{i}", h, "t", 1, 2.0) for i, (h, _) in PAGES.items()] + [(1, "http://b", PAGES[1][0], "t", 1, 2.0), (None, None, PAGES[7][0], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, score double")
    got = main_text.extract_main_text(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert found == sorted([(i, t, len(t)) for i, (_, t) in PAGES.items()] + [(1, PAGES[1][1], len(PAGES[1][1])), (0, "x", 1)], key=str)
    assert main_text.extract_main_text(pages.limit(0), model).count() == 0


def test_long_pages(model):
    said = "".join(f"<p>Sentence {i}, with a few words.</p>" for i in range(30_000))
    [got] = model.texts([f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{said}</article></body>"])
    assert got == " ".join(f"Sentence {i}, with a few words." for i in range(30_000))


def test_unseen_layouts(model):
    """Layouts that were not learned from: nearly every page comes out whole."""
    exact = 0
    for k in range(200):
        html = Layout(10**9 + k).page()
        page = main_text.Page(html)
        want = page.text_of(main_text._labels(page) == main_text.C)
        exact += model.texts([re.sub(r' data-y="."', "", html)])[0] == want
    assert exact >= 188


def test_decoding_agrees_with_the_tree_and_is_the_likeliest(model):
    import itertools

    r = np.random.default_rng(0)
    for k in range(30):
        page = main_text.Page("<a><b></b><b><i></i></b></a>" if k % 2 else "<p>x<b>y<i>z</i></b></p><u></u>")
        chances = np.log(r.dirichlet([1, 1, 1], len(page.names)))
        fits = lambda y: all(y[i] == main_text.B if y[p] == main_text.B else y[i] != main_text.O if y[p] == main_text.C else True for i, p in enumerate(page.parent) if i)
        best = max((y for y in itertools.product((0, 1, 2), repeat=len(page.names)) if fits(y)), key=lambda y: sum(chances[i, s] for i, s in enumerate(y)))
        assert tuple(main_text.decode_tree(page, chances)) == best
