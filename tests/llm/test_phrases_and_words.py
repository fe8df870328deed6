"""Collocations, the Jaccard join and spelling variants against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from planewatch.llm import collocations, jaccard_join, spelling
from tests.llm.conftest import DOC, ODD_TEXTS, passage
from tests.llm.test_documents import shingles, true_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def true_phrases(rows, least, inside=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in able.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        kept = []
        for p, a in able.items():
            if 100 * longest[p] >= inside * a and longest[p]:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


PHRASES = [
    "new york city. new york city! New York state; new\tyork  city\nthe new", "a a a a a a", None, "", " \t ", "...", "b\x01 c b\x01 c, b c b c", "x " * 50,
    "É a É a é b", "alone", "one two three four five. one two three four six. one two three. two three four", "one two three four five\x0bone\x0ctwo\rthree",
]


@pytest.mark.parametrize("least, more", [(1, {}), (2, {"buffer": 40, "hot": 3}), (3, {"buffer": 64, "hot": 1000, "open_bytes": 8}), (2, {"inside": 50, "top": 3})])
def test_collocations(spark, odd, empty, least, more):
    rows = [("en" if i % 3 else None, t) for i, t in enumerate(PHRASES * 3)] + [("und", "a a a"), ("xx", "lone words only")]
    docs = spark.createDataFrame([(0, *r[::-1], "clash") for r in rows], "doc_id long, text string, lang string, phrase string")
    want = true_phrases(rows, least, more.get("inside", 80), more.get("top", 2000))
    assert want and sorted(map(tuple, collocations.collocations(docs, least, **more).collect())) == want
    assert collocations.collocations(empty, least).count() == 0


def test_collocations_of_odd_rows(spark, odd):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations.collocations(odd, 2, buffer=5000).collect())) == true_phrases(rows, 2)


def test_stretches_of_a_long_piece_count_each_position_once():
    text = passage(500).encode()
    for most in (1, 7, 100, 10_000):
        batch = collocations.pa.RecordBatch.from_arrays([collocations.pa.array(["en"]), collocations.pa.array([text])], ["lang", "text"])
        total = sum(int(collocations._Grams(b).n.sum()) for b in collocations._buffers(iter([batch]), most))
        assert total == 500


def test_jaccard_odd_rows(spark, odd, empty):
    for words, block in ((5, 512), (2, 2), (1, 3)):
        got = jaccard_join.jaccard_components(odd, words, block).collect()
        assert len(got) == odd.count()
        want = true_components(dict(enumerate(ODD_TEXTS)), words)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
            assert r.doc_id is None or r.n_shingles == len(shingles(ODD_TEXTS[r.doc_id], words))
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_of_hot_groups(spark):
    """Near copies, a chain that leaves them, documents of one template that do not link, and large trees in blocks."""
    draw = np.random.default_rng(0)
    base, rows = [f"b{i}" for i in range(100)], []
    for i in range(60):
        own = list(base)
        own[int(draw.integers(100))] = f"x{i}"
        rows.append((i, " ".join(own)))
    chain = list(base)
    for i in range(60, 75):
        for k in draw.choice(100, 4, replace=False):
            chain[k] = f"y{i}-{k}"
        rows.append((i, " ".join(chain)))
    rows += [(i, passage(80, 1000 * i)) for i in range(75, 90)]
    rows += [(i, passage(60, 7) + " " + passage(25, 5000 * i)) for i in range(90, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (2, 5):
        want = true_components(dict(rows), words)
        for block in (4, 512):
            assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, words, block).collect()} == want


def test_jaccard_packs_only_texts_of_groups(spark, monkeypatch):
    texts = [" ".join(f"d{i}w{k}" for k in range(40)) for i in range(60)]
    texts += [texts[0] + " more", texts[1]]
    packed, pack = spark.sparkContext.accumulator(0), jaccard_join._packed

    def counted(batches):
        for batch in pack(batches):
            packed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(jaccard_join, "_packed", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i for i in range(60)} | {60: 0, 61: 1}
    assert 2 <= packed.value < 20  # of 62 texts, each of them twice before


def test_jaccard_of_two_texts_under_one_id(spark):
    rows = [(1, passage(60)), (2, passage(60)), (2, passage(60, 500)), (3, passage(60, 500)), (4, passage(61, 900)), (5, ""), (5, passage(60, 900)), (6, passage(50, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5), (6, 6)}


def test_bounds_of_trees_never_lose_a_pair():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 400, draw.integers(1, 60))) for _ in range(300)]
    sets += [np.unique(np.r_[s[:-1], draw.integers(0, 400, 1)]) for s in sets[:100]]
    sets.sort(key=len)
    bitmap = np.zeros((len(sets), jaccard_join.BITS // 64), np.uint64)
    for i, s in enumerate(sets):
        for t in s % 37:  # many shingles on one bit
            bitmap[i, 0] |= np.uint64(1) << np.uint64(t)
    size = np.array([len(s) for s in sets])
    forest = jaccard_join.Forest(np.zeros(len(sets), np.int64), size, bitmap, np.arange(len(sets)), np.zeros(len(sets), np.int64))
    found = {tuple(sorted(p)) for a, b in forest.pairs() for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both < 80 * (size[i] + size[j] - both) or (j, i) in found


def true_variants(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    n = {w: k for w, k in n.items() if k >= 3}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: best for w, x in near.items() if x for best in [min(x, key=lambda y: (-n[y], y))] if n[best] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n.get(form.get(w), 0)) for w in n)


@pytest.mark.parametrize("often, most", [(500, 200_000), (3, 5), (0, 0), (10**9, 0)])
def test_spelling(spark, empty, often, most):
    draw = np.random.default_rng(1)
    texts, letters = [], list("abé")
    for _ in range(60):  # few letters: many near words, repeated grams, ties
        words = ["".join(draw.choice(letters, draw.integers(3, 9))) for _ in range(120)]
        texts.append(" ".join(words) + " Receive RECEIVE receive receive recieve recieve recieve receeve receve9receve receve banana bananana bananana bananana bananas")
    rows = list(enumerate(texts)) + [(None, texts[0]), (1, texts[1]), (7, None), (8, ""), (9, "aaaaaÿ×÷ " * 4 + "z" * 3000 + " " + ("z" * 2999 + "y ") * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_variants(docs, often, most).collect())
    assert got == true_variants(rows)
    assert any(form and form != root for _, form, root, *_ in got)
    assert spelling.spelling_variants(empty).count() == 0


def test_spelling_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.op13_spelling(spark, sf_dir).collect())
    want = true_variants(rows)
    assert got == want
    assert DOC and got
