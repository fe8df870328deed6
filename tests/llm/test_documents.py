"""Document operators against plain Python, on odd rows and on the smallest driver tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewatch.llm import byte_bpe, licenses, mixing, near_dedup, quality_model, quality_rules, substring_dedup
from tests.llm.conftest import ODD_TEXTS, passage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text, n):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def true_components(texts, n):
    sets = {i: shingles(t, n) for i, t in texts.items() if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_near(got, texts, n):
    want = true_components(texts, n)
    for r in got:
        assert r.n_shingles == (len(shingles(texts[r.doc_id], n)) if r.doc_id is not None else r.n_shingles)
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))


def test_near_duplicates_odd_rows(odd, empty):
    for n in (1, 2, 5):
        got = near_dedup.near_duplicates(odd, n).collect()
        assert len(got) == odd.count()
        check_near(got, dict(enumerate(ODD_TEXTS)), n)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_hot_nodes_and_components(spark):
    """Small limits take the ways for very large nodes and components: branching, random splits, blocks, left-over documents."""
    draw = np.random.default_rng(0)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(60):  # near copies of one text
        own = list(base)
        own[int(draw.integers(100))] = f"x{i}"
        rows.append((i, " ".join(own)))
    chain = list(base)
    for i in range(60, 75):  # a chain that leaves the group step by step
        for k in draw.choice(100, 4, replace=False):
            chain[k] = f"y{i}-{k}"
        rows.append((i, " ".join(chain)))
    rows += [(i, passage(80, 1000 * i)) for i in range(75, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (2, 5):
        check_near(near_dedup.near_duplicates(docs, n, node_rows=10, block_rows=12).collect(), dict(rows), n)


def test_near_duplicates_of_a_template_stay_in_bounded_tasks(spark, monkeypatch):
    """Documents of one template, loosely linked and nearly all left over: no task holds more than two blocks of them."""
    exact, block_rows = near_dedup._exact, 20

    def watched(n):
        compare = exact(n)

        def run(batches):
            def checked():
                rows = {}
                for batch in batches:
                    for part in batch.column("part").to_pylist():
                        rows[part] = rows.get(part, 0) + 1
                    yield batch
                if max(rows.values(), default=0) > 4 * block_rows:  # blocks are dealt by a hash: about 20 rows each
                    raise ValueError(f"{max(rows.values())} rows in one task")

            return compare(checked())

        return run

    monkeypatch.setattr(near_dedup, "_exact", watched)
    rows = [(i, " ".join([passage(150), passage(35, 1000 * (i + 1))])) for i in range(200)]
    rows += [(200 + i, rows[10 * i][1] + " one more") for i in range(15)]  # true copies, far apart in the blocks
    rows += [(300, rows[3][1] + " " + passage(30, 1000 * 4 + 35)), (301, rows[3][1] + " " + passage(70, 1000 * 4 + 35))]  # a chain
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(near_dedup.near_duplicates(docs, 2, block_rows=block_rows).collect(), dict(rows), 2)
    size = sum(len(t) for _, t in rows) // 11
    check_near(near_dedup.near_duplicates(docs, 2, block_bytes=size).collect(), dict(rows), 2)


def test_near_duplicates_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_near(near_dedup.op7_near_dedup(spark, sf_dir).collect(), texts, 2)
    check_near(near_dedup.near_duplicates(docs).collect(), texts, 5)


def test_substrings_odd_rows(odd, empty, spark):
    first = {}
    for i, t in enumerate(ODD_TEXTS):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for width in (15, 28):  # 15: a sketch so small that it may let anything through
        for r in substring_dedup.without_repeats(odd, most_width=width).collect():
            w = words(ODD_TEXTS[r.doc_id]) if r.doc_id is not None else None
            if w is None:
                assert r.n_removed == 0
                continue
            gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r.doc_id for p in range(k, k + 50)}
            kept = [x for p, x in enumerate(w) if p not in gone]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
            assert words(r.left_text) == kept
            if not gone:
                assert r.left_text == ODD_TEXTS[r.doc_id]
    assert substring_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("open_bits", [28, 15])
def test_substrings_of_two_texts_under_one_id(spark, open_bits, monkeypatch):
    """Spans of one text must not cut another one of the same id, shorter or longer; blocks come by bitmap or by join."""
    if open_bits == 15:
        monkeypatch.setattr(substring_dedup, "LEAST_PER_OPEN", 1 << 16)  # no bitmap is large enough
    clean = [passage(55, 9000), passage(300, 20_000)]
    rows = [(1, passage(80)), (2, "head " + passage(120) + " tail"), (2, clean[0]), (2, clean[1]), (2, clean[1]), (3, passage(70, 20_100)), (3, clean[0] + " more"), (4, passage(100, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        for k in range(len(t.split()) - 49):
            w = tuple(t.split()[k : k + 50])
            first[w] = min(i, first.get(w, i))
    want = []
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, " ".join(words_of(r.left_text))) for r in substring_dedup.without_repeats(docs, most_width=open_bits).collect()]
    assert sorted(got) == sorted(want)
    assert {g[2] for g in got if g[0] == 2} == {80, 0}


def words_of(text):
    return [w.decode() for w in words(text)]


def test_sketch_widths():
    assert substring_dedup.sketch_width(1) == 15 and substring_dedup.sketch_width(10**6) == 23 and substring_dedup.sketch_width(10**12) == 28


def test_each_limit_of_repetition_rejects_alone(spark):
    texts = {
        "clean": passage(400), "covered": passage(30) + " " + passage(400, 1000) + " " + passage(30), "few": passage(20) + " " + passage(400, 1000) + " " + passage(20),
        "longest": passage(60) + " " + passage(2000, 1000) + " " + passage(60), "short enough": passage(49) + " " + passage(2000, 1000) + " " + passage(49),
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {name: r for name, r in zip(texts, sorted(quality_rules.quality_rules(docs).collect(), key=lambda r: r.doc_id), strict=True)}
    assert not any(r.base_failed for r in got.values())
    assert [name for name, r in got.items() if not r.kept] == ["covered", "longest"]
    covered, longest = got["covered"], got["longest"]
    assert 100 * covered.n_covered > quality_rules.COVERED * covered.n_words and covered.longest_repeat <= quality_rules.LONGEST
    assert 100 * longest.n_covered <= quality_rules.COVERED * longest.n_words and longest.longest_repeat > quality_rules.LONGEST


def test_near_duplicates_of_two_texts_under_one_id(spark):
    a, b, c = passage(60), passage(60, 500), passage(60, 900)
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " x"), (4, c), (5, ""), (5, c), (None, a), (None, None), (6, passage(60, 3000)), (6, passage(60, 4000))]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, key string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 5, True), (0, 0, True), (0, 0, True), (6, 6, True), (6, 6, True)])
    kept = near_dedup.kept_rows(docs, 2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, a), (2, b), (4, c), (5, ""), (0, a), (0, ""), (6, passage(60, 3000)), (6, passage(60, 4000))])
    assert sorted(r.doc_id for r in near_dedup.kept_rows(docs.where("doc_id in (1, 4)").unionAll(docs.where("doc_id = 1")), 2).collect()) == [1, 4]


def brute_repeats(w, least, length=None):
    n, inside = len(w), set()
    for span in [length] if length else range(least, n):
        at = defaultdict(list)
        for k in range(n - span + 1):
            at[tuple(w[k : k + span])].append(k)
        hit = [k for ks in at.values() if len(ks) > 1 for k in ks]
        if not hit:
            break
        inside |= {p for k in hit for p in range(k, k + span)}
    return len(inside)


def test_quality_rules_odd_rows(odd, empty):
    for r in quality_rules.quality_rules(odd).where("doc_id is not null and doc_id <> 15").collect():
        text = ODD_TEXTS[r.doc_id] or ""
        w = words(text)
        lines = [x for x in text.split("\n") if WORD.search(x.encode())]
        covered = brute_repeats(w, quality_rules.SPAN)
        longest = max((n for n in range(1, len(w)) if max(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)).values()) > 1), default=0)
        assert r.n_words == len(w) and r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(w, 3, 3) and r.n_covered == covered and r.longest_repeat == longest
        failed = len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w)
        assert r.base_failed == failed
        assert r.kept == (not failed and 100 * covered <= quality_rules.COVERED * len(w) and longest <= quality_rules.LONGEST)
    assert quality_rules.quality_rules(odd).count() == odd.count()
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.kept_documents(empty).count() == 0
    assert set(quality_rules.kept_documents(odd).columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def encoding():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(odd, empty, spark, sf_dir):
    path, pattern, known = encoding()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "a" * 600), (10_001, "\n\n x\r\n  y  "), (10_002, "<|endoftext|>"), (10_003, "z\u00a0\n\n b")], "doc_id long, text string")
    for docs in (odd, table, extra):
        texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
        got = byte_bpe.digests(byte_bpe.encode_and_decode(docs, path, pattern), "ids").collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is None:
                continue
            ids = np.array(known.encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()
            assert (r.n_tokens, bytes(r.ids)) == (len(ids) // 4, ids)
            assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.encode_and_decode(empty, path, pattern).count() == 0


def check_mix(docs):
    draws, sized = mixing.mix(docs)
    rows, uses = sized.collect(), Counter(r.key for r in draws.collect())
    assert len(rows) == docs.count() and len({r.key for r in rows}) == len(rows)
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert uses[r.key] <= 2
        size[r.source] += r.size
        taken[r.source] += r.size * uses[r.key]
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        capped.update((s, 2 * size[s]) for s in over)
    for s in order:
        assert target[s] == pytest.approx(capped.get(s, level * weight[s]))
        assert target[s] - largest[s] <= taken[s] <= target[s] + 1e-6
    shards = draws.groupBy("shard").count().collect()
    return len(shards)


def test_mixing_goes_on_past_long_documents(spark):
    """Sources of one block each, with documents too long for what is left: no unused document fits into the gap."""
    rows = [(1000 * k + i, f"s{k}", passage(30 + i % 7)) for k in range(9) for i in range(100)]
    rows += [(1000 * k + 500 + i, f"s{k}", passage(1200 + 10 * i)) for k in range(9) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    draws, sized = mixing.mix(docs)
    uses, sources = Counter(r.key for r in draws.collect()), defaultdict(list)
    for r in sized.collect():
        sources[r.source].append(r)
    for own in sources.values():
        gap = own[0].target - sum(r.size * uses[r.key] for r in own)
        passes = own[0].target // own[0].source_size
        unused = [r.size for r in own if uses[r.key] <= passes]
        assert gap >= -1e-6 and (passes == mixing.PASSES or gap < min(unused))


def test_mixing(odd, empty, spark, sf_dir):
    check_mix(odd)
    check_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert mixing.mix(empty)[0].count() == 0
    first, again = (sorted(map(tuple, mixing.op10_mixing(spark, sf_dir).collect())) for _ in range(2))
    assert first == again
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.mix(odd)[0].count()


def test_splitting_tree_deals_every_draw_once():
    import pyarrow as pa

    counts, shards = [37, 0, 5, 1000], 13
    dealt = [set() for _ in counts]
    for batch in mixing._shards(counts, shards, 1)(iter([pa.record_batch([pa.array(range(shards))], ["id"])])):
        for number, first, n in zip(*(batch.column(c).to_pylist() for c in ("number", "first", "n")), strict=True):
            own = set(range(first, first + n))
            assert not own & dealt[number]
            dealt[number] |= own
    assert [len(d) for d in dealt] == counts


def test_quality_scores(odd, empty, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_model.op1_quality_model(spark, sf_dir).join(labels.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in apart) >= 0.85 * len(apart)
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    scores = quality_model.quality_scores(odd, no_labels).collect()
    assert len(scores) == odd.count() and {r.score for r in scores} == {0.5}
    assert quality_model.quality_scores(empty, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in quality_model.quality_scores(odd, labels).collect())


def test_licences(odd, empty, spark):
    assert licenses.licences(odd).count() == odd.count() and licenses.licences(empty).count() == 0
    rows = [
        (1, "Intro.\nCopyright (c) 2020 Someone\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit-text"),
        (2, "Licensed under the Apache License, Version 2.0. Other words.", "apache-2.0-notice"),
        (3, "Released under the MIT License! Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0-notice,mit-notice"),
        (4, "No licence here.", None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.licences(docs).collect()}
    assert {k: v and ",".join(sorted(v.split(","))) for k, v in got.items()} == {r[0]: r[2] for r in rows}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [0, 60, 78])
def test_complete_licences(spark, mark, width):
    import textwrap

    texts = {"apache-2.0-header": "Copyright 2020 Some One\n\n" + APACHE, "mit-text": MIT, "bsd-2-clause": BSD2 + DISCLAIMER, "bsd-3-clause": BSD3 + DISCLAIMER, "gpl-3.0-or-later-notice": GPL}
    rows = []
    for name, text in texts.items():
        lines = [x for line in text.split("\n") for x in (textwrap.wrap(line, width) if width and line else [line])]
        for end in ("\n", "\r\n"):
            rows.append((f"{name} {len(rows)}", end.join(["import x", "", *(mark + x for x in lines), "", "code()"])))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.licences for r in licenses.licences(docs).collect()} == {k: k.split()[0] for k, _ in rows}
    no = spark.createDataFrame([(1, "It is not released under the MIT license."), (2, GPL.replace("version 3", "version 2"))], "doc_id long, text string")
    assert all(r.licences is None for r in licenses.licences(no).collect())
