import random

import numpy as np
import pytest

from driftline.llm import decontaminate as dc


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (dc.MATCH if a[i] == b[j] else dc.MISMATCH), h[i, j + 1] + dc.GAP, h[i + 1, j] + dc.GAP)
    return h.max() / (dc.MATCH * len(a))


def test_alignment_as_the_full_table():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = r.integers(0, 5, r.integers(1, 12)).astype(np.uint64), r.integers(0, 5, r.integers(1, 25)).astype(np.uint64)
        score, start, end = dc.align(a, b)
        assert score == pytest.approx(smith_waterman(a, b))
        if score:
            assert dc.align(a, b[start:end])[0] == pytest.approx(score)


def test_finds_copies_and_edits_and_leaves_the_rest(spark):
    r = random.Random(6)
    words = [f"v{k}" for k in range(200)] + ["the", "of", "and"] * 60
    sentence = lambda n: [r.choice(words) for _ in range(n)]
    items = [sentence(30) for _ in range(12)]
    docs, want = [], set()
    for i in range(300):
        w = sentence(80)
        if i % 5 == 0:
            k = i // 5 % 12
            copy = list(items[k])
            if i % 2:  # every sixth word is another one
                for j in range(3, 30, 6):
                    copy[j] = "é" + copy[j]
            w[40:40] = copy
            want.add((i, k))
        docs.append((i, "É. " + " ".join(w)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(None, "a"), (99, None)], "item_id long, text string")
    got = dc.leaks(docs, benchmark).collect()
    assert {(g["doc_id"], g["item_id"]) for g in got} == want
    text = {x["doc_id"]: x["text"] for x in docs.collect()}
    for g in got:
        if g["score"] == 1:
            assert text[g["doc_id"]][g["start"] : g["end"]] == " ".join(items[g["item_id"]])
    assert dc.clean(docs, benchmark).count() == 240
    assert dc.clean(docs, benchmark.limit(0)).count() == 300


def test_blocks_give_the_same_and_items_may_have_names(spark):
    items = spark.createDataFrame([(f"i{k}", f"a{k} b{k} c{k} d{k} e{k}") for k in range(9)], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"x a{k} b{k} c{k} d{k} e{k} y a8 b8 c8 d8 e8") for k in range(9)], "doc_id long, text string")
    whole = sorted(dc.leaks(docs, items).collect())
    assert len(whole) == 17 and {r["item_id"] for r in whole} == {f"i{k}" for k in range(9)}
    assert sum(len(b[0]) for b in dc.blocks(items, 3)) == sum(len(b[0]) for b in dc.blocks(items, 9, 10)) == 9
    parted = dc.matched(docs, items, block=3).collect()
    assert sorted((r["doc_id"], *m) for r in parted for m in r["matches"]) == [tuple(r) for r in whole]
    assert all([m["item_id"] for m in r["matches"]] == sorted(m["item_id"] for m in r["matches"]) for r in parted)


def test_odd_rows(spark, odd_documents, no_documents):
    benchmark = spark.createDataFrame([(1, "plain text of some words"), (2, "")], "item_id long, text string")
    assert {r["doc_id"] for r in dc.leaks(odd_documents, benchmark).collect()} == {1, 6}
    kept = dc.clean(odd_documents, benchmark)
    assert kept.count() == odd_documents.count() - 3 and kept.columns == odd_documents.columns
    assert kept.exceptAll(odd_documents).count() == 0
    assert dc.leaks(no_documents, benchmark).count() == 0


def test_edited_copies_beside_an_exact_one_as_without_seeds(spark):
    r = random.Random(8)
    words = [f"v{k}" for k in range(400)] + ["the", "of", "and"] * 40
    items = [[r.choice(words) for _ in range(n)] for n in (39, 39, 39, 24, 5, 4, 3)]
    texts = []
    for x in items:
        texts.append(list(x))
        for every in (2, 3, 4, 5):
            texts.append([f"e{k}" if k % every == 0 else w for k, w in enumerate(x)])
            texts.append([y for k, w in enumerate(x) for y in ((w, f"i{k}") if k % (every - 1) == 0 else (w,))])
            texts.append([w for k, w in enumerate(x) if k % every])
    texts = [[r.choice(words) for _ in range(30)] + t + [r.choice(words) for _ in range(30)] for t in texts] + texts
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    number = {w: k for k, w in enumerate({w for t in [*texts, *items] for w in t})}
    coded = lambda t: np.array([number[w] for w in t], np.uint64)
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            score = dc.align(coded(x), coded(t))[0]
            if score >= dc.LEAST:
                want[i, k] = score
    assert sum(k < 3 for _, k in want) >= 3 * 2 * 9
    got = {(g["doc_id"], g["item_id"]): g["score"] for g in dc.leaks(docs, benchmark).collect()}
    assert got == pytest.approx(want)


def test_seeds_in_parts_give_the_same(monkeypatch):
    r = random.Random(9)
    items = [[f"v{r.randrange(20)}" for _ in range(12)] for _ in range(6)]
    texts = [" ".join(["x", *items[k % 6], *items[k % 5]]) for k in range(20)]
    known = dc.Items(list(range(6)), [" ".join(x) for x in items])
    whole = dc.search(texts, known, dc.LEAST)
    for hits in (1, 40, 300):
        monkeypatch.setattr(dc, "HITS", hits)
        assert dc.search(texts, known, dc.LEAST) == whole
    assert all(whole)
