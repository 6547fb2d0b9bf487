import itertools
import random

import pytest

from driftline.llm import minmax_dedup as md


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(words)])) if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        met = len(sets[a] & sets[b])
        if met and 100 * met >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent", "ids"), [(3, 85, md.BROADCAST_IDS), (5, 80, 0)])
def test_as_brute_force_with_a_large_group(spark, monkeypatch, words, percent, ids):
    monkeypatch.setattr(md, "BROADCAST_IDS", ids)
    r = random.Random(words)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = []
    for _ in range(150):  # near copies of one text, not all near to each other
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        rows.append(" ".join(copy))
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(100):  # a passage that many share, and no link
        own = [r.choice(vocabulary) for _ in range(60)]
        rows.append(" ".join(passage + own))
    rows += [rows[0]] * 40 + ["a b", "A  b", "a c", "", None, "  ", "b"]
    r.shuffle(rows)
    table = list(enumerate(rows))
    got = md.classes(spark.createDataFrame(table, "doc_id long, text string"), words, percent).collect()
    want = brute(table, words, percent)
    assert len(got) == len(table)
    for x in got:
        assert (x["n_shingles"], x["component_id"]) == want[x["doc_id"]]
        assert x["kept"] == (x["doc_id"] == x["component_id"])


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    got = {r["id"]: r["component"] for r in md.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 40 else i for i in range(60)}


def test_bands_keep_the_miss_small():
    for t in (0.8, 0.85):
        assert (1 - t**md.ROWS) ** md.bands_for(t) <= md.MISS


def test_odd_rows(odd_documents, no_documents):
    got = md.classes(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 6)} == {1}
    assert all(r["kept"] for r in got if r["doc_id"] in (2, 3, 4, 5, 7, 8))
    assert md.classes(no_documents).count() == 0
    kept = md.deduplicated(odd_documents)
    assert kept.columns == odd_documents.columns and kept.exceptAll(odd_documents).count() == 0
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
