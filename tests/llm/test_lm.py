import math
import random
import re
from collections import Counter

import pytest

from driftline.llm import lm_delta


def brute(rows, target):
    lower = str.maketrans(lm_delta.UPPER, lm_delta.LOWER)
    texts = [(i, [w for w in re.split(lm_delta.GAP, (t or "").translate(lower)) if w]) for i, t in rows]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for i, ws in texts:
        for m in (0, 1) if i in target else (0,):
            words[m].update(["begin"] * bool(ws) + [(w,) for w in ws])
            pairs[m].update(zip(["begin"] + [(w,) for w in ws], ws))
    v = sum(k != "begin" for k in words[0])
    out = []
    for i, ws in texts:
        total = 0.0
        for h, w in zip(["begin"] + [(w,) for w in ws], ws):
            for m, sign in ((0, 1), (1, -1)):
                n = sum(words[m].values()) - words[m]["begin"]
                one = (words[m][(w,)] + lm_delta.ADDED) / (n + lm_delta.ADDED * v)
                two = (pairs[m][h, w] + lm_delta.ADDED_PAIR) / (words[m][h] + lm_delta.ADDED_PAIR * v)
                total += sign * (math.log(one) + math.log(two)) / 2
        out.append((i, len(ws), total / len(ws) if ws else 0.0))
    return out


@pytest.mark.parametrize("share, bucket, ids", [(lm_delta.SHARE, lm_delta.BUCKET, lm_delta.BROADCAST_IDS), (0.03, 100, 3), (1.0, 50, 0)])
def test_as_brute_force(spark, monkeypatch, share, bucket, ids):
    """With all n-grams hot, some, and none; with ids broadcast and shuffled."""
    monkeypatch.setattr(lm_delta, "BROADCAST_IDS", ids)
    r = random.Random(1)
    good, bad = [f"g{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(r.randint(0, 30)))) for i in range(80)]
    rows += [(80, "ONLY CAPITALS"), (81, None), (82, "..."), (None, "g1 g2 g3"), (83, "one"), (79, rows[79][1])]
    target = {i for i in range(0, 80) if i % 2 and i < 60} | {83}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    aimed = spark.createDataFrame([(i,) for i in target] * 2, "doc_id long")
    key = lambda x: (x[0] is None, x[0] or 0)
    got = sorted(map(tuple, lm_delta.compare(docs, aimed, share, bucket).collect()), key=key)
    want = sorted(brute(rows, target), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)
    side = [sum(x[2] for x in got if x[0] is not None and x[0] < 80 and x[0] % 2 == k) for k in (0, 1)]
    assert side[1] < 0 < side[0]


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1,), (None,)], "doc_id long")
    rows = lm_delta.compare(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    assert all((r["n_tokens"], r["delta"]) == (0, 0) for r in rows if r["doc_id"] in (2, 3, 4))
    assert lm_delta.compare(no_documents, labels).count() == 0
    assert lm_delta.compare(odd_documents, labels.limit(0)).count() == len(rows)


def test_hot_pairs_do_not_depend_on_partitions(spark):
    """What the driver gathers is the pairs that are hot in all texts, however small the parts that they lie in."""
    r = random.Random(3)
    rows = [(i, " ".join(["the same"] * 20 + [f"w{r.randrange(400)}" for _ in range(60)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(doc_id % 2 AS int) AS target")
    tokens = 300 * 100
    pairs = Counter()
    for _, t in rows:
        words = t.split()
        pairs.update(zip(["begin", *words], words))
    least = 0.001 * tokens
    want = sorted(n for n in pairs.values() if n >= least)
    assert 3 <= len(want) <= 1000
    for parts in (1, 64, 512):
        got = lm_delta.hot_pairs(docs.repartition(parts), least)
        assert sorted(got.n.tolist()) == want
