import math
from collections import Counter

import numpy as np
import pytest

from driftline.llm import topk_products as tp


def brute(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) by all products."""
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, v) in enumerate(kept):
        if i is None or i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, (j, w) in enumerate(kept) if m != n and len(w) == len(v)]
        for rank, (score, _, _, j) in enumerate(sorted(others, key=lambda x: x[:3])[:k], 1):
            out.append((i, rank, j, -score))
    return out


def same(got, rows, k=20):
    return Counter(map(tuple, got.collect())) == Counter(brute(rows, k))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "2 AS block", "'x' AS vector")


def test_lengths_that_differ_groups_of_copies_and_odd_rows(spark, odd_documents):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * math.exp(r.normal())).tolist()) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 360)]  # a group of copies, queries among them
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (420, [0.0] * 6), (440, [])]
    rows += [(40, rows[40][1]), (40, rows[40][1]), (60, rows[61][1]), (None, rows[20][1]), (None, [0.1] * 6), (-20, [0.2] * 6), (460, [1.0, 2.0]), (461, [0.5, -2.0])]
    assert same(tp.report(frame(spark, rows)), rows)
    assert tp.report(frame(spark, rows).limit(0)).count() == 0
    assert same(tp.report(frame(spark, rows[:7])), rows[:7])


@pytest.mark.parametrize("block, head, growth, bucket", [(60, 8, 2, 16), (2_000_000, 4096, 16, 1024)])
def test_near_vectors_are_pruned_by_coordinates(spark, monkeypatch, block, head, growth, bucket):
    """With small blocks, strata and buckets, and as they are; high local thresholds take the way by coordinates."""
    for name, x in (("BLOCK", block), ("HEAD", head), ("GROWTH", growth), ("ROWS", bucket)):
        monkeypatch.setattr(tp, name, x)
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] * (0.5 + i / 600) + 0.02 * r.normal(size=12)).tolist()) for i in range(600)]
    assert same(tp.report(frame(spark, rows), k=5), rows, 5)


def test_a_bucket_by_coordinates_loses_nothing():
    r = np.random.default_rng(6)
    p = r.normal(size=(400, 8))
    p = p[np.argsort(-np.linalg.norm(p, axis=1))]
    whole = np.floor(64 * p).astype(np.int64)
    bucket = object.__new__(tp.Vectors)
    bucket.whole, bucket.float, bucket.norm = whole, whole.astype(float), np.linalg.norm(whole, axis=1)
    q = bucket.take(np.arange(0, 400, 7))
    t = r.uniform(0.93, 0.9999, len(q.norm))
    chosen, left = tp.by_coordinates(q, t, bucket)
    assert chosen.sum() > 10
    cosine = (q.float @ bucket.float.T) / q.norm[:, None] / bucket.norm[None]
    for k, rows in zip(np.flatnonzero(chosen), left):
        assert set(np.flatnonzero(cosine[k] >= t[k])) <= set(rows.tolist())


def test_products_that_may_not_fit(spark):
    big = frame(spark, [(i, [float(2**40), 1.0 + i]) for i in range(0, 60, 20)])
    with pytest.raises(Exception, match="64 bits"):
        tp.report(big).count()
    rows = [(i, [float(2**22), float(i)]) for i in range(0, 100, 10)]
    assert same(tp.report(frame(spark, rows)), rows)
