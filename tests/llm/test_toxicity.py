import itertools
import random
import zlib

import numpy as np

from driftline.llm import toxic_crf as tc


def test_marginals_as_by_enumeration():
    r = np.random.default_rng(1)
    lengths = np.array([1, 4, 6, 2])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    score, move, start = r.normal(size=lengths.sum()), r.normal(size=(2, 2)), 0.3
    p, expected, log_z = tc.marginals(score, move, start, tc.Chains(first, lengths))
    want, moves, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for a, n in zip(first, lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([
            np.exp(start * y[0] + sum(score[a + k] for k in range(n) if y[k]) + sum(move[y[k - 1], y[k]] for k in range(1, n)))
            for y in paths
        ])
        total += np.log(weight.sum())
        weight /= weight.sum()
        for y, w in zip(paths, weight):
            want[a : a + n] += w * np.array(y)
            for k in range(1, n):
                moves[y[k - 1], y[k]] += w
    assert np.allclose(p, want) and np.allclose(expected, moves) and np.isclose(log_z, total)


def corpus(n, seed):
    r = random.Random(seed)
    words, vile = [f"word{k}" for k in range(300)], ["grotty", "vilesome", "vilebeast", "crudd"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.25)
        for _ in range(toxic * r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(vile)
        rows.append((i, " ".join(w) + "."))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_rows_and_spans(spark):
    rows, labels = corpus(600, 3)
    truth = dict(labels)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = [tc.report(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect() for x in (labels, flipped)]
    assert sorted(made[0]) == sorted(made[1])  # held-out labels are never looked at
    held = [r for r in made[0] if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    text = dict(rows)
    for r in held:
        for a, b in (s.split(":") for s in r["spans"].split(",") if s):
            assert any(v in text[r["doc_id"]][int(a) : int(b)] for v in ("grotty", "vile", "crudd"))


def test_sums_of_tasks_are_those_of_one_pass_and_scores_follow_from_them(spark):
    rows, labels = corpus(200, 4)
    rows[0] = (0, " ".join(f"long{k}" for k in range(30000)) + " grotty.")  # no text is too long to teach
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    taught = tc.sample(docs, marks)
    assert taught.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    assert tc.sample(docs, marks, 50).count() == 50
    one = taught.collect()
    texts, y = [r["text"] for r in one], np.array([r["toxic"] for r in one], float)
    tokens = tc.Tokens(texts)
    known = tc.known_features(taught, y.mean())
    # a feature in n texts, all toxic, where chance would make one of all features so
    holders = {}
    for h, t in zip(tokens.raw[0].tolist(), tokens.text.tolist()):
        holders.setdefault(h, set()).add(t)
    least = (np.log(len(holders) + 1) + 3) / -np.log(y.mean())
    want = {h for h, t in holders.items() if y[list(t)].sum() >= 0.95 * len(t) and y[list(t)].sum() > least}
    assert set(known[0].tolist()) == want and want
    model = tc.Model(0.5)
    model.weight += np.random.default_rng(2).normal(size=tc.FEATURES) * 0.1
    g = tc.Gradient()
    g.add(model, tokens.features, tc.telling(tokens, y, known), tokens.first, tokens.length)
    assert np.allclose(tc.summed(tc.prepared(taught, known), model), g.flat())

    model = tc.fit(docs, marks)
    got, spans = model.scores(["word1 grotty word2. word3", ""])
    t = tc.Tokens(["word1 grotty word2. word3"])
    s = model.weight[t.features].sum(axis=0) + model.bias
    p = np.zeros(4)
    for a, n in ((0, 3), (3, 1)):
        paths = list(itertools.product((0, 1), repeat=n))
        w = np.array([np.exp(model.start * q[0] + sum(s[a + k] * q[k] for k in range(n)) + sum(model.move[q[k - 1], q[k]] for k in range(1, n))) for q in paths])
        p[a : a + n] = (w / w.sum()) @ np.array(paths)
    x = np.array([1, p.max(), np.log1p(p.sum()), np.sqrt(p.sum() / 4)])
    assert np.isclose(got[0], 1 / (1 + np.exp(-x @ model.logit))) and spans == [[{"start": 6, "end": 12}], []]


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (3, 0), (7, 0)], "doc_id long, toxic int")
    rows = tc.report(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert tc.report(no_documents, labels).count() == 0
    assert {r["predicted"] for r in tc.report(odd_documents, labels.limit(0)).collect()} <= {0, 1}
    kept = tc.accepted(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.exceptAll(odd_documents).count() == 0
