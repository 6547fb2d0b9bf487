import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import periodic_runs as pr


def brute(words, least=6, times=4):
    """Runs by their definition: every period, every stretch, smallest periods only."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p) and not any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs, gone = brute(words), set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(shown), sha(left))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(0, 12), st.integers(1, 6))
def test_runs_by_definition(ids, at, p):
    ids = [ids[at + (i - at) % p] if at <= i and at + p <= len(ids) else x for i, x in enumerate(ids)]
    for least, times in ((2, 2), (6, 4), (4, 3)):
        assert pr.lyndon_runs(ids, least, times) == brute(ids, least, times)
    text = " ".join(map(str, ids))
    assert [r for _, r in pr.runs_of([text, None, text])] == [brute(ids), [], brute(ids)]


def test_a_collision_of_hashes_changes_nothing(monkeypatch):
    """With a hash of a few values only, words are what decides."""
    monkeypatch.setattr(pr, "MODULUS", 7)
    monkeypatch.setattr(pr, "BASE", 3)
    r = random.Random(2)
    for _ in range(150):
        ids = [r.randrange(3) for _ in range(r.randint(0, 30))]
        ids += ids[-3:] * r.randint(0, 5)
        same = pr.Extensions(ids)
        for _ in range(10 if len(ids) > 1 else 0):
            i, j = sorted(r.sample(range(len(ids)), 2))
            k = same.right(i, j)
            assert ids[i : i + k] == ids[j : j + k]
            m = same.left(i, j)
            assert ids[i - m : i] == ids[j - m : j]


def test_the_query_as_by_definition(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        words = [r.choice("abcde") + r.choice(["", "é", "X"]) for _ in range(r.choice([0, 1, 5, 30, 60]))]
        if r.random() < 0.4:
            words[3:3] = [r.choice("ab") for _ in range(r.randint(1, 3))] * r.randint(3, 9)
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words) + r.choice(["", " ", "\x0b"])))
    rows += [(400, None), (None, "a a a a a a a b"), (7, "x " * 50), (7, "x " * 50), (-20, "y y y y y y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS runs", "1 AS n", "2 AS best").repartition(3)
    key = lambda x: (str(x[0]), str(x[6]), str(x[7]))
    got = sorted((tuple(x) for x in pr.report(docs).collect()), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20
    assert got == sorted((row(*x) for x in rows), key=key)


def test_odd_rows(odd_documents, no_documents):
    made = pr.collapse(odd_documents)
    assert made.count() == odd_documents.count() and sorted(made.columns) == sorted(odd_documents.columns)
    by_id = {x["doc_id"]: x for x in made.collect()}
    n = 4000 * 7
    assert [tuple(x) for x in by_id[5]["runs"]] == [(0, n, 7)] and by_id[5]["collapsed"] == "the long text goes on and on"
    assert by_id[2]["runs"] == [] and by_id[2]["collapsed"] == by_id[3]["collapsed"] == by_id[4]["collapsed"] == ""
    assert made.drop("runs", "collapsed").exceptAll(odd_documents.drop("runs", "collapsed")).count() == 0
    assert pr.report(odd_documents).count() == odd_documents.count() and pr.report(no_documents).count() == 0
