import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import rarity_digest as rd


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_entropy_is_that_of_each_window():
    data = np.frombuffer(words(random.Random(1), 200).encode() + b"aaaaaaaaaa" * 10, np.uint8)
    for window in (8, 64):
        got = rd.entropies(data, window)
        assert len(got) == len(data) - window + 1
        for i in range(0, len(got), 7):
            n = np.array(list(Counter(data[i : i + window].tolist()).values())) / window
            want = -(n * np.log2(n)).sum() / np.log2(window) * rd.LEVELS
            assert abs(got[i] - want) <= 1


def test_rare_levels_rank_first_and_weak_ones_last():
    counts = np.full((2, rd.LEVELS + 1), 5)
    counts[0, 700], counts[0, 50] = 1, 0
    rank = rd.ranks(counts)
    assert rank[0, 700] == 0 and rank[0, 50] > rank[0, 800]


def test_strings_round_trip_and_likeness_orders_texts():
    r = random.Random(2)
    texts = [words(r, n) for n in (3, 20, 200, 2000)]
    near = [t[: len(t) * 3 // 4] + words(r, 1 + len(t) // 25) for t in texts]
    prints = rd.fingerprints([t.encode() for t in texts + near], rd.ranks(rd.histogram([t.encode() for t in texts])))
    for p in prints:
        again = rd.from_string(rd.to_string(p))
        assert again[1] == p[1] and np.array_equal(again[0], p[0])
    for k in range(4):
        assert rd.likeness(prints[k], prints[k]) == 1
        assert rd.likeness(prints[k], prints[k + 4]) > rd.likeness(prints[k], prints[(k + 1) % 4])
        assert rd.likeness(prints[k], prints[k + 4]) == rd.likeness(prints[k + 4], prints[k])
    assert rd.to_string(rd.fingerprints([b""], rd.ranks(rd.histogram([b""])))[0]) == ""


def test_compare_follows_the_next_document(spark):
    r = random.Random(4)
    rows = [((1 << 60) * (i % 7) - (1 << 61) + i * 3, words(r, r.randint(0, 60))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(1))
    got = {x["doc_id"]: x for x in rd.compare(frame).collect()}
    assert len(got) == 300
    down = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(down, down[1:] + down[:1]):
        want = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_chars"] == len(text)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1


def test_odd_rows(spark, odd_documents, no_documents):
    rows = rd.compare(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert rd.compare(no_documents).count() == 0
    one = spark.createDataFrame([(9, "alone here")], "doc_id long, text string")
    assert rd.compare(one).first()["near_next"] == 1


def plain_print(text: bytes, rank):
    """Filters and features of one text, window by window."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    found = []
    for row, (window, stretch, points) in enumerate((rd.COARSE, rd.FINE)):
        n = len(text) - window + 1
        if n <= 0 or (row and len(text) >= rd.SHORT):
            continue
        level = rd.entropies(np.frombuffer(text, np.uint8), window)
        point = Counter(min(range(s, min(s + stretch, n)), key=lambda i: (rank[row, level[i]], i)) for s in range(n))
        spots = [i for i in range(n) if point[i] >= points] or [max(range(n), key=lambda i: (point[i], -i))]
        for i in spots:
            h = 0
            for k in range(window // 8):
                h = mix((h * int(rd._ODD[k]) + int.from_bytes(text[i + 8 * k : i + 8 * k + 8], "little")) & mask)
            found.append(mix((h + 1) & mask) if row else h)
    if 0 < len(text) < rd.BRIEF:
        found += [mix((int.from_bytes(text[k : k + rd.SCRAP], "little") + 2) & mask) for k in range(max(1, len(text) - rd.SCRAP + 1))]
    found = list(dict.fromkeys(found))
    filters = []
    for k in range(0, len(found), rd.FULL):
        bits = np.zeros(rd.BITS, bool)
        for h in found[k : k + rd.FULL]:
            for i in range(rd.HASHES):
                bits[(h >> 11 * i) & (rd.BITS - 1)] = True
        filters.append(np.packbits(bits))
    return filters, len(found)


def test_the_whole_query_as_window_by_window(spark):
    r = random.Random(9)
    rows = [(i, words(r, r.choice([0, 1, 4, 20, 150, 900]))) for i in range(40)] + [(40, None), (41, "é梦" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rank = rd.fit(frame)
    down = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    prints = {}

    def of(text):
        if text not in prints:
            filters, n = plain_print(text.encode(), rank)
            prints[text] = (np.array(filters).reshape(-1, rd.BITS // 8), n)
        return prints[text]

    got = {x["doc_id"]: x for x in rd.compare(frame).collect()}
    for (i, text), (_, after) in zip(down, down[1:] + down[:1]):
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[i]["fingerprint"] == rd.to_string(of(text)), i
        assert got[i]["edited_fingerprint"] == rd.to_string(of(changed)), i
        assert got[i]["near_edited"] == rd.likeness(of(text), of(changed))
        assert got[i]["near_next"] == rd.likeness(of(text), of(after))


def test_a_doc_id_of_many_rows_is_many_partitions(spark):
    r = random.Random(12)
    rows = [(None if i % 3 else i, words(r, 6)) for i in range(900)] + [(5000 + i % 2, words(r, 4)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spread = rd.with_next(frame).filter("NOT halo").groupBy("part").count().collect()
    assert len(spread) >= 3 and max(x["count"] for x in spread) < 0.6 * len(rows)
    order = frame.withColumn("h", F.xxhash64("text").bitwiseAND(F.lit(rd.EXACT - 1))).collect()
    order.sort(key=lambda x: (-(x["doc_id"] if x["doc_id"] is not None else -(2**63)), x["h"], x["text"]))
    want = Counter()
    for one, after in zip(order, order[1:] + order[:1]):
        changed = one["text"][: len(one["text"]) - len(one["text"]) // 3] + after["text"][: len(one["text"]) // 3]
        want[one["doc_id"], hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((x["doc_id"], x["edited_sha256"]) for x in rd.compare(frame).collect()) == want
