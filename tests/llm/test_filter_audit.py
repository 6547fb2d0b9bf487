import random
import re
from collections import Counter
from itertools import permutations

from driftline.llm import filter_audit as fa

SPACE = r"[^\x20\x09-\x0D]+"


def brute(rows, labels):
    """Every document through every order, filter by filter."""
    good = {i for i, q, t in labels if i is not None and q == 1}
    toxic = {i for i, q, t in labels if i is not None and t == 1}
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(SPACE, t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    removed = Counter()
    for part, fails, _, _ in docs:
        for order in permutations("ABCDE"):
            first = next((x for x in order if x in fails), None)
            removed[part, first] += 1
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                fall = [k for k, d in enumerate(own) if letter in d[1]]
                here = [k for k in fall if k not in gone]
                redundant = len(fall) - len(here)
                gone |= set(here)
                out[part, "".join(order), step] = (
                    len(own) - len(gone), len(here), redundant, sum(own[k][1] == {letter} for k in fall),
                    sum(own[k][2] for k in here), sum(own[k][3] for k in here), removed[part, letter],
                )
    return out


def test_as_every_order_run_by_hand(spark):
    r = random.Random(5)
    texts = ["", "Aa " * 300, "one two three", "x|y", None]
    for _ in range(60):
        vocabulary = [f"w{k}" for k in range(r.choice([20, 400]))]
        text = " ".join(r.choice(vocabulary) for _ in range(r.choice([20, 199, 200, 260])))
        texts.append(text.upper() if r.random() < 0.2 else text + r.choice(["", " $", "\t# ", " é"]))
    rows = [(i, r.choice(texts), r.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(3, rows[3][1], "de"), (3, rows[3][1], "de"), (None, rows[0][1], "en"), (None, "", None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'mine' AS mask", "1 AS good", "2 AS digest")
    got = fa.report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 4 * 600 - 600 * ("fr" not in {x[2] for x in rows})
    for x in got:
        assert tuple(x)[3:] == want[x["part"], x["filter_order"], x["step"]]
    whole = [x for x in got if x["filter_order"] == "ABCDE" and x["step"] == 5]
    assert sum(x["kept"] for x in whole) + sum(x["removed"] for x in got if x["filter_order"] == "ABCDE") == len(rows)


def test_sums_invert_and_take_any_number_of_filters(spark):
    rows = spark.createDataFrame([("p", m, m == 3, False) for m in (0, 1, 2, 3, 3, 7)], "part string, mask int, good boolean, toxic boolean")
    cell = fa.cells(fa.parity_sums(rows, 3), 3).first()
    assert cell["n"] == [1, 1, 1, 2, 0, 0, 0, 1] and cell["n_good"] == [0, 0, 0, 2, 0, 0, 0, 0]
    out = {(x["filter_order"], x["step"]): x for x in fa.audit(rows, "XYZ").collect()}
    assert len(out) == 18
    assert (out["XYZ", 1]["removed"], out["XYZ", 2]["removed"], out["XYZ", 2]["redundant"], out["XYZ", 3]["kept"]) == (4, 1, 3, 1)
    # over six orders: alone 6, of two 3, of three 2
    assert (out["XYZ", 1]["shapley"], out["XYZ", 3]["shapley"]) == (6 + 2 * 3 + 2, 2)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = fa.report(odd_documents, labels, "source").collect()
    assert len(got) == 600 * 4 and {x["part"] for x in got} == {"", "src0", "src1", "src2"}
    last = {x["part"]: x["kept"] + sum(y["removed"] for y in got if y["part"] == x["part"] and y["filter_order"] == "EDCBA") for x in got if x["filter_order"] == "EDCBA" and x["step"] == 5}
    assert sum(last.values()) == odd_documents.count()
    assert fa.report(no_documents, labels, "source").count() == 0
    assert fa.report(odd_documents, labels.limit(0), "source").filter("good_lost > 0").count() == 0
