import pytest

#: Rows that every operator must bear: nulls, empty and very long texts, ties, repeated rows, a clashing column.
LONG = "the long text goes on and on " * 4000


@pytest.fixture
def odd_documents(spark):
    rows = [
        (1, "One plain text of some words, to begin with.", "src0"),
        (2, None, None),
        (3, "", "src1"),
        (4, "   \n\t ", "src1"),
        (5, LONG, "src0"),
        (6, "One plain text of some words, to begin with.", "src0"),
        (6, "One plain text of some words, to begin with.", "src0"),
        (7, "x", "src0"),
        (None, "A row without an id.", "src0"),
        (8, "é梦😀 \x00 ▁▁ text", "src2"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("ids", "findings", "matches", "toxicity", "bands", "key", "fingerprint", "shard", "toxic_spans", "__text", "__nth", "__masked", "runs", "collapsed"):
        frame = frame.selectExpr("*", f"'mine' AS {name}")
    return frame


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
