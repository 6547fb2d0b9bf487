import random

import numpy as np
import pytest

from driftline.llm import piece_codec
from driftline.llm.queries import piece_model_file

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_file())


@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel(piece_model_file())


def texts():
    r = random.Random(3)
    bits = ["a", "e", "th", "ing", " ", "  ", "▁", "\n", "ü", "梦", "😀", "\x00", "aaaa", "<s>", "0", "."]
    out = ["", None, " ", "a ", " a", "a" * 3000, " " * 3000 + "x", " " * 47]
    return out + ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(1500)]


def test_encodes_and_decodes_as_the_library_does(library, model):
    given = texts()
    ids, offsets = model.encode(given)
    want = [library.encode(t or "") + [2] for t in given]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert model.decode(ids, offsets) == [library.decode(w) for w in want]


def test_decodes_any_ids(library, model):
    r = random.Random(5)
    for _ in range(500):
        ids = [r.choice([r.randrange(32000), r.randint(0, 260)]) for _ in range(r.randint(0, 10))]
        assert model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0] == library.decode(ids)
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([0, 1]))


def test_odd_rows(spark, library, odd_documents, no_documents):
    coded = piece_codec.decode(piece_codec.encode(odd_documents, piece_model_file()), piece_model_file())
    rows = coded.collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "") + [2]
        assert r["decoded"] == library.decode(r["ids"])
    assert piece_codec.digests(no_documents, piece_model_file()).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "n int, ids array<int>")
    assert [r["decoded"] for r in piece_codec.decode(empty, piece_model_file()).orderBy("n").collect()] == [None, ""]
