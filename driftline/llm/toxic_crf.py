"""Toxicity by a linear-chain conditional random field.

Only documents are labelled, so tokens are labelled from them first: a token of a toxic
document is toxic if its word or one of its beginnings occurs in labelled documents so nearly
always with the label that chance cannot explain it. A chain over each sentence learns these
labels; its forward-backward marginals give every token a probability, and a logistic of the
largest one, the expected number and the expected share gives the document's score. Tokens
whose marginal reaches one half make up the offending spans.

The sample is cut into slices of tokens in tasks and written; each step of the fit adds up what
the slices say of the present weights. The driver holds weights and sums, whatever the texts'
lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import PUNCTUATION, Words, append_columns, aside, cut, slices

#: The classifier is fitted on at most so many labelled rows, of any length, in so many tasks.
SAMPLE, TASKS = 6000, 8
#: Beginnings of a word, in bytes, that are features beside the word.
PREFIXES = (4, 6)
FEATURES = 1 << 18
EPOCHS, RATE, DECAY = 12, 0.5, 1e-6
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Tokens:
    """Tokens of several texts: feature numbers (one column for the word and each beginning), chains and texts."""

    def __init__(self, texts: list[str | None]):
        w = self.words = Words(texts, PUNCTUATION, PREFIXES)
        self.raw = [w.hashes, *[w.prefix[n] for n in PREFIXES]]
        mask = np.uint64(FEATURES - 1)
        self.features = np.stack([((h + np.uint64(k)) & mask).astype(np.int32) for k, h in enumerate(self.raw)])
        count = w.counts()
        self.text = np.repeat(np.arange(len(texts)), count)
        n = len(self.text)
        # a chain begins with each text and after each mark or line break
        marks = np.concatenate([[0], np.cumsum(_ENDS[w.data])])
        begins = np.ones(n, bool)
        if n:
            begins[1:] = (marks[w.starts[1:]] > marks[w.ends[:-1]]) | (self.text[1:] != self.text[:-1])
        self.first = np.flatnonzero(begins)
        self.length = np.diff(np.append(self.first, n))


class Chains:
    """Chains in order of falling length, so that step k of all chains long enough is one slice."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        longest = int(self.length[0]) if len(length) else 0
        self.active = np.searchsorted(-self.length, -np.arange(1, longest + 1), side="right")

    def steps(self) -> range:
        return range(len(self.active))

    def at(self, k: int) -> np.ndarray:
        return self.first[: self.active[k]] + k


def marginals(score: np.ndarray, move: np.ndarray, start: float, chains: Chains) -> tuple:
    """Forward-backward of two labels: P(toxic) of each token, expected moves (2 x 2), sum of log partition.

    score: log odds of toxic of each token's features; move: scores of label pairs.
    """
    n = len(score)
    alpha, beta = np.zeros((2, n)), np.zeros((2, n))
    last = np.zeros(len(chains.first))
    for k in chains.steps():
        i = chains.at(k)
        if k == 0:
            alpha[0, i], alpha[1, i] = 0.0, start + score[i]
            continue
        a0, a1 = alpha[0, i - 1], alpha[1, i - 1]
        alpha[0, i] = np.logaddexp(a0 + move[0, 0], a1 + move[1, 0])
        alpha[1, i] = np.logaddexp(a0 + move[0, 1], a1 + move[1, 1]) + score[i]
    for k in reversed(chains.steps()[1:]):
        i = chains.at(k)
        b0, b1 = beta[0, i], beta[1, i] + score[i]
        beta[0, i - 1] = np.logaddexp(b0 + move[0, 0], b1 + move[0, 1])
        beta[1, i - 1] = np.logaddexp(b0 + move[1, 0], b1 + move[1, 1])
    if n:
        last = np.logaddexp(*alpha[:, chains.first + chains.length - 1])
    whole = np.zeros(n)
    whole[chains.first] = last
    whole = whole[np.maximum.accumulate(np.where(np.isin(np.arange(n), chains.first), np.arange(n), 0))] if n else whole
    p = np.exp(np.minimum(alpha[1] + beta[1] - whole, 0))
    expected = np.zeros((2, 2))
    if n:
        second = np.ones(n, bool)
        second[chains.first] = False
        j = np.flatnonzero(second)
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.exp(alpha[a, j - 1] + move[a, b] + beta[b, j] + b * score[j] - whole[j]).sum()
    return p, expected, float(last.sum())


def sightings(tokens: Tokens, toxic: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind of feature: its hashes, how many texts hold each, and how many toxic ones."""
    out = []
    for h in tokens.raw:
        order = np.lexsort((h, tokens.text))
        feature, text = h[order], tokens.text[order]
        new = np.ones(len(h), bool)
        new[1:] = (feature[1:] != feature[:-1]) | (text[1:] != text[:-1])
        feature, at = np.unique(feature[new], return_inverse=True)
        out.append((feature, np.bincount(at, minlength=len(feature)), np.bincount(at, toxic[text[new]], minlength=len(feature)).astype(np.int64)))
    return out


def sure(rate: float, features: int):
    """Condition on n and n_toxic: nearly always with the label, and as often by chance in none of so many features."""
    least = (np.log(features + 1) + 3) / -np.log(min(max(rate, 1e-3), 0.9))
    return (F.col("n_toxic") >= 0.95 * F.col("n")) & (F.col("n_toxic") > float(least))


def telling(tokens: Tokens, toxic: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Which tokens are labelled toxic: those of toxic texts with one of the known features."""
    out = np.zeros(len(tokens.text), bool)
    for h, k in zip(tokens.raw, known):
        out |= np.isin(h, k)
    return out & toxic[tokens.text].astype(bool)


def aggregate(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each text: largest marginal, log of 1 + expected number of toxic tokens, root of their share."""
    count = np.bincount(text, minlength=n)
    total = np.bincount(text, p, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, text, p)
    return np.stack([top, np.log1p(total), np.sqrt(total / np.maximum(count, 1))], axis=1)


class Gradient:
    """Sums over slices of tokens: of each feature, of label pairs, of first tokens. They add."""

    def __init__(self):
        self.feature, self.move, self.start = np.zeros(FEATURES), np.zeros((2, 2)), 0.0

    def add(self, model: Model, f: np.ndarray, truth: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        second = np.ones(len(truth), bool)
        second[first] = False
        j = np.flatnonzero(second)
        np.add.at(self.move, (truth[j - 1].astype(int), truth[j].astype(int)), 1)
        p, moved, _ = marginals(model.weight[f].sum(axis=0) + model.bias, model.move, model.start, Chains(first, length))
        wrong = truth - p
        for row in f:
            self.feature += np.bincount(row, wrong, minlength=FEATURES)
        self.move -= moved
        self.start += float(wrong[first].sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.feature, self.move.ravel(), [self.start]])


class Model:
    """Weights of the chain and of the logistic over a document's marginals; without a fit, it knows the prior alone."""

    def __init__(self, prior: float):
        self.weight = np.zeros(FEATURES, np.float64)
        self.move, self.start, self.bias = np.zeros((2, 2)), 0.0, 0.0
        self.logit = np.zeros(4)
        self.prior, self.only_prior = prior, True
        self.square = np.concatenate([np.full(FEATURES, 1e-2), np.ones(5)])

    def climb(self, gradient: np.ndarray) -> None:
        """A step up the log likelihood, of a size of its own for each weight (Adagrad); gradient as Gradient.flat has it."""
        g = gradient.copy()
        g[:FEATURES] -= DECAY * self.weight
        self.square += g**2
        step = RATE * g / np.sqrt(self.square)
        self.weight = self.weight + step[:FEATURES]
        self.move = self.move + step[FEATURES:-1].reshape(2, 2)
        self.start += float(step[-1])

    def fit_logit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton steps of a logistic regression with a small ridge."""
        x = np.hstack([np.ones((len(x), 1)), x])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.logit, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            h = (x * w[:, None]).T @ x + 1e-2 * np.eye(4)
            self.logit += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * self.logit)
        self.only_prior = False

    def token_probabilities(self, t: Tokens) -> np.ndarray:
        score = self.weight[t.features].sum(axis=0) + self.bias
        return marginals(score, self.move, self.start, Chains(t.first, t.length))[0]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of the texts and the spans of touching toxic tokens, in code points."""
        spans: list[list[dict]] = [[] for _ in texts]
        if self.only_prior:
            return np.full(len(texts), self.prior), spans
        t = Tokens(texts)
        p = self.token_probabilities(t)
        x = np.hstack([np.ones((len(texts), 1)), aggregate(p, t.text, len(texts))])
        score = 1 / (1 + np.exp(-np.clip(x @ self.logit, -30, 30)))
        w = t.words
        for k in np.flatnonzero(p >= 0.5).tolist():
            own = spans[t.text[k]]
            base = int(w.text_at[t.text[k]])
            start, end = int(w.starts[k]) - base, int(w.ends[k]) - base
            if own and own[-1]["token"] == k - 1:
                own[-1] |= {"end": end, "token": k}
            else:
                own.append({"start": start, "end": end, "token": k})
        for i, own in enumerate(spans):
            raw = w.raw[w.text_at[i] : w.text_at[i + 1]] if own else b""
            spans[i] = [{"start": len(raw[: s["start"]].decode()), "end": len(raw[: s["end"]].decode())} for s in own]
        return score, spans


def fold(doc_id):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic 0/1) of at most `most` labelled documents that are not held out, the first in order of a hash of the id.

    A label row without id or label, held out or of no document teaches nothing; of several labels of
    one id the largest holds, of several texts the smallest. A null text teaches as an empty one.
    """
    taught = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    there = documents.select("doc_id").distinct().join(taught, "doc_id")
    chosen = there.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    rows = rows.groupBy("doc_id", "toxic").agg(text)
    return cut(rows.repartition(TASKS, "doc_id").sortWithinPartitions("doc_id").select("text", "toxic"))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, np.ndarray]]:
    for piece in slices(batches, "text"):
        yield Tokens(piece.column("text").to_pylist()), piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)


def known_features(taught: DataFrame, rate: float) -> list[np.ndarray]:
    """Hashes of each kind of feature that tell toxic texts; sightings are summed by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, toxic in _sliced(batches):
            for kind, (feature, n, n_toxic) in enumerate(sightings(tokens, toxic)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), kind, np.int32)), pa.array(feature.view(np.int64)), pa.array(n), pa.array(n_toxic)],
                    names=["kind", "feature", "n", "n_toxic"],
                )

    seen = taught.mapInArrow(run, "kind int, feature long, n long, n_toxic long").groupBy("kind", "feature")
    seen = cut(seen.agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")))
    number = {r["kind"]: r["count"] for r in seen.groupBy("kind").count().collect()}
    known = []
    for kind in range(1 + len(PREFIXES)):
        found = seen.filter(F.col("kind") == kind).filter(sure(rate, number.get(kind, 0))).select("feature").toArrow()
        known.append(np.sort(found.column("feature").to_numpy().view(np.uint64)))
    return known


def prepared(taught: DataFrame, known: list[np.ndarray]) -> DataFrame:
    """The sample as slices of tokens, a row each: features, labels of tokens, chains, and the text of each token."""
    shared = taught.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, toxic in _sliced(batches):
            parts = (t.features, telling(t, toxic, shared.value), t.first.astype(np.int64), t.length.astype(np.int64), t.text.astype(np.int32), toxic)
            counts = [pa.array([len(parts[1])]), pa.array([int(parts[1].sum())])]
            yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()]) for x in parts], *counts], names=[*_PARTS, "tokens", "told"])

    return cut(taught.mapInArrow(run, ", ".join(f"{c} binary" for c in _PARTS) + ", tokens long, told long"))


_PARTS = ["features", "truth", "first", "length", "owner", "toxic"]
_KINDS = [np.int32, bool, np.int64, np.int64, np.int32, np.float64]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            got = [np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in zip(_PARTS, _KINDS)]
            yield [got[0].reshape(1 + len(PREFIXES), -1), *got[1:]]


def summed(rows: DataFrame, model: Model) -> np.ndarray:
    """The gradient at the model's weights; a vector from each of the sample's tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gradient()
        for f, truth, first, length, _, _ in _parts(batches):
            g.add(shared.value, f, truth, first, length)
        yield pa.RecordBatch.from_arrays([pa.array([g.flat().tobytes()])], names=["sums"])

    out = np.zeros(FEATURES + 5)
    for row in rows.mapInArrow(run, "sums binary").toLocalIterator(prefetchPartitions=True):
        out += np.frombuffer(row["sums"])
    shared.destroy()
    return out


def aggregates(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What the logistic sees of each text of the sample, and its label."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for f, _, first, length, owner, toxic in _parts(batches):
            p = marginals(m.weight[f].sum(axis=0) + m.bias, m.move, m.start, Chains(first, length))[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*aggregate(p, owner, len(toxic)).T, toxic)], names=["a", "b", "c", "y"])

    got = rows.mapInArrow(run, "a double, b double, c double, y double").toArrow()
    a, b, c, y = (got.column(k).to_numpy() for k in range(4))
    return np.stack([a, b, c], axis=1), y


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from the bounded sample; with no or one kind of label it knows the prior alone."""
    taught = sample(documents, labels, most)
    n, n_toxic = (int(x or 0) for x in taught.agg(F.count("*"), F.sum("toxic")).first())
    model = Model((n_toxic + 0.5) / (n + 1))
    if n_toxic in (0, n):
        return model
    rows = prepared(taught, known_features(taught, n_toxic / n))
    marks = rows.agg(F.sum(F.length("truth")), F.sum(F.octet_length(F.replace("truth", F.lit(b"\x00"), F.lit(b""))))).first()
    share = float(marks[1] or 0) / max(float(marks[0] or 0), 1)
    model.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    for _ in range(EPOCHS):
        model.climb(summed(rows, model))
    model.fit_logit(*aggregates(rows, model))
    return model


def score(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1) and toxic_spans (start, end in code points) of each whole text.

    Null, empty and wordless texts get the score of a text without toxic tokens. Columns of
    these names are replaced; all rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def make(texts: list[str | None]) -> list:
        return list(shared.value.scores(texts))

    fields = [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", span)]
    return append_columns(df, column, make, fields)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end, comma-joined) of every row.

    A null doc_id is not held out and teaches nothing; null and empty texts have no spans; repeated rows have equal
    scores; other columns are not looked at; an empty table gives no rows.
    """
    made = score(documents.select("doc_id", "text"), fit(documents, labels))
    shown = F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return made.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.array_join(shown, ",").alias("spans"),
    )


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below one half, with all their columns, those named as the score's too.

    Null and empty texts have the score of texts without toxic tokens; repeated rows stay or go alike.
    """
    rows, back = aside(documents, ["toxicity", "toxic_spans"])
    return back(score(rows, fit(documents, labels)).filter("toxicity < 0.5"))
