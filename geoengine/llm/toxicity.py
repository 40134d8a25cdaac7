"""Toxic passages by maximum-scoring segments.

Tokens are runs of letters, A-Z lower-cased. Keys are the tokens and their first
5 to 9 bytes, for words that take many endings. A key's score is its log-odds
of toxic against other labelled texts, with a Dirichlet prior informed by the
key's overall share, taken only as far as it exceeds ``z`` standard errors. A
token has the largest score of its keys, and -``drift`` if none has one or if it
repeats the token before it. Training counts the texts that hold a key, so a
text that repeats itself says no more than once. A linear scan (Ruzzo and Tompa) finds every
maximal-scoring segment of a text. Under the null, the best segment of a text of
n tokens follows an extreme-value law: its scale lambda solves sum p e^(lambda
s) = 1 over the scores of the texts that are not toxic, and its location K is
fitted to their best segments. A segment is a passage if its expected number by
chance, K n e^(-lambda S), is at most ``max_expected``. A text's r best segments
together have a chance of about e^-t t^(r-1) / (r! (r-1)!), t the sum of lambda
S - log(K n) over them (Karlin and Altschul); its evidence is the largest -log of
that over r, and a logistic fit on the training texts turns it into a
probability.

The classifier is fitted on at most ``max_labelled`` labelled texts, those with
the smallest hash of their id, and keeps every key of theirs that scores.
Scoring covers whole texts of all rows.

Labels: rows of null id or null label don't count; an id with several labels is
toxic if one of them says so. A null text is the empty text; a text without
letters gets the probability that the fit gives to no evidence. Without labels
of both kinds every score is the share of toxic labels (0 without any). Empty
tables give empty results; repeated rows repeated results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import batch_of, id_remainder, utf8
from geoengine.session import durable

#: Letters, lower-cased, and all bytes above 127; others separate tokens.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


#: Bytes of the prefixes that are keys beside the whole token; a prefix's key ends with an asterisk.
PREFIXES = range(5, 10)
#: Tokens whose scores a worker remembers.
REMEMBERED = 400_000


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def keys_of(token: bytes) -> list[bytes]:
    return [token, *(token[:k] + b"*" for k in PREFIXES if k <= len(token))]


class Scores(dict):
    """Token to score; remembers what it has worked out."""

    def __init__(self, keys: dict[bytes, float], drift: float):
        super().__init__()
        self.keyed, self.drift = keys, drift

    def __missing__(self, token: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        got = [self.keyed[k] for k in keys_of(token) if k in self.keyed]
        self[token] = score = max(got) if got else -self.drift
        return score

    def __reduce__(self):
        return Scores, (self.keyed, self.drift)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The scores of a text's tokens; one that repeats the token before it scores as if it were unknown."""
        low = -self.drift
        return np.array([self[w] if w != p else low for w, p in zip(words, [None, *words])])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time; only runs of positive scores are looked at one by one."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.diff(np.r_[False, up, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.r_[0.0, np.cumsum(scores)]
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    above: list[int] = []  # for each, the last before it whose total before is smaller, or -1
    for a, b in zip(starts.tolist(), ends.tolist()):
        left, right = float(total[a]), float(total[b])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = above[j]
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right))
                above.append(j)
                break
            a, left = found[j][0], found[j][2]
            del found[j:], above[j:]
    return [(a, b, r - x) for a, b, x, r in found]


@dataclass
class Model:
    scores: Scores = field(default_factory=lambda: Scores({}, 0.2))
    decay: float = 1.0
    log_k: float = 0.0
    bias: float = 0.0
    weight: float = 0.0
    max_expected: float = 0.05

    def surprise(self, score: float, n: int) -> float:
        """-log of how many segments of that score n tokens have by chance."""
        return self.decay * score - self.log_k - math.log(n)

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float]], float]:
        """(start, end, surprise) of each passage in tokens, and the text's evidence."""
        words = tokens_of(text)
        if not words:
            return [], 0.0
        scores = self.scores
        found = [(a, b, self.surprise(s, len(words))) for a, b, s in segments(scores.of(words))]
        best, t = 0.0, 0.0
        for r, x in enumerate(sorted((x[2] for x in found if x[2] > 0), reverse=True), 1):
            t += x
            best = max(best, t - (r - 1) * math.log(max(t, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        return [x for x in found if x[2] >= -math.log(self.max_expected)], best

    def probability(self, evidence: float) -> float:
        z = self.bias + self.weight * min(evidence, 1e6)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and weight by Newton steps, with a small ridge against separable data."""
    m, beta = np.c_[np.ones_like(x), x], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        grad = m.T @ (y - p) - ridge * beta
        hess = (m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, max_labelled: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text (bytes), label: at most ``max_labelled`` labelled rows whose id is not held out; the bound makes the labels small enough to send to all tasks."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    some = one.where(id_remainder("__id", folds) != 0).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    return docs.select(F.col(id_col).alias("__i"), utf8(text_col).alias("text")).join(F.broadcast(some), F.col("__i") == F.col("__id")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, max_labelled: int = 20_000, prior: float = 0.01, z: float = 3.0, drift: float = 0.2, max_expected: float = 0.05) -> Model:
    rows = durable(training_rows(docs, labels, folds, max_labelled, id_col, text_col, label_col))
    model = Model(scores=Scores({}, drift), max_expected=max_expected)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = (1 if 1 in sizes else 0) if sizes else 0
        model.bias = 30.0 if share else -30.0
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                both[label > 0].update({key for word in set(tokens_of(text.as_buffer().to_pybytes())) for key in keys_of(word)})
        words = list(both[0].keys() | both[1].keys())
        yield batch_of(token=pa.array(words, pa.binary()), other=np.array([both[0][w] for w in words], np.int64), toxic=np.array([both[1][w] for w in words], np.int64))

    counts = durable(rows.mapInArrow(count, "token binary, other long, toxic long").groupBy("token").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t")))
    whole = F.substring("token", -1, 1) != F.lit(b"*")
    total = counts.where(whole).agg(F.sum("o").alias("o"), F.sum("t").alias("t")).first()
    n_o, n_t = total.o or 0, total.t or 0
    if not n_o or not n_t:
        model.bias = math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))
        return model
    a = F.lit(prior) * (F.col("o") + F.col("t")) + 0.5
    strength = prior * (n_o + n_t) + 0.5
    odds = F.log((F.col("t") + a) / (n_t + strength)) - F.log((F.col("o") + a) / (n_o + strength))
    error = z * F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("o") + a))
    sure = F.when(odds > error, odds - error).when(odds < -error, odds + error)
    # as many keys as the labelled sample gives
    kept = counts.withColumn("s", sure).where("s is not null").select("token", "s").toArrow()
    model.scores = Scores({k: x if x > 0 else min(x, -drift) for k, x in zip(kept["token"].to_pylist(), kept["s"].to_pylist())}, drift)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    null = rows.where("label <= 0").select("text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, seen = sent.value.scores, Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(scores.of(tokens_of(text.as_buffer().to_pybytes())).tolist())
        yield batch_of(s=np.array(list(seen), np.float64), n=np.array(list(seen.values()), np.int64))

    # at most one row for each key that was kept
    law = null.mapInArrow(spread, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    s, share = np.r_[law.s.to_numpy(), max(model.scores.keyed.values(), default=1.0)], np.r_[law.n.to_numpy(np.float64), 0.5]
    grow = lambda x: float((share * np.exp(np.clip(x * s, -700, 700))).sum() / share.sum())
    low, high = 1e-6, 1.0
    while grow(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 1 else (low, mid)
    model.decay = (low + high) / 2

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value.scores
        for b in batches:
            words = [tokens_of(t.as_buffer().to_pybytes()) for t in b.column(0)]
            tops = [max((x[2] for x in segments(scores.of(own))), default=0.0) for own in words]
            yield batch_of(n=np.array([len(x) for x in words], np.int64), s=np.array(tops, np.float64))

    # at most max_labelled rows of two numbers
    top = null.mapInArrow(best, "n long, s double").where("n > 0").toPandas()
    if len(top):
        # the law's location: log K + Euler's constant is the mean of lambda S - log n
        model.log_k = float((model.decay * top.s - np.log(top.n)).mean() - 0.5772156649)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield batch_of(label=b.column(1), x=np.array([m.passages(t.as_buffer().to_pybytes())[1] for t in b.column(0)], np.float64))

    got = rows.mapInArrow(evidence, "label int, x double").toPandas()
    model.bias, model.weight = logistic(np.log1p(np.minimum(got.x.to_numpy(), 1e6)), (got.label > 0).to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score (double), predicted (int) and passages (array of start, end, surprise in tokens); ``prefix`` goes before these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            n = b.num_columns - 1
            got = [m.passages(t.as_buffer().to_pybytes()) for t in b.column(n)]
            p = [m.probability(math.log1p(e)) for _, e in got]
            spans = pa.array([[{"start": a, "end": z, "surprise": s} for a, z, s in found] for found, _ in got], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), spans], names=[f"c{i}" for i in range(n)] + ["score", "predicted", "passages"])

    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], utf8(text_col).alias("__t"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + ["score double", "predicted int", "passages array<struct<start:int,end:int,surprise:double>>"])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, *[prefix + x for x in ("score", "predicted", "passages")])


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **options) -> DataFrame:
    """id, held_out, score, predicted, passages for each row."""
    model = fit(docs, labels, id_col, text_col, folds=folds, **options)
    got = score(docs.select(id_col, text_col), model, text_col, prefix="__")
    return got.select(id_col, (id_remainder(id_col, folds) == 0).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"), F.col("__passages").alias("passages"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    return score(docs, fit(docs, labels, **options), prefix="__").where(F.col("__score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
