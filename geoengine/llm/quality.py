"""Document quality by hierarchical empirical Bayes.

A logistic classifier on surface features of the whole text gives each document
a probability. Sites are documents' hosts, and paths within hosts. Grouped
sums of these probabilities give every host a Beta posterior around the global
mean and every path one around its host's mean. How much a level is shrunk is
estimated from the data: the prior's weight is the one whose variance between
sites, beyond the sampling variance, matches the observed one (moments), so a
sparse site stays near its parent and a large one speaks for itself. A
document's own probability is taken out of its sites' sums. The score adds to
the document's log-odds what its path's posterior says beyond the global mean.

The classifier is fitted on at most ``max_labelled`` labelled rows, those with
the smallest hash of their id; the site statistics cover all rows.

Null hosts or paths are a site of their own. A null text is the empty text.
Without labels of both kinds the classifier says the share of good labels (one
half without any) for every document. Empty tables give empty results, repeated
rows repeated results. Hot hosts are pre-aggregated in each task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import id_remainder, size_within, utf8
from geoengine.session import durable

FEATURES = ("size", "upper", "digit", "symbol", "high", "line", "word", "distinct", "top", "marked", "repeats", "lines_again", "title", "single")
#: Sites of at most so many rows are broadcast.
BROADCAST_SITES = 100_000
#: Classes of bytes: 0 space, 1 lower case, 2 upper case, 3 digit, 4 symbol, 5 above 127, 6 line feed.
KIND = np.array([6 if c == 10 else 0 if c in b" \t\r\x0b\x0c" else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 5 if c > 127 else 4 for c in range(256)], np.uint8)


def features(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        math.log(n), kinds[2], kinds[3], kinds[4], kinds[5], math.log(n / len(lines)), math.log(sum(map(len, words)) / n),
        # how far distinct words fall short of what texts of that length have
        math.log(len(seen)) / math.log(n + 1), max(seen.values()) / n, marks / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), sum(map(bytes.istitle, words)) / n, sum(len(w) == 1 for w in words) / n,
    ]


def feature_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """id, host, path, x (array of features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_buffer().to_pybytes()) for t in b.column(3)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], x], names=["id", "host", "path", "x"])

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col, path_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), utf8(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kinds[0]}, host {kinds[1]}, path {kinds[2]}, x array<double>")


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares and a constant."""
    return np.c_[np.ones(len(x)), x, x * x]


def fit(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, folds: int, max_labelled: int, ridge: float) -> dict | float:
    """Mean, spread and weights of a ridge logistic regression; the share of good labels if there is only one kind."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    some = one.where(id_remainder("__id", folds) != 0).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    got = rows.join(F.broadcast(some), F.col("id") == F.col("__id")).select("x", "label").orderBy("__id", "x").toArrow()
    y = got["label"].to_numpy().astype(np.float64) > 0
    if not len(y) or y.all() or not y.any():
        return float(y.mean()) if len(y) else 0.5
    x = np.array(got["x"].to_pylist(), np.float64)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    m = expanded(np.clip((x - mean) / spread, -8, 8))
    beta, penalty = np.zeros(m.shape[1]), ridge * np.eye(m.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + penalty, m.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "spread": spread.tolist(), "beta": beta.tolist()}


def evidence(model: dict | float) -> Column:
    """The classifier's probability of a good document, as an expression over x."""
    if isinstance(model, float):
        return F.lit(min(max(model, 0.02), 0.98))
    k = len(FEATURES)
    z = F.lit(model["beta"][0])
    for i in range(k):
        v = F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (F.col("x")[i] - model["mean"][i]) / model["spread"][i]))
        z = z + v * model["beta"][1 + i] + v * v * model["beta"][1 + k + i]
    # no document is beyond what its sites can say
    return F.least(F.lit(0.995), F.greatest(F.lit(0.005), 1 / (1 + F.exp(-z))))


def weight(sites: DataFrame, parent: Column) -> float:
    """The Beta prior's weight: how many documents the parent's mean counts for, from sites with total p, squares q and n documents."""
    mean = F.col("p") / F.col("n")
    within = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")
    r = sites.where("n > 1").agg(F.avg((mean - parent) ** 2).alias("seen"), F.avg(within).alias("noise"), F.avg(parent * (1 - parent)).alias("whole")).first()
    if r.seen is None or r.whole is None:
        return 10.0
    between = r.seen - r.noise
    return min(max(r.whole / between - 1, 1.0), 1e4) if between > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", folds: int = 5, max_labelled: int = 20_000, ridge: float = 3.0) -> DataFrame:
    """id, held_out, doc_score, host_score, path_score, score (0 to 1), predicted (1: good): a row for each row of ``docs``."""
    rows = durable(feature_rows(docs, id_col, text_col, host_col, path_col))
    model = fit(rows, labels, id_col, label_col, folds, max_labelled, ridge)
    scored = durable(rows.select("id", "host", "path", evidence(model).alias("p")))
    paths = durable(scored.groupBy("host", "path").agg(F.sum("p").alias("p"), F.sum(F.col("p") ** 2).alias("q"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if not total.n:
        prior = 0.5
    else:
        prior = total.p / total.n
    at_host = weight(hosts, F.lit(prior))
    host = hosts.select(F.col("host").alias("__h"), F.col("p").alias("hp"), F.col("n").alias("hn"))
    sites = paths.join(host, F.col("host").eqNullSafe(F.col("__h"))).withColumn("above", (prior * at_host + F.col("hp")) / (at_host + F.col("hn")))
    at_path = weight(sites, F.col("above"))
    both = durable(sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "hp", "hn", F.col("p").alias("pp"), F.col("n").alias("pn")))
    both = F.broadcast(both) if size_within(both, BROADCAST_SITES) else both
    joined = scored.join(both, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    # the document's own part leaves its sites' sums
    above = (prior * at_host + F.col("hp") - F.col("p")) / (at_host + F.col("hn") - 1)
    site = (above * at_path + F.col("pp") - F.col("p")) / (at_path + F.col("pn") - 1)
    odds = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.least(F.lit(0.999), F.greatest(F.lit(0.001), c))
    out = joined.select("id", "p", safe(above).alias("above"), safe(site).alias("site"))
    z = odds(F.col("p")) + odds(F.col("site")) - odds(safe(F.lit(prior)))
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select(F.col("id").alias(id_col), (id_remainder("id", folds) == 0).alias("held_out"), F.col("p").alias("doc_score"), F.col("above").alias("host_score"), F.col("site").alias("path_score"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
