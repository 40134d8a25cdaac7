"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds
its letters: the first letter's vector rotated by two places, times the
second's rotated by one, times the third's. A text's vector bundles (adds) the
vectors of its trigrams; a language's prototype bundles those of its training
texts. The prediction is the language whose prototype has the largest cosine to
the text's vector, ties to the smaller language; the score is that cosine,
at least 0.

Letters are Unicode letters, lower-cased; a run of other characters is one
boundary. a-z have a class each, other letters share 997 classes by code point,
so the letters of an alphabet all differ, and ideographs share.

Counts of trigrams per text are exact, and one matrix product turns counts into
vectors, for a small group of texts at a time: memory does not grow with a text
or a batch. Prototypes come from all training texts: tasks add up counts per
language and send one vector per language each.

How close a text can be expected to come grows with its length: n trigrams drawn
from a language whose trigrams agree by chance with probability q have a cosine
of about sqrt(nq / (1 + nq)) to its prototype, and q is the prototype's squared
length over dims and the square of its trigrams. ``keep_known`` asks for a share
of that, less the noise of a cosine in so many dimensions, so that one rule holds
for all lengths.

A null text or one without letters gives ``und`` with score 0, as does any text
if nothing was learned; texts of null language teach nothing. Null ids count as
the empty text for the hold-out rule. Empty tables give empty results, repeated
rows repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import id_remainder

UNKNOWN = "und"
DIMS = 1024
CLASSES = 1024
SHIFT = 10
#: Texts whose counts are multiplied together, and trigram vectors held at once.
GROUP, ROWS = 64, 8192
BATCH = 1024
#: Counted trigrams of a language that wait in a training task to be added up.
WAITING = 1 << 20


@cache
def classes() -> np.ndarray:
    """Class of every code point: 0 is no letter, 1-26 a-z, 27-1023 other letters."""
    table = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[i] = low - 96 if 97 <= low <= 122 else 27 + low % 997
    return table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = classes()[points].astype(np.int32)
    if not c.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    c = np.r_[np.int32(0), c[keep], np.int32(0)]
    codes = np.sort((c[:-2] << 2 * SHIFT) | (c[1:-1] << SHIFT) | c[2:])
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.diff(np.r_[starts, codes.size])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several counted texts and the sums of their counts."""
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    total = np.zeros(codes.size, np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in parts]))
    return codes, total


@dataclass
class Model:
    langs: list[str]
    #: a prototype for each language, scaled to length 1
    unit: np.ndarray
    #: the probability that two trigrams of the language are the same
    alike: np.ndarray


class Space:
    """The letter vectors and the products with trigram vectors."""

    def __init__(self, dims: int, seed: int):
        self.dims = dims
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dims))
        self.parts = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        first, second, third = self.parts
        return (first[codes >> 2 * SHIFT] * second[codes >> SHIFT & CLASSES - 1] * third[codes & CLASSES - 1]).astype(np.float32)

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A vector for each text."""
        out = np.zeros((len(counted), self.dims))
        codes = np.unique(np.concatenate([c for c, _ in counted])) if counted else np.zeros(0, np.int32)
        for k in range(0, codes.size, ROWS):
            part = codes[k : k + ROWS]
            counts = np.zeros((len(counted), part.size), np.float32)
            for i, (c, n) in enumerate(counted):
                a, b = np.searchsorted(c, (part[0], part[-1] + 1))
                counts[i, np.searchsorted(part, c[a:b])] = n[a:b]
            out += counts @ self.vectors(part)
        return out


def prototypes(docs: DataFrame, train, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS, seed: int = 5) -> Model:
    """Languages in order with their prototypes, from the rows that satisfy ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, parts, waiting = Space(dims, seed), {}, {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                counted = trigrams(text.as_py())
                if counted[0].size:
                    parts.setdefault(lang, []).append(counted)
                    waiting[lang] = waiting.get(lang, 0) + counted[0].size
                    if waiting[lang] > WAITING and len(parts[lang]) > 1:
                        parts[lang], waiting[lang] = [added(parts[lang])], 0
        for lang, own in parts.items():
            codes, total = added(own)
            # integers throughout: a prototype does not depend on how rows were dealt
            vector = np.zeros(dims, np.int64)
            for k in range(0, codes.size, ROWS):
                vector += (space.vectors(codes[k : k + ROWS]).astype(np.int64) * total[k : k + ROWS][:, None]).sum(axis=0)
            sent = np.r_[vector, total.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * sent.size, pa.string()), pa.array(np.arange(sent.size)), pa.array(sent)], names=["lang", "i", "x"])

    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # a row for each language and dimension
    got = rows.mapInArrow(run, "lang string, i long, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas().sort_values(["lang", "i"])
    langs = sorted(set(got.lang))
    sums = got.x.to_numpy(np.float64).reshape(len(langs), dims + 1)
    length = np.maximum(np.linalg.norm(sums[:, :dims], axis=1), 1e-300)
    return Model(langs, sums[:, :dims] / length[:, None], length**2 / dims / np.maximum(sums[:, dims], 1) ** 2)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, seed: int = 5, keep_row: bool = False) -> DataFrame:
    """id, lang_pred, score, trigrams (how many the text has), expected (the cosine of so many trigrams of that language) for each row; with ``keep_row``, the row's columns followed by __lang, __score, __trigrams and __expected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(space: Space, texts: list[str | None]) -> tuple[list[str], list[float], list[int], list[float]]:
        m = sent.value
        out_l, out_s, out_n, out_e = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts)
        for k in range(0, len(texts), GROUP):
            counted = [(i, trigrams(t)) for i, t in enumerate(texts[k : k + GROUP], k) if t]
            counted = [(i, c) for i, c in counted if c[0].size]
            for i, c in counted:
                out_n[i] = int(c[1].sum())
            if not counted or not m.langs:
                continue
            v = space.bundle([c for _, c in counted])
            cosine = v @ m.unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for (i, _), j, c in zip(counted, cosine.argmax(axis=1).tolist(), cosine):
                out_l[i], out_s[i] = m.langs[j], float(min(1.0, max(0.0, c[j])))
                out_e[i] = float(np.sqrt(out_n[i] * m.alike[j] / (1 + out_n[i] * m.alike[j])))
        return out_l, out_s, out_n, out_e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dims, seed)
        for b in batches:
            n = b.num_columns - 1
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                lang, score, size, expected = scored(space, part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64()), pa.array(expected, pa.float64())], names=[f"c{i}" for i in range(n)] + ["lang", "score", "trigrams", "expected"])

    kept = docs.columns if keep_row else [id_col]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).alias("__text"))
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + ["lang string", "score double", "trigrams long", "expected double"])
    names = [*kept, "__lang", "__score", "__trigrams", "__expected"] if keep_row else [id_col, "lang_pred", "score", "trigrams", "expected"]
    return inner.mapInArrow(run, schema).toDF(*names)


def identify(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, **options) -> DataFrame:
    """id, held_out, lang_pred, score: learned from the rows whose id is not held out."""
    model = prototypes(docs, id_remainder(id_col, folds) != 0, **options)
    got = predict(docs, model, id_col, **options)
    return got.select(id_col, (id_remainder(id_col, folds) == 0).alias("held_out"), "lang_pred", "score", "trigrams")


def keep_known(docs: DataFrame, min_share: float = 0.35, errors: float = 2.0, id_col: str = "doc_id", folds: int = 5, dims: int = DIMS, **options) -> DataFrame:
    """The rows of ``docs`` whose text has letters and is close enough to a learned language.

    A text goes if its cosine is below ``min_share`` of what is expected of its
    length by more than ``errors`` standard errors of a cosine in ``dims`` dimensions.
    """
    model = prototypes(docs, id_remainder(id_col, folds) != 0, dims=dims, **options)
    got = predict(docs, model, id_col, dims=dims, keep_row=True, **options)
    near = (F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_share * F.col("__expected") - errors / dims**0.5)
    return got.where(near).drop("__lang", "__score", "__trigrams", "__expected")
