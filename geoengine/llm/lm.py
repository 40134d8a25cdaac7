"""Language-model scoring with a hierarchical Pitman-Yor process.

Tokens are a text's words, A-Z lower-cased, and one end. Each token is a
customer of the restaurant of its context, the word before it (the start of a
text is a context of its own). Words find their restaurant by a hash of 20 bits,
so words may share one; a word that is frequent rules the restaurant it shares.
The tables of all context restaurants are the customers of one shared parent,
the unigram restaurant, whose base is uniform over the training vocabulary and
one unknown word. Seating is sampled by Gibbs: the number of tables that serve a
word in a restaurant is drawn from its conditional given everything else, with
the arrangement at the tables summed out (generalized Stirling numbers) for up to
256 customers; more are seated one after the other up to 256 and then in blocks of
a 32nd of those seated, each with the probability at its middle. Predictive
probabilities are averaged over the sweeps after the burn-in. Discounts come from
the counts of counts. A token's log10 probability is rounded to 1/4096, far less
than sweeps differ by.

How it is distributed. Texts are read in chunks of some million tokens. A chunk
turns into its distinct (word, context) pairs with training counts, cut into
buckets by the word's hash, and its texts into places in that list of pairs.
All pairs of a word meet in one bucket, whatever their contexts, so a bucket
holds the word's part of every restaurant and of the parent. A sweep needs from
outside only the restaurants' totals, 2^20 + 1 sums at any size that the driver
hands on from sweep to sweep. Buckets keep no seating: a sweep's choices are
functions of seed, sweep, bucket and those totals, and a later sweep replays the
earlier ones, so a lost executor costs its own buckets only. At the end each
bucket answers the chunks' pairs, and the chunks score their texts. Nothing of
the size of the vocabulary reaches the driver or is broadcast, and no word is
dropped: what is gathered grows with the corpus. The number of buckets grows
with the number of documents. Words are told apart by 64-bit hashes.

A null text is the empty text (one end token); null ids count as the empty text
for the hold-out rule. Without training texts every probability is 1. Empty
tables give empty results, repeated rows repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import id_remainder, packed, unpacked, utf8, words_of
from geoengine.session import durable

#: Restaurants of contexts: words by their hash, and the start.
CONTEXTS, START, SHIFT = 1 << 20, (1 << 20) - 1, 20
END = xxhash.xxh64_intdigest(b" ")
EXACT = 256
#: Restaurants whose totals are added up together.
RANGE = 1 << 16
#: Steps of a token's log10 probability: answers travel in whole steps.
STEP = 4096
#: Weights of table numbers that are held at once.
CELLS = 1 << 20


def context(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1) % START


def packed_pairs(h: np.ndarray, c: np.ndarray, buckets: int) -> bytes:
    """A bucket's pairs in order of word and context: each word once, without what the bucket's number tells, with its pairs' number; contexts as steps inside a word."""
    first = np.r_[True, h[1:] != h[:-1]][: h.size]
    starts = np.flatnonzero(first)
    words = packed(h[starts] // np.uint64(buckets), np.diff(starts, append=h.size).astype(np.int32))
    c = c.astype(np.int32)
    return len(words).to_bytes(4, "big") + words + packed(np.where(first, c, np.diff(c, prepend=np.int32(0))))


def unpacked_pairs(data: bytes, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data = memoryview(data)
    cut = 4 + int.from_bytes(data[:4], "big")
    words, sizes = unpacked(data[4:cut], np.uint64, np.int32)
    c = np.cumsum(unpacked(data[cut:], np.int32)[0], dtype=np.int64)
    before = np.r_[0, c][np.cumsum(sizes) - sizes]
    h = np.repeat(words * np.uint64(buckets) + np.uint64(bucket), sizes)
    return h, (c - np.repeat(before, sizes)).astype(np.uint32)


class Chunk:
    """Texts on their way into pairs and places."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.docs: list[tuple[object, bool]] = []
        self.arrays: list[np.ndarray] = []
        self.tokens = 0

    def add(self, key: object, held_out: bool, text: bytes) -> None:
        words, numbers = words_of(text), self.numbers
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        self.arrays.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.docs.append((key, held_out))
        self.tokens += len(words) + 1

    def rows(self, name: str, buckets: int, piece: int) -> Iterator[tuple]:
        """(chunk, kind, part, data, counts, ids, held, sizes): kind 0 a bucket's pairs, kind 1 texts as places."""
        words = list(self.numbers)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words] + [END], np.uint64)
        classes = np.array([context(w) for w in words] + [START], np.int64)
        sizes = np.array([a.size + 1 for a in self.arrays], np.int64)
        ends = np.cumsum(sizes)
        word = np.full(int(ends[-1]), len(words), np.int64)
        inside = np.ones(word.size, bool)
        inside[ends - 1] = False
        word[inside] = np.concatenate(self.arrays)
        before = np.r_[0, word[:-1]]
        ctx = classes[before]
        ctx[ends - sizes] = START
        pairs, place = np.unique(word << SHIFT | ctx, return_inverse=True)
        learned = np.repeat(np.array([not h for _, h in self.docs]), sizes)
        counts = np.bincount(place[learned], minlength=pairs.size).astype(np.int32)
        h, c = hashes[pairs >> SHIFT], (pairs & (1 << SHIFT) - 1).astype(np.uint32)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((c, h, bucket))
        rank = np.empty(order.size, np.int32)
        rank[order] = np.arange(order.size, dtype=np.int32)
        h, c, counts, bucket, place = h[order], c[order], counts[order], bucket[order], rank[place]
        cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), bucket.size]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield name, 0, int(bucket[a]), packed_pairs(h[a:b], c[a:b], buckets), packed(counts[a:b]), [], [], []
        first = 0
        while first < len(self.docs):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + piece)))
            a, b = int(ends[first] - sizes[first]), int(ends[last - 1])
            part = self.docs[first:last]
            yield name, 1, first, packed(place[a:b]), None, [k for k, _ in part], [x for _, x in part], sizes[first:last].tolist()
            first = last


def chunked(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int, buckets: int, tokens: int) -> DataFrame:
    kind = docs.schema[id_col].dataType
    names = ["chunk", "kind", "part", "data", "counts", "ids", "held", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk, types = TaskContext.get().partitionId(), count(), Chunk(), None

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{task}-{next(number)}"
            for row in chunk.rows(name, buckets, 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for b in batches:
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(b.schema.field(0).type), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            for key, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                chunk.add(key, held, text.as_buffer().to_pybytes())
                if chunk.tokens >= tokens:
                    yield from flush()
                    chunk = Chunk()
        if chunk.docs:
            yield from flush()

    rows = docs.select(F.col(id_col).alias("id"), (id_remainder(id_col, folds) == fold).alias("held"), utf8(text_col).alias("t"))
    return rows.mapInArrow(run, f"chunk string, kind int, part int, data binary, counts binary, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<bigint>")


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One list of pairs in order of word and context, with summed counts."""
    h, c, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    return h[starts], c[starts], np.add.reduceat(n, starts)


def by_bucket(pairs: DataFrame, buckets: int) -> DataFrame:
    """bucket, data (hash, context, count of all its pairs), and sums: words, tokens, and pairs and words seen once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, waiting = None, [], 0

        def out() -> pa.RecordBatch:
            h, c, n = merged(parts)
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            seen = np.add.reduceat((n > 0).astype(np.int64), starts)
            sums = [int((seen > 0).sum()), int(n.sum()), *(int((n == k).sum()) for k in (1, 2)), *(int((seen == k).sum()) for k in (1, 2))]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(h, c, n)], pa.binary()), pa.array([sums], pa.list_(pa.int64()))], names=["bucket", "data", "sums"])

        for b in batches:
            for bucket, data, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if at is not None and bucket != at:
                    yield out()
                    parts, waiting = [], 0
                at = bucket
                parts.append((*unpacked_pairs(data.as_buffer(), bucket, buckets), *unpacked(counts.as_buffer(), np.int32)))
                waiting += parts[-1][0].size
                if waiting > 1 << 21 and len(parts) > 1:
                    parts = [merged(parts)]
                    waiting = 0
        if at is not None:
            yield out()

    rows = pairs.select(F.col("part").alias("bucket"), "data", "counts").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "bucket int, data binary, sums array<bigint>")


def stirling(discount: float) -> np.ndarray:
    """Logs of the generalized Stirling numbers S(c, t) for c, t <= EXACT: the weight of all arrangements of c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c, :c], out[c, 1 : c + 1] + np.log(c - discount * t))
        out[c + 1, c + 1] = out[c, c]
    return out


def seated(customers: np.ndarray, others: np.ndarray, base: np.ndarray, theta: float, d: float, logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables for each dish, given its customers, the restaurant's tables for other dishes, and the dish's probability in the parent."""
    t = np.minimum(customers, 1)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(customers[order], kind="stable")]
    sizes = customers[order]
    for c in np.unique(sizes[: np.searchsorted(sizes, EXACT + 1)]).tolist():
        own = order[np.searchsorted(sizes, c) : np.searchsorted(sizes, c + 1)]
        for k in range(0, own.size, CELLS // c):
            i = own[k : k + CELLS // c]
            new = np.log((theta + d * (others[i][:, None] + np.arange(c))) * base[i][:, None])
            w = logs[c, 1 : c + 1] + np.cumsum(new, axis=1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[i] = 1 + (w < (rng.random(i.size) * w[:, -1])[:, None]).sum(axis=1)
    live = order[np.searchsorted(sizes, EXACT + 1) :]
    n = 1
    while live.size:
        step = np.minimum(1 if n < EXACT else n // 32, customers[live] - n)
        new = (theta + d * (others[live] + t[live])) * base[live]
        p = new / (new + n + (step - 1) / 2 - d * t[live])
        t[live] += rng.binomial(step, p)
        n += 1 if n < EXACT else n // 32
        live = live[customers[live] > n]
    return t


class Bucket:
    """A bucket's part of the restaurants, replayed through the sweeps so far."""

    def __init__(self, number: int, data: bytes, setting: dict):
        self.h, self.c, self.n = unpacked(data, np.uint64, np.uint32, np.int64)
        self.starts = np.flatnonzero(np.r_[True, self.h[1:] != self.h[:-1]])
        self.word = np.repeat(np.arange(self.starts.size), np.diff(np.r_[self.starts, self.h.size]))
        self.number, self.s = number, setting
        self.t = np.minimum(self.n, 1)
        self.parent = np.add.reduceat(self.t, self.starts)
        self.t0 = np.minimum(self.parent, 1)
        self.logs = stirling(setting["d"]), stirling(setting["d0"])

    def unigram(self, totals: dict) -> np.ndarray:
        s = self.s
        return (self.parent - s["d0"] * self.t0 + (s["theta0"] + s["d0"] * totals["t0"]) / (s["vocabulary"] + 1)) / (s["theta0"] + totals["tables"].sum())

    def sweep(self, number: int, totals: dict) -> None:
        s, rng = self.s, np.random.default_rng([self.s["seed"], number, self.number])
        base = self.unigram(totals)[self.word]
        self.t = seated(self.n, totals["tables"][self.c] - self.t, base, s["theta"], s["d"], self.logs[0], rng)
        self.parent = np.add.reduceat(self.t, self.starts)
        flat = np.full(self.starts.size, 1 / (s["vocabulary"] + 1))
        self.t0 = seated(self.parent, totals["t0"] - self.t0, flat, s["theta0"], s["d0"], self.logs[1], rng)

    def predictive(self, totals: dict) -> np.ndarray:
        s, customers, tables = self.s, self.s["customers"], totals["tables"]
        new = ((s["theta"] + s["d"] * tables) / (s["theta"] + customers))[self.c]
        return (self.n - s["d"] * self.t) / (s["theta"] + customers[self.c]) + new * self.unigram(totals)[self.word]

    def replay(self, history: list[dict], burn: int) -> np.ndarray:
        """Run a sweep from each of the totals; the mean prediction over the sweeps after the burn-in whose totals are known."""
        total, used = np.zeros(self.h.size), 0
        for k, totals in enumerate(history):
            if k > burn:
                total, used = total + self.predictive(totals), used + 1
            if k < self.s["sweeps"]:
                self.sweep(k, totals)
        return total / max(used, 1)


def pieces(total: np.ndarray) -> pa.RecordBatch:
    """(part, data): the ranges of an array that are not all zero."""
    cut = [(k, total[k * RANGE : (k + 1) * RANGE]) for k in range(-(-total.size // RANGE))]
    cut = [(k, packed(a)) for k, a in cut if a.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([x for _, x in cut], pa.binary())], names=["part", "data"])


def added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays that came as rows of ``pieces``; each range is added up in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                (a,) = unpacked(data.as_buffer(), np.int64)
                sums[part] = sums[part] + a if part in sums else a
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(a) for a in sums.values()], pa.binary())], names=["part", "data"])

    out = np.zeros(size, np.int64)
    got = rows.repartition(-(-size // RANGE), "part").mapInArrow(run, "part int, data binary").toArrow()
    for part, data in zip(got.column("part").to_pylist(), got.column("data").to_pylist()):
        out[part * RANGE : (part + 1) * RANGE] = unpacked(data, np.int64)[0]
    return out


def opening(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The contexts' customers, and their tables while each dish has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CONTEXTS, np.int64)
        for b in batches:
            for data in b.column(0):
                _, c, n = unpacked(data.as_buffer(), np.uint64, np.uint32, np.int64)
                total[:CONTEXTS] += np.bincount(c, weights=n, minlength=CONTEXTS).astype(np.int64)
                total[CONTEXTS:] += np.bincount(c[n > 0], minlength=CONTEXTS)
        yield pieces(total)

    total = added(state.select("data").mapInArrow(run, "part int, data binary"), 2 * CONTEXTS)
    return total[:CONTEXTS], total[CONTEXTS:]


def carried(setting: dict, history: list[dict]) -> tuple[dict, list[dict]]:
    """Settings and totals as they are broadcast."""
    return {**setting, "customers": packed(setting["customers"])}, [{**t, "tables": packed(t["tables"])} for t in history]


def received(setting: dict, history: list[dict]) -> tuple[dict, list[dict]]:
    whole = lambda data: unpacked(data, np.int64)[0]
    return {**setting, "customers": whole(setting["customers"])}, [{**t, "tables": whole(t["tables"])} for t in history]


def sampled(state: DataFrame, setting: dict, first: dict) -> list[dict]:
    """The restaurants' totals before and after each sweep."""
    history, sc = [first], state.sparkSession.sparkContext
    for _ in range(setting["sweeps"]):
        sent = sc.broadcast(carried(setting, history))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            setting, history = received(*sent.value)
            total = np.zeros(CONTEXTS + 1, np.int64)
            for b in batches:
                for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                    own = Bucket(number, data.as_buffer(), setting)
                    own.replay(history, setting["sweeps"])
                    total[:CONTEXTS] += np.bincount(own.c, weights=own.t, minlength=CONTEXTS).astype(np.int64)
                    total[CONTEXTS] += own.t0.sum()
            yield pieces(total)

        sums = added(state.select("bucket", "data").mapInArrow(run, "part int, data binary"), CONTEXTS + 1)
        history = [*history, {"tables": sums[:CONTEXTS], "t0": int(sums[CONTEXTS])}]
    return history


def answered(pairs: DataFrame, state: DataFrame, setting: dict, history: list[dict], buckets: int) -> DataFrame:
    """chunk, kind 0, part (bucket), data: for each of the chunk's pairs the log10 probability, in steps, and the word's training count."""
    sent = state.sparkSession.sparkContext.broadcast(carried(setting, history))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setting, history = received(*sent.value)
        own = words = codes = logs = counts = None
        for b in batches:
            for number, chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if chunk is None:
                    own = Bucket(number, data.as_buffer(), setting)
                    logs = np.rint(np.log10(own.replay(history, setting["burn"])) * -STEP).astype(np.int32)
                    words = own.h[own.starts]
                    codes = own.word << SHIFT | own.c
                    counts = np.add.reduceat(own.n, own.starts)[own.word].astype(np.uint64)
                    continue
                h, c = unpacked_pairs(data.as_buffer(), number, buckets)
                at = np.searchsorted(codes, np.searchsorted(words, h) << SHIFT | c)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0], pa.int32()), pa.array([number], pa.int32()), pa.array([packed(logs[at], counts[at])], pa.binary())], names=["chunk", "kind", "part", "data"])

    none = F.lit(None).cast("string")
    rows = pairs.select(F.col("part").alias("bucket"), "chunk", "data").unionByName(state.select("bucket", none.alias("chunk"), "data"))
    # a bucket's state comes first
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    return rows.select("bucket", "chunk", "data").mapInArrow(run, "chunk string, kind int, part int, data binary")


def scored(texts: DataFrame, answers: DataFrame, setting: dict, id_col: str) -> DataFrame:
    """The chunks' texts with their answers: a partition for each chunk, so that no task grows with the corpus."""
    chunks = max(1, texts.select("chunk").distinct().count())
    kind = texts.schema["ids"].dataType.elementType.simpleString()
    n, v = setting["tokens"], setting["vocabulary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, table = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                chunk, what, data = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].as_buffer()
                if chunk != at:
                    at, parts, table = chunk, [], None
                if what == 0:
                    parts.append(unpacked(data, np.int32, np.uint64))
                    continue
                if table is None:
                    logs, counts = (np.concatenate(x) for x in zip(*parts))
                    table = logs / -STEP, np.log10((counts + 1.0) / (n + v + 1.0)), (counts > 0).astype(np.int64)
                (place,) = unpacked(data, np.int32)
                sizes = b.column(6)[i].values.to_numpy()
                starts = np.cumsum(sizes) - sizes
                logs, base, known = (np.add.reduceat(x[place], starts) for x in table)
                yield pa.RecordBatch.from_arrays([b.column(4)[i].values, b.column(5)[i].values, pa.array(sizes), pa.array(known), pa.array(np.full(sizes.size, n, np.int64)), pa.array(base), pa.array(logs)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = texts.unionByName(answers, allowMissingColumns=True)
    rows = rows.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "part")
    out = rows.select("chunk", "kind", "part", "data", "ids", "held", "sizes").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, burn: int = 2, samples: int = 2, theta: float = 1.0, theta0: float = 50.0, seed: int = 23, bucket_docs: int = 4_000, chunk_tokens: int = 3_000_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's log10 probability) for each row."""
    buckets = max(16, docs.count() // bucket_docs)
    rows = durable(chunked(docs, id_col, text_col, folds, fold, buckets, chunk_tokens))
    pairs, texts = rows.where("kind = 0"), rows.where("kind = 1")
    state = durable(by_bucket(pairs, buckets))
    sums = state.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(6)]).first()
    vocabulary, tokens, one, two, u_one, u_two = (int(x) for x in sums)
    customers, tables = opening(state)
    discount = lambda a, b: min(max(a / max(a + 2 * b, 1), 0.05), 0.95)
    setting = {"d": discount(one, two), "d0": discount(u_one, u_two), "theta": theta, "theta0": theta0, "vocabulary": vocabulary, "tokens": tokens, "customers": customers, "seed": seed, "sweeps": burn + samples, "burn": burn}
    first = {"tables": tables, "t0": vocabulary}
    history = sampled(state, setting, first)
    return scored(texts, answered(pairs, state, setting, history, buckets), setting, id_col)


def perplexity(scores: DataFrame, column: str = "score") -> float:
    """10 to the mean negative log10 probability of a token over the rows."""
    r = scores.agg(F.sum(column).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r.s / r.n) if r.n else float("nan")
