"""SimHash fingerprints of documents, and near duplicates by covering hashing.

A fingerprint has 64 bits, from the XXH64 of the word shingles. Fingerprints
link at ``radius`` or fewer differing bits. The covering family: every bit
position i gets a nonzero vector m(i) of radius + 1 bits; mask v, one for each
nonzero v, keeps the positions with an odd number of ones in m(i) & v. The
vectors of at most ``radius`` differing positions do not span the whole space,
so some v is orthogonal to all of them: under that mask the two fingerprints
are equal. Every linked pair thus meets in at least one of the 2^(radius+1) - 1
tables; there are no misses to tune away.

Groups of copies cost nothing extra: the tables hold distinct fingerprints. A
bucket gives a spanning forest of its links, not its pairs. A bucket of over
``bucket_limit`` distinct fingerprints is dealt out again by a second covering
family over the bits that its mask leaves free. What shares both keys can differ
in at most 16 bits (for radius 4), which bounds every second bucket.

``keep_one`` wants near copies: texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more, exactly. The SimHashes of the sets are linked
as above, and each link is verified on the whole sets. For similar sets whose
SimHashes are further apart, an exact completion follows: sets of sizes na and nb
that similar differ in at most d = (na + nb) / 9 elements, so cut into parts by
the elements' hashes they differ in at most d parts, and the d + 1 parts that come
first in any one order of all parts hold one they share. Texts meet by those
parts, larger ones first, as several shingles seldom agree by chance. Shingles that
are common in a sample of texts stand aside as long as enough parts are left
without them. Texts that meet, are not joined by verified links and may still be
similar by sizes and bitmaps of parities (which differ in no more bits than the
sets do in elements) form groups; the sets of a group are compared in its task,
from which only the links that join them leave. No pair of similar sets is missed.

Nulls: a null text is the empty text, with fingerprint zero, linked like any
other; a null doc_id is a row like others, and never the smallest of its
component unless all of the component's are null. Repeated rows give repeated
rows. An empty table gives an empty result. Only the two named columns are
read, so further columns don't matter.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoengine.llm.common import batch_of, column, give_back, packed, size_within, unpacked, utf8, words_of
from geoengine.session import durable

BITS = 64
#: Longs of a set's parity bitmap; sets of over about twice its bits always go on to be verified.
PARITY = 16
#: Shingles whose bits are unpacked at once; bounds memory for very long texts.
SLICE = 1 << 15
#: Bits of a part's signature that are shuffled; agreement by chance only costs a pair to verify.
SIGNED = 48
#: Signatures that a task gathers before it sends them on in blocks.
GATHERED = 1 << 18
#: Keys of texts that are broadcast to find the texts; more are joined by shuffles.
KEYS = 1_000_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number: a bit is 1 if it is set in over half of the shingle hashes."""
    words = words_of(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, seed), "big", signed=True)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts, ends = (ends - lengths)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    return majority(np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE])]), ">u8") for k in range(0, len(starts), SLICE))


def majority(slices: Iterable[np.ndarray]) -> int:
    """The signed number whose bits are 1 where over half of the hashes, which come in slices, have a 1."""
    ones, count = np.zeros(BITS, np.int64), 0
    for hashes in slices:
        bits = np.unpackbits(hashes.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1)
        ones, count = ones + bits.sum(axis=0, dtype=np.int32), count + hashes.size
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id_col``, fp (signed 64 bits): a fingerprint for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def covering_masks(positions: list[int], radius: int, seed: int) -> list[int]:
    """The masks of a covering family over ``positions``: any two words that differ in at most ``radius`` of them agree under one mask at least."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(len(positions))]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << p for p, m in zip(positions, vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]


def word_sketches(text: bytes, count: int) -> list[int]:
    """SimHashes of a text's distinct words, each by a hash of its own; signed."""
    words = set(words_of(text))
    if not words:
        return [0] * count
    ones = np.zeros((count, BITS), np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    for k in range(0, len(hashes), SLICE):
        for m in range(count):
            x = hashes[k : k + SLICE] + np.uint64(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones[m] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(words), axis=1).view(np.int64).ravel().tolist()


def forest(sketch: np.ndarray, node: np.ndarray, radius: int, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the nodes of each linked set: from each reached node to all the not yet reached ones whose sketch is within the radius and whose own bits are within ``max_bits``."""
    links, left, nodes = [], sketch, node
    while left.size > 1:
        reached, left, nodes = [(left[0], nodes[0])], left[1:], nodes[1:]
        while reached and left.size:
            centre, own = reached.pop()
            near = (np.bitwise_count(left ^ centre) <= radius) & (np.bitwise_count(nodes ^ own) <= max_bits)
            if near.any():
                links.append((np.full(int(near.sum()), own), nodes[near]))
                reached.extend(zip(left[near], nodes[near]))
                left, nodes = left[~near], nodes[~near]
    return links


def _links(masks: np.ndarray, radius: int, max_bits: int, limit: int | None):
    """Over rows (t, s, fp) sorted by (t, s & masks[t]): spanning links of each bucket (late = -1), or the members of a bucket beyond the limit (late = t)."""

    def first_of(t: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])])

    def solve(t: np.ndarray, s: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = first_of(t, s & masks[t])
        sizes = np.diff(np.r_[starts, fp.size])
        two = starts[sizes == 2]
        near = (np.bitwise_count(s[two] ^ s[two + 1]) <= radius) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits)
        yield fp[two][near], fp[two + 1][near]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            yield from forest(s[a : a + n], fp[a : a + n], radius, max_bits)

    def emit(pairs) -> Iterator[pa.RecordBatch]:
        pairs = [p for p in pairs if p[0].size]
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
            yield batch_of(late=np.full(a.size, -1, np.int32), u=np.maximum(a, b), v=np.minimum(a, b))

    def defer(t: int, s: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return batch_of(late=np.full(fp.size, t, np.int32), u=fp.view(np.int64), v=s.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s, fp, beyond = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for b in batches:
            t = np.r_[t, column(b, "t")]
            s = np.r_[s, column(b, "s").view(np.uint64)]
            fp = np.r_[fp, column(b, "fp").view(np.uint64)]
            if not fp.size:
                continue
            key = s & masks[t]
            if beyond is not None:
                more = int(np.argmin(np.r_[(t == beyond[0]) & (key == beyond[1]), False]))
                if more:
                    yield defer(beyond[0], s[:more], fp[:more])
                    t, s, fp, key = t[more:], s[more:], fp[more:], key[more:]
                if not fp.size:
                    continue
                beyond = None
            last = int(first_of(t, key)[-1])
            yield from emit(solve(t[:last], s[:last], fp[:last])) if last else ()
            t, s, fp, key = t[last:], s[last:], fp[last:], key[last:]
            if limit is not None and fp.size > limit:
                beyond = (int(t[0]), key[0])
                yield defer(beyond[0], s, fp)
                t, s, fp = t[:0], s[:0], fp[:0]
        if fp.size:
            yield from emit(solve(t, s, fp))

    return run


def links(fps: DataFrame, radius: int = 4, seed: int = 20240, bucket_limit: int = 1 << 15, sketches: int = 0, max_bits: int = BITS) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that join exactly the linked ones, directly or over others.

    Without sketches, fingerprints link at ``radius`` or fewer differing bits.
    With them, a column s (array of ``sketches`` numbers) is hashed instead, and
    a pair links if a sketch is within the radius and fp within ``max_bits``.
    """
    n, many = (2 << radius) - 1, max(1, sketches)
    first = covering_masks(list(range(BITS)), radius, seed)
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m

    def dealt(rows: DataFrame, masks: list[int], limit: int | None) -> DataFrame:
        # one literal array lookup gives a row's mask; the key itself is not shuffled
        table = F.array(*[F.lit(signed(m)) for m in masks])
        if sketches:
            key = F.col("s").bitwiseAND(F.element_at(table, F.col("t") % len(masks) + 1))
            rows = rows.repartition("t", key).sortWithinPartitions("t", key).select("t", "s", "fp")
        else:
            key = F.col("fp").bitwiseAND(F.element_at(table, F.col("t") + 1))
            rows = rows.select("t", "fp").repartition("t", key).sortWithinPartitions("t", key).select("t", F.col("fp").alias("s"), "fp")
        return rows.mapInArrow(_links(np.array(masks * many, np.uint64), radius, max_bits, limit), "late int, u long, v long")

    if sketches:
        rows = fps.select("fp", F.posexplode("s").alias("m", "s")).select(F.explode(F.sequence(F.col("m") * n, F.col("m") * n + (n - 1))).alias("t"), "s", "fp")
    else:
        rows = fps.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"), "fp")
    found = durable(dealt(rows, first, bucket_limit))
    late = found.where("late >= 0")
    out = found.where("late < 0").select("u", "v")
    if late.isEmpty():
        return out
    # the first key stays part of the second: a row's two masks are joined, and cover disjoint bits
    both = [first[t] | m for t in range(n) for m in covering_masks([p for p in range(BITS) if not first[t] >> p & 1], radius, seed + 1 + t)]
    again = late.select(F.explode(F.sequence(F.col("late") * n, F.col("late") * n + (n - 1))).alias("t"), F.col("v").alias("s"), F.col("u").alias("fp"))
    return out.unionByName(durable(dealt(again, both, None)).select("u", "v"))


def thinned(edges: DataFrame, per_task: int = 500_000) -> DataFrame:
    """u, v: for each part of about ``per_task`` edges the stars that join the same nodes, each node to the smallest it reaches in the part.

    A group meets in many tables, and each gives it a forest; joined in tasks
    that hold a bounded number of edges, they shrink to a few stars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(u), root(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        yield batch_of(u=np.array(nodes, np.int64), v=np.array([root(x) for x in nodes], np.int64))

    return edges.coalesce(max(8, -(-edges.count() // per_task))).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node of ``edges`` (u, v), by alternating large and small stars.

    Each round writes its edges to the shared folder; the loop ends when a round changes nothing.
    """
    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    sign = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = sign(e)
    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(rows: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """``id_col``, fp, component_id for rows (id, fp) whose fingerprints are linked by ``edges``."""
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    linked = durable(components(thinned(edges)).withColumnRenamed("node", "fp").join(distinct, "fp"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.join(smallest, "root").select("fp", "component_id")
    ids = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(ids, "fp").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``id_col``, fp, component_id (the smallest id reachable, itself included): a row for each row of ``docs``."""
    rows = durable(fingerprints(docs, id_col, text_col, shingle, seed))
    return classes(rows, links(rows.select("fp").distinct(), radius), id_col)


def shingles(text: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order; a text of fewer words is one shingle, one of none has none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, seed), ">u8").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts, ends = (ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist()
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends)]), ">u8").astype(np.uint64))


def common_shingles(texts: DataFrame, size: int, seed: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, counts): shingles that three or more of about ``sample`` texts (column text) share, the ``most`` most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield batch_of(s=shingles(t.as_buffer().to_pybytes(), size, seed).view(np.int64))

    share = max(1, -(-texts.count() // sample))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()
    found = some.mapInArrow(run, "s long").groupBy("s").count().where("count >= 3").orderBy(F.desc("count"), "s").limit(most).toPandas()
    hashes, counts = found["s"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _parts(a: np.ndarray, parts: int, most: int, salt: int) -> tuple[np.ndarray, int]:
    """Signatures of the ``most`` first parts of a set of hashes that holds any, largest first, and the number of parts that hold any."""
    if not a.size:
        return a, 0
    part = (a % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    x = a[order]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    signed = np.add.reduceat(x, starts)
    first = np.lexsort((signed, -np.diff(starts, append=a.size)))[:most]
    return _salted(signed[first], salt), starts.size


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(s: np.ndarray, hashes: np.ndarray, counts: np.ndarray, t: Fraction) -> np.ndarray:
    """Numbers of which any two sets with Jaccard t or more share one. ``hashes`` (ascending) with ``counts`` are the common elements.

    A scheme for each power of two that the larger set's size may have as next
    one up fixes the number of parts. A set with too few parts beside the common
    elements also gives those of the whole set, and one that has too few even so
    the elements of its prefix: of two sets, the one with enough parts suffices.
    """
    n = s.size
    if not n:
        return s
    often = np.zeros(n, np.int64)
    if hashes.size:
        at = np.minimum(np.searchsorted(hashes, s), hashes.size - 1)
        often = np.where(hashes[at] == s, counts[at], 0)
    rare, most, found = s[often == 0], n * t.denominator // t.numerator, []
    apart, both = t.denominator - t.numerator, t.denominator + t.numerator
    scheme = (n - 1).bit_length()
    while scheme == (n - 1).bit_length() or 1 << (scheme - 1) < most:
        top = 1 << scheme
        differ = (n + min(top, most)) * apart // both
        parts = -(-12 * top * apart // (5 * both)) + 2
        for level, own in enumerate((rare, s)):
            some, filled = _parts(own, parts, differ + 1, 3 * scheme + level)
            found.append(some)
            if filled > differ:
                break
        else:
            prefix = n - -(-n * t.numerator // t.denominator) + 1
            found.append(_salted(s[np.argsort(often, kind="stable")[:prefix]], 3 * scheme + 2))
        scheme += 1
    return np.concatenate(found)


def _signed(sent, size: int, seed: int, t: Fraction, ranges: int):
    """Over texts: blocks (range, data) of signatures with their set's hash; a task's repeats of a set once."""

    def block(found: list[np.ndarray], fps: list[int]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate(found) >> np.uint64(64 - SIGNED)
        fp = np.repeat(np.array(fps, np.int64), [x.size for x in found])
        at = (s % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        s, fp, at = s[order].view(np.int64), fp[order].view(np.uint64), at[order]
        cuts = np.r_[np.flatnonzero(np.diff(at, prepend=-1)), at.size].tolist()
        for a in range(0, len(cuts) - 1, 256):
            spans = list(zip(cuts[a : a + 256], cuts[a + 1 : a + 257]))
            yield batch_of(range=at[[x for x, _ in spans]], data=pa.array([packed(s[x:y], fp[x:y]) for x, y in spans], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = sent.value
        found, fps, seen, held = [], [], set(), 0
        for b in batches:
            for x in b.column(0):
                s = shingles(x.as_buffer().to_pybytes(), size, seed)
                fp = _set_hash(s, seed)
                if fp in seen or not s.size:
                    continue
                seen.add(fp)
                found.append(signatures(s, hashes, counts, t))
                fps.append(fp)
                held += found[-1].size
                if held >= GATHERED:
                    yield from block(found, fps)
                    found, fps, seen, held = [], [], set(), 0
        if found:
            yield from block(found, fps)
        give_back()

    return run


def _set_hash(s: np.ndarray, seed: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(s.tobytes(), seed), "big", signed=True)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks: fp, s for each set fp of each signature s that several sets have; two sets that are alone with several signatures come with one of a range's."""

    def out(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        s, fp = (np.concatenate(x) for x in zip(*parts))
        fp = fp.view(np.int64)
        order = np.lexsort((fp, s))
        s, fp = s[order], fp[order]
        keep = np.r_[True, (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])]
        s, fp = s[keep], fp[keep]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        sizes = np.diff(starts, append=s.size)
        two = starts[sizes == 2]
        two = two[np.unique(np.stack([fp[two], fp[two + 1]]), axis=1, return_index=True)[1]]
        many = np.repeat(sizes > 2, sizes)
        many[two] = many[two + 1] = True
        yield batch_of(fp=fp[many], s=s[many])

    ranges: dict[int, list[bytes]] = {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ranges.setdefault(k, []).append(data)
    while ranges:
        yield from out([unpacked(data, np.int64, np.uint64) for data in ranges.popitem()[1]])
    give_back()


def _unjoined(t: Fraction):
    """Over rows (s, n, fp, root, bits) sorted by (s, n): links u, v that join in each bucket (one s) the members of unlike root that can have Jaccard t by their sizes and parities; less than one a member."""
    both, apart = t.denominator + t.numerator, t.denominator - t.numerator

    def far(s, n, fp, root, bits) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        ends = np.r_[starts[1:], s.size]
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        found, held, label = [], 0, np.arange(s.size)
        for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            for i in range(a, b - 1):
                top = a + int(np.searchsorted(n[a:b], n[i] * t.denominator // t.numerator, "right"))
                k = np.flatnonzero((root[i + 1 : top] != root[i]) & (label[i + 1 : top] != label[i])) + i + 1
                differ = np.bitwise_count(bits[k] ^ bits[i]).sum(axis=1, dtype=np.int64)
                k = k[differ * both <= (n[k] + n[i]) * apart]
                if k.size:
                    joined, first = np.unique(label[k], return_index=True)
                    label[a:b][np.isin(label[a:b], joined)] = label[i]
                    k = k[first]
                    found.append((np.maximum(fp[k], fp[i]), np.minimum(fp[k], fp[i])))
                    held += k.size
                if held > SLICE:
                    yield links_of(found)
                    found, held = [], 0
        if found:
            yield links_of(found)

    def links_of(found) -> pa.RecordBatch:
        u, v = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
        return batch_of(u=u, v=v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole buckets go on; the last one of a batch waits for the rest of it
        wait: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = (*(column(b, c) for c in ("s", "n", "fp", "root")), np.array(b.column(4).flatten()).view(np.uint64).reshape(-1, PARITY))
            s = rows[0]
            if s[-1] == s[0] and (not wait or wait[0][0][0] == s[0]):
                wait.append(rows)
                continue
            last = int(np.searchsorted(s, s[-1]))
            yield from far(*(np.concatenate(x) for x in zip(*wait, tuple(x[:last] for x in rows))))
            wait = [tuple(x[last:] for x in rows)]
        if wait:
            yield from far(*(np.concatenate(x) for x in zip(*wait)))

    return run


def similar_links(sets: list[np.ndarray], label: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links i, j between ``sets`` of Jaccard t or more that join exactly what their pairs join; sets of one label are joined already."""
    n, label, found = np.array([s.size for s in sets], np.int64), label.copy(), []
    owner = np.repeat(np.arange(n.size), n)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    # the sets that hold an element, one element after the other
    holders, count = owner[np.argsort(element, kind="stable")], np.bincount(element)
    starts, cuts = np.cumsum(count) - count, np.r_[0, np.cumsum(n)]
    for i in range(n.size):
        if (label == label[i]).all():
            break
        own = element[cuts[i] : cuts[i + 1]]
        many = count[own]
        at = np.arange(many.sum()) + np.repeat(starts[own] - (np.cumsum(many) - many), many)
        shared = np.bincount(holders[at], minlength=n.size)
        near = np.flatnonzero((label != label[i]) & (shared * (t.denominator + t.numerator) >= (n + n[i]) * t.numerator))
        if near.size:
            joined, first = np.unique(label[near], return_index=True)
            found += [(i, j) for j in near[first].tolist()]
            label[np.isin(label, joined)] = label[i]
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    return i, j


def _within(t: Fraction):
    """Over rows (part, fp, root, s) sorted by part: links u, v that join the similar sets s of each part; those of one root are joined already."""

    def solve(rows) -> pa.RecordBatch:
        fp, root, sets = (sum(x, []) for x in zip(*rows))
        fp = np.array(fp, np.int64)
        i, j = similar_links(sets, np.unique(root, return_inverse=True)[1], t)
        return batch_of(u=np.maximum(fp[i], fp[j]), v=np.minimum(fp[i], fp[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, last = [], None
        for b in batches:
            parts, fp, root = (b.column(c).to_pylist() for c in range(3))
            cuts = [k for k in range(1, b.num_rows) if parts[k] != parts[k - 1]]
            for x, y in zip([0, *cuts], [*cuts, b.num_rows]) if b.num_rows else ():
                if wait and parts[x] != last:
                    yield solve(wait)
                    wait = []
                # the sets are copied, so that no batch is held for its views
                wait.append((fp[x:y], root[x:y], [np.array(z.values.to_numpy(zero_copy_only=False)) for z in b.column(3).slice(x, y - x)]))
                last = parts[x]
        if wait:
            yield solve(wait)
        give_back()

    return run


def sets_of(fps: DataFrame, keys: DataFrame, texts: DataFrame, size: int, seed: int) -> DataFrame:
    """fp, s: the shingle sets of the distinct ``fps`` (column fp); ``keys`` (fp, key) names a text for each, ``texts`` (key, text) has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingles(x.as_buffer().to_pybytes(), size, seed).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "s"])
        give_back()

    needed = durable(fps.join(keys.select("fp", "key"), "fp"))
    # few keys go to the texts, so that only texts of theirs are shuffled
    found = texts.join(F.broadcast(needed) if size_within(needed, KEYS) else needed, "key").select("fp", "text").dropDuplicates(["fp"])
    return durable(found.mapInArrow(run, "fp long, s array<bigint>"))


def verified(pairs: DataFrame, keys: DataFrame, texts: DataFrame, size: int, seed: int, t: Fraction) -> DataFrame:
    """u, v: the ``pairs`` (u, v) whose texts' shingle sets have Jaccard t or more.

    ``keys`` (fp, key, n, bits) names a text for each node, with its set's size
    and parities, ``texts`` (key, text) has them. A bit in which two bitmaps
    differ stands for at least one element in which the sets do, so pairs beyond
    the difference that t allows go first; only texts of the rest are read again.
    """
    part = lambda c: keys.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    apart = sum(F.bit_count(F.element_at("bu", k + 1).bitwiseXOR(F.element_at("bv", k + 1))) for k in range(PARITY)).cast("long")
    close = apart * (t.denominator + t.numerator) <= (F.col("nu") + F.col("nv")) * (t.denominator - t.numerator)
    pairs = durable(pairs.join(part("u"), "u").join(part("v"), "v").where(close).select("u", "v"))
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), keys, texts, size, seed)
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}"))
    shared = F.size(F.array_intersect("su", "sv")).cast("long") * (t.denominator + t.numerator)
    return pairs.join(side("u"), "u").join(side("v"), "v").where(shared >= (F.size("su") + F.size("sv")).cast("long") * t.numerator).select("u", "v")


def joined_within(groups: DataFrame, roots: DataFrame, keys: DataFrame, texts: DataFrame, size: int, seed: int, t: Fraction, block: int = 4096) -> DataFrame:
    """u, v: links that join the similar sets of each group, where ``groups`` has (node, root) and ``roots`` (node, root) what is joined already.

    All sets of a group are compared, and only the links that join them leave
    the task. Of a group with over ``block`` sets each two blocks meet in a task.
    """
    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = groups.join(blocks, "root").select(F.col("node").alias("fp"), F.col("root").alias("part"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("own"))
    members = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = members.join(sets_of(groups.select(F.col("node").alias("fp")), keys, texts, size, seed), "fp")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(F.struct("part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("part"), "fp", "root", "s")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_within(t), "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, sketches: int = 6, max_bits: int = 16, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """Like ``near_duplicates``, for texts whose shingle sets have a Jaccard of ``similarity`` or more; fp is a hash of the set.

    ``radius`` is that of the SimHash links, and changes no result, as the similarity is verified and the completion exact.
    ``sketches`` and ``max_bits`` are taken for older calls and have no effect.
    """
    t = Fraction(str(similarity))
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    keyed = texts.select(F.xxhash64("text").alias("key"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(keyed, shingle, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, sizes, bits = [], [], [], []
            for x in b.column(2):
                s = shingles(x.as_buffer().to_pybytes(), shingle, seed)
                fps.append(_set_hash(s, seed))
                sims.append(majority(s[k : k + SLICE] for k in range(0, s.size, SLICE)))
                sizes.append(s.size)
                odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (fps, sims, sizes)), pa.array(bits, pa.list_(pa.int64()))], names=["id", "key", "fp", "sim", "n", "bits"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"id {kind}, key long, fp long, sim long, n long, bits array<bigint>")
    rows = durable(rows.withColumnRenamed("id", id_col))
    # texts of one set are one node; any of them stands for it
    keys = durable(rows.groupBy("fp").agg(*[F.min(c).alias(c) for c in ("key", "sim", "n", "bits")]))
    # SimHash: links between the fingerprints of sets, and sets of one fingerprint
    stands = durable(keys.groupBy("sim").agg(F.min("fp").alias("fp")))
    side = lambda c: stands.select(F.col("sim").alias(c), F.col("fp").alias(f"f{c}"))
    linked = links(stands.select(F.col("sim").alias("fp")), radius).distinct().join(side("u"), "u").join(side("v"), "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    equal = keys.select("sim", F.col("fp").alias("u")).join(stands.withColumnRenamed("fp", "v"), "sim").where("u <> v").select("u", "v")
    # the exact completion: sets that share a part
    ranges = max(16, rows.count() // 2_000)
    blocks = texts.select("text").mapInArrow(_signed(sent, shingle, seed, t, ranges), "range long, data binary")
    met = durable(blocks.repartition(ranges, "range").mapInArrow(_meetings, "fp long, s long"))
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(verified(durable(ordered(linked.unionByName(equal))), keys, keyed, shingle, seed, t))
    if not met.isEmpty():
        roots = durable(components(thinned(edges)))
        grouped = met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(keys.select("fp", "n", "bits"), "fp")
        grouped = grouped.select("s", "n", "fp", "root", "bits").repartition("s").sortWithinPartitions("s", "n")
        rest = durable(grouped.mapInArrow(_unjoined(t), "u long, v long"))
        if not rest.isEmpty():
            groups = durable(components(thinned(rest)))
            edges = durable(edges.unionByName(joined_within(groups, roots, keys, keyed, shingle, seed, t)))
    return classes(rows.select(id_col, "fp"), edges, id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies: the one of the smallest id.

    Of rows that repeat that id, one stays. Only the ids that repeat take the shuffle which that needs.
    """
    found = near_copies(docs, id_col, text_col, **options)
    kept = durable(found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")))
    single = docs.join(kept.where("__n = 1 and __id is not null").select("__id"), docs[id_col] == F.col("__id"), "left_semi")
    repeated = kept.where("__n > 1 or __id is null").select("__id")
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(repeated, docs[id_col].eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([id_col]))
