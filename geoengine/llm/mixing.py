"""Mixing sources to target weights, in DataFrame and SQL functions only.

Targets. A source's target is its weight's share of all words, and at most
``cap`` times the source's own size; what a capped source leaves is shared by
weight among the others until none is above. That is min(cap * size, level *
weight) for the one level at which the targets sum to the total, which running
sums over the sources ordered by cap * size / weight give directly.

Draws. A source's documents are hashed into 2^k blocks of about ``block_docs``
documents. The ratio target / size says how often the source is taken: its
whole number of times every block (an epoch each), and for the rest the first
blocks of a keyed permutation of the block numbers, which needs no sort: the
permutation is arithmetic on k bits. The last block is filled to the word by
documents in order of falling size, each taken if it still fits; the room that
it leaves goes on to the next ``CARRY`` blocks in the same way. Prefix sums
over groups of 1024 blocks, then over the blocks of one group, find that block,
so no window sees more than 1024 rows a source for 2^20 blocks.

Shards. The exact numbers of blocks drawn from each source are split among the
output shards by a binary tree: at each node the left child's blocks are a
multivariate hypergeometric draw from the node's, source by source, by
inversion of the univariate distribution around its mode. A block drawn in
some epoch has a rank among its source's draws; the shard whose interval of the
source's counts holds the rank gets it. Every draw thus lands in one shard, the
shards' draws are disjoint, and each shard has its exact quota. Within a shard
the rows are shuffled locally by a keyed hash.

All choices are functions of the seed, source, doc_id and size: reruns agree,
and a recomputed task makes the same rows.

Ids may be of any type; they count by their hash. Nulls: a null text has size 0;
null sources are one source, the last; rows of null doc_id are hashed by their
text, so they spread over the blocks too. Repeated rows share a block and are
all taken or all left. Documents of size 0 are taken in the whole epochs only, and count
nothing. A source of size 0 has target 0. An empty table gives an empty result.
Input columns keep their names in ``mix``; helper columns start with ``__m_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.llm.common import WORD, size_within
from geoengine.session import durable

#: Source tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000
GROUP_BITS = 10
#: Blocks after the partly taken one that may fill what room it leaves.
CARRY = 3
#: Words of one output partition of ``mix``, about 64 MB of text.
PARTITION_WORDS = 8_000_000


def words(text_col: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str, seed: int) -> Column:
    """What a row is dealt by: the hash of its id, or of its text if it has none."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if its number of rows is within the bound."""
    return F.broadcast(df) if size_within(df, BROADCAST_SOURCES) else df


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size and more columns -> the same with target (double).

    Sources are ordered by code point, null last; weights repeat in that order.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    limit = F.lit(float(cap)) * F.col("source_size")
    by_ratio = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level if the sources before this one are capped and this one is not
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= limit)
    # the first source that stays free sets the level; none is free only if all are at their cap
    chosen = F.min(F.when(F.col("free"), F.struct(limit / F.col("weight"), F.col("level"))))
    return levels.withColumn("level", chosen.over(everything)["level"]).withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), limit), limit)).drop("level", "free")


def _permuted(block: Column, bits: Column, key: Column) -> Column:
    """A keyed bijection of the numbers below 2^bits (bits at most 24): odd multiples and right-shift xors."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    half = F.greatest(F.lit(1), F.ceil(bits / 2).cast("int"))
    x = block
    for i in range(3):
        odd = F.pmod(F.shiftright(key, 7 * i), F.lit(1 << 20)).bitwiseOR(F.lit(1).cast("long"))
        add = F.pmod(F.shiftright(key, 5 * i + 3), F.lit(1 << 20))
        x = (x * odd + add).bitwiseAND(mask)
        x = x.bitwiseXOR(F.call_function("shiftright", x, half))
    return x


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _lgamma(value: Column) -> Column:
    """Log gamma for a value >= 1 (Stirling's series, shifted up by 8)."""

    def series(x: Column) -> Column:
        shift = x
        for i in range(1, 8):
            shift = shift * (x + i)
        large = let(x + 8, lambda y: (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y))
        # the product of the eight factors leaves a double's range above 10^38 only
        return large - F.ln(shift)

    return let(value, series)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls are marked, of ``total`` balls with ``marked`` marked ones: the value whose cumulative probability first exceeds u.

    The walk covers 14 standard deviations on both sides of the mean; beyond lies less than a double's precision.
    """
    choose = lambda a, b: _lgamma(a + 1) - _lgamma(b + 1) - _lgamma(a - b + 1)

    def spread(b: Column) -> Column:
        n, k, m = b["n"], b["k"], b["m"]
        share = k / F.greatest(n, F.lit(1.0))
        return F.struct(n.alias("n"), k.alias("k"), m.alias("m"), b["u"].alias("u"), (m * share).alias("mean"), (14 * F.sqrt(m * share * (1 - share) + 1) + 2).alias("reach"))

    def ends(b: Column) -> Column:
        n, k, m = b["n"], b["k"], b["m"]
        low = F.greatest(F.lit(0.0), m + k - n, F.floor(b["mean"] - b["reach"]).cast("double"))
        high = F.least(m, k, F.ceil(b["mean"] + b["reach"]).cast("double"))
        return F.struct(n.alias("n"), k.alias("k"), m.alias("m"), b["u"].alias("u"), low.alias("low"), high.alias("high"))

    def walk(b: Column) -> Column:
        n, k, m, low, high = (b[c] for c in ("n", "k", "m", "low", "high"))
        first = F.exp(choose(k, low) + choose(n - k, m - low) - choose(n, m))
        start = let(first, lambda p: F.struct(p.alias("p"), p.alias("c"), low.alias("x")))

        def step(s: Column, x: Column) -> Column:
            p = s["p"] * (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))
            return let(p, lambda q: F.struct(q.alias("p"), (s["c"] + q).alias("c"), F.when(s["c"] <= b["u"], x).otherwise(s["x"]).alias("x")))

        steps = F.when(high > low, F.transform(F.sequence((low + 1).cast("long"), high.cast("long")), lambda v: v.cast("double"))).otherwise(F.array().cast("array<double>"))
        return F.aggregate(steps, start, step, lambda s: s["x"]).cast("long")

    given = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("m"), u.alias("u"))
    return let(let(let(given, spread), ends), walk)


def shard_counts(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """k (a dense source number), draws -> k, ends: for each source the running ends of its counts in the 2^depth shards.

    One row holds a tree node's quotas of all sources; a level splits every node in two.
    """
    whole = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "draws"))), lambda s: s["draws"]).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(depth):
        size = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.col("size").alias("n"), F.floor(F.col("size") / 2).alias("m"), F.array().cast("array<bigint>").alias("out"))

        def split(s: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), F.size(s["out"])), F.lit(1 << 52)) / float(1 << 52)
            take = lambda got: F.struct((s["n"] - x).alias("n"), (s["m"] - got).alias("m"), F.array_append(s["out"], got).alias("out"))
            return let(_hypergeometric(s["n"], x, s["m"], u), take)

        halves = whole.withColumn("size", size).withColumn("left", F.aggregate("q", start, split, lambda s: s["out"]))
        # written at each level, so that the next does not compute this one again for each use
        whole = durable(halves.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))).alias("s")).select("s.node", "s.q"))
    flat = whole.select("node", F.posexplode("q").alias("k", "n"))
    run = lambda s: F.aggregate(s, F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x["n"]))
    return flat.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("s")).select("k", run(F.col("s")).alias("ends"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, block_docs: int = 128, shards: int = 16) -> tuple[DataFrame, DataFrame]:
    """(sources, filled): what decides which documents are drawn, both small.

    sources: a row a source with its size, target, blocks and the shard ends.
    filled: the documents taken from each source's last blocks, which are not taken whole.
    """
    sized = durable(docs.select(F.col(source_col).alias("source"), row_key(id_col, text_col, seed).alias("h"), words(text_col).alias("size")))
    counted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = durable(
        counted.select(
            "source", "source_size", "target", "n",
            # a target a rounding error short of the cap is the cap
            F.floor(ratio + 1e-9).cast("long").alias("epochs"),
            F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(block_docs))))).cast("int").alias("bits"),
            F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("key"),
        ).withColumn("want", F.greatest(F.lit(0).cast("long"), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    )
    placed = _placed(sized, small(base), seed)
    blocks = placed.groupBy("source", "rank").agg(F.sum("size").alias("w"))
    blocks = durable(blocks.withColumn("part", F.shiftright("rank", GROUP_BITS)))
    ahead = lambda *order: Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = base.select("source", "want")
    by_source = lambda a, b: a.join(small(b.withColumnRenamed("source", "__s")), a["source"].eqNullSafe(F.col("__s"))).drop("__s")
    parts = blocks.groupBy("source", "part").agg(F.sum("w").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(ahead("part")), F.lit(0).cast("long")))
    edge = by_source(parts, want).where("before <= want").groupBy("source").agg(F.max_by(F.struct("part", "before", "want"), "part").alias("e")).select("source", "e.*")
    inside = by_source(blocks, edge.withColumnRenamed("part", "edge_part")).where("part = edge_part")
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("w").over(ahead("rank")), F.lit(0).cast("long")))
    last = inside.where("start <= want").groupBy("source").agg(F.max_by(F.struct("rank", "start"), "rank").alias("e")).select("source", F.col("e.rank").alias("full"), F.col("e.start").alias("start"))
    sources = by_source(base, last)
    # the blocks not taken whole: documents by falling size, each taken if all its repeats still fit
    late = F.col("rank").between(F.col("full"), F.col("full") + CARRY)
    rest = placed.join(small(last.withColumnRenamed("source", "__s")), placed["source"].eqNullSafe(F.col("__s")) & late).drop("__s")
    rest = by_source(rest.select("source", (F.col("full") - F.col("rank")).alias("later"), "h", "size", "start"), want).where("size > 0").groupBy("source", "want", "start", "later", "h", "size").agg(F.count("*").alias("n"))
    room = F.struct((F.col("want") - F.col("start")).alias("room"), F.array().cast("array<struct<h:bigint,size:bigint>>").alias("out"))
    listed = F.sort_array(F.collect_list(F.struct("later", (F.col("size") * F.col("n")).alias("w"), F.xxhash64(F.lit(seed + 1), "h").alias("o"), "h", "size")), asc=False)

    def fit(s: Column, d: Column) -> Column:
        takes = d["w"] <= s["room"]
        return F.struct(F.when(takes, s["room"] - d["w"]).otherwise(s["room"]).alias("room"), F.when(takes, F.array_append(s["out"], F.struct(d["h"].alias("h"), d["size"].alias("size")))).otherwise(s["out"]).alias("out"))

    filled = rest.groupBy("source", "want", "start").agg(listed.alias("d")).select("source", F.explode(F.aggregate("d", room, fit, lambda s: s["out"])).alias("d")).select("source", "d.h", "d.size")
    # draws: whole blocks, those of the last ones included
    depth = max(0, (shards - 1).bit_length())
    numbered = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    blocks_of = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    numbered = durable(numbered.withColumn("draws", F.col("epochs") * blocks_of + F.least(F.col("full") + 1 + CARRY, F.greatest(F.col("full") + 1, blocks_of))))
    split = shard_counts(numbered.select("k", "draws"), depth, seed)
    return durable(numbered.join(split, "k").drop("k")), durable(filled)


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows of (source, h, size) with their source's columns and the rank of their block."""
    columns = sources.withColumnRenamed("source", "__s")
    joined = sized.join(columns, sized["source"].eqNullSafe(F.col("__s"))).drop("__s")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    block = F.col("h").bitwiseAND(mask)
    return joined.withColumn("rank", _permuted(block, F.col("bits"), F.col("key")))


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """``docs`` with __m_size, __m_source_size, __m_target, __m_key and __m_shards: the shard of each of the document's draws, one entry for each time it is taken."""
    return _drawn(docs, *plan(docs, id_col, text_col, source_col, seed=seed, **options), id_col, text_col, source_col, seed)


def _drawn(docs: DataFrame, sources: DataFrame, filled: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__m_row"), F.col(source_col).alias("source"), row_key(id_col, text_col, seed).alias("h"), words(text_col).alias("size"))
    placed = _placed(rows, small(sources), seed)
    extra = small(filled.select(F.col("source").alias("__fs"), F.col("h").alias("__fh"), F.col("size").alias("__fz"), F.lit(True).alias("__fits")))
    placed = placed.join(extra, placed["source"].eqNullSafe(F.col("__fs")) & (placed["h"] == F.col("__fh")) & (placed["size"] == F.col("__fz")), "left")
    taken = F.col("epochs") + F.when((F.col("rank") < F.col("full")) | F.col("__fits"), 1).otherwise(0)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    shard = lambda e: F.size(F.filter("ends", lambda end: end <= e * size + F.col("rank")))
    shards = F.when(taken > 0, F.transform(F.sequence(F.lit(0).cast("long"), taken.cast("long") - 1), shard)).otherwise(F.array().cast("array<int>"))
    return placed.select("__m_row.*", F.col("size").alias("__m_size"), F.col("source_size").alias("__m_source_size"), F.col("target").alias("__m_target"), shards.alias("__m_shards"), F.col("h").alias("__m_key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shards: int = 16, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``: each document as often as it is drawn, dealt to its shards and shuffled in each.

    A shard is cut by a keyed hash into as many parts as its words ask for, so
    partitions hold about ``PARTITION_WORDS`` words at any size of the input.
    """
    sources, filled = plan(docs, id_col, text_col, source_col, seed=seed, shards=shards, **options)
    drawn = _drawn(docs, sources, filled, id_col, text_col, source_col, seed)
    # the targets sum to the sizes of all sources
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(sources.agg(F.sum("source_size")).first()[0] or 0) // PARTITION_WORDS))
    rows = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode("__m_shards").alias("__m_epoch", "__m_shard"), F.col("__m_key"))
    order = F.xxhash64(F.lit(seed + 2), F.col("__m_key"), F.col("__m_epoch"))
    # many more keys than partitions, so that hashing the keys fills partitions alike
    rows = rows.repartition(parts, "__m_shard", F.pmod(order, F.lit(max(16, 64 * parts // shards))))
    return rows.sortWithinPartitions("__m_shard", order).drop("__m_epoch", "__m_shard", "__m_key")
