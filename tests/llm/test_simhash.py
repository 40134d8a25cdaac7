import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from geoengine.llm import simhash


@pytest.fixture
def tiny_batches(spark):
    """Batches of a few rows, so that buckets run over batches and reach the limit."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius=4):
    """component_id by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [plain(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    return sorted([(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got], key=str)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(list(range(64)), 4, 7)
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << p for p in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in masks)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(400) for _ in range(300)]
    rows = [(i, " ".join("w%d" % rng.randrange(400) for _ in range(rng.choice([0, 1, 3, 4, 60])))) for i in range(40)]
    for i in range(40, 90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = "x"
        rows.append((i, " ".join(words)))
    rows += [(90, None), (91, ""), (92, " \t\n"), (None, " ".join(base)), (93, "É A b\x85c d"), (5, rows[5][1]), (94, rows[60][1]), (None, "alone here now yes ok")]
    assert result(spark, rows) == classes(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_very_long_text():
    text = " ".join(str(i % 977) for i in range(90_000))
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == plain(text)


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_second_family_finds_the_same_classes(spark, limit, tiny_batches):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, bucket_limit=limit)).collect()}
    want = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert got == want
    for a in signed:
        for b in signed:
            if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert got[a] == got[b]


def test_forest_joins_exactly_the_linked():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    members = np.unique(np.array([base ^ np.uint64(1 << int(p)) ^ np.uint64(1 << int(q)) for p, q in rng.integers(0, 63, (60, 2))]))
    pairs = simhash.forest(members, members, 4, 64)
    assert sum(p[0].size for p in pairs) == members.size - 1


def test_keep_one_leaves_clean_documents(spark):
    text = " ".join("word%d" % i for i in range(80))
    rows = [(1, text, "a"), (2, text + " more", "b"), (3, "quite another text with words of its own", "c"), (1, text, "a"), (4, None, "d"), (None, "a text without an id that stays", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(simhash.keep_one(df).collect(), key=str)
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "None"]
    assert simhash.keep_one(df).columns == df.columns


def test_clashing_columns_and_batches(spark):
    df = spark.createDataFrame([(1, "a b c d e", "u", 5)], "doc_id long, text string, fp string, component_id int")
    assert [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "component_id").collect()] == [(1, 1)]


def test_runs_that_cross_batches():
    masks = np.array(simhash.covering_masks(list(range(64)), 4, 1), np.uint64)
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 62, 500, dtype=np.int64)
    fps = np.unique(np.r_[fps, fps ^ 1, fps ^ 6])
    rows = sorted((t, int(f) & int(m), int(f)) for t, m in enumerate(masks) for f in fps)
    t, f = np.array([r[0] for r in rows], np.int32), np.array([r[2] for r in rows], np.int64)

    def edges(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(t[i : i + size]), *[pa.array(f[i : i + size])] * 2], names=["t", "s", "fp"]) for i in range(0, t.size, size)]
        return sorted((u, v) for b in simhash._links(masks, 4, 64, None)(iter(batches)) for u, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))

    assert edges(7) == edges(10**6) and len(edges(7)) >= 1000


def test_near_copies_with_changed_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows, base = [], {}
    for g in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(90, 400))]
        for c in range(5):
            copy = list(text)
            for _ in range(len(text) // 60 if c else 0):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((g * 10 + c, " ".join(copy)))
            base[g * 10 + c] = g * 10
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert all(got[i] == i for i in got if i >= 1000)
    assert sum(got[i] == base[i] for i in base) >= 0.97 * len(base)
    small = {r.doc_id: r.component_id for r in simhash.near_copies(df, sketches=6).collect()}
    assert small == got


@pytest.mark.parametrize("limit", [2, 1 << 15])
def test_sketch_links_against_all_pairs(spark, limit, tiny_batches):
    rng = random.Random(4)
    centre, own = rng.getrandbits(64), rng.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << p for p in rng.sample(range(64), n))
    nodes = {flip(own, rng.randint(0, 9)): [flip(centre, rng.randint(0, 4)) for _ in range(2)] for _ in range(60)}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(f), [sign(x) for x in s]) for f, s in nodes.items()], "fp long, s array<bigint>")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, bucket_limit=limit, sketches=2, max_bits=9)).collect()}
    keys, parent = list(nodes), {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 9 and any((x ^ y).bit_count() <= 4 for x, y in zip(nodes[a], nodes[b])):
                parent[root(a)] = root(b)
    for a in keys:
        for b in keys:
            if a != b and sign(a) in got and sign(b) in got:
                assert (root(a) == root(b)) == (got[sign(a)] == got[sign(b)])


def test_thinned_edges_join_the_same(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60)] * 3
    df = spark.createDataFrame(rows, "u long, v long").repartition(5)
    want = {r.node: r.root for r in simhash.components(df).collect()}
    thin = simhash.thinned(df, 20)
    assert thin.count() < len(rows)
    assert {r.node: r.root for r in simhash.components(thin).collect()} == want
    assert simhash.components(simhash.thinned(df.where("false"))).count() == 0


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_classes(rows):
    """Component ids by Jaccard of 0.8 or more over all pairs."""
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_copies_are_verified_against_all_pairs(spark, tiny_batches):
    rng = random.Random(11)
    words = ["w%d" % min(int(rng.paretovariate(0.7)), 3000) for _ in range(20_000)]
    line = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for g in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))] + line.split()
        for c in range(6):
            copy = list(text)
            # few to many words change, so similarities lie on both sides of 0.8
            for _ in range(round(len(text) * c * 0.012)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b", "A  b", "", None, "a b c d e", "a b c d e f"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = similar_classes(rows)
    assert 40 < len(set(want.values())) < len(rows) - 10
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == want


def test_near_copies_find_appended_truncated_and_replaced_passages(spark):
    rng = random.Random(12)
    words = ["w%d" % min(int(rng.paretovariate(0.9)), 20_000) for _ in range(40_000)]
    rows = []
    for size in (120, 300, 1000):
        for g in range(36):
            text, more = ([rng.choice(words) for _ in range(n)] for n in (size, size // 5))
            at, tenth = rng.randrange(size // 2), size // 10
            copy = [text + more, text[: size - size // 6], text[:at] + more[: tenth - 4] + text[at + tenth - 4 :]][g % 3]
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    want, sets = similar_classes(rows), sets_of(rows)
    close = [i for i in range(0, len(rows), 2) if jaccard(sets[i], sets[i + 1]) >= 0.8]
    assert len(close) > 90
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert all(got[i] == got[i + 1] for i in close)
    assert got == want


@pytest.mark.parametrize("similarity", ["0.8", "0.5"])
def test_similar_sets_share_a_signature(similarity):
    from fractions import Fraction

    t, rng = Fraction(similarity), np.random.default_rng(5)
    common = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    counts = rng.integers(3, 50, common.size)
    met = 0
    for k in range(3000):
        n = int(rng.choice([2, 4, 5, 9, 16, 17, 33, 64, 130, 260]))
        own = rng.integers(1 << 63, (1 << 64) - 1, n, dtype=np.uint64)
        often = rng.random(n) < rng.choice([0, 0.2, 0.9, 1])
        a = np.unique(np.where(often, rng.choice(common, n), own))
        # elements go and others come, as many as the similarity allows
        gone = rng.integers(0, a.size + 1) * float(rng.random())
        b = rng.permutation(a)[int(gone * 0.3) :]
        b = np.unique(np.r_[b, rng.integers(1 << 63, (1 << 64) - 1, rng.integers(0, 1 + a.size // 4), dtype=np.uint64)])
        shared = np.intersect1d(a, b).size
        if shared * t.denominator < (a.size + b.size - shared) * t.numerator:
            continue
        met += 1
        x, y = (simhash.signatures(s, common, counts, t) for s in (a, b))
        assert np.intersect1d(x, y).size, (k, a.size, b.size, shared)
    assert met > 800


def test_simhash_alone_links_close_copies(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for g in range(12):
        text = ["w%d" % rng.randrange(5000) for _ in range(1500)]
        for c in range(3):
            copy = list(text)
            if c:
                copy[rng.randrange(1500)] = "changed"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def nothing(batches):
        for _ in batches:
            pass
        return iter(())

    monkeypatch.setattr(simhash, "_meetings", nothing)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert sum(got[i] == i - i % 3 for i in got) >= 0.9 * len(rows)
    none = {r.doc_id: r.component_id for r in simhash.near_copies(df, radius=0).collect()}
    assert sum(none[i] == i for i in none) > sum(got[i] == i for i in got)


def test_pairs_to_verify_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(22)
    base = ["w%d" % rng.randrange(5000) for _ in range(150)]
    rows = []
    for i in range(240):
        copy = list(base)
        # most pairs are below 0.8, all above 0.4
        for p in rng.sample(range(150), 4 + i % 3):
            copy[p] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(copy)))
    asked, verified = [], simhash.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert got == similar_classes(rows)
    assert sum(asked) < 240 * 20


def test_unjoined_members_leave_a_bucket_as_links_not_pairs():
    from fractions import Fraction

    m, rng = 300, np.random.default_rng(7)
    fp, bits = np.sort(rng.integers(-(1 << 62), 1 << 62, m)), np.zeros((m, simhash.PARITY), np.int64)
    # two halves that cannot be similar; each has members of three roots
    bits[m // 2 :] = -1
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int64)), pa.array(np.full(m, 100)), pa.array(fp), pa.array(np.arange(m) % 3), pa.array(bits.tolist(), pa.list_(pa.int64()))], names=["s", "n", "fp", "root", "bits"])
    batches = [rows.slice(k, 70) for k in range(0, m, 70)]
    found = [p for b in simhash._unjoined(Fraction("0.8"))(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(found) < m
    low, high = set(fp[: m // 2].tolist()), set(fp[m // 2 :].tolist())
    for half in (low, high):
        reached, links = {min(half)}, [p for p in found if p[0] in half]
        for _ in half:
            reached |= {x for p in links if reached & set(p) for x in p}
        assert reached == half


@pytest.mark.parametrize("similarity", ["0.8", "0.5"])
def test_links_within_a_group_join_the_similar_sets(similarity):
    from fractions import Fraction

    t, rng = Fraction(similarity), np.random.default_rng(13)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 60)
        sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(40, 61)], rng.integers(0, 1 << 62, rng.integers(0, 12))]) for _ in range(30)]
        label = rng.integers(0, 25, 30)
        i, j = simhash.similar_links(sets, label, t)
        assert i.size < np.unique(label).size

        def classes_of(pairs, own=label):
            own = own.copy()
            for x, y in pairs:
                own[own == max(own[x], own[y])] = min(own[x], own[y])
            return own.tolist()

        near = lambda x, y: np.intersect1d(x, y).size * t.denominator >= np.union1d(x, y).size * t.numerator
        assert all(near(sets[x], sets[y]) for x, y in zip(i, j))
        assert classes_of(zip(i, j)) == classes_of([(x, y) for x in range(30) for y in range(x) if near(sets[x], sets[y])])


def test_long_texts_that_parities_cannot_tell_apart_are_not_paired(spark, monkeypatch):
    import functools

    rng = random.Random(31)
    base, rows = ["w%d" % i for i in range(3000)], []
    for i in range(60):
        copy = list(base)
        # of each three texts two are similar; all share parts, and their bitmaps are full
        spots = rng.sample(range(3000), 70) if i % 3 != 1 else spots + rng.sample(range(3000), 20)
        for p in spots:
            copy[p] = "x%d" % (p * 100 + i // 3 * 3 + (i % 3 == 2))
        rows.append((i, " ".join(copy)))
    asked, verified = [], simhash.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    monkeypatch.setattr(simhash, "joined_within", functools.partial(simhash.joined_within, block=9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = similar_classes(rows)
    assert 20 < len(set(want.values())) < 60
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == want
    assert sum(asked) < 60 * 8
