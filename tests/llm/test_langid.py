import numpy as np

from geoengine.llm import langid

EN = "the quick brown fox and the lazy dog were in the thick of things with nothing else to think on"
DE = "der schnelle braune fuchs und der faule hund waren mitten im geschehen und dachten an nichts anderes"
SCHEMA = "doc_id long, text string, lang string, score string"


def brute(text, dims=512, seed=5):
    space = langid.Space(dims, seed)
    letters = space.parts[2].astype(int)
    classes, out = [0], np.zeros(dims)
    for c in text:
        k = int(langid.classes()[ord(c)])
        if k or classes[-1]:
            classes.append(k)
    if classes[-1]:
        classes.append(0)
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def rows():
    out = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de", "x") for i in range(60)]
    return out + [(60, None, "en", ""), (61, "", "en", ""), (62, "12 34 !!", "de", ""), (63, "the thing", None, ""), (None, EN, "en", ""), (64, EN * 3000, "en", ""), (3, out[3][1], "en", "x")]


def test_bundles_equal_brute_force():
    texts = [EN, "Ab  1cé", "É", "x" * 50, DE * 40]
    got = langid.Space(512, 5).bundle([langid.trigrams(t) for t in texts])
    for t, v in zip(texts, got):
        assert np.allclose(v, brute(t))


def test_held_out_accuracy_and_odd_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = langid.identify(df).collect()
    assert len(out) == len(rows())
    by = {r.doc_id: r for r in out}
    for i, _, lang, _ in rows()[:60]:
        assert by[i].lang_pred == lang and 0 < by[i].score <= 1
    assert by[60].lang_pred == by[61].lang_pred == by[62].lang_pred == "und" and by[62].score == 0
    assert by[None].held_out and by[None].lang_pred == "en"
    import zlib

    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert {60, 61, 62}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(rows()) - 3


def test_same_prototypes_for_any_dealing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    a = langid.prototypes(df.repartition(1), F.lit(True))
    b = langid.prototypes(df.repartition(5), F.lit(True))
    assert a.langs == b.langs == ["de", "en"] and (a.unit == b.unit).all() and (a.alike == b.alike).all()


def test_alphabets_do_not_share_classes():
    for alphabet in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "אבגדהוזחטיכלמנסעפצקרשת", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"):
        assert len({int(langid.classes()[ord(c)]) for c in alphabet}) == len(alphabet)
    assert langid.classes()[ord("Ж")] == langid.classes()[ord("ж")] != langid.classes()[ord("é")]


def test_other_scripts_and_ties(spark):
    ru, el = "съешь же ещё этих мягких французских булок да выпей чаю", "ξεσκεπάζω την ψυχοφθόρα βδελυγμία με πολλή χαρά και τόλμη"
    data = [(i, " ".join(np.random.default_rng(i).permutation((ru if i % 2 else el).split())), "ru" if i % 2 else "el", "") for i in range(40)]
    out = langid.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r.lang_pred == data[r.doc_id][2] for r in out)
    # two languages of the same texts tie; the smaller name wins
    same = [(i, EN, "xb" if i % 2 else "xa", "") for i in range(1, 9) for _ in range(2)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(same, SCHEMA)
    got = langid.predict(df, langid.prototypes(df, F.lit(True))).collect()
    assert {r.lang_pred for r in got} == {"xa"}


def test_expected_cosine_grows_with_length(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows()[:60], SCHEMA)
    model = langid.prototypes(df, F.lit(True))
    texts = spark.createDataFrame([(n, EN[: 4 * n], "", "") for n in range(1, 20)], SCHEMA)
    got = sorted(langid.predict(texts, model).collect(), key=lambda r: r.trigrams)
    assert all(a.expected < b.expected for a, b in zip(got, got[1:]))
    assert all(r.score >= 0.35 * r.expected - 2 / langid.DIMS**0.5 for r in got)


def test_short_and_long_texts_of_no_language_are_judged_alike(spark):
    rng = np.random.default_rng(0)
    noise = lambda n: " ".join("".join(rng.choice(list("qxzwjkv"), 6)) for _ in range(n))
    junk = [(1000 + n, noise(n), None, "") for n in (25, 40, 80, 200, 2000)]
    plain = [(2000 + n, " ".join(EN.split()[:n]), None, "") for n in (1, 2, 3, 5, 8, 13)]
    df = spark.createDataFrame(rows()[:60] + junk + plain, SCHEMA)
    kept = {r.doc_id for r in langid.keep_known(df).collect()}
    assert kept == {r[0] for r in rows()[:60] + plain}


def test_nothing_learned_and_empty(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    got = langid.identify(spark.createDataFrame([(1, EN, None, "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
