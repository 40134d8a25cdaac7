import os
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages_one_by_one(spark, tmp_path):
    from geoengine.llm import langid, mixing, pieces, simhash, toxicity
    from geoengine.session import table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept[name] = before, docs
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    model = toxicity.fit(before, table(spark, SF, "labels"))
    clean = [r.doc_id for r in before.collect() if model.probability(__import__("math").log1p(model.passages((r.text or "").encode())[1])) < 0.5]
    assert ids(after) == sorted(clean) and 0 < len(clean) < before.count()
    before, after = kept["language_id"]
    known = {r.doc_id for r in langid.identify(before).collect() if r.lang_pred != "und"}
    assert set(ids(after)) <= known and len(ids(after)) > 0.95 * before.count()
    before, after = kept["simhash_near_dedup"]
    assert ids(after) == sorted({r.component_id for r in simhash.near_copies(before).collect()})
    texts = [r.text for r in after.collect()]
    assert len(set(texts)) == len(texts)
    before, after = kept["mix_sources"]
    want = {r.doc_id: len(r["__m_shards"]) for r in mixing.draws(before).collect()}
    assert Counter(ids(after)) == Counter({i: n for i, n in want.items() if n})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    model = pieces.load(pieces.MODEL)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(last) == docs.count() and all(r.lossless and r.n_pieces == len(r.pieces) for r in last)
    import numpy as np

    assert all(model.decode(np.array(r.pieces, np.int64)).decode() == text[r.doc_id] for r in last)


def test_run_agrees_with_itself(spark):
    a = corpus_pipeline.run(spark, SF).select("doc_id", "n_pieces").collect()
    b = corpus_pipeline.run(spark, SF).select("doc_id", "n_pieces").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, rows):
    text = "the thing and the other thing were there and then some more of the same words came along with it"
    odd = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " again", "en", None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (None, text.upper(), "de", "b", 1), (5, "12 34", "en", "c", 1), (6, "word " * 30_000, "en", "c", 1), (None, None, None, None, None)]
    spark.createDataFrame(odd if rows == "odd" else [], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels if rows == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert out.collect() is not None
        if rows == "none":
            assert out.count() == 0
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.lossless for r in last)
