"""The pipeline's stages against plain versions on a small table."""

import collections

import corpus_pipeline as pipeline
import numpy as np
import pytest

from palimpsest.llm import simhash
from palimpsest.llm.common import read

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = read(spark, DIR, "documents")
    out = [docs.cache()]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], DIR).cache())
    return out


def test_stages_keep_the_columns_and_rows_of_documents(steps):
    for before, after in zip(steps[:3], steps[1:4]):
        assert after.columns == before.columns and after.exceptAll(before).count() == 0
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "packing"]


def test_clean_documents_are_kept(spark, steps):
    good = {r.doc_id for r in read(spark, DIR, "labels").where("quality = 1").collect()}
    for before, after in zip(steps[:2], steps[1:3]):
        had, has = ({r.doc_id for r in df.select("doc_id").collect()} for df in (before, after))
        assert len((had - has) & good) <= 0.02 * len(good)


def test_near_copies_against_all_pairs(steps):
    rows = {r.doc_id: simhash.shingles(r.text) for r in steps[2].collect()}
    text = {r.doc_id: r.text for r in steps[2].collect()}
    ids = sorted(rows)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if text[a] == text[b] or simhash.similarity(rows[a], rows[b]) >= 0.8:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    assert {r.doc_id for r in steps[3].collect()} == {find(i) for i in ids}


def test_packing_takes_all_that_is_left(spark, steps):
    kept = {r.doc_id for r in steps[3].collect()}
    packed = collections.Counter()
    total = {}
    for r in steps[4].collect():
        packed[r.doc_id] += r.length
        total[r.doc_id] = r.doc_tokens
    assert set(packed) == kept and packed == collections.Counter(total)
    assert np.sum([r.padding for r in steps[4].collect()]) == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, a long text, an extra column whose name clashes; then no rows at all."""
    rows = [(i, f"the calm sea and the hills number {i} lie in the evening light of day {i}", "en", "s", 60) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (101, "", "en", None, 0), (None, "the calm sea by the hills " * 3, "en", "s", None), (102, "the sea " * 40_000, "en", "s", 9)]
    odd = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", quality_score string")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for (name, stage), column in zip(pipeline.STAGES[:3], ("lang_pred", "quality_keep", "_key")):
            given = docs.withColumnRenamed("quality_score", column)
            out = stage(spark, given, str(tmp_path))
            left = out.collect()
            assert out.columns == given.columns and len(left) <= given.count()
            if name == "language_id" and left:
                # known language stays, texts without a letter go
                assert {r.doc_id for r in left} == {r[0] for r in rows if r[1]}
            if name == "quality_classifier":
                assert len(left) == given.count()  # one label teaches nothing, so nothing goes
        packed = pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
