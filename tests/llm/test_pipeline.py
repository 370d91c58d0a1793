"""The stages of the corpus pipeline: odd rows, an empty table, other columns, and the whole run."""

import pytest

import corpus_pipeline
from sitegrid.llm.common import clean, materialize
from tests.conftest import DATA
from tests.llm import brute

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string"
A = "the quick brown fox jumps over the lazy dog and runs far away from here"
B = "completely other words stand in this text which nobody has ever seen before today"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y") for i, t, s in texts], SHAPE)


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    some = [(1, A, "s"), (5, A, "s"), (5, B, "s"), (7, B + " z", "s"), (7, B + " z", "s")]
    out = corpus_pipeline.keep_first(spark, rows(spark, some), str(DATA)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, A), (5, B)]


def test_rows_without_ids_or_words_stay(spark):
    some = [(None, A, "s"), (None, A, "s"), (1, None, "s"), (2, "", None), (3, " \n", "s"), (4, A, "s"), (9, A, "s")]
    out = corpus_pipeline.keep_first(spark, rows(spark, some), str(DATA)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in out) == [(0, A), (0, A), (1, ""), (2, ""), (3, " \n"), (4, A)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows_and_empty_tables(spark, name, stage):
    some = [(1, None, None), (2, "", "s"), (3, A, "s"), (3, A, "s"), (None, B, "t"), (4, "word " * 20_000, "t")]
    out = stage(spark, rows(spark, some), str(DATA))
    assert len(out.collect()) <= 3 * len(some)
    if name != "bpe":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    assert stage(spark, rows(spark, some).limit(0), str(DATA)).collect() == []


def test_the_whole_run(spark):
    """Stage by stage on what the stage before kept: near-duplicates against brute force, the last against the one before."""
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = materialize(stage(spark, docs, str(DATA)), name)
    before = [(r.doc_id, r.text) for r in kept["line_dedup"].collect()]
    after = {r.doc_id for r in kept["near_duplicates"].collect()}
    assert after == {i for i, (_, _, first) in brute.near_duplicates(before, 5).items() if first}
    assert kept["bpe"].count() == kept["mixing"].count()
    run = corpus_pipeline.run(spark, str(DATA))
    assert sorted(map(repr, run.collect())) == sorted(map(repr, kept["bpe"].collect()))
    clean(spark)
