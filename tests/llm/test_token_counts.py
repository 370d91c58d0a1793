import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitegrid.llm import token_counts
from sitegrid.llm.queries import WORD_BPE, queries
from tests.llm.brute import EDGE_TEXTS

PATH = public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries()["op8_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_edges(spark, library):
    rows = [(i, t, i, "x") for i, t in enumerate(EDGE_TEXTS)] + [(4, "word", 0, None), (None, "word", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, word string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PATH).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        assert got[i] == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)
    assert got[None] == 1
    assert token_counts.token_counts(df, PATH).count() == len(rows)
    assert token_counts.token_counts(df.limit(0), PATH).collect() == []


def test_the_table_only_saves_time(spark, library):
    df = spark.createDataFrame([(i, f"word{i} the the cat's {i}") for i in range(300)], "doc_id long, text string")
    one = sorted(token_counts.token_counts(df, PATH, entries=1, each=1).collect())
    assert one == sorted(token_counts.token_counts(df, PATH).collect())


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=40) | st.text(alphabet="abT' \n\t İ²3é<|endoftx>́", max_size=60))
def test_any_text(library, text):
    c = token_counts.load(PATH)
    assert c.count(text) == len(library.encode(text, add_special_tokens=False).ids)
