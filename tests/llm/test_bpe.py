import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitegrid.llm import bpe
from sitegrid.llm.queries import BYTE_BPE, queries, round_trip
from tests.llm.brute import EDGE_TEXTS, sha

PATH = public_tokenizers.path(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries()["op1_bpe_round_trip"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])


def test_edges(spark, library):
    """Nulls, empty and long texts, special strings, repeated rows, a null id, clashing extra columns."""
    rows = [(i, t, i, "x") for i, t in enumerate(EDGE_TEXTS)] + [(4, "word", 0, None), (None, "word", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, label string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(df).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        assert got[i] == expected(library, t), repr(t)
    assert got[None] == expected(library, "word")
    assert round_trip(df).count() == len(rows)
    assert round_trip(df.limit(0)).collect() == []


def test_a_very_long_text(library):
    a = bpe.load(PATH)
    text = "lorem ipsum " * 30_000 + "x" * 30_000
    assert a.encode_text(text).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=40) | st.text(alphabet="abt' \n\t İ²3é<|endoftx>", max_size=60))
def test_any_text(library, text):
    a = bpe.load(PATH)
    ids = a.encode_text(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert a.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoding_broken_bytes(library):
    a = bpe.load(PATH)
    for ids in ([168], [168, 250], [50256, 127], [*range(256)]):
        assert a.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_one_transition_a_byte(library):
    """The byte automaton is deterministic: it reads each byte once, filled or not, and what is kept doesn't change a path."""
    a = bpe.load(PATH)
    for word in ("unbelievably", "xqzkjv" * 40, "aaaaaaaaaaaaab", "çéñ日本"):
        for _ in range(2):
            taken, state = 0, 0
            for c in word.encode():
                state = a.steps.get(state << 8 | c) or a.step(state, c)
                taken += 1
            assert taken == len(word.encode()) and a.ends[state] == a.encode(word.encode())[-1]
        got = a.encode(word.encode())
        a._reset()
        assert a.encode(word.encode()) == got


def test_one_pass_as_two(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*EDGE_TEXTS, "again", "again"])], "doc_id long, text string")
    two, one = bpe.decode(bpe.encode(df, path), path), bpe.round_trip(df, path)
    assert two.schema == one.schema and sorted(map(repr, two.collect())) == sorted(map(repr, one.collect()))
    assert bpe.round_trip(df.limit(0), path).collect() == []
