import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kavak.llm.encode import PATTERN, VOCABULARY, Encoder, encode

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, texts):
    flat, at = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aişğ İ  \n\t\r'0.,!\0")), max_size=60))
def test_same_ids_and_back(encoder, other, text):
    got = ids(encoder, [text])[0]
    assert got == other.encode_ordinary(text) and encoder.decode(got) == text


def test_special_strings_and_long_words(encoder, other):
    texts = ["<|endoftext|> a", "x" * 20_000, None, "", "  iki  boşluk \n", "👩‍🔬 ½"]
    assert ids(encoder, texts) == [other.encode_ordinary(t or "") for t in texts]


def test_column(spark, other):
    rows = spark.createDataFrame([(1, "bir iki", "x"), (2, None, "y"), (3, "", "z"), (1, "bir iki", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode(rows, "doc_id", "text").collect())
    assert got == [(1, other.encode_ordinary("bir iki"))] * 2 + [(2, []), (3, [])]
    assert encode(rows.limit(0), "doc_id", "text").count() == 0
