import base64
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import tokens
from plumbline.llm.batches import texts

PATH = os.path.join(os.environ.get("PLUMBLINE_TOKENIZERS", tokens.FOLDER), tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    e = tokens.Encoder(PATH, remembered=1000)
    own = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(PATH), special_tokens={})
    return e, own


def encode(e, rows):
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
    return e.rows(*texts(batch, "text")).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="ab'stdm .,!\n\t\r09é漢 　\x85😀́<|endoftext|>"))))
def test_equal_to_encoding_whole_texts(tools, rows):
    e, own = tools
    assert encode(e, rows) == [own.encode_ordinary(x or "") for x in rows]


def test_long_and_odd_texts(tools):
    e, own = tools
    rows = ["", None, " " * 50_000, "a" * 100_000, "!'s" * 1000, "\n" * 3000 + "x", "漢" * 20_000, "<|endoftext|>", "word " * 100_000]
    assert encode(e, rows) == [own.encode_ordinary(x or "") for x in rows]


def test_round_trip_and_table(spark, tools):
    e, own = tools
    rows = [(1, "Don't stop.\n\nNow"), (2, None), (3, ""), (4, "é漢😀"), (4, "é漢😀")]
    df = spark.createDataFrame([(k, t, 0, "z") for k, t in rows], "doc_id long, text string, ids int, key string")
    got = tokens.encoded(df, "doc_id", "text")
    assert got.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert sorted((r.doc_id, own.decode(r.ids)) for r in got.collect()) == sorted((k, t or "") for k, t in rows)
    assert tokens.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_cuts_are_never_inside_a_token(tools):
    e, _ = tools
    with open(PATH, "rb") as f:
        some = [base64.b64decode(line.split()[0]) for k, line in enumerate(f) if k % 50 == 0]
    assert all(e.inside[a, b] for t in some for a, b in zip(t, t[1:]))
