import random

import numpy as np
import pytest

pytest.importorskip("tiktoken")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from verbarium.llm.encode import Encoder, count_tokens, decode_documents, encode_documents  # noqa: E402

SCHEMA = "doc_id bigint, text string, key int, row int, ids string"
TREE, PLAIN = Encoder(leaf=16, window=4), Encoder()


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t'sreldmtv19ab中文の。，,.?!é\xa0　👍", max_size=200))
def test_tree_equals_direct(text):
    assert np.array_equal(TREE.encode(text), PLAIN.direct(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_tree_equals_direct_on_any_text(text):
    assert np.array_equal(TREE.encode(text), PLAIN.direct(text))
    assert PLAIN.decode(PLAIN.encode(text)) == text


def test_join_is_associative():
    rng = random.Random(1)
    for _ in range(100):
        parts = ["".join(rng.choice(" abc1'中。\n") for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        a, b, c = ((p, PLAIN.direct(p)) for p in parts)
        ab = (a[0] + b[0], PLAIN.join(*a, *b))
        bc = (b[0] + c[0], PLAIN.join(*b, *c))
        assert np.array_equal(PLAIN.join(*ab, *c), PLAIN.join(*a, *bc))


TEXTS = ["Hello world", "", None, "   ", "<|endoftext|> is text", "中文没有空格" * 500, "x" * 30_000, " " * 9000 + "end", "Hello world", "line\r\nline\n\n\nend 'tis"]


def test_documents(spark):
    expected = {i: PLAIN.direct(t).tolist() if t else [] for i, t in enumerate(TEXTS)}
    for split in (1 << 18, 64):  # the second cuts most texts into rows
        encoded = encode_documents(table(spark, TEXTS), split_chars=split)
        assert encoded.columns == ["doc_id", "ids"]
        assert {r.doc_id: r.ids for r in encoded.collect()} == expected
        assert {r.doc_id: r.n_tokens for r in count_tokens(table(spark, TEXTS), split_chars=split).collect()} == {i: len(x) for i, x in expected.items()}
    decoded = {r.doc_id: r.text for r in decode_documents(encode_documents(table(spark, TEXTS))).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_long_rows_stay_apart(spark):
    df = spark.createDataFrame([(1, "ab cd " * 100), (1, "ab cd " * 100)], "doc_id bigint, text string")
    got = [r.ids for r in encode_documents(df, split_chars=50).collect()]
    assert got == [PLAIN.direct("ab cd " * 100).tolist()] * 2


def test_empty_table(spark):
    assert encode_documents(table(spark, [])).count() == 0
    assert count_tokens(table(spark, [])).count() == 0
