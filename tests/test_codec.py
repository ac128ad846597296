from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.functions.codec import decode_fixed, decode_gaps, encode_fixed, encode_gaps

def by_hand(ints):
    """The gap code from its definition, byte by byte."""
    out, last = [], 0
    for x in ints:
        gap, last = x - last, x
        groups = [gap & 127]
        while gap := gap >> 7:
            groups.append(128 | gap & 127)
        out += reversed(groups)
    return bytes(out).hex().upper()


# Both sides of each seven-bit border, alone and as gaps.
BORDERS = [b + k for b in (1 << 7, 1 << 14, 1 << 21, 1 << 28) for k in (-1, 0, 1)]
LISTS = [*[[x] for x in BORDERS], [5], [9, 9], [100, 227, 355], list(accumulate(x for x in BORDERS if x < 1 << 28)), [(1 << 31) - 1], []]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>").orderBy("i")


def test_gap_codes(spark):
    assert by_hand([127]) == "7F" and by_hand([130, 257]) == "81027F" and by_hand([16385]) == "818001"
    df = column(spark, LISTS)
    assert [r[0] for r in df.select(F.hex(encode_gaps(F.col("v")))).collect()] == [by_hand(v) for v in LISTS]
    assert [r[0] for r in df.select(decode_gaps(encode_gaps(F.col("v")))).collect()] == LISTS


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 31) - 1), max_size=12).map(sorted), min_size=1, max_size=20))
def test_random_lists(spark, lists):
    df = column(spark, lists)
    rows = df.select(F.hex(encode_gaps(F.col("v"))).alias("h"), decode_gaps(encode_gaps(F.col("v"))).alias("v"), decode_fixed(encode_fixed(F.col("v"))).alias("f")).collect()
    assert [tuple(r) for r in rows] == [(by_hand(v), v, v) for v in lists]


def test_fixed_codes(spark):
    values = [[7, 4096, 1 << 30], [-3, -(1 << 31)], []]
    df = column(spark, values)
    assert [r[0] for r in df.select(F.hex(encode_fixed(F.col("v")))).collect()] == ["000000070000100040000000", "FFFFFFFD80000000", ""]
    assert [r[0] for r in df.select(decode_fixed(encode_fixed(F.col("v")))).collect()] == values


def test_range_of_bytes(spark):
    df = column(spark, [[4, 9, 600]])
    code = encode_gaps(F.col("v"))
    assert df.select(decode_gaps(code, 1, 1), decode_gaps(code, 0, 2), decode_gaps(code, 99, 1)).first()[:] == ([5], [4, 9], [])


def test_unsorted_is_an_error(spark):
    with pytest.raises(Exception, match="not sorted"):
        column(spark, [[8, 6]]).select(encode_gaps(F.col("v"))).collect()


def test_gaps_are_smaller_than_fixed(spark):
    df = column(spark, [list(range(11, 30000, 5))])
    a, b = df.select(F.octet_length(encode_fixed(F.col("v"))), F.octet_length(encode_gaps(F.col("v")))).first()
    assert a > 2 * b
