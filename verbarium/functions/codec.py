"""Codecs of sorted integer lists, as built-in expressions on arrays of int."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_fixed(ints: Column) -> Column:
    """Four bytes each, most significant first."""
    return F.unhex(F.array_join(F.transform(ints, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def _bytes(data: Column) -> Column:
    text = F.hex(data)
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(text, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))


def _range(data: Column, start: int | None, length: int | None) -> Column:
    """The given bytes; a start outside of the data gives none."""
    if start is None:
        return data
    inside = (F.lit(start) >= 0) & (F.lit(start) < F.octet_length(data))
    return F.when(inside, F.substring(data, start + 1, length if length is not None else 1 << 30)).otherwise(F.unhex(F.lit("")))


def decode_fixed(data: Column, start: int | None = None, length: int | None = None) -> Column:
    data = _range(data, start, length)
    n = F.floor(F.octet_length(data) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    text = F.hex(data)
    value = lambda i: F.conv(F.substring(text, 8 * i - 7, F.lit(8)), 16, 10).cast("long")
    return F.transform(places, lambda i: F.when(value(i) >= 1 << 31, value(i) - (1 << 32)).otherwise(value(i)).cast("int"))


def gaps(ints: Column) -> Column:
    """Differences to the number before; an unsorted list is an error."""

    def gap(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(ints, i - 1))
        return F.when(x - before < 0, F.raise_error(F.lit("array is not sorted"))).otherwise(x - before)

    return F.transform(ints, gap)


def encode_gaps(ints: Column) -> Column:
    """Gaps in groups of seven bits, most significant first, the high bit set on all but the last byte."""

    def group(x: Column, place: int) -> Column:
        bits = F.shiftrightunsigned(x, 7 * place).bitwiseAND(F.lit(127))
        byte = F.lpad(F.hex((bits + (128 if place else 0)).cast("long")), 2, "0")
        return byte if place == 0 else F.when(x >= 1 << (7 * place), byte).otherwise("")

    return F.unhex(F.array_join(F.transform(gaps(ints), lambda x: F.concat(*[group(x, p) for p in (4, 3, 2, 1, 0)])), ""))


def decode_gaps(data: Column, start: int | None = None, length: int | None = None) -> Column:
    empty = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("now"), F.lit(0).alias("last"))

    def step(s: Column, b: Column) -> Column:
        now = F.shiftleft(s["now"], 7).bitwiseOR(b.bitwiseAND(F.lit(127)))
        value = s["last"] + now
        return F.when(b >= 128, F.struct(s["out"].alias("out"), now.alias("now"), s["last"].alias("last"))).otherwise(
            F.struct(F.concat(s["out"], F.array(value)).alias("out"), F.lit(0).alias("now"), value.alias("last"))
        )

    return F.aggregate(_bytes(_range(data, start, length)), empty, step, lambda s: s["out"])
