"""Column functions of the audit and evaluation operators; all run in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^([A-Za-z]+ \(\d+\))((?:-[A-Za-z0-9 ]+)*)$"


def source_key(name: Column) -> Column:
    """Class and number of a name, null where it does not follow the grammar."""
    return F.when(name.rlike(NAME), F.regexp_extract(name, NAME, 1))


def chain(name: Column) -> Column:
    """Operations of a name in order: empty for a base file, null where the name does not parse."""
    tail = F.regexp_extract(name, NAME, 2)
    return F.when(name.rlike(NAME), F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(tail, 2, 1 << 30), "-")))


def unknown_ops(ops: Column, known: Iterable[str]) -> Column:
    """Operations of a chain that are not known."""
    return F.filter(ops, lambda op: ~op.isin(list(known)))


def content_id(prefix: str, digests: Column) -> Column:
    """prefix and the first 12 hex digits of the md5 of sorted digests (repeats stay)."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.array_join(F.array_sort(digests), "|")), 1, 12))


def half_hash(digest: Column, at: int) -> Column:
    """Eight hex digits of a digest as a number under 2**32."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def unit_score(text: Column) -> Column:
    """A number in [0, 1) that follows from a text alone."""
    return half_hash(F.md5(text), 1).cast("double") / F.lit(4294967296.0)


def bits_to_long(bits: Column) -> Column:
    """64 booleans, the first the highest bit, as the signed number with that pattern."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda t, b: F.shiftleft(t, 1).bitwiseOR(b.cast("bigint")))


def hex16(x: Column) -> Column:
    """Sixteen lower-case hex digits of a 64-bit number."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def is_uncertain(p: Column, margin: float = 0.1, tolerance: float = 1e-9) -> Column:
    """Whether a score is within the margin of one half; a tolerance of 0 gives the strict variant."""
    return F.abs(p - 0.5) <= F.lit(margin + tolerance)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as SQL engines round floating numbers: the product with the power of ten goes to the nearest whole, halves away from zero, and is divided again.

    Spark's own round takes the shortest decimal of x instead, so that 0.575, whose product is 57.49999999999999, goes up.
    """
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def clip01(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
