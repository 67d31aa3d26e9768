"""Content hashes and the deterministic generator of mock embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def hash32(text: Column) -> Column:
    """31-polynomial over UTF-16 units, wrapped to a signed 32-bit integer (as a long); for short strings."""

    def units(u: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(u), F.lit(4)), lambda i: F.conv(F.substr(u, i, F.lit(4)), 16, 10).cast("long"))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda h, x: ((h * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF))))

    h = F.when(F.length(text) > 0, let(F.hex(F.encode(text, "UTF-16BE")), units)).otherwise(F.lit(0).cast("long"))
    return let(h, lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))


def hash32_of(text: str | None) -> int:
    """The same hash of one string of any length."""
    units = np.frombuffer((text or "").encode("utf-16-be", "surrogatepass"), ">u2").astype(np.uint32)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint32), np.full(max(0, len(units) - 1), 31, np.uint32)]))[::-1]
        h = int((units * powers[: len(units)]).sum(dtype=np.uint32)) if len(units) else 0
    return h - (1 << 32) if h >> 31 else h


def _hash32_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([hash32_of(x) for x in texts], dtype="int64")


def hash32_long(text: Column | str) -> Column:
    """:func:`hash32` for texts of any length, a batch at a time in numpy."""
    return F.pandas_udf(_hash32_batch, "long")(text)


def signed_hex(h: Column) -> Column:
    """Base 16 in lower case, with a minus sign for negatives."""
    return F.when(h < 0, F.concat(F.lit("-"), F.lower(F.hex(-h)))).otherwise(F.lower(F.hex(h)))


def mock_embedding(text: Column, dimensions: int) -> Column:
    """Unit vector drawn from a linear congruential generator that the text's hash seeds.

    The product runs in doubles, as above 2^53 its rounding is part of the result.
    """
    start = F.struct(F.abs(hash32(text)).alias("state"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        new = (s["state"].cast("double") * F.lit(1103515245.0) + F.lit(12345.0)).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
        return let(new, lambda n: F.struct(n.alias("state"), F.concat(s["out"], F.array(n / F.lit(float(0x7FFFFFFF)) * 2 - 1)).alias("out")))

    raw = F.aggregate(F.sequence(F.lit(1), F.lit(dimensions)), start, step)["out"]
    return let(raw, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(v, lambda x: x / n)))
