"""Document fingerprints by order MinHash.

A text is cut into units (a run of at most 16 characters with the white space
before it; of a longer run each character is a unit, so that an edit doesn't move
the others), and every three successive units form a k-mer, numbered by its
occurrence. Each of M orders of the k-mers selects the L minimal ones; these
are put back in the order of the text and hashed as a tuple, so a fingerprint
depends on content and on order and follows the edit distance.

The M orders are M rotations of one hash order: with the hashes on a circle,
order m starts at the m-th of M equal steps. A text's hashes are then sorted
once, every order has a full selection even in short texts, and M and L don't
multiply the work. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import RANGE_ROWS, range_of, splitters
from .common import let

UNIT = r"\s*+(?<!\S)\S{1,16}+(?!\S)|\s*+\S|\s++"
#: Orders, k-mers selected by each, and units in a k-mer.
M, L, K = 64, 2, 3
#: A selected k-mer is one long: 36 bits of hash above 27 bits of position (the top bit is 0).
_AT = 27
_HASH = 63 - _AT


def signature(text: Column) -> Column:
    """Array of M ints; a null or empty text has M zeros, and equal texts have equal signatures."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), 0)

    def of_units(u: Column) -> Column:
        kmers = F.transform(u, lambda x, i: F.xxhash64(x, *[F.get(u, i + j) for j in range(1, K)]))
        return let(kmers, of_kmers)

    def of_kmers(h: Column) -> Column:
        plain = F.transform(h, lambda x, i: _packed(F.xxhash64(x, F.lit(0)), i))
        found = F.when(F.size(F.array_distinct(h)) == F.size(h), plain).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), numbered))
        starts = F.array(*[F.lit((m << (63 - 6)) | ((1 << _AT) - 1)) for m in range(M)])
        return let(F.sort_array(F.concat(found, starts)), select)

    def numbered(s: Column) -> Column:
        """Each k-mer hashed with its occurrence number, from pairs sorted by k-mer and position."""
        n = F.size(s)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"]))
        return let(heads, lambda b: F.flatten(F.transform(b, lambda start, j: F.transform(F.slice(s, start + 1, F.coalesce(F.get(b, j + 1), n) - start), lambda x, o: _packed(F.xxhash64(x["h"], o), x["i"])))))

    def select(all_: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda j: _is_start(F.get(all_, j)))
        kept = F.filter(all_, lambda x: ~_is_start(x))
        return let(F.struct(marks.alias("marks"), kept.alias("kept")), tuples)

    def tuples(z: Column) -> Column:
        n, low = F.size(z["kept"]), F.lit((1 << _AT) - 1)

        def one(mark: Column, m: Column) -> Column:
            first = F.get(z["kept"], (mark - m) % n)
            second = F.get(z["kept"], (mark - m + 1) % n)
            pair = F.when(first.bitwiseAND(low) <= second.bitwiseAND(low), F.xxhash64(F.shiftright(first, _AT), F.shiftright(second, _AT))).otherwise(F.xxhash64(F.shiftright(second, _AT), F.shiftright(first, _AT)))
            return F.shiftright(pair, 32).cast("int")

        return F.when(n == 0, F.array_repeat(F.lit(0), M)).otherwise(F.transform(z["marks"], one))

    return let(units, of_units)


def _packed(h: Column, at: Column) -> Column:
    top = F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH), _AT)
    return top.bitwiseOR(F.least(at, F.lit((1 << _AT) - 2)).cast("long"))


def _is_start(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _AT) - 1)) == F.lit((1 << _AT) - 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of orders whose selections agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(M))


def as_text(signature_: Column) -> Column:
    """A signature as 8 hexadecimal digits a selection."""
    return F.array_join(F.transform(signature_, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``next_<c>`` of each column: its value in the next row by descending doc_id; after the last comes the first.

    Ids are dealt to ranges between sampled ids, each sorted by itself; where a
    range ends, the next one's first row follows. Ids may be any longs. Rows of one id
    follow each other by a hash of ``columns`` and by their values, and those without
    an id come last; an id with many rows, or null, gets several ranges.
    ``derived`` names further columns that are made of ``columns`` alone: they
    are added before the shuffle, and anew for the few rows that follow a range. ``__range`` and
    ``__hash`` aren't kept, and ``__key``, ``__last``, ``__to``, ``__from`` and names that begin with ``__next_`` or ``__head_`` mustn't be columns' names.
    """
    derived = derived or {}
    every = [*columns, *derived]
    rows, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    # Descending order is the ascending one of the ids' complements, which no id overflows.
    upside_down = F.bitwise_not(F.col("doc_id").cast("long"))
    keyed = docs.withColumns({"__key": upside_down, "__hash": F.xxhash64(*columns)})
    cuts = splitters(keyed, "__key", rows)
    unnamed = max(1, -(-(rows - named) // min(RANGE_ROWS, max(1, rows // 4096))))
    after = F.lit(len(cuts) + 1) + F.least(F.floor((F.col("__hash").cast("double") / F.lit(float(1 << 64)) + 0.5) * unnamed).cast("int"), F.lit(unnamed - 1))
    ranged = keyed.withColumn("__range", F.coalesce(range_of(F.col("__key"), cuts, F.col("__hash")), after)).drop("__key")
    inside = W.partitionBy("__range").orderBy(F.desc_nulls_last("doc_id"), "__hash", *columns)
    full = ranged.withColumns(derived)
    out = full.withColumns({f"__next_{c}": F.lead(c).over(inside) for c in every} | {"__last": F.lead(F.lit(False), 1, True).over(inside)})
    heads = ranged.groupBy("__range").agg(F.min_by(F.struct(*columns), F.struct(F.bitwise_not("doc_id"), "__hash", *columns)).alias("__head"))
    # One small row a range: which range comes next.
    ids = ranged.select("__range").distinct()
    along = ids.select("__range", F.coalesce(F.lead("__range").over(W.orderBy("__range")), F.min("__range").over(W.partitionBy())).alias("__to"))
    follow = along.join(heads.withColumnRenamed("__range", "__to"), "__to").select(F.col("__range").alias("__from"), *[F.col("__head")[c].alias(c) for c in columns]).withColumns(derived)
    follow = follow.select("__from", *[F.col(c).alias(f"__head_{c}") for c in every])
    own = [c for c in full.columns if c not in ("__range", "__hash")]
    ends = out.where("__last").join(follow, F.col("__range") == F.col("__from")).select(*own, *[F.col(f"__head_{c}").alias(f"next_{c}") for c in every])
    return out.where("not __last").select(*own, *[F.col(f"__next_{c}").alias(f"next_{c}") for c in every]).unionByName(ends)


def fingerprint(docs: DataFrame, text: str = "text", into: str = "signature") -> DataFrame:
    """Adds the signature (array of M ints) of each whole text. All rows and columns stay."""
    return docs.withColumn(into, signature(F.col(text)))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of ``following``."""
    n = F.length(text)
    return F.concat(F.left(text, n - F.floor(n / 2)), F.left(following, F.floor(n / 2)))
