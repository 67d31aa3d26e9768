"""Near-duplicates by SetSketch registers.

A document's set of word shingles gets a SetSketch: per register the minimum of
exponential variables, kept as its truncated logarithm to the base B, so that
values are exponentially spaced, sketches of parts merge by the maximum, and
two registers agree with about the Jaccard similarity. Documents that agree in
a band of registers are candidates. A joint maximum-likelihood estimate from
both sketches and both set sizes drops clear misses, and the candidates' families
are then verified on full sets.

Equal sets are one class from the start, so copies cost one row. Within a
family every document is compared exactly with the family's first one, which
links a tight group at once. Those that aren't linked to it are compared exactly with
every other document of the family, block against block, in tasks of bounded rows and
bytes; pairs of documents that are both linked to the first need no look. Only a
spanning set of links leaves a task, so links don't grow with the square of a group.

What can be missed: two similar documents that share no band, or whose common
bands (13 of 32 on average at 0.8) all have a first member so unlike them that the
estimate drops it. Each such member agrees with them in a band by chance, once in
100 times at a similarity of 0.3, so both cases are rarer than one in 10^7 pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, release
from .components import connected_components

#: Registers; base; registers in a band. At a similarity of 0.8 all 32 bands miss once in 2 * 10^7 pairs.
REGISTERS, BASE, BAND = 128, 1.001, 4
_Q = (1 << 16) - 2
_RATE = 20.0
#: Candidates with a lower joint estimate are dropped (0.8 is over ten standard errors away).
LEAST_ESTIMATE = 0.3
#: Documents and bytes of shingles that a block should hold.
BLOCK, BLOCK_BYTES = 1024, 8 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, REGISTERS, np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words, A-Z lower-cased.

    With fewer words the whole sequence is one; without words there's none.
    """
    global _POWERS
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    solid = ~_SPACE[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_POWERS) < len(raw) + 1:
        size = 1 << (len(raw) + 1).bit_length()
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _STEP, np.uint64)]))
    # A word's hash counts from its end, so that equal words are equal anywhere.
    length = last - first
    word = np.add.reduceat(np.where(solid, _BYTE[raw], np.uint64(0)) * _POWERS[_behind(first, last, len(raw))], first) if n else first
    word = _mix(word + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + word[j : n - k + 1 + j])
    if n < width:
        h = _mix(h + np.uint64(n))
    return np.unique(h)


def _behind(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Of every byte of a word, how many bytes of it follow; elsewhere 0."""
    at = np.zeros(n, np.int64)
    length = last - first
    inside = np.repeat(last, length) - 1
    start = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    where = start + np.arange(len(start))
    at[where] = inside - where
    return at


def sketch(items: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a set of hashes; those of a union are the maximum of the parts'."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048, None]
        least = np.minimum(least, ((part ^ _PLUS) * _TIMES).min(0))
    x = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 1e-16)) / _RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, _Q + 1).astype(np.uint16)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (pairs x REGISTERS) with set sizes."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = REGISTERS - more - less
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        pa, pb = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(pa, 1e-12)) + less * np.log(np.maximum(pb, 1e-12)) + same * np.log(np.maximum(1 - pa - pb, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = fit(low + third) < fit(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def document_of(text: str = "text") -> Column:
    """A document's key: its doc_id or, without one, a number from 2^62 on that its text decides."""
    return F.coalesce(F.col("doc_id").cast("long"), F.conv(F.substring(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") + F.lit(1 << 62))


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, document, first of every row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    shingle sets; component_id is the smallest doc_id that links lead to, the
    document's own included. Null, empty and blank texts have no shingles and
    are linked with nothing. Rows of one doc_id count as one document: it is in
    the component of each of its texts. Rows without a doc_id are documents known by
    their texts (``document`` is :func:`document_of`) and linked like others; their
    component_id is null where no document of the component has an id. ``first`` is the
    document that stands for the component. Other columns aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def measure(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingles(x, width) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["document", "named", "n_shingles", "class", "sketch"],
            )

    ids = docs.select(document_of().alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.col("text").cast("string").alias("text"))
    measured = materialize(ids.mapInArrow(measure, "document long, named boolean, n_shingles long, class binary, sketch binary"), "sketches")
    nameless = measured.where("not named").limit(1).count() > 0
    named = F.min(F.when(F.col("named"), F.col("document")))
    classes = measured.where("class is not null").groupBy("class").agg(F.coalesce(named, F.min("document")).alias("rep"), named.isNotNull().alias("named"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")

    def bands(sketches: pd.Series) -> pd.Series:
        table = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, REGISTERS // BAND, BAND).astype(np.uint64)
        h = np.arange(REGISTERS // BAND, dtype=np.uint64)[None] + np.uint64(1)
        for j in range(BAND):
            h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + table[:, :, j])
        return pd.Series(list(h.view(np.int64)))

    # A class is known by its smallest doc_id; one id with two texts joins both.
    banded = classes.select("rep", F.explode(F.pandas_udf(bands, "array<long>").asNondeterministic()("sketch")).alias("band"))
    banded = materialize(banded, "bands")
    # What is joined with many rows of a key is written first, so that Spark can split those rows.
    centers = materialize(banded.groupBy("band").agg(F.min("rep").alias("center"), F.max("rep").alias("__most")).where("center < __most").select("band", "center"), "centers")
    stars = materialize(banded.join(centers, "band").where("rep <> center").select("rep", "center").distinct(), "stars")
    release(banded, centers)

    def estimates(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        table = [np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (a, b)]
        return pd.Series(joint_estimate(*table, na.to_numpy(float), nb.to_numpy(float)))

    # Of a doc_id with several texts, the largest class gives the estimate.
    one = materialize(classes.groupBy("rep").agg(F.max_by("sketch", "n").alias("sketch"), F.max("n").alias("n")), "one")
    likely = stars.join(one.toDF("rep", "sa", "na"), "rep").join(one.toDF("center", "sb", "nb"), "center").withColumn("estimate", F.pandas_udf(estimates, "double")("sa", "sb", "na", "nb"))
    families = connected_components(likely.where(F.col("estimate") >= LEAST_ESTIMATE).select(F.col("rep").alias("a"), F.col("center").alias("b")))
    release(stars)
    texts = ids.where("named").select("doc_id", "text")
    if nameless:  # copies are one document
        texts = texts.unionByName(ids.where("not named").groupBy("doc_id").agg(F.first("text").alias("text")))
    links = _verified(texts, families, one.select("rep", "n"), width, percent)
    found = connected_components(links)
    release(one, links, families)
    # The component of every class, and then one join to the rows.
    labelled = classes.select("class", "rep", "named").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_class = materialize(labelled.select("class", F.coalesce("component", "rep").alias("first"), F.when(F.col("named"), F.col("rep")).alias("rep")), "class-components")
    release(classes, found)
    if nameless:  # the smallest of the ids alone
        least = materialize(of_class.groupBy("first").agg(F.min("rep").alias("component")), "least")
        of_class = of_class.join(least.hint("merge"), "first")
    else:
        of_class = of_class.withColumn("component", F.col("first"))
    of_class = materialize(of_class.select("class", "first", "component"), "components")
    rows = measured.select("document", "named", "n_shingles", "class").join(of_class.hint("merge"), "class", "left")
    own = F.when(F.col("named"), F.col("document"))
    return rows.select(own.alias("doc_id"), "n_shingles", F.coalesce("component", own).alias("component_id"), "document", F.coalesce("first", "document").alias("first"))


def _verified(ids: DataFrame, families: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of a spanning set of the links within each family, written; ``sizes`` has rep and n, its shingles."""

    def as_sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, width).tobytes() for x in texts])

    members = families.select(F.col("id").alias("doc_id"), "component")
    sets = materialize(members.join(ids.hint("merge"), "doc_id").select("doc_id", "component", F.pandas_udf(as_sets, "binary").asNondeterministic()("text").alias("items")), "sets")

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    # A family is known by its first document.
    first = sets.where("doc_id = component").select("component", F.col("items").alias("first_items"))
    likened = sets.where("doc_id <> component").join(first.hint("merge"), "component").select("doc_id", "component", F.pandas_udf(alike, "boolean").asNondeterministic()("items", "first_items").alias("linked"))
    # A doc_id with several texts is linked if one of them is.
    likened = materialize(likened.groupBy("doc_id", "component").agg(F.max("linked").alias("linked")), "likened")
    direct = likened.where("linked").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    lone = likened.where("not linked").select("doc_id", "component")
    if not lone.limit(1).count():
        out = materialize(direct, "links")
        release(sets, likened)
        return out

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        counted = rows.join(sizes.toDF("doc_id", "n"), "doc_id", "left").groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
        number = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(8 * F.col("n") / BLOCK_BYTES), F.lit(1)).cast("int")
        return counted.select("component", number.alias(name))

    # Every block of lone documents meets every block of its family.
    numbers = materialize(blocks(lone, "lone_blocks").join(blocks(members, "blocks"), "component"), "blocks")
    marked = sets.join(lone.withColumn("lone", F.lit(True)).hint("merge"), ["doc_id", "component"], "left").join(numbers.hint("merge"), "component")
    at = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = marked.select("doc_id", "component", "items", F.lit(False).alias("lone"), F.explode(F.sequence(F.lit(0), F.col("lone_blocks") - 1)).alias("i"), at("blocks").alias("j"))
    own = marked.where("lone").select("doc_id", "component", "items", F.lit(True).alias("lone"), at("lone_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "lone"])  # so that each is reached from the least
        linked = _links([np.frombuffer(x, np.uint64) for x in rows["items"]], percent)
        lone, ids_ = rows["lone"].to_numpy(), rows["doc_id"].to_numpy()
        linked &= (lone[:, None] != lone[None]) | (ids_[:, None] == ids_[None])
        return pd.DataFrame(_spanning(linked, ids_), columns=["a", "b"])

    # Dealt by blocks: left to itself, Spark would leave a family in the partition that the join put it in.
    pairs = own.unionByName(every).repartition("component", "i", "j")
    rest = pairs.groupBy("component", "i", "j").applyInPandas(compare, "a long, b long").where("a <> b")
    out = materialize(direct.unionByName(rest), "links")
    release(sets, likened, numbers)
    return out


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) - len(np.setdiff1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links(items: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the pairs with 100 * intersection >= percent * union, from exact counts."""
    n, size = len(items), np.array([len(x) for x in items])
    flat, owner = np.concatenate(items), np.repeat(np.arange(n), size)
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    code = np.cumsum(count > 1)[which[shared]] - 1
    owner = owner[shared]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    codes = int(code[-1]) + 1 if len(code) else 0
    width = max(1, min(codes, (1 << 23) // n))
    for low in range(0, codes, width):
        a, b = np.searchsorted(code, [low, low + width])
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], code[a:b] - low] = 1
        both += table @ table.T
    either = size[:, None] + size[None] - both
    return 100 * both.astype(np.int64) >= percent * either.astype(np.int64)


def _spanning(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows (first found, reached) that connect what ``linked`` connects."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & left)
            left[front] = False
            out += [(ids[i], ids[k]) for k in front]
    return np.array(out, np.int64).reshape(-1, 2)


def classes_sql(width: int, percent: int, table: str = "documents") -> str:
    """DuckDB statement for :func:`near_classes` with ``kept``: all pairs that share a shingle, and their closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as l from {table}),
    s as (select distinct doc_id, array_to_string(list_slice(l, i, i + {width - 1}), ' ') as x, least(len(l), {width}) as k from (select doc_id, l, unnest(range(1, greatest(len(l) - {width - 1}, 1) + 1)) as i from w where len(l) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.x = b.x and a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
    links as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * shared >= {percent} * (na.n + nb.n - shared)),
    r as (select doc_id as a, doc_id as b from {table} union select r.a, links.b from r join links on links.a = r.b),
    c as (select a as doc_id, min(b) as component_id from r group by a)
    select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept from w left join n using (doc_id) left join c using (doc_id)"""
