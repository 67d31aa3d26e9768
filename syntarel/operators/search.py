"""Exact nearest-neighbour search and the embedding cache."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_distance
from ..storage import written


def nearest(vectors: DataFrame, query: list[float] | DataFrame, k: int = 10, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows with the least L2 distance to one query vector, ties by id, with ``distance``.

    ``query`` is a list or a DataFrame of one row and one array column. Every
    task keeps k rows; these are merged.
    """
    if isinstance(query, DataFrame):
        one = query.limit(1).toDF("__query")
        df = vectors.join(F.broadcast(one))
    else:
        df = vectors.withColumn("__query", F.array(*[F.lit(float(x)) for x in query]))
    return df.withColumn("distance", l2_distance(F.col(embedding), F.col("__query"))).drop("__query").orderBy("distance", id_column).limit(k)


#: Rows of a block of vectors and of queries where there are few; with more rows blocks grow to so many times that, as far as BLOCK_VALUES numbers.
VECTOR_BLOCK, QUERY_BLOCK, GROWN, BLOCK_VALUES = 8192, 1024, (8, 16), 1 << 22
#: Vectors of a cell on average, cells at most, vectors that are compared in one step, and pairs of blocks whose rows are copied for each other at a time (or what makes four copies of the vectors, if that's more).
CELL, MOST_CELLS, STEP, ROUND = 2048, 1024, 2048, 128
#: Numbers in the sample that the cells' centres are fitted on.
SAMPLE_VALUES = 1 << 21


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.zeros(0, int), *((half - rows[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(rows), 4096))])


def _centres(sample: np.ndarray, number: int, steps: int = 6) -> np.ndarray:
    """Centres of ``number`` cells of a sample, moved a few times to the means of their vectors; near ones follow each other."""
    centres = sample[np.linspace(0, len(sample) - 1, number).astype(int)].copy()
    for _ in range(steps):
        own = _closest(sample, centres)
        sums, size = np.zeros_like(centres), np.bincount(own, minlength=number)
        np.add.at(sums, own, sample)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    at, left = 0, np.ones(number, bool)
    order = []
    while len(order) < number:
        order.append(at)
        left[at] = False
        at = int(np.where(left, ((centres - centres[at]) ** 2).sum(1), np.inf).argmin())
    return centres[order]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, summed in the order of the numbers, as SQL engines do."""
    return np.sqrt(np.cumsum((a - b) ** 2, 1)[:, -1])


def _few_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of all rows but those that have ``k`` equal ones with smaller ids."""
    bits = np.ascontiguousarray(rows + 0.0).view(np.uint64)
    mixed = (bits ^ (bits >> np.uint64(29))) * (np.random.default_rng(7).integers(1, 1 << 63, rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    key = (mixed ^ (mixed >> np.uint64(32))).sum(1, dtype=np.uint64)
    order = np.lexsort((ids, key))
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    sizes = np.diff(np.r_[starts, len(order)])
    gone = np.zeros(len(order), bool)
    for at, n in zip(starts[sizes > k], sizes[sizes > k], strict=True):
        gone[at + k : at + n] = (rows[order[at : at + n]] == rows[order[at]]).all()
    return np.sort(order[~gone])


class _Step:
    """Some vectors, relative to a point near them."""

    def __init__(self, rows: np.ndarray, centre: np.ndarray):
        x = rows - centre
        half = (x * x).sum(1) / 2
        radius = np.sqrt(2 * half)
        self.centre, self.low, self.high, self.size = centre, radius.min(), radius.max(), len(rows)
        # Columns up to a multiple of eight, behind which no vector stands.
        self.x = np.zeros((-(-len(rows) // 8) * 8, rows.shape[1] + 1))
        self.x[:, -1] = -np.inf
        self.x[: len(rows)] = np.column_stack([x, -half])
        self.narrow = self.x.astype(np.float32) if self.high < 1e15 else None

    def products(self, queries: np.ndarray, bound: np.ndarray):
        """Positions of the queries that can have a vector within ``bound``, and for some of these at a time: from where, y x - x x / 2 of all vectors,
        what it is at least for vectors within ``bound`` (NaN if that is not known), and how far it can be off."""
        y = queries - self.centre
        square = (y * y).sum(1)
        far = np.sqrt(square)
        least = np.maximum(far - self.high, self.low - far) - 1e-9 * (far + self.high)
        live = np.flatnonzero(~(least > bound))
        y, square, far, bound = y[live], square[live], far[live], bound[live]
        single = self.narrow is not None and bool((far < 1e15).all())
        x, kind = (self.narrow, np.float32) if single else (self.x, np.float64)
        eps, d = float(np.finfo(kind).eps), y.shape[1] + 8
        # Rounding to ``kind``, then sums of d products; the rest is for what is computed in doubles. Twice what it can be.
        off = d * (eps * (far * self.high + self.high**2) + 1e-15 * (square + self.high**2) + float(np.finfo(kind).tiny))
        limit = (square - bound * bound) / 2
        limit -= off + d * 1e-15 * np.abs(square + bound * bound) + eps * np.abs(limit)
        y = np.column_stack([y, np.ones(len(y))]).astype(kind)
        some = max(1, (1 << 19) // len(x))
        return live, ((i, y[i : i + some] @ x.T, limit[i : i + some], off[i : i + some]) for i in range(0, len(y), some))


class _Best:
    """The ``k`` nearest vectors of some queries so far: distances (NaN: none yet) and ids."""

    def __init__(self, queries: np.ndarray, limit: np.ndarray, k: int):
        self.queries, self.limit, self.k = queries, limit, k
        self.distance, self.ids = np.full((len(queries), k), np.nan), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.held, self.waiting = np.zeros(len(queries), int), []

    def bound(self) -> np.ndarray:
        """No vector further than this is among the ``k``."""
        return np.fmin(self.limit, self.distance[:, -1])

    def look(self, ids: np.ndarray, rows: np.ndarray, step: _Step) -> int:
        """Compares with the vectors of a step; how many pairs."""
        live, parts = step.products(self.queries, self.bound())
        pairs, some = [], 0
        for at, product, least, off in parts:
            if step.size > self.k and np.isnan(least).any():
                kth = np.partition(np.where(np.isnan(product), -np.inf, product), product.shape[1] - self.k, 1)[:, -self.k]
                least = np.where(np.isnan(least), kth - 4 * off - 1e-6 * np.abs(kth), least)
            under = product < least.astype(product.dtype)[:, None]  # what isn't a number isn't under anything
            eights = np.flatnonzero(under.view(np.uint64) != 0x0101010101010101)
            eight, one = np.nonzero(~under.reshape(-1, 8)[eights])
            q, t = np.divmod(eights[eight] * 8 + one, product.shape[1])
            pairs.append((live[at + q[t < step.size]], t[t < step.size]))
            some += len(q)
            if some > 1 << 16:
                self._add(pairs, ids, rows)
                pairs, some = [], 0
        self._add(pairs, ids, rows)
        return len(live) * step.size

    def _add(self, pairs: list, ids: np.ndarray, rows: np.ndarray) -> None:
        if not pairs:
            return
        q, t = map(np.concatenate, zip(*pairs, strict=True))
        distance = np.concatenate([np.zeros(0), *(_exact(self.queries[q[i : i + 8192]], rows[t[i : i + 8192]]) for i in range(0, len(q), 8192))])
        keep = ~(distance > self.bound()[q])
        self.waiting.append((q[keep], distance[keep], ids[t[keep]]))
        if sum(len(x[0]) for x in self.waiting) > max(1 << 16, 2 * self.k * len(self.queries)):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        q, distance, ids = map(np.concatenate, zip(*self.waiting, strict=True))
        self.waiting = []
        able = np.unique(q)
        self.held += np.bincount(q, minlength=len(self.held))
        every = [np.concatenate([old[able].ravel(), new]) for old, new in ((self.ids, ids), (self.distance, distance))]
        query = np.concatenate([np.repeat(np.arange(len(able)), self.k), np.searchsorted(able, q)])
        order = np.lexsort((*every, query))
        first = order[np.searchsorted(query[order], np.arange(len(able)))[:, None] + np.arange(self.k)]
        self.ids[able], self.distance[able] = every[0][first], every[1][first]


def _vectors(column, d: int) -> np.ndarray:
    """An Arrow column of arrays of ``d`` numbers as rows of doubles."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) != len(flat) * d or not pc.all(pc.equal(pc.list_value_length(flat), d), min_count=0).as_py():
        raise ValueError(f"all vectors must have {d} numbers")
    return values.reshape(-1, d)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", embedding: str = "embedding", compared=None) -> DataFrame:
    """query_id, ``id_column``, distance: of every query (its own ``id_column`` and ``embedding``) the ``k`` rows with the least L2 distance, ties by id.

    Exact, and without looking at every vector. Vectors and queries are dealt to cells by their nearest
    centre (fitted on a sample of SAMPLE_VALUES numbers), and cells to blocks of bounded size; a hot cell
    is many blocks. A block of queries meets, in a group of its own, each block of vectors that can, by
    the triangle inequality, hold one nearer than the k-th of a query's nearest in the sample. There the same is asked for each
    query and some vectors at a time, with what it has found by then. Products in single precision with a bound of
    their error tell which pairs can be among the k; only those are computed exactly.
    The number of copies of the vectors that groups hold at a time is bounded, too (ROUND). Only the cells' figures
    (MOST_CELLS rows) and the sample reach the driver. Null vectors and ids are
    left out. ``compared``, an accumulator, counts the pairs that distances were computed of.
    """
    spark = vectors.sparkSession
    single = all(df.schema[embedding].dataType == T.ArrayType(T.FloatType(), df.schema[embedding].dataType.containsNull) for df in (vectors, queries))
    array = f"array<{'float' if single else 'double'}>"

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_column).isNotNull() & F.col(embedding).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(embedding).cast(array).alias("v"))

    table, asked = clean(vectors), clean(queries)
    size = table.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = size["n"], size["d"]
    def compare(few: pa.Table, many: pa.Table) -> pa.Table:
        best = _Best(_vectors(few["v"], d), few["bound"].to_numpy(), k)
        if len(few) and len(many):
            ids, rows, cell = many["id"].to_numpy(), _vectors(many["v"], d), many["cell"].to_numpy()
            some = _few_copies(ids, rows, k)
            cell = np.where(np.isfinite(rows).all(1), cell, -1)  # what isn't finite spoils no other's centre
            some = some[np.argsort(cell[some], kind="stable")]
            ids, rows, cell = ids[some], rows[some], cell[some]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                centre = rows[a:b].mean(0)
                order = a + np.argsort(((rows[a:b] - centre) ** 2).sum(1), kind="stable")
                for at in range(0, b - a, STEP):
                    own = order[at : at + STEP]
                    seen = best.look(ids[own], rows[own], _Step(rows[own], centre))
                    if compared is not None:
                        compared.add(seen)
            best.merge()
        q, place = np.nonzero(np.arange(k) < np.minimum(best.held, k)[:, None])
        return pa.table({"query_id": pa.array(few["id"].to_numpy()[q], pa.int64()), id_column: pa.array(best.ids[q, place], pa.int64()), "distance": pa.array(best.distance[q, place], pa.float64())})

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", id_column))

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")

    def met(few: DataFrame, many: DataFrame) -> DataFrame:
        found = few.groupBy("pair").cogroup(many.groupBy("pair")).applyInArrow(compare, f"query_id long, {id_column} long, distance double")
        return best_of(found)

    if not n:
        return spark.createDataFrame([], f"query_id long, {id_column} long, distance double")
    if n <= VECTOR_BLOCK:  # a single block
        groups = max(1, -(-asked.count() // QUERY_BLOCK))
        few = asked.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("pair"), F.lit(0).alias("cell"), F.lit(float("nan")).alias("bound"), "id", "v")
        return met(few, table.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("pair"), F.lit(0).alias("cell"), "id", "v"))
    dealt = f"cell int, far double, bound double, id long, v {array}"
    most = max(1, SAMPLE_VALUES // d)
    sample = _vectors(table.sample(min(1.0, 1.2 * most / n), 5).limit(most).select("v").toArrow()["v"], d)
    sample = sample[(np.abs(sample) < 1e100).all(1)]
    centres = _centres(sample, max(1, min(MOST_CELLS, len(sample), n // CELL))) if len(sample) else np.zeros((1, d))
    between = np.array([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])
    # Of so many vectors the k nearest are a bound for each query; at a sixteenth of all it costs a sixteenth of the comparisons.
    known = sample[np.linspace(0, len(sample) - 1, min(len(sample), max(k, n // 16))).astype(int)] if len(sample) else sample
    known = known.astype(np.float32) if single else known

    def assign(with_bound: bool):
        def run(batches):
            step = _Step(known.astype(np.float64), known.mean(0, dtype=np.float64)) if with_bound and len(known) >= k else None
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = _vectors(batch.column("v"), d)
                cell = _closest(rows, centres)
                bound = np.full(len(rows), np.nan)
                if step is not None:
                    live, parts = step.products(rows, bound)
                    square = ((rows - step.centre) ** 2).sum(1)
                    for at, product, _, off in parts:
                        kth = np.partition(product, product.shape[1] - k, 1)[:, -k].astype(np.float64)
                        own = square[live[at : at + len(kth)]]
                        bound[live[at : at + len(kth)]] = np.sqrt(np.maximum(0.0, own - 2 * kth + 4 * off + 1e-12 * own)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(_exact(rows, centres[cell])), pa.array(bound), batch.column("id"), batch.column("v")], names=["cell", "far", "bound", "id", "v"])

        return run

    table, asked = (written(df.mapInArrow(assign(b), dealt), name) for df, b, name in ((table, False, "cells"), (asked, True, "asked")))

    number = len(between)

    def figures(df: DataFrame, block: int, grown: int, parts: int):
        """Rows of a block; of each cell the number of rows, how many come before it, its radius and its largest bound."""
        counts, far, bound = np.zeros(number, int), np.zeros(number), np.zeros(number)
        for r in df.groupBy("cell").agg(F.count("*"), F.max("far"), F.max("bound")).collect():
            counts[r[0]], far[r[0]], bound[r[0]] = r[1:]
        rows = max(1, min(BLOCK_VALUES // d, grown * block, max(block, -(-int(counts.sum()) // parts))))
        rows = max(1, -(-int(counts.sum()) // max(1, -(-int(counts.sum()) // rows))))  # so that no block is much smaller than the others
        return rows, counts, np.cumsum(counts) - counts, far, bound

    rows_v, count_v, before_v, far_v, _ = figures(table, VECTOR_BLOCK, GROWN[0], 12)
    rows_q, count_q, before_q, far_q, bound_q = figures(asked, QUERY_BLOCK, GROWN[1], 4)
    needed = (count_q > 0)[:, None] & (count_v > 0) & ~(between * (1 - 1e-9) - far_q[:, None] - far_v > bound_q[:, None] * (1 + 1e-9))
    blocks = np.zeros((-(-int(count_q.sum()) // rows_q), -(-int(count_v.sum()) // rows_v)), bool)
    for cell in np.flatnonzero(needed.any(1)):
        reached = np.zeros(blocks.shape[1] + 1, int)
        np.add.at(reached, before_v[needed[cell]] // rows_v, 1)
        np.add.at(reached, (before_v + count_v - 1)[needed[cell]] // rows_v + 1, -1)
        blocks[before_q[cell] // rows_q : (before_q[cell] + count_q[cell] - 1) // rows_q + 1] |= np.cumsum(reached)[:-1] > 0

    def copied(df: DataFrame, rows: int, counts: np.ndarray, before: np.ndarray, pairs: list[tuple[int, int]], own: int, groups: int) -> DataFrame:
        """A copy of each row for every pair of blocks that has its block."""
        cells = spark.createDataFrame([(int(c), int(counts[c]), int(before[c])) for c in np.flatnonzero(counts)], "cell int, cell_rows long, before long")
        of = spark.createDataFrame([(p[own], i) for i, p in enumerate(pairs)], "block long, pair int").groupBy("block").agg(F.collect_list("pair").alias("pairs"))
        block = F.floor((F.col("before") + F.pmod(F.xxhash64("id", "v"), F.col("cell_rows"))) / F.lit(rows)).alias("block")
        placed = df.join(F.broadcast(cells), "cell").select("cell", "bound", "id", "v", block).join(F.broadcast(of), "block")
        return placed.select(F.explode("pairs").alias("pair"), "cell", "bound", "id", "v").repartition(groups, "pair")

    def search(pairs: list[tuple[int, int]]) -> DataFrame:
        groups = max(1, 2 * len(pairs))
        few = copied(asked, rows_q, count_q, before_q, pairs, 0, groups)
        many = copied(table, rows_v, count_v, before_v, pairs, 1, groups)
        return met(few, many)

    pairs = [(int(q), int(v)) for q, v in np.argwhere(blocks)]
    some = max(ROUND, 4 * blocks.shape[1])
    if len(pairs) <= some:
        return search(pairs)
    return best_of(reduce(DataFrame.unionByName, [written(search(pairs[at : at + some]), "nearest") for at in range(0, len(pairs), some)]))


def with_cache(entries: DataFrame, cache: DataFrame, key: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached embedding, misses) of entries by content hash."""
    # Dealt anew after the aggregation, so that Spark can split a hot key's entries in the join.
    known = cache.select(key, F.col("embedding").alias("embedding")).dropDuplicates([key]).hint("rebalance")
    return entries.join(known, key), entries.join(known, key, "left_anti")


def repeat_hits(df: DataFrame, key, order: str) -> DataFrame:
    """Adds ``hit``: does an earlier row have the same key? Null keys are equal."""
    keyed = df.withColumn("__key", F.struct(key))
    first = keyed.groupBy("__key").agg(F.min(order).alias("__first")).hint("rebalance")  # a hot key can then be split in the join
    return keyed.join(first, "__key").withColumn("hit", F.col("__first") < F.col(order)).drop("__key", "__first")
