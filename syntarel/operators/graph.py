"""Graphs as edge tables: chains, incidence, and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Buckets, scratch, written


def _neighbours(df: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """(keys, src, dst): each node and the next one of its keys by ``order``.

    A segmented scan: rows are dealt to ranges of (keys, order), so a hot key lies in many.
    Neighbours within a range are a window; the last node of a key in a range goes on to
    its first one in the next range that has any, one row a key and range. Null keys are one key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, places = [f"k{k}" for k in range(len(keys))], [f"o{k}" for k in range(len(order))]
    plain = df.select(*[F.col(c).alias(n) for c, n in zip([*keys, *order], [*names, *places], strict=True)], F.col(node).alias("src"))
    dealt = written(plain.repartitionByRange(parts, *names, *places).withColumn("part", F.spark_partition_id()), "neighbours")
    inside = W.partitionBy("part", *names).orderBy(*places)
    near = dealt.select(*names, "src", F.lead("src").over(inside).alias("dst")).where("dst is not null")
    place = F.struct(*places)
    ends = dealt.groupBy("part", *names).agg(F.min_by("src", place).alias("head"), F.max_by("src", place).alias("src"))
    far = ends.select(*names, "src", F.lead("head").over(W.partitionBy(*names).orderBy("part")).alias("dst")).where("dst is not null")
    return near.unionByName(far).select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "src", "dst")


def chain_edges(df: DataFrame, scope: list[str], order: list[str], node: str) -> DataFrame:
    """(scope, src, dst): each node and the next one by ``order``, which is unique in a scope."""
    return _neighbours(df, scope, order, node)


def last_of_kind_edges(df: DataFrame, scope: list[str], kind: str, order: list[str], node: str) -> DataFrame:
    """(scope, src, dst, label): each node and the one of its kind before it."""
    return _neighbours(df, [*scope, kind], order, node).select(*scope, "src", "dst", F.col(kind).alias("label"))


def dependencies(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that meet a target (column ``node``), by bucket ``<dep>_in`` or ``<dep>_out``; an edge can be in both."""
    one = targets.select("node").distinct()
    into = edges.join(one.withColumnRenamed("node", "dst"), "dst", "left_semi").withColumn("bucket", F.concat("dep", F.lit("_in")))
    out = edges.join(one.withColumnRenamed("node", "src"), "src", "left_semi").withColumn("bucket", F.concat("dep", F.lit("_out")))
    return into.unionByName(out)


def closure(edges: DataFrame, seeds: DataFrame, scope: list[str], backward: bool = False) -> DataFrame:
    """(scope, node, round): all nodes that the scope's seeds lead to, seeds (round 0) included, against the edges if ``backward``; ``round`` is the least number of edges.

    ``edges``: scope columns, src, dst; ``seeds``: scope columns, node. Any graph, cycles and
    parallel edges included; edges and seeds with a null anywhere don't count. Semi-naive rounds: only the rows that the last round
    has found meet the edges, and what is known already is taken off. A round is
    one job; there are as many as the longest shortest way, and one more.

    What is reached lies in buckets by scope and node, so a round shuffles its candidates
    only. The edges are written once, in their narrow form; a hot node's are split by Spark
    where the rows of a round are too many to be broadcast.
    """
    spark = edges.sparkSession
    src, dst = ("dst", "src") if backward else ("src", "dst")
    names = [f"s{k}" for k in range(len(scope))]
    steps = written(edges.select(*[F.col(c).alias(n) for c, n in zip(scope, names, strict=True)], F.col(src).alias("node"), F.col(dst).alias("next")).na.drop(), "edges")
    first = seeds.select(*[F.col(c).alias(n) for c, n in zip(scope, names, strict=True)], "node").na.drop().distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema.fields)
    reached = Buckets(spark, scratch(spark, "reached"), f"{kinds}, round int", [*names, "node"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    found, number = reached.append(first.withColumn("round", F.lit(0))), 0
    while found:
        frontier = reached.read().where(F.col("round") == number).drop("round")
        number += 1
        candidates = frontier.join(steps, [*names, "node"]).select(*names, F.col("next").alias("node")).distinct()
        new = candidates.join(reached.read().drop("round"), [*names, "node"], "left_anti")
        found = reached.append(new.withColumn("round", F.lit(number)), dealt=True)
    return reached.forget().select(*[F.col(n).alias(c) for c, n in zip(scope, names, strict=True)], "node", "round")


def reachable(edges: DataFrame, seeds: DataFrame, scope: str, backward: bool = False) -> DataFrame:
    """(scope, node): :func:`closure` in one scope column, without the rounds. Long chains go faster through :func:`along_chains`."""
    return closure(edges, seeds, [scope], backward).drop("round")


def along_chains(df: DataFrame, seeds: DataFrame, scope: list[str], kind: str, order: list[str], node: str, backward: bool = False) -> DataFrame:
    """(scope, node): what seeds (scope, ``kind`` and ``order`` of nodes) lead to along the edges of :func:`last_of_kind_edges`, seeds included, against them if ``backward``.

    The edges of one kind in a scope are a chain, so that what is reached is all
    nodes of the chain up to its last seed (from its first one on, forward): one
    bound a chain, and a join that Spark can split where a scope is hot.
    """
    at = F.struct(*order)
    bound = seeds.groupBy(*scope, kind).agg((F.max if backward else F.min)(at).alias("__bound"))
    reached = df.select(*scope, kind, F.col(node).alias("node"), at.alias("__at")).join(bound, [*scope, kind])
    return reached.where(F.col("__at") <= F.col("__bound") if backward else F.col("__at") >= F.col("__bound")).select(*scope, "node")
