"""Peak concurrency: how many spans are open at every moment, by step functions.

A step function is compact: the moments at which it changes, with the change
there. Each task turns the spans that it happens to hold into such functions,
cut at fixed ranges of time; functions of two tasks at a time are added, level
by level, until one is left for every key and range. A range has at most
RANGE / STEP moments, so no function grows with the input.

Ranges are then stitched by a carry scan over a tree: 256 ranges make a block,
256 blocks a larger one, and so on. Sums go up the tree, and what holds before
a range (open spans, amount, highest count so far) and after it (the next
moment) comes down, so every window sees 256 rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release

#: Seconds between moments, and of a range.
STEP, RANGE = 900, 86_400
#: Ranges of a block, and levels of blocks: together all times that a timestamp can hold.
FAN, LEVELS = 256, 3
#: Keys of spans without one, and of all spans together.
NOWHERE, EVERYWHERE = -1, -2


def moment_of(df: DataFrame, name: str) -> Column:
    """UTC seconds since 1970 of a timestamp, rounded down to STEP; without a zone it is taken as UTC, whatever the session's zone."""
    at = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        seconds = F.unix_seconds(at)
    else:
        seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))
    return (seconds - F.pmod(seconds, F.lit(STEP))).cast("long")


def sale_spans(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 0) -> DataFrame:
    """key int, start, end (null: never ends) and amount (cents) of every sale that is open for some moment.

    A sale ends ``days`` after the latest ``shipped_at`` of its lines. Its key is the
    client's nation, NOWHERE if that is null or the client unknown; of a client
    with several rows the least nation counts. Sales without an id have no lines;
    repeated sales count repeatedly.
    """
    # Aggregated sides are dealt anew, so that Spark can split the sales of a hot client or id in the joins.
    last = lines.where("sale_id is not null").groupBy("sale_id").agg(F.max(moment_of(lines, "shipped_at")).alias("shipped")).hint("rebalance")
    nations = clients.where("client_id is not null").groupBy("client_id").agg(F.min(F.col("nation_id").cast("int")).alias("nation")).hint("rebalance")
    cents = F.when(F.isnan(F.col("total").cast("double")), 0).otherwise(F.coalesce(F.floor(F.lit(100) * F.col("total").cast("double") + 0.5).cast("long"), F.lit(0)))
    sold = sales.select("sale_id", "client_id", moment_of(sales, "sold_at").alias("start"), cents.cast("long").alias("amount")).where("start is not null")
    joined = sold.join(last, "sale_id", "left").select("client_id", "start", (F.col("shipped") + 86_400 * days).alias("end"), "amount").where("end is null or end > start")
    return joined.join(nations, "client_id", "left").select(F.coalesce("nation", F.lit(NOWHERE)).alias("key"), "start", "end", "amount")


def step_functions(spans: DataFrame, parts: int) -> DataFrame:
    """key, range, at, n, amount: the changes of each key's function, those that are not zero.

    ``parts`` tells how many functions of a key and range may be there at first (a
    power of two is next); which spans share one doesn't matter.
    """
    opens = F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("n"), F.col("amount").alias("amount"))
    closes = F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("n"), (-F.col("amount")).alias("amount"))
    changes = spans.select("key", F.explode(F.when(F.col("end").isNull(), F.array(opens)).otherwise(F.array(opens, closes))).alias("c")).select("key", "c.*")
    levels = max(1, (max(1, parts) - 1).bit_length())
    functions = changes.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(1 << levels))).withColumn("range", F.floor(F.col("at") / RANGE))
    for _ in range(levels):
        # Sums within a task come before the shuffle: the first level's are the functions of the tasks.
        halved = functions.withColumn("part", F.shiftright("part", 1))
        functions = halved.groupBy("key", "range", "part", "at").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    return functions.where("n <> 0 or amount <> 0").drop("part")


def _with_total(functions: DataFrame) -> DataFrame:
    """The functions of all keys, and their sum as that of EVERYWHERE."""
    twice = functions.select("*", F.explode(F.array("key", F.lit(EVERYWHERE))).alias("whose")).drop("key")
    return twice.groupBy(F.col("whose").alias("key"), "range", "at").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")).where("n <> 0 or amount <> 0")


def _carries(nodes: DataFrame) -> DataFrame:
    """key, range and what holds around each range: before_n, before_amount, before_high (null at first), next.

    ``nodes``: key, range, n, amount (net changes), high (the largest sum of the
    first changes of n), first (moment).
    """
    tree = [nodes]
    for _ in range(LEVELS):
        ordered = W.partitionBy("key", "parent").orderBy("range")
        below = tree[-1].withColumn("parent", F.floor(F.col("range") / FAN)).withColumn("top", F.coalesce(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("high"))
        tree.append(below.groupBy("key", F.col("parent").alias("range")).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.max("top").alias("high"), F.min("first").alias("first")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    carry = None
    for level in reversed(tree):
        if carry is None:  # the roots: nothing before, nothing after
            joined = level.withColumns({"parent": zero, "n0": zero, "amount0": zero, "high0": none, "next0": none})
        else:
            joined = level.withColumn("parent", F.floor(F.col("range") / FAN)).join(carry, ["key", "parent"])
        ordered = W.partitionBy("key", "parent").orderBy("range")
        before, after = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(1, W.unboundedFollowing)
        summed = joined.withColumns({"before_n": F.col("n0") + F.coalesce(F.sum("n").over(before), zero), "before_amount": F.col("amount0") + F.coalesce(F.sum("amount").over(before), zero)})
        highest = F.max(F.col("before_n") + F.col("high")).over(before)
        found = summed.withColumns({"before_high": F.greatest("high0", highest), "next": F.coalesce(F.min("first").over(after), "next0")})
        carry = found.select("key", F.col("range").alias("parent"), F.col("before_n").alias("n0"), F.col("before_amount").alias("amount0"), F.col("before_high").alias("high0"), F.col("next").alias("next0"))
    return carry.select("key", F.col("parent").alias("range"), F.col("n0").alias("before_n"), F.col("amount0").alias("before_amount"), F.col("high0").alias("before_high"), F.col("next0").alias("next"))


def open_spans(spans: DataFrame) -> DataFrame:
    """key, from_s, to_s, n_open, open_amount, high_open, is_peak: a row per key and moment at which the open spans or their amount change; EVERYWHERE is the key of all.

    ``spans``: key (int), start, end (moments as longs; null: never ends) and amount.
    Spans that end when or before they start and those without a start or key take
    no part; a null amount is 0. Repeated spans count repeatedly; changes that cancel
    each other out make no row. No spans, no rows. Further columns are left out.
    """
    clean = spans.select("key", "start", "end", F.coalesce("amount", F.lit(0)).cast("long").alias("amount")).where("key is not null and start is not null and (end is null or end > start)")
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    functions = materialize(_with_total(step_functions(clean, parts)), "steps")
    inside = W.partitionBy("key", "range").orderBy("at")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = functions.withColumns({"sum_n": F.sum("n").over(upto), "sum_amount": F.sum("amount").over(upto), "after": F.lead("at").over(inside)}).withColumn("top", F.max("sum_n").over(upto))
    nodes = rows.groupBy("key", "range").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.max("sum_n").alias("high"), F.min("at").alias("first"))
    # One row per key and range, whatever the input's size.
    nodes = materialize(nodes, "ranges")
    carry = materialize(_carries(nodes).join(nodes.select("key", "range", "high"), ["key", "range"]), "carries")
    release(nodes)
    peak = carry.groupBy("key").agg(F.max(F.col("before_n") + F.col("high")).alias("peak"))
    whole = rows.join(carry.drop("high"), ["key", "range"]).join(peak, "key")
    n_open = F.col("before_n") + F.col("sum_n")
    high = F.greatest("before_high", F.col("before_n") + F.col("top"))
    return whole.select("key", F.col("at").alias("from_s"), F.coalesce("after", "next").alias("to_s"), n_open.alias("n_open"), (F.col("before_amount") + F.col("sum_amount")).alias("open_amount"), high.alias("high_open"), (n_open == F.col("peak")).alias("is_peak"))


def open_sales_sql() -> str:
    """The DuckDB statement of open sales by nation."""
    moment = "(epoch_us({0}) // 1000000 // 900 * 900)::bigint"
    return f"""with l as (select sale_id, max({moment.format("shipped_at")}) as shipped from sale_lines where sale_id is not null group by sale_id),
    c as (select client_id, min(nation_id) as nation from clients where client_id is not null group by client_id),
    s as (select coalesce(c.nation, -1) as nation, {moment.format("sold_at")} as start, l.shipped as stop, coalesce(floor(100 * total + 0.5)::bigint, 0) as cents from sales left join l using (sale_id) left join c using (client_id) where sold_at is not null),
    k as (select * from s where stop is null or stop > start), b as (select * from k union all select -2, start, stop, cents from k),
    e as (select nation, start as moment, 1 as n, cents from b union all select nation, stop, -1, -cents from b where stop is not null),
    f as (select nation, moment, sum(n)::bigint as n, sum(cents)::bigint as cents from e group by all having sum(n) <> 0 or sum(cents) <> 0),
    o as (select nation, moment, lead(moment) over w as to_s, (sum(n) over w)::bigint as n_open, (sum(cents) over w)::bigint as open_cents from f window w as (partition by nation order by moment))
    select nation::int as nation_id, moment as from_s, to_s, n_open, open_cents, max(n_open) over (partition by nation order by moment) as high_open, n_open = max(n_open) over (partition by nation) as is_peak from o"""
