"""Queries of the engine's own operators bound to the driver's tables, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embeddings import MockProvider
from ..functions.hashing import hash32_long, mock_embedding, signed_hex
from ..operators import dataflow, graph, intervals, ordering, search, tree
from ..sources import markup
from ..storage import scratch, written
from ..streaming import keyed
from . import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Cases of fixed input with hand-derived rows: for tests, not registered.
FIXTURES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def case(expected: str):
    """Keep a function of fixed input under its name, with the statement of its rows."""

    def add(f):
        FIXTURES[f.__name__] = (f, expected)
        return f

    return add


def query(oracle: str | None = None):
    """Register a function under its name, with its DuckDB statement."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NEAREST_SQL = """(select query_id, vec_id, d from (select q.vec_id as query_id, v.vec_id, list_distance(v.embedding::double[], q.embedding::double[]) as d,
    row_number() over (partition by q.vec_id order by list_distance(v.embedding::double[], q.embedding::double[]), v.vec_id) as place from embeddings v, embeddings q where q.vec_id % 20 = 0) where place <= 10)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.nearest_each(vectors, vectors.where("vec_id % 20 = 0"), 10)


@query(f"select query_id, vec_id, round(d, 6) as distance from {_NEAREST_SQL}")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 20."""
    return _nearest(spark, sf_dir).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"select query_id, vec_id, round(1 - d, 6) as score from {_NEAREST_SQL}")
def knn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "vec_id", F.round(1 - F.col("distance"), 6).alias("score"))


@query("select vec_id, label, round(list_distance(embedding::double[], q), 6) as distance from embeddings, (select embedding::double[] as q from embeddings where vec_id = 0) order by list_distance(embedding::double[], q), vec_id limit 10")
def knn_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single search: the ten rows nearest to one query vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.nearest(vectors, vectors.where("vec_id = 0").select("embedding"), 10).select("vec_id", "label", F.round("distance", 6).alias("distance"))


_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda a, b: (a * 31 + b) % 4294967296)"


@query(f"select doc_id, case when h >= 2147483648 then '-' || lower(format('{{:x}}', 4294967296 - h)) else lower(format('{{:x}}', h)) end as content_hash from (select doc_id, ({_HASH.format('text')})::bigint as h from documents)")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hash32_long("text").alias("h")).select("doc_id", signed_hex(F.col("h")).alias("content_hash"))


_DIMS = 8


def mock_sql(digits: int = 6) -> str:
    states = ["s0 as (select p_partkey, abs(case when h >= 2147483648 then h - 4294967296 else h end)::bigint as s0 from (select p_partkey, (" + _HASH.format("p_name || p_partkey::varchar") + ")::bigint as h from part))"]
    for k in range(1, _DIMS + 1):
        states.append(f"s{k} as (select *, (s{k - 1}::double * 1103515245.0::double + 12345.0::double)::bigint & 2147483647 as s{k} from s{k - 1})")
    values = ", ".join(f"s{k} / 2147483647.0::double * 2 - 1" for k in range(1, _DIMS + 1))
    return f"with {', '.join(states)}, v as (select p_partkey, [{values}]::double[] as v from s{_DIMS}) select p_partkey, (g - 1)::int as dim, round(v[g] / sqrt(list_sum(list_transform(v, lambda x: x * x))), {digits}) as value from v, range(1, {_DIMS + 1}) as r(g)"


@query(mock_sql())
def mock_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", mock_embedding(F.concat("p_name", F.col("p_partkey").cast("string")), _DIMS).alias("v"))
    return part.select("p_partkey", F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("select doc_id, row_number() over (partition by text order by doc_id) > 1 as hit from documents")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.repeat_hits(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id").select("doc_id", "hit")


@query("select doc_id, (doc_id % 4)::int as batch, min(doc_id % 4) over (partition by text) < doc_id % 4 as hit, (select count(distinct text) from documents)::int as cached from documents where text is not null")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches; which of each batch are in the cache already, and what it holds in the end."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    store, out = index.VectorIndex(spark, scratch(spark)), []
    for batch in range(4):
        arrived = docs.where(F.col("doc_id") % 4 == batch).select("doc_id", F.col("text").alias("content"), F.md5("text").alias("hash"))
        found, part = index.embedded(arrived, store, MockProvider(8))
        store.commit(cache=part)
        out.append(found.select("doc_id", F.lit(batch).alias("batch"), "hit"))
    cached = sum(x["rows"] for x in store.manifest()["cache"])
    return reduce(DataFrame.unionByName, out).withColumn("cached", F.lit(cached))


@query("select min(doc_id) as first_position, max(doc_id) as doc_id, arg_max(source, doc_id) as source from documents group by text")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", F.md5("text"))
    return ordering.dedup_last_wins(docs.withColumn("id", F.col("doc_id")), ["key"], "id", ["doc_id", "source"]).drop("key")


@query("select doc_id, len(l) as n_lines, array_to_string(list_slice(l, 1, 8), chr(10)) as content from (select doc_id, string_split(text, chr(10)) as l from documents) where len(l) >= 3")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines before and after line 3."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l")).where("size(l) >= 3")
    first = F.greatest(F.lit(1), F.lit(3 - 5))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_join(F.slice("l", first, F.lit(3 + 5) - first + 1), "\n").alias("content"))


@query("select doc_id, ((row_number() over (order by doc_id) - 1) // 64)::bigint as batch from documents")
def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


@query("select p_partkey, p_name, p_type from part where not contains(lower(p_name), lower('Part 1')) and p_type in (select p_type from (select distinct p_type from part order by p_type limit 2))")
def impact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that don't contain the target, of two types."""
    part = table(spark, sf_dir, "part")
    types = part.select("p_type").distinct().orderBy("p_type").limit(2)
    return part.join(F.broadcast(types), "p_type", "left_semi").where(~F.contains(F.lower("p_name"), F.lower(F.lit("Part 1")))).select("p_partkey", "p_name", "p_type")


@query(
    """select event_id, user_id, def_id from (select *, last_value(case when event_type in ('signup', 'purchase') then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as def_id
    from events where event_type in ('signup', 'purchase', 'view', 'click')) where event_type in ('view', 'click') and def_id is not null"""
)
def reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and purchases define, views and clicks use; the latest definition of the user reaches."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "view", "click")).withColumn("name", F.lit("session"))
    found = dataflow.reaching_definitions(events, ["user_id"], "name", F.col("event_type").isin("view", "click"), ["ts", "event_id"], F.col("event_id"))
    return found.select("event_id", "user_id", F.col("reaching").alias("def_id"))


_SAME_KIND = "e as (select user_id, event_type, event_id, ts, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as src from events)"


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return events, graph.last_of_kind_edges(events, ["user_id"], "event_type", ["ts", "event_id"], "event_id")


def _along(spark: SparkSession, sf_dir: str, backward: bool) -> DataFrame:
    """What each user's last (first) event is led to by (leads to) along events of its kind."""
    events = _steps(spark, sf_dir)[0]
    one = (F.max if backward else F.min)(F.struct("ts", "event_id", "event_type")).alias("x")
    seeds = events.groupBy("user_id").agg(one).select("user_id", "x.*")
    return graph.along_chains(events, seeds, ["user_id"], "event_type", ["ts", "event_id"], "event_id", backward)


@query(f"with {_SAME_KIND}, l as (select user_id, arg_max(event_type, (ts, event_id)) as kind from events group by user_id) select e.user_id, event_id as node from e join l using (user_id) where event_type = kind")
def backward_slice_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _along(spark, sf_dir, backward=True)


@query(f"with {_SAME_KIND}, l as (select user_id, arg_min(event_type, (ts, event_id)) as kind from events group by user_id) select e.user_id, event_id as node from e join l using (user_id) where event_type = kind")
def forward_slice_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _along(spark, sf_dir, backward=False)


_BOTH = f"""{_SAME_KIND}, g as (select src, event_id as dst from e where src is not null union all
    select * from (select event_id as src, lead(event_id) over (partition by user_id order by ts, event_id) as dst from events where value > 40) where dst is not null)"""


@query(
    f"""with recursive {_BOTH}, r as (select user_id, arg_max(event_id, (ts, event_id)) as node, 0 as round from events group by user_id
    union select r.user_id, g.src, r.round + 1 from r join g on g.dst = r.node) select user_id, node, min(round)::int as round from r group by user_id, node"""
)
def backward_slice_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leads to each user's last event, by events of one kind and by neighbours among those of some value: a graph of two kinds of edges, in rounds."""
    events = table(spark, sf_dir, "events")
    data = graph.last_of_kind_edges(events, ["user_id"], "event_type", ["ts", "event_id"], "event_id").drop("label")
    control = graph.chain_edges(events.where("value > 40"), ["user_id"], ["ts", "event_id"], "event_id")
    seeds = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("node"))
    return graph.closure(data.unionByName(control), seeds, ["user_id"], backward=True)


@query("select * from (select user_id, event_id as src, lead(event_id) over (partition by user_id order by ts, event_id) as dst from events) where dst is not null")
def cfg_sequence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain_edges(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@query(
    f"""with {_SAME_KIND}, c as (select event_id as src, lead(event_id) over (partition by user_id order by ts, event_id) as dst from events),
    g as (select src, event_id as dst, 'data' as dep from e where src is not null union all select src, dst, 'control' from c where dst is not null),
    t as (select event_id as node from events where value > 95)
    select bucket, count(*) as edges from (select dep || '_in' as bucket from g where dst in (select node from t) union all select dep || '_out' from g where src in (select node from t)) group by bucket"""
)
def dependencies_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, steps = _steps(spark, sf_dir)
    data = steps.select("src", "dst", F.lit("data").alias("dep"))
    control = graph.chain_edges(events, ["user_id"], ["ts", "event_id"], "event_id").select("src", "dst", F.lit("control").alias("dep"))
    targets = table(spark, sf_dir, "events").where("value > 95").select(F.col("event_id").alias("node"))
    return graph.dependencies(data.unionByName(control), targets).groupBy("bucket").agg(F.count("*").alias("edges"))


@query("select doc_id, g::int as line, l[g] as code from (select doc_id, string_split(text, chr(10)) as l from documents), range(2, 5) as r(g) where g <= len(l)")
def slice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "code"))
    return lines.where("p between 1 and 3").select("doc_id", (F.col("p") + 1).alias("line"), "code")


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as module from pages")
def import_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("module"))


_MARKUP = r"""with recursive t as (select page_id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(html, '(<(script|style)[^>]*>)[^<]*("</p>")?[^<]*</(script|style)>', '\1</\4>', 'g'), '<!--.*?-->', '', 'gs'), '</?[a-zA-Z][a-zA-Z0-9]*'), lambda x: true) as tags from pages),
    w as (select page_id, tags, 0 as i, 0 as n, []::struct(p int, t varchar)[] as stack, null::int as pre, null::varchar as tag, []::int[] as above from t
      union all select page_id, tags, i + 1, n + (case when closes then 0 else 1 end), case when closes then (case when place > 0 then stack[1:place - 1] else stack end) when name in ('meta', 'br') then stack else list_append(stack, {'p': n, 't': name}) end,
      case when closes then null else n end, name, list_transform(stack, lambda x: x.p) from (select *, list_aggregate(list_transform(range(1, len(stack) + 1), lambda k: case when stack[k].t = name then k else 0 end), 'max') as place
        from (select *, tags[i + 1][2] = '/' as closes, lower(ltrim(tags[i + 1], '</')) as name from w where i < len(tags)))),
    e as (select page_id, pre, tag, above from w where pre is not null), b as (select page_id, unnest(above) as pre, tag from e)"""


@query(f"{_MARKUP} select e.page_id, e.pre, e.tag, len(e.above)::int as depth, count(b.tag) as inside, count(*) filter (b.tag = 'a') as links from e left join b on b.page_id = e.page_id and b.pre = e.pre group by all")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every page with its depth and how many elements, and links, lie inside of it: nested sets and an interval join."""
    nodes = written(markup.page_nodes(table(spark, sf_dir, "pages").select("page_id", "html")), "markup")
    ranges = nodes.where("last > pre").select("page_id", F.col("pre").alias("outer"), (F.col("pre") + 1).alias("low"), F.col("last").alias("high"))
    pairs = intervals.inside(nodes.select("page_id", "pre", "tag"), ranges, ["page_id"], "pre", "low", "high")
    counts = pairs.groupBy("page_id", F.col("outer").alias("pre")).agg(F.count("*").alias("inside"), F.count_if(F.col("tag") == "a").alias("links"))
    return nodes.select("page_id", "pre", "tag", "depth").join(counts, ["page_id", "pre"], "left").fillna(0, ["inside", "links"])


@query(f"{_MARKUP} select page_id, tag, count(*) as n, max(len(above))::int as deepest from e where page_id % 3 = 1 and tag in ('p', 'li', 'b') group by page_id, tag")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, items and bold parts of every third page: the pages are chosen below the table function."""
    nodes = markup.page_nodes(table(spark, sf_dir, "pages").select("page_id", "html"), where="page_id % 3 = 1").where("tag in ('p', 'li', 'b')")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query(
    """with r as (select l_partkey, (o_orderdate::date - date '1970-01-01') as a, (l_shipdate::date - date '1970-01-01') as b from lineitem join orders on o_orderkey = l_orderkey where o_orderdate <= l_shipdate and l_shipdate::date - o_orderdate::date < 60),
    s as (select *, case when a > 1 + max(b) over (partition by l_partkey order by a, b rows between unbounded preceding and 1 preceding) then 1 else 0 end as begins from r),
    n as (select *, sum(begins) over (partition by l_partkey order by a, b, begins desc rows unbounded preceding) as number from s) select l_partkey, min(a)::bigint as first_day, max(b)::bigint as last_day, count(*) as ranges from n group by l_partkey, number"""
)
def part_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which each part is between order and shipment, as unions of the lines' ranges."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(orders, "l_orderkey").where("o_orderdate <= l_shipdate")
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    days = lines.select("l_partkey", day("o_orderdate").alias("first_day"), day("l_shipdate").alias("last_day")).where("last_day - first_day < 60")
    return intervals.union_ranges(days, ["l_partkey"], "first_day", "last_day")


_TREE = """u as (select distinct list_filter(string_split(regexp_replace(url, '^[^:]*://', ''), '/'), lambda x: x <> '') as parts from pages), d as (select unnest(range(1, len(parts) + 1)) as k, parts from u),
    n as (select array_to_string(list_slice(parts, 1, k), '/') as path, array_to_string(list_slice(parts, 1, k - 1), '/') as parent_path, parts[k] as name, (k - 1)::int as depth, bool_or(k < len(parts)) as is_directory from d group by all),
    f as (select *, row_number() over (partition by parent_path order by is_directory desc, name)::int as position, row_number() over (partition by parent_path order by is_directory desc, name) = count(*) over (partition by parent_path) as is_last from n)"""


@query(f"with {_TREE} select * from f")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all pages' addresses, siblings by code."""
    return tree.file_tree(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[^:]*://", "").alias("path")), locale=False)


@query(
    f"""with {_TREE}, a as (select f.path, f.name, f.is_directory, list(g.position order by g.depth) as places, list(g.is_last order by g.depth) as lasts from f join f g on f.path = g.path or starts_with(f.path, g.path || '/') group by all)
    select (row_number() over (order by places) - 1)::bigint as place, path, array_to_string(list_transform(lasts[1:len(lasts) - 1], lambda x: case when x then '    ' else '│   ' end), '') || case when lasts[-1] then '└── ' else '├── ' end || name || case when is_directory then '/' else '' end as line from a"""
)
def tree_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all pages' addresses as numbered lines."""
    nodes = written(file_tree(spark, sf_dir), "tree")
    return ordering.with_ordinal(tree.tree_lines(nodes), "places", "place").select("place", "path", "line")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by user_id, event_type")
def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and kind, kept as state while events arrive in four batches, out of order."""
    root = scratch(spark, "events")
    arrives = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    arrives.repartition(4, "batch").sortWithinPartitions("batch").write.partitionBy("batch").parquet(f"{root}/in")
    stream = spark.readStream.schema(arrives.drop("batch").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    keyed.latest_by_key(stream, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"], f"{root}/out", f"{root}/state").awaitTermination()
    return keyed.current(spark, f"{root}/out", ["user_id", "event_type"])


@query(
    """select callee, s[1] as conv_id, s[2] as turn, s[3] as position from (select callee, min([conv_id, turn, pos]) as s from
    (select conv_id, turn, unnest(w) as callee, unnest(range(1, len(w) + 1)) - 1 as pos from (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') as w from conversations)) group by callee)"""
)
def call_graph_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all conversations with the place where each is seen first."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("pos", "callee"))
    return ordering.distinct_first_seen(words, "callee", ["conv_id", "turn", "pos"]).select("callee", "first_seen.conv_id", "first_seen.turn", F.col("first_seen.pos").cast("long").alias("position"))


@query("select distinct p_name as name from part where p_name not in ('constructor', 'toString', 'valueOf')")
def define_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).where(~F.col("name").isin("constructor", "toString", "valueOf")).distinct()


@query("select user_id, event_type, min(event_id) as first, array_to_string(list_sort(list(event_id)), ',') as refs from events group by user_id, event_type")
def variables_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataflow.group_references(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")
    return found.select("user_id", "event_type", "first", F.array_join(F.col("all").cast("array<string>"), ",").alias("refs"))


@query("select event_id, (props->>'k')::int as k from events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
