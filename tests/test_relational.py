"""Graphs, scans, intervals, trees, streams and searches against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from syntarel import storage
from syntarel.functions import embeddings
from syntarel.operators import dataflow, graph, intervals, ordering, search, tree
from syntarel.sources import markup
from syntarel.streaming import keyed


def plain_closure(edges, seeds, backward):
    out, level = {}, [(g, n) for g, n in seeds if g is not None and n is not None]
    k = 0
    while level:
        for x in level:
            out.setdefault(x, k)
        k += 1
        level = {(g, (a if backward else b)) for h, n in level for g, a, b in edges if g == h and (b if backward else a) == n and (a if backward else b) is not None} - set(out)
    return out


@pytest.mark.parametrize("backward", [False, True])
def test_closure_of_any_graph(spark, backward):
    rng = random.Random(3)
    edges = [(rng.choice("stu"), rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [("s", k, k + 1) for k in range(100, 106)] + [("s", 106, 100), ("s", 1, 1), ("s", None, 2), ("s", 2, None), (None, 1, 2)]
    edges += edges[:9]
    seeds = [("s", 3), ("s", 3), ("s", 103), ("t", 7), ("u", 99), (None, 1), ("s", None)]
    got = graph.closure(spark.createDataFrame(edges, "g string, src long, dst long"), spark.createDataFrame(seeds, "g string, node long"), ["g"], backward).collect()
    assert len(got) == len({(r.g, r.node) for r in got})
    assert {(r.g, r.node): r.round for r in got} == plain_closure(edges, set(seeds), backward)


def test_closure_of_nothing(spark):
    edges = spark.createDataFrame([], "g string, src long, dst long")
    assert graph.closure(edges, spark.createDataFrame([], "g string, node long"), ["g"]).count() == 0
    assert [tuple(r) for r in graph.closure(edges, spark.createDataFrame([("a", 5)], "g string, node long"), ["g"]).collect()] == [("a", 5, 0)]


def test_reaching_definitions_of_a_hot_scope(spark, monkeypatch):
    """One user has nine tenths of all rows: every range holds its share, and definitions are carried over ranges without one."""
    rng = random.Random(4)
    rows = [(rng.choice([1] * 9 + [2, 3]), t, rng.random() < (0.004 if t > 300 else 0.3)) for t in range(4000)]
    df = spark.createDataFrame(rows, "u long, t long, d boolean").withColumns({"name": F.lit("x"), "__range": F.lit(7)}).drop("__range")
    seen = []
    monkeypatch.setattr(dataflow, "written", lambda x, name: seen.append(storage.written(x, name)) or seen[-1])
    got = {(r.u, r.t): r.reaching for r in dataflow.reaching_definitions(df, ["u"], "name", ~F.col("d"), ["t"], F.col("t")).collect()}
    want, last = {}, {}
    for u, t, d in rows:
        if d:
            last[u] = t
        elif u in last:
            want[u, t] = last[u]
    assert got == want
    counts = [r["count"] for r in seen[0].groupBy("__range").count().collect()]
    assert max(counts) < 2 * sum(counts) / len(counts) and len(counts) >= 3


def test_chains_of_a_hot_scope(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.choice("xyz"), t // 3, t, 10_000 - t) for t in range(2000)]
    df = spark.createDataFrame(rows, "u string, kind string, at long, t long, id long").repartition(5)
    for keys, got in ((1, graph.chain_edges(df, ["u"], ["at", "t"], "id")), (2, graph.last_of_kind_edges(df, ["u"], "kind", ["at", "t"], "id"))):
        want, last = [], {}
        for r in rows:
            if r[:keys] in last:
                want.append((r[0], last[r[:keys]], r[4], *([r[1]] if keys == 2 else [])))
            last[r[:keys]] = r[4]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert graph.chain_edges(df.limit(0), ["u"], ["t"], "id").count() == 0


def test_ordinals_of_nulls_and_texts(spark):
    df = spark.createDataFrame([(f"k{i % 97:02d}{i}",) for i in range(300)] + [(None,)], "k string").withColumn("ordinal", F.lit("old"))
    got = [r.ordinal for r in ordering.with_ordinal(df, "k").orderBy(F.asc_nulls_last("k")).collect()]
    assert got == list(range(301))
    assert ordering.with_ordinal(df.limit(0), "k").count() == 0


def test_nearest_by_cells(spark, monkeypatch):
    """Far clusters are skipped; a hot cell of equal vectors is many blocks; ties go by id."""
    monkeypatch.setattr(search, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(search, "CELL", 100)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 12)) * 20
    rows = [(i, (centres[i % 8] + rng.standard_normal(12) * 0.3).tolist()) for i in range(1200)] + [(2000 + i, [1.0] * 12) for i in range(700)] + [(5000, None), (None, [0.0] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked, counted = vectors.where("vec_id % 20 = 0"), spark.sparkContext.accumulator(0)
    got = {}
    for r in search.nearest_each(vectors, asked, 5, compared=counted).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    live = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    queries = [(i, v) for i, v in live if i % 20 == 0]
    assert set(got) == {i for i, _ in queries}
    for i, q in queries:
        want = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in live)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want] and [d for d, _ in sorted(got[i])] == pytest.approx([d for d, _ in want])
    assert 0 < counted.value < 0.5 * len(live) * len(queries)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert search.nearest_each(few, few, 5).count() == 9
    assert search.nearest_each(few.limit(0), few, 5).count() == 0


def test_nearest_copies_few_rows(spark, monkeypatch):
    """In random directions no cell can be left out; a query is then copied to the blocks of vectors, however many cells they have."""
    monkeypatch.setattr(search, "VECTOR_BLOCK", 500)
    monkeypatch.setattr(search, "CELL", 20)
    v = np.random.default_rng(4).standard_normal((2000, 32))
    v /= np.sqrt((v * v).sum(1))[:, None]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    asked = vectors.where("vec_id % 5 = 0")
    before, threshold = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = search.nearest_each(vectors, asked, 3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # A copy of the vectors for each block of queries, and one of the queries, a fifth as many, for each of four blocks of vectors.
    assert shuffled() - before < 10 * v.nbytes
    want = {(q, int(i)) for q in range(0, 2000, 5) for i in ((v - v[q]) ** 2).sum(1).argsort()[:3]}
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == 1200


def test_nearest_of_odd_vectors(spark, monkeypatch):
    """Numbers that aren't finite come last, by id; many copies, repeated ids, far and tiny and huge numbers, groups in rounds."""
    rng = np.random.default_rng(5)
    small = rng.standard_normal((300, 6))
    odd = small.copy()
    odd[7], odd[20, 2], odd[33, 1], odd[40, 0] = np.nan, np.nan, np.inf, 1e200
    many = np.repeat(rng.standard_normal((4, 6)), [250, 30, 10, 10], 0) + 1e7
    mixed = np.concatenate([small[:75] * 1e-30, small[75:150] * 1e-3 + 1e9, small[150:225] * 1e14, small[225:]])
    for block, rows, k in ((60, odd, 4), (60, odd[[7, 20, 40, 8]], 6), (10_000, odd, 4), (60, many, 12), (60, mixed, 4), (60, many.astype(np.float32), 4)):
        monkeypatch.setattr(search, "VECTOR_BLOCK", block)
        monkeypatch.setattr(search, "CELL", 15)
        monkeypatch.setattr(search, "QUERY_BLOCK", 1)
        monkeypatch.setattr(search, "ROUND", 2)
        ids = [i if i % 50 else 1 for i in range(len(rows))]
        kind = "float" if rows.dtype == np.float32 else "double"
        vectors = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows, strict=True)], f"vec_id long, embedding array<{kind}>").repartition(3)
        got = {}
        for r in search.nearest_each(vectors, vectors.where("vec_id % 2 = 1" if len(rows) > 4 else "true"), k).collect():
            got.setdefault(r.query_id, []).append((np.isnan(r.distance), r.distance if r.distance == r.distance else 0.0, r.vec_id))
        want = {}
        for i, q in zip(ids, rows.astype(float), strict=True):
            if i % 2 == 1 or len(rows) == 4:
                with np.errstate(all="ignore"):
                    d = np.sqrt(np.cumsum((rows.astype(float) - q) ** 2, 1)[:, -1])
                want.setdefault(i, []).extend((np.isnan(x), x if x == x else 0.0, j) for x, j in zip(d.tolist(), ids, strict=True))
        assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:k] for q, x in want.items()}


def test_inside_and_unions_of_ranges(spark):
    rng = random.Random(6)
    ranges = [(rng.choice([0, 0, 0, 0, 1, None]), a := rng.randrange(-500, 3000), a + rng.choice([0, 3, 40, -2])) for _ in range(900)] + [(0, None, 5), (0, 5, None), (0, 10, 10), (0, 10, 10)]
    points = [(rng.choice([0, 0, 1, None]), rng.randrange(-600, 3100)) for _ in range(400)] + [(0, None)]
    r = spark.createDataFrame(ranges, "g int, low long, high long")
    p = spark.createDataFrame(points, "g int, at long")
    got = sorted((x.g, x.low, x.high, x.at) for x in intervals.inside(p, r, ["g"], "at", "low", "high", 64).collect())
    assert got == sorted((g, a, b, t) for g, a, b in ranges for h, t in points if None not in (g, a, b, t) and g == h and a <= t <= b)
    for apart in (0, 1, 15):
        want, ends = [], {}
        for g, a, b in sorted((x for x in ranges if x[1] is not None and x[2] is not None and x[1] <= x[2]), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
            if g in ends and a <= want[ends[g]][2] + apart:
                w = want[ends[g]]
                want[ends[g]] = (g, w[1], max(w[2], b), w[3] + 1)
            else:
                ends[g] = len(want)
                want.append((g, a, b, 1))
        found = [tuple(x) for x in intervals.union_ranges(r.repartition(3), ["g"], "low", "high", apart).collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert intervals.union_ranges(r.limit(0), ["g"], "low", "high").count() == 0


HTML = '<!DOCTYPE html><html><head><meta a="1"><script>var x = "<p></p>";</script><style>b{}</style></head><body><!-- <p> --><p>one<p>two<b>x</p></b></i><br/><div><img></div>'


def test_markup_is_nested_sets():
    rows = markup.elements(HTML)
    assert [(r[4], r[3]) for r in rows] == [("html", 0), ("head", 1), ("meta", 2), ("script", 2), ("style", 2), ("body", 1), ("p", 2), ("p", 3), ("b", 4), ("br", 3), ("div", 3), ("img", 4)]
    for pre, last, parent, depth, _ in rows:
        assert pre <= last < len(rows) and (parent == -1 or rows[parent][0] < pre <= last <= rows[parent][1] and rows[parent][3] + 1 == depth)
    assert markup.elements(None) == markup.elements("no tags < at all") == []


def test_pages_are_chosen_below_the_table_function(spark, tmp_path):
    spark.createDataFrame([(1, "x", HTML), (2, "y", "<p>"), (3, "z", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    nodes = markup.page_nodes(pages)
    assert nodes.columns == ["page_id", "url", "pre", "last", "parent", "depth", "tag"] and nodes.count() == 13
    few = markup.page_nodes(pages.select("page_id", "html"), where="page_id = 2")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in few.collect()] == [(2, 0, 0, -1, 0, "p")]
    assert plan.index("EvalPythonUDTF") < plan.index("PushedFilters: [IsNotNull(page_id), EqualTo(page_id,2)]") and "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_tree_lines_are_those_of_the_walk(spark):
    rng = random.Random(9)
    paths = {"/".join(rng.choice(["a", "B", "b", "_c", "é"]) for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".ts"]) for _ in range(120)}
    nodes = tree.file_tree(spark.createDataFrame([(p,) for p in paths], "path string"))
    lines = [r.line for r in tree.tree_lines(nodes).orderBy("places").collect()]
    assert "\n".join(lines) == tree.render_tree([r.asDict() for r in nodes.collect()])
    by_code = tree.file_tree(spark.createDataFrame([("b",), ("B",), ("a",), ("A",)], "path string"), locale=False)
    assert [r.name for r in by_code.orderBy("position").collect()] == ["A", "B", "a", "b"]


def test_state_by_key_over_late_and_repeated_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(1000), k * 10) for k in range(400)]
    schema = "id long, key string, at long, value long"
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 110] + rows[:5], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        assert keyed.latest_by_key(stream, ["key"], ["at", "id"], ["id", "value"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(200) in (True, None)
        return {r.key: (r.id, r.value) for r in keyed.current(spark, f"{tmp_path}/out", ["key"]).collect()}

    want = lambda: {k: max((r[2], r[0], r[3]) for r in rows if r[1] == k)[1:] for k in ("a", "b", None)}
    assert run() == want()
    rows.append((900, "b", 5000, 1))
    spark.createDataFrame([rows[-1], (901, "a", -5, 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    assert run() == want()  # started again from its checkpoint, with the state of before


def test_batches_in_flight(spark):
    class Slow:
        def embed_batch(self, texts):
            time.sleep(0.2)
            return [[float(len(t)), 1.0] for t in texts]

    texts = ["x" * (k % 50) for k in range(24 * 8)]
    began = time.perf_counter()
    got = embeddings.in_batches(texts, Slow(), 8)
    assert [v[0] for v in got] == [len(t) for t in texts] and time.perf_counter() - began < 0.4 * 24 * 0.2

    class Failing(Slow):
        left = 2

        def embed_batch(self, texts):
            if self.left:
                self.left -= 1
                raise OSError("busy")
            return [[1.0] for _ in texts]

    assert embeddings.in_batches(["a"], Failing(), wait=0.01) == [[1.0]]
    always = Failing()
    always.left = 99
    with pytest.raises(OSError):
        embeddings.in_batches(["a"], always, wait=0.01)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    assert sorted(r.v[0] for r in df.select(embeddings.embedding("t", Slow(), 8).alias("v")).collect()) == sorted([len(t) for t in texts] + [0])
