"""Queries over a small project that they write first: scans, renderers, the index, settings and streams, with hand-derived rows as their statements."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import embeddings
from ..functions.hashing import hash32, signed_hex
from ..operators import code, tree
from ..sources import ast_table
from ..streaming import incremental
from . import index, render
from .code_queries import FIXTURES, _golden, _nodes, _pdg, _refs, fixture_sources, values
from ..storage import scratch
from .table_queries import case, mock_sql, query, table

#: Texts of a project's files by path.
PROJECT = {
    "app/main.ts": FIXTURES["golden.ts"],
    "app/_util.js": "function half(n) {\n  return n / 2;\n}\n",
    "app/Zed.js": "class Zed { go() { half(4); } }\n",
    "app/alpha.py": "def alpha(x):\n    return x\n",
    "lib/vendor/old.js": "function old() {}\n",
    "lib/build/made.ts": "function made() {}\n",
    "node_modules/dep/index.js": "function dep() {}\n",
    "notes.txt": "no source",
    "UPPER.TS": "function upper() {}\n",
}


def written(spark: SparkSession, files: dict[str, str] = PROJECT) -> str:
    """The root of a project with these files, written by Spark's own file system."""
    root, jvm = scratch(spark), spark.sparkContext._jvm
    for path, text in files.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        stream.write(bytearray(text.encode()))
        stream.close()
    return root


def rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    """place, text of some lines."""
    return spark.createDataFrame(list(enumerate(lines)), "place int, text string").coalesce(1)


def lines(*texts: str) -> str:
    """The statement for :func:`rows`."""
    return values("place, text", *[f"({k}, '{t.replace(chr(39), chr(39) * 2)}')" for k, t in enumerate(texts)])


@case(values("path, language", "('app/main.ts', 'typescript')", "('app/_util.js', 'javascript')", "('app/Zed.js', 'javascript')", "('app/alpha.py', 'python')", "('lib/vendor/old.js', 'javascript')"))
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of a folder: ignored names and other extensions (case counts) are left out."""
    return ast_table.read_sources(spark, written(spark)).select("path", "language")


@case(
    values(
        "path, type, name, line",
        "('app/main.ts', 'function', 'tally', 4)",
        "('app/_util.js', 'function', 'half', 1)",
        "('app/Zed.js', 'class', 'Zed', 1)",
        "('app/Zed.js', 'method', 'go', 1)",
        "('app/alpha.py', 'function', 'alpha', 1)",
        "('lib/vendor/old.js', 'function', 'old', 1)",
    )
)
def scan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all files below a folder."""
    return code.code_units(ast_table.ast_nodes(ast_table.read_sources(spark, written(spark)))).select("path", "type", "name", "line")


@case(values("caller, callee", "('tally', null)", "('half', null)", "('Zed', null)", "('go', null)", "('alpha', null)", "('old', null)", "('__global', 'length')", "('__global', 'sc')", "('__global', 'half')"))
def scan_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call graph of all files below a folder; calls have one caller."""
    return code.call_graph(ast_table.ast_nodes(ast_table.read_sources(spark, written(spark)))).select("caller", "callee")


@case(lines("├── app/", "│   ├── _util.js", "│   ├── alpha.py", "│   ├── main.ts", "│   └── Zed.js", "└── UPPER.TS"))
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of a folder as text: folders first, names in the order of the root locale, extensions in any case."""
    found = tree.file_tree(ast_table.tree_files(spark, written(spark)))
    return rows(spark, tree.render_tree([r.asDict() for r in found.collect()]).split("\n"))


@case(values("name, position", "('_x', 1)", "('a', 2)", "('A', 3)", "('b', 4)", "('B', 5)", "('é', 6)", "('f', 7)"))
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings in the order of the root locale."""
    names = spark.createDataFrame([(x,) for x in ("f", "B", "é", "a", "_x", "b", "A")], "path string")
    return tree.file_tree(names).select("name", "position")


@case(values("path", "('app/alpha.py')", "('app/Zed.js')", "('lib/vendor/old.js')", "('notes.txt')", "('UPPER.TS')", "('lib/build/made.ts')", "('node_modules/dep/index.js')", "('app/_util.js')"))
def parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a cache by path and time lacks: all but the one that it knows; one known at another time is changed."""
    root = written(spark)
    nothing = spark.createDataFrame([], "path string, modified timestamp")
    every = ast_table.changed_files(spark, root, nothing)
    known = every.where("path like '%main.ts'").unionByName(every.where("path like '%_util.js'").withColumn("modified", F.col("modified") - F.expr("interval 1 hour")))
    return ast_table.changed_files(spark, root, known).select(F.regexp_replace("path", r"^.*/project-[0-9a-f]+/", "").alias("path"))


_STRUCTURE = ["method area (shapes.js:3)", "method grow (shapes.js:6)"]


@case(
    lines("class Lib (Lib.java:4)", "function twice (Lib.java:5)", "function tally (golden.ts:4)", "class Box (main.go:8)", "function Show (main.go:10)", "function main (main.go:11)", "class Shape (shapes.js:2)", *_STRUCTURE, "class Tool (tools.py:4)", "function run (tools.py:5)", "function fetch (tools.py:8)")
)
def structure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [r["text"] for r in render.structure_lines(code.code_units(_nodes(spark))).toLocalIterator()])


@case(lines("__global -> helper, length, sc, fmt.Println, str.ToUpper, Box{1}.Show, size, open, os.path.join, first, other"))
def calls_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees in the order of files and places; names without callees are left out."""
    return rows(spark, list(render.call_lines(code.call_graph(_nodes(spark)))))


@case(lines("Units that may be affected by e:", "  tally (golden.ts:4)", "  Show (main.go:10)", "  main (main.go:11)", "  grow (shapes.js:6)", "  run (tools.py:5)", "Nothing is affected by tally."))
def impact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = code.code_units(_nodes(spark))
    return rows(spark, render.impact_lines(code.impact(units, "e"), "e") + render.impact_lines(code.impact(units.where("name = 'tally'"), "tally"), "tally"))


@case(lines("fetch: complexity 0, blocks 0", "grow: complexity 3, blocks 3", "tally: complexity 4, blocks 4"))
def complexity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.unit_complexity(_nodes(spark)).where("name in ('tally', 'grow', 'fetch')")
    return rows(spark, sorted(r["text"] for r in render.complexity_lines(found).collect()))


def _as_rows(spark: SparkSession, text: str) -> DataFrame:
    """key, value of a JSON object, compact and with ordered keys below the first level."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, separators=(",", ":"))) for k, v in json.loads(text).items()], "key string, value string").coalesce(1)


_FLOWS = ",".join(f'{{"defLine":{a},"useLine":{b},"var":"{n}"}}' for n, a, b in (("start", 4, 5), ("k", 6, 6), ("rows", 4, 6), ("k", 6, 6), ("rows", 4, 7), ("k", 6, 7), ("start", 4, 7), ("acc", 8, 8), ("rows", 4, 8), ("k", 6, 8), ("acc", 8, 11)))


@case(values("key, value", "('function', '\"tally\"')", "('variables', '[\"rows\",\"start\",\"acc\",\"k\",\"sc\"]')", f"('edges', '[{_FLOWS}]')", "('refs', '17')"))
def dfg_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function's references (here their number) and flows as JSON."""
    refs = _golden(_refs(spark))
    found = json.loads(render.dfg_json("tally", refs, code.dfg_edges(refs)))
    return _as_rows(spark, json.dumps(found | {"refs": len(found["refs"])}))


@case(values("key, value", "('function', '\"tally\"')", "('targetLine', '8')", "('direction', '\"backward\"')", "('variable', 'null')", "('sliceLines', '[4,5,6,7,8,9,10,11,12]')", "('code', '\"  let acc = start;\"')"))
def slice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice as JSON, with the second of its source lines."""
    found = code.with_source(code.slice_by_blocks(_golden(code.cfg_blocks(_nodes(spark))), 8), fixture_sources(spark))
    text = json.loads(render.slice_json("tally", 8, "backward", None, found))
    return _as_rows(spark, json.dumps(text | {"code": text["code"][1]}))


@case(values("key, value", "('file', '\"golden.ts\"')", "('imports', '[{\"aliases\":{\"sc\":\"scale\"},\"isDefault\":true,\"isFrom\":true,\"module\":\"./ops\",\"names\":[\"base\",\"scale\"]},{\"aliases\":{\"util\":\"*\"},\"isDefault\":false,\"isFrom\":true,\"module\":\"util-lib\",\"names\":[\"*\"]}]')"))
def imports_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_rows(spark, render.imports_json("golden.ts", ast_table.imports(fixture_sources(spark).where("path = 'golden.ts'"))))


@case(
    values(
        "json",
        '(\'{"id":0,"type":"entry","lines":[4,4],"defs":["rows","start"]}\')',
        '(\'{"id":1,"type":"branch","lines":[6,10],"defs":["k"],"uses":["k","rows","k"]}\')',
        '(\'{"id":2,"type":"branch","lines":[7,9],"uses":["rows","k","start"]}\')',
        '(\'{"id":3,"type":"body","lines":[4,12],"defs":["rows","start"]}\')',
        '(\'{"id":4,"type":"exit","lines":[12,12]}\')',
        *[f'(\'{{"source":{k},"target":{k + 1},"type":"control:sequential"}}\')' for k in range(4)],
        *[f'(\'{{"source":{a},"target":{b},"type":"data:{n}"}}\')' for a, b, n in ((0, 1, "rows"), (0, 2, "rows"), (1, 2, "k"), (0, 2, "start"))],
    )
)
def pdg_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with what is defined and used on their first line, and dependence edges with their full types."""
    nodes, edges = _pdg(spark)
    return _golden(render.node_json(nodes)).select("json").unionByName(_golden(render.edge_json(edges)).select("json"))


@case(values("seed, line", *[f"('{s}', {k})" for s in ("rows", "zzz") for k in range(4, 13)]))
def slice_variable_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices filtered by a variable: only data edges are filtered, the chain of blocks stays."""
    nodes, edges = _pdg(spark)
    found = [_golden(code.slice_generic(nodes, edges, 7, name)).select(F.lit(name).alias("seed"), "line") for name in ("rows", "zzz")]
    return found[0].unionByName(found[1])


@case(values("dep, label, source, target", "('data', 'k', 1, 2)", *[f"('control', 'sequential', {k}, {k + 1})" for k in range(4)]))
def variable_edges_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that a slice by one variable follows."""
    return _golden(code.edges_of(_pdg(spark)[1], "k")).select("dep", "label", "source", "target")


OTHERS = {
    "a.php": "<?php\nuse A\\B\\C;\nuse D\\{E, F as G};\n",
    "b.rs": "use std::io;\nuse a::{b, c};\n// use no::such;\n",
    "c.c": '#include <stdio.h>\n#include "x/y.h"\n',
    "d.cpp": "#include <map>\nusing namespace std;\nusing a::b;\n",
    "e.kt": "import a.b.C\nimport d.e as f\n",
    "f.tsx": "import type { T } from 'types';\nimport * as React from 'react';\n",
}


@case(
    values(
        "path, ord, module, names, is_from",
        "('a.php', 0, 'A\\B\\C', 'C', true)",
        "('a.php', 1, 'D', 'E,F', true)",
        "('b.rs', 0, 'std::io', 'std::io', true)",
        "('b.rs', 1, 'a::{b, c}', 'a::{b, c}', true)",
        "('c.c', 0, 'stdio.h', '', true)",
        "('c.c', 1, 'x/y.h', '', true)",
        "('d.cpp', 0, 'map', '', true)",
        "('d.cpp', 1, '', 'std', false)",
        "('d.cpp', 2, '', 'b', false)",
        "('e.kt', 0, 'a.b.C', 'a.b.C', true)",
        "('e.kt', 1, 'd.e', 'd.e', true)",
        "('f.tsx', 0, 'types', 'T', true)",
        "('f.tsx', 1, 'react', '*', true)",
    )
)
def imports_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of PHP, Rust, C, C++, Kotlin and TSX."""
    sources = ast_table.read_sources(spark, written(spark, OTHERS))
    return ast_table.imports(sources).select("path", "ord", "module", F.array_join("names", ",").alias("names"), F.col("isFrom").alias("is_from"))


@case(
    values(
        "step, entries, hits, misses, stored, dimensions, version",
        "('first', 6, 0, 6, 6, 16, 1)",
        "('again', 6, 6, 0, 6, 16, 2)",
        "('other model', 6, 0, 6, 6, 8, 3)",
        "('cleared', null, null, null, 0, null, 4)",
    )
)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a folder, built, built from its cache, built by another model, and cleared."""
    sources = ast_table.read_sources(spark, written(spark))
    store, out = index.VectorIndex(spark, scratch(spark)), []
    for step, provider in (("first", embeddings.MockProvider(16)), ("again", embeddings.MockProvider(16)), ("other model", embeddings.MockProvider(8, "other"))):
        figures = index.build_index(sources, store, provider)
        out.append((step, figures["entries"], figures["hits"], figures["misses"], store.count(), store.dimensions(), store.version()))
    store.clear()
    out.append(("cleared", None, None, None, store.count(), store.dimensions(), store.version()))
    return spark.createDataFrame(out, "step string, entries int, hits int, misses int, stored int, dimensions int, version int")


@case(lines("1. Zed (app/Zed.js:1) score 1.000", "class Zed { go() { half(4); } }"))
def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best result of a search for a stored text, and no more of its content than there is."""
    store, mock = index.VectorIndex(spark, scratch(spark)), embeddings.MockProvider(16)
    index.build_index(ast_table.read_sources(spark, written(spark)), store, mock)
    content = store.read("vectors").where("id = 'app/Zed.js:1:Zed'").first()["content"]
    return rows(spark, render.search_text(index.search_index(store, content, mock, 1)).rstrip("\n").split("\n"))


@case(
    values(
        "step, provider, warm_model, search_model, base_url",
        "('default', 'mock', 'nomic-embed-text-v2-moe', 'embeddinggemma', 'http://localhost:11434')",
        "('changed', 'huggingface', 'm', 'embeddinggemma', 'http://localhost:11434')",
        "('broken', 'mock', 'nomic-embed-text-v2-moe', 'embeddinggemma', 'http://localhost:11434')",
    )
)
def settings_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a project on the driver's disk: without a file, after an edit, and with a file that isn't valid."""
    with tempfile.TemporaryDirectory() as project:
        out = [("default", config.load(project))]
        config.save(project, config.changed(config.load(project), {"provider": "huggingface", "warm_model": "m"}))
        out.append(("changed", config.load(project)))
        with open(f"{project}/{config.PROJECT_FOLDER}/config.json", "w") as file:
            file.write('{"embeddings": ')
        out.append(("broken", config.load(project)))
    found = [(step, s.embeddings.provider, s.embeddings.warm_model, s.embeddings.search_model, s.embeddings.base_url) for step, s in out]
    return spark.createDataFrame(found, "step string, provider string, warm_model string, search_model string, base_url string")


@query(mock_sql(4))
def provider_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the mock provider as the index asks for them, which are single floats."""
    text = F.concat("p_name", F.col("p_partkey").cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", embeddings.embedding(text, embeddings.MockProvider(8)).cast("array<double>").alias("v"))
    return part.select("p_partkey", F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 4))


@case(
    values(
        "name, value",
        "('hash of hello world', '1794106052')",
        "('hash of é漢𝄞', '36054147')",
        "('hash in base 16, below 0', '-80000000')",
        "('last segment', 'tally')",
        "('score 0.1235', '0.123')",
        "('score 1.0005', '1.000')",
        "('score -0.25', '-0.250')",
        "('language of a/.ts', '')",
        "('language of A.TSX', 'typescript')",
    )
)
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on given values."""
    one = spark.range(1)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cells = [
        ("hash of hello world", text(hash32(F.lit("hello world")))),
        ("hash of é漢𝄞", text(hash32(F.lit("é漢𝄞")))),
        ("hash in base 16, below 0", signed_hex(hash32(F.lit("polygenelubricants")))),
        ("last segment", F.element_at(F.split(F.lit("golden.ts:4:tally"), ":"), -1)),
        *[(f"score {x}", F.lit(render.score_text(x))) for x in (0.1235, 1.0005, -0.25)],
        ("language of a/.ts", text(ast_table.language_of(F.lit("a/.ts")))),
        ("language of A.TSX", text(ast_table.language_of(F.lit("A.TSX")))),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in cells])).alias("x")).select("x.*")


@case(
    values(
        "path, type, name, line",
        "('main.ts', 'function', 'tally', 4)",
        "('Zed.js', 'class', 'Zed', 1)",
        "('Zed.js', 'method', 'go', 1)",
        "('alpha.py', 'function', 'alpha', 1)",
    )
)
def stream_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of files that arrive in a folder, one stream run. Streams don't see names that begin with an underscore or a dot."""
    root, out = written(spark, {k: v for k, v in PROJECT.items() if k.startswith("app/")}), scratch(spark)
    incremental.index_changes(incremental.source_stream(spark, root), f"{out}/units", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/units").select(F.element_at(F.split("path", "/"), -1).alias("path"), "type", "name", "line")
