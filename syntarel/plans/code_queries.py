"""Queries of the code operators over fixture sources, with hand-derived rows as their statements."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code
from ..sources import ast_table
from ..storage import scratch
from .table_queries import case, query, table

FIXTURES = {
    "golden.ts": """import base, { scale as sc } from "./ops";
import * as util from "util-lib";

function tally(rows: number[], start: number): number {
  let acc = start;
  for (let k = 0; k < rows.length; k++) {
    if (rows[k] > 0 && start > 1) {
      acc = acc + sc(rows[k]);
    }
  }
  return acc;
}
""",
    "shapes.js": """import "side";
class Shape extends Base {
  area(r) {
    switch (r) { case 1: return 1; case 2: return 4; default: return r ? 0 : 2; }
  }
  grow(by) { this.size += by; while (by > 0 || this.open) { by--; } }
}
const half = (n) => n / 2;
""",
    "tools.py": """import os, sys as system
from pkg.mod import first, second as other

class Tool:
    def run(self, path):
        return os.path.join(path, first())

async def fetch(url):
    return await other(url)
""",
    "main.go": """package main

import (
    "fmt"
    str "strings"
)

type Box struct { n int }

func (b Box) Show() { fmt.Println(str.ToUpper("x")) }
func main() { Box{1}.Show() }
""",
    "Lib.java": """import java.util.*;
import java.io.File;

public class Lib {
    public int twice(int n) { return helper(n) * 2; }
}
""",
}


def fixture_sources(spark: SparkSession) -> DataFrame:
    rows = [(p, t) for p, t in FIXTURES.items()]
    return spark.createDataFrame(rows, "path string, text string").select("path", ast_table.language_of(F.col("path")).alias("language"), "text")


def _nodes(spark: SparkSession) -> DataFrame:
    return ast_table.ast_nodes(fixture_sources(spark).coalesce(1))


def _refs(spark: SparkSession) -> DataFrame:
    return code.function_refs(_nodes(spark))


def _golden(df: DataFrame) -> DataFrame:
    return df.where("path = 'golden.ts' and function = 'tally'")


@cache
def values(columns: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) as t({columns})"


@case(
    values(
        "path, type, name, line",
        "('golden.ts', 'function', 'tally', 4)",
        "('shapes.js', 'class', 'Shape', 2)",
        "('shapes.js', 'method', 'area', 3)",
        "('shapes.js', 'method', 'grow', 6)",
        "('tools.py', 'class', 'Tool', 4)",
        "('tools.py', 'function', 'run', 5)",
        "('tools.py', 'function', 'fetch', 8)",
        "('main.go', 'class', 'Box', 8)",
        "('main.go', 'function', 'Show', 10)",
        "('main.go', 'function', 'main', 11)",
        "('Lib.java', 'class', 'Lib', 4)",
        "('Lib.java', 'function', 'twice', 5)",
    )
)
def structure_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_units(_nodes(spark)).select("path", "type", "name", "line")


@case(values("path, name, line", "('golden.ts', 'tally', 4)", "('shapes.js', 'area', 3)", "('shapes.js', 'grow', 6)", "('tools.py', 'run', 5)", "('main.go', 'Show', 10)", "('main.go', 'main', 11)", "('Lib.java', 'twice', 5)"))
def impact_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.impact(code.code_units(_nodes(spark)), "FETCH").select("path", "name", "line")


@case(
    values(
        "path, ord, module, names, is_from, is_default, aliases",
        "('golden.ts', 0, './ops', 'base,scale', true, true, 'sc=scale')",
        "('golden.ts', 1, 'util-lib', '*', true, false, 'util=*')",
        "('shapes.js', 0, 'side', '', true, false, '')",
        "('tools.py', 0, 'sys', 'os,sys', false, false, 'system=sys')",
        "('tools.py', 1, 'pkg.mod', 'first,second', true, false, 'other=second')",
        "('main.go', 0, '', 'fmt,strings', true, false, 'str=strings')",
        "('Lib.java', 0, 'java.util', 'java.util,*', true, false, '')",
        "('Lib.java', 1, 'java.io.File', 'java.io.File', true, false, '')",
    )
)
def imports_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ast_table.imports(fixture_sources(spark))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("aliases")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("path", "ord", "module", F.array_join("names", ",").alias("names"), F.col("isFrom").alias("is_from"), F.col("isDefault").alias("is_default"), pairs.alias("aliases"))


@case(
    values(
        "path, defines, calls",
        "('golden.ts', 'tally', 'length,sc')",
        "('shapes.js', 'Shape,area,grow', 'size,open')",
        "('tools.py', 'Tool,run,fetch', 'os.path.join,first,other')",
        "('main.go', 'Box,Show,main', 'fmt.Println,str.ToUpper,Box{1}.Show')",
        "('Lib.java', 'Lib,twice', 'helper')",
    )
)
def calls_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.file_calls(_nodes(spark))
    return found.select("path", F.array_join("defines", ",").alias("defines"), F.array_join("calls", ",").alias("calls"))


@case(values("path, name, complexity, block_count", "('golden.ts', 'tally', 4, 4)", "('shapes.js', 'area', 2, 2)", "('shapes.js', 'grow', 3, 3)", "('tools.py', 'run', 0, 0)", "('tools.py', 'fetch', 0, 0)", "('main.go', 'Show', 0, 0)", "('main.go', 'main', 0, 0)", "('Lib.java', 'twice', 0, 0)"))
def complexity_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.unit_complexity(_nodes(spark)).select("path", "name", "complexity", "block_count")


@case(values("id, type, start_line, end_line", "(0, 'entry', 4, 4)", "(1, 'branch', 6, 10)", "(2, 'branch', 7, 9)", "(3, 'body', 4, 12)", "(4, 'exit', 12, 12)"))
def cfg_blocks_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(code.cfg_blocks(_nodes(spark))).select("id", "type", "start_line", "end_line")


@case(values("source, target, type", "(0, 1, 'sequential')", "(1, 2, 'sequential')", "(2, 3, 'sequential')", "(3, 4, 'sequential')"))
def cfg_edges_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(code.cfg_edges(code.cfg_blocks(_nodes(spark)))).select("source", "target", "type")


_REFS = """1 rows definition 4:15|2 start definition 4:31|3 acc definition 5:6|4 start use 5:12|5 k definition 6:11|6 k use 6:18|7 rows use 6:22|8 k use 6:35|9 rows use 7:8
|10 k use 7:13|11 start use 7:23|12 acc update 8:6|13 acc use 8:12|14 sc use 8:18|15 rows use 8:21|16 k use 8:26|17 acc use 11:9"""


def _ref_rows() -> list[str]:
    out = []
    for x in _REFS.replace("\n", "").split("|"):
        seq, name, kind, at = x.split()
        line, col = at.split(":")
        out.append(f"({seq}, '{name}', '{kind}', {line}, {col})")
    return out


@case(values("seq, name, ref_type, line, col", *_ref_rows()))
def var_refs_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(_refs(spark)).select("seq", "name", "ref_type", "line", "col")


@case(values("name, def_line, use_line", *[f"('{n}', {a}, {b})" for n, a, b in (("start", 4, 5), ("k", 6, 6), ("rows", 4, 6), ("k", 6, 6), ("rows", 4, 7), ("k", 6, 7), ("start", 4, 7), ("acc", 8, 8), ("rows", 4, 8), ("k", 6, 8), ("acc", 8, 11))]))
def dfg_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(code.dfg_edges(_refs(spark))).select("name", "def_line", "use_line")


@case(values("name, place", "('rows', 1)", "('start', 2)", "('acc', 3)", "('k', 5)", "('sc', 14)"))
def variables_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(code.variables(_refs(spark))).select("name", F.col("first").alias("place"))


def _pdg(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    blocks, refs = code.cfg_blocks(_nodes(spark)), _refs(spark)
    return code.pdg_nodes(blocks, refs), code.pdg_edges(blocks, code.dfg_edges(refs))


@case(values("source, target, label", "(0, 1, 'rows')", "(0, 2, 'rows')", "(1, 2, 'k')", "(0, 2, 'start')"))
def pdg_data_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(_pdg(spark)[1]).where("dep = 'data'").select("source", "target", "label")


@case(values("bucket, edges", "('control_in', 3)", "('control_out', 3)", "('data_in', 4)", "('data_out', 1)"))
def dependencies_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _pdg(spark)
    return _golden(code.line_dependencies(nodes, edges, 7)).select("bucket", F.col("edges").cast("int").alias("edges"))


def _slice_rows() -> list[str]:
    lines = FIXTURES["golden.ts"].split("\n")
    return [f"({k}, '{lines[k - 1]}')" for k in range(4, 13)]


@case(values("line, code", *_slice_rows()))
def slice_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.slice_by_blocks(code.cfg_blocks(_nodes(spark)), 8)
    return _golden(code.with_source(found, fixture_sources(spark))).select("line", "code")


@case(values("line", *[f"({k})" for k in range(4, 13)]))
def slice_generic_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(code.slice_generic(*_pdg(spark), 8, "acc", forward=True)).select("line")


@case(
    values(
        "path, caller, callee",
        "('golden.ts', 'tally', 'sc')",
        "('tools.py', 'run', 'os.path.join')",
        "('tools.py', 'run', 'first')",
        "('tools.py', 'fetch', 'other')",
        "('main.go', 'Show', 'fmt.Println')",
        "('main.go', 'Show', 'str.ToUpper')",
        "('main.go', 'main', 'Box{1}.Show')",
        "('Lib.java', 'twice', 'helper')",
    )
)
def callers_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.callers(_nodes(spark))


def _entry_text() -> str:
    return "\n".join(FIXTURES["golden.ts"].split("\n")[:9]) + "\n\nvars:17, def-use chains:11"


@case(f"select 'golden.ts:4:tally' as id, '{_entry_text()}' as content")
def index_content_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = fixture_sources(spark)
    return code.index_entries(sources, _nodes(spark)).where("file = 'golden.ts'").select("id", "content")


@case("select count(*)::int as bad from (select 1) where false")
def nested_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that break the numbering: an end before the start, or a child outside of its parent."""
    nodes = _nodes(spark)
    parents = nodes.select("path", F.col("pre").alias("parent"), F.col("pre").alias("p_pre"), F.col("last").alias("p_last"))
    bad = nodes.join(parents, ["path", "parent"], "left").where("last < pre or (p_pre is not null and (pre <= p_pre or last > p_last))")
    return bad.agg(F.count("*").cast("int").alias("bad"))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of programs that the events tell: 64 neighbours by id make the body of one function, a line each; parsed once and stored.

    Signups and purchases assign, views and clicks call, errors branch.
    """
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind.isin("signup", "purchase"), F.concat(F.lit("  s = made"), number, F.lit("();"))).when(kind == "error", "  if (s > 3) { fail(s); }").otherwise(F.concat(F.lit("  "), kind, F.lit("(s);")))
    lines = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 64).alias("p"), F.struct("event_id", line.alias("line")).alias("x"))
    texts = lines.groupBy("p").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], "\n").alias("body"))
    name = F.col("p").cast("string")
    text = F.concat(F.lit("function f"), name, F.lit("(seed: number) {\n  let s = seed;\n"), "body", F.lit("\n}\n"))
    sources = texts.select(F.concat(F.lit("p"), name, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("text"))
    return ast_table.stored(ast_table.ast_nodes(sources), scratch(spark))


_PROGRAMS = """with e as (select *, event_id // 64 as p, row_number() over (partition by event_id // 64 order by event_id) + 2 as line, event_type in ('signup', 'purchase') as makes from events),
    u as (select p, event_id, line, event_type from e where not makes union all select p, event_id, line, event_type from e where event_type = 'error')"""


@query(f"{_PROGRAMS} select 'p' || p || '.ts' as path, 'f' || p as name, (1 + count(*) filter (event_type = 'error'))::int as complexity, (2 + count(*) filter (event_type = 'error'))::int as block_count from e group by p")
def complexity_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity and blocks of the functions that events tell."""
    return code.unit_complexity(_programs(spark, sf_dir)).select("path", "name", "complexity", "block_count")


@query(f"{_PROGRAMS} select distinct 'p' || p || '.ts' as path, 'f' || p as caller, case when makes then 'made' || event_id when event_type = 'error' then 'fail' else event_type end as callee from e")
def callers_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls what in them."""
    return code.callers(_programs(spark, sf_dir))


@query(f"{_PROGRAMS} select 'p' || u.p || '.ts' as path, u.line::int as use_line, coalesce(max(e.line) filter (e.makes and e.line < u.line), 2)::int as def_line, count(distinct e.event_id) as lines from u join e using (p) group by u.p, u.line, u.event_type union all select distinct 'p' || p || '.ts', 2, 1, null from e")
def flows_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses with the definition that reaches them, with the number of lines of their program that events tell; the parameter's without."""
    nodes = _programs(spark, sf_dir)
    flows = code.dfg_edges(code.function_refs(nodes)).select("path", "use_line", "def_line").distinct()
    spans = code.flow_functions(nodes).select("path", (F.col("end_line") - F.col("start_line") - 2).cast("long").alias("lines"))
    return flows.join(spans, "path").withColumn("lines", F.when(F.col("use_line") > 2, F.col("lines")))


@query(f"{_PROGRAMS} select 'p' || p || '.ts' as path, 'f' || p as function, 0 as source, k::int as target, 'control' as dep from (select p, count(*) filter (event_type = 'error') as n from e group by p), range(1, 2) as r(k) union all select 'p' || p || '.ts', 'f' || p, k::int, (k + 1)::int, 'control' from (select p, count(*) filter (event_type = 'error') as n from e group by p) c, range(1, 1000) as r(k) where k <= n + 1")
def chains_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of their blocks: an entry, a branch for every error, a body and an exit."""
    edges = code.cfg_edges(code.cfg_blocks(_programs(spark, sf_dir)))
    return edges.select("path", "function", "source", "target", F.lit("control").alias("dep"))


@query(f"{_PROGRAMS}, m as (select p, max(line) as top from e group by p) select 'p' || m.p || '.ts' as path, k::int as line from m, range(1, 68) as r(k) where k <= m.top + 1")
def slices_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of each program backwards from its second line: the body's block spans the whole function."""
    return code.slice_by_blocks(code.cfg_blocks(_programs(spark, sf_dir)), 2).select("path", "line")


_SCRIPTS = "select page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as text from pages"


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the scripts that pages hold."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), 1)).alias("text"))
    sources = found.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), "text")
    return ast_table.stored(ast_table.ast_nodes(sources), scratch(spark))


@query(f"with s as ({_SCRIPTS}), c as (select page_id, unnest(regexp_extract_all(text, '([a-z]+)\\(', 1)) as callee from s) select 'page' || page_id || '.js' as path, array_to_string(list_sort(list(distinct callee)), ',') as calls from c group by page_id")
def page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scripts in pages call, whatever their strings hold."""
    return code.file_calls(_scripts(spark, sf_dir)).select("path", F.array_join(F.array_sort("calls"), ",").alias("calls"))


@query(f"with s as ({_SCRIPTS}) select 'page' || page_id || '.js' as path, 'string' as kind, regexp_extract(text, '\"[^\"]*\"') as text from s where contains(text, '\"') union all select 'page' || page_id || '.js', 'number', regexp_extract(text, '\\((\\d+)\\)', 1) from s where regexp_matches(text, '\\(\\d+\\)')")
def page_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and numbers of the scripts in pages, from the syntax tree."""
    return _scripts(spark, sf_dir).where(F.col("kind").isin("string", "number")).select("path", "kind", "text")
