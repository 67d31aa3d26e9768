"""Results as text and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structure_lines(units: DataFrame) -> DataFrame:
    return units.select("path", "pre", F.format_string("%s %s (%s:%d)", "type", "name", "path", "line").alias("text")).orderBy("path", "pre").select("text")


def complexity_lines(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("%s: complexity %d, blocks %d", "name", "complexity", "block_count").alias("text"))


def call_lines(graph: DataFrame) -> Iterator[str]:
    """A line for each caller with callees, in order of first sight; edges arrive one by one."""
    edges = graph.where("callee is not null").orderBy("caller", "at").toLocalIterator()
    for caller, rows in groupby(edges, key=lambda r: r["caller"]):
        yield f"{caller} -> {', '.join(r['callee'] for r in rows)}"


def impact_lines(units: DataFrame, target: str) -> list[str]:
    rows = [f"  {r['name']} ({r['path']}:{r['line']})" for r in units.orderBy("path", "line").toLocalIterator()]
    return [f"Units that may be affected by {target}:", *rows] if rows else [f"Nothing is affected by {target}."]


def dfg_json(function: str, refs: DataFrame, edges: DataFrame) -> str:
    """One function's references and flows."""
    rows = sorted(refs.collect(), key=lambda r: r["seq"])
    names = list(dict.fromkeys(r["name"] for r in rows))
    flows = sorted(edges.collect(), key=lambda r: (r["use_line"], r["use_seq"]))
    return json.dumps({"function": function, "variables": names, "refs": [{"name": r["name"], "type": r["ref_type"], "line": r["line"], "column": r["col"]} for r in rows], "edges": [{"var": r["name"], "defLine": r["def_line"], "useLine": r["use_line"]} for r in flows]}, indent=2)


def slice_json(function: str, line: int, direction: str, variable: str | None, lines: DataFrame) -> str:
    rows = sorted(lines.collect(), key=lambda r: r["line"])
    return json.dumps({"function": function, "targetLine": line, "direction": direction, "variable": variable, "sliceLines": [r["line"] for r in rows], "code": [r["code"] for r in rows]}, indent=2)


def imports_json(file: str, found: DataFrame) -> str:
    rows = sorted(found.collect(), key=lambda r: r["ord"])
    return json.dumps({"file": file, "imports": [{"module": r["module"], "names": r["names"], "isFrom": r["isFrom"], "isDefault": r["isDefault"], "aliases": r["aliases"]} for r in rows]}, indent=2)


def node_json(nodes: DataFrame) -> DataFrame:
    """Dependence nodes as JSON; empty lists are left out."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return nodes.select("path", "function", F.to_json(F.struct("id", F.col("type"), F.array("start_line", "end_line").alias("lines"), some("definitions").alias("defs"), some("uses").alias("uses"))).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    """Dependence edges as JSON, with their full type ``dep:label``."""
    return edges.select("path", "function", F.to_json(F.struct("source", "target", F.concat_ws(":", "dep", "label").alias("type"))).alias("json"))


def score_text(score: float) -> str:
    """Three decimals of the exact binary value, halves up."""
    return str(Decimal(score).quantize(Decimal("0.001"), ROUND_HALF_UP))


def search_text(found: DataFrame, lines: int = 10) -> str:
    """Title, place, score and the first lines of each result (top k rows)."""
    rows = found.withColumns({"title": F.element_at(F.split("id", ":"), -1), "head": F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n")}).collect()
    return "\n\n".join(f"{k}. {r['title']} ({r['file']}:{r['line']}) score {score_text(r['score'])}\n{r['head']}" for k, r in enumerate(rows, 1)) or "No results."
