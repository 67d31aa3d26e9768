"""Commands: tree, structure, calls, impact, complexity, dfg, slice, warm, semantic, config, imports."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from . import config
from .functions import embeddings
from .operators import code, tree
from .plans import index, render
from .session import session
from .sources import ast_table
from .sources.rules import IGNORED_IN_TREE, LANGUAGES, PROJECT_FOLDER


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="syntarel")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("tree", "structure", "calls"):
        sub.add_parser(name).add_argument("path", nargs="?", default=".")
    p = sub.add_parser("impact")
    p.add_argument("function")
    p.add_argument("path", nargs="?", default=".")
    for name in ("complexity", "dfg"):
        p = sub.add_parser(name)
        p.add_argument("file")
        p.add_argument("function", nargs=None if name == "dfg" else "?")
    p = sub.add_parser("slice")
    p.add_argument("file")
    p.add_argument("function")
    p.add_argument("line", type=int)
    p.add_argument("--direction", default="backward")
    p.add_argument("--var")
    p = sub.add_parser("imports")
    p.add_argument("file")
    p.add_argument("--lang")
    for name in ("warm", "semantic"):
        p = sub.add_parser(name)
        if name == "semantic":
            p.add_argument("query")
            p.add_argument("-k", type=int, default=10)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--provider")
    p = sub.add_parser("config")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="change a setting; an empty value sets its default")
    p.add_argument("--edit", action="store_true", help="ask for every setting")
    return top


def _files(spark, path: str):
    """One row a supported path below a folder; names only, nothing is read."""
    rows = []
    for folder, folders, names in os.walk(path):
        folders[:] = [x for x in folders if x not in IGNORED_IN_TREE]
        rows += [(os.path.relpath(os.path.join(folder, x), path),) for x in names if x not in IGNORED_IN_TREE and os.path.splitext(x)[1].lower() in LANGUAGES and not os.path.islink(os.path.join(folder, x))]
    return spark.createDataFrame(rows, "path string")


def _one(spark, file: str, language: str | None = None):
    if not os.path.isfile(file):
        sys.exit(f"no such file: {file}")
    with open(file, encoding="utf-8", errors="replace") as f:
        df = spark.createDataFrame([(file, f.read())], "path string, text string")
    given = {"py": "python"}.get(language or "", language)
    from pyspark.sql import functions as F

    return df.select("path", (F.lit(given) if given else ast_table.language_of(F.col("path"))).alias("language"), "text")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config":
        settings = config.load(args.path)
        try:
            given = dict(x.split("=", 1) for x in args.set)
            if args.edit:
                given |= config.asked(settings)
            if given:
                config.save(args.path, config.changed(settings, given))
        except ValueError as error:
            print(f"not a setting: {error}", file=sys.stderr)
            return 1
        print(json.dumps(asdict(config.load(args.path)), indent=2))
        return 0
    if args.command == "slice" and args.line < 1:
        print("the line must be 1 or more", file=sys.stderr)
        return 1
    if args.command == "warm" and not args.provider and not os.path.exists(os.path.join(args.path, PROJECT_FOLDER, "config.json")):
        print("No settings yet: give --provider (mock, ollama, huggingface) or write " + os.path.join(PROJECT_FOLDER, "config.json"))
        return 0
    spark = session()
    if args.command == "tree":
        for r in tree.tree_lines(tree.file_tree(_files(spark, args.path))).orderBy("places").toLocalIterator():
            print(r["line"])
    elif args.command in ("structure", "calls", "impact"):
        nodes = ast_table.ast_nodes(ast_table.read_sources(spark, os.path.abspath(args.path))).persist()
        if args.command == "structure":
            rows = render.structure_lines(code.code_units(nodes))
        elif args.command == "calls":
            for line in render.call_lines(code.call_graph(nodes)):
                print(line)
            return 0
        else:
            print("\n".join(render.impact_lines(code.impact(code.code_units(nodes), args.function), args.function)))
            return 0
        for r in rows.toLocalIterator():
            print(r["text"])
    elif args.command == "imports":
        print(render.imports_json(args.file, ast_table.imports(_one(spark, args.file, args.lang))))
    elif args.command in ("complexity", "dfg", "slice"):
        sources = _one(spark, args.file)
        nodes = ast_table.ast_nodes(sources).persist()
        if args.command == "complexity":
            found = code.unit_complexity(nodes) if not args.function else code.complexity(nodes).withColumnRenamed("function", "name").where(f"name = '{args.function}'")
            for r in render.complexity_lines(found).toLocalIterator():
                print(r["text"])
        elif args.command == "dfg":
            refs = code.function_refs(nodes).where(f"function = '{args.function}'")
            print(render.dfg_json(args.function, refs, code.dfg_edges(refs)))
        else:
            lines = code.slice_by_blocks(code.cfg_blocks(nodes).where(f"function = '{args.function}'"), args.line, args.direction != "backward")
            print(render.slice_json(args.function, args.line, args.direction, args.var, code.with_source(lines, sources)))
    else:
        settings = config.load(args.path).embeddings
        settings.provider = args.provider or settings.provider
        store = index.VectorIndex(spark, "file://" + os.path.abspath(os.path.join(args.path, PROJECT_FOLDER)))
        if args.command == "warm":
            print(json.dumps(index.build_index(ast_table.read_sources(spark, os.path.abspath(args.path)), store, embeddings.provider(settings), lambda line: print(line, file=sys.stderr))))
        else:
            print(render.search_text(index.search_index(store, args.query, embeddings.provider(settings, for_search=True), args.k)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
