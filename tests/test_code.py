"""Parser, code operators, index and tools."""

import json
import os

import pytest
from pyspark.sql import functions as F

from syntarel import cli, config
from syntarel.functions import embeddings
from syntarel.functions.hashing import hash32, hash32_of, mock_embedding, signed_hex
from syntarel.operators import code, graph, ordering, search, tree
from syntarel.plans import index, render
from syntarel.sources import ast_table, files, outline
from syntarel.sources.imports import imports_of
from syntarel.sources.script import parse_script
from syntarel.streaming import incremental


def sources(spark, **files):
    rows = [(k.replace("__", "."), v) for k, v in files.items()]
    return spark.createDataFrame(rows, "path string, text string").select("path", ast_table.language_of(F.col("path")).alias("language"), "text")


#: (case, extension, source, complexity, blocks or None)
FLOWS = [
    ("straight", "ts", "function go() { return 7; }", 1, 2),
    ("if", "ts", "function go(a: number) { if (a) { return 1; } return 2; }", 2, 3),
    ("if_else", "ts", "function go(a: number) { if (a) { return 1; } else { return 2; } }", 2, 4),
    ("while", "ts", "function go(a: number) { while (a) { a--; } }", 2, 3),
    ("for", "ts", "function go(n: number) { for (let i = 0; i < n; i++) { use(i); } }", 2, 3),
    ("nested_if", "ts", "function go(a: any, b: any) { if (a) { if (b) { return 1; } } }", 3, 4),
    ("nested_while", "ts", "function go(a: any, b: any) { while (a) { while (b) { b--; } } }", 3, 4),
    ("while_in_if", "ts", "function go(a: any, b: any) { if (a) { while (b) { b--; } } }", 3, 4),
    ("deep", "ts", "function go(a: any) { if (a) { if (a > 1) { while (a) { a--; } } } }", 4, 5),
    ("ternary", "ts", "function go(a: any) { if (a ? 1 : 0) { return 1; } }", 2, 3),
    ("and", "ts", "function go(a: any, b: any) { return a && b; }", 2, 2),
    ("or", "ts", "function go(a: any, b: any) { return a || b; }", 2, 2),
    ("nullish", "ts", "function go(a: any, b: any) { return a ?? b; }", 1, 2),
    ("switch", "ts", "function go(a: any) { switch (a) { case 1: return 1; case 2: return 2; default: return 3; } }", 2, 2),
    ("script", "js", "function go(a) { if (a) { return 1; } }", 2, 3),
    ("do_for_in", "js", "function go(o) { do { o--; } while (o); for (const k in o) k; for (const k of o) k; }", 4, 5),
    ("method", "ts", "class A { go(a: number) { return a > 1 && a < 3; } }", 2, 2),
]


def test_complexity_cases(spark):
    df = sources(spark, **{f"{name}__{ext}": text for name, ext, text, _, _ in FLOWS} | {"py__py": "def go(a):\n    if a:\n        return 1\n"})
    got = {r.path: (r.complexity, r.block_count) for r in code.complexity(ast_table.ast_nodes(df)).where("function = 'go'").collect()}
    assert got == {f"{name}.{ext}": (c, b) for name, ext, _, c, b in FLOWS}
    units = {r.path: r.complexity for r in code.unit_complexity(ast_table.ast_nodes(df)).collect()}
    assert units["py.py"] == 0 and units["deep.ts"] == 4


HARD = """#!/usr/bin/env node
import type { A } from 'a';
export * from "b"; export { c as d } from "c"; export default class extends Base<T> {}
const re = /[/]\\/"x/g, q = a / b / c, t = `x ${y + `in ${z}`} end`;
let { p, q: { r = 1 }, ...rest } = o, [m, , n = 2] = xs;
type Fn<T> = T extends (...a: infer P) => void ? P : never;
interface I { x: number; y?(): void }
enum E { One = 1, Two }
declare module "m" { export function f(a: string): void; }
abstract class B<T> implements I { private readonly x: number = 1; static #s = 2; constructor(private a: string) { super(); } get v(): T { return this.#s as unknown as T; } async *gen() { yield* f(); } abstract go(): void; [key: string]: any }
const f = async <T,>(a: T, { b, c }: { b: number; c: T }): Promise<Array<T>> => { await a!; return [a] satisfies T[]; };
label: for (let i = 0, j = 1; i < j; i++) { if (i >>> 1) continue label; else break; }
for await (const x of xs) {}
try { throw new Error(`bad`); } catch { } finally { }
const g = <div className={a}>text {b} <b/></div>;
x = y as const; a?.b?.[c]?.(d); new Map<string, number[]>(); i = j < k; tag`a${b}`; if (a) b; else c
"""


def kinds(node):
    yield node.kind
    for c in node.children:
        yield from kinds(c)


def test_parser_on_hard_sources():
    assert "ERROR" not in set(kinds(parse_script(HARD)))
    plain = "var a = b\n++c\nfunction f(x, ...y) { return\n x }\nvar o = { f() {}, get g() { return 1 }, [k]: 2, 'q': 3, s, async *t() {} }\n[a, b] = [b, a];({ c } = d)\nnew (foo())(1)\n`${`${`x`}`}`"
    assert "ERROR" not in set(kinds(parse_script(plain, typed=False)))
    for junk in ("", "}", "((((", "function (", "class {", "`${", "'unclosed", "\x00\x01", "(" * 5000, "if " * 300, "é漢𝄞 = 1", "/* open"):
        root = parse_script(junk)
        assert root.start == 0 and root.end == len(junk)


def test_nodes_are_nested_sets(spark):
    df = sources(spark, hard__ts=HARD, b__py="class A:\n    def f(self): return g(1)(2)\n", empty__js="")
    rows = ast_table.ast_nodes(df).collect()
    by = {(r.path, r.pre): r for r in rows}
    for r in rows:
        assert r.last >= r.pre and (r.start_line, r.start_col) <= (r.end_line, r.end_col)
        if r.parent >= 0:
            p = by[r.path, r.parent]
            assert p.pre < r.pre <= r.last <= p.last and p.depth + 1 == r.depth


def test_references_keep_the_known_quirks(spark):
    plain = "function f(a) { x += 1; x = 2; x = 3; for (const k of a) k; o.p = y; ({ q } = a); }"
    typed = "function f(a: number, { b, c: d }: T, e?: string, g = a) { var { h } = a; return h; }"
    nested = "function f(a: number) { const g = function inner(b: number) { a = b; return this; }; [a, o.x] = [1, 2]; }"
    hidden = "function f() { var { p = function q(r: number) { return r; } } = z; }"
    nodes = ast_table.ast_nodes(sources(spark, a__js=plain, b__ts=typed, c__ts=nested, d__ts=hidden))
    got = {}
    for r in code.var_refs(nodes).orderBy("path", "fn_pre", "seq").collect():
        got.setdefault((r.path, r.fn_pre), []).append((r.name, r.ref_type))
    by = {}
    for (path, _), refs in sorted(got.items()):
        by.setdefault(path, []).append(refs)
    assert by["a.js"] == [[("x", "use"), ("x", "update"), ("x", "definition"), ("x", "update"), ("k", "use"), ("a", "use"), ("k", "use"), ("o", "use"), ("y", "use"), ("a", "use")]]
    assert by["b.ts"] == [[("a", "definition"), ("b", "definition"), ("d", "definition"), ("e", "definition"), ("g", "definition"), ("a", "use"), ("a", "use"), ("h", "use")]]
    inner = [("b", "definition"), ("a", "definition"), ("b", "use")]
    assert by["c.ts"] == [[("a", "definition"), ("g", "definition"), ("b", "definition"), ("a", "update"), ("b", "use"), ("a", "update"), ("o", "use")], inner]
    # A function in a pattern that isn't looked at is known by itself only.
    assert by["d.ts"] == [[("z", "use")], [("r", "definition"), ("r", "use")]]


def test_slices_agree(spark):
    text = "function f(a: number) {\n  let b = a;\n  if (b) {\n    b = 2;\n  }\n  return b;\n}\n"
    df = sources(spark, f__ts=text)
    nodes = ast_table.ast_nodes(df)
    blocks, refs = code.cfg_blocks(nodes), code.function_refs(nodes)
    pdg = code.pdg_nodes(blocks, refs), code.pdg_edges(blocks, code.dfg_edges(refs))
    for line in (3, 9):
        for forward in (False, True):
            a = {r.line for r in code.slice_by_blocks(blocks, line, forward).collect()}
            assert a == {r.line for r in code.slice_generic(*pdg, line, "b", forward).collect()} == (set(range(1, 8)) if line == 3 else set())


IMPORTS = [
    ("php", "<?php\nuse A\\B\\C;\nuse D\\{E, F as G};\nclass X { use T1; }\n", [("A\\B\\C", ["C"]), ("D", ["E", "F"]), ("T1", ["T1"])]),
    ("rust", "use std::io;\nuse a::{b, c};\n// use no::such;\n", [("std::io", ["std::io"]), ("a::{b, c}", ["a::{b, c}"])]),
    ("c", '#include <stdio.h>\n#include "x/y.h"\n', [("stdio.h", []), ("x/y.h", [])]),
    ("cpp", "#include <map>\nusing namespace std;\nusing a::b;\n", [("map", []), ("", ["std"]), ("", ["b"])]),
    ("go", 'import "fmt"\nimport (\n\t"os"\n\tx "y/z"\n)\n', [("fmt", []), ("", ["os", "y/z"])]),
    ("java", "import java.util.List;\nimport a.b.*;\n", [("java.util.List", ["java.util.List"]), ("a.b", ["a.b", "*"])]),
    ("kotlin", "import a.b.C\nimport d.e as f\n", [("a.b.C", ["a.b.C"]), ("d.e", ["d.e"])]),
    ("python", "from . import x\nimport a.b as c, d\n", [(".", ["x"]), ("d", ["a.b", "d"])]),
    ("cobol", "COPY X.", []),
]


@pytest.mark.parametrize("language,text,want", IMPORTS)
def test_imports_by_language(language, text, want):
    assert [(m, n) for m, n, *_ in imports_of(text, language)] == want


OUTLINES = [
    ("php", "<?php class A { public function run($x) { return go($x); } }\nfunction top() {}", {("class_declaration", "A"), ("method_definition", "run"), ("function_declaration", "top"), ("call_expression", "go")}),
    ("rust", "struct P { x: i32 }\nimpl P { fn new() -> P { make() } }\nimpl Show for P {}", {("struct_item", "P"), ("impl_item", "P"), ("function_item", "new"), ("call_expression", "make")}),
    ("c", "struct s { int a; };\nunion u { int b; };\nint main(void) { return f(1); }", {("struct_specifier", "s"), ("union_specifier", "u"), ("function_definition", "main"), ("call_expression", "f")}),
    ("cpp", "class K : public B { };\nint K::get() const { return h(); }", {("class_specifier", "K"), ("function_definition", "K::get"), ("call_expression", "h")}),
    ("kotlin", 'class K { fun a(x: Int) = b("fun no()") }', {("class_declaration", "K"), ("function_declaration", "a"), ("call_expression", "b")}),
]


@pytest.mark.parametrize("language,text,want", OUTLINES)
def test_outlines(language, text, want):
    def facts(node):
        for c in node.children:
            if c.children and c.children[0].kind == "identifier" and c.children[0].name:
                yield c.kind, text[c.children[0].start : c.children[0].end]
            yield from facts(c)

    assert set(facts(outline.outline(text, language))) == want


def test_call_graph_and_impact(spark):
    df = sources(spark, a__ts="function one() { two(); console.log(x.y); }\nfunction two() {}", b__ts="class __ {}\ntwo();")
    nodes = ast_table.ast_nodes(df)
    got = {}
    for r in code.call_graph(nodes).orderBy("caller", "at").collect():
        got.setdefault(r.caller, []).extend([r.callee] * (r.callee is not None))
    assert got == {"one": [], "two": [], "__": [], "__global": ["two", "console.log", "log", "y"]}
    assert {r.name for r in code.impact(code.code_units(nodes), "TW").collect()} == {"one"}
    assert code.impact(code.code_units(nodes), "").count() == 0
    assert {(r.caller, r.callee) for r in code.callers(nodes).collect()} == {("one", "two"), ("one", "console.log")}
    assert list(render.call_lines(code.call_graph(nodes))) == ["__global -> two, console.log, log, y"]


def test_tree_rules_and_rendering(spark):
    paths = spark.createDataFrame([("src/b.ts",), ("src/a/x.py",), ("z.js",), ("src/a/B.go",)], "path string")
    text = render_tree = tree.render_tree([r.asDict() for r in tree.file_tree(paths).collect()])
    assert text.split("\n") == ["├── src/", "│   ├── a/", "│   │   ├── B.go", "│   │   └── x.py", "│   └── b.ts", "└── z.js"], render_tree
    kinds_ = sources(spark, **{"a__TS": "", "b__ts": "", "c": "", "__ts": ""}).collect()
    assert {r.path: r.language for r in kinds_} == {"a.TS": "typescript", "b.ts": "typescript", "c": None, ".ts": None}
    strict = spark.createDataFrame([("a.TS",)], "p string").select(ast_table.language_of(F.col("p"), True)).first()[0]
    assert strict is None


def test_hash_values(spark):
    for text, want in (("hello world", 1794106052), ("é漢𝄞", 36054147), ("polygenelubricants", -2147483648), ("", 0)):
        got = spark.createDataFrame([(text,)], "t string").select(hash32(F.col("t")).alias("h"), signed_hex(hash32(F.col("t"))).alias("x")).first()
        assert got.h == want == hash32_of(text)
        assert int(got.x, 16) == want


def test_mock_provider(spark):
    mock = embeddings.provider()
    a, b = mock.embed_batch(["one text", "one text"])
    assert len(a) == 768 and a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and mock.model() == "nomic-embed-text-v2-moe"
    sql = spark.createDataFrame([("one text",)], "t string").select(mock_embedding(F.col("t"), 8)).first()[0]
    assert sql == pytest.approx(embeddings.MockProvider(8).embed_batch(["one text"])[0])
    settings = config.EmbeddingSettings(provider="ollama", base_url="http://127.0.0.1:9")
    assert isinstance(embeddings.provider(settings), embeddings.MockProvider)


def test_index_build_cache_and_search(spark, tmp_path):
    df = sources(spark, a__ts="function one() {\n  return 1;\n}\nfunction two(x: number) {\n  return x;\n}\n")
    store, mock = index.VectorIndex(spark, f"file://{tmp_path}/index"), embeddings.MockProvider(16)
    assert store.dimensions() is None
    assert index.build_index(df, store, mock) == {"entries": 2, "hits": 0, "misses": 2}
    more = df.union(sources(spark, b__ts="class K {}\n"))
    assert index.build_index(more, store, mock) == {"entries": 3, "hits": 2, "misses": 1}
    assert index.build_index(more, store, embeddings.MockProvider(8, "other"))["hits"] == 0
    assert store.dimensions() == 8
    content = store.read("vectors").where("id = 'b.ts:1:K'").first().content
    found = index.search_index(store, content, embeddings.MockProvider(8, "other"), 2).collect()
    assert found[0].id == "b.ts:1:K" and found[0].score == pytest.approx(1, abs=1e-6) and len(found) == 2
    assert "1. K (b.ts:1) score 1.000" in render.search_text(index.search_index(store, content, embeddings.MockProvider(8, "other")))
    store.clear()
    assert store.read("vectors").count() == 0


def test_json_renderers(spark):
    df = sources(spark, f__ts="import x from 'y';\nfunction f(a: number) {\n  return a;\n}\n")
    nodes = ast_table.ast_nodes(df)
    refs = code.function_refs(nodes)
    got = json.loads(render.dfg_json("f", refs, code.dfg_edges(refs)))
    assert got["variables"] == ["a"] and got["edges"] == [{"var": "a", "defLine": 2, "useLine": 3}]
    assert json.loads(render.imports_json("f.ts", ast_table.imports(df)))["imports"][0] == {"module": "y", "names": ["x"], "isFrom": True, "isDefault": True, "aliases": {}}
    blocks = code.cfg_blocks(nodes)
    one = json.loads(render.node_json(code.pdg_nodes(blocks, refs)).where("json like '%entry%'").first().json)
    assert one["defs"] == ["a"] and "uses" not in one
    assert render.score_text(1.0005) == "1.000" and render.score_text(-0.25) == "-0.250"
    lines = code.with_source(code.slice_by_blocks(blocks, 3), df)
    assert json.loads(render.slice_json("f", 3, "backward", None, lines))["sliceLines"] == [2, 3, 4]


def test_scan_and_stream(spark, tmp_path):
    for name in ("a.ts", "sub/b.py", "node_modules/c.ts", "note.txt", "sub/dist/d.js", "U.TS", "sub/__init__.py", "_tests/deep/e.js", ".git/f.py", "sub/.conf/g.py", "_tests/build/h.js"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("function f() {}" if name.endswith("s") else "def f(): pass")
    got = {(r.path, r.language) for r in ast_table.read_sources(spark, str(tmp_path / "src")).collect()}
    assert got == {("a.ts", "typescript"), ("sub/b.py", "python"), ("sub/__init__.py", "python"), ("_tests/deep/e.js", "javascript"), ("sub/.conf/g.py", "python")}
    assert "U.TS" in {r.path for r in ast_table.tree_files(spark, str(tmp_path / "src")).collect()}
    every = ast_table.changed_files(spark, str(tmp_path / "src"), spark.createDataFrame([], "path string, modified timestamp"))
    assert every.count() == 10 and ast_table.changed_files(spark, str(tmp_path / "src"), every).count() == 0
    query = incremental.index_changes(incremental.source_stream(spark, str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    assert {os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"a.ts", "b.py"}


def test_listing_in_tasks(spark, tmp_path, monkeypatch):
    """Rounds by level give what Spark's readers and the driver give together, and names that need escapes; a file is its own scan."""
    root = tmp_path / "a b%20c"
    plain = {f"{'x/' * (k % 5)}f{k}.ts": f"let v{k} = {k};" for k in range(40)} | {"_h/.i/j.py": "x = 1", "empty.js": "", "x/long.go": "package a // é\n" * 9000}
    for name, text in plain.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bare").mkdir()
    (root / ".f0.ts.crc").write_text("sum")
    at = files.address(spark, str(root))
    found = files.listed(spark, at)
    assert {r.path: r.bytes for r in found.collect()} == {k: len(v.encode()) for k, v in plain.items()}
    assert {r.path: r.text for r in files.contents(found.select("bytes", "path"), at).collect()} == plain
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    assert files.contents(found, at).rdd.getNumPartitions() == 3
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.listed(spark, at + "/bare").count() == 0
    assert {r.text for r in ast_table.read_sources(spark, str(root / "f0.ts")).collect()} == {"let v0 = 0;"}
    with pytest.raises(Exception, match="NotFound|No such|does not exist|Cannot list"):
        files.listed(spark, at + "/none")

    (root / "gone.ts").write_text("let g = 1;")
    (root / "bytes.js").write_bytes(b"f('\xff')")
    (root / "two words.ts").write_text("let w = 2;")
    late = files.listed(spark, at)
    (root / "gone.ts").unlink()
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.contents(late, at).collect()
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    texts = {r.path: r.text for r in files.contents(late, at).collect()}
    spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    assert texts == plain | {"bytes.js": "f('\ufffd')", "two words.ts": "let w = 2;"}

    (root / "bytes.js").unlink()
    (root / "two words.ts").unlink()
    (root / "empty.js").unlink()  # Spark's readers have no row for it
    easy = tmp_path / "easy"
    root.rename(easy)
    ways = []
    for known in (files.SCHEMES, {}):
        monkeypatch.setattr(files, "SCHEMES", known)
        ways.append((sorted(map(tuple, ast_table.read_sources(spark, str(easy)).collect())), sorted(r.path for r in ast_table.tree_files(spark, str(easy)).collect())))
    assert ways[0] == ways[1] and len(ways[0][0]) == len(plain) - 1


def test_settings_round_trip(tmp_path):
    assert config.load(str(tmp_path)) == config.Settings()
    config.save(str(tmp_path), config.Settings(config.EmbeddingSettings(provider="huggingface")))
    assert config.load(str(tmp_path)).embeddings.provider == "huggingface"
    (tmp_path / ".syntarel" / "config.json").write_text("{broken")
    assert config.load(str(tmp_path)) == config.Settings()


def test_http_provider(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            self.answer({})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.headers["Authorization"] == "Bearer key" and asked["model"] == "warm"
            self.answer({"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]})

        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    settings = config.EmbeddingSettings(provider="ollama", warm_model="warm", base_url=f"http://127.0.0.1:{server.server_port}", api_key="key")
    chosen = embeddings.provider(settings)
    assert isinstance(chosen, embeddings.HttpProvider) and chosen.embed_batch(["abc", ""]) == [[3.0, 1.0], [0.0, 1.0]] and chosen.dimensions() == 2
    got = spark.createDataFrame([("ab",), ("abcd",)], "t string").select(embeddings.embedding("t", chosen).alias("v")).collect()
    assert sorted(r.v[0] for r in got) == [2.0, 4.0]
    server.shutdown()


def test_edited_settings(tmp_path, capsys):
    assert cli.main(["config", str(tmp_path), "--set", "provider=ollama", "--set", "warm_model=m"]) == 0
    assert json.loads(capsys.readouterr().out)["embeddings"]["warm_model"] == "m"
    assert cli.main(["config", str(tmp_path), "--set", "warm_model="]) == 0 and config.load(str(tmp_path)).embeddings == config.EmbeddingSettings(provider="ollama")
    assert cli.main(["config", str(tmp_path), "--set", "provider=none"]) == cli.main(["config", str(tmp_path), "--set", "nothing=1"]) == 1
    answers = iter(["huggingface", "", "q", "", ""])
    assert config.asked(config.Settings(), lambda _: next(answers)) == {"provider": "huggingface", "search_model": "q"}


def test_index_versions(spark, tmp_path):
    store = index.VectorIndex(spark, f"file://{tmp_path}/index")
    row = lambda n: spark.createDataFrame([(str(n), "c", "f", 1, "t", [1.0])], index.ENTRY)
    for n in range(3):
        before = store.read("vectors")
        store.commit(store.stage("vectors", row(n)))
        assert [r.id for r in before.collect()] == [str(n - 1)] * (n > 0)  # a reader of the version before
    assert store.version() == 3 and store.count() == 1 and len(store._versions()) == 2
    assert len(store.vacuum()) == 1 and store.vacuum() == [] and [r.id for r in store.read("vectors").collect()] == ["2"]
    late = index.VectorIndex(spark, f"file://{tmp_path}/other")
    late._versions = dict  # a writer that has seen no version yet
    late.commit(late.stage("vectors", row(7)))
    with pytest.raises(FileExistsError):
        late.commit(late.stage("vectors", row(8)))
    again = index.VectorIndex(spark, f"file://{tmp_path}/other")
    assert again.version() == 1 and [r.id for r in again.read("vectors").collect()] == ["7"]


def test_a_build_that_fails_in_between_changes_neither_table(spark, tmp_path, monkeypatch):
    store, mock = index.VectorIndex(spark, f"file://{tmp_path}/index"), embeddings.MockProvider(4)
    first = sources(spark, a__ts="function one() {}\n")
    index.build_index(first, store, mock)
    old = [sorted(map(str, store.read(t).collect())) for t in ("vectors", "cache")]
    stage = store.stage

    def broken(table, df):
        if table == "vectors":
            raise RuntimeError("lost")
        return stage(table, df)

    monkeypatch.setattr(store, "stage", broken)
    with pytest.raises(RuntimeError):
        index.build_index(sources(spark, b__ts="class K {}\n"), store, mock)
    late = index.VectorIndex(spark, f"file://{tmp_path}/index")
    assert late.version() == 1 and [sorted(map(str, late.read(t).collect())) for t in ("vectors", "cache")] == old
    assert len(late.vacuum()) == 1  # the part of the cache that nothing names
    assert index.build_index(sources(spark, b__ts="class K {}\n"), late, mock) == {"entries": 1, "hits": 0, "misses": 1}
    assert late.read("cache").count() == 2 and late.count() == 1


def test_a_build_writes_its_misses_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_PARTS", 3)
    store, mock = index.VectorIndex(spark, f"file://{tmp_path}/index"), embeddings.MockProvider(64)
    entries = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) id", "concat('text ', id) content").withColumn("hash", F.md5("content"))

    def size(folder):
        return sum(p.stat().st_size for p in (tmp_path / "index" / folder).rglob("*.parquet"))

    sizes = []
    for a, b in ((0, 3000), (2700, 3300), (3000, 3600), (0, 3600)):
        df, part = index.embedded(entries(a, b), store, mock)
        rows = {r.id: (r.hit, r.embedding) for r in df.collect()}
        store.commit(cache=part)
        assert len(rows) == b - a and all(len(v[1]) == 64 for v in rows.values())
        sizes.append((sum(not h for h, _ in rows.values()), part["rows"], size(part["folder"])))
    assert [x[:2] for x in sizes] == [(3000, 3000), (300, 300), (300, 300), (0, 0)]
    assert sizes[1][2] < 0.2 * sizes[0][2] and sizes[3][2] < 0.02 * sizes[0][2]
    assert rows["5"][1] == pytest.approx(mock.embed_batch(["text 5"])[0], abs=1e-6)
    # A lookup reads the cache in its buckets: no exchange above its scan.
    part = store.parts()[0]
    plan = entries(0, 10).join(part.read().select("hash", "embedding").hint("merge"), "hash")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    part.forget()
    for a in (4000, 5000, 6000):
        store.commit(cache=index.embedded(entries(a, a + 10), store, mock)[1])
    assert len(store.manifest()["cache"]) <= 3 and store.read("cache").count() == 3630 and sum(x["rows"] for x in store.manifest()["cache"]) == 3630


def test_nearest_of_a_query_set(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rows = [(i, [float(i % 9), float(i % 4)]) for i in range(40)] + [(99, None), (None, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in search.nearest_each(vectors, vectors.where("vec_id % 5 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    for q in range(0, 40, 5):
        want = sorted((((a[0] - rows[q][1][0]) ** 2 + (a[1] - rows[q][1][1]) ** 2) ** 0.5, i) for i, a in rows[:40])[:4]
        assert [(round(d, 9), i) for d, i in sorted(got[q])] == [(round(d, 9), i) for d, i in want]
    assert set(got) == set(range(0, 40, 5))


def test_chains_agree_with_reachability(spark):
    rows = [(u, k, t) for t in range(40) for u, k in (("a", "x"), ("a", "y"), ("b", "x"))]
    df = spark.createDataFrame([(u, k, t, 1000 + i) for i, (u, k, t) in enumerate(rows)], "u string, kind string, t long, id long")
    seeds = df.where("(u = 'a' and kind = 'x' and t in (3, 17)) or (u = 'b' and t = 39)")
    edges = graph.last_of_kind_edges(df, ["u"], "kind", ["t"], "id")
    for backward in (False, True):
        got = graph.along_chains(df, seeds, ["u"], "kind", ["t"], "id", backward)
        want = graph.reachable(edges, seeds.select("u", F.col("id").alias("node")), "u", backward)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_graph_and_order_operators(spark):
    edges = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 3, 1), ("s", 4, 3), ("t", 1, 9)], "g string, src long, dst long")
    seeds = spark.createDataFrame([("s", 2), ("t", 9), ("u", 5)], "g string, node long")
    assert {(r.g, r.node) for r in graph.reachable(edges, seeds, "g").collect()} == {("s", 1), ("s", 2), ("s", 3), ("t", 9), ("u", 5)}
    assert {(r.g, r.node) for r in graph.reachable(edges, seeds, "g", backward=True).collect()} == {("s", 1), ("s", 2), ("s", 3), ("s", 4), ("t", 1), ("t", 9), ("u", 5)}
    ids = spark.createDataFrame([(i * i * 31 - 500,) for i in range(300)], "k long").repartition(5)
    assert [r.ordinal for r in ordering.with_ordinal(ids, "k").orderBy("k").collect()] == list(range(300))
    wide = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), *[(i,) for i in range(50)]], "k long")
    assert [r.ordinal for r in ordering.with_ordinal(wide, "k").orderBy("k").collect()] == list(range(52))
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.nearest(vectors, [7.4, 0.0], 3).collect()] == [7, 8, 6]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.ts").write_text("import x from 'y';\nfunction one(a: number) {\n  return a;\n}\n")
    here, file = str(tmp_path), str(tmp_path / "a.ts")

    def said(*argv):
        assert cli.main(list(argv)) == 0
        return capsys.readouterr().out

    assert said("tree", here).strip() == "└── a.ts"
    assert "function one (a.ts:2)" in said("structure", here)
    assert "one (a.ts:2)" in said("impact", "zzz", here) and "Nothing" in said("impact", "ONE", here)
    assert "one: complexity 1, blocks 2" in said("complexity", file)
    assert json.loads(said("slice", file, "one", "3"))["sliceLines"] == [2, 3, 4]
    assert json.loads(said("imports", file))["imports"][0]["module"] == "y"
    assert json.loads(said("config", here))["embeddings"]["provider"] == "mock"
    assert "--provider" in said("warm", here)
    assert json.loads(said("warm", here, "--provider", "mock"))["entries"] == 1
    assert "1. one (a.ts:2)" in said("semantic", "anything", here)
    assert cli.main(["slice", file, "one", "0"]) == 1
