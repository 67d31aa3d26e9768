"""Code analyses over ``ast_nodes``, as joins, windows and aggregates.

"Inside of" is a join on the path and on the number of an enclosing function, which
each node lists, so every join below is an equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.rules import CALL_KINDS, CASES, CLASS_KINDS, COUNTED_OPERATORS, DECISIONS, FLOW_FUNCTIONS, FLOW_LANGUAGES, FUNCTION_KINDS, KEYWORDS, LOOPS, MEMBER_KINDS
from .graph import closure

PROTOTYPE_NAMES = ["constructor", "toString", "valueOf", "hasOwnProperty", "isPrototypeOf", "propertyIsEnumerable", "toLocaleString"]


def _rule(table: dict[str, list[str]]) -> Column:
    """Does a node's kind stand in its language's list?"""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.coalesce(F.array_contains(F.element_at(known, F.col("language")), F.col("kind")), F.lit(False))


def _fields(nodes: DataFrame, *fields: str) -> DataFrame:
    """(path, parent) with the first child of each field as a struct."""
    some = nodes.where(F.col("field").isin(*fields))
    first = [F.min(F.when(F.col("field") == f, F.struct("seq", "pre", "last", "text", "kind"))).alias(f"f_{f}") for f in fields]
    return some.groupBy("path", "parent").agg(*first).withColumnRenamed("parent", "pre")


def code_units(nodes: DataFrame) -> DataFrame:
    """path, pre, type, name, line of functions, methods and classes."""
    is_class = (F.col("kind") == "class_declaration") | _rule(CLASS_KINDS)
    is_function = F.col("kind").isin("function_declaration", "method_definition") | _rule(FUNCTION_KINDS)
    kind = F.when(is_class, "class").when(is_function, F.when(F.col("kind") == "method_definition", "method").otherwise("function"))
    units = nodes.withColumn("type", kind).where("type is not null")
    name = F.coalesce("f_name.text", F.when(F.col("type") == "class", "Anonymous").otherwise("anonymous"))
    return units.join(_fields(nodes, "name"), ["path", "pre"], "left").select("path", "pre", "type", name.alias("name"), F.col("start_line").alias("line"))


def impact(units: DataFrame, target: str) -> DataFrame:
    """Functions and methods whose lower-cased name doesn't hold the target; none for an empty target."""
    return units.where(F.col("type").isin("function", "method") & ~F.contains(F.lower("name"), F.lower(F.lit(target))))


def defines(nodes: DataFrame) -> DataFrame:
    """path, pre, name of definitions that have a name."""
    functions = {k: [*v, *(["arrow_function"] if k in FLOW_LANGUAGES else [])] for k, v in FUNCTION_KINDS.items()}
    classes = {k: [x for x in v if x != "union_specifier"] for k, v in CLASS_KINDS.items()}
    some = nodes.where(_rule(functions) | _rule(classes))
    return some.join(_fields(nodes, "name"), ["path", "pre"]).select("path", "pre", F.col("f_name.text").alias("name"))


def calls(nodes: DataFrame) -> DataFrame:
    """path, callee and the first place (``at``) of each callee of a file; reads of properties count."""
    fields = _fields(nodes, "function", "name", "method", "property")
    joined = nodes.select("path", "language", "kind", "pre").join(fields, ["path", "pre"])
    direct = joined.where(_rule(CALL_KINDS)).select("path", F.struct("pre", F.lit(0).alias("k")).alias("at"), F.coalesce("f_function.text", "f_name.text", "f_method.text").alias("callee"))
    reads = joined.where(F.col("kind").isin(*MEMBER_KINDS)).select("path", F.struct("pre", F.lit(1).alias("k")).alias("at"), F.col("f_property.text").alias("callee"))
    return direct.unionByName(reads).where("callee is not null").groupBy("path", "callee").agg(F.min("at").alias("at"))


def file_calls(nodes: DataFrame) -> DataFrame:
    """path, defines, calls: ordered names of every file."""
    d = defines(nodes).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pre", "name"))).alias("d"))
    c = calls(nodes).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "callee"))).alias("c"))
    empty = F.array().cast("array<string>")
    return nodes.select("path").distinct().join(d, "path", "left").join(c, "path", "left").select("path", F.coalesce(F.col("d.name"), empty).alias("defines"), F.coalesce(F.col("c.callee"), empty).alias("calls"))


def call_graph(nodes: DataFrame) -> DataFrame:
    """caller, callee, at: every defined name without a callee, and ``__global`` with each callee and the place (path, pre, k) where it is seen first."""
    first = calls(nodes).groupBy("callee").agg(F.min(F.struct("path", "at.pre", "at.k")).alias("at"))
    edges = first.select(F.lit("__global").alias("caller"), "callee", "at")
    keys = defines(nodes).select(F.col("name").alias("caller")).distinct().where("caller <> '__global'")
    return keys.select("caller", F.lit(None).cast("string").alias("callee"), F.lit(None).cast(edges.schema["at"].dataType).alias("at")).unionByName(edges)


def callers(nodes: DataFrame) -> DataFrame:
    """caller, callee pairs: each call with the innermost named definition around it."""
    named = defines(nodes).select("path", F.col("pre").alias("d_pre"), F.col("name").alias("caller"))
    fields = _fields(nodes, "function", "name", "method")
    made = nodes.where(_rule(CALL_KINDS)).select("path", "pre", "within").join(fields, ["path", "pre"]).select("path", "pre", "within", F.coalesce("f_function.text", "f_name.text", "f_method.text").alias("callee")).where("callee is not null")
    inside = made.select("path", "pre", "callee", F.explode("within").alias("d_pre")).join(named, ["path", "d_pre"])
    return inside.groupBy("path", "pre", "callee").agg(F.max_by("caller", "d_pre").alias("caller")).select("path", "caller", "callee").distinct()


def flow_functions(nodes: DataFrame) -> DataFrame:
    """The first function of each name in a file, with its span of lines and its body's range."""
    some = nodes.where(F.col("language").isin(*FLOW_LANGUAGES) & F.col("kind").isin(*FLOW_FUNCTIONS))
    joined = some.join(_fields(nodes, "name", "body"), ["path", "pre"]).where("f_name is not null")
    lasts = nodes.groupBy("path", F.col("parent").alias("pre")).agg(F.max_by(F.struct("pre", "last", "kind"), "seq").alias("tail"))
    tail = F.when(~F.col("tail.kind").isin("=>", "formal_parameters"), F.col("tail"))
    whole = joined.join(lasts, ["path", "pre"], "left")
    body = F.when(F.col("f_body").isNotNull(), F.struct(F.col("f_body.pre").alias("pre"), F.col("f_body.last").alias("last"))).otherwise(F.struct(tail["pre"].alias("pre"), tail["last"].alias("last")))
    picked = F.struct("pre", "start_line", "end_line", body.alias("body"))
    return whole.groupBy("path", F.col("f_name.text").alias("function")).agg(F.min_by(picked, "pre").alias("x")).select("path", "function", "x.pre", "x.start_line", "x.end_line", F.col("x.body.pre").alias("b_pre"), F.col("x.body.last").alias("b_last"))


def _inside(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of each function's body, the body included."""
    own = functions.select("path", "function", F.col("pre").alias("f_pre"), "b_pre", "b_last")
    scoped = nodes.where("size(within) > 0").withColumn("f_pre", F.explode("within"))
    return scoped.join(own, ["path", "f_pre"]).where("pre between b_pre and b_last")


def complexity(nodes: DataFrame) -> DataFrame:
    """path, function, complexity, block_count of the first function of each name."""
    functions = flow_functions(nodes)
    direct = nodes.groupBy("path", F.col("parent").alias("pre")).agg(F.count_if(F.col("kind").isin(*CASES)).alias("cases"), F.max(F.col("kind") == "else_clause").alias("has_else"), F.max(F.when(F.col("field") == "operator", F.col("text"))).alias("sign"))
    inner = _inside(functions, nodes).join(direct, ["path", "pre"], "left")
    kind, cases = F.col("kind"), F.coalesce("cases", F.lit(0))
    points = F.when(kind == "switch_statement", F.greatest(cases, F.lit(1))).when(kind.isin(*DECISIONS), 1).when((kind == "binary_expression") & F.col("sign").isin(*COUNTED_OPERATORS), 1).otherwise(0)
    blocks = F.when(kind == "if_statement", 1 + F.coalesce(F.col("has_else"), F.lit(False)).cast("int")).when(kind.isin(*LOOPS), 1).when(kind == "switch_statement", cases).otherwise(0)
    sums = inner.groupBy("path", "function").agg((F.sum(points) + 1).cast("int").alias("complexity"), (F.sum(blocks) + 2).cast("int").alias("block_count"))
    # A function without a body has one path through two blocks.
    return functions.select("path", "function").join(sums, ["path", "function"], "left").select("path", "function", F.coalesce("complexity", F.lit(1)).alias("complexity"), F.coalesce("block_count", F.lit(2)).alias("block_count"))


def unit_complexity(nodes: DataFrame) -> DataFrame:
    """Every function and method with the figures of the first function of its name; 0 where there's none."""
    units = code_units(nodes).where(F.col("type").isin("function", "method"))
    found = complexity(nodes).withColumnRenamed("function", "name")
    zero = F.lit(0)
    return units.join(found, ["path", "name"], "left").select("path", "name", "line", F.coalesce("complexity", zero).alias("complexity"), F.coalesce("block_count", zero).alias("block_count"))


def cfg_blocks(nodes: DataFrame) -> DataFrame:
    """path, function, id, type, start_line, end_line of every block."""
    functions = flow_functions(nodes)
    cases = nodes.where(F.col("kind").isin(*CASES)).select("path", "pre", "parent", "start_line", "end_line")
    inner = _inside(functions, nodes)
    plain = inner.where(F.col("kind").isin("if_statement", *LOOPS)).select("path", "function", F.lit(1).alias("rank"), "pre", F.lit(0).alias("sub"), F.lit("branch").alias("type"), "start_line", "end_line")
    switches = inner.where("kind = 'switch_statement'").select("path", "function", F.col("pre").alias("parent"))
    arms = switches.join(cases, ["path", "parent"]).select("path", "function", F.lit(1).alias("rank"), F.col("parent").alias("pre"), F.col("pre").alias("sub"), F.lit("branch").alias("type"), "start_line", "end_line")
    zero = F.lit(0)

    def edge(kind: str, rank: int, first: str, last: str, source: DataFrame) -> DataFrame:
        return source.select("path", "function", F.lit(rank).alias("rank"), zero.alias("pre"), zero.alias("sub"), F.lit(kind).alias("type"), F.col(first).alias("start_line"), F.col(last).alias("end_line"))

    rows = plain.unionByName(arms).unionByName(edge("entry", 0, "start_line", "start_line", functions)).unionByName(edge("body", 2, "start_line", "end_line", functions.where("b_pre is not null"))).unionByName(edge("exit", 3, "end_line", "end_line", functions))
    order = W.partitionBy("path", "function").orderBy("rank", "pre", "sub")
    return rows.select("path", "function", (F.row_number().over(order) - 1).alias("id"), "type", "start_line", "end_line")


def cfg_edges(blocks: DataFrame) -> DataFrame:
    """path, function, source, target, type: the chain of blocks."""
    following = F.lead("id").over(W.partitionBy("path", "function").orderBy("id"))
    return blocks.select("path", "function", F.col("id").alias("source"), following.alias("target"), F.lit("sequential").alias("type")).where("target is not null")


def var_refs(nodes: DataFrame) -> DataFrame:
    """path, fn_pre, seq, name, ref_type, line, col: definitions, updates and uses in every named function with a body, in order (TypeScript and JavaScript).

    Scopes and branches don't count: an assignment defines a name that nothing in the
    function has defined before it, and updates it otherwise.
    """
    some = nodes.where(F.col("language").isin(*FLOW_LANGUAGES) & F.col("kind").isin(*FLOW_FUNCTIONS))
    functions = some.join(_fields(nodes, "name", "body"), ["path", "pre"]).where("f_name is not null and f_body is not null").select("path", F.col("pre").alias("fn_pre"))
    told = nodes.where(F.col("role").isNotNull() & ~((F.col("role") == "use") & F.col("text").isin(*KEYWORDS)))
    seen = told.select("path", "pre", F.col("text").alias("name"), "role", "since", F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.explode("within").alias("fn_pre")).where("fn_pre >= since")
    events = seen.join(functions, ["path", "fn_pre"], "left_semi")
    before = W.partitionBy("path", "fn_pre", "name").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.col("role").isin("define", "assign")).over(before), F.lit(False))
    kinds = F.when(F.col("role") == "augment", F.array(F.lit("use"), F.lit("update"))).otherwise(F.array(F.when(F.col("role") == "use", "use").when((F.col("role") == "assign") & F.col("known"), "update").otherwise("definition")))
    rows = events.withColumn("known", known).select("path", "fn_pre", "pre", "name", "line", "col", F.posexplode(kinds).alias("k", "ref_type"))
    seq = F.row_number().over(W.partitionBy("path", "fn_pre").orderBy("pre", "k"))
    return rows.select("path", "fn_pre", seq.alias("seq"), "name", "ref_type", "line", "col")


def function_refs(nodes: DataFrame) -> DataFrame:
    """Variable references of the first function of each name."""
    own = flow_functions(nodes).select("path", "function", F.col("pre").alias("fn_pre"))
    return var_refs(nodes).join(own, ["path", "fn_pre"]).drop("fn_pre")


def dfg_edges(refs: DataFrame) -> DataFrame:
    """path, function, name, def_line, def_col, use_line, use_col, seq of the use: uses with the definition that reaches them.

    Line by line, definitions of a line stand before its uses.
    """
    use = F.col("ref_type") == "use"
    window = W.partitionBy("path", "function", "name").orderBy("line", use.cast("int"), "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.last(F.when(~use, F.struct("line", "col", "seq")), ignorenulls=True).over(window)
    found = refs.withColumn("d", reach).where(use & F.col("d").isNotNull())
    return found.select("path", "function", "name", F.col("d.line").alias("def_line"), F.col("d.col").alias("def_col"), F.col("d.seq").alias("def_seq"), F.col("line").alias("use_line"), F.col("col").alias("use_col"), F.col("seq").alias("use_seq"))


def variables(refs: DataFrame) -> DataFrame:
    """path, function, name, first: variables in order of first sight, with the lines of their references."""
    return refs.groupBy("path", "function", "name").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "ref_type", "line", "col"))).alias("refs"))


def pdg_nodes(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Blocks with the definitions and uses on their first line."""
    use = F.col("ref_type") == "use"
    at = refs.groupBy("path", "function", F.col("line").alias("start_line")).agg(F.array_sort(F.collect_list(F.when(~use, F.struct("seq", "name")))).alias("d"), F.array_sort(F.collect_list(F.when(use, F.struct("seq", "name")))).alias("u"))
    empty = F.array().cast("array<string>")
    return blocks.join(at, ["path", "function", "start_line"], "left").select("path", "function", "id", "type", "start_line", "end_line", F.coalesce("d.name", empty).alias("definitions"), F.coalesce("u.name", empty).alias("uses"))


def pdg_edges(blocks: DataFrame, flows: DataFrame) -> DataFrame:
    """path, function, source, target, dep, label: control edges along the chain, data edges between the first blocks of two lines."""
    control = cfg_edges(blocks).select("path", "function", "source", "target", F.lit("control").alias("dep"), F.lit("sequential").alias("label"))
    first = blocks.groupBy("path", "function", F.col("start_line").alias("line")).agg(F.min("id").alias("id"))
    source = first.select("path", "function", F.col("line").alias("def_line"), F.col("id").alias("source"))
    target = first.select("path", "function", F.col("line").alias("use_line"), F.col("id").alias("target"))
    data = flows.join(source, ["path", "function", "def_line"]).join(target, ["path", "function", "use_line"]).where("source <> target")
    return control.unionByName(data.select("path", "function", "source", "target", F.lit("data").alias("dep"), F.col("name").alias("label")))


def slice_by_blocks(blocks: DataFrame, line: int, forward: bool = False) -> DataFrame:
    """path, function, line: the lines of a slice.

    The control chain is never filtered and data edges only lead on, so what is
    reached is every block up to the last seed (or from the first one, forward).
    """
    seeds = blocks.where((F.col("start_line") <= line) & (F.col("end_line") >= line)).groupBy("path", "function").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    reached = blocks.join(seeds, ["path", "function"]).where("id >= low" if forward else "id <= high")
    return reached.select("path", "function", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def edges_of(edges: DataFrame, variable: str | None) -> DataFrame:
    """The edges that a slice by a variable follows: all control edges, and the data edges with its name; all without one."""
    return edges if not variable else edges.where((F.col("dep") == "control") | (F.col("label") == variable))


def slice_generic(nodes: DataFrame, edges: DataFrame, line: int, variable: str | None = None, forward: bool = False) -> DataFrame:
    """path, function, line of a slice over any dependence graph, all functions together."""
    kept = edges_of(edges, variable)
    seeds = nodes.where((F.col("start_line") <= line) & (F.col("end_line") >= line)).select("path", "function", F.col("id").alias("node"))
    steps = kept.select("path", "function", F.col("source").alias("src"), F.col("target").alias("dst"))
    found = closure(steps, seeds, ["path", "function"], backward=not forward).withColumnRenamed("node", "id")
    return nodes.join(found, ["path", "function", "id"]).select("path", "function", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def line_dependencies(nodes: DataFrame, edges: DataFrame, line: int) -> DataFrame:
    """path, function, bucket, edges: edges that meet the blocks around a line, by kind and direction."""
    at = nodes.where((F.col("start_line") <= line) & (F.col("end_line") >= line)).select("path", "function", "id")
    into = edges.join(at.withColumnRenamed("id", "target"), ["path", "function", "target"], "left_semi").withColumn("bucket", F.concat("dep", F.lit("_in")))
    out = edges.join(at.withColumnRenamed("id", "source"), ["path", "function", "source"], "left_semi").withColumn("bucket", F.concat("dep", F.lit("_out")))
    return into.unionByName(out).groupBy("path", "function", "bucket").agg(F.count("*").alias("edges"))


def with_source(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``code``, the source of each line; empty past the end."""
    text = sources.select("path", F.posexplode(F.split("text", "\n")).alias("p", "code")).withColumn("line", F.col("p") + 1).drop("p")
    return lines.join(text, ["path", "line"], "left").withColumn("code", F.coalesce("code", F.lit("")))


def index_entries(sources: DataFrame, nodes: DataFrame, around: int = 5) -> DataFrame:
    """id, file, line, type, content of every unit: the lines around it and, for functions, counts of its references and flows."""
    units = code_units(nodes)
    own = function_refs(nodes)
    counts = own.groupBy("path", F.col("function").alias("name")).agg(F.count("*").alias("vars"))
    chains = dfg_edges(own).groupBy("path", F.col("function").alias("name")).agg(F.count("*").alias("chains"))
    lines = sources.select("path", F.split("text", "\n").alias("l"))
    joined = units.join(lines, "path").join(counts, ["path", "name"], "left").join(chains, ["path", "name"], "left")
    first = F.greatest(F.lit(1), F.col("line") - around)
    window = F.array_join(F.slice("l", first, F.least(F.size("l"), F.col("line") + around) - first + 1), "\n")
    note = F.when(F.col("type").isin("function", "method"), F.format_string("\n\nvars:%d, def-use chains:%d", F.coalesce("vars", F.lit(0)), F.coalesce("chains", F.lit(0)))).otherwise("")
    return joined.select(F.concat_ws(":", "path", F.col("line").cast("string"), "name").alias("id"), F.col("path").alias("file"), "line", "type", F.concat(window, note).alias("content"))
