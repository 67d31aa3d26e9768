"""Sources to tables: files, syntax nodes and imports.

``ast_nodes`` numbers a file's nodes in pre-order (``pre``) and gives the last number
in each subtree (``last``). ``within`` lists the functions and classes around a
node, from the outermost, so that "inside of" joins on equality. ``role`` says what an
identifier does, and ``since`` from which function on it is looked at. Every analysis
behind the table is relational.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files as listing
from .imports import imports_of
from .outline import outline
from .references import role_of, way_below
from .rules import CLASS_KINDS, FLOW_FUNCTIONS, FLOW_LANGUAGES, FUNCTION_KINDS, IGNORED, IGNORED_IN_TREE, LANGUAGES
from .script import Node, parse_script

NODES = "path string, language string, pre int, last int, parent int, depth int, seq int, kind string, field string, text string, start_line int, start_col int, end_line int, end_col int, within array<int>, role string, since int"
IMPORTS = "path string, ord int, module string, names array<string>, isFrom boolean, isDefault boolean, aliases map<string,string>"
#: Fields whose full text analyses read; other inner nodes have none.
_TEXT_OF = {"name", "function", "method", "property", "operator", "source"}


def language_of(path: Column, sensitive: bool = False) -> Column:
    """Language by the extension of a path's last segment, or null; dotfiles have none."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name if sensitive else F.lower(name), r"^.+(\.[^.]*)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def _below(full: Column, root: str) -> Column:
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    return F.regexp_replace(full, "^.*?" + re.escape(base).replace("\\-", "-") + "/", "")


def unlisted_files(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> list:
    """File states of what Spark's readers leave out below ``root``: names that begin with an underscore or a dot, such as ``__init__.py``, and all below such folders.

    They are found by patterns, level by level, in the file system's own listing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    out, level = [], root.rstrip("/")
    while fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/*")):
        for state in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/[_.]*")) or ():
            found = fs.listFiles(state.getPath(), True) if state.getPath().getName() not in ignored else None
            while found is not None and found.hasNext():
                out.append(found.next())
        level += "/[!_.]*"
    return out


def _unlisted(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """full, modified of :func:`unlisted_files`."""
    rows = [(x.getPath().toString(), x.getModificationTime()) for x in unlisted_files(spark, root, ignored)]
    return spark.createDataFrame(rows, "full string, ms long").select("full", F.timestamp_millis("ms").alias("modified"))


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), language, text of every supported file; ignored names are skipped on the way.

    Files are listed and read in tasks. Unreadable ones fail the scan unless
    ``spark.sql.files.ignoreMissingFiles`` or its like says otherwise. Where only Spark
    opens the file system, its readers are used, and files that these leave out by their names
    are read one by one through the driver.
    """
    if at := listing.address(spark, root):
        found = listing.listed(spark, at, IGNORED).withColumn("language", language_of(F.col("path"), sensitive=True)).where("language is not null")
        return listing.contents(found.select("path", "language", "bytes"), at).select("path", "language", "text")
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("full"))
    some = _kept(_unlisted(spark, root), root).select("full").collect()
    if some:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        rows = []
        for r in some:
            target = jvm.org.apache.hadoop.fs.Path(r["full"])
            stream = target.getFileSystem(conf).open(target)
            try:
                rows.append((jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), r["full"]))
            finally:
                stream.close()
        files = files.unionByName(spark.createDataFrame(rows, "text string, full string"))
    return _kept(files, root).select("path", "language", "text")


def _kept(files: DataFrame, root: str) -> DataFrame:
    """Adds path and language; supported files below no ignored name."""
    named = files.withColumn("path", _below(F.col("full"), root)).withColumn("language", language_of(F.col("path"), sensitive=True))
    return named.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*IGNORED)) & F.col("language").isNotNull())


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``) of every file that the tree shows: supported whatever the case of its extension, below no name that it skips; nothing is read but names."""
    if at := listing.address(spark, root):
        return listing.listed(spark, at, IGNORED_IN_TREE).where(language_of(F.col("path")).isNotNull()).select("path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"))
    files = listed.unionByName(_unlisted(spark, root, IGNORED_IN_TREE).select("full")).select(_below(F.col("full"), root).alias("path"))
    return files.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*IGNORED_IN_TREE)) & language_of(F.col("path")).isNotNull())


def changed_files(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """path, modified of files below ``root`` that ``known`` (path, modified) lacks in this state; nothing is read but names and times."""
    if at := listing.address(spark, root):
        now = listing.listed(spark, at, [x for x in IGNORED if x[0] in "_."]).select(F.concat(F.lit(at + "/"), "path").alias("path"), "modified")
        return now.join(known.select("path", "modified"), ["path", "modified"], "left_anti")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"))
    files = listed.unionByName(_unlisted(spark, root).select(F.col("full").alias("path"), "modified"))
    return files.join(known.select("path", "modified"), ["path", "modified"], "left_anti")


def tree_of(text: str, language: str) -> Node:
    """The syntax tree or outline of one source."""
    return parse_script(text, language == "typescript") if language in FLOW_LANGUAGES else outline(text, language)


def rows_of(path: str, language: str, text: str, root: Node) -> list[tuple]:
    """A tree's nodes as rows of ``ast_nodes``."""
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    rows: list[list] = []
    scopes = {"class_declaration", *FLOW_FUNCTIONS, *FUNCTION_KINDS.get(language, ()), *CLASS_KINDS.get(language, ())}
    looked = language in FLOW_LANGUAGES
    stack: list[tuple] = [(root, -1, 0, 0, [], "read" if looked else None, 0)]
    while stack:
        node, parent, depth, seq, within, way, since = stack.pop()
        pre = len(rows)
        a, b = bisect.bisect_right(lines, node.start) - 1, bisect.bisect_right(lines, node.end) - 1
        body = text[node.start : node.end] if not node.children or node.name in _TEXT_OF else None
        rows.append([path, language, pre, pre, parent, depth, seq, node.kind, node.name or None, body, a + 1, node.start - lines[a], b + 1, node.end - lines[b], within, role_of(way, node), since])
        if looked and way is None and node.kind in FLOW_FUNCTIONS:
            since = pre
        inner = [*within, pre] if node.kind in scopes else within
        stack += [(c, pre, depth + 1, k, inner, way_below(way, node, c) if looked else None, since) for k, c in reversed(list(enumerate(node.children)))]
    for row in reversed(rows):
        if row[4] >= 0:
            rows[row[4]][3] = max(rows[row[4]][3], row[3])
    return [tuple(r) for r in rows]


def _mapped(sources: DataFrame, each, schema: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(parsed)
        for batch in batches:
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = each(path, language, text or "")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    from pyspark.sql import types as T

    parsed = T._parse_datatype_string(schema)
    return sources.select("path", "language", "text").mapInArrow(run, parsed)


def ast_nodes(sources: DataFrame) -> DataFrame:
    """The nodes of all sources (path, language, text). A source that can't be read in part has ``ERROR`` nodes."""
    return _mapped(sources, lambda p, lang, t: rows_of(p, lang, t, tree_of(t, lang)), NODES)


def stored(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes written to a new table and read from it: analyses look at them several times, and parsing is what costs."""
    nodes.write.parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def imports(sources: DataFrame) -> DataFrame:
    """Import statements of all sources, in order."""
    return _mapped(sources, lambda p, lang, t: [(p, k, *r) for k, r in enumerate(imports_of(t, lang))], IMPORTS)
