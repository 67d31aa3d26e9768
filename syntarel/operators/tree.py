"""File trees from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_tree(paths: DataFrame, path: str = "path", locale: bool = True) -> DataFrame:
    """path, parent_path, name, depth, is_directory, position, is_last of every file and directory above it.

    Siblings are in order: directories first, then by name in the order of the root locale (``_x, a, A, b, B``), equal ones by code; without ``locale``, all by code.
    """
    parts = paths.select(F.filter(F.split(path, "/"), lambda x: x != "").alias("parts")).where("size(parts) > 0").distinct()
    prefixes = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    nodes = prefixes.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("parent_path"), F.element_at("parts", F.col("depth")).alias("name"), (F.col("depth") - 1).alias("depth"), (F.col("depth") < F.size("parts")).alias("is_directory"))
    # A name can be a file in one path and a directory in another: it is a directory.
    nodes = nodes.groupBy("path", "parent_path", "name", "depth").agg(F.max("is_directory").alias("is_directory"))
    siblings = W.partitionBy("parent_path")
    place = F.row_number().over(siblings.orderBy(F.desc("is_directory"), *([F.collate("name", "UNICODE")] if locale else []), "name"))
    return nodes.withColumn("position", place).withColumn("is_last", F.col("position") == F.count("*").over(siblings))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """path, places, line: the box-drawing line of every row of :func:`file_tree`, in order of ``places``.

    A node's places among its siblings, from the top, are its key in the whole
    order, and its ancestors' ``is_last`` draw the line: a join with its ancestors, a
    row for each level, so no tree is walked in one place.
    """
    levels = nodes.select("path", "name", "is_directory", F.explode(F.sequence(F.lit(1), F.col("depth") + 1)).alias("level"))
    above = nodes.select(F.col("path").alias("at"), F.col("position"), F.col("is_last").alias("last"))
    joined = levels.join(above, F.expr("substring_index(path, '/', level)") == F.col("at"))
    one = joined.groupBy("path").agg(F.first("name").alias("name"), F.first("is_directory").alias("is_directory"), F.sort_array(F.collect_list(F.struct("level", "position", "last"))).alias("up"))
    around = F.array_join(F.transform(F.slice("up", 1, F.size("up") - 1), lambda x: F.when(x["last"], "    ").otherwise("│   ")), "")
    branch = F.when(F.element_at("up", -1)["last"], "└── ").otherwise("├── ")
    return one.select("path", F.col("up.position").alias("places"), F.concat(around, branch, "name", F.when(F.col("is_directory"), "/").otherwise("")).alias("line"))


def render_tree(root: list[dict]) -> str:
    """Box-drawing text of a (collected) tree, ordered by path position."""
    children: dict[str, list[dict]] = {}
    for x in root:
        children.setdefault(x["parent_path"], []).append(x)

    def lines(parent: str, prefix: str) -> list[str]:
        out = []
        for x in sorted(children.get(parent, []), key=lambda y: y["position"]):
            out.append(prefix + ("└── " if x["is_last"] else "├── ") + x["name"] + "/" * x["is_directory"])
            out += lines(x["path"], prefix + ("    " if x["is_last"] else "│   "))
        return out

    return "\n".join(lines("", ""))
