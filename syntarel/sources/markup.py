"""Markup as nested sets: a table function over pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: Elements that have no end (fixed by the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = re.compile(r"(<(script|style)\b[^>]*>).*?(?=</\2\s*>|\Z)", re.S | re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>")

NODES = "pre int, last int, parent int, depth int, tag string"


def elements(text: str | None) -> list[list]:
    """[pre, last, parent, depth, tag] of every element, in order of their starts.

    An end closes the innermost open element of its name and all inside of it; one
    without a start is passed over. What is open at the end ends there. Comments and what
    scripts and styles hold are no markup.
    """
    rows: list[list] = []
    open_: list[int] = []
    for m in _TAG.finditer(_COMMENT.sub("", _RAW.sub(r"\1", text or ""))):
        tag = m[2].lower()
        if m[1]:
            at = next((k for k in range(len(open_) - 1, -1, -1) if rows[open_[k]][4] == tag), None)
            if at is not None:
                for pre in open_[at:]:
                    rows[pre][1] = len(rows) - 1
                del open_[at:]
            continue
        pre = len(rows)
        rows.append([pre, pre, open_[-1] if open_ else -1, len(open_), tag])
        if tag not in VOID and not m[0].endswith("/>"):
            open_.append(pre)
    for pre in open_:
        rows[pre][1] = len(rows) - 1
    return rows


class _Markup:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from map(tuple, elements(html))


markup_nodes = udtf(_Markup, returnType=NODES)


def page_nodes(pages: DataFrame, html: str = "html", where: str | None = None) -> DataFrame:
    """All columns of ``pages`` but ``html``, and pre, last, parent, depth, tag of each element: the table function joined laterally.

    Spark moves no filter below a Python table function, so one on the pages' own columns
    is given as ``where`` and applied before it, down to the scan.
    """
    spark: SparkSession = pages.sparkSession
    spark.udtf.register("syntarel_markup", markup_nodes)
    others = ", ".join(f"p.`{c}`" for c in pages.columns if c != html)
    return spark.sql(f"select {others}, m.* from {{pages}} p, lateral syntarel_markup(p.`{html}`) m", pages=pages.where(where) if where else pages)
