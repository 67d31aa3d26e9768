"""Import statements of a source, by language."""

from __future__ import annotations

import ast
import re

from .outline import blank
from .script import Node, parse_script

#: module, names, isFrom, isDefault, aliases
Import = tuple[str, list[str], bool, bool, dict[str, str]]


def imports_of(text: str, language: str) -> list[Import]:
    """In the order of the source; an unknown language or unreadable source has none."""
    if language in ("typescript", "javascript"):
        return _script(text, parse_script(text, language == "typescript"))
    return globals().get(f"_{language}", lambda _: [])(text)


def _script(text: str, root: Node) -> list[Import]:
    out: list[Import] = []
    stack = [root]
    while stack:
        node = stack.pop()
        stack += reversed(node.children)
        if node.kind != "import_statement":
            continue
        source = next((c for c in node.children if c.kind == "string"), None)
        if source is None:
            continue
        names: list[str] = []
        aliases: dict[str, str] = {}
        default = False
        for clause in (c for c in node.children if c.kind == "import_clause"):
            for part in clause.children:
                if part.kind == "identifier":
                    names.append(text[part.start : part.end])
                    default = True
                elif part.kind == "namespace_import":
                    names.append("*")
                    aliases[text[part.children[-1].start : part.children[-1].end]] = "*"
                elif part.kind == "named_imports":
                    for one in (c for c in part.children if c.kind == "import_specifier"):
                        words = {c.name: text[c.start : c.end] for c in one.children if c.name}
                        names.append(words["name"])
                        if "alias" in words:
                            aliases[words["alias"]] = words["name"]
        out.append((text[source.start + 1 : source.end - 1], names, True, default, aliases))
    return out


def _python(text: str) -> list[Import]:
    """Every imported name is given, and relative modules keep their dots."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = sorted((n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset))
    out: list[Import] = []
    for n in found:
        names, aliases = [a.name for a in n.names], {a.asname: a.name for a in n.names if a.asname}
        if isinstance(n, ast.Import):
            out.append((names[-1], names, False, False, aliases))
        else:
            out.append(("." * n.level + (n.module or ""), names, True, False, aliases))
    return out


def _php(text: str) -> list[Import]:
    out: list[Import] = []
    bare = blank(text, "php")
    for m in re.finditer(r"(?:^|[{};])\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*(?:\{([^}]*)\})?\s*;", bare, re.M):
        if m[3] is not None:
            names = [x.split(" as ")[0].strip() for x in m[3].split(",") if x.strip()]
            aliases = {x.split(" as ")[1].strip(): x.split(" as ")[0].strip() for x in m[3].split(",") if " as " in x}
            out.append((m[1].rstrip("\\"), names, True, False, aliases))
        else:
            out.append((m[1], [m[1].rsplit("\\", 1)[-1]], True, False, {m[2]: m[1]} if m[2] else {}))
    return out


def _rust(text: str) -> list[Import]:
    paths = (re.sub(r"\s+", " ", m[1]).strip() for m in re.finditer(r"\buse\s+([^;]+);", blank(text, "rust")))
    return [(p, [p], True, False, {}) for p in paths]


def _included(text: str) -> list[tuple[int, Import]]:
    return [(m.start(), (m[1], [], True, False, {})) for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', text, re.M)]


def _c(text: str) -> list[Import]:
    return [x for _, x in _included(text)]


def _cpp(text: str) -> list[Import]:
    bare = blank(text, "cpp")
    using: list[tuple[int, Import]] = [(m.start(), ("", [m[1].rsplit("::", 1)[-1]], False, False, {})) for m in re.finditer(r"\busing\s+(?:namespace\s+)?((?:\w+::)*\w+)\s*;", bare)]
    return [x for _, x in sorted(_included(text) + using, key=lambda y: y[0])]


def _go(text: str) -> list[Import]:
    out: list[Import] = []
    for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|([\w.]+\s+)?([\"`][^\"`]+[\"`]))", text, re.M):
        if m[1] is None:
            path = m[3].replace('"', "").strip("`")
            out.append((path, [], True, False, {m[2].strip(): path} if m[2] else {}))
        else:
            each = re.findall(r"^\s*([\w.]+\s+)?[\"`]([^\"`]+)[\"`]", m[1], re.M)
            out.append(("", [p for _, p in each], True, False, {a.strip(): p for a, p in each if a.strip()}))
    return out


def _java(text: str) -> list[Import]:
    out: list[Import] = []
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", blank(text, "java"), re.M):
        out.append((m[1], [m[1], "*"] if m[2] else [m[1]], True, False, {}))
    return out


def _kotlin(text: str) -> list[Import]:
    return [(m[1], [m[1]], True, False, {m[2]: m[1]} if m[2] else {}) for m in re.finditer(r"^\s*import\s+([\w.]+(?:\.\*)?)(?:\s+as\s+(\w+))?", blank(text, "kotlin"), re.M)]
