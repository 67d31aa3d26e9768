"""Outlines of sources in other languages: definitions, calls and imports.

Python is read by its own parser. The others are scanned as text whose comments
and strings are blanked; braces give a definition's extent. An outline is a tree
of the kinds that the analyses ask for, each with a ``name`` or ``function`` child.
"""

from __future__ import annotations

import ast
import re

from .script import Node

_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_NOT_CALLS = set("if for while switch return catch when match fn func fun function def sizeof new throw else do elif with class struct enum union impl mod use echo print isset unset array list foreach elseif synchronized super this in is as not and or defer select range assert using namespace template typename import package".split())
_CONTROL = set("if for while switch return catch else do".split())
_CALL = re.compile(r"(?<![\w.:>])([A-Za-z_$][\w]*(?:(?:::|\.|->)[A-Za-z_]\w*)*)\s*!?\(")

#: A call on the value of a bracketed expression, such as ``a().b(``.
_CHAINED = re.compile(r"(?<=[)\]}])(?:\s*(?:::|\.|->)\s*[A-Za-z_]\w*)+\s*!?\(")

#: By language: (pattern with a group ``name``, kind).
_DEFINITIONS = {
    "php": [(r"\b(?:abstract\s+|final\s+|readonly\s+)*class\s+(?P<name>\w+)", "class_declaration"), (r"\bfunction\s+&?\s*(?P<name>\w+)\s*\(", "function_declaration")],
    "rust": [(r"\bstruct\s+(?P<name>\w+)", "struct_item"), (r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", "impl_item"), (r"\bfn\s+(?P<name>\w+)", "function_item")],
    "c": [(r"\bstruct\s+(?P<name>\w+)\s*\{", "struct_specifier"), (r"\bunion\s+(?P<name>\w+)\s*\{", "union_specifier"), (r"^[A-Za-z_][\w\s*]*?\b(?P<name>[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*\{", "function_definition")],
    "cpp": [(r"\bclass\s+(?P<name>\w+)[^;{()]*\{", "class_specifier"), (r"^[ \t]*(?:[A-Za-z_][\w:<>,*&~\s]*?[\s*&])?(?P<name>~?[A-Za-z_][\w]*(?:::~?[A-Za-z_]\w*)*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?\{", "function_definition")],
    "go": [(r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\b", "type_specification"), (r"\bfunc\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", "function_declaration")],
    "java": [(r"\bclass\s+(?P<name>\w+)", "class_declaration"), (r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[A-Za-z_][\w.<>,\[\]? ]*\s+(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\{", "method_declaration")],
    "kotlin": [(r"\bclass\s+(?P<name>\w+)", "class_declaration"), (r"\bfun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\(", "function_declaration")],
}
_CALL_KIND = {"java": "method_invocation"}
#: Languages whose calls name the method alone.
_BARE_METHODS = ("java", "php")


def blank(text: str, language: str) -> str:
    """The text with comments and the insides of strings as spaces, of the same length."""
    comment = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    if language == "php":
        comment += r"|\#(?!\[)[^\n]*"
    if language == "go":
        comment += r"|`[^`]*`"
    pattern = re.compile(f"{comment}|{_STRINGS}" if language != "rust" else rf"{comment}|\"(?:\\.|[^\"\\])*\"", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def outline(text: str, language: str) -> Node:
    """The outline of a source; an unreadable Python source has none."""
    root = Node("program", 0, len(text))
    found = _python(text) if language == "python" else _scanned(text, language)
    # Nest by extent.
    stack = [root]
    for node in sorted(found, key=lambda x: (x.start, -x.end)):
        while len(stack) > 1 and node.start >= stack[-1].end:
            stack.pop()
        stack[-1].children.append(node)
        if node.kind not in ("call_expression", "method_invocation", "call"):
            stack.append(node)
    return root


def _named(kind: str, start: int, end: int, name: tuple[int, int], field: str = "name") -> Node:
    return Node(kind, start, end, [Node("identifier", name[0], name[1], name=field)])


def _scanned(text: str, language: str) -> list[Node]:
    bare, out, names = blank(text, language), [], set()
    for pattern, kind in _DEFINITIONS.get(language, ()):
        for m in re.finditer(pattern, bare, re.M):
            if m["name"] in _CONTROL:
                continue
            names.add(m.start("name"))
            opening, stop = bare.find("{", m.end() - 1), bare.find(";", m.end() - 1)
            end = m.end() if opening < 0 or 0 <= stop < opening else _closing(bare, opening)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append(_named(kind, start, max(end, m.end()), m.span("name")))
    if language == "php":  # functions inside classes are methods
        classes = [x for x in out if x.kind == "class_declaration"]
        for x in out:
            if x.kind == "function_declaration" and any(c.start < x.start < c.end for c in classes):
                x.kind = "method_definition"
    for pattern in (_CALL, _CHAINED):
        for m in pattern.finditer(bare):
            callee = m[0].rstrip("(! \t\r\n")
            last = re.split(r"::|\.|->", callee)[-1].strip()
            start, stop = m.start(), m.start() + len(callee)
            if callee in _NOT_CALLS or last in _NOT_CALLS or stop - len(last) in names or start in names:
                continue
            if pattern is _CHAINED:
                start = _operand(bare, start)
            first = stop - len(last) if language in _BARE_METHODS else start
            out.append(_named(_CALL_KIND.get(language, "call_expression"), start, m.end(), (first, stop), "function"))
    return out


def _operand(text: str, at: int) -> int:
    """Where the operand that ends in a bracket before ``at`` begins: brackets and the names and dots before them."""
    while at > 0:
        if text[at - 1] in ")]}":
            depth = 0
            for k in range(at - 1, -1, -1):
                depth += (text[k] in ")]}") - (text[k] in "([{")
                if not depth:
                    break
            at = k
        elif m := re.search(r"(?:[\w$]|::|\.|->)+$", text[max(0, at - 200) : at]):
            at -= len(m[0])
        else:
            break
    return at


def _closing(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _python(text: str) -> list[Node]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    raw = text.split("\n")
    begins = [0]
    for line in raw:
        begins.append(begins[-1] + len(line) + 1)

    def at(line: int, column: int) -> int:
        return begins[line - 1] + len(raw[line - 1].encode()[:column].decode("utf-8", "ignore"))

    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start, end = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            name = text.index(node.name, start + len("class" if isinstance(node, ast.ClassDef) else "def"))
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "async_function_definition" if isinstance(node, ast.AsyncFunctionDef) else "function_definition"
            out.append(_named(kind, start, end, (name, name + len(node.name))))
        elif isinstance(node, ast.Call):
            f = node.func
            span = at(f.lineno, f.col_offset), at(f.end_lineno, f.end_col_offset)
            out.append(_named("call", at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), span, "function"))
    return out
