"""Tokens of TypeScript and JavaScript sources."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, private, number, string, template, regex, punct, end
    text: str
    start: int
    end: int
    fresh_line: bool  # is there a line break before it?


_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|_[\w$]*", re.U)
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
# A closing angle stands alone; the parser joins shifts and comparisons.
_PUNCT = re.compile(r"\.\.\.|=>|\?\.(?!\d)|\?\?=|&&=|\|\|=|\*\*=|<<=|===|!==|==|!=|<=|<<|\*\*|\+\+|--|&&|\|\||\?\?|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


def template_end(text: str, at: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the template that begins at ``at`` ends, and the spans of its expressions."""
    spans, i = [], at + 1
    while i < end:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, spans
        elif text.startswith("${", i):
            depth, first = 1, i + 2
            i = first
            while i < end and depth:
                c = text[i]
                if c in "'\"":
                    i = max(_STRING.match(text, i, end).end(), i + 1)
                    continue
                if c == "`":
                    i = template_end(text, i, end)[0]
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            spans.append((first, i - 1 if not depth else i))
        else:
            i += 1
    return end, spans


def tokens(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    """All tokens, the last of kind ``end``. Characters that fit nothing are skipped."""
    end = len(text) if end is None else end
    out: list[Token] = []
    i, fresh = start, False
    if text.startswith("#!", i):
        i = (text.find("\n", i) + 1) or end
    while i < end:
        if m := _SPACE.match(text, i, end):
            fresh |= "\n" in m[0]
            i = m.end()
            continue
        c, kind, m = text[i], None, None
        if c == "`":
            stop = template_end(text, i, end)[0]
            out.append(Token("template", text[i:stop], i, stop, fresh))
            i, fresh = stop, False
            continue
        if m := _NAME.match(text, i, end):
            kind = "name"
        elif c == "#" and (m := _NAME.match(text, i + 1, end)):
            out.append(Token("private", text[i : m.end()], i, m.end(), fresh))
            i, fresh = m.end(), False
            continue
        elif c in "'\"":
            kind, m = "string", _STRING.match(text, i, end)
        elif c.isdigit() or (c == "." and i + 1 < end and text[i + 1].isdigit()):
            kind, m = "number", _NUMBER.match(text, i, end)
        elif c == "/" and _regex_fits(out) and (m := _REGEX.match(text, i, end)):
            kind = "regex"
        else:
            kind, m = "punct", _PUNCT.match(text, i, end)
        if not m:
            i += 1
            continue
        out.append(Token(kind, m[0], i, m.end(), fresh))
        i, fresh = m.end(), False
    out.append(Token("end", "", end, end, True))
    return out


def _regex_fits(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "punct":
        return last.text not in (")", "]", "}", "++", "--")
    return last.kind == "name" and last.text in _BEFORE_REGEX
