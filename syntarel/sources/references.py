"""What identifiers do in TypeScript and JavaScript, as a table of rules over kinds and fields.

Every node is looked at in some way, and its own way and kind say how its children
are looked at. An identifier's way is its role; who defines, updates and uses what in
which function follows from roles, nesting and order, relationally.
"""

from __future__ import annotations

from .rules import FLOW_FUNCTIONS
from .script import Node

#: (way, kind) of a node: ways of its children, by field and kind (``field:kind``), field, or kind; ``*`` are all others.
#: Children that no entry fits aren't looked at. Without an entry, all children are read.
WAYS: dict[tuple[str, str], dict[str, str | None]] = {
    ("read", "variable_declaration"): {"variable_declarator": "declare"},
    ("read", "lexical_declaration"): {"variable_declarator": "declare"},
    ("declare", "variable_declarator"): {"name:identifier": "define", "value": "read"},
    ("read", "assignment_expression"): {"left": "assign", "right": "read"},
    ("assign", "array_pattern"): {"*": "assign"},
    ("assign", "object_pattern"): {"*": "assign"},
    ("read", "augmented_assignment_expression"): {"left:identifier": "augment", "right": "read"},
    ("read", "formal_parameters"): {"required_parameter": "parameter", "optional_parameter": "parameter"},
    ("parameter", "required_parameter"): {"pattern": "bind", "value": "read"},
    ("parameter", "optional_parameter"): {"pattern": "bind", "value": "read"},
    ("bind", "array_pattern"): {"identifier": "define", "shorthand_property_identifier_pattern": "define", "pair_pattern": "bind"},
    ("bind", "object_pattern"): {"identifier": "define", "shorthand_property_identifier_pattern": "define", "pair_pattern": "bind"},
    ("bind", "pair_pattern"): {"value:identifier": "define"},
    ("read", "function_declaration"): {"name:identifier": None, "*": "read"},
    ("read", "function_expression"): {"name:identifier": None, "*": "read"},
}
#: Roles of identifiers by the way they are looked at.
ROLES = {"read": "use", "assign": "assign", "define": "define", "bind": "define", "augment": "augment"}


def way_below(way: str | None, node: Node, child: Node) -> str | None:
    """How ``child`` is looked at; functions are read even where nothing around them is."""
    if node.kind in FLOW_FUNCTIONS or (way == "assign" and ("assign", node.kind) not in WAYS):
        way = "read"
    if way is None:
        return None
    rules = WAYS.get((way, node.kind))
    if rules is None:
        return "read" if way == "read" else None
    for name in (f"{child.name}:{child.kind}", child.name, child.kind, "*"):
        if name in rules:
            return rules[name]
    return None


def role_of(way: str | None, node: Node) -> str | None:
    """The role of an identifier that is looked at."""
    if node.kind == "identifier" or (way == "define" and not node.children):
        return ROLES.get(way or "")
    return None
