"""Fixed values of the analyses: extensions, ignored names, node kinds, keywords."""

from __future__ import annotations

# Languages by extension.
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".php": "php",
    ".py": "python",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".go": "go",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
}

#: Where the index and the settings of a project are kept.
PROJECT_FOLDER = ".syntarel"

# Names that scans skip; the tree skips some more.
IGNORED = ["node_modules", ".git", PROJECT_FOLDER, "dist", "build"]
IGNORED_IN_TREE = [*IGNORED, "__pycache__", ".venv", "vendor"]

# Kinds of nodes that define functions and classes, by language.
FUNCTION_KINDS = {
    "typescript": ["function_declaration", "method_definition"],
    "javascript": ["function_declaration", "method_definition"],
    "php": ["function_declaration", "method_definition"],
    "python": ["function_definition", "async_function_definition"],
    "rust": ["function_item"],
    "c": ["function_definition"],
    "cpp": ["function_definition"],
    "go": ["function_declaration"],
    "java": ["method_declaration"],
    "kotlin": ["function_declaration"],
}
CLASS_KINDS = {
    "typescript": ["class_declaration"],
    "javascript": ["class_declaration"],
    "php": ["class_declaration"],
    "python": ["class_definition"],
    "rust": ["struct_item", "impl_item"],
    "c": ["struct_specifier", "union_specifier"],
    "cpp": ["class_specifier"],
    "go": ["type_specification"],
    "java": ["class_declaration"],
    "kotlin": ["class_declaration"],
}
# Kinds of nodes that call, by language.
CALL_KINDS = {
    "typescript": ["call_expression", "member_expression"],
    "javascript": ["call_expression", "member_expression"],
    "php": ["call_expression", "member_call_expression"],
    "python": ["call", "attribute"],
    "rust": ["call_expression", "field_expression"],
    "c": ["call_expression"],
    "cpp": ["call_expression"],
    "go": ["call_expression"],
    "java": ["method_invocation"],
    "kotlin": ["call_expression"],
}
MEMBER_KINDS = ["member_expression", "field_expression", "attribute"]

# What counts for complexity and blocks.
FLOW_FUNCTIONS = ["function_declaration", "function_expression", "method_definition", "arrow_function"]
LOOPS = ["for_statement", "for_in_statement", "for_of_statement", "while_statement", "do_statement"]
DECISIONS = ["if_statement", *LOOPS, "switch_statement", "conditional_expression"]
CASES = ["switch_case", "switch_default"]
COUNTED_OPERATORS = ["&&", "||"]
FLOW_LANGUAGES = ["typescript", "javascript"]

# Words that are never uses of a variable.
KEYWORDS = """
if else for while return function const let var true false null undefined this super new class extends import export
from default try catch finally throw break continue switch case typeof instanceof void delete in of await async yield
static public private protected
""".split()
