"""A tolerant parser of TypeScript and JavaScript.

It gives concrete syntax nodes of the kinds and fields that the analyses ask
for, named as public grammars name them. Types are skipped, since no analysis
looks into them. What can't be parsed becomes an ``ERROR`` node of one token, and
parsing goes on behind it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import Token, template_end, tokens


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    name: str = ""  # of the field it fills in its parent


class _Stuck(Exception):
    pass


_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="}
_POWER = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "override", "abstract", "declare", "async", "get", "set", "accessor"}
_LITERALS = {"true", "false", "null", "undefined", "this", "super"}
_CLOSING = {"(": ")", "[": "]", "{": "}"}
#: Deepest nesting; deeper input is given up as an error node instead of overflowing the stack.
_DEEPEST = 120


class ScriptParser:
    """``typed`` parses TypeScript, else JavaScript."""

    def __init__(self, text: str, typed: bool, start: int = 0, end: int | None = None):
        self.text, self.typed = text, typed
        self.all = tokens(text, start, end)
        self.at = 0
        self.depth = 0

    # -- tokens -----------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.all[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.all[min(self.at + k, len(self.all) - 1)]

    def on(self, *texts: str) -> bool:
        t = self.now
        return t.kind in ("punct", "name") and t.text in texts

    def take(self) -> Node:
        t = self.now
        if t.kind == "end":
            raise _Stuck
        self.at += 1
        return Node(t.text if t.kind in ("punct", "name") else t.kind, t.start, t.end)

    def need(self, text: str) -> Node:
        if not self.on(text):
            raise _Stuck
        return self.take()

    @staticmethod
    def make(kind: str, *parts: Node | None, **fields: Node | None) -> Node:
        """A node of its parts in order of position; keywords name fields."""
        children = [p for p in parts if p]
        for name, part in fields.items():
            if part:
                part.name = name.rstrip("_")
                children.append(part)
        children.sort(key=lambda x: (x.start, x.end))
        return Node(kind, children[0].start, max(c.end for c in children), children)

    def word(self, kind: str = "identifier") -> Node:
        if self.now.kind not in ("name", "private"):
            raise _Stuck
        node = self.take()
        node.kind = "private_property_identifier" if self.all[self.at - 1].kind == "private" else kind
        return node

    def attempt(self, parse):
        """The result of ``parse``, or None with nothing consumed."""
        at, depth = self.at, self.depth
        try:
            return parse()
        except _Stuck:
            self.at, self.depth = at, depth
            return None

    # -- program and statements -------------------------------------------

    def program(self) -> Node:
        root = Node("program", 0, len(self.text))
        root.children = self.statements(until=None)
        return root

    def statements(self, until: str | None) -> list[Node]:
        out = []
        while self.now.kind != "end" and not (until and self.on(until)):
            at = self.at
            try:
                out.append(self.statement())
            except _Stuck:
                self.at = at
                bad = self.take()
                bad.kind = "ERROR"
                out.append(bad)
        return out

    def finish(self, node: Node) -> Node:
        """With the semicolon, if there's one."""
        if self.on(";"):
            end = self.take()
            node.children.append(end)
            node.end = end.end
        return node

    def block(self, kind: str = "statement_block") -> Node:
        first = self.need("{")
        inner = self.statements("}")
        return self.make(kind, first, *inner, self.need("}"))

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > _DEEPEST:
            self.depth -= 1
            raise _Stuck
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        t, after = self.now, self.peek()
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                node = self.take()
                node.kind = "empty_statement"
                return node
            if t.text == "@":
                marks = []
                while self.on("@"):
                    marks.append(self.make("decorator", self.take(), self.postfix(self.primary())))
                node = self.statement()
                return self.make(node.kind, *marks, *node.children)
        if t.kind == "name":
            parse = getattr(self, f"_{t.text}_statement", None)
            plain = after.text in (":", "=", ".", ",", ")") or (after.text == "(" and t.text not in ("if", "for", "while", "switch", "return", "throw", "import"))
            if parse and not (plain and t.text not in ("if", "for", "while", "switch", "return", "throw")):
                node = self.attempt(parse)
                if node:
                    return node
            if after.text == ":" and after.kind == "punct":
                return self.make("labeled_statement", self.take(), self.take(), body=self.statement())
        return self.finish(self.make("expression_statement", self.expression()))

    def _if_statement(self) -> Node:
        first, test = self.take(), self.parenthesized()
        then = self.statement()
        other = self.make("else_clause", self.take(), self.statement()) if self.on("else") else None
        return self.make("if_statement", first, condition=test, consequence=then, alternative=other)

    def _while_statement(self) -> Node:
        return self.make("while_statement", self.take(), condition=self.parenthesized(), body=self.statement())

    def _do_statement(self) -> Node:
        first, body = self.take(), self.statement()
        return self.finish(self.make("do_statement", first, self.need("while"), body=body, condition=self.parenthesized()))

    def _for_statement(self) -> Node:
        parts = [self.take()]
        if self.on("await"):
            parts.append(self.take())
        parts.append(self.need("("))
        each = self.attempt(self.each_head)
        if each:
            head, left, sign, right = each
            return self.make("for_in_statement", *parts, *head, self.need(")"), left=left, operator=sign, right=right, body=self.statement())
        first = None
        if self.on(";"):
            first = self.take()
        elif self.on("var", "let", "const"):
            first = self.declaration()
        else:
            first = self.make("expression_statement", self.expression(), self.need(";"))
        if first.children and self.text[first.end - 1] != ";":
            raise _Stuck
        test = None if self.on(";") else self.expression()
        semi = self.need(";")
        step = None if self.on(")") else self.expression()
        return self.make("for_statement", *parts, semi, self.need(")"), initializer=first, condition=test, increment=step, body=self.statement())

    def each_head(self):
        head = [self.take()] if self.on("var", "let", "const") else []
        left = self.pattern() if head else self.postfix(self.primary())
        if not self.on("of", "in"):
            raise _Stuck
        sign = self.take()
        return head, left, sign, self.expression()

    def _switch_statement(self) -> Node:
        first, value, opening = self.take(), self.parenthesized(), self.need("{")
        cases = []
        while not self.on("}"):
            if self.on("case"):
                word, test, colon = self.take(), self.expression(), self.need(":")
                cases.append(self.make("switch_case", word, colon, *self.case_body(), value=test))
            elif self.on("default"):
                cases.append(self.make("switch_default", self.take(), self.need(":"), *self.case_body()))
            else:
                raise _Stuck
        return self.make("switch_statement", first, value=value, body=self.make("switch_body", opening, *cases, self.need("}")))

    def case_body(self) -> list[Node]:
        out = []
        while not self.on("case", "default", "}") and self.now.kind != "end":
            out.append(self.statement())
        return out

    def _return_statement(self) -> Node:
        return self._with_value("return_statement")

    def _throw_statement(self) -> Node:
        return self._with_value("throw_statement")

    def _with_value(self, kind: str) -> Node:
        first = self.take()
        t = self.now
        value = None if t.fresh_line or t.kind == "end" or self.on(";", "}") else self.expression()
        return self.finish(self.make(kind, first, value))

    def _break_statement(self) -> Node:
        return self._jump("break_statement")

    def _continue_statement(self) -> Node:
        return self._jump("continue_statement")

    def _debugger_statement(self) -> Node:
        return self.finish(self.make("debugger_statement", self.take()))

    def _jump(self, kind: str) -> Node:
        first = self.take()
        label = self.word("statement_identifier") if self.now.kind == "name" and not self.now.fresh_line else None
        return self.finish(self.make(kind, first, label=label))

    def _try_statement(self) -> Node:
        first, body = self.take(), self.block()
        caught = final = None
        if self.on("catch"):
            word, parts, bound = self.take(), [], None
            if self.on("("):
                parts.append(self.take())
                bound = self.pattern()
                self.annotation()
                parts.append(self.need(")"))
            caught = self.make("catch_clause", word, *parts, parameter=bound, body=self.block())
        if self.on("finally"):
            final = self.make("finally_clause", self.take(), body=self.block())
        return self.make("try_statement", first, body=body, handler=caught, finalizer=final)

    def _var_statement(self) -> Node:
        return self.declaration()

    def _let_statement(self) -> Node:
        return self.declaration()

    def _const_statement(self) -> Node:
        if self.peek().text == "enum":
            return self.make("enum_declaration", self.take(), *self._enum_statement().children)
        return self.declaration()

    def declaration(self) -> Node:
        word, parts = self.take(), []
        while True:
            name = self.pattern()
            if self.on("!"):
                self.take()
            kind = self.annotation()
            value = None
            if self.on("="):
                parts.append(self.make("variable_declarator", kind, self.take(), name=name, value=self.assignment()))
            else:
                parts.append(self.make("variable_declarator", kind, name=name, value=value))
            if not self.on(","):
                break
            parts.append(self.take())
        return self.finish(self.make("variable_declaration" if word.kind == "var" else "lexical_declaration", word, *parts))

    def _function_statement(self) -> Node:
        return self.function("function_declaration")

    def _async_statement(self) -> Node:
        if self.peek().text != "function" or self.peek().fresh_line:
            raise _Stuck
        return self.function("function_declaration")

    def function(self, kind: str) -> Node:
        parts = [self.take()] if self.on("async") else []
        parts.append(self.need("function"))
        if self.on("*"):
            parts.append(self.take())
            kind = {"function_declaration": "generator_function_declaration", "function_expression": "generator_function"}[kind]
        name = self.word() if self.now.kind == "name" else None
        self.type_parameters()
        params, kind_of = self.parameters(), self.annotation()
        if self.on("{"):
            return self.make(kind, *parts, kind_of, name=name, parameters=params, body=self.block())
        return self.finish(self.make("function_signature", *parts, kind_of, name=name, parameters=params))

    def _abstract_statement(self) -> Node:
        word = self.take()
        node = self.class_("abstract_class_declaration")
        return self.make(node.kind, word, *node.children)

    def _class_statement(self) -> Node:
        return self.class_("class_declaration")

    def class_(self, kind: str) -> Node:
        word = self.need("class")
        name = None
        if self.now.kind == "name" and not self.on("extends", "implements"):
            name = self.word("type_identifier" if self.typed else "identifier")
        self.type_parameters()
        heritage = []
        if self.on("extends"):
            heritage.append(self.make("class_heritage", self.take(), self.postfix(self.primary())))
            self.type_arguments()
        if self.on("implements"):
            self.take()
            self.type_list()
        return self.make(kind, word, *heritage, name=name, body=self.class_body())

    def class_body(self) -> Node:
        parts = [self.need("{")]
        while not self.on("}"):
            if self.on(";"):
                parts.append(self.take())
                continue
            parts.append(self.member())
        return self.make("class_body", *parts, self.need("}"))

    def member(self) -> Node:
        parts = []
        while self.on("@"):
            parts.append(self.make("decorator", self.take(), self.postfix(self.primary())))
        if self.on("static") and self.peek().text == "{":
            return self.make("class_static_block", self.take(), body=self.block())
        while self.now.kind == "name" and self.now.text in _MODIFIERS and self.peek().text not in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
            parts.append(self.take())
        if self.on("*"):
            parts.append(self.take())
        if self.typed and self.on("[") and self.peek().kind == "name" and self.peek(2).text == ":":
            self.skip_balanced()
            kind = self.annotation()
            return self.finish(self.make("index_signature", *parts, kind))
        name = self.property_name()
        while self.on("?", "!"):
            parts.append(self.take())
        if self.on("(", "<"):
            self.type_parameters()
            params, kind = self.parameters(), self.annotation()
            if self.on("{"):
                return self.make("method_definition", *parts, kind, name=name, parameters=params, body=self.block())
            return self.finish(self.make("method_signature", *parts, kind, name=name, parameters=params))
        kind = self.annotation()
        value = None
        if self.on("="):
            parts.append(self.take())
            value = self.assignment()
        fields = {"name" if self.typed else "property": name, "value": value}
        return self.finish(self.make("public_field_definition" if self.typed else "field_definition", *parts, kind, **fields))

    def property_name(self) -> Node:
        t = self.now
        if t.kind in ("name", "private"):
            return self.word("property_identifier")
        if t.kind in ("string", "number"):
            return self.take()
        if self.on("["):
            return self.make("computed_property_name", self.take(), self.assignment(), self.need("]"))
        raise _Stuck

    def _interface_statement(self) -> Node:
        return self._named_body("interface_declaration")

    def _enum_statement(self) -> Node:
        return self._named_body("enum_declaration")

    def _named_body(self, kind: str) -> Node:
        if not self.typed:
            raise _Stuck
        first, name = self.take(), self.word("type_identifier")
        while not self.on("{"):
            self.take()
        at = self.now.start
        self.skip_balanced()
        return self.make(kind, first, name=name, body=Node("object_type", at, self.all[self.at - 1].end))

    def _type_statement(self) -> Node:
        if not self.typed or self.peek().kind != "name":
            raise _Stuck
        first, name = self.take(), self.word("type_identifier")
        self.type_parameters()
        sign = self.need("=")
        at = self.now.start
        self.skip_type()
        return self.finish(self.make("type_alias_declaration", first, sign, name=name, value=Node("type", at, self.all[self.at - 1].end)))

    def _declare_statement(self) -> Node:
        if not self.typed:
            raise _Stuck
        return self.make("ambient_declaration", self.take(), self.statement())

    def _namespace_statement(self) -> Node:
        if not self.typed:
            raise _Stuck
        first = self.take()
        name = self.take() if self.now.kind == "string" else self.postfix(self.primary())
        return self.make("internal_module", first, name=name, body=self.block())

    _module_statement = _namespace_statement

    def _import_statement(self) -> Node:
        if self.peek().text in ("(", "."):
            raise _Stuck
        parts = [self.take()]
        if self.now.kind == "string":
            return self.finish(self.make("import_statement", *parts, source=self.take()))
        if self.on("type", "typeof") and self.peek().text not in ("from", ",", "="):
            parts.append(self.take())
        clause = []
        if self.now.kind == "name":
            clause.append(self.word())
            if self.on("="):
                self.take()
                value = self.expression()
                return self.finish(self.make("import_statement", *parts, self.make("import_require_clause", *clause, value)))
            if self.on(","):
                clause.append(self.take())
        if self.on("*"):
            clause.append(self.make("namespace_import", self.take(), self.need("as"), self.word()))
        elif self.on("{"):
            clause.append(self.specifiers("named_imports", "import_specifier"))
        return self._source(self.make("import_statement", *parts, self.make("import_clause", *clause), self.need("from")))

    def specifiers(self, kind: str, each: str) -> Node:
        parts = [self.need("{")]
        while not self.on("}"):
            own = []
            if self.on("type") and self.peek().text not in (",", "}", "as"):
                own.append(self.take())
            name = self.take() if self.now.kind == "string" else self.word()
            alias = None
            if self.on("as"):
                own.append(self.take())
                alias = self.take() if self.now.kind == "string" else self.word()
            parts.append(self.make(each, *own, name=name, alias=alias))
            if self.on(","):
                parts.append(self.take())
        return self.make(kind, *parts, self.need("}"))

    def _source(self, node: Node) -> Node:
        if self.now.kind != "string":
            raise _Stuck
        source = self.take()
        source.name = "source"
        node.children.append(source)
        node.end = source.end
        if self.on("with", "assert") and self.peek().text == "{":
            self.take()
            self.skip_balanced()
        return self.finish(node)

    def _export_statement(self) -> Node:
        parts = [self.take()]
        if self.on("default"):
            parts.append(self.take())
            if self.on("function", "class", "abstract", "interface") or (self.on("async") and self.peek().text == "function"):
                return self.make("export_statement", *parts, declaration=self.statement())
            return self.finish(self.make("export_statement", *parts, value=self.assignment()))
        if self.on("type") and self.peek().text in ("{", "*"):
            parts.append(self.take())
        if self.on("*"):
            parts.append(self.take())
            if self.on("as"):
                parts += [self.take(), self.word()]
            return self._source(self.make("export_statement", *parts, self.need("from")))
        if self.on("{"):
            node = self.make("export_statement", *parts, self.specifiers("export_clause", "export_specifier"))
            if self.on("from"):
                node.children.append(self.take())
                return self._source(node)
            return self.finish(node)
        if self.on("="):
            return self.finish(self.make("export_statement", *parts, self.take(), self.expression()))
        return self.make("export_statement", *parts, declaration=self.statement())

    # -- patterns and parameters ------------------------------------------

    def pattern(self) -> Node:
        if self.on("["):
            parts = [self.take()]
            while not self.on("]"):
                parts.append(self.take() if self.on(",") else self.element())
            return self.make("array_pattern", *parts, self.need("]"))
        if self.on("{"):
            parts = [self.take()]
            while not self.on("}"):
                if self.on(","):
                    parts.append(self.take())
                elif self.on("..."):
                    parts.append(self.make("rest_pattern", self.take(), self.pattern()))
                elif self.now.kind == "name" and self.peek().text in (",", "}", "="):
                    name = self.word("shorthand_property_identifier_pattern")
                    if self.on("="):
                        name = self.make("object_assignment_pattern", self.take(), left=name, right=self.assignment())
                    parts.append(name)
                else:
                    key = self.property_name()
                    parts.append(self.make("pair_pattern", self.need(":"), key=key, value=self.element()))
            return self.make("object_pattern", *parts, self.need("}"))
        return self.word()

    def element(self) -> Node:
        """A pattern with what may go before or after it."""
        if self.on("..."):
            return self.make("rest_pattern", self.take(), self.pattern())
        target = self.pattern() if self.now.kind == "name" or self.on("[", "{") else self.primary()
        if self.on(".", "["):
            target = self.postfix(target)
        if self.on("="):
            return self.make("assignment_pattern", self.take(), left=target, right=self.assignment())
        return target

    def parameters(self) -> Node:
        parts = [self.need("(")]
        while not self.on(")"):
            parts.append(self.take() if self.on(",") else self.parameter())
        return self.make("formal_parameters", *parts, self.need(")"))

    def parameter(self) -> Node:
        if not self.typed:
            return self.element()
        parts = []
        while self.on("@"):
            parts.append(self.make("decorator", self.take(), self.postfix(self.primary())))
        while self.now.kind == "name" and self.now.text in _MODIFIERS and (self.peek().kind == "name" or self.peek().text in ("{", "[")):
            parts.append(self.take())
        target = self.make("rest_pattern", self.take(), self.pattern()) if self.on("...") else self.pattern()
        kind = "required_parameter"
        if self.on("?"):
            parts.append(self.take())
            kind = "optional_parameter"
        typed, value = self.annotation(), None
        if self.on("="):
            parts.append(self.take())
            value = self.assignment()
        return self.make(kind, *parts, typed, pattern=target, value=value)

    # -- types, skipped -----------------------------------------------------

    def annotation(self) -> Node | None:
        if not (self.typed and self.on(":")):
            return None
        at = self.take().start
        self.skip_type()
        return Node("type_annotation", at, self.all[self.at - 1].end, name="type")

    def skip_balanced(self) -> None:
        closing = [_CLOSING[self.take().kind]]
        while closing:
            t = self.take()
            if t.kind in _CLOSING:
                closing.append(_CLOSING[t.kind])
            elif t.kind == closing[-1]:
                closing.pop()

    def type_parameters(self) -> None:
        if self.typed and self.on("<"):
            self.take()
            while not self.on(">"):
                if self.on("{", "(", "["):
                    self.skip_balanced()
                elif self.on("<"):
                    self.type_parameters()
                else:
                    self.take()
            self.take()

    def type_arguments(self) -> bool:
        """Skips type arguments, if that is what follows."""
        if not (self.typed and self.on("<")):
            return False

        def parse() -> bool:
            self.take()
            if not self.on(">"):
                self.type_list()
            self.need(">")
            return True

        return bool(self.attempt(parse))

    def type_list(self) -> None:
        self.skip_type()
        while self.on(","):
            self.take()
            self.skip_type()

    def skip_type(self) -> None:
        if self.on("|", "&"):
            self.take()
        self.skip_one_type()
        while self.on("|", "&"):
            self.take()
            self.skip_one_type()
        if self.on("is") and not self.now.fresh_line:
            self.take()
            self.skip_type()
        elif self.on("extends") and not self.now.fresh_line:
            at = self.at
            self.take()
            self.skip_one_type()
            if not self.on("?"):
                self.at = at
                return
            self.take()
            self.skip_type()
            self.need(":")
            self.skip_type()

    def skip_one_type(self) -> None:
        while self.on("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract") and (self.peek().kind in ("name", "string") or self.peek().text in ("(", "[", "{", "<")) and not self.peek().fresh_line:
            self.take()
        self.type_parameters()
        t = self.now
        if self.on("("):
            self.skip_balanced()
            if self.on("=>"):
                self.take()
                self.skip_type()
                return
        elif self.on("{", "["):
            self.skip_balanced()
        elif self.on("-") or t.kind in ("string", "number", "template"):
            self.take()
            if t.text == "-":
                self.take()
        elif t.kind == "name":
            self.take()
            if t.text == "import" and self.on("("):
                self.skip_balanced()
            while self.on("."):
                self.take()
                self.take()
            self.type_arguments()
        else:
            raise _Stuck
        while self.on("[") and not self.now.fresh_line:
            self.skip_balanced()

    # -- expressions --------------------------------------------------------

    def parenthesized(self) -> Node:
        return self.make("parenthesized_expression", self.need("("), self.expression(), self.need(")"))

    def expression(self) -> Node:
        node = self.assignment()
        while self.on(","):
            node = self.make("sequence_expression", self.take(), left=node, right=self.assignment())
        return node

    def assignment(self) -> Node:
        self.depth += 1
        if self.depth > _DEEPEST:
            self.depth -= 1
            raise _Stuck
        try:
            return self._assignment()
        finally:
            self.depth -= 1

    def _assignment(self) -> Node:
        if self.on("(", "async", "<") or (self.now.kind == "name" and self.peek().text == "=>"):
            if arrow := self.attempt(self.arrow):
                return arrow
        if self.on("yield"):
            word = self.take()
            star = self.take() if self.on("*") else None
            value = None if self.now.fresh_line or self.on(")", "]", "}", ",", ";", ":") or self.now.kind == "end" else self.assignment()
            return self.make("yield_expression", word, star, value)
        if self.on("[", "{"):
            def destructured() -> Node:
                left = self.pattern_target()
                return self.make("assignment_expression", self.need("="), left=left, right=self.assignment())

            if node := self.attempt(destructured):
                return node
        left = self.conditional()
        sign = self.operator()
        if sign == "=" and self.now.text == "=":
            return self.make("assignment_expression", self.take(), left=left, right=self.assignment())
        if sign in _ASSIGN:
            return self.make("augmented_assignment_expression", left=left, operator=self.take_operator(sign), right=self.assignment())
        return left

    def pattern_target(self) -> Node:
        return self.pattern()

    def arrow(self) -> Node:
        parts = []
        if self.on("async") and not self.peek().fresh_line and (self.peek().kind == "name" or self.peek().text in ("(", "<")):
            parts.append(self.take())
        self.type_parameters()
        if self.on("("):
            params, kind = self.parameters(), self.annotation()
            sign = self.need("=>")
            return self.make("arrow_function", *parts, kind, sign, parameters=params, body=self.arrow_body())
        if self.on("<"):
            raise _Stuck
        name = self.word()
        sign = self.need("=>")
        return self.make("arrow_function", *parts, sign, parameter=name, body=self.arrow_body())

    def arrow_body(self) -> Node:
        return self.block() if self.on("{") else self.assignment()

    def conditional(self) -> Node:
        test = self.binary(0)
        if not self.on("?"):
            return test
        mark, yes = self.take(), self.assignment()
        return self.make("ternary_expression", mark, self.need(":"), condition=test, consequence=yes, alternative=self.assignment())

    def operator(self) -> str:
        """The operator at hand, with what a closing angle is joined to."""
        t = self.now
        if t.kind == "name":
            return t.text if t.text in ("instanceof", "in") else ""
        if t.kind != "punct" or t.text != ">":
            return t.text if t.kind == "punct" else ""
        text, k = ">", 1
        while self.peek(k).text in (">", "=", ">=", "==", "===") and self.peek(k).start == self.peek(k - 1).end and len(text) < 4:
            text += self.peek(k).text
            k += 1
        return text if text in _POWER or text in _ASSIGN else ">"

    def take_operator(self, text: str) -> Node:
        start = self.now.start
        while self.now.start < start + len(text):
            self.take()
        return Node(text, start, start + len(text))

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            if self.typed and self.on("as", "satisfies") and not self.now.fresh_line:
                word = self.take()
                at = self.now.start
                if self.on("const"):
                    self.take()
                else:
                    self.skip_type()
                left = self.make(f"{word.kind}_expression", left, word, Node("type", at, self.all[self.at - 1].end))
                continue
            sign = self.operator()
            power = _POWER.get(sign, 0)
            if not power or power <= least:
                return left
            mark = self.take_operator(sign)
            right = self.binary(power - (sign == "**"))
            left = self.make("binary_expression", left=left, operator=mark, right=right)

    def unary(self) -> Node:
        if self.now.kind in ("punct", "name"):
            if self.now.text in _UNARY:
                return self.make("unary_expression", operator=self.take(), argument=self.unary())
            if self.on("++", "--"):
                return self.make("update_expression", operator=self.take(), argument=self.unary())
            if self.on("await") and not (self.peek().kind == "punct" and self.peek().text not in ("(", "[", "{", "!")):
                return self.make("await_expression", self.take(), self.unary())
            if self.typed and self.on("<") and self.type_arguments():
                return self.unary()
        node = self.postfix(self.primary())
        if self.on("++", "--") and not self.now.fresh_line:
            return self.make("update_expression", argument=node, operator=self.take())
        return node

    def postfix(self, node: Node) -> Node:
        while True:
            if self.on("."):
                dot = self.take()
                node = self.make("member_expression", dot, object=node, property=self.word("property_identifier"))
            elif self.on("?."):
                mark = self.take()
                if self.on("("):
                    node = self.make("call_expression", mark, function=node, arguments=self.arguments())
                elif self.on("["):
                    node = self.make("subscript_expression", mark, self.take(), object=node, index=self.expression(), close_=self.need("]"))
                else:
                    node = self.make("member_expression", mark, object=node, property=self.word("property_identifier"))
            elif self.on("["):
                opening, index = self.take(), self.expression()
                node = self.make("subscript_expression", opening, self.need("]"), object=node, index=index)
            elif self.on("("):
                node = self.make("call_expression", function=node, arguments=self.arguments())
            elif self.now.kind == "template":
                node = self.make("call_expression", function=node, arguments=self.template())
            elif self.typed and self.on("!") and not self.now.fresh_line:
                node = self.make("non_null_expression", node, self.take())
            elif self.typed and self.on("<"):
                at = self.at
                if not self.type_arguments() or not (self.on("(") or self.now.kind == "template"):
                    self.at = at
                    return node
            else:
                return node

    def arguments(self) -> Node:
        parts = [self.need("(")]
        while not self.on(")"):
            parts.append(self.take() if self.on(",") else self.item())
        return self.make("arguments", *parts, self.need(")"))

    def item(self) -> Node:
        if self.on("..."):
            return self.make("spread_element", self.take(), self.assignment())
        return self.assignment()

    def template(self) -> Node:
        t = self.now
        self.at += 1
        node = Node("template_string", t.start, t.end)
        for a, b in template_end(self.text, t.start, t.end)[1]:
            inner = ScriptParser(self.text, self.typed, a, b)
            inner.depth = self.depth
            part = inner.attempt(inner.expression)
            node.children.append(Node("template_substitution", a - 2, b + 1, [part] if part else []))
        return node

    def primary(self) -> Node:
        t = self.now
        if t.kind in ("string", "number", "regex"):
            return self.take()
        if t.kind == "template":
            return self.template()
        if t.kind == "private":
            return self.word()
        if t.kind == "name":
            if t.text in _LITERALS:
                return self.take()
            if t.text == "function" or (t.text == "async" and self.peek().text == "function"):
                return self.function("function_expression")
            if t.text == "class":
                return self.class_("class")
            if t.text == "new":
                word = self.take()
                if self.on("."):
                    return self.make("meta_property", word, self.take(), self.word("property_identifier"))
                target = self.primary()
                while self.on(".", "["):
                    sign = self.take()
                    target = self.make("member_expression", sign, object=target, property=self.word("property_identifier")) if sign.kind == "." else self.make("subscript_expression", sign, object=target, index=self.expression(), close_=self.need("]"))
                self.type_arguments()
                return self.make("new_expression", word, constructor=target, arguments=self.arguments() if self.on("(") else None)
            if t.text == "import":
                return self.take()
            if t.text in ("if", "for", "while", "switch", "return", "case", "default", "else", "var", "const", "throw", "try", "catch", "finally", "do", "break", "continue", "with", "export", "extends", "in", "instanceof"):
                raise _Stuck
            return self.word()
        if self.on("("):
            return self.parenthesized()
        if self.on("["):
            parts = [self.take()]
            while not self.on("]"):
                parts.append(self.take() if self.on(",") else self.item())
            return self.make("array", *parts, self.need("]"))
        if self.on("{"):
            return self.object()
        if self.on("<"):
            return self.markup()
        raise _Stuck

    def object(self) -> Node:
        parts = [self.take()]
        while not self.on("}"):
            if self.on(","):
                parts.append(self.take())
            elif self.on("..."):
                parts.append(self.make("spread_element", self.take(), self.assignment()))
            elif self.now.kind == "name" and self.peek().text in (",", "}"):
                parts.append(self.word("shorthand_property_identifier"))
            elif self.now.kind == "name" and self.peek().text == "=":
                raise _Stuck
            else:
                own = []
                while self.now.kind == "name" and self.now.text in ("async", "get", "set") and self.peek().text not in ("(", ":", ",", "}"):
                    own.append(self.take())
                if self.on("*"):
                    own.append(self.take())
                key = self.property_name()
                if self.on("(", "<"):
                    self.type_parameters()
                    params, kind = self.parameters(), self.annotation()
                    parts.append(self.make("method_definition", *own, kind, name=key, parameters=params, body=self.block()))
                else:
                    parts.append(self.make("pair", self.need(":"), key=key, value=self.assignment()))
        return self.make("object", *parts, self.need("}"))

    def markup(self) -> Node:
        """Markup as one node that holds its embedded expressions."""
        start, parts, depth = self.now.start, [], 0
        while True:
            self.need("<")
            closing = self.on("/")
            if closing:
                self.take()
            while not self.on(">", "/"):
                if self.on("{"):
                    parts += self.embedded()
                else:
                    self.take()
            alone = self.on("/")
            if alone:
                self.take()
            end = self.need(">").end
            depth += 0 if alone else -1 if closing else 1
            if depth <= 0:
                return Node("jsx_element", start, end, parts)
            while not self.on("<"):
                if self.on("{"):
                    parts += self.embedded()
                else:
                    self.take()

    def embedded(self) -> list[Node]:
        self.take()
        if self.on("..."):
            self.take()
        inner = [] if self.on("}") else [self.expression()]
        self.need("}")
        return inner


def parse_script(text: str, typed: bool = True) -> Node:
    """The syntax tree of a source; never fails, whatever the text."""
    return ScriptParser(text, typed).program()
