"""A structural parser of TypeScript and TSX: the node types and fields that the measurements look at.

What it does not know becomes an opaque node; what it cannot read is skipped up to the next statement.
Types are skipped. Node types have the names of the public tree-sitter grammar for TypeScript.
"""

import re
from bisect import bisect_right

from codestrata.syntax.lexer import Lexer, Token


class Node:
    __slots__ = ("type", "start", "end", "children", "field", "text", "comments", "names")

    def __init__(self, type_: str, start: int, end: int = -1, text: str | None = None):
        self.type, self.start, self.end, self.text = type_, start, end, text
        self.children: list[Node] = []
        self.field: str | None = None
        self.comments = self.names = 0

    def add(self, child: "Node | None", field: str | None = None) -> "Node":
        if child is not None:
            child.field = field
            self.children.append(child)
        return self


class Stuck(Exception):
    """No statement or expression can be read here."""


_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor"}
_UNARY_WORDS = {"typeof", "void", "delete", "await"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: A run of statements that are names alone, joined by dots or commas at most, as one node; ``comments`` says how many, ``names`` of how many names.
WORDS = "words"
_NAME = r"(?=[\w$])[A-Za-z_$\u00c0-\u024f][\w$]*+"
#: Such a statement, if a name or number follows with nothing but blanks between.
_WORD = re.compile(rf"[ \t\r\n]*+({_NAME}(?:[ \t\r\n]*+[.,][ \t\r\n]*+{_NAME})*+)(?=[ \t\r\n]++([\w$]+))")
_NAMES = re.compile(r"[\w$]+")
#: After these a name goes on with the expression before it.
_JOINS = {"as", "satisfies", "in", "instanceof"}


class Parser:
    def __init__(self, code: str, tsx: bool, function_expressions: bool = False, words: bool = False):
        self.code, self.tsx, self.words, self.lexer = code, tsx, words, Lexer(code)
        self.expression_type = "function" if function_expressions else "function_expression"
        self.at = self.last = 0  # the place of the next token; the end of the last one taken
        self.no_in = self.ternary = 0

    # Tokens

    def peek(self, operand: bool = False) -> Token:
        return self.lexer.known.get((self.at, operand)) or self.lexer.scan(self.at, operand)

    def take(self, operand: bool = False) -> Token:
        t = self.peek(operand)
        self.at = self.last = t.end
        return t

    def sees(self, *texts: str) -> bool:
        t = self.peek()
        return t.kind in ("punct", "name") and t.text in texts

    def accept(self, *texts: str) -> Token | None:
        return self.take() if self.sees(*texts) else None

    def expect(self, text: str) -> Token:
        if not self.sees(text):
            raise Stuck(text)
        return self.take()

    def after(self, token: Token, operand: bool = False) -> Token:
        return self.lexer.scan(token.end, operand)

    def done(self, node: Node) -> Node:
        node.end = max(self.last, node.start)
        return node

    def balanced(self) -> None:
        """Takes a bracket and all up to its partner."""
        want = [_CLOSE[self.take().text]]
        while want:
            t = self.peek(operand=True)
            if t.kind == "end":
                return
            if t.kind == "template":
                self.template()
                continue
            self.take(operand=True)
            if t.kind == "punct":
                if t.text in _CLOSE:
                    want.append(_CLOSE[t.text])
                elif t.text == want[-1]:
                    want.pop()
                elif t.text in ")]}":
                    return

    # Types

    def type_arguments(self) -> bool:
        """Takes <...>; gives the place back if there is no end to it."""
        if not self.sees("<"):
            return False
        back, depth = (self.at, self.last), 0
        while True:
            t = self.peek()
            if t.kind == "end" or t.text == ";" or (t.kind == "punct" and t.text in (")", "]", "}", "&&", "||", "=>=")):
                self.at, self.last = back
                return False
            if t.kind == "template":
                self.template()
                continue
            if t.kind == "punct" and t.text in _CLOSE:
                self.balanced()
                continue
            self.take()
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
            elif t.text == "<<":
                depth += 2
            elif t.text in (">=", ">>=", ">>>="):
                self.at = self.last = t.start + 1  # only one mark of it closes
                depth -= 1
            if depth == 0:
                return True

    def type_(self) -> None:
        """Takes a type."""
        self.accept("|", "&")
        while True:
            self.type_operand()
            if self.accept("|", "&"):
                continue
            if self.sees("extends") and not self.peek().newline:
                self.take()
                self.type_operand()
                while self.accept("|", "&"):
                    self.type_operand()
                if self.accept("?"):
                    self.type_()
                    if self.accept(":"):
                        continue
            return

    def type_operand(self) -> None:
        while self.sees("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract", "-") and self.after(self.peek()).text not in (",", ")", ">", ";", "=", "|", "]", "}"):
            self.take()
        t = self.peek()
        if t.kind == "template":
            self.template()
        elif t.kind in ("string", "number"):
            self.take()
        elif t.text == "<":
            self.type_arguments()
            self.type_operand()
            return
        elif t.kind == "punct" and t.text in _CLOSE:
            self.balanced()
            if t.text == "(" and self.accept("=>"):
                self.type_()
                return
        elif t.kind == "name":
            self.take()
            if t.text == "import" and self.sees("("):
                self.balanced()
            while self.accept("."):
                self.take()
            if not self.peek().newline:
                self.type_arguments()
        else:
            raise Stuck("type")
        while True:
            if self.sees("[") and not self.peek().newline:
                self.balanced()
            elif self.sees("is") and not self.peek().newline:
                self.take()
                self.type_()
            else:
                return

    def annotation(self) -> None:
        if self.accept(":"):
            self.type_()

    # Statements

    def program(self) -> Node:
        root = Node("program", 0)
        self.statements(root, None)
        root.end = len(self.code)
        return root

    def bare_words(self, into: Node) -> None:
        """Takes statements that are names alone, without a node for each. What this leaves is read as any other statement."""
        start, at, n, names = self.at, self.at, 0, 0
        while (m := _WORD.match(self.code, at)) and m[2] not in _JOINS:
            found = _NAMES.findall(m[1])
            if not _STARTS.isdisjoint(found):
                break
            at, n, names = m.end(1), n + 1, names + len(found)
        if n:
            self.at = self.last = at
            node = self.done(Node(WORDS, start))
            node.comments, node.names = n, names
            into.add(node)

    def statements(self, into: Node, close: str | None) -> None:
        while True:
            if self.words:
                self.bare_words(into)
            t = self.peek(operand=True)
            into.comments += t.comment
            if t.kind == "end" or close and t.text == close and t.kind == "punct":
                return
            back = self.at
            try:
                into.add(self.statement())
            except Stuck:
                pass
            if self.at == back:
                self.take(operand=True)

    def block(self) -> Node:
        node = Node("statement_block", self.expect("{").start)
        self.statements(node, "}")
        self.accept("}")
        return self.done(node)

    def semicolon(self) -> None:
        self.accept(";")

    def statement(self) -> Node | None:
        t = self.peek(operand=True)
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.take()
                return self.done(Node("empty_statement", t.start))
            if t.text == "@":
                self.decorators()
                return self.statement()
        if t.kind == "name":
            f = getattr(self, f"_{t.text}_statement", None) if t.text.isascii() else None
            if f is not None and self.after(t).text not in ("=", ".", "?.", ":", ",", ")", "=>", "+=") and (node := f(t)) is not None:
                return node
            if self.after(t).text == ":" and self.after(t).kind == "punct" and t.text not in ("default", "case"):
                node = Node("labeled_statement", self.take().start)
                self.take()
                return self.done(node.add(self.statement(), "body"))
        node = Node("expression_statement", t.start)
        node.add(self.expression())
        self.semicolon()
        return self.done(node)

    def decorators(self) -> list[Node]:
        out = []
        while self.accept("@"):
            out.append(self.postfix(self.primary(), calls=True))
        return out

    def condition(self) -> Node:
        node = Node("parenthesized_expression", self.expect("(").start)
        node.add(self.expression())
        self.expect(")")
        return self.done(node)

    def _if_statement(self, t: Token) -> Node:
        node = Node("if_statement", self.take().start)
        node.add(self.condition(), "condition").add(self.statement(), "consequence")
        if e := self.accept("else"):
            other = Node("else_clause", e.start)
            node.add(self.done(other.add(self.statement())), "alternative")
        return self.done(node)

    def _for_statement(self, t: Token) -> Node:
        start = self.take().start
        self.accept("await")
        self.expect("(")
        node = Node("for_statement", start)
        self.no_in += 1
        try:
            if not self.sees(";"):
                if self.sees("var", "let", "const", "using"):
                    node.add(self.variables(self.take().start))
                else:
                    node.add(self.expression())
        finally:
            self.no_in -= 1
        if self.accept("of", "in"):
            node.type = "for_in_statement"
            node.add(self.expression(), "right")
        else:
            for _ in range(2):
                self.accept(";")
                if not self.sees(";", ")"):
                    node.add(self.expression())
        self.expect(")")
        return self.done(node.add(self.statement(), "body"))

    def _while_statement(self, t: Token) -> Node:
        node = Node("while_statement", self.take().start)
        return self.done(node.add(self.condition(), "condition").add(self.statement(), "body"))

    def _do_statement(self, t: Token) -> Node:
        node = Node("do_statement", self.take().start)
        node.add(self.statement(), "body")
        self.expect("while")
        node.add(self.condition(), "condition")
        self.semicolon()
        return self.done(node)

    def _switch_statement(self, t: Token) -> Node:
        node = Node("switch_statement", self.take().start)
        node.add(self.condition(), "value")
        body = Node("switch_body", self.expect("{").start)
        while not self.sees("}") and self.peek().kind != "end":
            head = self.take()
            part = Node("switch_case" if head.text == "case" else "switch_default", head.start)
            if head.text == "case":
                part.add(self.expression(), "value")
            elif head.text != "default":
                continue
            self.accept(":")
            while not self.sees("case", "default", "}") and self.peek().kind != "end":
                back = self.at
                try:
                    part.add(self.statement())
                except Stuck:
                    pass
                if self.at == back:
                    self.take(operand=True)
            body.add(self.done(part))
        self.accept("}")
        return self.done(node.add(self.done(body), "body"))

    def _try_statement(self, t: Token) -> Node:
        node = Node("try_statement", self.take().start)
        node.add(self.block(), "body")
        if c := self.accept("catch"):
            clause = Node("catch_clause", c.start)
            if self.accept("("):
                clause.add(self.pattern(), "parameter")
                self.annotation()
                self.expect(")")
            node.add(self.done(clause.add(self.block(), "body")), "handler")
        if f := self.accept("finally"):
            node.add(self.done(Node("finally_clause", f.start).add(self.block(), "body")), "finalizer")
        return self.done(node)

    def _return_statement(self, t: Token) -> Node:
        node = Node(f"{t.text}_statement", self.take().start)
        n = self.peek(operand=True)
        if not n.newline and n.kind != "end" and n.text not in (";", "}"):
            node.add(self.expression())
        self.semicolon()
        return self.done(node)

    _throw_statement = _return_statement

    def _break_statement(self, t: Token) -> Node:
        node = Node(f"{t.text}_statement", self.take().start)
        if self.peek().kind == "name" and not self.peek().newline:
            self.take()
        self.semicolon()
        return self.done(node)

    _continue_statement = _break_statement

    def _var_statement(self, t: Token) -> Node | None:
        n = self.after(t)
        if t.text == "const" and n.text == "enum":
            self.take()
            return self._enum_statement(t)
        if t.text in ("let", "using") and not (n.kind == "name" or n.text in ("{", "[")):
            return None
        node = self.variables(self.take().start)
        self.semicolon()
        return self.done(node)

    _let_statement = _const_statement = _using_statement = _var_statement

    def variables(self, start: int) -> Node:
        node = Node("lexical_declaration", start)
        while True:
            d = Node("variable_declarator", self.peek().start)
            d.add(self.pattern(), "name")
            self.accept("!")
            self.annotation()
            if self.accept("="):
                d.add(self.assignment(), "value")
            node.add(self.done(d))
            if not self.accept(","):
                return self.done(node)

    def pattern(self) -> Node:
        t = self.peek()
        if t.text in ("{", "[") and t.kind == "punct":
            node = self.primary()
            node.type = f"{node.type}_pattern"
            return node
        if t.kind != "name":
            raise Stuck("pattern")
        self.take()
        return self.done(Node("identifier", t.start, text=t.text))

    def _function_statement(self, t: Token) -> Node:
        return self.function(t.start, declaration=True)

    def _async_statement(self, t: Token) -> Node | None:
        n = self.after(t)
        if n.text != "function" or n.newline:
            return None
        self.take()
        return self.function(t.start, declaration=True)

    def function(self, start: int, declaration: bool) -> Node:
        self.expect("function")
        star = self.accept("*")
        names = {(True, False): "function_declaration", (True, True): "generator_function_declaration", (False, False): self.expression_type, (False, True): "generator_function"}
        node = Node(names[declaration, bool(star)], start)
        if self.peek().kind == "name":
            n = self.take()
            node.add(self.done(Node("identifier", n.start, text=n.text)), "name")
        self.signature(node)
        if self.sees("{"):
            node.add(self.block(), "body")
        else:
            node.type = "function_signature"
            self.semicolon()
        return self.done(node)

    def signature(self, node: Node) -> None:
        self.type_arguments()
        node.add(self.parameters(), "parameters")
        self.annotation()

    def parameters(self) -> Node:
        node = Node("formal_parameters", self.expect("(").start)
        while not self.sees(")") and self.peek().kind != "end":
            back = self.at
            node.children += self.decorators()
            p = Node("required_parameter", self.peek().start)
            while self.sees("public", "private", "protected", "readonly", "override") and (self.after(self.peek()).kind == "name" or self.after(self.peek()).text in "{["):
                self.take()
            self.accept("...")
            p.add(self.pattern(), "pattern")
            if self.accept("?"):
                p.type = "optional_parameter"
            self.annotation()
            if self.accept("="):
                p.add(self.assignment(), "value")
            node.add(self.done(p))
            if not self.accept(",") and not self.sees(")") or self.at == back:
                raise Stuck("parameter")
        self.expect(")")
        return self.done(node)

    def _class_statement(self, t: Token) -> Node:
        return self.class_("class_declaration")

    def class_(self, kind: str) -> Node:
        node = Node(kind, self.expect("class").start)
        if self.peek().kind == "name" and not self.sees("extends", "implements"):
            n = self.take()
            node.add(self.done(Node("type_identifier", n.start, text=n.text)), "name")
        self.type_arguments()
        while not self.sees("{"):
            if self.accept("extends"):
                node.add(self.postfix(self.primary(), calls=True))
                self.type_arguments()
            elif self.accept("implements"):
                self.type_()
                while self.accept(","):
                    self.type_()
            else:
                raise Stuck("class")
        body = Node("class_body", self.take().start)
        while not self.sees("}") and self.peek().kind != "end":
            back = self.at
            try:
                body.add(self.member())
            except Stuck:
                pass
            if self.at == back:
                self.take(operand=True)
        self.accept("}")
        return self.done(node.add(self.done(body), "body"))

    def member(self) -> Node | None:
        if self.accept(";"):
            return None
        before = self.decorators()
        t = self.peek()
        if t.text == "static" and self.after(t).text == "{":
            self.take()
            return self.done(Node("class_static_block", t.start).add(self.block(), "body"))
        while self.sees(*_MODIFIERS):
            n = self.after(self.peek())
            if n.kind == "punct" and n.text not in ("[", "*", "{", "#", "@") or n.kind == "end":
                break
            self.take()
        self.accept("*")
        if self.sees("[") and self.index_signature():
            return None
        name = self.key()
        self.accept("?")
        self.accept("!")
        if self.sees("(", "<"):
            node = Node("method_definition", t.start).add(name, "name")
            self.signature(node)
            if self.sees("{"):
                node.add(self.block(), "body")
            else:
                node.type = "method_signature"
                self.semicolon()
        else:
            node = Node("public_field_definition", t.start)
            node.children += before
            node.add(name, "name")
            self.annotation()
            if self.accept("="):
                node.add(self.assignment(), "value")
            self.semicolon()
        return self.done(node)

    def index_signature(self) -> bool:
        """[key: type]: type of a class."""
        t = self.peek()
        name = self.after(t)
        if name.kind != "name" or self.after(name).text not in (":", "in"):
            return False
        self.balanced()
        self.annotation()
        self.semicolon()
        return True

    def key(self) -> Node:
        t = self.peek()
        if t.text == "[" and t.kind == "punct":
            node = Node("computed_property_name", self.take().start)
            node.add(self.assignment())
            self.expect("]")
            self.done(node)
            node.text = self.code[node.start : node.end]
            return node
        if t.kind not in ("name", "string", "number"):
            raise Stuck("key")
        self.take()
        return self.done(Node({"name": "property_identifier", "string": "string", "number": "number"}[t.kind], t.start, text=t.text))

    def _interface_statement(self, t: Token) -> Node | None:
        if self.after(t).kind != "name" or self.after(t).newline:
            return None
        node = Node("interface_declaration", self.take().start)
        while not self.sees("{") and self.peek().kind != "end":
            if not self.type_arguments():
                self.take()
        self.balanced()
        return self.done(node)

    def _type_statement(self, t: Token) -> Node | None:
        n = self.after(t)
        if n.kind != "name" or n.newline or self.after(n).text not in ("=", "<"):
            return None
        node = Node("type_alias_declaration", self.take().start)
        self.take()
        self.type_arguments()
        self.expect("=")
        self.type_()
        self.semicolon()
        return self.done(node)

    def _enum_statement(self, t: Token) -> Node | None:
        if self.after(self.peek()).kind != "name":
            return None
        node = Node("enum_declaration", t.start)
        self.take()
        self.take()
        self.expect("{")
        while not self.sees("}") and self.peek().kind != "end":
            self.key()
            if self.accept("="):
                node.add(self.assignment())
            self.accept(",")
        self.accept("}")
        return self.done(node)

    def _namespace_statement(self, t: Token) -> Node | None:
        n = self.after(t)
        if n.kind not in ("name", "string") and n.text != "{" or n.newline:
            return None
        node = Node("internal_module", self.take().start)
        while not self.sees("{"):
            if self.accept(";") or self.peek().kind == "end" or self.peek().newline:
                return self.done(node)
            self.take()
        return self.done(node.add(self.block(), "body"))

    _module_statement = _global_statement = _namespace_statement

    def _declare_statement(self, t: Token) -> Node | None:
        if self.after(t).kind != "name" or self.after(t).newline:
            return None
        node = Node("ambient_declaration", self.take().start)
        return self.done(node.add(self.statement()))

    def _abstract_statement(self, t: Token) -> Node | None:
        if self.after(t).text != "class":
            return None
        self.take()
        node = self.class_("abstract_class_declaration")
        node.start = t.start
        return node

    def _export_statement(self, t: Token) -> Node:
        node = Node("export_statement", self.take().start)
        if self.accept("default"):
            n = self.peek(operand=True)
            if n.text in ("function", "class", "abstract", "interface") or n.text == "async" and self.after(n).text == "function":
                node.add(self.statement())
            else:
                node.add(self.assignment(), "value")
        elif self.accept("="):
            node.add(self.assignment())
        elif self.sees("*", "{") or self.sees("type") and self.after(self.peek()).text in ("{", "*"):
            self.accept("type")
            if self.accept("*"):
                if self.accept("as"):
                    self.take()
            else:
                self.balanced()
            if self.accept("from"):
                self.take()
            self.import_attributes()
        elif self.sees("as") or self.sees("import"):
            while not self.sees(";") and self.peek().kind != "end" and not (self.peek().newline and self.last > node.start + 6):
                self.take()
        else:
            return self.done(node.add(self.statement(), "declaration"))
        self.semicolon()
        return self.done(node)

    def import_attributes(self) -> None:
        if self.sees("with", "assert") and not self.peek().newline:
            self.take()
            if self.sees("{"):
                self.balanced()

    def _import_statement(self, t: Token) -> Node | None:
        if self.after(t).text in ("(", "."):
            return None
        node = Node("import_statement", self.take().start)
        while True:
            n = self.peek()
            if n.kind == "string":
                self.take()
                self.import_attributes()
                break
            if n.text == "{":
                self.balanced()
            elif n.text == "=":
                self.take()
                node.add(self.assignment())
                break
            elif n.kind == "end" or n.text == ";":
                break
            else:
                self.take()
        self.semicolon()
        return self.done(node)

    # Expressions

    def expression(self) -> Node:
        node = self.assignment()
        while self.sees(","):
            self.take()
            more = Node("sequence_expression", node.start)
            node = self.done(more.add(node).add(self.assignment()))
        return node

    def assignment(self) -> Node:
        t = self.peek(operand=True)
        if (arrow := self.arrow(t)) is not None:
            return arrow
        if t.kind == "name" and t.text == "yield":
            node = Node("yield_expression", self.take().start)
            n = self.peek(operand=True)
            if not n.newline and n.text not in (")", "]", "}", ",", ";", ":") and n.kind != "end":
                self.accept("*")
                node.add(self.assignment())
            return self.done(node)
        left = self.conditional()
        n = self.peek()
        if n.kind == "punct" and (n.text in _ASSIGN or n.text == ">" and self.code.startswith(("=", ">=", ">>="), n.end) and self.code[n.start : n.start + 4].rstrip() in (">>=", ">>>=")):
            self.take()
            node = Node("assignment_expression" if n.text == "=" else "augmented_assignment_expression", left.start)
            return self.done(node.add(left, "left").add(self.assignment(), "right"))
        return left

    def arrow(self, t: Token) -> Node | None:
        """An arrow function, if one starts here."""
        start, head = t.start, t
        if t.kind == "name" and t.text == "async" and not self.after(t).newline and (self.after(t).kind == "name" or self.after(t).text in ("(", "<")) and self.after(t).text != "function":
            head = self.after(t)
        if head.kind == "name" and self.after(head).text == "=>" and not self.after(head).newline:
            self.at = self.last = head.end
            node = Node("arrow_function", start).add(Node("identifier", head.start, head.end, head.text), "parameter")
            return self.arrow_body(node)
        if head.text not in ("(", "<") or head.kind != "punct":
            return None
        if head.text == "<" and self.tsx and self.after(self.after(head)).text not in (",", "extends"):
            return None
        back = self.at, self.last
        self.at = head.start
        if head.text == "(" and not self.arrow_ahead(head):
            self.at, self.last = back
            return None
        self.at = head.start
        try:
            node = Node("arrow_function", start)
            self.type_arguments()
            node.add(self.parameters(), "parameters")
            self.annotation()
            if not self.sees("=>"):
                raise Stuck("=>")
            return self.arrow_body(node)
        except Stuck:
            self.at, self.last = back
            return None

    def arrow_ahead(self, head: Token) -> bool:
        self.balanced()
        n = self.peek()
        if n.text == "=>":
            return True
        if n.text != ":" or self.code[self.last - 1 : self.last] != ")":
            return False
        if self.ternary and self.after(head).kind != "name" and self.after(head).text not in (")", "{", "[", "..."):
            return False
        try:
            self.take()
            self.type_()
            return self.sees("=>")
        except Stuck:
            return False

    def arrow_body(self, node: Node) -> Node:
        self.expect("=>")
        saved, self.ternary = (self.ternary, self.no_in), 0
        self.ternary, in_ = 0, self.no_in
        if self.sees("{"):
            self.no_in = 0
            node.add(self.block(), "body")
        else:
            node.add(self.assignment(), "body")
        self.ternary, self.no_in = saved[0], in_
        return self.done(node)

    def conditional(self) -> Node:
        test = self.binary(0)
        if not self.sees("?"):
            return test
        self.take()
        node = Node("ternary_expression", test.start).add(test, "condition")
        self.ternary += 1
        saved, self.no_in = self.no_in, 0
        node.add(self.assignment(), "consequence")
        self.no_in = saved
        self.ternary -= 1
        self.expect(":")
        return self.done(node.add(self.assignment(), "alternative"))

    def operator(self) -> tuple[str, int]:
        """The binary operator that comes next and the end of its text."""
        t = self.peek()
        if t.kind == "punct" and t.text == ">":
            text = ">"
            while text in (">", ">>") and self.code.startswith(">", t.start + len(text)):
                text += ">"
            if self.code.startswith("=", t.start + len(text)) and not self.code.startswith("=>", t.start + len(text)):
                text += "="
            return text, t.start + len(text)
        return (t.text, t.end) if t.kind in ("punct", "name") else ("", t.end)

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            t = self.peek()
            if t.kind == "name" and t.text in ("as", "satisfies") and not t.newline:
                self.take()
                if not self.accept("const"):
                    self.type_()
                left = self.done(Node(f"{t.text}_expression", left.start).add(left))
                continue
            text, end = self.operator()
            rank = _BINARY.get(text, 0)
            if not rank or rank <= least and not (text == "**" and rank == least) or text == "in" and self.no_in:
                return left
            self.at = self.last = end
            node = Node("binary_expression", left.start, text=None).add(left, "left")
            node.add(Node("operator", t.start, end, text), "operator")
            left = self.done(node.add(self.binary(rank - (text == "**")), "right"))

    def unary(self) -> Node:
        t = self.peek(operand=True)
        if t.kind == "punct" and t.text in ("!", "~", "+", "-", "++", "--") or t.kind == "name" and t.text in _UNARY_WORDS and self.after(t, True).text not in (")", ",", ";", "=", ".", "=>", "]", "}", ":", "?", "&&", "||"):
            self.take()
            kind = "await_expression" if t.text == "await" else "update_expression" if t.text in ("++", "--") else "unary_expression"
            return self.done(Node(kind, t.start).add(self.unary(), "argument"))
        if t.kind == "punct" and t.text == "<" and not self.tsx:
            back = self.at, self.last
            if self.type_arguments():
                return self.done(Node("type_assertion", t.start).add(self.unary()))
            self.at, self.last = back
        node = self.postfix(self.primary(), calls=True)
        n = self.peek()
        if n.text in ("++", "--") and not n.newline:
            self.take()
            node = self.done(Node("update_expression", node.start).add(node, "argument"))
        return node

    def arguments(self) -> Node:
        node = Node("arguments", self.expect("(").start)
        self.listed(node, ")")
        return self.done(node)

    def listed(self, node: Node, close: str) -> None:
        saved = self.no_in, self.ternary
        self.no_in = self.ternary = 0
        while not self.sees(close):
            t = self.peek(operand=True)
            if t.kind == "end":
                break
            if self.accept(","):
                continue
            if self.accept("..."):
                node.add(self.done(Node("spread_element", t.start).add(self.assignment())))
            else:
                node.add(self.assignment())
            if not self.sees(",", close):
                raise Stuck(close)
        self.no_in, self.ternary = saved
        self.accept(close)

    def postfix(self, node: Node, calls: bool) -> Node:
        while True:
            t = self.peek()
            if t.kind == "template":
                node = self.done(Node("call_expression", node.start).add(node, "function").add(self.template(), "arguments"))
                continue
            if t.kind != "punct":
                return node
            if t.text in (".", "?."):
                self.take()
                n = self.peek()
                if n.text == "(" and t.text == "?." and calls:
                    node = self.done(Node("call_expression", node.start).add(node, "function").add(self.arguments(), "arguments"))
                elif n.text == "[" and t.text == "?.":
                    node = self.subscript(node)
                elif n.kind == "name":
                    self.take()
                    prop = self.done(Node("property_identifier", n.start, text=n.text))
                    node = self.done(Node("member_expression", node.start).add(node, "object").add(prop, "property"))
                else:
                    raise Stuck("property")
            elif t.text == "[":
                node = self.subscript(node)
            elif t.text == "(" and calls:
                node = self.done(Node("call_expression", node.start).add(node, "function").add(self.arguments(), "arguments"))
            elif t.text == "!" and not t.newline and self.code[t.end : t.end + 1] != "=":
                self.take()
                node = self.done(Node("non_null_expression", node.start).add(node))
            elif t.text == "<":
                back = self.at, self.last
                if self.type_arguments() and (self.sees("(", ")", "]", ",", ";", ".", "?.") or self.peek().kind == "template") and not (self.sees("(") and not calls):
                    continue
                if not calls and self.at != back[0] and self.sees("("):
                    return node
                self.at, self.last = back
                return node
            else:
                return node

    def subscript(self, node: Node) -> Node:
        self.expect("[")
        out = Node("subscript_expression", node.start).add(node, "object").add(self.expression(), "index")
        self.expect("]")
        return self.done(out)

    def primary(self) -> Node:
        t = self.peek(operand=True)
        if t.kind == "template":
            return self.template()
        if t.kind in ("number", "string", "regex"):
            self.take(operand=True)
            return self.done(Node(t.kind, t.start, text=t.text if t.kind != "regex" else None))
        if t.kind == "name":
            if t.text == "function":
                return self.function(t.start, declaration=False)
            if t.text == "async" and self.after(t).text == "function" and not self.after(t).newline:
                self.take()
                return self.function(t.start, declaration=False)
            if t.text == "class":
                return self.class_("class")
            if t.text == "new":
                return self.new()
            self.take()
            return self.done(Node("identifier", t.start, text=t.text))
        if t.text == "(":
            node = Node("parenthesized_expression", self.take().start)
            saved = self.no_in, self.ternary
            self.no_in = self.ternary = 0
            node.add(self.expression())
            self.annotation()
            self.expect(")")
            self.no_in, self.ternary = saved
            return self.done(node)
        if t.text == "[":
            node = Node("array", self.take().start)
            self.listed(node, "]")
            return self.done(node)
        if t.text == "{":
            return self.object_()
        if t.text == "<" and self.tsx:
            return self.element()
        if t.text == "@":
            self.decorators()
            return self.primary()
        raise Stuck("operand")

    def new(self) -> Node:
        t = self.take()
        if self.sees("."):
            self.take()
            self.take()
            return self.done(Node("meta_property", t.start))
        node = Node("new_expression", t.start)
        node.add(self.postfix(self.primary(), calls=False), "constructor")
        self.type_arguments()
        if self.sees("("):
            node.add(self.arguments(), "arguments")
        return self.done(node)

    def object_(self) -> Node:
        node = Node("object", self.expect("{").start)
        saved = self.no_in, self.ternary
        self.no_in = self.ternary = 0
        while not self.sees("}") and self.peek().kind != "end":
            t = self.peek()
            if self.accept(","):
                continue
            if self.accept("..."):
                node.add(self.done(Node("spread_element", t.start).add(self.assignment())))
                continue
            while self.sees("async", "get", "set") and (self.after(self.peek()).kind in ("name", "string", "number") or self.after(self.peek()).text in ("[", "*")):
                self.take()
            self.accept("*")
            key = self.key()
            if self.sees("(", "<"):
                method = Node("method_definition", t.start).add(key, "name")
                self.signature(method)
                node.add(self.done(method.add(self.block(), "body")))
            elif self.accept(":"):
                pair = Node("pair", t.start).add(key, "key")
                node.add(self.done(pair.add(self.assignment(), "value")))
            else:
                short = Node("shorthand_property_identifier", t.start, text=key.text)
                if self.accept("="):
                    short.add(self.assignment())
                node.add(self.done(short))
            if not self.sees(",", "}"):
                raise Stuck("}")
        self.accept("}")
        self.no_in, self.ternary = saved
        return self.done(node)

    def template(self) -> Node:
        node = Node("template_string", self.take().start)
        code, at = self.code, self.at
        while at < len(code):
            c = code[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self.at = self.last = at + 1
                return self.done(node)
            elif code.startswith("${", at):
                part = Node("template_substitution", at)
                self.at = at + 2
                part.add(self.expression())
                self.expect("}")
                node.add(self.done(part))
                at = self.at
            else:
                at += 1
        self.at = self.last = len(code)
        return self.done(node)

    def element(self) -> Node:
        """A JSX element or fragment."""
        node = Node("jsx_element", self.expect("<").start)
        if not self.sees(">"):
            self.jsx_name()
            self.type_arguments()
            while not self.sees(">", "/"):
                t = self.peek()
                if t.text == "{":
                    node.add(self.jsx_expression())
                elif t.kind == "name":
                    attribute = Node("jsx_attribute", t.start)
                    self.jsx_name()
                    if self.accept("="):
                        n = self.peek()
                        if n.kind == "string":
                            quote = self.code.find(n.text[0], n.start + 1)
                            self.at = self.last = quote + 1 if quote >= 0 else len(self.code)
                        elif n.text == "{":
                            attribute.add(self.jsx_expression())
                        else:
                            attribute.add(self.element())
                    node.add(self.done(attribute))
                else:
                    raise Stuck("attribute")
        if self.accept("/"):
            self.expect(">")
            return self.done(node)
        self.expect(">")
        code = self.code
        while True:
            at = self.at
            while at < len(code) and code[at] not in "<{":
                at += 1
            self.at = self.last = at
            if at >= len(code):
                return self.done(node)
            if code[at] == "{":
                node.add(self.jsx_expression())
            elif self.after(self.peek()).text == "/":
                self.take()
                self.take()
                while not self.accept(">"):
                    if self.peek().kind == "end":
                        break
                    self.take()
                return self.done(node)
            else:
                node.add(self.element())

    def jsx_name(self) -> None:
        self.take()
        while self.sees("-", ".", ":"):
            self.take()
            if self.peek().kind in ("name", "number"):
                self.take()

    def jsx_expression(self) -> Node:
        node = Node("jsx_expression", self.expect("{").start)
        self.accept("...")
        if not self.sees("}"):
            node.add(self.expression())
        self.expect("}")
        return self.done(node)


#: Names that may start something other than a statement of their own.
_STARTS = {m[1:-10] for m in dir(Parser) if m.startswith("_") and m.endswith("_statement")} | _UNARY_WORDS | _JOINS | {"async", "yield", "function", "class", "new"}


def parse(code: str, tsx: bool = False, function_expressions: bool = False, words: bool = False) -> Node:
    """The tree of a file. With ``words`` a run of statements that are names alone is one node ``WORDS``."""
    return Parser(code, tsx, function_expressions, words).program()


class Rows:
    """Rows of a file's places."""

    def __init__(self, code: str):
        self.breaks = [m.start() for m in re.finditer("\n", code)]

    def of(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) if at else 0
