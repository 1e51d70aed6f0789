"""Rust definitions, by a recursive-descent parser for items and bodies."""

from __future__ import annotations

import re

from .base import Analysis, Definition, Lines
from .tree import Node, ParseError, Reader, Renaming, size, written

WORD = re.compile(r"(?:r#)?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*")
LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')")
CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|.))'")
STRING = re.compile(r"(?:b|c)?\"(?:[^\"\\]|\\.)*\"", re.S)
RAW = re.compile(r"(?:b|c)?r(#*)\"")
NUMBER = re.compile(r"0x[\da-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?|[eE][+-]?\d+|\.(?![.\w]))?(?:[iuf](?:8|16|32|64|128|size))?")
# The punctuators, longest first, and the binary operators by precedence.
PUNCT = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != + - * / % << >> & | ^ ! && || ? : :: = += -= *= /= %= <<= >>= &= |= ^= => -> . .. ..= ... @ # $ ~".split(),
    key=len,
    reverse=True,
)
BINARY = {
    "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9,
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "|=", "^="}
STUB_MACROS = {"todo", "unimplemented", "panic", "unreachable", "write", "writeln", "matches"}
CONSTANT_NAME = re.compile(r"[A-Z0-9_]+\Z")
ITEM_WORDS = {"fn", "struct", "enum", "union", "trait", "impl", "mod", "use", "const", "static", "type", "extern", "macro_rules"}
BLOCK_LIKE = {"If", "Match", "For", "While", "Loop", "BlockExpr", "Unsafe", "Async"}


def _after_space(text: str, pos: int) -> int:
    n = len(text)
    while pos < n:
        if text[pos].isspace():
            pos += 1
        elif text.startswith("//", pos):
            end = text.find("\n", pos)
            pos = n if end < 0 else end
        elif text.startswith("/*", pos):
            depth, pos = 1, pos + 2
            while depth:
                a, b = text.find("/*", pos), text.find("*/", pos)
                if b < 0:
                    raise ParseError("open comment")
                if 0 <= a < b:
                    depth, pos = depth + 1, a + 2
                else:
                    depth, pos = depth - 1, b + 2
        else:
            break
    return pos


class Parser(Reader):
    """Items, statements, expressions and patterns; types are kept as normalised text."""

    def __init__(self, text: str):
        self.no_struct = False
        super().__init__(text)
        if text.startswith("#!") and not text.startswith("#!["):
            self.jump(text.find("\n") if "\n" in text else len(text))

    def cut(self, pos: int) -> tuple[str, str, int, int, bool]:
        text = self.text
        start = _after_space(text, pos)
        line = "\n" in text[pos:start]
        if start >= len(text):
            return "eof", "", start, start, line
        c = text[start]
        if c in "rbc" and (m := RAW.match(text, start)):
            end = text.find('"' + m.group(1), m.end())
            if end < 0:
                raise ParseError(f"open string at {start}")
            end += 1 + len(m.group(1))
            return "str", text[start:end], start, end, line
        if c in "bc\"" and (m := STRING.match(text, start)):
            return "str", m.group(), start, m.end(), line
        if c in "b'" and (m := CHAR.match(text, start)):
            return "char", m.group(), start, m.end(), line
        if c == "'" and (m := LIFETIME.match(text, start)):
            return "life", m.group(), start, m.end(), line
        if m := WORD.match(text, start):
            return "id", m.group(), start, m.end(), line
        if c.isdigit() and (m := NUMBER.match(text, start)):
            return "num", m.group(), start, m.end(), line
        for p in PUNCT:
            if text.startswith(p, start):
                return "punct", p, start, start + len(p), line
        raise ParseError(f"unknown character at {start}")

    def done(self, node: Node, start: int) -> Node:
        node.start, node.end = start, self.last_end
        return node

    def split(self, first: str) -> None:
        """Take ``first`` off the front of a longer punctuator."""
        if not (self.token[0] == "punct" and self.token[1].startswith(first)):
            raise ParseError(f"expected {first!r} at {self.token[2]}")
        self.jump(self.token[2] + len(first))

    def starts(self, first: str) -> bool:
        return self.token[0] == "punct" and self.token[1].startswith(first)

    def group(self) -> None:
        """Skip one bracketed token tree."""
        depth = 0
        pairs = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
        while True:
            if self.token[0] == "eof":
                raise ParseError("open bracket")
            depth += pairs.get(self.token[1], 0) if self.token[0] == "punct" else 0
            self.advance()
            if depth == 0:
                return

    def attributes(self) -> None:
        while self.at("#"):
            self.advance()
            self.take("!")
            self.group()

    # ---- types, kept as text

    def type_text(self, bounds: bool = True) -> str:
        start = self.token[2]
        self.type_(bounds)
        return " ".join(re.findall(r"\w+|[^\w\s]", self.text[start : self.last_end]))

    def type_(self, bounds: bool = True) -> None:
        if self.starts("&"):
            self.split("&")
            if self.token[0] == "life":
                self.advance()
            self.take("mut")
            return self.type_(False)
        if self.take("*"):
            if not self.take("const", "mut"):
                raise ParseError(f"expected a pointer at {self.token[2]}")
            return self.type_(False)
        if self.at("(", "["):
            self.group()
        elif self.take("!") or self.take("_"):
            pass
        elif self.take("dyn", "impl"):
            self.bound()
        elif self.at("for"):
            self.advance()
            self.angle()
            return self.type_(bounds)
        elif self.at("unsafe", "extern", "fn"):
            while not self.take("fn"):
                self.advance()
            self.group()
            if self.take("->"):
                self.type_(False)
        else:
            self.type_path()
        if bounds:
            while self.take("+"):
                self.bound()
        return None

    def bound(self) -> None:
        while True:
            self.take("?")
            if self.take("("):
                self.bound()
                self.expect(")")
            elif self.token[0] == "life":
                self.advance()
            elif self.at("for"):
                self.advance()
                self.angle()
                self.type_path()
            else:
                self.type_path()
            if not self.take("+"):
                return

    def type_path(self) -> None:
        if self.starts("<"):
            self.angle()
        else:
            self.take("::")
            self.identifier()
        while True:
            if self.starts("<") and not self.at("<=", "<<="):
                self.angle()
            elif self.at("("):
                self.group()
                if self.take("->"):
                    self.type_(False)
            elif self.at("!"):
                self.advance()
                self.group()
            elif self.take("::"):
                if not self.starts("<"):
                    self.identifier()
            else:
                return

    def angle(self) -> None:
        """Skip generic arguments or parameters."""
        self.split("<")
        while not self.starts(">"):
            if self.take(",", ":", "=", "+", "?", "const"):
                continue
            if self.token[0] in ("life", "num", "str", "char") or self.at("-"):
                self.advance()
            elif self.at("{"):
                self.group()
            else:
                self.type_()
        self.split(">")

    def where(self) -> None:
        if self.take("where"):
            while not self.at("{", ";", "="):
                if self.token[0] == "eof":
                    raise ParseError("open where")
                if self.take(",", ":", "+", "?"):
                    continue
                if self.token[0] == "life":
                    self.advance()
                else:
                    self.type_()

    # ---- items

    def file(self) -> list[Node]:
        out = []
        while self.token[0] != "eof":
            out.append(self.item())
        return out

    def visibility(self) -> None:
        if self.take("pub") and self.at("(") and self.peek()[1] in ("crate", "super", "self", "in"):
            self.group()

    def item(self) -> Node:
        self.attributes()
        start = self.token[2]
        self.visibility()
        return self.done(self._item(), start)

    def _item(self) -> Node:
        self.take("default")
        if self.at("const") and self.peek()[1] not in ("fn", "unsafe", "async", "extern"):
            return self.constant("Const")
        if self.at("static"):
            return self.constant("Static")
        if self.at("unsafe", "async", "const", "extern", "fn"):
            words = set()
            while self.at("unsafe", "async", "const", "extern"):
                words.add(self.advance()[1])
                if self.token[0] == "str":
                    self.advance()
            if self.at("fn"):
                return self.function(words)
            if self.at("crate"):
                return self.until_semicolon("ExternCrate")
            if self.at("{"):
                self.group()
                return Node("ForeignMod")
        if self.at("struct", "union") and self.peek()[0] == "id":
            return self.struct()
        if self.at("enum"):
            return self.enum()
        if self.at("trait") or (self.at("auto") and self.peek()[1] == "trait"):
            self.take("auto")
            return self.trait()
        if self.at("impl"):
            return self.impl()
        if self.at("mod"):
            self.advance()
            name = self.identifier()
            if self.take(";"):
                return Node("Mod", None, name=name)
            self.expect("{")
            items = []
            while True:
                self.attributes()
                if self.take("}"):
                    return Node("Mod", items, name=name)
                items.append(self.item())
        if self.at("type"):
            return self.alias()
        if self.at("use"):
            return self.until_semicolon("Use")
        if self.at("macro_rules"):
            self.advance()
            self.expect("!")
            self.identifier()
            self.group()
            self.take(";")
            return Node("MacroRules")
        if self.token[0] == "id" and self.peek()[1] in ("!", "::"):
            path = self.path_text()
            self.expect("!")
            self.group()
            self.take(";")
            return Node("MacroItem", f"'{path}'")
        raise ParseError(f"expected an item at {self.token[2]}, got {self.token[1]!r}")

    def until_semicolon(self, tag: str) -> Node:
        while not self.at(";"):
            if self.at("{", "(", "["):
                self.group()
            elif self.token[0] == "eof":
                raise ParseError("open item")
            else:
                self.advance()
        self.advance()
        return Node(tag)

    def constant(self, tag: str) -> Node:
        self.advance()
        self.take("mut")
        name = self.identifier()
        self.expect(":")
        kind = self.type_text()
        value = self.expression() if self.take("=") else None
        self.expect(";")
        return Node(tag, kind, value, name=name)

    def alias(self) -> Node:
        self.expect("type")
        name = self.identifier()
        if self.starts("<"):
            self.angle()
        if self.take(":") and not self.at("=", ";"):
            self.bound()
        self.where()
        kind = self.type_text() if self.take("=") else None
        self.where()
        self.expect(";")
        return Node("Type", kind, name=name)

    def generics(self) -> str:
        start = self.token[2]
        if self.starts("<"):
            self.angle()
        inside = self.text[start : self.last_end] if self.last_end > start else ""
        return f"'g{len([p for p in re.split(r',(?![^<]*>[^>]*$)', inside[1:-1]) if p.strip()]) if inside else 0}'"

    def function(self, words: set[str]) -> Node:
        self.expect("fn")
        name = self.identifier()
        if self.starts("<"):
            self.angle()
        self.expect("(")
        params = []
        while not self.take(")"):
            self.attributes()
            if not self.receiver():
                if self.take("..."):
                    continue
                target = self.pattern()
                self.expect(":")
                params.append(Node("Param", target, self.type_text()))
            if not self.at(")"):
                self.expect(",")
        back = self.type_text() if self.take("->") else None
        self.where()
        body = None
        if not self.take(";"):
            body = self.block()
        flags = " ".join(f"{w}={int(w in words)}" for w in ("async", "unsafe", "const"))
        return Node("Func", Node("Params", params), back, f"'{flags}'", body, name=name)

    def receiver(self) -> bool:
        def read() -> bool:
            if self.starts("&"):
                self.split("&")
                if self.token[0] == "life":
                    self.advance()
            self.take("mut")
            if not self.take("self"):
                raise ParseError("no receiver")
            if self.take(":"):
                self.type_()
            return True

        return bool(self.attempt(read))

    def fields(self) -> Node:
        if self.at("{"):
            self.advance()
            out = []
            while not self.take("}"):
                self.attributes()
                self.visibility()
                name = self.identifier()
                self.expect(":")
                out.append(Node("Field", f"'{name}'", self.type_text()))
                if not self.at("}"):
                    self.expect(",")
            return Node("Named", out)
        if self.at("("):
            self.advance()
            out = []
            while not self.take(")"):
                self.attributes()
                self.visibility()
                out.append(Node("Field", "''", self.type_text()))
                if not self.at(")"):
                    self.expect(",")
            return Node("Tuple", out)
        return Node("Unit")

    def struct(self) -> Node:
        tag = "Struct" if self.advance()[1] == "struct" else "Union"
        name = self.identifier()
        generics = self.generics()
        self.where()
        fields = self.fields()
        self.where()
        if fields.tag != "Named":
            self.expect(";")
        return Node(tag, generics, fields, name=name)

    def enum(self) -> Node:
        self.expect("enum")
        name = self.identifier()
        generics = self.generics()
        self.where()
        self.expect("{")
        variants = []
        while not self.take("}"):
            self.attributes()
            self.visibility()
            label = self.identifier()
            fields = self.fields()
            value = self.expression() if self.take("=") else None
            variants.append(Node("Variant", f"'{label}'", fields, value))
            if not self.at("}"):
                self.expect(",")
        return Node("Enum", generics, variants, name=name)

    def trait(self) -> Node:
        self.expect("trait")
        name = self.identifier()
        generics = self.generics()
        if self.take(":"):
            if not self.at("{", "where"):
                self.bound()
        self.where()
        return Node("Trait", generics, self.members(), name=name)

    def members(self) -> list[Node]:
        self.expect("{")
        out = []
        while True:
            self.attributes()
            if self.take("}"):
                return out
            out.append(self.item())

    def impl(self) -> Node:
        self.expect("impl")
        if self.starts("<"):
            self.angle()
        self.take("!")
        target = self.type_text(bounds=False)
        if self.take("for"):
            target = self.type_text(bounds=False)
        self.where()
        return Node("Impl", f"'{last_segment(target)}'", self.members())

    # ---- statements and expressions

    def block(self) -> Node:
        start = self.token[2]
        self.expect("{")
        keep, self.no_struct = self.no_struct, False
        body = []
        while True:
            self.attributes()
            if self.take("}"):
                break
            body.append(self.statement())
        self.no_struct = keep
        return self.done(Node("Block", body), start)

    def statement(self) -> Node:
        start = self.token[2]
        if self.take(";"):
            return self.done(Node("Empty"), start)
        if self.at("let"):
            self.advance()
            target = self.pattern(alternatives=True)
            if self.take(":"):
                self.type_()
            value = self.expression() if self.take("=") else None
            if self.take("else"):
                self.block()
            self.expect(";")
            return self.done(Node("Let", target, value), start)
        word = self.value
        after = self.peek()[1] if self.token[0] == "id" else ""
        expression_start = (word == "unsafe" and after == "{") or (word == "async" and after in ("{", "move", "|", "||")) or (word == "const" and after == "{")
        if word == "pub" or (word in ITEM_WORDS and not expression_start) or (word in ("unsafe", "async") and not expression_start):
            if word == "union" and self.peek()[0] != "id":
                pass
            else:
                self.item()
                return self.done(Node("NestedItem"), start)
        if self.token[0] == "id" and after in ("!", "::"):
            macro = self.attempt(self.macro_statement)
            if macro is not None:
                return self.done(macro, start)
        value = self.expression(statement=True)
        if self.take(";"):
            return self.done(Node("ExprStmt", value), start)
        if self.at("}"):
            return self.done(Node("Tail", value), start)
        if value.tag in BLOCK_LIKE:
            return self.done(Node("ExprStmt", value), start)
        raise ParseError(f"expected ; at {self.token[2]}, got {self.token[1]!r}")

    def macro_statement(self) -> Node:
        path = self.path_text()
        self.expect("!")
        braces = self.at("{")
        self.group()
        if self.take(";") or (braces and not self.at(".", "?")):
            return Node("MacroStmt", f"'{path}'")
        raise ParseError("macro in an expression")

    def path_text(self) -> str:
        parts = [self.identifier()]
        while self.take("::"):
            parts.append(self.identifier())
        return "::".join(parts)

    def expression(self, statement: bool = False) -> Node:
        start = self.token[2]
        if self.at("return", "break", "continue", "yield"):
            return self.done(self.jump_expression(), start)
        if self.at("..", "..="):
            op = self.advance()[1]
            end = None if self.range_ends() else self.binary(0)
            return self.done(Node("Range", None, end, f"'{op}'"), start)
        left = self.binary(0, statement)
        if self.at("..", "..="):
            op = self.advance()[1]
            end = None if self.range_ends() else self.binary(0)
            return self.done(Node("Range", left, end, f"'{op}'"), start)
        if self.token[0] == "punct" and self.value in ASSIGN:
            op = self.advance()[1]
            return self.done(Node("Assign", f"'{op}'", left, self.expression()), start)
        return left

    def range_ends(self) -> bool:
        return self.at(")", "]", "}", ",", ";", "=>") or self.token[0] == "eof" or (self.no_struct and self.at("{"))

    def jump_expression(self) -> Node:
        word = self.advance()[1]
        label = None
        if word in ("break", "continue") and self.token[0] == "life":
            label = self.advance()[1]
        value = None
        if word != "continue" and not self.range_ends():
            value = self.expression()
        return Node(word.capitalize(), label, value) if word in ("break", "continue") else Node(word.capitalize(), value)

    def binary(self, least: int, statement: bool = False) -> Node:
        start = self.token[2]
        left = self.unary()
        if statement and left.tag in BLOCK_LIKE and not self.at(".", "?"):
            return left
        while True:
            if self.take("as"):
                left = self.done(Node("Cast", left, self.type_text(bounds=False)), start)
                continue
            op = self.value
            rank = BINARY.get(op, 0) if self.token[0] == "punct" else 0
            if not rank or rank <= least:
                return left
            self.advance()
            if self.at("return", "break", "continue"):
                right = self.jump_expression()
            else:
                right = self.binary(rank)
            left = self.done(Node("Bin", f"'{op}'", left, right), start)

    def unary(self) -> Node:
        start = self.token[2]
        if self.at("-", "!", "*"):
            op = self.advance()[1]
            return self.done(Node("Unary", f"'{op}'", self.unary()), start)
        if self.starts("&") and not self.at("&="):
            twice = self.at("&&")
            self.advance()
            how = "mut" if self.take("mut") else ""
            if self.at("raw") and self.peek()[1] in ("const", "mut"):
                self.advance()
                self.advance()
            inner = Node("Ref", f"'{how}'", self.unary())
            return self.done(Node("Ref", "''", inner) if twice else inner, start)
        return self.tail(self.primary(), start)

    def tail(self, value: Node, start: int) -> Node:
        while True:
            if self.take("?"):
                value = Node("Try", value)
            elif self.at("(") and not (value.tag in BLOCK_LIKE and self.token[4]):
                value = Node("Call", value, self.arguments(")"))
            elif self.at("[") and not (value.tag in BLOCK_LIKE and self.token[4]):
                self.advance()
                keep, self.no_struct = self.no_struct, False
                index = self.expression()
                self.no_struct = keep
                self.expect("]")
                value = Node("Index", value, index)
            elif self.take("."):
                if self.take("await"):
                    value = Node("Await", value)
                elif self.token[0] == "num":
                    value = Node("Field", value, f"'{self.advance()[1]}'")
                else:
                    name = self.identifier()
                    if self.take("::"):
                        self.angle()
                    if self.at("("):
                        value = Node("Method", value, f"'{name}'", self.arguments(")"))
                    else:
                        value = Node("Field", value, f"'{name}'")
            else:
                return value
            self.done(value, start)

    def arguments(self, close: str) -> list[Node]:
        self.advance()
        keep, self.no_struct = self.no_struct, False
        out = []
        while not self.take(close):
            self.attributes()
            out.append(self.expression())
            if not self.at(close):
                self.expect(",")
        self.no_struct = keep
        return out

    def primary(self) -> Node:
        start = self.token[2]
        return self.done(self._primary(), start)

    def _primary(self) -> Node:
        kind, value, start, _, _ = self.token
        if kind == "num":
            self.advance()
            return Node("Float" if re.search(r"[.]|^\d[\d_]*[eE]|f(32|64)$", value) and not value.startswith("0x") else "Int", value)
        if kind == "str":
            self.advance()
            if value[0] in "bc" and '"' in value[:3]:
                return Node("ByteStr" if value[0] == "b" else "CStr", "")
            return Node("Str", repr(value))
        if kind == "char":
            self.advance()
            return Node("Byte" if value[0] == "b" else "Char", repr(value))
        if kind == "life":
            label = self.advance()[1]
            self.expect(":")
            return Node("Label", label, self.primary())
        if self.at("("):
            self.advance()
            keep, self.no_struct = self.no_struct, False
            items, comma = [], False
            while not self.take(")"):
                self.attributes()
                items.append(self.expression())
                comma = self.take(",")
                if not comma and not self.at(")"):
                    raise ParseError(f"expected ) at {self.token[2]}")
            self.no_struct = keep
            return items[0] if len(items) == 1 and not comma else Node("Tuple", items)
        if self.at("["):
            self.advance()
            keep, self.no_struct = self.no_struct, False
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if self.take(";"):
                    node = Node("Repeat", items[0], self.expression())
                    self.expect("]")
                    self.no_struct = keep
                    return node
                if not self.at("]"):
                    self.expect(",")
            self.no_struct = keep
            return Node("Array", items)
        if self.at("{"):
            return Node("BlockExpr", self.block())
        if self.at("|", "||", "move", "static"):
            return self.closure()
        if self.at("<"):
            self.angle()
            self.expect("::")
            return Node("Path", f"'{self.path_text()}'")
        if kind != "id":
            raise ParseError(f"expected an expression at {start}, got {value!r}")
        if self.take("if"):
            return self.if_()
        if self.take("match"):
            return self.match_()
        if self.take("while"):
            test = self.condition()
            return Node("While", test, self.block())
        if self.take("loop"):
            return Node("Loop", self.block())
        if self.at("for") and self.peek()[1] != "<":
            self.advance()
            target = self.pattern(alternatives=True)
            self.expect("in")
            return Node("For", target, self.condition(), self.block())
        if self.take("unsafe"):
            return Node("Unsafe", self.block())
        if self.at("async", "const", "try") and self.peek()[1] in ("{", "move"):
            word = self.advance()[1]
            self.take("move")
            return Node({"async": "Async", "const": "BlockExpr", "try": "TryBlock"}[word], self.block())
        if self.at("async"):
            self.advance()
            return self.closure()
        if self.at("return", "break", "continue"):
            return self.jump_expression()
        if value in ("true", "false"):
            self.advance()
            return Node("Bool", value)
        return self.path_expression()

    def path_expression(self) -> Node:
        parts = [self.identifier()] if not self.take("::") else ["", self.identifier()]
        while self.at("::"):
            self.advance()
            if self.starts("<"):
                self.angle()
            else:
                parts.append(self.identifier())
        path = "::".join(parts)
        if self.at("!") and self.peek()[1] in ("(", "[", "{"):
            self.advance()
            self.group()
            return Node("Macro", f"'{path}'")
        node = Node("Path", name=path) if len(parts) == 1 else Node("Path", f"'{path}'")
        if self.at("{") and not self.no_struct and path[:1] != "" and (parts[-1][:1].isupper() or len(parts) > 1):
            literal = self.attempt(lambda: self.struct_literal(path))
            if literal is not None:
                return literal
        return node

    def struct_literal(self, path: str) -> Node:
        self.expect("{")
        fields, rest = [], None
        while not self.take("}"):
            self.attributes()
            if self.take(".."):
                rest = None if self.at("}") else self.expression()
                continue
            if self.token[0] not in ("id", "num"):
                raise ParseError("no struct literal")
            name = self.advance()[1]
            value = self.expression() if self.take(":") else Node("Path", name=name)
            fields.append(Node("FieldVal", f"'{name}'", value))
            if not self.at("}"):
                self.expect(",")
        return Node("StructLit", f"'{path}'", fields, rest)

    def condition(self) -> Node:
        keep, self.no_struct = self.no_struct, True
        test = self.let_chain()
        self.no_struct = keep
        return test

    def let_chain(self) -> Node:
        parts = []
        while True:
            if self.take("let"):
                target = self.pattern(alternatives=True)
                self.expect("=")
                parts.append(Node("LetExpr", target, self.binary(2)))
            else:
                parts.append(self.expression() if not parts else self.binary(2))
            if not self.take("&&"):
                break
        out = parts[0]
        for p in parts[1:]:
            out = Node("Bin", "'&&'", out, p)
        return out

    def if_(self) -> Node:
        test = self.condition()
        yes = self.block()
        no = None
        if self.take("else"):
            no = self.if_() if self.take("if") else self.block()
        return Node("If", test, yes, no)

    def match_(self) -> Node:
        keep, self.no_struct = self.no_struct, True
        what = self.expression()
        self.no_struct = False
        self.expect("{")
        arms = []
        while True:
            self.attributes()
            if self.take("}"):
                break
            target = self.pattern(alternatives=True)
            guard = self.let_chain() if self.take("if") else None
            self.expect("=>")
            body = self.expression(statement=self.at("{"))
            arms.append(Node("Arm", target, guard, body))
            if not self.take(",") and not self.at("}") and body.tag not in BLOCK_LIKE:
                raise ParseError(f"expected , at {self.token[2]}")
        self.no_struct = keep
        return Node("Match", what, arms)

    def closure(self) -> Node:
        self.take("static")
        self.take("move")
        params = []
        if not self.take("||"):
            self.expect("|")
            while not self.take("|"):
                target = self.pattern()
                if self.take(":"):
                    self.type_(bounds=False)
                params.append(target)
                if not self.at("|"):
                    self.expect(",")
        if self.take("->"):
            self.type_()
            return Node("Closure", params, Node("BlockExpr", self.block()))
        return Node("Closure", params, self.expression())

    def pattern(self, alternatives: bool = False) -> Node:
        start = self.token[2]
        if alternatives:
            self.take("|")
        first = self.done(self._pattern(), start)
        if not (alternatives and self.at("|")):
            return first
        options = [first]
        while self.take("|"):
            options.append(self._pattern())
        return self.done(Node("PatOr", options), start)

    def _pattern(self) -> Node:
        if self.starts("&"):
            self.split("&")
            self.take("mut")
            return Node("PatRef", self._pattern())
        if self.take("_"):
            return Node("Wild")
        if self.take(".."):
            return Node("Rest")
        if self.at("(", "["):
            close = ")" if self.advance()[1] == "(" else "]"
            items = []
            while not self.take(close):
                items.append(self.pattern(alternatives=True))
                if not self.at(close):
                    self.expect(",")
            return Node("PatTuple" if close == ")" else "PatSlice", items)
        if self.token[0] in ("num", "str", "char") or self.at("-"):
            return self.range_pattern(self.literal())
        by_ref = self.take("ref")
        mutable = self.take("mut")
        if by_ref or mutable:
            return self.binding()
        if self.token[0] == "id" and self.value in ("true", "false"):
            return Node("Bool", self.advance()[1])
        if self.at("box"):
            self.advance()
            return self._pattern()
        if self.at("<"):
            self.angle()
            self.expect("::")
        leading = self.take("::")
        name = self.identifier()
        single = not leading
        path = name
        while self.take("::"):
            single = False
            if self.starts("<"):
                self.angle()
            else:
                path += "::" + self.identifier()
        if self.at("!"):
            self.advance()
            self.group()
            return Node("Macro", f"'{path}'")
        if self.at("("):
            self.advance()
            items = []
            while not self.take(")"):
                items.append(self.pattern(alternatives=True))
                if not self.at(")"):
                    self.expect(",")
            return Node("PatTupleStruct", f"'{path}'", items)
        if self.at("{") and (not single or name[:1].isupper()):
            return self.struct_pattern(path)
        if self.at("..", "..=", "..."):
            return self.range_pattern(Node("PatPath", f"'{path}'"))
        if single and not name[:1].isupper():
            inner = self._pattern() if self.take("@") else None
            return Node("Bind", inner, name=name, binds=True)
        if single and self.take("@"):
            return Node("Bind", self._pattern(), name=name, binds=True)
        return Node("PatPath", f"'{path}'")

    def binding(self) -> Node:
        name = self.identifier()
        inner = self._pattern() if self.take("@") else None
        return Node("Bind", inner, name=name, binds=True)

    def literal(self) -> Node:
        minus = "-" if self.take("-") else ""
        return Node("Lit", repr(minus + self.advance()[1]))

    def range_pattern(self, low: Node) -> Node:
        if not self.take("..=", "..", "..."):
            return low
        ends = self.at("=>", ",", ")", "]", "|", "if", "=")
        high = None if ends else self.literal() if self.token[0] != "id" else Node("PatPath", f"'{self.path_text()}'")
        return Node("PatRange", low, high)

    def struct_pattern(self, path: str) -> Node:
        self.expect("{")
        fields = []
        while not self.take("}"):
            self.attributes()
            if self.take(".."):
                fields.append(Node("Rest"))
            else:
                short = self.at("ref", "mut")
                while self.take("ref", "mut"):
                    pass
                name = self.advance()[1]
                if not short and self.take(":"):
                    fields.append(Node("PatField", f"'{name}'", self.pattern(alternatives=True)))
                else:
                    fields.append(Node("PatField", f"'{name}'", Node("Bind", None, name=name, binds=True)))
            if not self.at("}"):
                self.expect(",")
        return Node("PatStruct", f"'{path}'", fields)


def last_segment(type_text: str) -> str:
    """The name a type's methods go under: the last part of its path, or the whole in angle brackets."""
    plain = re.sub(r"^(?:& )?(?:' \w+ )?(?:mut )?(?:dyn )?", "", type_text)
    head = plain.split(" <", 1)[0]
    if re.fullmatch(r"(?:: : )?\w+(?: : : \w+)*", head):
        return head.split(" : : ")[-1]
    return "<ty>"


ATOMS = {"Int", "Float", "Str", "Bool", "Char", "Byte", "ByteStr", "CStr"}


def is_trivial(body: Node | None) -> bool:
    """Whether a body says nothing: absent, empty, or only atoms, returned atoms and stub macros."""
    return body is None or all(map(_says_nothing, body.fields[0]))


def _is_stub(macro: Node) -> bool:
    return macro.fields[0].strip("'").split("::")[-1] in STUB_MACROS


def _says_nothing(statement: Node) -> bool:
    if statement.tag == "MacroStmt":
        return _is_stub(statement)
    value = statement.fields[0] if statement.tag in ("ExprStmt", "Tail") else None
    if not isinstance(value, Node):
        return False
    if value.tag == "Return":
        value = value.fields[0]
        if value is None or value.tag == "Path":
            return True
    if value.tag == "Macro":
        return _is_stub(value)
    # a path of several parts names something elsewhere
    return value.tag in ATOMS or (value.tag == "Path" and value.name is not None)


def bound_names(func: Node) -> set[str]:
    """Names that parameters and patterns bind; parameters of closures are not among them."""
    names: set[str] = set()

    def visit(node: Node) -> None:
        if node.tag == "Closure":
            visit(node.fields[1])
            return
        if node.binds:
            names.add(node.name)
        for c in node.children():
            visit(c)

    visit(func)
    return names


class RustFrontend:
    """Functions, methods, types, traits, constants and aliases, modules included; nothing inside bodies."""

    lang = "rs"
    extensions = (".rs",)
    kinds = ("constants", "functions", "methods", "classes", "interfaces", "type-aliases")

    def scan(self, path: str, text: str) -> list[Definition]:
        """Definitions in source order, the first of each kind and qualified name; a file that can't be parsed has none."""
        try:
            items = Parser(text).file()
        except (ParseError, RecursionError):
            return []
        scan = _Scan(text)
        scan.items(items, "")
        return scan.out


class _Scan:
    def __init__(self, text: str):
        self.text, self.lines = text, Lines(text)
        self.out: list[Definition] = []
        self.seen: set[tuple[str, str]] = set()

    def items(self, items: list[Node], prefix: str) -> None:
        for x in items:
            if x.tag == "Func" and not is_trivial(x.fields[3]):
                self.callable("functions", prefix + x.name, x)
            elif x.tag == "Mod" and x.fields[0] is not None:
                self.items(x.fields[0], f"{prefix}{x.name}::")
            elif x.tag in ("Struct", "Enum", "Union"):
                self.add("classes", prefix + x.name, x, canonical=written(x))
            elif x.tag == "Trait":
                self.add("interfaces", prefix + x.name, x, canonical=written(x))
                self.methods(x.fields[1], prefix + x.name)
            elif x.tag == "Impl":
                self.methods(x.fields[1], prefix + x.fields[0].strip("'"))
            elif x.tag in ("Const", "Static") and CONSTANT_NAME.match(x.name):
                self.add("constants", prefix + x.name, x)
            elif x.tag == "Type":
                self.add("type-aliases", prefix + x.name, x)

    def methods(self, members: list[Node], owner: str) -> None:
        for m in members:
            if m.tag == "Func" and not is_trivial(m.fields[3]):
                self.callable("methods", f"{owner}::{m.name}", m)

    def add(self, kind: str, name: str, node: Node, args: int = 0, canonical: str | None = None, analysis: Analysis | None = None) -> None:
        if (kind, name) in self.seen:
            return
        self.seen.add((kind, name))
        line, col = self.lines.place(node.start)
        self.out.append(Definition(kind, name, line, col, args, self.text[node.start : node.end], canonical, analysis))

    def callable(self, kind: str, name: str, node: Node) -> None:
        bound = bound_names(node)
        xname = written(node, Renaming(bound, node.name))
        lines = [written(x, Renaming(bound, node.name)) for x in node.fields[3].fields[0]]
        self.add(kind, name, node, len(node.fields[0].fields[0]), written(node), Analysis(xname, lines, size(node)))
