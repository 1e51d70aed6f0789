"""TypeScript definitions, by a recursive-descent parser for the parts of the language that carry code."""

from __future__ import annotations

import re

from .base import Analysis, Definition, Lines
from .tree import Node, ParseError, Reader, Renaming, size, written

SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|\A#![^\n]*)*", re.S)
WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# The punctuators, longest first, and the binary operators by precedence.
PUNCT = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #".split(),
    key=len,
    reverse=True,
)
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
MODIFIERS = {"public", "private", "protected", "static", "abstract", "readonly", "override", "declare", "accessor", "async"}
RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
CONSTANT_NAME = re.compile(r"[A-Z0-9_]+\Z")
THROWN = {"Error", "TypeError", "RangeError", "NotImplementedError"}


class Parser(Reader):
    """Statements and expressions; types are read to their end and kept as normalised text."""

    def __init__(self, text: str, jsx: bool):
        self.jsx = jsx
        self.no_in = False
        super().__init__(text)

    def cut(self, pos: int) -> tuple[str, str, int, int, bool]:
        text = self.text
        start = SPACE.match(text, pos).end()
        line = "\n" in text[pos:start]
        if start >= len(text):
            return "eof", "", start, start, line
        c = text[start]
        if m := WORD.match(text, start):
            return "id", m.group(), start, m.end(), line
        if c.isdigit() or (c == "." and text[start + 1 : start + 2].isdigit()):
            m = NUMBER.match(text, start)
            return "num", m.group(), start, m.end(), line
        if c in "\"'":
            m = STRING.match(text, start)
            if not m:
                raise ParseError(f"open string at {start}")
            return "str", m.group(), start, m.end(), line
        if c == "`":
            return "tpl", "`", start, start + 1, line
        for p in PUNCT:
            if text.startswith(p, start):
                if p == "?." and text[start + 2 : start + 3].isdigit():
                    p = "?"
                return "punct", p, start, start + len(p), line
        raise ParseError(f"unknown character at {start}")

    def done(self, node: Node, start: int) -> Node:
        node.start, node.end = start, self.last_end
        return node

    def semicolon(self) -> None:
        if self.take(";") or self.at("}") or self.token[0] == "eof" or self.token[4]:
            return
        raise ParseError(f"expected ; at {self.token[2]}")

    # ---- types, kept as text

    def type_text(self) -> str:
        start = self.token[2]
        self.type_()
        return " ".join(re.findall(r"\w+|[^\w\s]", self.text[start : self.last_end]))

    def type_(self) -> None:
        if self.at("asserts") and self.peek()[0] == "id" and not self.peek()[4]:
            self.advance()
        self.type_operand()
        while True:
            if self.take("|", "&"):
                self.type_operand()
            elif self.at("is") and not self.token[4]:
                self.advance()
                self.type_()
            elif self.at("extends") and not self.token[4]:
                here = self.mark()
                self.advance()
                self.type_operand()
                while self.take("|", "&"):
                    self.type_operand()
                if not self.take("?"):
                    self.back(here)
                    return
                self.type_()
                self.expect(":")
                self.type_()
            else:
                return

    def type_operand(self) -> None:
        while self.take("|", "&", "keyof", "unique", "readonly", "infer", "abstract"):
            pass
        kind = self.token[0]
        if self.take("-"):
            self.advance()
        elif kind in ("num", "str"):
            self.advance()
        elif kind == "tpl":
            self.template()
        elif self.at("new", "(", "<"):
            self.take("new")
            if self.at("<"):
                self.type_parameters()
            self.balanced("(", ")")
            if self.take("=>"):
                self.type_()
        elif self.at("{"):
            self.balanced("{", "}")
        elif self.at("["):
            self.balanced("[", "]")
        elif self.at("typeof", "import"):
            self.advance()
            if self.at("("):
                self.balanced("(", ")")
            else:
                self.identifier()
            self.type_rest()
        elif kind == "id":
            self.advance()
            self.type_rest()
        else:
            raise ParseError(f"expected a type at {self.token[2]}")
        while self.at("[") and not self.token[4]:
            self.balanced("[", "]")

    def type_rest(self) -> None:
        while True:
            if self.take("."):
                self.identifier()
            elif self.at("<") and not self.token[4]:
                self.type_arguments()
            else:
                return

    def type_arguments(self) -> None:
        self.expect("<")
        while not self.closing():
            self.type_()
            if self.take("="):
                self.type_()
            if not self.take(","):
                if not self.closing():
                    raise ParseError(f"expected > at {self.token[2]}")
        self.close_angle()

    def type_parameters(self) -> None:
        self.expect("<")
        while not self.closing():
            while self.at("const", "in", "out") and self.peek()[0] == "id":
                self.advance()
            self.identifier()
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            if not self.take(",") and not self.closing():
                raise ParseError(f"expected > at {self.token[2]}")
        self.close_angle()

    def closing(self) -> bool:
        return self.token[0] == "punct" and self.token[1].startswith(">")

    def close_angle(self) -> None:
        start = self.token[2]
        self.jump(start + 1)

    def balanced(self, open_: str, close: str) -> None:
        """Skip a bracketed part whatever it holds."""
        self.expect(open_)
        depth = 1
        pairs = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
        while depth:
            if self.token[0] == "eof":
                raise ParseError(f"open {open_}")
            if self.token[0] == "tpl":
                self.template()
                continue
            depth += pairs.get(self.token[1], 0) if self.token[0] == "punct" else 0
            self.advance()

    def annotation(self) -> str | None:
        return self.type_text() if self.take(":") else None

    # ---- statements

    def module(self) -> list[Node]:
        out = []
        while self.token[0] != "eof":
            out.append(self.statement())
        return out

    def block(self) -> Node:
        start = self.token[2]
        self.expect("{")
        body = []
        while not self.at("}"):
            body.append(self.statement())
        self.expect("}")
        return self.done(Node("Block", body), start)

    def statement(self) -> Node:
        self.decorators()
        start = self.token[2]
        return self.done(self._statement(), start)

    def _statement(self) -> Node:
        word = self.value
        after = self.peek() if self.token[0] == "id" else ("", "", 0, 0, False)
        if word == "{":
            return self.block()
        if self.take(";"):
            return Node("Empty")
        if word in ("var", "let", "const") and (after[0] == "id" or after[1] in ("[", "{")):
            if word == "const" and after[1] == "enum":
                self.advance()
                return self.enum()
            node = self.variables()
            self.semicolon()
            return node
        if word == "function" or (word == "async" and after[1] == "function" and not after[4]):
            return self.function()
        if word == "class" or (word == "abstract" and after[1] == "class"):
            self.take("abstract")
            return self.class_()
        simple = {"if": self.if_, "for": self.for_, "while": self.while_, "do": self.do_, "switch": self.switch, "try": self.try_, "import": self.import_, "export": self.export}
        if word in simple and not (word == "import" and after[1] in ("(", ".")):
            return simple[word]()
        if word in ("return", "throw"):
            self.advance()
            value = None
            if not (self.at(";", "}") or self.token[4] or self.token[0] == "eof"):
                value = self.expression()
            self.semicolon()
            return Node(word.capitalize(), value)
        if word in ("break", "continue"):
            self.advance()
            label = self.identifier() if self.token[0] == "id" and not self.token[4] else None
            self.semicolon()
            return Node(word.capitalize(), label)
        if word == "debugger":
            self.advance()
            self.semicolon()
            return Node("Debugger")
        if word == "with":
            self.advance()
            self.expect("(")
            what = self.expression()
            self.expect(")")
            return Node("With", what, self.statement())
        if self.token[0] == "id" and after[0] == "id" and not after[4]:
            if word == "interface":
                return self.interface()
            if word == "type":
                return self.type_alias()
            if word == "enum":
                return self.enum()
            if word in ("namespace", "module") or (word == "declare" and after[1] in ("global", "module", "namespace")):
                return self.namespace()
            if word == "declare":
                self.advance()
                return self.statement()
        if word == "module" and after[0] == "str" or (word == "declare" and after[1] == "module"):
            return self.namespace()
        if self.token[0] == "id" and after[1] == ":" and word not in RESERVED:
            label = self.identifier()
            self.advance()
            return Node("Label", f"'{label}'", self.statement())
        value = self.expression()
        self.semicolon()
        return Node("Expr", value)

    def decorators(self) -> None:
        while self.take("@"):
            self.unary_tail(self.primary())

    def variables(self) -> Node:
        start = self.token[2]
        how = self.advance()[1]
        items = []
        while True:
            at = self.token[2]
            target = self.pattern()
            self.take("!")
            self.annotation()
            value = self.assignment() if self.take("=") else None
            items.append(self.done(Node("Decl", target, value), at))
            if not self.take(","):
                return self.done(Node("Var", f"'{how}'", items), start)

    def pattern(self) -> Node:
        start = self.token[2]
        if self.take("["):
            parts: list = []
            while not self.take("]"):
                if self.at(","):
                    parts.append("<hole>")
                else:
                    parts.append(self.pattern_default())
                if not self.at("]"):
                    self.expect(",")
            node = Node("BindArr", parts)
        elif self.take("{"):
            parts = []
            while not self.take("}"):
                parts.append(self.pattern_property())
                if not self.at("}"):
                    self.expect(",")
            node = Node("BindObj", parts)
        elif self.take("..."):
            node = Node("Rest", self.pattern())
        else:
            if self.value in RESERVED and self.value != "this":
                raise ParseError(f"reserved word at {start}")
            node = Node("Bind", name=self.identifier(), binds=True)
        return self.done(node, start)

    def pattern_default(self) -> Node:
        target = self.pattern()
        return Node("BindDefault", target, self.assignment()) if self.take("=") else target

    def pattern_property(self) -> Node:
        if self.take("..."):
            return Node("Rest", self.pattern())
        key, short = self.property_key()
        if self.take(":"):
            return Node("BindProp", key, self.pattern_default())
        if short is None:
            raise ParseError(f"bad pattern at {self.token[2]}")
        target = Node("Bind", name=short, binds=True)
        return Node("BindProp", key, Node("BindDefault", target, self.assignment()) if self.take("=") else target)

    def property_key(self) -> tuple[Node | str, str | None]:
        """A key, and its name where it can stand alone."""
        kind = self.token[0]
        if self.take("["):
            key = self.assignment()
            self.expect("]")
            return Node("ComputedKey", key), None
        if self.take("#"):
            return f"'#{self.identifier()}'", None
        if kind == "id":
            name = self.advance()[1]
            return f"'{name}'", name
        if kind in ("str", "num"):
            return f"'{self.advance()[1].strip(chr(34) + chr(39))}'", None
        raise ParseError(f"expected a key at {self.token[2]}")

    def parameters(self) -> Node:
        start = self.token[2]
        self.expect("(")
        items = []
        while not self.take(")"):
            self.decorators()
            while self.at("public", "private", "protected", "readonly", "override") and self.peek()[0] == "id":
                self.advance()
            is_this = self.at("this")
            target = self.pattern()
            self.take("?")
            self.annotation()
            value = self.assignment() if self.take("=") else None
            if not is_this:
                items.append(target if target.tag == "Rest" else Node("Param", target, value))
            if not self.at(")"):
                self.expect(",")
        return self.done(Node("Params", items), start)

    def function_rest(self, name: str | None, is_async: bool, is_generator: bool) -> Node:
        if self.at("<"):
            self.type_parameters()
        params = self.parameters()
        self.annotation()
        body = self.block() if self.at("{") else None
        return Node("Func", params, body, f"async={str(is_async).lower()} gen={str(is_generator).lower()}", name=name or "")

    def function(self) -> Node:
        is_async = self.take("async")
        self.expect("function")
        star = self.take("*")
        name = self.identifier() if self.token[0] == "id" else None
        node = self.function_rest(name, is_async, star)
        if node.fields[1] is None:
            self.semicolon()
        return node

    def class_(self) -> Node:
        self.expect("class")
        name = self.identifier() if self.token[0] == "id" and not self.at("extends", "implements") else ""
        if self.at("<"):
            self.type_parameters()
        base = None
        if self.take("extends"):
            base = self.unary_tail(self.primary())
            if self.at("<"):
                self.type_arguments()
        if self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.expect("{")
        members = []
        while not self.take("}"):
            if not self.take(";"):
                members.append(self.class_member())
        return Node("Class", base, members, name=name)

    def class_member(self) -> Node:
        self.decorators()
        start = self.token[2]
        words = set()
        while self.value in MODIFIERS and self.peek()[1] not in ("(", "=", ";", ":", "?", "!", "}", ",", "<"):
            if self.value == "static" and self.peek()[1] == "{":
                self.advance()
                return self.done(Node("StaticBlock", self.block()), start)
            words.add(self.advance()[1])
        star = self.take("*")
        how = "method"
        if self.at("get", "set") and self.peek()[1] not in ("(", "=", ";", ":", "?", "!", "}", ",", "<"):
            how = self.advance()[1]
        static = "static" if "static" in words else ""
        if self.at("["):
            index = self.attempt(self.index_signature)
            if index is not None:
                return self.done(index, start)
        key, _ = self.property_key()
        if key == "'constructor'":
            how = "ctor"
        self.take("?", "!")
        if self.at("(", "<"):
            node = Node("Method", key, f"'{how}'", f"'{static}'", self.function_rest(None, "async" in words, star))
            if node.fields[3].fields[1] is None:
                self.semicolon()
            return self.done(node, start)
        self.annotation()
        value = self.assignment() if self.take("=") else None
        self.semicolon()
        return self.done(Node("Prop", key, f"'{static}'", value), start)

    def index_signature(self) -> Node:
        self.expect("[")
        self.identifier()
        self.expect(":")
        self.type_()
        self.expect("]")
        node = Node("TSIndexSig", self.annotation())
        self.semicolon()
        return node

    def interface(self) -> Node:
        self.expect("interface")
        name = self.identifier()
        if self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.type_()
            while self.take(","):
                self.type_()
        self.expect("{")
        members = []
        while not self.take("}"):
            if not self.take(";", ","):
                members.append(self.interface_member())
        return Node("TSInterface", members, name=name)

    def interface_member(self) -> Node:
        if self.at("(", "<"):
            self.signature()
            return Node("TSCall")
        if self.at("new") and self.peek()[1] in ("(", "<"):
            self.advance()
            self.signature()
            return Node("TSCtor")
        if self.at("["):
            index = self.attempt(self.index_signature)
            if index is not None:
                return Node("TSIndex", index.fields[0])
        while self.at("readonly", "get", "set") and self.peek()[1] not in ("(", ":", "?", ";", ",", "}", "<"):
            self.advance()
        key, _ = self.property_key()
        self.take("?")
        if self.at("(", "<"):
            self.signature()
            return Node("TSMethod", key)
        return Node("TSProp", key, self.annotation())

    def signature(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.balanced("(", ")")
        self.annotation()

    def type_alias(self) -> Node:
        self.expect("type")
        name = self.identifier()
        if self.at("<"):
            self.type_parameters()
        self.expect("=")
        node = Node("TSTypeAlias", self.type_text(), name=name)
        self.semicolon()
        return node

    def enum(self) -> Node:
        self.expect("enum")
        name = self.identifier()
        self.balanced("{", "}")
        return Node("TSEnum", f"'{name}'")

    def namespace(self) -> Node:
        while not self.at("{", ";") and self.token[0] != "eof":
            self.advance()
        if self.at("{"):
            self.block()
        else:
            self.semicolon()
        return Node("TSModule")

    def if_(self) -> Node:
        self.expect("if")
        self.expect("(")
        test = self.expression()
        self.expect(")")
        yes = self.statement()
        return Node("If", test, yes, self.statement() if self.take("else") else None)

    def for_(self) -> Node:
        self.expect("for")
        waits = self.take("await")
        self.expect("(")
        start = None
        self.no_in = True
        if self.at("var", "let", "const"):
            start = self.variables()
        elif not self.at(";"):
            start = self.expression()
        self.no_in = False
        if self.at("of", "in"):
            how = self.advance()[1]
            over = self.expression()
            self.expect(")")
            tag = "ForIn" if how == "in" else "ForAwaitOf" if waits else "ForOf"
            return Node(tag, start, over, self.statement())
        self.expect(";")
        test = None if self.at(";") else self.expression()
        self.expect(";")
        update = None if self.at(")") else self.expression()
        self.expect(")")
        return Node("For", start, test, update, self.statement())

    def while_(self) -> Node:
        self.expect("while")
        self.expect("(")
        test = self.expression()
        self.expect(")")
        return Node("While", test, self.statement())

    def do_(self) -> Node:
        self.expect("do")
        body = self.statement()
        self.expect("while")
        self.expect("(")
        test = self.expression()
        self.expect(")")
        self.take(";")
        return Node("DoWhile", body, test)

    def switch(self) -> Node:
        self.expect("switch")
        self.expect("(")
        what = self.expression()
        self.expect(")")
        self.expect("{")
        cases = []
        while not self.take("}"):
            test = None
            if not self.take("default"):
                self.expect("case")
                test = self.expression()
            self.expect(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            cases.append(Node("Case", test, Node("Block", body)))
        return Node("Switch", what, cases)

    def try_(self) -> Node:
        self.expect("try")
        body = self.block()
        caught = None
        if self.take("catch"):
            target = None
            if self.take("("):
                target = self.pattern()
                self.annotation()
                self.expect(")")
            caught = Node("Catch", target, self.block())
        return Node("Try", body, caught, self.block() if self.take("finally") else None)

    def import_(self) -> Node:
        self.expect("import")
        names = []
        equals = False
        while not (self.at(";") or self.token[0] == "eof"):
            if self.token[4] and self.text[self.last_end - 1] in "'\"})":
                break
            if self.take("="):
                equals = True
                self.expression()
                break
            if self.token[0] == "id" and self.value not in ("from", "type", "as", "with", "assert"):
                names.append(Node("Bind", name=self.value, binds=True))
            self.advance()
        self.take(";")
        return Node("TSImportEquals" if equals else "Import", names)

    def export(self) -> Node:
        self.expect("export")
        if self.take("default"):
            if self.at("function", "async", "class", "abstract", "interface"):
                return Node("ExportDefault", self.statement())
            value = self.assignment()
            self.semicolon()
            return Node("ExportDefault", value)
        if self.take("="):
            value = self.expression()
            self.semicolon()
            return Node("TSExportAssign", value)
        if self.take("*"):
            while self.token[0] != "str":
                self.advance()
            self.advance()
            self.semicolon()
            return Node("ExportAll")
        here = self.mark()
        if self.take("type") and not self.at("{", "*"):
            self.back(here)
        if self.at("{", "*"):
            if not self.take("*"):
                self.balanced("{", "}")
            if self.take("from"):
                self.advance()
            self.semicolon()
            return Node("ExportNamed", None)
        self.decorators()
        return Node("ExportNamed", self.statement())

    # ---- expressions

    def expression(self) -> Node:
        first = self.assignment()
        if not self.at(","):
            return first
        items = [first]
        while self.take(","):
            items.append(self.assignment())
        return Node("Seq", items)

    def assignment(self) -> Node:
        start = self.token[2]
        arrow = self.arrow()
        if arrow is not None:
            return self.done(arrow, start)
        if self.at("yield"):
            self.advance()
            star = "*" if self.take("*") else ""
            empty = self.at(")", "]", "}", ",", ";", ":") or self.token[4] or self.token[0] == "eof"
            return self.done(Node("Yield", f"'{star}'", None if empty else self.assignment()), start)
        left = self.binary(0)
        if self.take("?"):
            keep, self.no_in = self.no_in, False
            yes = self.assignment()
            self.no_in = keep
            self.expect(":")
            return self.done(Node("Cond", left, yes, self.assignment()), start)
        if self.value in ASSIGN and self.token[0] == "punct":
            op = self.advance()[1]
            return self.done(Node("Assign", f"'{op}'", as_target(left), self.assignment()), start)
        return left

    def arrow(self) -> Node | None:
        if not (self.at("(", "<", "async") or (self.token[0] == "id" and self.peek()[1] == "=>")):
            return None
        return self.attempt(self._arrow)

    def _arrow(self) -> Node:
        is_async = False
        if self.at("async") and not self.peek()[4] and (self.peek()[1] in ("(", "<") or self.peek()[0] == "id"):
            self.advance()
            is_async = True
        if self.token[0] == "id":
            params = Node("Params", [Node("Param", Node("Bind", name=self.identifier(), binds=True), None)])
        else:
            if self.at("<"):
                self.type_parameters()
            params = self.parameters()
            self.annotation()
        if self.token[4]:
            raise ParseError("line break before =>")
        self.expect("=>")
        keep, self.no_in = self.no_in, False
        if self.at("{"):
            body, expression = self.block(), False
        else:
            body, expression = Node("Block", [Node("Expr", self.assignment())]), True
        self.no_in = keep
        return Node("Arrow", params, body, f"async={str(is_async).lower()} gen=false expr={str(expression).lower()}")

    def binary(self, least: int) -> Node:
        start = self.token[2]
        left = self.unary()
        while True:
            op = self.value
            rank = BINARY.get(op, 0)
            if not rank or rank <= least and not (op == "**" and rank == least) or (op == "in" and self.no_in):
                return left
            if op in ("as", "satisfies"):
                if self.token[4]:
                    return left
                self.advance()
                self.take("const") or self.type_()
                left = self.done(Node("TSAs" if op == "as" else "TSSat", left), start)
                continue
            self.advance()
            right = self.binary(rank - 1 if op == "**" else rank)
            tag = "Logic" if op in ("&&", "||", "??") else "Bin"
            left = self.done(Node(tag, f"'{op}'", left, right), start)

    def unary(self) -> Node:
        start = self.token[2]
        if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
            op = self.advance()[1]
            return self.done(Node("Unary", f"'{op}'", self.unary()), start)
        if self.at("++", "--"):
            op = self.advance()[1]
            return self.done(Node("Update", f"'{op}'", "'pre'", self.unary()), start)
        if self.at("await") and self.peek()[1] not in (")", ",", ";", "=", ".", "]", "}", "=>", ":"):
            self.advance()
            return self.done(Node("Await", self.unary()), start)
        if self.at("<") and not self.jsx:
            cast = self.attempt(self.type_assertion)
            if cast is not None:
                return self.done(cast, start)
        value = self.unary_tail(self.primary())
        if self.at("++", "--") and not self.token[4]:
            op = self.advance()[1]
            return self.done(Node("Update", f"'{op}'", "'post'", value), start)
        return value

    def type_assertion(self) -> Node:
        self.expect("<")
        self.type_()
        if not self.closing():
            raise ParseError("no type assertion")
        self.close_angle()
        return Node("TSAssert", self.unary())

    def arguments(self) -> list[Node]:
        self.expect("(")
        keep, self.no_in = self.no_in, False
        out = []
        while not self.take(")"):
            out.append(Node("Spread", self.assignment()) if self.take("...") else self.assignment())
            if not self.at(")"):
                self.expect(",")
        self.no_in = keep
        return out

    def unary_tail(self, value: Node, calls: bool = True) -> Node:
        start = value.start
        chained = False
        while True:
            if self.take("?."):
                chained = True
                if self.at("("):
                    value = Node("Call", value, "'opt'", self.arguments())
                elif self.take("["):
                    value = Node("CMember", value, self.expression())
                    self.expect("]")
                else:
                    value = self.member(value)
            elif self.take("."):
                value = self.member(value)
            elif self.at("["):
                self.advance()
                keep, self.no_in = self.no_in, False
                value = Node("CMember", value, self.expression())
                self.no_in = keep
                self.expect("]")
            elif self.at("(") and calls:
                value = Node("Call", value, "''", self.arguments())
            elif self.token[0] == "tpl":
                value = Node("TaggedTpl", value, self.template())
            elif self.at("!") and not self.token[4]:
                self.advance()
                value = Node("TSNonNull", value)
            elif self.at("<") and calls and self.attempt(self.call_types):
                continue
            else:
                return Node("Chain", value) if chained else value
            value.start, value.end = start, self.last_end

    def call_types(self) -> bool:
        self.type_arguments()
        if not (self.at("(", ")", ",", ";", "]", ":", ".") or self.token[0] == "tpl"):
            raise ParseError("no type arguments")
        return True

    def member(self, value: Node) -> Node:
        if self.take("#"):
            return Node("PrivateMember", value, f"'{self.identifier()}'")
        return Node("Member", value, f"'{self.identifier()}'")

    def primary(self) -> Node:
        start = self.token[2]
        return self.done(self._primary(), start)

    def _primary(self) -> Node:
        kind, value, start, _, _ = self.token
        if kind == "num":
            self.advance()
            return Node("BigInt" if value.endswith("n") and not value.startswith("0x") else "Num", number_text(value))
        if kind == "str":
            self.advance()
            return Node("Str", repr(value[1:-1]))
        if kind == "tpl":
            return self.template()
        if kind == "punct" and value in ("/", "/="):
            m = REGEX.match(self.text, start)
            if not m:
                raise ParseError(f"open regular expression at {start}")
            self.jump(m.end())
            return Node("Regex", repr(m.group()))
        if self.take("("):
            keep, self.no_in = self.no_in, False
            inner = self.expression()
            self.no_in = keep
            self.expect(")")
            return inner
        if self.take("["):
            items: list = []
            while not self.take("]"):
                if self.at(","):
                    items.append("<hole>")
                else:
                    items.append(Node("Spread", self.assignment()) if self.take("...") else self.assignment())
                if not self.at("]"):
                    self.expect(",")
            return Node("Arr", items)
        if self.at("{"):
            return self.object()
        if self.at("<") and self.jsx:
            return self.element()
        if self.at("#"):
            self.advance()
            name = self.identifier()
            self.expect("in")
            return Node("PrivateIn", f"'{name}'", self.unary())
        if self.at("@"):
            self.decorators()
            return self.class_()
        if kind != "id":
            raise ParseError(f"expected an expression at {start}, got {value!r}")
        if value == "function" or (value == "async" and self.peek()[1] == "function" and not self.peek()[4]):
            return self.function_expression()
        if value == "class":
            return self.class_()
        if value == "new":
            return self.new()
        if value == "import":
            self.advance()
            if self.take("."):
                return Node("Meta", f"'import.{self.identifier()}'")
            return Node("ImportExpr", self.arguments())
        self.advance()
        plain = {"this": Node("This"), "super": Node("Super"), "null": Node("Null"), "true": Node("Bool", "true"), "false": Node("Bool", "false")}
        if value in plain:
            return plain[value]
        if value in RESERVED:
            raise ParseError(f"reserved word {value} at {start}")
        return Node("Id", name=value)

    def function_expression(self) -> Node:
        is_async = self.take("async")
        self.expect("function")
        star = self.take("*")
        name = self.identifier() if self.token[0] == "id" else None
        return self.function_rest(name, is_async, star)

    def new(self) -> Node:
        self.expect("new")
        if self.take("."):
            return Node("Meta", f"'new.{self.identifier()}'")
        what = self.unary_tail(self.new() if self.at("new") else self.primary(), calls=False)
        if self.at("<"):
            self.attempt(self.type_arguments)
        return Node("New", what, self.arguments() if self.at("(") else [])

    def object(self) -> Node:
        self.expect("{")
        keep, self.no_in = self.no_in, False
        items = []
        while not self.take("}"):
            items.append(self.object_member())
            if not self.at("}"):
                self.expect(",")
        self.no_in = keep
        return Node("Obj", items)

    def object_member(self) -> Node:
        if self.take("..."):
            return Node("Spread", self.assignment())
        ends = ("(", ",", ":", "}", "=", "<")
        is_async = self.at("async") and self.peek()[1] not in ends and self.take("async")
        star = self.take("*")
        how = self.advance()[1] if self.at("get", "set") and self.peek()[1] not in ends else "init"
        key, short = self.property_key()
        if self.at("(", "<"):
            return Node("ObjProp", key, self.function_rest(None, bool(is_async), star), f"'{how}'")
        if self.take(":"):
            return Node("ObjProp", key, self.assignment(), "'init'")
        if short is None or short in RESERVED:
            raise ParseError(f"bad property at {self.token[2]}")
        value = Node("Id", name=short)
        if self.take("="):
            value = Node("Default", value, self.assignment())
        return Node("ObjProp", key, value, "'init'")

    def template(self) -> Node:
        text, pos = self.text, self.token[3]
        parts: list = []
        piece = pos
        while True:
            if pos >= len(text):
                raise ParseError("open template")
            c = text[pos]
            if c == "\\":
                pos += 2
            elif c == "`":
                parts.append(repr(text[piece:pos]))
                self.jump(pos + 1)
                return Node("Tpl", parts)
            elif text.startswith("${", pos):
                parts.append(repr(text[piece:pos]))
                self.jump(pos + 2)
                keep, self.no_in = self.no_in, False
                parts.append(self.expression())
                self.no_in = keep
                if not self.at("}"):
                    raise ParseError(f"open template part at {pos}")
                pos = piece = self.token[3]
            else:
                pos += 1

    def element(self) -> Node:
        """A JSX element; only its tag is kept."""
        self.expect("<")
        if self.take(">"):
            tag, empty = "", False
        else:
            tag = self.jsx_name()
            if self.at("<"):
                self.type_arguments()
            while not self.at(">", "/"):
                if self.take("{"):
                    self.take("...")
                    self.assignment()
                    self.expect("}")
                    continue
                self.jsx_name()
                if self.take("="):
                    if self.at("{"):
                        self.advance()
                        self.expression()
                        self.expect("}")
                    elif self.token[0] == "str":
                        self.advance()
                    else:
                        self.element()
            empty = self.take("/")
            if not self.at(">"):
                raise ParseError(f"open tag at {self.token[2]}")
        if empty:
            self.advance()
            return Node("JSX", f"'{tag}'")
        self.children(self.token[3] if self.at(">") else self.last_end)
        return Node("JSX", f"'{tag}'") if tag else Node("JSXFragment")

    def jsx_name(self) -> str:
        start = self.token[2]
        m = re.compile(r"[\w$.:-]+").match(self.text, start)
        if not m:
            raise ParseError(f"expected a tag name at {start}")
        self.jump(m.end())
        return m.group()

    def children(self, pos: int) -> None:
        text = self.text
        while True:
            while pos < len(text) and text[pos] not in "<{":
                pos += 1
            if pos >= len(text):
                raise ParseError("open element")
            if text[pos] == "{":
                self.jump(pos + 1)
                if not self.at("}"):
                    self.take("...")
                    self.expression()
                if not self.at("}"):
                    raise ParseError(f"open braces at {pos}")
                pos = self.token[3]
                continue
            self.jump(pos)
            if self.peek()[1] == "/":
                self.advance()
                self.advance()
                if not self.at(">"):
                    self.jsx_name()
                self.expect(">")
                return
            self.element_inside()
            pos = self.last_end

    def element_inside(self) -> None:
        self.element()


def as_target(node: Node) -> Node:
    """An expression read as the left side of an assignment."""
    if node.tag == "Arr":
        return Node("ArrTarget", [as_target(x) if isinstance(x, Node) else x for x in node.fields[0]])
    if node.tag == "Obj":
        return Node("ObjTarget", [Node("TargetProp", *x.fields) if x.tag == "ObjProp" else x for x in node.fields[0]])
    return node


def number_text(value: str) -> str:
    try:
        plain = value.replace("_", "").rstrip("n")
        number = int(plain, 0) if plain[:2].lower() in ("0x", "0b", "0o") else float(plain)
    except ValueError:
        return value
    return str(int(number)) if number == int(number) and abs(number) < 1e21 else repr(number)


def count_parameters(func: Node) -> int:
    return len(func.fields[0].fields[0])


ATOMS = {"Num", "Str", "Bool", "Null", "BigInt", "Regex", "Id", "This"}


def is_trivial(body: Node | None) -> bool:
    """Whether a body says nothing: absent, empty, or only empty statements, returned atoms and new plain errors thrown."""
    return body is None or all(map(_says_nothing, body.fields[0]))


def _says_nothing(statement: Node) -> bool:
    value = statement.fields[0] if statement.fields else None
    if statement.tag == "Return":
        return value is None or value.tag in ATOMS
    if statement.tag == "Throw" and value is not None and value.tag == "New":
        return value.fields[0].tag == "Id" and value.fields[0].name in THROWN
    return statement.tag == "Empty"


def bound_names(func: Node) -> set[str]:
    """Parameters and every name declared inside; parameters of inner arrows and functions are not."""
    names: set[str] = set()

    def visit(node: Node, inner: bool) -> None:
        if inner and node.tag == "Params":
            return
        if node.binds:
            names.add(node.name)
        for c in node.children():
            visit(c, inner or node.tag in ("Func", "Arrow") and node is not func)

    for c in func.children():
        visit(c, c.tag in ("Func", "Arrow"))
    return names


class TypeScriptFrontend:
    """Functions, constant arrows, classes, methods, interfaces, type aliases and constants of a module."""

    lang = "ts"
    extensions = (".ts", ".tsx", ".mts", ".cts")
    kinds = ("constants", "functions", "methods", "classes", "interfaces", "type-aliases")

    def scan(self, path: str, text: str) -> list[Definition]:
        """Definitions in source order; a file that can't be parsed has none."""
        try:
            nodes = Parser(text, path.endswith(".tsx")).module()
        except (ParseError, RecursionError):
            return []
        scan = _Scan(text)
        for node in nodes:
            scan.top(node)
        return scan.out


class _Scan:
    def __init__(self, text: str):
        self.text, self.lines = text, Lines(text)
        self.out: list[Definition] = []

    def top(self, node: Node) -> None:
        if node.tag in ("ExportNamed", "ExportDefault"):
            if isinstance(node.fields[0], Node):
                self.top(node.fields[0])
        elif node.tag == "Func":
            if node.name and not is_trivial(node.fields[1]):
                self.callable(node, node.name, node)
        elif node.tag == "Var":
            self.variables(node)
        elif node.tag == "Class" and node.name:
            self.add("classes", node.name, node, canonical=self.form(node))
            self.methods(node)
        elif node.tag == "TSInterface":
            self.add("interfaces", node.name, node, canonical=self.form(node))
        elif node.tag == "TSTypeAlias":
            self.add("type-aliases", node.name, node)

    def add(self, kind: str, name: str, node: Node, args: int = 0, canonical: str | None = None, analysis: Analysis | None = None) -> None:
        line, col = self.lines.place(node.start)
        self.out.append(Definition(kind, name, line, col, args, self.text[node.start : node.end], canonical, analysis))

    def form(self, node: Node) -> str:
        """The canonical of a node, or its text if it holds JSX."""
        if any(x.tag.startswith("JSX") for x in node.walk()):
            return self.text[node.start : node.end]
        return written(node)

    def callable(self, node: Node, name: str, func: Node, own_name: bool = True) -> None:
        args = count_parameters(func)
        canonical = self.form(node)
        if any(x.tag.startswith("JSX") for x in node.walk()):
            self.add("functions", name, node, args, canonical)
            return
        bound = bound_names(func)
        xname = written(node, Renaming(bound, name if own_name else None))
        rename = Renaming(bound, name if own_name else None)
        written(func.fields[0], rename)
        lines = [written(x, rename) for x in func.fields[1].fields[0]]
        self.add("functions", name, node, args, canonical, Analysis(xname, lines, size(node)))

    def variables(self, node: Node) -> None:
        for decl in node.fields[1]:
            target, value = decl.fields
            if target.tag != "Bind":
                continue
            if isinstance(value, Node) and value.tag in ("Arrow", "Func"):
                short = value.tag == "Arrow" and value.fields[2].endswith("expr=true")
                if short or not is_trivial(value.fields[1]):
                    self.callable(node, target.name, value, own_name=False)
            elif node.fields[0] == "'const'" and CONSTANT_NAME.match(target.name):
                self.add("constants", target.name, decl)

    def methods(self, owner: Node) -> None:
        for m in owner.fields[1]:
            if m.tag != "Method" or is_trivial(m.fields[3].fields[1]):
                continue
            key = m.fields[0].strip("'") if isinstance(m.fields[0], str) else "<computed>"
            role = {"'get'": ".getter", "'set'": ".setter"}.get(m.fields[1], "")
            text = self.text[m.start : m.end]
            self.add("methods", f"{owner.name}.{key}{role}", m, count_parameters(m.fields[3]), text)
