"""Python definitions, by way of CPython's own ``ast``."""

from __future__ import annotations

import ast
import copy
import re
import warnings

from .base import Analysis, Definition

CONSTANT_NAME = re.compile(r"[A-Z0-9_]+\Z")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_DEFS, ast.ClassDef)


class PythonFrontend:
    """Functions, classes, methods, constants and type aliases of a module; nothing inside functions."""

    lang = "py"
    extensions = (".py",)
    kinds = ("constants", "functions", "methods", "classes", "type-aliases")

    def scan(self, path: str, text: str) -> list[Definition]:
        """Definitions in source order; a file that can't be parsed has none."""
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        source = _Source(text)
        out: list[Definition] = []
        for node in tree.body:
            if isinstance(node, _DEFS):
                if not is_trivial(node.body):
                    out.append(_callable(source, node, "functions", node.name, strip=False))
            elif isinstance(node, ast.ClassDef):
                out.append(_class(source, node))
                out += _methods(source, node, node.name)
            elif isinstance(node, ast.TypeAlias):
                out.append(source.raw("type-aliases", node.name.id, node))
            elif name := constant_name(node):
                out.append(source.raw("constants", name, node))
        return out


class _Source:
    """A text with places as ``ast`` gives them: lines from 1, columns in UTF-8 bytes."""

    def __init__(self, text: str):
        self.lines = ast._splitlines_no_ff(text)

    def segment(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        start, end = self.char(first, node.col_offset), self.char(last, node.end_col_offset)
        if first == last:
            return self.lines[first][start:end]
        return "".join([self.lines[first][start:], *self.lines[first + 1 : last], self.lines[last][:end]])

    def char(self, line: int, byte: int) -> int:
        text = self.lines[line]
        return byte if text.isascii() else len(text.encode()[:byte].decode())

    def raw(self, kind: str, name: str, node: ast.stmt) -> Definition:
        line = node.lineno - 1
        return Definition(kind, name, line, self.char(line, node.col_offset), 0, self.segment(node))


def constant_name(node: ast.stmt) -> str | None:
    """The name of a top-level assignment to one upper-case name."""
    if isinstance(node, ast.Assign) and len(node.targets) == 1:
        target = node.targets[0]
    elif isinstance(node, ast.AnnAssign):
        target = node.target
    else:
        return None
    return target.id if isinstance(target, ast.Name) and CONSTANT_NAME.match(target.id) else None


def is_trivial(body: list[ast.stmt]) -> bool:
    """Whether every statement says nothing: pass, ``...``, a string, a returned atom, or not implemented."""
    return all(map(_says_nothing, body))


def _says_nothing(node: ast.stmt) -> bool:
    if isinstance(node, ast.Pass):
        return True
    if isinstance(node, ast.Expr):
        return isinstance(node.value, ast.Constant) and (node.value.value is ... or isinstance(node.value.value, str))
    if isinstance(node, ast.Raise):
        what = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        return isinstance(what, ast.Name) and what.id == "NotImplementedError"
    return isinstance(node, ast.Return) and (node.value is None or isinstance(node.value, (ast.Constant, ast.Name)))


def _role(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    for d in node.decorator_list:
        if isinstance(d, ast.Attribute) and d.attr in ("setter", "deleter", "getter"):
            return "." + d.attr
    return ""


def _methods(source: _Source, owner: ast.ClassDef, path: str) -> list[Definition]:
    out: list[Definition] = []
    for node in owner.body:
        if isinstance(node, _DEFS):
            if not is_trivial(node.body):
                out.append(_callable(source, node, "methods", f"{path}.{node.name}{_role(node)}", strip=True))
        elif isinstance(node, ast.ClassDef):
            out += _methods(source, node, f"{path}.{node.name}")
    return out


def _class(source: _Source, node: ast.ClassDef) -> Definition:
    d = source.raw("classes", node.name, node)
    return Definition(d.kind_id, d.name, d.line, d.col, 0, d.text, dumped(node))


def count_parameters(args: ast.arguments) -> int:
    plain = len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs)
    return plain + (args.vararg is not None) + (args.kwarg is not None)


def _callable(source: _Source, node, kind: str, name: str, strip: bool) -> Definition:
    raw = source.raw(kind, name, node)
    try:
        plain = _plain(without_receiver(node) if strip else node)
        canonical, analysis = ast.dump(plain, annotate_fields=False), analysed(plain)
    except (RecursionError, ValueError):
        canonical, analysis = raw.text, None
    return Definition(kind, name, raw.line, raw.col, count_parameters(node.args), raw.text, canonical, analysis)


def without_receiver(node):
    """The method without a leading ``self`` or ``cls``; a receiver that is the only positional-only one stays."""
    a = node.args
    if a.posonlyargs:
        at = "posonlyargs" if len(a.posonlyargs) > 1 else None
    else:
        at = "args" if a.args else None
    if at is None or getattr(a, at)[0].arg not in ("self", "cls"):
        return node
    out = copy.copy(node)
    out.args = copy.copy(a)
    setattr(out.args, at, getattr(a, at)[1:])
    before = len(a.posonlyargs) + len(a.args)
    if len(a.defaults) == before:
        out.args.defaults = a.defaults[1:]
    return out


def _copied(node: ast.AST) -> ast.AST:
    """A copy without docstrings and string prefixes; a body left empty passes."""
    fields = {}
    for name, value in node.__dict__.items():
        if isinstance(value, ast.AST):
            fields[name] = _copied(value)
        elif isinstance(value, list):
            fields[name] = [_copied(x) if isinstance(x, ast.AST) else x for x in value]
        else:
            fields[name] = value
    if isinstance(node, _SCOPES) and node.body and _is_docstring(node.body[0]):
        fields["body"] = fields["body"][1:] or [ast.Pass(lineno=node.lineno, col_offset=0)]
    if isinstance(node, ast.Constant):
        fields["kind"] = None
    out = node.__class__.__new__(node.__class__)
    out.__dict__.update(fields)
    return out


def _is_docstring(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def _plain(node: ast.AST) -> ast.AST:
    out = _copied(node)
    out.decorator_list = []
    return out


def dumped(node: ast.AST) -> str:
    """Structural form: the dump without field names, docstrings and the outermost decorators."""
    return ast.dump(_plain(node), annotate_fields=False)


class _Bound(ast.NodeVisitor):
    """Names that a function binds."""

    def __init__(self, top: ast.AST):
        self.names: set[str] = set()
        a = top.args
        for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg):
            if p is not None:
                self.names.add(p.arg)
        for node in top.body:
            self.visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Store):
            self.names.add(node.id)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.name:
            self.names.add(node.name)
        self.generic_visit(node)

    def visit_alias(self, node: ast.alias) -> None:
        self.names.add(node.asname or node.name.split(".")[0])

    def visit_Lambda(self, node: ast.Lambda) -> None:
        for p in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
            self.names.add(p.arg)
        self.generic_visit(node)


class _Renamed(ast.NodeTransformer):
    """Bound names numbered by their first appearance in field order."""

    def __init__(self, bound: set[str]):
        self.bound = bound
        self.seen: dict[str, str] = {}

    def _new(self, name: str) -> str:
        if name not in self.bound:
            return name
        return self.seen.setdefault(name, f"_v{len(self.seen)}")

    def visit_Name(self, node: ast.Name) -> ast.Name:
        node.id = self._new(node.id)
        return node

    def visit_arg(self, node: ast.arg) -> ast.arg:
        node.arg = self._new(node.arg)
        self.generic_visit(node)
        return node

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> ast.ExceptHandler:
        if node.type is not None:
            node.type = self.visit(node.type)
        if node.name:
            node.name = self._new(node.name)
        node.body = [self.visit(x) for x in node.body]
        return node


def analysed(plain) -> Analysis:
    """The callable under neutral names, which its tree takes on: its dump, its lines, and its number of nodes."""
    renamed = _Renamed(_Bound(plain).names).visit(plain)
    renamed.name = "_fn"
    canonical = ast.dump(renamed, annotate_fields=False)
    size = sum(1 for _ in ast.walk(renamed))
    for inner in ast.walk(renamed):
        if isinstance(inner, _SCOPES):
            inner.decorator_list = []
    lines = [x.strip() for x in ast.unparse(renamed).splitlines()]
    return Analysis(canonical, [x for x in lines if x], size)
