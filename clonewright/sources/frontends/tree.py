"""Syntax trees of the hand-written parsers and their canonical text."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class ParseError(ValueError):
    """The text is not in the language, or in a part of it that the parser does not know."""


class Node:
    """A tag and its fields: strings, nodes, lists of nodes, or None for an absent part.

    ``name`` is set where the node stands for an identifier that renaming may
    touch; ``binds`` where it introduces one.
    """

    __slots__ = ("binds", "end", "fields", "name", "start", "tag")

    def __init__(self, tag: str, *fields, name: str | None = None, binds: bool = False):
        self.tag, self.fields, self.name, self.binds = tag, fields, name, binds
        self.start = self.end = 0

    def children(self) -> Iterator[Node]:
        for f in self.fields:
            for x in f if isinstance(f, list) else (f,):
                if isinstance(x, Node):
                    yield x

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def written(node: Node, rename: Callable[[str], str] = str) -> str:
    """``Tag(f1, f2, ...)``; absent fields are empty, lists stand in brackets, names go through ``rename``."""
    parts = []
    if node.name is not None:
        parts.append(f"'{rename(node.name)}'")
    for f in node.fields:
        if isinstance(f, Node):
            parts.append(written(f, rename))
        elif isinstance(f, list):
            parts.append("[" + ", ".join(written(x, rename) if isinstance(x, Node) else "" if x is None else str(x) for x in f) + "]")
        else:
            parts.append("" if f is None else str(f))
    return f"{node.tag}({', '.join(parts)})"


def size(node: Node) -> int:
    return sum(1 for _ in node.walk())


class Renaming:
    """Neutral names for bound ones by first appearance; ``top`` becomes ``_fn``."""

    def __init__(self, bound: set[str], top: str | None):
        self.bound, self.top = bound, top
        self.seen: dict[str, str] = {}

    def __call__(self, name: str) -> str:
        if name == self.top:
            return "_fn"
        if name not in self.bound:
            return name
        return self.seen.setdefault(name, f"_v{len(self.seen)}")


class Reader:
    """A cursor over lazily cut tokens, with places to return to."""

    def __init__(self, text: str):
        self.text = text
        self.pos = 0
        self.last_end = 0
        self.advance()

    # tokens are (kind, value, start, end, line break before)
    def cut(self, pos: int) -> tuple[str, str, int, int, bool]:
        raise NotImplementedError

    def advance(self) -> tuple[str, str, int, int, bool]:
        old = getattr(self, "token", ("", "", 0, 0, False))
        self.last_end = old[3]
        self.token = self.cut(self.pos)
        self.pos = self.token[3]
        return old

    def mark(self):
        return self.pos, self.last_end, self.token

    def back(self, mark) -> None:
        self.pos, self.last_end, self.token = mark

    def jump(self, pos: int) -> None:
        """Go on cutting at ``pos``."""
        self.pos = pos
        self.token = ("", "", pos, pos, False)
        self.advance()
        self.last_end = pos

    @property
    def value(self) -> str:
        return self.token[1] if self.token[0] in ("punct", "id") else ""

    def at(self, *values: str) -> bool:
        return self.token[0] in ("punct", "id") and self.token[1] in values

    def take(self, *values: str) -> bool:
        if self.at(*values):
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise ParseError(f"expected {value!r} at {self.token[2]}, got {self.token[1]!r}")

    def identifier(self) -> str:
        if self.token[0] != "id":
            raise ParseError(f"expected a name at {self.token[2]}, got {self.token[1]!r}")
        return self.advance()[1]

    def peek(self) -> tuple[str, str, int, int, bool]:
        return self.cut(self.pos)

    def attempt(self, work):
        """The result of ``work``, or None with the cursor where it was."""
        here = self.mark()
        try:
            return work()
        except ParseError:
            self.back(here)
            return None
