"""What a frontend is, and what all share."""

from __future__ import annotations

import bisect
import sys
import threading
from dataclasses import dataclass
from typing import Any, Protocol

from clonewright.functions.model import KINDS


class Frontend(Protocol):
    """A language: its code, file endings, kinds, and how one file is scanned."""

    lang: str
    extensions: tuple[str, ...]
    kinds: tuple[str, ...]

    def scan(self, path: str, text: str) -> list[Definition]: ...


@dataclass(frozen=True)
class Analysis:
    """Name-free forms of a callable."""

    xname_canonical: str
    type3_lines: list[str]
    size: int


@dataclass(frozen=True)
class Definition:
    """One definition; ``line`` and ``col`` count from 0, ``col`` in characters."""

    kind_id: str
    name: str
    line: int
    col: int
    args: int
    text: str
    canonical: str | None = None
    analysis: Analysis | None = None

    def row(self, lang: str, path: str, ordinal: int) -> dict[str, Any]:
        k = KINDS[self.kind_id]
        return {
            "lang": lang,
            "kind": {"id": k.id, "label": k.label, "noun_plural": k.noun_plural, "section": k.section, "body": k.body, "fn_like": k.fn_like},
            "name": self.name,
            "file": path,
            "line": self.line,
            "col": self.col,
            "ordinal": ordinal,
            "loc": sum(1 for x in self.text.split("\n") if x.strip()),
            "args": self.args,
            "text_orig": self.text,
            "cluster_canonical": self.canonical,
            "analysis": None
            if self.analysis is None
            else {"xname_canonical": self.analysis.xname_canonical, "type3_lines": self.analysis.type3_lines, "size": self.analysis.size},
        }


class Lines:
    """Places of character offsets."""

    def __init__(self, text: str):
        self.starts = [0]
        for i, c in enumerate(text):
            if c == "\n":
                self.starts.append(i + 1)

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]


def with_deep_stack(work, *args, megabytes: int = 256, depth: int = 40_000):
    """Run ``work`` in a thread with a large stack, so deeply nested sources can be walked.

    The thread belongs to the calling task; its result or exception is handed back.
    """
    box: dict[str, Any] = {}

    def run() -> None:
        try:
            box["value"] = work(*args)
        except BaseException as error:  # handed to the caller
            box["error"] = error

    limit, size = sys.getrecursionlimit(), threading.stack_size(megabytes << 20)
    sys.setrecursionlimit(max(limit, depth))
    try:
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(limit)
    if "error" in box:
        raise box["error"]
    return box["value"]
