"""Glob patterns as anchored regular expressions."""

from __future__ import annotations

import re


def alternatives(pattern: str) -> list[str]:
    """The pattern with every ``{a,b}`` written out; braces that never close stay as they are."""
    start = pattern.find("{")
    end = pattern.find("}", start + 1)
    if start < 0 or end < 0:
        return [pattern]
    head, tail = pattern[:start], pattern[end + 1 :]
    return [whole for option in pattern[start + 1 : end].split(",") for whole in alternatives(head + option + tail)]


def to_regex(pattern: str) -> str:
    """A regular expression, valid in Java and Python, for the whole string: ``*`` any run, ``?`` one character."""
    quoted = {"*": ".*", "?": "."}
    options = ("".join(quoted.get(c) or re.sub(r"([^\w])", r"\\\1", c) for c in p) for p in alternatives(pattern))
    return r"(?s)^(?:" + "|".join(options) + r")\z"


def matches(pattern: str, text: str) -> bool:
    """Whether the glob matches all of ``text``."""
    return re.match(to_regex(pattern).replace(r"\z", r"\Z"), text) is not None
