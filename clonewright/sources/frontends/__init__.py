"""Language frontends: each turns the text of one file into definitions."""

from __future__ import annotations

from .base import Frontend
from .python import PythonFrontend
from .rust import RustFrontend
from .typescript import TypeScriptFrontend

#: All frontends by language code, in report order.
FRONTENDS: dict[str, Frontend] = {f.lang: f for f in (PythonFrontend(), TypeScriptFrontend(), RustFrontend())}


def register(frontend: Frontend) -> None:
    """Add a language: any object with ``lang``, ``extensions``, ``kinds`` and ``scan(path, text)``.

    Its endings are routed to it and its kinds join the report; an ending or
    language that is taken already is refused. It travels to the executors
    with the scan.
    """
    taken = {e for f in FRONTENDS.values() for e in f.extensions}
    if frontend.lang in FRONTENDS or taken & set(frontend.extensions):
        raise ValueError(f"language {frontend.lang!r} or one of {frontend.extensions} is taken")
    FRONTENDS[frontend.lang] = frontend
