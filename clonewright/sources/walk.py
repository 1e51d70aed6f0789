"""From paths to a table of definitions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonewright.functions.model import SCAN_SCHEMA, with_def_ids
from clonewright.plans.scratch import materialise

from .frontends import FRONTENDS
from .frontends.base import with_deep_stack

# Folders that hold no source of a project's own.
SKIPPED_DIRS = frozenset(
    ".venv venv venv2 venv3 env .env __pycache__ .tox .pytest_cache .mypy_cache .ruff_cache .ipynb_checkpoints site-packages "
    "node_modules dist out build .next .nuxt .turbo .cache coverage .git target .idea .vscode .direnv".split()
)


def is_skipped(folder: str) -> bool:
    return folder in SKIPPED_DIRS or folder.endswith(".egg-info")


def source_paths(paths: list[str], langs: list[str] | None = None) -> list[tuple[str, str]]:
    """(lang, path) of the files below ``paths`` that a frontend takes, once each, sorted.

    Skipped folders are pruned before they are entered; a folder or file that
    is itself given never is. What can't be read is left out.
    """
    endings = {e: f.lang for f in FRONTENDS.values() if langs is None or f.lang in langs for e in f.extensions}
    found: set[tuple[str, str]] = set()

    def take(path: str) -> None:
        lang = endings.get(os.path.splitext(path)[1])
        if lang:
            found.add((lang, path))

    for top in paths:
        if os.path.isfile(top):
            take(top)
        for folder, below, files in os.walk(top):
            below[:] = [b for b in below if not is_skipped(b)]
            for name in files:
                take(os.path.join(folder, name))
    return sorted(found)


def read_sources(spark: SparkSession, paths: list[str], langs: list[str] | None = None) -> DataFrame:
    """(lang, file, content) of the source files; executors read them, so the folders must be shared.

    Spark's own file sources skip names with a leading underscore, which
    ``__init__.py`` has, so the files are opened by path. Files that are not
    UTF-8 have null content.
    """
    rows = source_paths(paths, langs)
    listed = spark.createDataFrame(rows, "lang string, file string")
    parts = max(1, min(len(rows) // 16 + 1, 10_000))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[_text(p) for p in batch["file"]])

    return listed.repartition(parts).mapInPandas(read, "lang string, file string, content string")


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def scan(sources: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Definitions of a table (lang, file, content), by the frontend of each language.

    Null contents, unknown languages and files that can't be parsed give
    nothing. ``kinds`` are filtered where they are found.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = with_deep_stack(_scan_rows, batch, kinds)
            yield pd.DataFrame(rows, columns=COLUMNS)

    usable = sources.where(F.col("content").isNotNull() & F.col("file").isNotNull()).select("lang", "file", "content")
    return usable.mapInPandas(work, SCAN_SCHEMA)


COLUMNS = ["lang", "kind", "name", "file", "line", "col", "ordinal", "loc", "args", "text_orig", "cluster_canonical", "analysis"]


def _scan_rows(batch: pd.DataFrame, kinds: list[str] | None) -> list[dict]:
    rows = []
    for lang, path, text in zip(batch["lang"], batch["file"], batch["content"], strict=True):
        frontend = FRONTENDS.get(lang)
        for i, d in enumerate(frontend.scan(path, text) if frontend else []):
            if kinds is None or d.kind_id in kinds:
                rows.append(d.row(lang, path, i))
    return rows


def definitions(sources: DataFrame) -> DataFrame:
    """The scanned definitions with ids in the order of file and place, written once."""
    return materialise(with_def_ids(materialise(scan(sources))))
