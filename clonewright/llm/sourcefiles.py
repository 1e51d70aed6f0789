"""Source files that were not written by hand."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonewright.plans.partitions import spread
from clonewright.plans.scratch import discard, materialise

# Names of folders and files that tools write by convention.
GENERATED_DIRS = {"_generated", "__generated__", "generated", "autogen", "gen"}
GENERATED_NAME = re.compile(r"(_pb2|_pb2_grpc|_gen|\.gen|\.g|\.pb|\.generated)\.[a-z]+$")
MINIFIED_NAME = re.compile(r"(\.min|-min|\.bundle|\.packed)\.[a-z]+$")
VENDOR_DIRS = {"vendor", "vendored", "_vendor", "third_party", "thirdparty", "external", "extern", "deps", "node_modules", "site-packages"}

# What tools and copiers write into the comment at a file's head or end.
GENERATED_NOTE = re.compile(
    r"@generated\b"
    r"|<auto-?generated\b"
    r"|^auto-?generated (file|code|by|from)\b"
    r"|\bcode generated by\b"
    r"|^(this file (is|was) |file )?(automatically |auto-?|machine[- ])?generated (by|from)\b"
    r"|\b(produced|generated|created) automatically (by|from)\b"
    r"|\bautomatically (produced|generated|created) (by|from)\b"
    r"|^(this file (is|was) )?machine[- ](written|generated|made) by\b"
    r"|^(this is )?(an? )?(auto-?|automatically )?generated (file|code)\b.*\bdo not (edit|modify)\b",
    re.I,
)
VENDORED_NOTE = re.compile(
    r"^vendored( from)?\b ?:"
    r"|^vendored from\b"
    r"|\bupstream copy\b"
    r"|^copy of \S+, (tag|version|release|commit)\b"
    r"|^(imported|copied|taken) from the \S+ (project|library|package|repository)\b"
    r"|\bbundled here unchanged\b",
    re.I,
)

COMMENT = re.compile(r"\s*(?:#|//|/\*+!?|\*(?!/)|--|;;|<!--|\"\"\"|''')")
CLOSERS = ("*/", "-->", '"""', "'''")
IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
DECLARED = re.compile(r"\b(?:def|function|fn|class|struct|enum|trait|interface)\s+([A-Za-z_]\w*)")
NUMBERED = re.compile(r"^(.*?[A-Za-z_])(\d+)$")
LITERALS = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|\b0[xX][0-9a-fA-F]+\b|\b\d[\d_]*(?:\.\d+)?\b")
PLAIN = re.compile("[^a-z0-9]+")
BLOB = re.compile(r"^[\"'][A-Za-z0-9+/=_\-]{200,}[\"']$")

#: What may stand before or between the comments at a file's head: imports and other openings that declare nothing.
OPENING = re.compile(r"\s*(?:#!|import\b|from\s+\S+\s+import\b|use\b|extern\b|mod\b|package\b|export\s+(?:\*|\{)|['\"]use strict|const\s+.*=\s*require\(|#!?\[|[})\],]|\w+,?$)")


def _said(line: str) -> str | None:
    opened = COMMENT.match(line)
    if not opened:
        return None
    text = line[opened.end() :].strip()
    for end in CLOSERS:
        text = text.removesuffix(end)
    return text.strip()


def notes(lines: list[str]) -> list[str]:
    """Texts of the comments at a file's head, before anything is declared however far down that is, and at its end."""
    filled = [x for x in lines if x.strip()]
    out = []
    top = 0
    for top, line in enumerate(filled):  # noqa: B007
        text = _said(line)
        if text is not None:
            out.append(text)
        elif not OPENING.match(line):
            break
    for line in reversed(filled[top + 1 :]):
        text = _said(line)
        if text is None:
            break
        out.append(text)
    return out


def is_numbered_series(names: list[str], least: int = 3) -> bool:
    """Whether ``least`` or more declared names differ only in a number that counts up by one."""
    runs: dict[str, set[int]] = defaultdict(set)
    for name in names:
        m = NUMBERED.match(name)
        if m and len(m.group(2)) >= 3:
            runs[m.group(1)].add(int(m.group(2)))
    return any(len(v) >= least and all(x + 1 in v for x in sorted(v)[:-1]) for v in runs.values())


def is_minified(code: str) -> bool:
    """Whether next to no white space is left in long lines, or names are mostly single letters and nothing is indented by more than one space a level."""
    names = IDENTIFIER.findall(code)
    if len(names) < 15:
        return False
    lines = code.split("\n")
    if sum(map(str.isspace, code)) < 0.09 * len(code) and max(map(len, lines)) > 300:
        return True
    indents = [len(x) - len(x.lstrip()) for x in lines if x.strip() and x[0].isspace()]
    return min(indents, default=0) <= 1 and sum(len(x) == 1 for x in names) >= 0.2 * len(names)


def is_data(code: str) -> bool:
    """Whether the file is mostly literals: tables of at least 40 numbers, or encoded blobs."""
    numbers = n_numbers = blob = 0
    for m in LITERALS.finditer(code):
        text = m.group()
        if text[0] in "\"'":
            blob += len(text) if BLOB.match(text) else 0
        else:
            numbers += len(text)
            n_numbers += 1
    return blob + (numbers if n_numbers >= 40 else 0) >= 0.35 * max(1, len(code))


def reasons(path: str, content: str | None) -> list[str]:
    """Why a file is not hand-written; empty for hand-written ones, and for null content. Empty content is judged by its path."""
    if content is None:
        return []
    parts = path.split("/")
    out = []
    if GENERATED_DIRS & set(parts[:-1]) or GENERATED_NAME.search(parts[-1]):
        out.append("generated-layout")
    if MINIFIED_NAME.search(parts[-1]):
        out.append("minified-layout")
    if VENDOR_DIRS & set(parts[:-2]):
        out.append("vendored-layout")
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    said = notes(lines)
    if any(map(GENERATED_NOTE.search, said)):
        out.append("generated-note")
    if any(map(VENDORED_NOTE.search, said)):
        out.append("vendored-note")
    if is_numbered_series(DECLARED.findall(content)):
        out.append("generated-series")
    code = "\n".join(x for x in lines if not COMMENT.match(x))
    if is_data(code):
        out.append("data")
    elif is_minified(code):
        out.append("minified")
    return out


def leaves(content: str | None) -> list[tuple[bytes, int]]:
    """(digest, length) of each part of a file: what is declared at its outermost level, up to the next declaration.

    Only letters and digits in one case count, without comments and imports:
    copies of a library differ in those, in layout and in single lines from one
    repository to the next. A file that declares nothing is one part.
    """
    parts: list[list[str]] = [[]]
    for line in (content or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if COMMENT.match(line) or not line.strip():
            continue
        outermost = line[0] not in " \t"
        if outermost and re.match(r"(?:import|from|use)\b", line):
            continue
        if outermost and parts[-1] and DECLARED.search(line):
            parts.append([])
        parts[-1].append(line)
    texts = (PLAIN.sub("", "".join(p).lower()) for p in parts)
    return [(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), len(t)) for t in texts if t]


def _feature_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaf = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))
    for batch in batches:
        paths = batch.column(0).to_pylist()
        contents = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(3),
                pa.array([reasons(p, c) for p, c in zip(paths, contents, strict=True)], pa.list_(pa.string())),
                pa.array([[{"digest": d, "n": n} for d, n in leaves(c)] for c in contents], leaf),
            ],
            names=["file", "repo", "scanned_at", "reasons", "leaves"],
        )


def features(files: DataFrame) -> DataFrame:
    """(file, repo, reasons, leaves): one row per path, from its latest scan. Contents stay in the task that reads them."""
    rows = files.where(F.col("file").isNotNull()).select("file", "repo", "content", F.unix_micros("scanned_at").alias("scanned_at"))
    schema = "file string, repo string, scanned_at long, reasons array<string>, leaves array<struct<digest:binary,n:int>>"
    found = spread(rows).mapInArrow(_feature_stage, schema)
    newest = F.max(F.struct("scanned_at", "repo", "reasons", "leaves")).alias("s")
    return found.groupBy("file").agg(newest).select("file", "s.repo", "s.reasons", "s.leaves")


def stem(path: Column) -> Column:
    """A file's name without its endings, in one case."""
    return F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", 1))


def copied_files(files: DataFrame, share: float = 0.5) -> DataFrame:
    """(repo, node) of the files of which at least ``share``, by length, stands in files of one name in other repositories.

    The lowest levels of the tree, a file and its parts, are compared by what
    they contain: equal hashes of whole files miss copies with one changed
    line. A part counts as shared if its digest stands under the same file name
    in two repositories; counting that is one aggregation with partial sums.
    """
    parts = files.select("file", "repo", stem(F.col("file")).alias("stem"), F.explode("leaves").alias("p"))
    parts = parts.select("file", "repo", "stem", "p.digest", "p.n")
    twice = parts.groupBy("stem", "digest").agg(F.min("repo").alias("_a"), F.max("repo").alias("_b")).where(F.col("_a") < F.col("_b"))
    known = parts.join(twice.select("stem", "digest", F.lit(True).alias("twice")), ["stem", "digest"], "left")
    each = known.groupBy("repo", F.col("file").alias("node")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("twice"), F.col("n")).otherwise(0)).alias("shared"))
    return each.where((F.col("shared") > 0) & (F.col("shared") >= share * F.col("n"))).select("repo", "node")


def shared_subtrees(nodes: DataFrame) -> DataFrame:
    """(repo, node): files and folders whose Merkle hash stands in several repositories.

    ``nodes`` has rows (file, repo, leaves). A file's hash is made of its name
    and its parts, a file without any takes no part. A folder's hash is the sum of two
    64-bit hashes of its children's names and hashes, so children need no order
    and are combined on the map side; a folder with a third of all files is no
    single task's work. Version numbers in folder names do not count. Levels
    are hashed bottom-up, each written to the shared folder. A repository's own
    root is not compared: repositories equal as a whole are forks.
    """
    digests = F.array_sort(F.transform("leaves", lambda p: p["digest"]))
    start = nodes.where(F.size("leaves") > 0).select(
        "repo",
        F.col("file").alias("node"),
        F.xxhash64(stem(F.col("file")), digests).alias("h1"),
        F.xxhash64(F.lit(1), stem(F.col("file")), digests).alias("h2"),
    ).withColumn("depth", F.size(F.split("node", "/")))
    level = materialise(start)
    depth = level.agg(F.max("depth")).first()[0] or 0
    done = [level]
    below: DataFrame | None = None
    for k in range(depth, 2, -1):
        here = level.where(F.col("depth") == k)
        here = here if below is None else here.unionByName(below)
        name = F.regexp_replace(F.substring_index("node", "/", -1), r"(-\d[\w.]*)?(\.\w+)?$", "")
        parent = F.regexp_replace("node", "/[^/]*$", "")
        total = here.groupBy("repo", parent.alias("node")).agg(
            F.sum(F.xxhash64(name, "h1", "h2").cast("decimal(38,0)")).alias("s1"),
            F.sum(F.xxhash64(F.lit(1), name, "h1", "h2").cast("decimal(38,0)")).alias("s2"),
        )
        below = materialise(total.select("repo", "node", F.xxhash64("s1").alias("h1"), F.xxhash64("s2").alias("h2"), F.lit(k - 1).alias("depth")))
        done.append(below)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = every.where(F.col("depth") > 1)
    shared = every.groupBy("h1", "h2").agg(F.min("repo").alias("_a"), F.max("repo").alias("_b")).where(F.col("_a") < F.col("_b"))
    out = materialise(every.join(shared, ["h1", "h2"]).select("repo", "node").distinct())
    for old in done:
        discard(old)
    return out


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file, repo, reasons): the files that a rule or a shared subtree marks.

    A file is marked by what its head or end says, by the names of its folders
    and itself, by what it holds (numbered series, tight code, mere literals),
    or when it, most of it, or a folder above it stands in another repository too. Files
    with null path are left out; a file whose content is null is no case.
    """
    found = materialise(features(files))
    tree = found.select("file", "repo", "leaves")
    shared = shared_subtrees(tree).unionByName(copied_files(tree)).distinct()
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    deep = found.where(F.size(parts) >= 2).select("file", "repo", F.explode(above).alias("node"))
    merkle = deep.join(shared, ["repo", "node"], "left_semi").select("file").distinct().withColumn("merkle", F.lit(True))
    marked = found.join(merkle, "file", "left").select(
        "file",
        "repo",
        F.when(F.col("merkle"), F.concat("reasons", F.array(F.lit("shared-subtree")))).otherwise(F.col("reasons")).alias("reasons"),
    )
    return marked.where(F.size("reasons") > 0)


def handwritten_definitions(definitions: DataFrame, marked: DataFrame) -> DataFrame:
    """The definitions whose file is not marked."""
    return definitions.join(marked.select("file"), "file", "left_anti")
