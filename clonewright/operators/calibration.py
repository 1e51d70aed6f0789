"""Distribution of thickness, threshold suggestions and inferred rules."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonewright.plans.scratch import discard, materialise

BINS = 10
# The suggestions and the percentiles they stand on.
ANCHORS = (("permissive", 50), ("balanced", 75), ("strict", 90))
SUGGESTED_CAP = 256
VENDORED_LEAST = 30


def histogram(findings: DataFrame) -> DataFrame:
    """(bin, lo, hi, n) of ``thickness`` in ten bins from 0 to 1; the last is open above. Every bin has a row."""
    width = 1.0 / BINS
    edges = F.array(*[F.lit(i * width) for i in range(BINS)])
    reached = F.size(F.filter(edges, lambda e: e <= F.col("thickness"))) - 1
    counts = findings.where(F.col("thickness") >= 0).groupBy(reached.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = findings.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    lo, hi = F.col("bin").cast("double") * width, (F.col("bin") + 1).cast("double") * width
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Values of a numeric column at shares between 0 and 1, interpolated between neighbours; None if it holds none.

    Values are counted, range-sorted and written; counts per partition tell
    which partitions hold the wanted ranks, and only those are ranked row by
    row, so the distinct values never meet in one task. The driver gets a count
    per partition and two values per share.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = materialise(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(p.n for p in parts)
    if not total:
        discard(placed)
        return None
    places = [(total - 1) * s for s in shares]
    ranks = sorted({r for at in places for r in (floor(at), ceil(at))})
    base, before = {}, 0
    for p in parts:
        if any(before <= r < before + p.n for r in ranks):
            base[p.part] = before
        before += p.n
    start = F.lit(0)
    for part, n in base.items():
        start = F.when(F.col("part") == part, F.lit(n)).otherwise(start)
    upto = start + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = placed.where(F.col("part").isin(list(base))).select("v", (upto - F.col("n")).alias("lo"), upto.alias("hi"))
    hit = F.exists(F.array(*[F.lit(r) for r in ranks]), lambda r: (F.col("lo") <= r) & (r < F.col("hi")))
    found = ranked.where(hit).collect()
    discard(placed)
    at_rank = {r: next(x.v for x in found if x.lo <= r < x.hi) for r in ranks}
    return [at_rank[floor(at)] if floor(at) == ceil(at) else (ceil(at) - at) * at_rank[floor(at)] + (at - floor(at)) * at_rank[ceil(at)] for at in places]


def suggestions(findings: DataFrame) -> DataFrame:
    """One row per anchor: the threshold at that percentile, what stays above it, and the thinnest finding that does.

    The percentile interpolates between neighbours; medians are the upper of
    two. An empty input gives no row.
    """
    spark = findings.sparkSession
    shares = [p / 100 for _, p in ANCHORS]
    cuts = quantiles(findings, "thickness", shares)
    if cuts is None:
        return spark.createDataFrame([], "label string, percentile int, threshold double, kept long, median_loc int, median_args int, name string, thickness double, loc int, args int, members array<struct<file:string,line:int,col:int>>, snippet string")
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("percentile"), F.lit(float(c)).alias("threshold")) for (label, p), c in zip(ANCHORS, cuts, strict=True)])
    each = findings.select("*", F.inline(rows)).where(F.col("thickness") >= F.col("threshold"))
    example = F.min(F.struct("thickness", "name", "members", "loc", "args", "snippet")).alias("e")
    base = each.groupBy("label", "percentile", "threshold").agg(F.count(F.lit(1)).alias("kept"), example)
    for column in ("loc", "args"):
        base = base.join(_upper_medians(each, column), "label")
    return base.select("label", "percentile", "threshold", "kept", "median_loc", "median_args", "e.name", "e.thickness", "e.loc", "e.args", "e.members", "e.snippet").orderBy("percentile")


def _upper_medians(each: DataFrame, column: str) -> DataFrame:
    """(label, median): the value at place n div 2 from 0, found on counts per value."""
    counts = each.groupBy("label", column).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label").orderBy(column)
    upto = F.sum("n").over(order)
    total = F.sum("n").over(Window.partitionBy("label"))
    placed = counts.select("label", column, upto.alias("upto"), total.alias("total"))
    return placed.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("label").agg(F.min(column).alias(f"median_{column}"))


def _any_of(path: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | path.contains(p)
    return hit


def _ends_with(path: Column, ends: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for e in ends:
        hit = hit | path.endswith(e)
    return hit


# The path conventions that mark duplication by design.
I18N_DIRS = ("/locale/", "/locales/", "/i18n/", "/translations/")
TEST_DIRS = ("/tests/", "/test/", "/__tests__/", "/test_cases/", "/test-cases/", "/__fixtures__/", "/fixtures/", "/integration/", "/e2e/")
GENERATED_ENDS = ("_pb2.py", "_pb2_grpc.py", "_grpc.py", ".gen.py", ".generated.ts", ".generated.tsx", ".generated.js", ".generated.jsx")
GENERATED_DIRS = ("/_generated/", "/generated/", "/__generated__/")
MIGRATION_DIRS = ("/migrations/", "/alembic/versions/")
DECLARATION_ENDS = (".d.ts", ".d.tsx", ".d.mts", ".d.cts")
EXAMPLE_DIRS = ("/docs_src/", "/docs/src/", "/examples/", "/example/", "/tutorial/", "/tutorials/", "/samples/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_i18n(path: Column) -> Column:
    return _any_of(F.lower(path), I18N_DIRS)


def is_test_named(path: Column) -> Column:
    return _any_of(file_name(path), (".test.", ".spec."))


def is_test(path: Column) -> Column:
    name = file_name(path)
    return _any_of(F.lower(path), TEST_DIRS) | name.startswith("test_") | name.endswith("_test.py") | is_test_named(path)


def is_generated(path: Column) -> Column:
    return _ends_with(path, GENERATED_ENDS) | _any_of(path, GENERATED_DIRS)


def is_migration(path: Column) -> Column:
    return _any_of(path, MIGRATION_DIRS)


def is_declaration(path: Column) -> Column:
    return _ends_with(path, DECLARATION_ENDS)


def is_story(path: Column) -> Column:
    return file_name(path).contains(".stories.")


def is_example(path: Column) -> Column:
    return _any_of(path, EXAMPLE_DIRS)


def _all(test) -> Column:
    return F.forall("members", lambda m: test(m["file"]))


def _any(test) -> Column:
    return F.exists("members", lambda m: test(m["file"]))


def _mostly_i18n_constants() -> Column:
    inside = F.size(F.filter("members", lambda m: is_i18n(m["file"])))
    return (F.col("kind.id") == "constants") & (F.try_divide(inside, F.size("members")) >= 0.8)


# For each rule the least number of findings, the directive and its reason, in report order.
RULES = (
    (_mostly_i18n_constants, 5, "suppress:CONSTANT:*@*locale*=i18n locale tables, duplication is by design", "{n} CONSTANT clusters are ≥80% inside locale/i18n paths"),
    (lambda: _all(is_i18n), 5, "suppress:*:*@*/{locale,locales,i18n,translations}/*=i18n / translation tables — per-locale near-duplicates are by design", "{n} clusters live entirely in locale / i18n / translation paths"),
    (lambda: _all(is_test), 3, "de-escalate:*:*@*/{test,tests,__tests__,test_cases,test-cases,__fixtures__,fixtures,integration,e2e}/*=test parametrize/fixture candidates — review for conftest", "{n} clusters live entirely in test paths — parametrize/conftest candidates"),
    (lambda: _all(is_test_named), 3, "de-escalate:*:*@*.{test,spec}.*=test files by .test.* / .spec.* naming", "{n} clusters live entirely in `*.test.*` / `*.spec.*` files (jest/vitest/mocha)"),
    (lambda: _any(is_generated), 3, "suppress:*:*@*_pb2*=generated protobuf/gRPC code, suppress wholesale", "{n} clusters touch `*_pb2*`/`*_grpc*` files — generated code"),
    (lambda: _all(is_migration), 3, "suppress:*:*@*migrations/*=schema migrations are snapshots, not refactor targets", "{n} clusters live entirely under migrations/ — schema-history files"),
    (lambda: _all(is_example), 5, "de-escalate:*:*@*/{docs_src,docs/src,examples,example,tutorial,tutorials,samples}/*=tutorial/doc-example code — snippet duplication is expected", "{n} clusters live entirely under docs_src/ / examples/ / tutorial/ paths"),
    (lambda: _all(is_declaration), 3, "suppress:*:*@*.d.ts=TypeScript declaration files, type-only duplication is by design", "{n} clusters live entirely in `.d.ts` declaration files"),
    (lambda: _all(is_story), 5, "de-escalate:*:*@*.stories.*=Storybook stories — boilerplate duplication is the docstring", "{n} clusters live entirely in `*.stories.*` Storybook files"),
)

INFERRED_SCHEMA = "place int, directive string, rationale string, affects_total long, affects_error long, affects_warning long, affects_info long"


def inferred_rules(findings: DataFrame) -> list[tuple]:
    """(directive, rationale, total, error, warning, info) of every path rule with enough findings: one pass, one row of counts."""
    aggregates = []
    for i, (test, *_) in enumerate(RULES):
        hit = F.coalesce(test() & (F.size("members") >= 0), F.lit(False))
        aggregates.append(F.count_if(hit).alias(f"t{i}"))
        aggregates += [F.count_if(hit & (F.col("severity") == s)).alias(f"{s}{i}") for s in ("ERROR", "WARNING", "INFO")]
    row = findings.agg(*aggregates).first()
    out = []
    for i, (_, least, directive, why) in enumerate(RULES):
        n = row[f"t{i}"]
        if n >= least:
            out.append((directive, why.format(n=n), n, *[row[f"{s}{i}"] for s in ("ERROR", "WARNING", "INFO")]))
    return out


# The suggestion to cap name groups and its reason.
CAP_DIRECTIVE = "settings:max-name-group={cap}"
CAP_REASON = "{n} name-group(s) exceed {cap} members ({sample}) — shared / entry-point names, not duplication; their O(n²) name-gated clustering dominates runtime, so the cap skips them"


def inferred_cap(groups: DataFrame, named: int = 4) -> list[tuple]:
    """The suggestion to cap name groups, from the rows (kind_id, name, n) of the large ones in report order; only those it names reach the driver."""
    n, total = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return []
    sample = ", ".join(f"{r.kind_id}:{r.name} ×{r.n}" for r in groups.limit(named).collect()) + (f", +{n - named} more" if n > named else "")
    return [(CAP_DIRECTIVE.format(cap=SUGGESTED_CAP), CAP_REASON.format(n=n, cap=SUGGESTED_CAP, sample=sample), total, 0, 0, 0)]


# Marks of a folder that holds copies, and their points.
VENDORED_MARKS = (
    (("/fixtures/", "/__fixtures__/"), 10),
    (("/test/", "/tests/", "/__tests__/"), 5),
    (("/vendor/", "/vendored/", "/third_party/"), 8),
    (("/extensions/", "/extension/"), 1),
)


def vendored_score(directory: Column) -> Column:
    """How much a folder looks like a copy of another: marks of fixtures, tests, vendored code and the like add up."""
    score = F.when(directory.contains("/util/vs/"), 5).when(directory.contains("/util/"), 1).otherwise(0)
    for parts, points in VENDORED_MARKS:
        score = score + F.when(_any_of(directory, parts), points).otherwise(0)
    return score


def vendored_roots(findings: DataFrame, least: int = VENDORED_LEAST) -> DataFrame:
    """(anchor, source, n, n_error, n_warning, n_info): folders that hold copies of same-named files, most first, five at most.

    Of a finding whose members share one file name over several folders, the
    folder that looks least like a copy is the source; every other folder with
    a mark gives the part of its path that the source does not share. Paths are
    rolled up to the deepest folder with ``least`` findings; a folder above
    another chosen one is dropped.
    """
    parts = F.transform("members", lambda m: F.regexp_extract(m["file"], "^(.*)/[^/]*$", 1))
    names = F.array_distinct(F.transform("members", lambda m: file_name(m["file"])))
    dirs = findings.select("severity", names.alias("names"), F.array_distinct(parts).alias("dirs"), F.monotonically_increasing_id().alias("f"))
    dirs = dirs.where((F.size("names") == 1) & (F.size("dirs") >= 2))
    ranked = F.array_sort(F.transform("dirs", lambda x: F.struct(vendored_score(x).alias("s"), F.size(F.split(x, "/")).alias("k"), x.alias("d"))))
    rows = dirs.select("severity", ranked[0]["d"].alias("source"), F.explode(F.slice(ranked, F.lit(2), F.size(ranked))).alias("o"))
    rows = rows.where(F.col("o.s") > 0).select("severity", "source", F.col("o.d").alias("dir"))
    mine, theirs = F.reverse(F.split("dir", "/")), F.reverse(F.split("source", "/"))
    same = F.transform(F.arrays_zip(mine.alias("a"), theirs.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    differs = F.array_position(same, False)
    shared = F.when(differs > 0, differs - 1).otherwise(F.least(F.size(mine), F.size(theirs)))
    own = F.array_join(F.slice(F.split("dir", "/"), F.lit(1), (F.size(F.split("dir", "/")) - shared).cast("int")), "/")
    prefixed = rows.withColumn("prefix", F.when(own == "", F.col("dir")).otherwise(own)).where(F.col("prefix") != "")
    steps = F.split("prefix", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    counts = prefixed.select("severity", F.explode(ancestors).alias("anchor")).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("ERROR", "WARNING", "INFO")],
    )
    enough = counts.where(F.col("n") >= least)
    leaves = prefixed.select("prefix", F.explode(ancestors).alias("anchor")).distinct().join(enough.select("anchor"), "anchor")
    chosen = leaves.groupBy("prefix").agg(F.max_by("anchor", F.length("anchor")).alias("anchor")).select("anchor").distinct()
    above = chosen.select(F.col("anchor").alias("deep"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("anchor", "/"))), lambda k: F.array_join(F.slice(F.split("anchor", "/"), F.lit(1), k), "/"))).alias("anchor"))
    chosen = chosen.join(above.where(F.col("deep") != F.col("anchor")).select("anchor").distinct(), "anchor", "left_anti")
    sources = prefixed.select("source", F.explode(ancestors).alias("anchor")).groupBy("anchor").agg(F.min("source").alias("source"))
    return chosen.join(enough, "anchor").join(sources, "anchor").select("anchor", "source", "n", "n_error", "n_warning", "n_info").orderBy(F.col("n").desc(), "anchor").limit(5)
