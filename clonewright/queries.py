"""Queries over the definition and finding tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonewright.functions.canonical import analysed
from clonewright.functions.model import distinct_definitions, kind_column
from clonewright.functions.scoring import graded, loc, section_index, thickness
from clonewright.operators import calibration, nearcopy
from clonewright.operators.directives import applied, parse_directive
from clonewright.operators.graph import smallest_label
from clonewright.operators.named import large_name_groups, name_groups, named_clusters, named_findings
from clonewright.operators.renamed import callables, renamed_clusters, renamed_findings
from clonewright.plans.partitions import heavy_tasks
from clonewright.plans.pipeline import cluster
from clonewright.sources.frontends import FRONTENDS
from clonewright.sources.tables import table
from clonewright.sources.walk import scan

Query = Callable[[SparkSession, str], DataFrame]

RULES = ("suppress:*:*@*/tests/*=test code", "de-escalate:FUNCTION:*@*/tools/*=tooling", "escalate:METHOD:*", "note:CLASS:*=class")


def _defs(spark: SparkSession, d: str) -> DataFrame:
    return distinct_definitions(table(spark, d, "definitions"))


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """The last loaded row of each finding, with the kind as the passes give it, and usable members only."""
    newest = F.max(F.struct("loaded_at", "pass", "kind", "name", "severity", "min_sim", "loc", "args", "thickness", "snippet", "notes", "members")).alias("f")
    rows = table(spark, d, "findings").where(F.col("finding_id").isNotNull()).groupBy("finding_id").agg(newest).select("finding_id", "f.*")
    whole = F.filter(F.coalesce("members", F.array()), lambda m: m.isNotNull() & m["file"].isNotNull() & m["line"].isNotNull() & m["col"].isNotNull())
    return rows.withColumn("members", whole).withColumn("kind", kind_column(F.col("kind"))).withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Findings that have a thickness; for the operators that need one."""
    return _loaded(spark, d).where(F.col("thickness").isNotNull() & ~F.isnan("thickness"))


def _summary(found: DataFrame) -> DataFrame:
    """Findings flattened to plain columns, floats rounded, for comparison."""
    places = F.transform("members", lambda m: F.concat_ws(":", m["file"], m["line"].cast("string"), m["col"].cast("string")))
    return found.select(
        "pass", F.col("kind.id").alias("kind_id"), "name", "severity", F.round("min_sim", 6).alias("min_sim"), "loc", "args",
        F.round("thickness", 6).alias("thickness"), F.size("members").alias("n"), F.array_join(places, " ").alias("members"),
    )


def definition_loc(spark: SparkSession, d: str) -> DataFrame:
    return _defs(spark, d).where(F.col("text_orig").isNotNull()).select("def_id", loc(F.col("text_orig")).alias("lines"))


def scan_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "source_files").where(F.col("file").isNotNull())
    newest = F.row_number().over(Window.partitionBy("file").orderBy(F.col("scanned_at").desc_nulls_last()))
    # the newest scan is found on times alone; contents only move to be dealt out evenly
    last = sources.select("file", "scanned_at").withColumn("_k", newest).where("_k = 1").drop("_k")
    same = (sources["file"] == last["file"]) & sources["scanned_at"].eqNullSafe(last["scanned_at"])
    files = sources.join(last, same, "left_semi").repartition(heavy_tasks(spark), "file").dropDuplicates(["file"])
    return scan(files.select("lang", "file", "content")).select("lang", F.col("kind.id").alias("kind_id"), "name", "file", "line", "col", "loc", "args", F.col("analysis").isNotNull().alias("analysed"))


def canonical_forms(spark: SparkSession, d: str) -> DataFrame:
    """Callables of every language analysed anew from their text."""
    own = _defs(spark, d).where(F.col("lang").isin(list(FRONTENDS)) & F.col("kind.fn_like") & F.col("text_orig").isNotNull())
    own = own.repartition(heavy_tasks(spark), "def_id")
    forms = []
    for lang in FRONTENDS:
        rows = own.where(F.col("lang") == lang).select("def_id", analysed(lang)(F.col("text_orig")).alias("a"))
        forms.append(rows.where(F.col("a.size").isNotNull()).select("def_id", F.md5("a.xname_canonical").alias("xname"), F.size("a.type3_lines").alias("n_lines"), "a.size"))
    return reduce(DataFrame.unionByName, forms)


def pass_named(spark: SparkSession, d: str) -> DataFrame:
    return _summary(named_findings(_defs(spark, d)))


def pass_renamed(spark: SparkSession, d: str) -> DataFrame:
    return _summary(renamed_findings(_defs(spark, d)))


def pass_type3(spark: SparkSession, d: str) -> DataFrame:
    return _summary(nearcopy.type3_findings(_defs(spark, d)))


def named_members(spark: SparkSession, d: str) -> DataFrame:
    """Membership of the clusters of the first pass, one row per definition."""
    return named_clusters(_defs(spark, d)).select("def_id", "cluster", F.round("min_sim", 6).alias("min_sim"))


def renamed_members(spark: SparkSession, d: str) -> DataFrame:
    return renamed_clusters(_defs(spark, d))


def type3_members(spark: SparkSession, d: str) -> DataFrame:
    return nearcopy.type3_clusters(_defs(spark, d)).select("def_id", "cluster", F.round("min_sim", 6).alias("min_sim"))


def name_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return name_groups(_defs(spark, d))


def large_groups(spark: SparkSession, d: str) -> DataFrame:
    return large_name_groups(_defs(spark, d), 64)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    own = callables(_defs(spark, d)).where(F.size("analysis.type3_lines") >= 3)
    return own.select("def_id", F.explode("analysis.type3_lines").alias("line")).where(F.col("line").isNotNull())


def type3_line_weights(spark: SparkSession, d: str) -> DataFrame:
    return nearcopy.line_weights(_lines(spark, d)).select("line", "occurrences", F.round("weight", 6).alias("weight"))


def type3_cosines(spark: SparkSession, d: str) -> DataFrame:
    own = callables(_defs(spark, d)).where(F.size("analysis.type3_lines") >= 3)
    sequences = own.select(F.col("def_id").alias("seq"), F.col("analysis.type3_lines").alias("lines"))
    cells = nearcopy.line_vectors(sequences, nearcopy.line_weights(sequences.select(F.explode("lines").alias("line"))))
    return nearcopy.cosine_pairs(cells, 0.7).select("a", "b", F.round("cosine", 6).alias("cosine"))


def component_labels(spark: SparkSession, d: str) -> DataFrame:
    """Components of definitions that share a file or a renamed canonical."""
    own = callables(_defs(spark, d)).select("def_id", "file", F.md5("analysis.xname_canonical").alias("x"))
    firsts = [own.groupBy(c).agg(F.min("def_id").alias("a")).join(own, c).select("a", F.col("def_id").alias("b")) for c in ("file", "x")]
    return smallest_label(firsts[0].unionByName(firsts[1]))


def thickness_scores(spark: SparkSession, d: str) -> DataFrame:
    f = _loaded(spark, d).where(F.size("members") > 0)
    score = thickness(F.col("loc"), F.col("args"), F.size("members"), F.coalesce("min_sim", F.lit(1.0)))
    return f.where(F.col("loc").isNotNull() & F.col("args").isNotNull() & ~F.isnan(F.coalesce("min_sim", F.lit(1.0)))).select("finding_id", F.round(score, 6).alias("score"))


def severity_ladder(spark: SparkSession, d: str) -> DataFrame:
    f = _loaded(spark, d)
    return f.select("finding_id", graded(F.col("severity"), F.col("thickness"), 0.4, 0.3, 0.9).alias("severity"), section_index(F.col("kind"), F.col("pass")).alias("section"))


def directives_applied(spark: SparkSession, d: str) -> DataFrame:
    out = applied(_loaded(spark, d), [parse_directive(r) for r in RULES])
    return out.select("finding_id", "severity", F.array_join("notes", "|").alias("notes"))


def thickness_histogram(spark: SparkSession, d: str) -> DataFrame:
    return calibration.histogram(_scored(spark, d)).select("bin", "n")


def threshold_suggestions(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.suggestions(_scored(spark, d).where(F.col("severity") == "ERROR"))
    return out.select("label", "percentile", F.round("threshold", 6).alias("threshold"), "kept", "median_loc", "median_args", "name")


def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").select("file").distinct()
    tests = ("is_i18n", "is_test", "is_generated", "is_migration", "is_declaration", "is_story", "is_example")
    return files.select("file", *[getattr(calibration, t)(F.col("file")).alias(t) for t in tests])


def inferred_directives(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(calibration.inferred_rules(_loaded(spark, d)))]
    return spark.createDataFrame(rows, calibration.INFERRED_SCHEMA).select("directive", "affects_total", "affects_error", "affects_warning", "affects_info")


def vendored_roots(spark: SparkSession, d: str) -> DataFrame:
    return calibration.vendored_roots(_loaded(spark, d), 3)


def all_passes(spark: SparkSession, d: str) -> DataFrame:
    found = cluster(_defs(spark, d))
    return found.groupBy("pass", F.col("kind.id").alias("kind_id"), "severity").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    own = (
        definition_loc, scan_sources, canonical_forms, pass_named, pass_renamed, pass_type3, named_members, renamed_members, type3_members, name_group_sizes, large_groups, type3_line_weights, type3_cosines,
        component_labels, thickness_scores, severity_ladder, directives_applied, thickness_histogram, threshold_suggestions, path_predicates,
        inferred_directives, vendored_roots, all_passes,
    )
    return {q.__name__: q for q in own}


_DEFS = """
d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY def_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM definitions)
  WHERE rn = 1 AND def_id IS NOT NULL)
"""

_F = """
f AS (
  SELECT * EXCLUDE (members), list_filter(coalesce(members, []), lambda m: m IS NOT NULL AND m.file IS NOT NULL AND m.line IS NOT NULL AND m.col IS NOT NULL) AS members
  FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM findings)
  WHERE rn = 1 AND finding_id IS NOT NULL)
"""

_SCORED = f"{_F}, g AS (SELECT * FROM f WHERE thickness IS NOT NULL AND NOT isnan(thickness))"

_WEIGHTS = f"""
WITH {_DEFS},
l AS (
  SELECT def_id, unnest(analysis.type3_lines) AS line FROM d
  WHERE kind.fn_like AND analysis IS NOT NULL AND len(analysis.type3_lines) >= 3),
o AS (SELECT line, count(*) AS occurrences FROM l WHERE line IS NOT NULL GROUP BY line),
t AS (
  SELECT line, occurrences, unnest(regexp_extract_all(line, '[A-Za-z_][\\p{{L}}\\p{{M}}\\p{{N}}_]*|[0-9]+|[^\\s\\p{{Z}}]')) AS token FROM o),
i AS (
  SELECT token, ln((SELECT sum(occurrences) FROM o) / sum(occurrences)) AS idf
  FROM (SELECT DISTINCT line, occurrences, token FROM t) GROUP BY token),
w AS (SELECT o.line, o.occurrences, coalesce(sum(idf), 0) AS weight FROM o LEFT JOIN t USING (line) LEFT JOIN i USING (token) GROUP BY ALL)
"""

_EDGES = f"""
WITH RECURSIVE {_DEFS},
own AS (SELECT def_id, file, analysis.xname_canonical AS x FROM d WHERE kind.fn_like AND analysis IS NOT NULL),
e AS (
  SELECT min(def_id) OVER (PARTITION BY file) AS a, def_id AS b FROM own WHERE file IS NOT NULL
  UNION SELECT min(def_id) OVER (PARTITION BY x), def_id FROM own WHERE x IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, other) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.id, s.b FROM reach r JOIN s ON s.a = r.other)
SELECT id, min(other) AS label FROM reach GROUP BY id
"""

def _path_sql(p: str) -> dict[str, str]:
    """The path conventions as SQL over a path expression, written out anew."""
    low, base = f"lower({p})", f"list_last(string_split({p}, '/'))"
    named = f"({base} LIKE '%.test.%' OR {base} LIKE '%.spec.%')"
    tests = f"regexp_matches({low}, '/(tests|test|__tests__|test_cases|test-cases|__fixtures__|fixtures|integration|e2e)/')"
    return {
        "is_i18n": f"regexp_matches({low}, '/(locale|locales|i18n|translations)/')",
        "is_test": f"({tests} OR starts_with({base}, 'test_') OR ends_with({base}, '_test.py') OR {named})",
        "is_test_named": named,
        "is_generated": f"(regexp_matches({p}, '(_pb2\\.py|_pb2_grpc\\.py|_grpc\\.py|\\.gen\\.py|\\.generated\\.(ts|tsx|js|jsx))$') OR regexp_matches({p}, '/(_generated|generated|__generated__)/'))",
        "is_migration": f"regexp_matches({p}, '/(migrations|alembic/versions)/')",
        "is_declaration": f"regexp_matches({p}, '\\.d\\.(ts|tsx|mts|cts)$')",
        "is_story": f"contains({base}, '.stories.')",
        "is_example": f"regexp_matches({p}, '/(docs_src|docs/src|examples|example|tutorial|tutorials|samples)/')",
    }


def _inferred_sql() -> str:
    path = _path_sql("p")
    every = {k: f"len(list_filter(files, lambda p: NOT {test})) = 0" for k, test in path.items()}
    rules = (
        (f"kind = 'constants' AND len(files) > 0 AND len(list_filter(files, lambda p: {path['is_i18n']})) / len(files) >= 0.8", 5, "suppress:CONSTANT:*@*locale*=i18n locale tables, duplication is by design"),
        (every["is_i18n"], 5, "suppress:*:*@*/{locale,locales,i18n,translations}/*=i18n / translation tables — per-locale near-duplicates are by design"),
        (every["is_test"], 3, "de-escalate:*:*@*/{test,tests,__tests__,test_cases,test-cases,__fixtures__,fixtures,integration,e2e}/*=test parametrize/fixture candidates — review for conftest"),
        (every["is_test_named"], 3, "de-escalate:*:*@*.{test,spec}.*=test files by .test.* / .spec.* naming"),
        (f"len(list_filter(files, lambda p: {path['is_generated']})) > 0", 3, "suppress:*:*@*_pb2*=generated protobuf/gRPC code, suppress wholesale"),
        (every["is_migration"], 3, "suppress:*:*@*migrations/*=schema migrations are snapshots, not refactor targets"),
        (every["is_example"], 5, "de-escalate:*:*@*/{docs_src,docs/src,examples,example,tutorial,tutorials,samples}/*=tutorial/doc-example code — snippet duplication is expected"),
        (every["is_declaration"], 3, "suppress:*:*@*.d.ts=TypeScript declaration files, type-only duplication is by design"),
        (every["is_story"], 5, "de-escalate:*:*@*.stories.*=Storybook stories — boilerplate duplication is the docstring"),
    )
    counted = [
        f"SELECT '{rule}' AS directive, count(*) AS affects_total, count(*) FILTER (WHERE severity = 'ERROR') AS affects_error, "
        f"count(*) FILTER (WHERE severity = 'WARNING') AS affects_warning, count(*) FILTER (WHERE severity = 'INFO') AS affects_info "
        f"FROM h WHERE {test} HAVING count(*) >= {least}"
        for test, least, rule in rules
    ]
    return f"WITH {_F}, h AS (SELECT kind, severity, list_transform(members, lambda m: m.file) AS files FROM f)\n" + "\nUNION ALL ".join(counted)


_VENDORED = f"""
WITH {_F},
m AS (
  SELECT finding_id, severity, list_distinct(list_transform(members, lambda m: regexp_replace(m.file, '^.*/', ''))) AS names,
         list_distinct(list_transform(members, lambda m: CASE WHEN contains(m.file, '/') THEN regexp_replace(m.file, '/[^/]*$', '') ELSE '' END)) AS dirs
  FROM f),
x AS (SELECT finding_id, severity, unnest(dirs) AS dir FROM m WHERE len(names) = 1 AND len(dirs) >= 2),
y AS (
  SELECT *, 10 * regexp_matches(dir, '/(fixtures|__fixtures__)/')::INT + 5 * regexp_matches(dir, '/(test|tests|__tests__)/')::INT
    + 8 * regexp_matches(dir, '/(vendor|vendored|third_party)/')::INT + CASE WHEN contains(dir, '/util/vs/') THEN 5 WHEN contains(dir, '/util/') THEN 1 ELSE 0 END
    + regexp_matches(dir, '/(extensions|extension)/')::INT AS score FROM x),
z AS (
  SELECT *, first_value(dir) OVER (PARTITION BY finding_id ORDER BY score, len(string_split(dir, '/')), dir) AS source FROM y),
w AS (
  SELECT severity, dir, source, list_reverse(string_split(dir, '/')) AS a, list_reverse(string_split(source, '/')) AS b FROM z WHERE dir <> source AND score > 0),
v AS (
  SELECT severity, source, dir, a, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS shared FROM w),
p AS (
  SELECT severity, source, CASE WHEN shared >= len(a) THEN dir ELSE array_to_string(list_reverse(a[shared + 1:]), '/') END AS prefix FROM v),
q AS (
  SELECT severity, source, prefix, unnest(list_transform(range(1, len(string_split(prefix, '/')) + 1), lambda k: array_to_string(string_split(prefix, '/')[1:k], '/'))) AS anchor
  FROM p WHERE prefix <> ''),
n AS (
  SELECT anchor, min(source) AS source, count(*) AS n, count(*) FILTER (WHERE severity = 'ERROR') AS n_error,
         count(*) FILTER (WHERE severity = 'WARNING') AS n_warning, count(*) FILTER (WHERE severity = 'INFO') AS n_info FROM q GROUP BY anchor HAVING count(*) >= 3),
c AS (SELECT DISTINCT (SELECT n.anchor FROM n WHERE n.anchor = u.prefix OR starts_with(u.prefix, n.anchor || '/') ORDER BY length(n.anchor) DESC LIMIT 1) AS anchor
  FROM (SELECT DISTINCT prefix FROM q) u)
SELECT n.* FROM n JOIN c USING (anchor)
WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.anchor <> n.anchor AND starts_with(o.anchor, n.anchor || '/'))
ORDER BY n DESC, anchor LIMIT 5"""

_TYPE3_CLUSTERS = _WEIGHTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS (SELECT def_id, line, count(*) * any_value(weight) AS w FROM l JOIN w USING (line) WHERE line IS NOT NULL GROUP BY def_id, line),
nm AS (SELECT def_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY def_id),
dots AS (SELECT x.def_id AS a, y.def_id AS b, sum(x.w * y.w) AS dot FROM c x JOIN c y ON x.line = y.line AND x.def_id < y.def_id GROUP BY ALL),
cs AS (
  SELECT a, b, CASE WHEN na.norm * nb.norm > 0 THEN dot / (na.norm * nb.norm) ELSE 0 END AS cosine
  FROM dots JOIN nm na ON na.def_id = a JOIN nm nb ON nb.def_id = b),
own AS (
  SELECT def_id, name, file, line, col, loc, args, kind.id AS kind_id, list_filter(analysis.type3_lines, lambda v: v IS NOT NULL) AS lines FROM d
  WHERE kind.fn_like AND analysis IS NOT NULL AND len(analysis.type3_lines) >= 3 AND name IS NOT NULL),
e AS (
  SELECT a, b FROM cs JOIN own oa ON oa.def_id = a JOIN own ob ON ob.def_id = b
  WHERE cosine > 0.7 AND oa.name <> ob.name AND oa.name <> 'a' || ob.name AND ob.name <> 'a' || oa.name AND oa.lines <> ob.lines),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, other) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.id, s.b FROM reach r JOIN s ON s.a = r.other),
-- copies of a linked definition under the same name belong with it
k AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
lab AS (SELECT o.def_id, min(k.label) AS label FROM own o JOIN own p ON p.lines = o.lines AND p.name = o.name JOIN k ON k.id = p.def_id GROUP BY o.def_id),
least_cs AS (
  SELECT x.label, min(CASE WHEN ox.lines = oy.lines THEN 1 ELSE coalesce(cosine, 0) END) AS min_sim
  FROM lab x JOIN lab y ON x.label = y.label AND x.def_id < y.def_id JOIN own ox ON ox.def_id = x.def_id JOIN own oy ON oy.def_id = y.def_id
  LEFT JOIN cs ON cs.a = x.def_id AND cs.b = y.def_id GROUP BY x.label)"""

_TYPE3 = _TYPE3_CLUSTERS + """,
g AS (
  SELECT label, count(*) AS n, max(loc) AS loc, max(args) AS args, list(DISTINCT name ORDER BY name) AS names,
         list({'file': file, 'line': line, 'col': col, 'kind': kind_id} ORDER BY file, line, col, def_id) AS m
  FROM lab JOIN own USING (def_id) GROUP BY label HAVING count(DISTINCT name) >= 2)
SELECT 'type-3' AS pass,
  CASE WHEN len(list_filter(m, lambda v: v.kind <> 'methods')) = 0 THEN 'methods'
       WHEN len(list_filter(m, lambda v: v.kind = 'functions')) > 0 THEN 'functions' ELSE m[1].kind END AS kind_id,
  array_to_string(names, '/') AS name, CASE WHEN min_sim >= 0.9 THEN 'ERROR' ELSE 'WARNING' END AS severity, round(min_sim, 6) AS min_sim, loc, args,
  round(0.7 * (1 - exp(-(loc * (n - 1)) / 30.0)) + 0.1 * (1 - exp(-args / 5.0)) + 0.2 * min_sim, 6) AS thickness, n::INT AS n,
  array_to_string(list_transform(m, lambda v: concat_ws(':', v.file, v.line + 1, v.col)), ' ') AS members
FROM g JOIN least_cs USING (label)"""


def oracle_sql() -> dict[str, str]:
    paths = [f"{sql} AS {name}" for name, sql in _path_sql("file").items() if name != "is_test_named"]
    renamed = f"""
WITH {_DEFS},
g AS (
  SELECT analysis.xname_canonical AS x, count(*) AS n, max(loc) AS loc, max(args) AS args, list(DISTINCT name ORDER BY name) AS names,
         list({{'file': file, 'line': line, 'col': col, 'kind': kind.id, 'size': analysis.size}} ORDER BY file, line, col, def_id) AS m
  FROM d WHERE kind.fn_like AND analysis.xname_canonical IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT name) >= 2)
SELECT 'cross-name' AS pass,
  CASE WHEN len(list_filter(m, lambda v: v.kind <> 'methods')) = 0 THEN 'methods'
       WHEN len(list_filter(m, lambda v: v.kind = 'functions')) > 0 THEN 'functions' ELSE m[1].kind END AS kind_id,
  array_to_string(names, '/') AS name, CASE WHEN coalesce(m[1].size, 0) >= 20 THEN 'ERROR' ELSE 'WARNING' END AS severity,
  NULL::DOUBLE AS min_sim, loc, args,
  round(0.7 * (1 - exp(-(loc * (n - 1)) / 30.0)) + 0.1 * (1 - exp(-args / 5.0)) + 0.2, 6) AS thickness, n::INT AS n,
  array_to_string(list_transform(m, lambda v: concat_ws(':', v.file, v.line + 1, v.col)), ' ') AS members
FROM g"""
    rules = f"""
WITH {_F},
h AS (
  SELECT *, list_transform(members, lambda m: m.file) AS files FROM f),
x AS (
  SELECT finding_id, severity, coalesce(notes, []) AS notes,
    len(list_filter(files, lambda p: contains(p, '/tests/'))) > 0 AS r0,
    kind = 'functions' AND len(list_filter(files, lambda p: contains(p, '/tools/'))) > 0 AS r1, kind = 'methods' AS r2, kind = 'classes' AS r3
  FROM h)
SELECT finding_id,
  ['ERROR', 'WARNING', 'INFO'][greatest(1, least(3, list_position(['ERROR', 'WARNING', 'INFO'], severity) + r1::INT - r2::INT))] AS severity,
  array_to_string(list_concat(list_concat(notes, CASE WHEN r1 THEN ['tooling'] ELSE [] END), CASE WHEN r3 THEN ['class'] ELSE [] END), '|') AS notes
FROM x WHERE NOT r0"""
    return {
        "definition_loc": f"WITH {_DEFS} SELECT def_id, len(list_filter(string_split(text_orig, chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')))::INT AS lines FROM d WHERE text_orig IS NOT NULL",
        "pass_renamed": renamed,
        "name_group_sizes": f"WITH {_DEFS} SELECT kind.id AS kind_id, name, count(*) AS n FROM d WHERE kind.id IS NOT NULL AND name IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
        "large_groups": f"WITH {_DEFS} SELECT kind.id AS kind_id, name, count(*) AS n FROM d WHERE kind.id IS NOT NULL AND name IS NOT NULL GROUP BY ALL HAVING count(*) >= 64",
        "type3_line_weights": _WEIGHTS + "SELECT line, occurrences, round(weight, 6) AS weight FROM w",
        "type3_cosines": _WEIGHTS
        + """, c AS (SELECT def_id, line, count(*) * any_value(weight) AS w FROM l JOIN w USING (line) GROUP BY def_id, line),
n AS (SELECT def_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY def_id),
p AS (
  SELECT x.def_id AS a, y.def_id AS b, sum(x.w * y.w) AS dot FROM c x JOIN c y ON x.line = y.line AND x.def_id < y.def_id GROUP BY ALL),
q AS (SELECT a, b, dot / (na.norm * nb.norm) AS cosine FROM p JOIN n na ON na.def_id = a JOIN n nb ON nb.def_id = b WHERE na.norm * nb.norm > 0)
SELECT a, b, round(cosine, 6) AS cosine FROM q WHERE cosine > 0.7""",
        "component_labels": _EDGES,
        "thickness_scores": f"""WITH {_F} SELECT finding_id, round(0.7 * (1 - exp(-(loc * (len(members) - 1)) / 30.0)) + 0.1 * (1 - exp(-args / 5.0)) + 0.2 * coalesce(min_sim, 1), 6) AS score
FROM f WHERE len(members) > 0 AND loc IS NOT NULL AND args IS NOT NULL AND NOT isnan(coalesce(min_sim, 1))""",
        "severity_ladder": f"""WITH {_F},
k AS (SELECT * EXCLUDE (thickness), CASE WHEN NOT isnan(thickness) THEN thickness END AS thickness FROM f),
a AS (SELECT *, CASE WHEN severity = 'ERROR' AND thickness < 0.4 THEN 'WARNING' ELSE severity END AS s1 FROM k),
b AS (SELECT *, CASE WHEN s1 = 'WARNING' AND thickness < 0.3 THEN 'INFO' ELSE s1 END AS s2 FROM a)
SELECT finding_id, CASE WHEN s2 <> 'ERROR' AND thickness >= 0.9 THEN 'ERROR' ELSE s2 END AS severity,
  (CASE kind WHEN 'constants' THEN 0 WHEN 'functions' THEN 1 WHEN 'methods' THEN 4 WHEN 'classes' THEN 7 WHEN 'interfaces' THEN 8 WHEN 'type-aliases' THEN 9 END
   + CASE WHEN kind NOT IN ('functions', 'methods') THEN 0 WHEN pass = 'cross-name' THEN 1 WHEN pass = 'type-3' THEN 2 ELSE 0 END)::INT AS section FROM b""",
        "directives_applied": rules,
        "thickness_histogram": f"""WITH {_SCORED}, b AS (SELECT range AS bin FROM range(10)),
h AS (SELECT *, (SELECT max(bin) FROM b WHERE bin * 0.1::DOUBLE <= thickness) AS bin FROM g WHERE thickness >= 0)
SELECT b.bin::INT AS bin, count(h.finding_id) AS n FROM b LEFT JOIN h ON h.bin = b.bin GROUP BY b.bin""",
        "threshold_suggestions": f"""WITH {_SCORED}, e AS (SELECT * FROM g WHERE severity = 'ERROR'),
a AS (SELECT * FROM (VALUES ('permissive', 50), ('balanced', 75), ('strict', 90)) v(label, percentile)),
t AS (SELECT label, percentile, CASE percentile WHEN 50 THEN quantile_cont(thickness, 0.5) WHEN 75 THEN quantile_cont(thickness, 0.75) ELSE quantile_cont(thickness, 0.9) END AS threshold
  FROM a, e GROUP BY label, percentile)
SELECT label, percentile, round(threshold, 6) AS threshold, count(*) AS kept,
  list_sort(list(e.loc))[(count(*) // 2 + 1)::INT] AS median_loc, list_sort(list(e.args))[(count(*) // 2 + 1)::INT] AS median_args,
  list(e.name ORDER BY e.thickness, e.name)[1] AS name
FROM t JOIN e ON e.thickness >= t.threshold GROUP BY label, percentile, threshold""",
        "path_predicates": f"SELECT DISTINCT file, {', '.join(paths)} FROM source_files",
        "inferred_directives": _inferred_sql(),
        "vendored_roots": _VENDORED,
        "pass_type3": _TYPE3,
        "type3_members": _TYPE3_CLUSTERS + " SELECT def_id, label AS cluster, round(min_sim, 6) AS min_sim FROM lab JOIN least_cs USING (label)",
        "renamed_members": f"""WITH {_DEFS},
g AS (
  SELECT def_id, analysis.xname_canonical AS x, name FROM d WHERE kind.fn_like AND analysis.xname_canonical IS NOT NULL),
h AS (SELECT x, min(def_id) AS cluster, count(*) AS n FROM g GROUP BY x HAVING count(*) >= 2 AND count(DISTINCT name) >= 2)
SELECT def_id, cluster, n FROM g JOIN h USING (x)""",
    }
