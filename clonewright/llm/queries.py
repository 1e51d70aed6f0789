"""The queries pN_... of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonewright.sources.tables import table

from . import components, cutoffs, formatting, leaks, levels, neardup, packing, sourcefiles, spans, terms
from .common import field_values

Query = Callable[[SparkSession, str], DataFrame]


def _p1_marked(spark: SparkSession, d: str) -> DataFrame:
    return sourcefiles.not_handwritten(table(spark, d, "source_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_marked(spark, d).select("file")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _p1_marked(spark, d).select("file", F.explode("reasons").alias("reason"))


def p1_handwritten(spark: SparkSession, d: str) -> DataFrame:
    kept = sourcefiles.handwritten_definitions(table(spark, d, "definitions"), _p1_marked(spark, d))
    return kept.select("def_id", "lang", "file").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.named_groups(components.finding_links(table(spark, d, "findings")))


def _p3_near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    fields = {"text_orig": F.col("text_orig"), "cluster_canonical": F.col("cluster_canonical")}
    return neardup.NearDuplicates(field_values(table(spark, d, "definitions"), fields), run=3, threshold=0.6, min_words=20)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_near(spark, d).record_pairs()


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _p3_near(spark, d).clusters()


def _p4_terms(spark: SparkSession, d: str) -> DataFrame:
    lines = F.col("analysis.type3_lines")
    rows = table(spark, d, "definitions").where(F.col("def_id").isNotNull() & (F.size(lines) >= 3))
    return terms.TermTable(rows.select(F.col("def_id").alias("id"), lines.alias("lines")).dropDuplicates(["id"])).scored()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.best_terms(_p4_terms(spark, d), "rarity").select(F.col("id").alias("def_id"), "term")


def p4_residuals(spark: SparkSession, d: str) -> DataFrame:
    best = terms.best_terms(_p4_terms(spark, d), "adjusted")
    return best.select(F.col("id").alias("def_id"), "term", F.round("score", 6).alias("adjusted"))


def _p5_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scores = cutoffs.latest_findings(table(spark, d, "findings"))
    cuts = cutoffs.cutoffs(scores, table(spark, d, "keep_targets"), ["kind", "severity"], "thickness", "keep_permille")
    return scores, cuts


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scores, cuts = _p5_parts(spark, d)
    return cutoffs.kept(scores, cuts, ["kind", "severity"], "thickness").select("finding_id")


def p5_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    _, cuts = _p5_parts(spark, d)
    return cuts.select("kind", "severity", "permille", "cutoff", "n", "n_kept")


def _p6_spans(spark: SparkSession, d: str) -> DataFrame:
    fields = {"text_orig": F.col("text_orig"), "type3_lines": F.array_join("analysis.type3_lines", "\n")}
    return spans.shared_spans(field_values(table(spark, d, "definitions"), fields))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6_spans(spark, d).select("field", "def_id")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p6_spans(spark, d)


def _p7_values(spark: SparkSession, d: str) -> DataFrame:
    fields = {"text_orig": F.col("text_orig"), "xname_canonical": F.col("analysis.xname_canonical")}
    return field_values(table(spark, d, "definitions"), fields)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapse(_p7_values(spark, d)).where(F.col("def_id") > F.col("keep_id")).select("field", "keep_id", "def_id")


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(_p7_values(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_beside_buckets(packing.packing(table(spark, d, "documents"), table(spark, d, "pack_limits")))


def _p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return _p9_leaks(spark, d)


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a leaked passage."""
    return leaks.without_leaks(table(spark, d, "documents"), _p9_leaks(spark, d)).where(F.col("doc_id").isNotNull()).select("doc_id").distinct()


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their leaked spans cut out: how many words went, and how many are left."""
    cut = leaks.without_spans(table(spark, d, "documents"), _p9_leaks(spark, d))
    left = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))
    return cut.where(F.col("n_removed") > 0).select("doc_id", "n_removed", left.alias("n_left"))


def p9_joined(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``p9_spans`` by the join that larger item sets take."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), most_characters=0)


def _p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    out = _p10_levels(spark, d)
    return out.select("doc_id", "language", "n_words", "n_sentences", *[F.round(g, 6).alias(g) for g in (*levels.GRADES, "grade")], "level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return levels.level_profile(_p10_levels(spark, d))


def p10_agreement(spark: SparkSession, d: str) -> DataFrame:
    return levels.agreement(spark, _p10_levels(spark, d), table(spark, d, "level_labels"))


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Agreement on the half of the labelled texts that the borders were not fitted to; copies of a text are on one side."""
    documents = table(spark, d, "documents")
    side = documents.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("_side"))
    labels = table(spark, d, "level_labels").join(side, "doc_id")
    fitted = levels.reading_levels(documents, labels.where("_side = 0").drop("_side"))
    return levels.agreement(spark, fitted, labels.where("_side = 1").drop("_side"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_reasons": p1_reasons,
        "p1_handwritten": p1_handwritten,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_clusters": p3_clusters,
        "p4_found": p4_found,
        "p4_residuals": p4_residuals,
        "p5_found": p5_found,
        "p5_cutoffs": p5_cutoffs,
        "p6_found": p6_found,
        "p6_shares": p6_shares,
        "p7_found": p7_found,
        "p7_copies": p7_copies,
        "p8_containers": p8_containers,
        "p8_fill": p8_fill,
        "p9_found": p9_found,
        "p9_spans": p9_spans,
        "p9_joined": p9_joined,
        "p9_kept": p9_kept,
        "p9_cut": p9_cut,
        "p10_levels": p10_levels,
        "p10_profile": p10_profile,
        "p10_agreement": p10_agreement,
        "p10_held_out": p10_held_out,
    }


_LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM findings)
  WHERE rn = 1 AND finding_id IS NOT NULL)
"""

_CUTS = f"""
WITH {_LATEST},
scored AS (
  SELECT f.finding_id, f.kind, f.severity, f.thickness, t.keep_permille,
         count(*) OVER (PARTITION BY f.kind, f.severity) AS n,
         count(*) OVER (PARTITION BY f.kind, f.severity ORDER BY f.thickness DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM latest f JOIN keep_targets t ON f.kind = t.kind AND f.severity = t.severity
  WHERE f.thickness IS NOT NULL AND NOT isnan(f.thickness)),
cuts AS (
  SELECT kind, severity, max(thickness) AS cutoff FROM scored
  WHERE reached * 1000 >= n * keep_permille GROUP BY kind, severity)
"""

_TERMS_4 = """
WITH l AS (
  SELECT def_id, any_value(analysis.type3_lines) AS lines FROM definitions WHERE len(analysis.type3_lines) >= 3 GROUP BY def_id),
t AS (SELECT def_id, unnest(regexp_extract_all(array_to_string(lines, chr(10)), '[A-Za-z_][A-Za-z0-9_]*')) AS term FROM l),
c AS (SELECT def_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (
  SELECT *, count(*) OVER (PARTITION BY term) AS d, sum(tf) OVER (PARTITION BY term) AS col_total,
         sum(tf) OVER (PARTITION BY def_id) AS row_total, sum(tf) OVER () AS total, (SELECT count(*) FROM l) AS n FROM c),
x AS (
  SELECT *, round(tf * ln(n / d), 6) AS rarity, row_total * col_total / total AS e,
         sqrt((1 - row_total / total) * (1 - col_total / total)) AS spread FROM s),
"""

_RUNS_6 = """
WITH v AS (
  SELECT DISTINCT 'text_orig' AS field, def_id, text_orig AS value FROM definitions WHERE text_orig IS NOT NULL
  UNION SELECT DISTINCT 'type3_lines', def_id, array_to_string(analysis.type3_lines, chr(10)) FROM definitions WHERE analysis.type3_lines IS NOT NULL),
r AS (SELECT field, def_id, length(value) AS n_chars, start, md5(substring(value, start::INT, 240)) AS h
  FROM v, range(1, length(value) - 238) t(start) WHERE length(value) >= 240),
twice AS (SELECT field, h FROM r GROUP BY ALL HAVING min(def_id) < max(def_id)),
hit AS (SELECT r.* FROM r JOIN twice USING (field, h))
"""

_FOUND_7 = """
WITH v AS (
  SELECT DISTINCT 'text_orig' AS field, def_id, text_orig AS value FROM definitions WHERE text_orig IS NOT NULL
  UNION SELECT DISTINCT 'xname_canonical', def_id, analysis.xname_canonical FROM definitions WHERE analysis.xname_canonical IS NOT NULL),
w AS (SELECT field, def_id, list_sort(regexp_extract_all(lower(value), '[a-z0-9_]+')) AS c FROM v),
k AS (SELECT field, def_id, c, min(def_id) OVER (PARTITION BY field, c) AS keep_id FROM w WHERE len(c) >= 8)
"""

_FOUND_3 = """
WITH v AS (
  SELECT DISTINCT 'text_orig' AS field, def_id, text_orig AS value FROM definitions WHERE text_orig IS NOT NULL
  UNION SELECT DISTINCT 'cluster_canonical', def_id, cluster_canonical FROM definitions WHERE cluster_canonical IS NOT NULL),
w AS (SELECT field, def_id, regexp_extract_all(lower(value), '[a-z0-9_]+') AS w FROM v),
s AS (
  SELECT DISTINCT field, def_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS runs
  FROM w WHERE len(w) >= 20),
g AS (SELECT field, def_id, len(runs) AS n, unnest(runs) AS run FROM s),
p AS (
  SELECT a.field, a.def_id AS def_id_a, b.def_id AS def_id_b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS either
  FROM g a JOIN g b ON a.field = b.field AND a.run = b.run AND a.def_id < b.def_id
  WHERE least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY ALL)
"""

_RUNS_9 = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM dw WHERE len(w) >= 13),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM iw WHERE len(w) >= 13)
"""


_SPANS_9 = """
WITH dw AS (SELECT doc_id, any_value(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
iw AS (SELECT item_id, any_value(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM eval_items WHERE text IS NOT NULL GROUP BY item_id),
dg AS (SELECT doc_id, i AS a, array_to_string(w[i:i + 12], ' ') AS g FROM dw, range(1, len(w) - 11) t(i) WHERE len(w) >= 13),
ig AS (SELECT item_id, i AS b, array_to_string(w[i:i + 12], ' ') AS g FROM iw, range(1, len(w) - 11) t(i) WHERE len(w) >= 13),
met AS (SELECT doc_id, item_id, a, a - b AS diagonal FROM dg JOIN ig USING (g)),
island AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY a) AS stretch FROM met),
spans AS (
  SELECT DISTINCT doc_id, item_id, (min(a) - 1)::INT AS first_word, (count(*) + 12)::INT AS n_words FROM island GROUP BY doc_id, item_id, diagonal, stretch)
"""

_CLUSTERS_3 = _FOUND_3.replace("WITH v AS", "WITH RECURSIVE v AS", 1) + """,
e AS (SELECT field, def_id_a AS a, def_id_b AS b FROM p WHERE common >= 0.6 * either),
ends AS (SELECT field, a, b FROM e UNION ALL SELECT field, b, a FROM e),
reach(field, id, other) AS (SELECT DISTINCT field, a, a FROM ends UNION SELECT r.field, r.id, o.b FROM reach r JOIN ends o ON o.field = r.field AND o.a = r.other),
lab AS (SELECT field, id, min(other) AS label FROM reach GROUP BY ALL),
deg AS (SELECT field, a AS id, count(DISTINCT b) AS n FROM ends GROUP BY ALL)
SELECT s.field, s.def_id, coalesce(label, s.def_id) AS cluster, coalesce(n, 0) AS n_links
FROM s LEFT JOIN lab ON lab.field = s.field AND lab.id = s.def_id LEFT JOIN deg ON deg.field = s.field AND deg.id = s.def_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
WITH RECURSIVE {_LATEST},
m AS (
  SELECT DISTINCT finding_id, concat_ws(':', x.file, x.line, x.col) AS member
  FROM (SELECT finding_id, unnest(members) AS x FROM latest)
  WHERE x IS NOT NULL AND x.file IS NOT NULL AND x.line IS NOT NULL AND x.col IS NOT NULL),
reach(member, other) AS (
  SELECT DISTINCT member, member FROM m
  UNION
  SELECT r.member, b.member FROM reach r JOIN m a ON a.member = r.other JOIN m b ON b.finding_id = a.finding_id)
SELECT member, min(other) AS group_member FROM reach GROUP BY member""",
        "p3_found": _FOUND_3 + "SELECT field, def_id_a, def_id_b FROM p WHERE common >= 0.6 * either",
        "p4_found": _TERMS_4
        + "o AS (SELECT *, row_number() OVER (PARTITION BY def_id ORDER BY rarity DESC, term) AS k FROM x) SELECT def_id, term FROM o WHERE k = 1",
        "p5_found": _CUTS
        + "SELECT s.finding_id FROM scored s JOIN cuts c ON s.kind = c.kind AND s.severity = c.severity WHERE s.thickness >= c.cutoff",
        "p5_cutoffs": _CUTS
        + """SELECT s.kind, s.severity, any_value(keep_permille) AS permille, any_value(c.cutoff) AS cutoff, any_value(n) AS n,
  count(*) FILTER (WHERE s.thickness >= c.cutoff) AS n_kept
FROM scored s JOIN cuts c ON s.kind = c.kind AND s.severity = c.severity GROUP BY s.kind, s.severity""",
        "p6_found": _RUNS_6 + "SELECT DISTINCT field, def_id FROM hit",
        "p6_shares": _RUNS_6
        + """, gaps AS (
  SELECT *, start - lag(start) OVER (PARTITION BY field, def_id ORDER BY start) AS gap FROM (SELECT DISTINCT field, def_id, n_chars, start FROM hit))
SELECT field, def_id, any_value(n_chars)::INT AS n_chars, sum(CASE WHEN gap IS NULL THEN 240 ELSE least(gap, 240) END)::BIGINT AS n_shared,
  count(*) FILTER (WHERE gap IS NULL OR gap > 240) AS n_spans FROM gaps GROUP BY field, def_id""",
        "p7_found": _FOUND_7 + "SELECT field, keep_id, def_id FROM k WHERE def_id > keep_id",
        "p7_copies": _FOUND_7 + "SELECT field, keep_id, count(DISTINCT def_id) AS copies FROM k GROUP BY field, keep_id, c",
        "p3_clusters": _CLUSTERS_3,
        "p4_residuals": _TERMS_4
        + """r AS (SELECT def_id, term, CASE WHEN spread > 0 THEN (tf - e) / sqrt(e) / spread ELSE 0 END AS adjusted FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY def_id ORDER BY adjusted DESC, term) AS k FROM r)
SELECT def_id, term, round(adjusted, 6) AS adjusted FROM o WHERE k = 1""",
        "p9_spans": _SPANS_9 + "SELECT * FROM spans",
        "p9_joined": _SPANS_9 + "SELECT * FROM spans",
        "p9_kept": _SPANS_9 + "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM spans)",
        "p9_cut": _SPANS_9
        + """, hit AS (SELECT doc_id, count(DISTINCT i) AS n FROM spans, range(first_word, first_word + n_words) t(i) GROUP BY doc_id)
SELECT doc_id, n::INT AS n_removed, (len(w) - n)::INT AS n_left FROM hit JOIN dw USING (doc_id)""",
        "p9_found": _RUNS_9 + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    }
