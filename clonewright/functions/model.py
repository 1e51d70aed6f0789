"""Schemas, the kind vocabulary, and the definition table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIND_TYPE = "struct<id:string,label:string,noun_plural:string,section:int,body:boolean,fn_like:boolean>"
ANALYSIS_TYPE = "struct<xname_canonical:string,type3_lines:array<string>,size:int>"
MEMBER_TYPE = "struct<file:string,line:int,col:int>"

#: What a frontend yields for one file; ``ordinal`` keeps the order of definitions that start at one place.
SCAN_SCHEMA = (
    f"lang string, kind {KIND_TYPE}, name string, file string, line int, col int, ordinal int, loc int, args int, "
    f"text_orig string, cluster_canonical string, analysis {ANALYSIS_TYPE}"
)
DEFINITION_SCHEMA = SCAN_SCHEMA.replace("lang string", "def_id long, lang string", 1).replace("ordinal int, ", "")
FINDING_SCHEMA = (
    f"pass string, kind {KIND_TYPE}, name string, severity string, min_sim double, loc int, args int, thickness double, "
    f"snippet string, notes array<string>, members array<{MEMBER_TYPE}>"
)


@dataclass(frozen=True)
class Kind:
    """One kind of definition: its report section, and whether bodies and callables are compared."""

    id: str
    label: str
    noun_plural: str
    section: int
    body: bool
    fn_like: bool


# The kind vocabulary and the order of the report sections.
KINDS = {
    k.id: k
    for k in (
        Kind("constants", "CONSTANT", "constants", 0, False, False),
        Kind("functions", "FUNCTION", "functions", 1, True, True),
        Kind("methods", "METHOD", "methods", 4, True, True),
        Kind("classes", "CLASS", "classes", 7, True, False),
        Kind("interfaces", "INTERFACE", "interfaces", 8, True, False),
        Kind("type-aliases", "TYPE_ALIAS", "type aliases", 9, False, False),
    )
}


def kind_column(kind_id: Column) -> Column:
    """The kind struct of a kind id; ids outside the vocabulary give null."""
    out = F.lit(None)
    for k in KINDS.values():
        value = F.struct(
            F.lit(k.id).alias("id"), F.lit(k.label).alias("label"), F.lit(k.noun_plural).alias("noun_plural"),
            F.lit(k.section).alias("section"), F.lit(k.body).alias("body"), F.lit(k.fn_like).alias("fn_like"),
        )
        out = F.when(kind_id == k.id, value).otherwise(out)
    return out


def with_def_ids(scanned: DataFrame) -> DataFrame:
    """Scanned definitions with ``def_id``, rising with (file, line, col, ordinal).

    Range partitioning keeps the numbering distributed: the id holds the
    partition and the place within it. Materialise the result before use.
    """
    ordered = scanned.repartitionByRange("file", "line", "col", "ordinal").sortWithinPartitions("file", "line", "col", "ordinal")
    return ordered.withColumn("def_id", F.monotonically_increasing_id()).drop("ordinal")


def distinct_definitions(definitions: DataFrame) -> DataFrame:
    """One row per ``def_id``, the last ingested. Rows without an id are left out.

    The newest row is found on (id, time, row hash) alone, so texts are not
    shuffled for it unless an id really has several rows.
    """
    if "ingested_at" not in definitions.columns:
        return definitions.where(F.col("def_id").isNotNull()).dropDuplicates(["def_id"])
    newest = Window.partitionBy("def_id").orderBy(F.col("ingested_at").desc_nulls_last())
    keys = definitions.where(F.col("def_id").isNotNull()).select("def_id", "ingested_at")
    doubled = keys.groupBy("def_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("def_id")
    once = definitions.where(F.col("def_id").isNotNull()).join(doubled, "def_id", "left_anti")
    several = definitions.join(doubled, "def_id", "left_semi").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") == 1).drop("_k")
    return once.unionByName(several)
