"""Stage outputs as Parquet or JSON, to be read again later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonewright.functions.model import DEFINITION_SCHEMA, FINDING_SCHEMA
from clonewright.functions.scoring import TYPE3_LEAST_LINES
from clonewright.operators.renamed import callables


def save_definitions(definitions: DataFrame, path: str, form: str = "parquet") -> None:
    definitions.write.format(form).save(path)


def load_definitions(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).schema(DEFINITION_SCHEMA).load(path)


def save_findings(findings: DataFrame, path: str, form: str = "parquet") -> None:
    """Findings without their snippets, which the definitions hold."""
    findings.drop("snippet").write.format(form).save(path)


def load_findings(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Saved findings; the snippet is null."""
    return spark.read.format(form).schema(FINDING_SCHEMA).load(path)


def type3_inputs(definitions: DataFrame) -> DataFrame:
    """(name, type3_lines) of the callables that the third pass compares."""
    own = callables(definitions).where(F.size("analysis.type3_lines") >= TYPE3_LEAST_LINES)
    return own.select("name", F.col("analysis.type3_lines").alias("type3_lines"))


def save_type3_inputs(definitions: DataFrame, path: str, form: str = "parquet") -> None:
    type3_inputs(definitions).write.format(form).save(path)


def load_type3_inputs(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).schema("name string, type3_lines array<string>").load(path)


def save_stages(definitions: DataFrame, findings: DataFrame, folder: str, form: str = "parquet") -> None:
    """Definitions, inputs of the third pass and findings, each in its own folder below ``folder``."""
    save_definitions(definitions, f"{folder}/definitions", form)
    save_type3_inputs(definitions, f"{folder}/type3", form)
    save_findings(findings, f"{folder}/findings", form)
