"""Streams give what batches give; plans read and shuffle only what they need."""

import re

from clonewright import queries
from clonewright.operators.renamed import renamed_findings
from clonewright.functions.model import DEFINITION_SCHEMA
from clonewright.sources.walk import scan
from clonewright.streaming.incremental import copy_counts, write_definitions


def test_stream_scans_like_a_batch(spark, tmp_path):
    schema = "lang string, file string, content string"
    text = "def {0}(a, b):\n    c = a + b\n    return c * 2\n"
    for k, name in enumerate("fgh"):
        spark.createDataFrame([("py", f"{name}.py", text.format(name)), ("py", f"null{k}.py", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    write_definitions(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    batch = scan(spark.read.parquet(str(tmp_path / "in")))
    out = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect())) and out.count() == 3
    counts = copy_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "out")))
    run = counts.writeStream.outputMode("complete").format("memory").queryName("copies").start()
    run.processAllAvailable()
    run.stop()
    assert [r.n for r in spark.table("copies").collect()] == [3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_renamed_pass_shuffles_no_text(spark, tmp_path):
    spark.createDataFrame([], DEFINITION_SCHEMA).write.parquet(str(tmp_path / "definitions.parquet"))
    text = plan(renamed_findings(spark.read.parquet(str(tmp_path / "definitions.parquet"))))
    assert "type3_lines" not in " ".join(re.findall(r"ReadSchema: (.*)", text))
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


def test_every_query_has_a_name_of_its_own():
    assert set(queries.oracle_sql()) <= set(queries.queries())
