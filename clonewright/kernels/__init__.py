"""Functions in Java, compiled when first used by the compiler that Spark itself brings along (Janino).

String kernels whose inner loop is a comparison of characters belong inside the
JVM: they are plain expressions of a plan there, without a Python worker. The
sources lie beside this file. The classes go into one jar in the shared folder
and reach the executors as any jar of the session does.
"""

from __future__ import annotations

import io
import uuid
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from clonewright.plans.scratch import remove_at_exit, shared_dir

_READY: weakref.WeakKeyDictionary[SparkSession, dict[str, str]] = weakref.WeakKeyDictionary()
_PACKAGE = "clonewright.kernels"


def _compiled(spark: SparkSession, sources: list[Path]) -> dict[str, bytes]:
    """Class files by name; sources compile as one unit, so that they may use each other."""
    jvm = spark.sparkContext._jvm
    imports, bodies = set(), []
    for source in sources:
        lines = source.read_text(encoding="utf-8").split("\n")
        imports |= {x for x in lines if x.startswith("import ")}
        bodies += [x for x in lines if not x.startswith(("import ", "package "))]
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook("\n".join([f"package {_PACKAGE};", *sorted(imports), *bodies]))
    return {name: bytes(code) for name, code in dict(compiler.getBytecodes()).items()}


def _write(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


def kernel(spark: SparkSession, name: str, returns: DataType | str, folder: Path = Path(__file__).parent) -> Callable[..., Column]:
    """A column function of the class ``name`` among the Java sources of ``folder``; these may use the sources beside this file."""
    known = _READY.setdefault(spark, {})
    key = f"{folder}:{name}"
    if key not in known:
        sources = sorted({*Path(__file__).parent.glob("*.java"), *folder.glob("*.java")})
        jar = f"{shared_dir(spark)}/clonewright/{uuid.uuid4().hex}.jar"
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for each, code in _compiled(spark, sources).items():
                z.writestr(each.replace(".", "/") + ".class", code)
        _write(spark, jar, packed.getvalue())
        remove_at_exit(spark, jar)
        spark.sql(f"ADD JAR '{jar}'")
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        loader = spark._jsparkSession.artifactManager().classloader()
        for source in folder.glob("*.java"):
            found = jvm.java.lang.Class.forName(f"{_PACKAGE}.{source.stem}", True, loader)
            if any(i.getName().startswith("org.apache.spark.sql.api.java.UDF") for i in found.getInterfaces()):
                made = found.getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
                known[f"{folder}:{source.stem}"] = made
    made = known[key]
    function = f"clonewright_{name}"
    kind = returns if isinstance(returns, str) else returns.simpleString()
    spark._jsparkSession.udf().register(function, made, spark._jsparkSession.parseDataType(DataType.fromDDL(kind).json()))
    return lambda *columns: F.call_udf(function, *columns)
