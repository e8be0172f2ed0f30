"""Java functions of this folder, compiled at the driver by the compiler that Spark itself brings and sent to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: what is ready, by application
_READY: dict[str, dict[str, object]] = {}


def grown(spark: SparkSession, packed: Column) -> Column:
    """The trees of a sample that ``Boosted.packed`` gave, as ``Boosted.taken`` reads them."""
    return _function(spark, "trees", "spanloom.Trees", packed)


def _function(spark: SparkSession, file: str, name: str, arg: Column) -> Column:
    called, app, jvm = f"spanloom_{file}", spark.sparkContext.applicationId, spark.sparkContext._jvm
    if app not in _READY:
        _READY.clear()  # of applications that have ended
    ready = _READY.setdefault(app, {})
    if file not in ready:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / f"{file}.java").read_text())
        jar = Path(tempfile.mkdtemp(prefix="spanloom-")) / f"{called}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for cls, code in dict(compiler.getBytecodes()).items():
                z.writestr(cls.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{jar}'")
        ready[file] = compiler.getClassLoader().loadClass(name).newInstance()
    spark._jsparkSession.udf().register(called, ready[file], spark._jsparkSession.parseDataType('"binary"'))
    return F.call_function(called, arg)
