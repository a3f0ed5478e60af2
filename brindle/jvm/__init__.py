"""Kernels that run inside Spark's own tasks: Java sources compiled once per application by the compiler that Spark itself uses.

Only the driver compiles. The classes go to the executors as a jar of the session, so nothing needs to be installed there.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import threading
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCK = threading.Lock()
_LOADERS: dict[tuple[str, str], object] = {}  # class loaders, by application and source


def instance(spark: SparkSession, source: str, kind: str):
    """A new object of the class ``kind`` of ``source``.java."""
    with _LOCK:
        place = spark.conf.get("spark.app.id", "local"), source
        if place not in _LOADERS:
            compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
            compiler.cook(pkgutil.get_data(__name__, f"{source}.java").decode())
            jar = os.path.join(tempfile.mkdtemp(prefix="brindle-jvm-"), f"{source.lower()}.jar")
            with zipfile.ZipFile(jar, "w") as out:
                for name, code in compiler.getBytecodes().items():
                    out.writestr(name.replace(".", "/") + ".class", bytes(code))
            spark.sql(f"ADD JAR '{jar}'")
            _LOADERS[place] = compiler.getClassLoader()
    return _LOADERS[place].loadClass(f"brindle.{kind}").newInstance()


def function(spark: SparkSession, source: str, kind: str, returns: str) -> Callable[..., Column]:
    """The class as a function of columns."""
    made, name = instance(spark, source, kind), f"brindle_{kind.lower()}"
    spark._jsparkSession.udf().register(name, made, _type(spark, returns))
    return lambda *columns: F.call_function(name, *columns)


def over_partitions(df: DataFrame, made, schema: str) -> DataFrame:
    """The rows of ``schema`` that an object of a class over whole partitions makes of those of ``df``."""
    spark = df.sparkSession
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(_type(spark, schema))
    return DataFrame(df._jdf.mapPartitions(made, encoder), spark)


def _type(spark: SparkSession, ddl: str):
    types = spark.sparkContext._jvm.org.apache.spark.sql.types
    return types.DataType.fromDDL(ddl)
