"""Text inputs: many-character separators, and wide tables with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from brindle.functions.text import split_fixed


def scan_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "::") -> DataFrame:
    """Rows of separated text with no quoting rules; an empty text field is an empty string."""
    df = spark.read.csv(path, sep=sep, quote="", schema=schema)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts})


def scan_lines(spark: SparkSession, path: str, names: list[str], sep: str = "::") -> DataFrame:
    """Each line in exactly ``len(names)`` text columns; the last keeps the rest."""
    pieces = split_fixed(F.col("value"), sep, len(names))
    return spark.read.text(path).select(*[p.alias(n) for p, n in zip(pieces, names)])


def scan_wide(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV table with a header. Types are inferred in an extra pass unless ``schema`` is given."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)
