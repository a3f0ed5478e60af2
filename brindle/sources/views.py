"""The two study tables as views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.text import extract_year

PROTEINS = [f"p{i:02d}" for i in range(64)]
FACTORS = ["Genotype", "Treatment", "Behavior", "class"]
# Fixed positions of the columns with many nulls in the expression view.
SPARSE = (5, 17, 29, 41, 53, 61)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """movieId, title, genres: the dimension behind the ratings."""
    key = F.col("p_partkey")
    year = (F.lit(1950) + key % 60).cast("int").cast("string")
    title = F.when(key % 97 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), year, F.lit(")")))
    return table(spark, folder, "part").select(key.alias("movieId"), title.alias("title"),
                                               F.concat("p_type", F.lit("|"), "p_brand").alias("genres"))


def ratings(spark: SparkSession, folder: str, dim: DataFrame | None = None) -> DataFrame:
    """row_id, userId, movieId, rating and the columns of the dimension: one row per line item."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                    "l_quantity", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    row_id = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in
                                      ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                               F.col("l_quantity").cast("int").cast("string"),
                               F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")))
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    dim = items(spark, folder) if dim is None else dim
    # the digest comes after the joins: its text would weigh more in a shuffle than the numbers it is made of
    return (facts.join(dim, F.col("l_partkey") == F.col("movieId"))
            .select(row_id.alias("row_id"), F.col("o_custkey").alias("userId"), "movieId",
                    (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"), *[c for c in dim.columns if c != "movieId"]))


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """``ratings`` with the year, taken from the title once per item rather than once per row."""
    return ratings(spark, folder, items(spark, folder).withColumn("year", extract_year(F.col("title"))))


def movies(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension: every item, rated or not."""
    return items(spark, folder)


def proteins(spark: SparkSession, folder: str) -> DataFrame:
    """MouseID, p00..p63 with nulls in places, and four label columns."""
    vec, label = F.col("vec_id"), F.col("label").cast("bigint")

    def level(i: int):
        gap = "vec_id % 3 = 0" if i in SPARSE else f"(vec_id * 31 + {i * 7}) % 53 = 0"
        return F.expr(f"CASE WHEN NOT ({gap}) THEN cast(embedding[{i}] AS double) END AS {PROTEINS[i]}")

    return table(spark, folder, "embeddings").select(
        vec.alias("MouseID"), *[level(i) for i in range(len(PROTEINS))],
        (label % 2).alias("Genotype"), (F.floor(label / 2) % 2).alias("Treatment"),
        (F.floor(label / 4) % 2).alias("Behavior"), label.alias("class"))
