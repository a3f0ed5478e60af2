"""From raw documents to packed training sequences, in five stages that are each written and read again.

A stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the columns of
``docs``. Every stage works on all rows that the one before kept.

Defined results: a document without a letter (also an empty or null text) is no language and goes, and so does one whose
score is below half of the least of all held-out documents of known, rightly predicted language; of
rows that repeat an id and a text one stays; a null id is an id of its own, and its rows are never
near-duplicates that go; an empty table passes through as an empty table; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import exact_dedup, language_id, mixing, near_dedup, packing
from brindle.llm.tables import hash_mod, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the machines tell: with a letter, and not far below all held-out rows in score. A missing ``lang`` is filled."""
    return language_id.of_known_language(docs, hash_mod("doc_id", 3) == 1)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id, once."""
    verdict = stage(exact_dedup.exact_dedup(*exact_dedup.split_by_hash(docs)), "pipeline-exact")
    gone = verdict.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.lit(True).alias("__gone")).distinct()
    again = verdict.where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).count().where("count > 1")
    marked = gone.unionByName(again.select("__id", "__sha", F.lit(False).alias("__gone")))
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    rows = docs.withColumn("__text_sha", sha)
    # the copies grow with the corpus, so rows meet them in a sorted merge at every size
    marked = marked.hint("merge")
    rows = rows.join(marked, rows["doc_id"].eqNullSafe(marked["__id"]) & (rows["__text_sha"] == marked["__sha"]), "left")
    once = rows.where("not __gone").dropDuplicates(["__id", "__sha"])
    return rows.where("__gone IS NULL").select(*docs.columns).unionByName(once.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shared runs of five words, at 0.8 or more."""
    verdict = near_dedup.near_duplicates(docs, size=5, percent=80)
    gone = stage(verdict.where("not kept and doc_id is not null").select("doc_id").distinct(), "pipeline-near")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut off where a source's budget ends."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, by place on the curve, with a checksum of their token ids."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
