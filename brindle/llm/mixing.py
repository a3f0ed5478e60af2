"""Mixing sources to target weights.

Every document gets a random key, a hash of its id. Documents are range-sorted by source and key,
token counts are summed along that order in two levels (inside a range partition, then over the
partitions of a source), and each source is cut at its budget; a budget above the source's size
repeats it. A source may hold any share of the rows: its range is spread over many partitions.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own and the
last; a null id is ordered like the text ``null``; repeated rows count as often as they occur;
empty input gives no rows; columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brindle.llm.tables import stage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, ceiling: float) -> DataFrame:
    """``target`` per source: ``share`` of all words dealt by ``weight``, none above ``ceiling`` sizes.

    Sources at their ceiling leave the deal and the rest is dealt again, until none is above. Only
    three sums reach the driver per turn.
    """
    top = F.col("source_size") * F.lit(ceiling)
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > top
        total, fixed, weights = sources.agg(F.sum("source_size"), F.sum(F.when(above, top)),
                                            F.sum(F.when(~above, F.col("weight")))).first()
        # The same sources are above again once the level stays: then nothing is left to deal again.
        again = ((total or 0) * share - (fixed or 0.0)) / weights if weights else level
        if again <= level:
            break
        level = again
    dealt = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(dealt > top, top).otherwise(dealt).cast("double"))


def take_plan(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
              weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per document: ``key``, tie (hash of the text), size, source_size, target, taken."""
    spark = docs.sparkSession
    rank_key = F.md5(F.concat_ws("#", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(str(seed))))
    sized = stage(docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), rank_key.alias("r"),
                              F.xxhash64(text).alias("tie"), word_count(F.col(text)).alias("size")), "mix-sizes")
    order = [F.col("r"), F.col("tie")]
    ranged = stage(sized.repartitionByRange(F.col("s").asc_nulls_last(), *order)
                   .withColumn("part", F.spark_partition_id()), "mix-ranges")

    # (partition, source) sums: as many rows as range partitions and sources together
    parts = stage(ranged.groupBy("part", "s").agg(F.sum("size").alias("n")), "mix-parts")
    before = F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", "s", before.alias("offset"))

    # the place of a source among all: those of earlier partitions, then those that start in the same one
    own = parts.groupBy("s").agg(F.sum("n").alias("source_size"), F.min("part").alias("first"))
    starts = own.groupBy("first").agg(F.count("*").alias("c"))
    earlier = starts.select("first", F.coalesce(F.sum("c").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)),
                                                F.lit(0)).alias("earlier"))
    place = F.col("earlier") + F.row_number().over(W.partitionBy("first").orderBy(F.col("s").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = stage(own.join(earlier, "first").withColumn("weight", weight).select("s", "source_size", "weight"), "mix-sources")
    goals = targets(sources, share, ceiling)

    o, g = offsets.alias("o"), goals.alias("g")
    bounds = (o.join(g, F.col("o.s").eqNullSafe(F.col("g.s")))
              .select("o.part", F.col("o.s").alias("bs"), "o.offset", "g.source_size", "g.target"))
    inside = F.sum("size").over(W.partitionBy("part", "s").orderBy(*order, "k").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    summed = ranged.withColumn("inside", inside)
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("offset") - F.col("inside"), F.col("size")))
    return (summed.join(bounds.withColumnRenamed("part", "bp"), (F.col("part") == F.col("bp")) & F.col("s").eqNullSafe(F.col("bs")))
            .withColumn("budget", budget).withColumn("epochs", epochs)
            .select(F.col("k").alias(key), "tie", "size", "source_size", "target", taken.cast("long").alias("taken")))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document comes once for every whole time it is taken; the one document of a source in which
    the budget ends also comes cut to the words that are still taken. Rows that agree in id and text
    are one document whose takes add up.
    """
    cols = docs.columns
    plan = (take_plan(docs, key=key, text=text, **options).groupBy(F.col(key).alias("__k"), F.col("tie").alias("__t"))
            .agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count("*").alias("__rows")).where("__taken > 0"))
    one = docs.withColumn("__tie", F.xxhash64(text))
    joined = one.join(plan, one[key].eqNullSafe(F.col("__k")) & (F.col("__tie") == F.col("__t")))
    joined = joined.where("__rows = 1").unionByName(joined.where("__rows > 1").dropDuplicates(["__k", "__t"]))
    pieces = F.expr("transform(sequence(1, cast(ceil(__taken / __size) as int)), i -> least(__size, __taken - (i - 1) * __size))")
    out = joined.withColumn("__words", F.explode(pieces))
    # each word with the white space before it, so that the first of them make up a prefix of the text
    steps = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(steps, F.lit(1), F.col("__words").cast("int")), "")
    cut = F.when(F.col("__words") < F.col("__size"), head).otherwise(F.col(text))
    out = out.withColumn(text, cut)
    if n_chars in cols:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*cols)
