"""Exact duplicates against an immutable snapshot and inside a new batch.

``build_snapshot`` writes a snapshot once: its exact buckets (digest, smallest id, rows, text) and its filters. The
distinct digests are dealt over shards by their first bits; each shard gets a static 3-wise binary fuse filter (Graf
and Lemire 2022) of 16-bit fingerprints. ``dedup_batch`` reads only these, for as many batches as come. A batch is
first grouped by digest, so each digest is screened once however often it occurs; the digests of a shard are dealt to as many tasks
as they need, each with a copy of the shard's filter. A digest that the filter rejects is certainly new; one that passes joins
the snapshot's buckets, and the bytes of one text of either side are compared. Rows of a hot digest are spread by a salt in the last join.

Defined results: a null text is the empty text; a null id is never the smallest unless the group has
no other; rows that repeat the smallest id all count as the row that stays; an empty snapshot or
batch gives only the other's groups; a very long text is digested and compared as one string, by the engine's own functions; columns
other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.tables import hash_mod, join_spread, stage, workers_import
from brindle.storage import scratch_path
from brindle.llm.words import mix as mix64

SHARD_KEYS = 200_000
_U = np.uint64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


# --- the filter: numpy on the keys of one shard -------------------------------------------------

def _shape(n: int) -> tuple[int, int]:
    """Segment length and number of segments for n keys, with some room beyond the published size."""
    if n < 2:
        return 4, 3
    length = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return length, max(1, int(np.ceil(n * factor / length)) - 2) + 2


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments for every key, and its fingerprint."""
    h = mix64(keys ^ _U(seed))
    start = ((h >> _U(32)) * _U(segments - 2)) >> _U(32)
    again = mix64(h + _U(0x9E3779B97F4A7C15))
    mask = _U(length - 1)
    slots = np.stack([(start + _U(i)) * _U(length) + ((again >> _U(20 * i)) & mask) for i in range(3)])
    return slots.astype(np.int64), (mix64(again) & _U(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Seed, segment length, segments and the slots of a filter that accepts every one of ``keys``."""
    keys = np.unique(keys)
    length, segments = _shape(len(keys))
    for turn in range(100):
        seed = int(mix64(np.array([turn + 1], np.uint64))[0])
        slots, prints = _places(keys, seed, length, segments)
        size = length * segments
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(len(keys)))
        peeled = []
        alone = np.flatnonzero(count == 1)
        while len(alone):
            # of a key that is alone in several slots, one slot is enough
            key, first = np.unique(held[alone], return_index=True)
            peeled.append((key, alone[first]))
            touched = slots[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(key, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if sum(len(k) for k, _ in peeled) == len(keys):
            table = np.zeros(size, np.uint16)
            for key, slot in reversed(peeled):
                table[slot] = 0
                table[slot] = prints[key] ^ table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]]
            return seed, length, segments, table
        if turn % 5 == 4:
            segments += max(1, segments // 8)
    raise RuntimeError("no seed gives a filter for these keys")


def passes(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    slots, prints = _places(keys, seed, length, segments)
    return prints == table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]


def _numbers(digests) -> np.ndarray:
    """The digests' second eight bytes; the shard comes from the first."""
    return np.frombuffer(b"".join(d[8:16] for d in digests.to_pylist()), np.uint64).copy()


def _build(group: pa.Table) -> pa.Table:
    seed, length, segments, table = build_filter(_numbers(group["digest"]))
    return pa.table({"shard": group["shard"][:1], "seed": pa.array([seed & (2**63 - 1) if seed < 2**63 else seed - 2**64]),
                     "length": pa.array([length]), "segments": pa.array([segments]), "slots": pa.array([table.tobytes()], pa.binary())})


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(batch) or not len(filters):
        return batch.slice(0, 0).select(["digest"])
    f = filters.to_pylist()[0]
    hit = passes(_numbers(batch["digest"]), f["seed"] % 2**64, f["length"], f["segments"], np.frombuffer(f["slots"], np.uint16))
    return batch.select(["digest"]).filter(pa.array(hit))


# --- Spark ---------------------------------------------------------------------------------------

def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))


def groups(rows: DataFrame, label: str) -> DataFrame:
    """The exact buckets: digest, smallest id, number of rows."""
    return stage(rows.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("n")), label)


def _sharded(buckets: DataFrame, shards: int) -> DataFrame:
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return buckets.select((first % shards).alias("shard"), "digest")


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """One static filter per shard of the snapshot's digests."""
    return (_sharded(buckets, shards).groupBy("shard")
            .applyInArrow(_build, "shard long, seed long, length long, segments long, slots binary").withColumn("shards", F.lit(shards)))


def screen(batch: DataFrame, filters: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """Digests of the batch that the snapshot's filters let pass; a shard's digests go to ``parts`` tasks."""
    dealt = _sharded(batch, shards).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
            .applyInArrow(_screen, "digest binary"))


def build_snapshot(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> None:
    """Write the buckets, with one text each, and the filters of ``docs`` to ``path``."""
    workers_import(docs.sparkSession)
    spark, body = docs.sparkSession, normalised(F.col(text))
    rows = docs.select(F.col(key).alias("id"), body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    buckets = rows.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("n"), F.first("body").alias("body"))
    buckets.write.option("compression", "zstd").parquet(f"{path}/buckets")
    old = spark.read.parquet(f"{path}/buckets")
    build_filters(old, 1 + old.count() // SHARD_KEYS).write.parquet(f"{path}/filters")


def _marked(path: str, batch: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The snapshot's and the batch's buckets, and the batch's rows; ``apart`` is 1 where equal digests have unequal bytes."""
    spark = batch.sparkSession
    old, filters = spark.read.parquet(f"{path}/buckets"), spark.read.parquet(f"{path}/filters")
    rows = stage(digests(batch, key, text), "dedup-new-rows")
    new = groups(rows, "dedup-new")
    known = filters.agg(F.max("shards")).first()[0]
    if known is None:  # an empty snapshot
        hits = new.limit(0)
    else:
        parts = 1 + new.count() // (known * SHARD_KEYS)
        hits = stage(screen(new, filters, known, parts).join(new, "digest"), "dedup-hits")
    exact = hits.select("digest").join(old.select("digest", F.col("body").alias("old_body")), "digest")
    texts = batch.select(F.col(key).alias("id"), normalised(F.col(text)).alias("body"))
    one = (texts.join(hits.select("digest", "keep"), texts["id"].eqNullSafe(F.col("keep"))).where(F.unhex(F.sha2("body", 256)) == F.col("digest"))
           .select("digest", "body"))
    same = exact.join(one, "digest").where(F.col("old_body") == F.col("body")).select("digest").distinct()
    # a digest that both sides hold without equal bytes stays a group of its own
    apart = stage(exact.select("digest").join(same, "digest", "left_anti").distinct().withColumn("apart", F.lit(1)), "dedup-apart")

    def marked(df: DataFrame) -> DataFrame:
        return df.join(apart, "digest", "left").withColumn("apart", F.coalesce("apart", F.lit(0)))

    return old.select("digest", "keep", "n").withColumn("apart", F.lit(0)), marked(new), marked(rows)


def _verdict(rows: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    whole = buckets.groupBy("digest", "apart").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("group_size"))
    return (join_spread(rows, whole, ["digest", "apart"], "id")
            .select(F.col("id").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def dedup_batch(path: str, batch: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``batch``, against the snapshot at ``path`` and inside the batch."""
    workers_import(batch.sparkSession)
    old, new, rows = _marked(path, batch, key, text)
    mine = new.select("digest").distinct()
    return _verdict(rows, old.join(mine, "digest", "left_semi").unionByName(new), key)


def exact_dedup(snapshot: DataFrame, batch: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``snapshot`` and ``batch``: key, keep_id, group_size, kept, text_sha256."""
    workers_import(batch.sparkSession)
    path = scratch_path(batch.sparkSession, "dedup-snapshot")
    build_snapshot(snapshot, path, key=key, text=text)
    old, new, rows = _marked(path, batch, key, text)
    old_rows = stage(digests(snapshot, key, text), "dedup-old-rows").withColumn("apart", F.lit(0))
    return _verdict(old_rows.unionByName(rows), old.unionByName(new), key)


def split_by_hash(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table as a snapshot and a later batch, by a hash of the id."""
    part = hash_mod(key, 2)
    return docs.where(part == 0), docs.where(part != 0)
