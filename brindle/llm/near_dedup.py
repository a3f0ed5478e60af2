"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

A text's set is its distinct runs of ``size`` lower-case words. Two small collections of TABLES hashes
each are computed, a hash being over WIDTH minima; the keys of TABLES^2 hash tables are the pairs of one
hash of either collection (Christiani 2019), so that minima grow with the square root of the tables.
A key can only be shared where both its halves are, which prunes nearly all texts before pairs are formed.

Texts with equal sets are one class, represented by its smallest id. The members of a table's bucket are
tied to its smallest member; the components of these ties are families, within which all links lie. A
family is cut into blocks by hash, and each pair of blocks is one task that compares full sets exactly
and returns edges that span the links it found. Families of any size are thus verified whole, in bounded
memory. The components of the spanning edges are the result. Two texts with a Jaccard similarity of 0.8
miss each other in all tables with a probability below 0.4 %, less above, and a family also finds them
through others.

Shingles are compared by 64-bit hashes, and texts are one class if their sets have equal sizes and two equal 64-bit sums of
mixed hashes; their sets are not compared again. Work inside a family grows with the square of its blocks.

Defined results: a very long text's set is built whole, from pieces; a text without words (or null) has an empty set and is linked with nothing; a text with
fewer words than ``size`` has its whole sequence as its set; rows that repeat an id are one node, and all
are kept that carry the component's id; a null id is an id of its own, ordered first; empty input gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.components import components
from brindle.llm.tables import join_spread, stage, workers_import
from brindle.llm.words import BASE, buffer, chained, mix, words

TABLES, WIDTH = 12, 4
BLOCK_TEXTS, BLOCK_SHINGLES = 1000, 2_000_000
NO_ID = -2**63
_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * TABLES * WIDTH + 1, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, _, first = words(*buffer(texts))
    runs = chained(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(runs[a:b - size + 1]) if b - a >= size else chained(hashes[a:b], b - a) if b > a else runs[:0]


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = list(shingle_sets(some.column(1), size))
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                a, b = np.zeros((len(sets), TABLES), np.uint64), np.zeros((len(sets), TABLES), np.uint64)
                digest = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    start = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for side, seed in enumerate((_U(0x1F83D9AB), _U(0x5BE0CD19))):
                        digest[side, full] = np.add.reduceat(mix(every ^ seed), start)
                    low = every >> _U(32)
                    for k, seed in enumerate(_SEEDS):
                        # multiply-shift of a hash that is mixed already; the high half decides
                        least = np.minimum.reduceat((every ^ (low * seed)) * seed >> _U(20), start)
                        out = a if k < TABLES * WIDTH else b
                        column = k % (TABLES * WIDTH) // WIDTH
                        out[full, column] = mix(out[full, column] * BASE + least)
                signed = lambda x: pa.array(x.view(np.int64))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, TABLES, dtype=np.int32)), signed(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), signed(digest[0]), signed(digest[1]), lists(a), lists(b)],
                                                 names=["id", "n", "d1", "d2", "a", "b"])
    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = [s.tobytes() for s in shingle_sets(some.column(1), size)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), some.column(4), pa.array(sets, pa.binary())],
                                                 names=["id", "family", "blocks", "block", "shingles"])
    return run


def spanning_links(ids: list[int], blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that span all links between texts of different blocks, or of the one block there is."""
    every = np.concatenate(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle = np.unique(every, return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    count = np.bincount(shingle)
    begin = np.concatenate([[0], np.cumsum(count)])
    posted, offsets = owner[order], np.concatenate([[0], np.cumsum(size)])
    alone, label, edges = blocks.min() == blocks.max(), np.arange(len(sets)), []
    for x in range(len(sets)):
        mine = shingle[offsets[x]:offsets[x + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        # all postings of the text's shingles, one after the other
        lengths = count[mine]
        jump = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        common = np.bincount(posted[jump + np.arange(lengths.sum())], minlength=len(sets))
        linked = (100 * common >= percent * (size[x] + size - common)) & (label != label[x]) & (alone | (blocks != blocks[x]))
        for other in np.unique(label[linked]):
            y = int(np.flatnonzero(linked & (label == other))[0])
            edges.append((ids[x], ids[y]))
            label[label == other] = label[x]
    return edges


def _verify(percent: int):
    def run(group: pa.Table) -> pa.Table:
        rows = {}
        for i, k, s in zip(group["id"].to_pylist(), group["block"].to_pylist(), group["shingles"].to_pylist()):
            rows.setdefault((i, s), (i, k, np.frombuffer(s, np.uint64)))
        ids, blocks, sets = zip(*rows.values())
        edges = spanning_links(list(ids), np.array(blocks), list(sets), percent)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})
    return run


def _ties(nodes: DataFrame) -> DataFrame:
    """(a, b): a bucket's smallest member and another member, over all table keys; pairs may repeat."""
    half = stage(nodes.select("id", F.posexplode("a").alias("t", "h")).withColumn("side", F.lit(0))
                 .unionByName(nodes.select("id", F.posexplode("b").alias("t", "h")).withColumn("side", F.lit(1)))
                 .select("id", "side", F.xxhash64("side", "t", "h").alias("h")), "near-halves")
    shared = half.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h")
    live = stage(half.join(shared, "h", "left_semi"), "near-live")
    left, right = live.where("side = 0").select("id", F.col("h").alias("l")), live.where("side = 1").select("id", F.col("h").alias("r"))
    # a text has at most TABLES halves per side, so TABLES^2 keys
    keys = stage(left.join(right, "id").select("id", F.xxhash64("l", "r").alias("key")), "near-keys")
    buckets = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most").select("key", "a")
    return join_spread(keys, buckets, ["key"], "id").where("a < id").select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("body"))
    signed = stage(rows.mapInArrow(_signatures(size), "id long, n long, d1 long, d2 long, a array<long>, b array<long>"), "near-signatures")
    same = ["n", "d1", "d2"]
    classes = stage(signed.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")), "near-classes")
    families = components(_ties(classes.select(F.col("rep").alias("id"), "a", "b")))
    members = stage(families.join(classes.select(F.col("rep").alias("node"), "n"), "node"), "near-members")
    weight = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = (members.join(weight, "root").select(F.col("node").alias("member"), F.col("root").alias("family"), "blocks",
                                                  F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).distinct())
    # the members grow with the corpus, so texts meet them in a sorted merge at every size
    sets = (rows.join(placed.hint("merge"), rows["id"] == placed["member"]).select("id", "body", "family", "blocks", "block")
            .mapInArrow(_with_sets(size), "id long, family long, blocks int, block int, shingles binary"))
    other = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("id", "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "shingles")
    links = pairs.groupBy("family", "low", "high").applyInArrow(_verify(percent), "a long, b long")
    found = stage(components(links), "near-components")
    whole = (classes.select(*same, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select(*same, F.coalesce("root", "rep").alias("component")))
    lone = signed.where("n = 0").select("id", "n", F.col("id").alias("component"))
    out = join_spread(signed.where("n > 0").select("id", *same), whole, same, "id").select("id", "n", "component").unionByName(lone)
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(plain("id").alias(key), F.col("n").alias("n_shingles"), plain("component").alias("component_id"),
                      (F.col("id") == F.col("component")).alias("kept"))
