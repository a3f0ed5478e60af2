"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

An item's windows are its runs of ``size`` words; an item of fewer words is one window. A window's set is its
shingles: runs of SHINGLE words, or the whole window where it is shorter. A document holds the window only if it
holds all of its shingles, so one shingle, the rarest by its count in all documents (ties: the smaller hash), is the
whole prefix that containment needs; a window with a shingle that no document has can't occur and goes before the join.

1. One scan counts the benchmark's shingles in all documents, pre-aggregated per batch.
2. A second scan yields, per document, the places of prefix shingles with the words around them: as many as the
   longest window can reach to either side.
3. Places join windows by the prefix shingle. A window fits if enough words lie before and after (position and length
   bounds) and its words equal the document's at that place, word by word. Words covered by any window are hit.

Both scans are screened by a bitmap of 2^SCREEN_BITS bits over the shingles in question, so its size is fixed. What it
lets through by chance ends in the join, whatever the number of shingles; texts never move. A place that a third of
the documents share is spread over salts.

Defined results: a null or empty text has no words, no hits and the digest of the empty list; an item without words
never occurs; equal windows of several items count for each; rows that repeat an item id are one item, a null item id is an
item written as empty text; rows that repeat a document id are rows of their own; very long texts are read in pieces, and of them
only places of prefix shingles are kept; without items or documents nothing is hit; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.llm.tables import join_spread, stage, workers_import
from brindle.llm.words import buffer, chained, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
SCREEN_BITS = 23
BITMAP_BITS = 32768  # of one bitmap of the engine's aggregate
SLICE = 1000
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _windows(size: int):
    """(item, words of the window, shingle hash, offset of the shingle in it) for every shingle of every distinct window of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                item = batch.slice(i, 1)
                listed = item.column(1)[0].as_py()
                if not listed:
                    continue
                hashes = words(*buffer(pa.array([" ".join(listed)])), gaps=_GAPS)[0]
                length = min(size, len(listed))
                width = min(SHINGLE, length)
                runs = chained(hashes, width).view(np.int64)
                offsets = np.arange(length - width + 1, dtype=np.int32)
                for at in range(0, len(listed) - length + 1, SLICE):
                    begin = np.arange(at, min(at + SLICE, len(listed) - length + 1))
                    texts = pa.array([" ".join(listed[b:b + length]) for b in begin])
                    each = np.repeat(np.arange(len(begin)), len(offsets))
                    place = np.tile(offsets, len(begin))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item.column(0).take(pa.array(np.zeros(len(each), np.int64)))), texts.take(pa.array(each)),
                         pa.array(np.full(len(each), length, np.int32)), pa.array(np.full(len(each), width, np.int32)),
                         pa.array(runs[begin[each] + place]), pa.array(place)],
                        names=["item", "window", "length", "width", "key", "at"])
    return run


def _screen(keys: DataFrame) -> tuple[list[int], np.ndarray]:
    """The shingle widths among ``keys`` and a bitmap of fixed size over their hashes."""
    spot = F.pmod(F.col("key"), F.lit(1 << SCREEN_BITS))
    parts = (keys.groupBy((spot / BITMAP_BITS).cast("int").alias("part"))
             .agg(F.bitmap_construct_agg((spot % BITMAP_BITS).cast("long")).alias("bits"), F.collect_set("width").alias("widths")).collect())
    bits = np.zeros((1 << SCREEN_BITS) // 8, np.uint8)
    for r in parts:
        bits[r["part"] * (BITMAP_BITS // 8):(r["part"] + 1) * (BITMAP_BITS // 8)] = np.frombuffer(r["bits"], np.uint8)
    return sorted({w for r in parts for w in r["widths"]}), bits


def _places(hashes: np.ndarray, first: np.ndarray, widths: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of every run within one text that the bitmap lets through."""
    at, keys = [], []
    for width in widths:
        runs = chained(hashes, width)
        low = runs & np.uint64((1 << SCREEN_BITS) - 1)
        found = np.flatnonzero(bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
        text_end = first[np.searchsorted(first, found, side="right")] if len(found) else found
        found = found[found + width <= text_end]
        at.append(found)
        keys.append(runs[found])
    return (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _count(widths: list[int], bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                hashes, _, first = words(*buffer(batch.column(0).slice(at, SLICE)), gaps=_GAPS)
                keys, n = np.unique(_places(hashes, first, widths, bits)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])
    return run


def _find(widths: list[int], bits: np.ndarray, size: int):
    """One row per document: id, n_words, and the places of prefix shingles with the words that a window there can reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowered = bytes(c + 32 if 65 <= c <= 90 else 32 if _GAPS[c] else c for c in range(256))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                data, offsets = buffer(some.column(1))
                hashes, ends, first = words(data, offsets, gaps=_GAPS)
                at, keys = _places(hashes, first, widths, bits)
                order = np.argsort(at, kind="stable")
                at, keys = at[order], keys[order]
                doc = np.searchsorted(first, at, side="right") - 1
                low, high = np.maximum(at - max(size - SHINGLE, 0), first[doc]), np.minimum(at + size, first[doc + 1]) - 1
                # a word begins after the end of the one before it, behind the gap that translate turns into blanks
                begin = np.maximum(np.where(low > 0, ends[low - 1], 0), offsets[doc]) if len(at) else at
                raw = data.tobytes() if len(at) else b""
                around = [raw[b:e].translate(lowered).split() for b, e in zip(begin.tolist(), ends[high].tolist())]
                found = pa.StructArray.from_arrays(
                    [pa.array((at - first[doc]).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(keys.view(np.int64)),
                     pa.array([b" ".join(w).decode() for w in around], pa.string())], names=["at", "before", "key", "around"])
                per_doc = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(first).astype(np.int64)), per_doc], names=["id", "n_words", "places"])
    return run


def find_contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                       item_text: str = "text", size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): ``row``, key, n_words of every document, and (row, begin, end, item) of every window found."""
    spark = docs.sparkSession
    workers_import(spark)
    listed = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"),
                          F.regexp_extract_all(lower_ascii(F.col(item_text).cast("string")), F.lit(WORD), F.lit(0)).alias("words"))
    windows = stage(listed.mapInArrow(_windows(size), "item string, window string, length int, width int, key long, at int"), "leak-windows")
    shingles = windows.select("window", "length", "width", "key", "at").distinct()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body"))

    counted = stage(rows.select("body").mapInArrow(_count(*_screen(windows.select("key", "width").distinct())), "key long, n long")
                    .groupBy("key").agg(F.sum("n").alias("n")), "leak-counts")
    ranked = shingles.join(counted, "key", "left")
    # the rarest shingle of each window, if none of them is missing from all documents
    prefix = stage(ranked.groupBy("window", "length").agg(F.min(F.struct("n", "key", "at", "width")).alias("p"), F.count("n").alias("present"), F.count("*").alias("all"))
                   .where("present = all").select("window", "length", "p.key", "p.at", "p.width"), "leak-prefixes")

    kind = rows.schema["id"].dataType.simpleString()
    scanned = rows.mapInArrow(_find(*_screen(prefix.select("key", "width").distinct()), size),
                              f"id {kind}, n_words long, places array<struct<at int, before int, key long, around string>>")
    found = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "leak-places")
    places = found.select("row", F.explode("places").alias("p")).select("row", "p.at", "p.before", "p.key", F.split("p.around", " ").alias("around"))
    met = join_spread(places, prefix.select("key", "window", "length", F.col("at").alias("offset")), ["key"], "row")
    fits = met.where("before >= offset AND before - offset + length <= size(around)")
    same = fits.where(F.array_join(F.slice("around", F.col("before") - F.col("offset") + 1, F.col("length")), " ") == F.col("window"))
    hits = same.select("row", (F.col("at") - F.col("offset")).alias("begin"), (F.col("at") - F.col("offset") + F.col("length")).alias("end"), "window").distinct()
    spans = join_spread(stage(hits, "leak-hits"), windows.select("window", "item").distinct(), ["window"], "row")
    return found.select("row", F.col("id").alias(key), "n_words"), spans.select("row", "begin", "end", "item")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted ids of the items with a window in it), contaminated."""
    documents, spans = find_contamination(docs, items, **options)
    spans = stage(spans, "leak-spans")
    places = spans.select("row", "begin", "end").distinct()
    earlier = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = (places.withColumn("new", F.greatest(F.col("end") - F.greatest("begin", F.coalesce(earlier, "begin")), F.lit(0)))
               .groupBy("row").agg(F.sum("new").alias("n_hit")))
    named = spans.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = stage(covered.join(named, "row"), "leak-hit-rows")
    return (documents.join(hit, "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
            .withColumn("contaminated", F.col("n_hit") > 0).drop("row"))
