"""Spelling variants: words one edit apart, found by dynamic programming over a sorted vocabulary.

In a sorted list the words that share their first d letters are neighbours: a range, bounded by the places
where the common prefix of adjacent words (LCP) is shorter than d. The edit matrix of a query and any of
these words has the same first d rows, and with at most one edit only three cells of a row count. ``descend``
keeps one banded row per query and range, extends it by one letter per child range, so that a row is computed
once for all words behind it, and leaves out a range as soon as its shared prefix exceeds one edit.

Two lists find every pair. If words of m and at most m+1 letters differ by one edit, they agree in the first or in the
last floor(m/2) letters of the query. The list of words finds the first kind and the list of reversed words
the other, each from the ranges that share that half. A list is cut into segments of about SEGMENT words by a
range partition; a query visits the segments whose span holds its half and whose common prefix is within
one edit of it, which is decided by the same descent over the segments' prefixes. A half that a third of all words
share thus costs a query its near segments only. Python works on one segment's words and visitors, in chunks.

The driver sees the first and last word of every segment, one in about SEGMENT words.

Defined results: null, empty and letterless texts have no words; a very long run of letters is one word, and the descent takes as
many steps as the longest prefix within one edit of a query; of equally frequent near words the first in code-point order is
the form; rows that repeat an id count each; a null id counts as the text ``null``; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.tables import stage, workers_import

RUN = r"[A-Za-zÀ-ÿ]+"
SEGMENT = 20_000
CHUNK = 2048
FAR = 2  # any cost above one edit


class Words:
    """Code points of words, one after the other, each followed by two zeros."""

    def __init__(self, listed: list[str]):
        self.size = np.array([len(w) for w in listed], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size + 2)])
        self.codes = np.frombuffer("".join(w + "\0\0" for w in listed).encode("utf-32-le"), np.uint32)

    def __len__(self) -> int:
        return len(self.size)

    def letter(self, word: np.ndarray, place: int) -> np.ndarray:
        """The letters at ``place``; zero behind a word's end."""
        return self.codes[self.at[word] + np.minimum(place, self.size[word])]

    def common_prefixes(self) -> np.ndarray:
        """LCP of every word and the one before it; of the first word, -1."""
        lcp = np.zeros(len(self), np.int64)
        lcp[:1] = -1
        same, depth = np.arange(1, len(self)), 0
        while len(same):
            a = self.letter(same, depth)
            same = same[(a == self.letter(same - 1, depth)) & (a > 0)]
            depth += 1
            lcp[same] = depth
        return lcp


def descend(queries: Words, fixed: np.ndarray, entries: Words, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, entry) of the sorted ``entries`` that share the query's first ``fixed`` letters and then are one edit apart.

    With ``whole=False`` an entry stands for all words that begin with it: it is paired if some such word may be near.
    """
    lcp = entries.common_prefixes()
    order = np.argsort(lcp, kind="stable")
    levels = np.searchsorted(lcp[order], np.arange(int(lcp.max(initial=0)) + 2))
    for start in range(0, len(queries), CHUNK):
        q = np.arange(start, min(start + CHUNK, len(queries)))
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(entries), np.int64)
        # cells d-1, d and d+1 of row d of the edit matrix
        row = np.tile(np.array([[FAR], [0], [1]], np.int8), len(q))
        depth = 0
        while len(q) and len(entries):
            # children of a range begin at its start and wherever adjacent words share just this prefix
            cuts = order[levels[depth]:levels[depth + 1]] if depth + 1 < len(levels) else order[:0]
            a, b = np.searchsorted(cuts, low, side="right"), np.searchsorted(cuts, high)
            n = b - a + 1
            of = np.repeat(np.arange(len(q)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.where(nth == 0, low[of], cuts[np.minimum(a[of] + nth - 1, max(len(cuts) - 1, 0))] if len(cuts) else 0)
            last = nth == n[of] - 1
            end = np.where(last, high[of], np.append(begin[1:], 0))
            q, row = q[of], row[:, of]
            ended = entries.size[begin] == depth
            if ended.any():
                cell = queries.size[q] - depth + 1
                hit = ended & ((cell >= 0) & (cell <= 2) & (row[np.clip(cell, 0, 2), np.arange(len(q))] == 1) & (fixed[q] <= depth) if whole else True)
                yield q[hit], begin[hit]
                q, row, begin, end = q[~ended], row[:, ~ended], begin[~ended], end[~ended]
            letter = entries.letter(begin, depth)
            same = queries.letter(q, depth) == letter
            first = np.minimum(row[0] + (queries.letter(q, max(depth - 1, 0)) != letter), row[1] + 1)
            second = np.minimum(np.minimum(row[1] + ~same, row[2] + 1), first + 1)
            third = np.minimum(row[2] + (queries.letter(q, depth + 1) != letter), second + 1)
            row = np.minimum(np.stack([first, second, third]), FAR).astype(np.int8)
            bound = depth < fixed[q]
            row[:, bound] = np.array([[FAR], [0], [1]], np.int8)
            alive = np.where(bound, same, row.min(axis=0) < FAR) & (depth <= queries.size[q])
            q, row, low, high = q[alive], row[:, alive], begin[alive], end[alive]
            depth += 1


def _half(words: list[str]) -> np.ndarray:
    return np.array([len(w) // 2 for w in words], np.int64)


def _shared(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def _visits(bounds: list[tuple[int, str, str]]):
    """The segments that each word must be compared with."""
    prefixes = sorted((_shared(low, high), i) for i, (_, low, high) in enumerate(bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Words([p for p, _ in prefixes])
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                listed = some.column(0).to_pylist()
                for q, entry in descend(Words(listed), _half(listed), spans, whole=False):
                    found = []
                    for x, e in zip(q.tolist(), entry.tolist()):
                        segment, low, high = bounds[prefixes[e][1]]
                        word = listed[x]
                        half = word[:len(word) // 2]
                        # the span holds words that begin with the half
                        if low[:len(half)] <= half <= high[:len(half)]:
                            found.append((segment, x))
                    if found:
                        segment, x = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), some.column(0).take(pa.array(x)), pa.nulls(len(x), pa.int64())],
                                                         names=["segment", "listed", "n"])
    return run


def _pairs(backwards: bool):
    def run(group: pa.Table) -> pa.Table:
        entries = group.filter(group["n"].is_valid()).sort_by("listed")
        queries = group.filter(group["n"].is_null())["listed"].to_pylist()
        kept, count = entries["listed"].to_pylist(), entries["n"].to_numpy()
        found_q, found_e = [], []
        # UTF-8 and code points sort alike
        for q, e in descend(Words(queries), _half(queries), Words(kept), whole=True):
            if backwards:  # pairs that agree in the first half are found in the other list
                new = [queries[x][len(queries[x]) - len(queries[x]) // 2:] != kept[y][max(len(kept[y]) - len(queries[x]) // 2, 0):] for x, y in zip(q.tolist(), e.tolist())]
                q, e = q[new], e[new]
            found_q.append(q)
            found_e.append(e)
        q, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_e))
        turn = -1 if backwards else 1
        return pa.table({"word": pa.array([queries[i][::turn] for i in q], pa.string()), "near": pa.array([kept[i][::turn] for i in e], pa.string()),
                         "near_n": pa.array(count[e], pa.int64())})
    return run


def _listed_pairs(vocabulary: DataFrame, segments: int, backwards: bool) -> DataFrame:
    words = vocabulary.select((F.reverse("word") if backwards else F.col("word")).alias("listed"), "n")
    cut = stage(words.repartitionByRange(segments, "listed").withColumn("segment", F.spark_partition_id()), "spelling-list")
    bounds = [tuple(r) for r in cut.groupBy("segment").agg(F.min("listed"), F.max("listed")).collect()]
    visits = cut.select("listed").mapInArrow(_visits(bounds), "segment int, listed string, n long")
    # a segment is much work for few bytes, so segments are dealt by number
    return (cut.select("segment", "listed", "n").unionByName(visits).repartition(segments, "segment").groupBy("segment")
            .applyInArrow(_pairs(backwards), "word string, near string, near_n long"))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``vocabulary`` (word, n) that are exactly one edit apart."""
    workers_import(vocabulary.sparkSession)
    segments = 1 + vocabulary.count() // SEGMENT
    return _listed_pairs(vocabulary, segments, False).unionByName(_listed_pairs(vocabulary, segments, True))


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): runs of letters in lower case; every ``noise``-th occurrence by hash, one letter is left out."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(named.alias("named"), F.explode(F.regexp_extract_all(body, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("named", F.lit(":"), "run").cast("binary")))
    place = F.expr("cast(h % length(run) AS int)")
    # a run that loses a letter is as long as asked only if it had one more
    word = F.when(F.col("h") % noise != 0, F.col("run")).otherwise(F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run"))))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def variant_forms(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    words = stage(words, "spelling-words")
    best = (near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b")))
    judged = words.join(best, "word", "left").withColumn("form_n", -F.col("b.less")).withColumn("led", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    forms = stage(judged.select("word", F.when(F.col("led"), F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("led"), F.col("form_n")).alias("form_n")), "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form. A chain's counts grow at every step, so it ends; each turn doubles what a word sees of it."""
    ahead = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        seen = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = stage(ahead.join(seen, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        ahead = ahead.select("word", "root")
