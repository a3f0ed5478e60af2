"""Merkle fingerprints of documents: equal roots mean equal texts, differing branches locate edits.

A text is a tree: sections hold paragraphs (lines), paragraphs hold leaves of a few words. Leaves and
sections end where their content's hash says so, hence an edit moves no boundary elsewhere. Every byte,
white space included, lies in exactly one leaf. A paragraph's node is a 128-bit hash of its bytes, a section's of
its paragraphs', the root's of the sections', so equal roots mean equal texts. Leaves, of 48 bits, tell which
words of a paragraph differ. The fingerprint is the root, a colon, and the leaves in 8 signs
each, with ``,`` after a paragraph and ``;`` after a section. Two trees are compared from the root down: equal
branches are not entered, and only leaves of paragraphs that the other tree lacks are counted one by one.

Defined results: a null text is empty, and the likeness of two empty texts is 1, of an empty and another
text 0; repeated rows and ids are fingerprinted each, and follow one another in the order by text; a null
id comes last in descending order; the only row is its own next; a very long text is one tree, whose words are hashed in
pieces; empty input gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from brindle.llm.tables import stage, workers_import
from brindle.llm.words import BASE, buffer, mix, units

_U = np.uint64
LEAF_ODDS, SECTION_ODDS = 4, 8  # one word in 4 ends a leaf, one paragraph in 8 a section
PART_BYTES = 64 * 1024 * 1024


# --- the tree -----------------------------------------------------------------------------------

def _leaves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hash of every leaf, its kind (0 inside, 1 ends a paragraph, 2 ends a section), first leaf per text, its last byte."""
    hashes, ends, first = units(data, offsets)
    if not len(hashes):
        return hashes, np.zeros(0, np.int8), first, ends
    # a line break opens the next unit, so a unit before such a one ends its paragraph
    opens = np.zeros(len(ends), bool)
    begins = np.concatenate([[0], ends[:-1]])
    lines = np.flatnonzero(data == 10)
    opens[np.searchsorted(ends, lines, side="right")] = True
    last = np.zeros(len(ends), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    paragraph = last.copy()
    paragraph[:-1] |= opens[1:]
    leaf_end = paragraph | (hashes % _U(LEAF_ODDS) == 0)
    at = np.flatnonzero(leaf_end)
    start = np.concatenate([[0], at[:-1] + 1])
    # order-dependent sum of the unit hashes inside a leaf
    place = np.arange(len(hashes)) - np.repeat(start, at - start + 1)
    spread = mix(hashes + place.astype(np.uint64) * BASE)
    length = (ends[at] - begins[start]).astype(np.uint64)
    leaf = mix(np.add.reduceat(spread, start) + length) >> _U(16)
    kind = paragraph[at].astype(np.int8)
    kind[paragraph[at] & ((hashes[at] >> _U(20)) % _U(SECTION_ODDS) == 0) | last[at]] = 2
    return leaf, kind, np.searchsorted(at, first, side="left"), ends[at]


def _node(children: bytes) -> bytes:
    return hashlib.blake2b(children, digest_size=16).digest()


@dataclass(frozen=True)
class Tree:
    """A text's nodes: sections of paragraphs, each with its leaves."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, np.ndarray]]]]
    leaves: int

    def written(self) -> str:
        out = []
        for _, paragraphs in self.sections:
            for i, (_, leaf) in enumerate(paragraphs, start=1):
                raw = leaf.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
                out.append(base64.b64encode(raw, b"-_").decode() + (";" if i == len(paragraphs) else ","))
        return f"{self.root.hex()}:{''.join(out)}"


def _tree(data: bytes, begin: int, leaf: np.ndarray, kind: np.ndarray, end: np.ndarray) -> Tree:
    """The tree of the text that begins at a byte of ``data``, from its leaves and the bytes where they end."""
    sections, paragraphs, first = [], [], 0
    for at in (np.flatnonzero(kind) + 1).tolist():
        upto = int(end[at - 1])
        paragraphs.append((_node(data[begin:upto]), leaf[first:at]))
        first, begin = at, upto
        if kind[at - 1] == 2:
            sections.append((_node(b"".join(p for p, _ in paragraphs)), paragraphs))
            paragraphs = []
    return Tree(_node(b"".join(s for s, _ in sections)), sections, len(leaf))


def trees(texts: list[str]) -> list[Tree]:
    data, offsets = buffer(pa.array(texts, pa.large_string()))
    leaf, kind, first, end = _leaves(data, offsets)
    raw = data.tobytes()
    return [_tree(raw, o, leaf[a:b], kind[a:b], end[a:b]) for o, a, b in zip(offsets.tolist(), first[:-1].tolist(), first[1:].tolist())]


def _without(own: list[tuple], other: list[tuple]) -> list[tuple]:
    """The branches of ``own`` that are left when each equal one of ``other`` has taken one away."""
    spare, left = Counter(node for node, _ in other), []
    for branch in own:
        if spare[branch[0]]:
            spare[branch[0]] -= 1
        else:
            left.append(branch)
    return left


def descend(a: Tree, b: Tree) -> tuple[list[tuple], list[tuple]]:
    """The paragraphs of either tree that the other lacks; only sections that differ are entered."""
    if a.root == b.root:
        return [], []
    sections = _without(a.sections, b.sections), _without(b.sections, a.sections)
    left, right = ([p for _, inner in some for p in inner] for some in sections)
    return _without(left, right), _without(right, left)


def likeness(a: Tree, b: Tree) -> float:
    """Share of leaves that both have: those of equal branches, and the common ones of the paragraphs that differ."""
    if not a.leaves or not b.leaves:
        return 1.0 if a.leaves == b.leaves else 0.0
    left, right = descend(a, b)
    x, y = (np.concatenate([leaf for _, leaf in some]) if some else np.zeros(0, np.uint64) for some in (left, right))
    (x_leaf, x_count), (y_leaf, y_count) = (np.unique(v, return_counts=True) for v in (x, y))
    _, i, j = np.intersect1d(x_leaf, y_leaf, assume_unique=True, return_indices=True)
    common = a.leaves - len(x) + int(np.minimum(x_count[i], y_count[j]).sum())
    return 2 * common / (a.leaves + b.leaves)


def leaves_of(fingerprint: str) -> np.ndarray:
    """The ascending leaves of a written fingerprint."""
    signs = fingerprint.partition(":")[2].replace(",", "").replace(";", "")
    raw = np.frombuffer(base64.b64decode(signs, b"-_"), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return np.sort(out.reshape(-1).view(">u8").astype(np.uint64))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose branch ``b`` lacks: sections are compared first, then inside."""
    trees = [[s.split(",") for s in x.partition(":")[2].split(";")[:-1]] for x in (a, b)]
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    sections, paragraphs = {tuple(s) for s in trees[1]}, {p for s in trees[1] for p in s}
    return [(i, j) for i, s in enumerate(trees[0]) if tuple(s) not in sections for j, p in enumerate(s) if p not in paragraphs]


# --- Spark --------------------------------------------------------------------------------------

_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_FIELDS = [c.split() for c in _SCHEMA.split(", ")]


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(rows: list[tuple[int, str, str]]) -> list[tuple]:
    """Results of (id, text, next text)."""
    edited = [edited_text(t, n) for _, t, n in rows]
    texts = [t for _, t, _ in rows]
    following = [n for _, _, n in rows]
    # of a run in order each next text is the following row's own
    chain = following[:-1] == texts[1:]
    n, made = len(rows), trees(texts + edited + (following[-1:] if chain else following))
    after = made[1:n] + made[2 * n:] if chain else made[2 * n:]
    return [(rows[i][0], len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), made[i].written(), made[n + i].written(),
             likeness(made[i], made[n + i]), likeness(made[i], after[i])) for i in range(n)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[kind]) for v, (_, kind) in zip(zip(*rows), _FIELDS)], names=[name for name, _ in _FIELDS])


def _placed(bounds: np.ndarray):
    """Add ``part``, the place of the id among the bounds in descending order; a null id is in the last part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            part = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds), part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])
    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a part with the next; a part ends with a guest, the text that follows it."""
    held, size = [], 0

    def pairs() -> list[tuple]:
        return [(*a, b[1]) for a, b in zip(held, held[1:])]

    for batch in batches:
        for row, body, guest in zip(batch.column(0), batch.column(1), batch.column(2)):
            held.append((row.as_py(), body.as_py() or ""))
            size += len(held[-1][1])
            if (size > 1_000_000 or guest.as_py()) and len(held) > 1:
                yield _batch(_compared(pairs()))
                held, size = ([], 0) if guest.as_py() else (held[-1:], len(held[-1][1]))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likeness.

    The order is by descending key, cut into parts by quantiles of the key. The text that opens a part
    also goes, as a guest, to the end of the part before, so a part can be walked on its own.
    """
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.withColumn("tie", F.xxhash64("body"))
    marks = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("id", marks, max(10_000, 20 * parts))).first()[0] if marks else None
    bounds = np.unique(np.array(found or [], np.int64))
    narrow = rows.select("id", "tie").mapInArrow(_placed(bounds), "id long, tie long, part int")
    # as many rows as parts: the first row of each, and the part before it (before the first comes the last)
    opening = narrow.groupBy("part").agg(F.max(F.struct("id", F.bitwise_not("tie").alias("tie"))).alias("first"))
    order = W.orderBy("part")
    heads = stage(opening.select(F.col("first.id").alias("hid"), F.bitwise_not("first.tie").alias("htie"),
                                 F.coalesce(F.lag("part").over(order), F.max("part").over(W.partitionBy())).alias("part")), "fingerprint-heads")
    guests = (rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["hid"]) & (rows["tie"] == heads["htie"]))
              .select("id", "body", "tie", "part").dropDuplicates(["part"]))
    placed = rows.mapInArrow(_placed(bounds), "id long, body string, tie long, part int")
    every = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    walked = (every.repartitionByRange(parts, "part").sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "tie")
              .select("id", "body", "guest").mapInArrow(_walk, _SCHEMA))
    return walked.withColumnRenamed("id", key)
