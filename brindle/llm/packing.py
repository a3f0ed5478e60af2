"""Packing of tokenised documents into fixed sequences along a Hilbert curve.

The words of a document, hashed, are projected on a few random directions of signs; the mean per
direction is one coordinate, and the point's place on the Hilbert curve is the document's key.
Documents are range-partitioned and sorted by that key and their id, so that a third of all rows
with one key still spreads over partitions. Each partition is one stream of token ids: it is cut every
``length`` ids, and what remains at its end is cut into sequences whose sizes are powers of two,
which need no padding. No sequence is padded at all, and partitions need not know of each other.

Defined results: a null or empty text is its end token alone; repeated rows are packed each, and of rows with one
key and id either may come first; a very long text is cut wherever a sequence ends; a null
id sorts first; empty input gives no rows; other columns are not read. A partition's rows stream
through memory: beyond one batch only an unfinished sequence is kept.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from brindle.llm.tables import stage, workers_import
from brindle.llm.words import buffer, words

DIMENSIONS, BITS = 4, 10
CACHED = 600_000


# --- the curve ----------------------------------------------------------------------------------

def coordinates(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One point per text: per direction the mean sign of its words, as an integer of BITS bits."""
    count = np.diff(first)
    out = np.zeros((DIMENSIONS, len(count)), np.int64)
    for d in range(DIMENSIONS):
        signs = ((hashes >> np.uint64(11 + 7 * d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(signs)])
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
        out[d] = np.clip((mean + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return out


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points given as (dimensions, n) integers below 2^bits.

    Skilling's transposed form (AIP Conf. Proc. 707, 2004), on all points at once.
    """
    x = points.astype(np.int64).copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            up = (x[i] & level) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, _, first = words(*buffer(batch.column(1)))
        curve = hilbert_index(coordinates(hashes, first))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(curve, pa.int64())], names=["id", "body", "curve"])


# --- token ids ----------------------------------------------------------------------------------

# Words with one space or line break between any two, and no other white space.
PLAIN = re.compile(r"\S++(?:[ \n]\S++)*+")

# The pre-tokenizer's published pattern (byte-level BPE of 50,257 ids): a fixed value.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, with the words seen before kept.

    A single space or line break between two characters that are no white space always begins a new
    pre-token, so a text may be encoded in the parts between such places. New parts go through the
    same merges in the faster of the two installed libraries, with ranks read from the tokenizer's
    own file; texts with other white space or special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            raise ValueError("the merges are not in the order of the ids")
        byte = {s: b for b, s in enumerate(byte_signs())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        self.ids = tiktoken.Encoding("parts", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced: dict[str, bytes] = {}  # words after a space
        self.bare: dict[str, bytes] = {}  # words at the begin of a line
        self.line = self._part("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 200):
            lines: list[list[list[str]] | str] = []
            for t in texts[at:at + 200]:
                plain = PLAIN.fullmatch(t) and not any(s in t for s in self.special)
                lines.append([line.split(" ") for line in t.split("\n")] if plain else t)
            if len(self.spaced) > CACHED or len(self.bare) > CACHED:
                self.spaced.clear(), self.bare.clear()
            bare, spaced, part = self.bare, self.spaced, self._part
            for text in lines:
                if isinstance(text, str):
                    yield self._whole(text)
                    continue
                out = []
                for line in text:
                    if line[0] not in bare:
                        bare[line[0]] = part(line[0])
                    out.append(self.line if out else b"")
                    out.append(bare[line[0]])
                    for w in line[1:]:
                        if w not in spaced:
                            spaced[w] = part(" " + w)
                    out.extend(map(spaced.__getitem__, line[1:]))
                yield b"".join(out)


# --- sequences ----------------------------------------------------------------------------------

_OUT = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                  ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())])


def cut_stream(docs: Iterator[tuple[int, bytes]], length: int, first_id: int) -> Iterator[tuple]:
    """Pieces of a stream of (id, token bytes); those of one sequence are yielded together."""
    held, room, sequence = [], length, first_id
    for doc, ids in docs:
        n, at = len(ids) // 4, 0
        while at < n:
            step = min(room, n - at)
            held.append((doc, at, ids[4 * at:4 * (at + step)], n))
            at, room = at + step, room - step
            if not room:
                yield from _placed(held, sequence, length)
                held, room, sequence = [], length, sequence + 1
    left = length - room
    while left:  # the rest: its largest power of two is the next sequence
        size = 1 << (left.bit_length() - 1)
        taken, need = [], size
        while need:
            doc, at, ids, n = held.pop(0)
            k = len(ids) // 4
            if k > need:
                held.insert(0, (doc, at + need, ids[4 * need:], n))
                ids, k = ids[:4 * need], need
            taken.append((doc, at, ids, n))
            need -= k
        yield from _placed(taken, sequence, size)
        left, sequence = left - size, sequence + 1


def _placed(pieces: list[tuple], sequence: int, size: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, n in pieces:
        k = len(ids) // 4
        yield doc, start, k, ids, n, sequence, offset, size
        offset += k


_ENCODERS: dict[str, Encoder] = {}


def _pack(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        last = np.array([end], "<u4").tobytes()

        def docs():
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    texts = [t or "" for t in some.column(1).to_pylist()]
                    for doc, ids in zip(some.column(0).to_pylist(), _ENCODERS[path].encode(texts)):
                        yield doc, ids + last

        rows = []
        for piece in cut_stream(docs(), length, TaskContext.get().partitionId() << 40):
            rows.append(piece)
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
    return run


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", length: int = 2048, end: int = 1) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, sequence_tokens."""
    if length < 1 or length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    workers_import(docs.sparkSession)
    # written once: drawing the range bounds reads the rows a second time
    keyed = stage(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
                  .mapInArrow(_keys, "id long, body string, curve long"), "pack-keys")
    order = ["curve", "id"]
    packed = (keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "body")
              .mapInArrow(_pack(tokenizer, length, end), "id long, start long, length long, ids binary, doc_tokens long, "
                          "sequence_id long, offset long, sequence_tokens long"))
    return packed.withColumnRenamed("id", key)
