"""Fill-in-the-middle texts: two cut ranks per document, found in an indexable skip list of its units.

A unit is a run of ASCII letters or one other code point. Lane 0 of the list holds every unit with its
width in units (1) and in code points; a lane above holds the units that a hash of their rank promotes,
about one in STEP, and its links carry the sums of both widths below them. A search starts in the top
lane, follows links as long as the accumulated unit-width does not pass the rank, descends, and so
reaches the rank exactly with the code points before it: no unit is counted one by one.

Prefix, middle and suffix are written with sentinels, prefix first (psm) or suffix first (spm). A text that
is empty or holds a sentinel, and the share of texts that a hash leaves out, stay plain. As the text holds no
sentinel and a sentinel has its first character only at its start, each occurs once in the output, so the text
is rebuilt from output and form alone (``restored``).

Defined results: a null text is empty, and an empty text is plain with no units; a very long text is worked on whole, with
1/(STEP-1) more links than units; ties do not arise, as cuts depend on the id alone; rows that repeat an id get the same
hashes, each its own row; a null id counts as the text ``null``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.tables import workers_import
from brindle.llm.words import mix

STEP = 4
SENTINELS = ("<P>", "<S>", "<M>")
SLICE = 256


def unit_widths(text: str) -> np.ndarray:
    """Code points of every unit, in order."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = codes | np.uint32(32)
    letter = (low >= 97) & (low <= 122)
    begins = ~letter
    begins[:1] = True
    begins[1:] |= ~letter[:-1]
    return np.diff(np.append(np.flatnonzero(begins), len(codes)))


class SkipList:
    """Lanes of links, lowest first; link i of a lane leads from its node i over ``units[i]`` and ``points[i]``."""

    def __init__(self, widths: np.ndarray):
        ranks = np.arange(len(widths), dtype=np.uint64)
        towers = mix(ranks + np.uint64(1))
        self.lanes = [(np.ones(len(widths), np.int64), widths.astype(np.int64), None)]
        while len(ranks) > STEP:
            towers //= np.uint64(STEP)
            up = towers % np.uint64(STEP) == 0
            up[0] = True  # the head stands in every lane
            down = np.flatnonzero(up)
            units, points, _ = self.lanes[-1]
            # the last entry leads from the end of the lane to the end of the one below
            self.lanes.append((np.add.reduceat(units, down), np.add.reduceat(points, down), np.append(down, len(ranks))))
            if len(down) == len(ranks) or len(down) == 1:
                break
            ranks, towers = ranks[down], towers[down]

    def __len__(self) -> int:
        return len(self.lanes[0][0])

    def points_before(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        at = units_done = points_done = 0
        for units, points, down in reversed(self.lanes):
            while at < len(units) and units_done + units[at] <= rank:
                units_done += int(units[at])
                points_done += int(points[at])
                at += 1
            if down is not None:
                at = int(down[at])
        if units_done != rank:
            raise IndexError(rank)
        return points_done


def _transform(salt: str, plain_percent: int, spm_percent: int, sentinels: tuple[str, str, str]):
    p, s, m = sentinels

    def one(key: str, text: str) -> tuple:
        digest = hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
        units = SkipList(unit_widths(text))
        n = len(units)
        if not text or any(x in text for x in sentinels) or h3 % 100 >= 100 - plain_percent:
            return n, "plain", None, None, text
        a, b = (units.points_before(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                made = [one(k, t) for k, t in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                n, form, before, within, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                     pa.array(within, pa.int64()), pa.array(output, pa.string())],
                    names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", salt: str = "1", plain_percent: int = 10,
                   spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: key, n (units), form, prefix_chars, middle_chars, output (the text to train on)."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("named"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(_transform(salt, plain_percent, spm_percent, sentinels),
                           f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which ``output`` was made."""
    p, s, m = sentinels
    middle, head = F.substring_index(output, m, -1), F.substring_index(output, m, 1)

    def parted(first: str, second: str) -> tuple[Column, Column]:
        return F.replace(F.substring_index(head, second, 1), F.lit(first), F.lit("")), F.substring_index(head, second, -1)

    prefix, suffix = parted(p, s)
    suffix_first, prefix_last = parted(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(output)
