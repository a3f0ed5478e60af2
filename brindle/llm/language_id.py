"""Language of texts: first the family, then one-versus-one linear machines inside it.

A text is the mean, over its places, of weights of three-byte grams (lower case; bytes that are no
letters count as a space), so one look-up per byte scores it. The machines are fitted on a sample of
about ``per_language`` training texts of each language, drawn by a hash of the id: its bound does not grow with
the corpus. Each pair of families and each pair of languages of one family has its machine; the most
wins take it, then the larger sum of margins, then the smaller name. The score is the product of the
winner's mean squashed margins on both levels.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing can be learned; a null language is not learned from; a language that the table of families lacks
is of the family ``other``; repeated rows are predicted each; empty input gives no rows; other columns
are not read. Texts of any length are scored in pieces of a few MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brindle.llm.linear import hinge_fit
from brindle.llm.tables import workers_import
from brindle.llm.words import buffer

BITS = 14
PIECE = 1_000_000
# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _grams(part: np.ndarray) -> np.ndarray:
    """Hashed column of the three bytes that begin at each place."""
    b = _LETTERS[part].astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its padded bytes in pieces that overlap by two); a space stands before and after a text."""
    for i in range(len(offsets) - 1):
        text = np.concatenate([[32], data[offsets[i]:offsets[i + 1]], [32]]).astype(np.uint8)
        for a in range(0, max(len(text) - 2, 1), PIECE):
            yield i, text[a:a + PIECE + 2]


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, columns, shares) of whole sampled texts."""
    for batch in batches:
        data, offsets = buffer(batch.column(1))
        out: list[tuple] = []
        counts = np.zeros(1 << BITS)
        for i in range(batch.num_rows):
            counts[:] = 0
            for _, part in _spans(data, offsets[i:i + 2]):
                if len(part) > 2:
                    counts += np.bincount(_grams(part), minlength=1 << BITS)
            columns = np.flatnonzero(counts)
            if len(columns):
                out.append((batch.column(0)[i].as_py(), columns.astype(np.int16).tobytes(), (counts[columns] / counts.sum()).astype(np.float32).tobytes()))
        if out:
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["lang", "columns", "shares"])


def _pair(rows: list[tuple], names: np.ndarray, a: str, b: str) -> np.ndarray:
    pick = np.flatnonzero((names == a) | (names == b))
    y = np.where(names[pick] == a, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    return hinge_fit([rows[i][0] for i in pick], [rows[i][1] for i in pick], y, 1 << BITS, cost=cost)


class Machines:
    """The fitted pairs: names, weights (columns + 1, pairs), and which pairs decide on which level."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        langs = np.array([r[0] for r in rows], object)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(_FAMILY.get(lang, "other"), []).append(lang)
        # columns that vary little weigh as much as frequent ones; the scale is folded into the weights
        total, square = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for _, c, v in rows:
            total[c] += v
            square[c] += v * v
        spread = np.sqrt(np.maximum(square / len(rows) - (total / len(rows)) ** 2, 0)) + 1e-4
        scaled = [(c, v / spread[c]) for _, c, v in rows]
        unit = float(np.mean([np.sqrt(v @ v) for _, v in scaled]))
        scaled = [(c, v / unit) for c, v in scaled]
        kin = np.array([_FAMILY.get(x, "other") for x in langs], object)
        self.pairs: list[tuple[str, str, str]] = []  # (level, first, second)
        weights = []
        for a, b in combinations(sorted(self.families), 2):
            self.pairs.append(("", a, b))
            weights.append(_pair(scaled, kin, a, b))
        for family, members in self.families.items():
            for a, b in combinations(members, 2):
                self.pairs.append((family, a, b))
                weights.append(_pair(scaled, langs, a, b))
        w = np.array(weights).reshape(len(weights), (1 << BITS) + 1).T
        w[:-1] /= (spread * unit)[:, None]
        self.weights, self.offsets = np.ascontiguousarray(w[:-1], np.float32), w[-1]

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, pairs): mean weight over the places of a text."""
        total, places = np.zeros((len(offsets) - 1, len(self.pairs))), np.zeros(len(offsets) - 1)
        for i, part in _spans(data, offsets):
            if len(part) > 2:
                grams = np.bincount(_grams(part), minlength=1 << BITS)
                seen = np.flatnonzero(grams)
                total[i] += grams[seen] @ self.weights[seen]
                places[i] += len(part) - 2
        return total / np.maximum(places, 1)[:, None] + self.offsets

    def _level(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning name per text and its mean squashed margin."""
        wins, sums, squashed = (np.zeros((len(margins), len(names))) for _ in range(3))
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level:
                i, j, m = names.index(a), names.index(b), margins[:, k]
                wins[:, i] += m >= 0
                wins[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
                squashed[:, i] += p
                squashed[:, j] += 1 - p
        best = np.argmax(wins + 0.4 * np.tanh(sums / max(1, len(names))), axis=1)
        return best, squashed[np.arange(len(margins)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(margins))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = self.margins(data, offsets)
        kin = sorted(self.families)
        family, score = self._level("", kin, margins)
        out = np.empty(len(margins), object)
        for f, name in enumerate(kin):
            here = np.flatnonzero(family == f)
            if len(here):
                lang, inner = self._level(name, self.families[name], margins[here])
                out[here] = np.array(self.families[name], object)[lang]
                score[here] *= inner
        return out.tolist(), score


def _predict(machines: Machines | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                langs, scores = ["und"] * some.num_rows, np.zeros(some.num_rows)
                if machines is not None:
                    langs, scores = machines.predict(*buffer(some.column(3)))
                    lettered = some.column(2).to_pylist()
                    langs = [x if ok else "und" for x, ok in zip(langs, lettered)]
                    scores = np.where(np.array(lettered, bool), scores, 0.0)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(langs, pa.string()), pa.array(scores), *some.columns[4:]],
                                                 names=["id", "held_out", "lang_pred", "score", *some.schema.names[4:]])
    return run


def fit(docs: DataFrame, held_out: Column, *, key: str, text: str, lang: str, per_language: int = 400) -> Machines | None:
    """Machines from a hash sample of the rows that are not held out and have a language and a text."""
    known = docs.where(~held_out & F.col(lang).isNotNull()).select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("body"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    odds = F.lit(0.0)
    for name, n in counts.items():
        odds = F.when(F.col("lang") == name, F.lit(per_language / n)).otherwise(odds)
    drawn = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = known.where((drawn < odds) & F.col("body").rlike(r"\p{L}")).select("lang", "body")
    rows = sample.mapInArrow(_gram_rows, "lang string, columns binary, shares binary").collect()
    rows = sorted((r["lang"], bytes(r["columns"]), bytes(r["shares"])) for r in rows)
    return Machines([(a, np.frombuffer(b, np.int16).astype(np.int64), np.frombuffer(c, np.float32).astype(float)) for a, b, c in rows]) if rows else None


def identify(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400,
             whole_rows: bool = False) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score; with ``whole_rows`` also ``row``, a struct of all columns."""
    workers_import(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False))
    return _apply(fit(docs, held, key=key, text=text, lang=lang, per_language=per_language), docs, held, key, text, whole_rows)


def _apply(machines: Machines | None, docs: DataFrame, held: Column, key: str, text: str, whole_rows: bool) -> DataFrame:
    out = T.StructType().add("id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    rows = docs.select(F.col(key).cast("long").alias("id"), held.alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
                       F.col(text).cast("string").alias("body"), *([F.struct(*docs.columns).alias("row")] if whole_rows else []))
    return rows.mapInArrow(_predict(machines), out.add("row", docs.schema) if whole_rows else out).withColumnRenamed("id", key)


def of_known_language(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400,
                      share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told by the machines, a missing ``lang`` filled with the prediction.

    A row goes if it has no letter, or if its score is below ``share`` of the least score that a held-out row of a known and
    rightly predicted language has. Without a language to learn, or such a row, only the letters decide.
    """
    workers_import(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False))
    machines = fit(docs, held, key=key, text=text, lang=lang, per_language=per_language)
    known = _apply(machines, docs.where(held & F.col(lang).isNotNull()), held, key, text, True)
    least = known.where(F.col("lang_pred") == F.col("row")[lang]).agg(F.min("score")).first()[0]
    found = _apply(machines, docs, held, key, text, True).where(F.col("row")[text].rlike(r"\p{L}") & (F.col("score") >= F.lit(share * (least or 0.0))))
    told = F.when(F.col("lang_pred") != "und", F.col("lang_pred"))
    return found.select(*[F.coalesce(F.col("row")[c], told).alias(c) if c == lang else F.col("row")[c].alias(c) for c in docs.columns])
