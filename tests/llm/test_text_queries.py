"""Registered queries against their SQL, or against a brute-force version, on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from brindle.llm.queries import QUERIES
from registry.check import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, small, con, name):
    fn, sql = QUERIES[name]
    assert compare(fn(spark, small).toPandas(), con.sql(sql).df()).startswith("ok")


def test_all_thirteen_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) <= set(entry.queries())


def test_fingerprints_by_brute_force(spark, small, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op2_fingerprints"][0](spark, small).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(texts)
    by_text = {}
    for doc, following in zip(order, order[1:] + order[:1]):
        text, half = texts[doc], len(texts[doc]) // 2
        edited = text[:len(text) - half] + texts[following][:half]
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_next"] <= 1 and 0 <= row["near_edited"] <= 1
        assert by_text.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (text == edited)
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in rows.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95


def test_packing_round_trip(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = QUERIES["op4_packing"][0](spark, small).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_doc) == sorted(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0  # no sequence needs padding


def _agreement(rows, truth, column):
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return np.mean([r[column] == truth[r["doc_id"]] for r in held]), len(held)


def test_language_on_held_out_rows(spark, small, con):
    rows = QUERIES["op9_language_id"][0](spark, small).collect()
    truth = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    share, n = _agreement(rows, truth, "lang_pred")
    assert n > 30 and share > 0.95


def test_quality_on_held_out_rows(spark, small, con):
    rows = QUERIES["op5_quality"][0](spark, small).collect()
    truth = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    share, n = _agreement(rows, truth, "predicted")
    assert n > 10 and share > 0.9


def test_main_text_of_all_pages(spark, small, con):
    """The given pages hold their text in headings and paragraphs of one article element."""
    import html

    rows = {r["page_id"]: r for r in QUERIES["op6_main_text"][0](spark, small).collect()}
    for page, source in con.sql("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", source or "", re.S)
        parts = [re.sub(r"</?b>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:h1|p)>", inner[1])] if inner else []
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert rows[page]["text"] == "\n\n".join(p for p in parts if p)
        assert rows[page]["n_chars"] == len(rows[page]["text"])


def test_pipeline_by_brute_force(spark, small, texts):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, step in pipeline.STAGES:
        docs = pipeline.stage(step(spark, docs, small), "test")
        kept[name] = docs.collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    lettered = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in kept["language identification"]} == set(lettered)
    first = {}
    for i in sorted(lettered):
        first.setdefault(normal(lettered[i]), i)
    assert sorted(r["doc_id"] for r in kept["exact dedup"]) == sorted(first.values())
    sets = {i: _runs(lettered[i], 5) for i in first.values()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in kept["near dedup"]) == sorted(i for i in sets if find(i) == i)
    assert all(r["text"] == texts[r["doc_id"]] for r in kept["near dedup"])
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    total = words(kept["near dedup"])
    assert abs(words(kept["mixing"]) - 1.5 * total) < 40  # each source ends within one word of its budget
    packed = {}
    for p in kept["packing"]:
        packed[p["doc_id"]] = packed.get(p["doc_id"], 0) + p["length"]
    assert set(packed) == {r["doc_id"] for r in kept["mixing"]}


def _runs(text: str, size: int) -> set:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
