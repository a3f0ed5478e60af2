"""Fill-in-the-middle, decontamination and spelling variants: brute force, and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontaminate, fill_middle, spelling


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def source(awkward):
    return rows_of(awkward)


# fill in the middle

def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for n in (0, 1, 2, 4, 5, 17, 400):
        widths = np.array([rng.randrange(1, 9) for _ in range(n)], np.int64)
        units = fill_middle.SkipList(widths)
        assert len(units) == n
        assert [units.points_before(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        with pytest.raises(IndexError):
            units.points_before(n + 1)


def test_skip_list_descends_in_few_steps():
    units = fill_middle.SkipList(np.full(1_000_000, 3, np.int64))
    links = sum(len(u) for u, _, _ in units.lanes)
    assert len(units.lanes) > 7 and links < 1.4e6 and units.points_before(777_777) == 3 * 777_777


def middle_by_hand(doc, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_by_brute_force_and_round_trip(spark, awkward, empty, source):
    more = [(100 + i, t) for i, t in enumerate(["<", "<P", "<S<M", "a<P>b", "<<<", "P>S>M>", "\n", "é", "𝒳𝒳 a", "x" * 5000, "1234567890" * 700, "a b " * 50_000])]
    more += [(1000 + i, "<S <M <P one < two > three") for i in range(300)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    made = fill_middle.fill_in_middle(docs).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows_of(made))
    given = [(r["doc_id"], r["text"]) for r in source] + more
    assert got == Counter((i, *middle_by_hand(i, t or "")) for i, t in given)
    assert Counter((r["doc_id"], r["restored"]) for r in rows_of(made)) == Counter((i, t or "") for i, t in given)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(empty).count() == 0


# benchmark decontamination

def leaks_by_hand(docs, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(size, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + min(size, len(w))]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                named = windows.get(tuple(w[i:i + n]))
                if named:
                    hit |= set(range(i, i + n))
                    found |= named
        out[doc, len(w), len(hit), ",".join(sorted(found)), bool(hit)] += 1
    return out


def leaks(docs, items, **options):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in rows_of(decontaminate.contaminated(docs, items, **options)))


ITEM = "item_id string, text string"


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Cé", "d1", "漢", "f"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([1, 2, 3, 4, 5, 6, 7, 12]))) for k in range(25)] + [("i0", say(9)), (None, say(6)), ("none", None), ("blank", " .,; ")]
    docs = [(k, say(rng.randrange(0, 40)).replace(" ", rng.choice([" ", ", ", "\n-- "]))) for k in range(150)] + [(7, say(5)), (None, say(20)), (900, None), (901, "")]
    for size in (6, 10):
        got = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, ITEM), size=size)
        assert got == leaks_by_hand(docs, items, size)


def test_leaks_of_awkward_rows(spark, awkward, empty, source):
    long = next(r["text"] for r in source if r["doc_id"] == 13)
    items = [("whole", long), ("part", " ".join(long.split()[4000:4025])), ("short", "TWO three"), ("kanji", "漢字"), ("end", " ".join(long.split()[-3:]))]
    table = spark.createDataFrame(items, ITEM).selectExpr("*", "1 as key", "2 as at", "3 as window", "4 as row", "5 as length")
    got = leaks(awkward, table)
    assert got == leaks_by_hand([(r["doc_id"], r["text"]) for r in source], items)
    assert any(n_hit > 8900 for _, _, n_hit, _, _ in got)
    assert not any(hit for *_, hit in leaks(awkward, table.limit(0)))
    assert decontaminate.contaminated(empty, table).count() == 0


def test_a_passage_of_a_third_of_all_documents(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = [(i, f"own{i} text " + (passage if i % 3 == 0 else " ".join(f"w{i}x{j}" for j in range(9)))) for i in range(900)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("p", passage), ("q", passage + " tail")], ITEM))
    assert sum(n for (_, _, n_hit, items, _), n in got.items() if n_hit == 30 and items == "p,q") == 300
    assert sum(n for (_, _, n_hit, *_), n in got.items() if n_hit == 0) == 600


# spelling variants

def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def forms_by_hand(counts: dict[str, int]):
    form, around = {}, {}
    for w in counts:
        around[w] = [x for x in counts if near(w, x)]
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(around[w]), None if form[w] is None else counts[form[w]]))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_forms_by_brute_force(spark):
    rng = random.Random(8)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))): rng.choice([1, 2, 9, 10, 30, 300, 4000]) for _ in range(500)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r[c] for c in COLUMNS) for r in rows_of(spelling.variant_forms(words))} == forms_by_hand(counts)
    assert max(len(set(x)) for x in [[w for w, f, r, *_ in forms_by_hand(counts) if f and f != r]]) > 5  # chains of several steps


def test_segments_meet_their_visitors(spark, monkeypatch):
    """Many small segments, and half of all words behind one long prefix."""
    monkeypatch.setattr(spelling, "SEGMENT", 30)
    rng = random.Random(9)
    words = {"prefix" * rng.randrange(2) + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(700)}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = Counter((r["word"], r["near"]) for r in rows_of(spelling.near_pairs(table)))
    assert got == Counter((a, b) for a in words for b in words if near(a, b))


def words_by_hand(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_vocabulary_and_forms_of_awkward_rows(spark, awkward, empty, source):
    docs = [(500 + i, "Éléphant élephant GARDENER gardener gardner " * 3) for i in range(60)] + [(900, "y" * 3000 + " " + "y" * 3000), (901, "y" * 3001 + " " + "y" * 3001)]
    given = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    words = spelling.vocabulary(given)
    want = words_by_hand([(r["doc_id"], r["text"]) for r in source] + docs)
    assert {r["word"]: r["n"] for r in rows_of(words)} == want
    got = {r["word"]: r for r in rows_of(spelling.variant_forms(words))}
    assert got["y" * 3000]["n_near"] >= 1 and got["y" * 3000]["form"] is None
    assert {tuple(r[c] for c in COLUMNS) for r in got.values()} == forms_by_hand(want)
    assert spelling.variant_forms(spelling.vocabulary(empty)).count() == 0
