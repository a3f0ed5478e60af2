"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from brindle.llm import exact_dedup, fingerprints, language_id, main_text, mixing, near_dedup, ngram_scores, packing, quality, secret_scan
from brindle.llm.tables import hash_mod


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def source(awkward):
    return rows_of(awkward)


def ids_of(rows) -> Counter:
    return Counter(r["doc_id"] for r in rows)


def test_scores(awkward, empty, source):
    got = rows_of(ngram_scores.score_texts(awkward, hash_mod("doc_id", 5) == 1))
    assert ids_of(got) == ids_of(source)
    tokens = {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] is not None}
    assert tokens[4] == tokens[5] == tokens[6] == 1 and tokens[13] == 9001
    assert all(r["n_known"] <= r["n_tokens"] and np.isfinite(r["score"]) for r in got)
    assert ngram_scores.score_texts(empty, hash_mod("doc_id", 5) == 1).count() == 0


def one_block(texts: list[str], held: list[bool]):
    import pyarrow as pa

    from brindle.llm.words import buffer, words

    hashes, _, first = words(*buffer(pa.array(texts)))
    row = ngram_scores._row(0, list(range(len(texts))), held, hashes, np.diff(first)).to_pylist()[0]
    return ngram_scores._Block(row, 48, walked=True)


def test_states_sum_to_one():
    """Over all learned words and the unknown one, the probabilities of every state's arcs and falls sum to one."""
    texts = ["a b a b c", "a b c c a", "b a c", "unseen"]
    b = one_block(texts, [False, False, False, True])
    n_train, n_words = 3 + sum(len(t.split()) for t in texts[:3]), 4
    machine = ngram_scores.Automaton(b, b.counts, n_train, n_words, (4.0, 0.9))
    # the words a, b, c and end, and one for all that was never learned, which has its base probability
    symbols = np.arange(machine.words)
    assert machine.words == 5 and (machine.of_word > 0).sum() == 4
    # a text stops at its end, so nothing follows what an end leads to
    inner = np.flatnonzero(np.append(b.place[1:], 0) > 0)
    states = {0} | {int(machine.of_word[machine.word[i]]) for i in inner} | {int(machine.of_bigram[b.ends[1][i]]) for i in inner if b.place[i] > 0}
    assert len(states) > 8
    for state in states:
        _, score = machine.step(np.full(len(symbols), state), symbols)
        assert (10.0 ** score).sum() == pytest.approx(1)


def test_the_walk_carries_the_longest_known_context(monkeypatch):
    """Against the formula over counts of n-grams, with long texts walked in stretches."""
    monkeypatch.setattr(ngram_scores, "STRETCH", 7)
    rng = __import__("random").Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 5, 40, 7, 14, 15, 90)]
    held = [i % 3 == 1 for i in range(len(texts))]
    b = one_block(texts, held)
    tokens = [t.split() + ["</s>"] for t in texts]
    counts = [Counter(tuple(t[i - n:i + 1]) for t, h in zip(tokens, held) if not h for i in range(n, len(t))) for n in range(3)]
    n_train, n_words = sum(len(t) for t, h in zip(tokens, held) if not h), len(counts[0])

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 0.5) / (n_train + 0.5 * (n_words + 1))
        c = counts[len(gram) - 2][gram[:-1]]
        mass = 4.0 * c ** 0.9
        return (counts[len(gram) - 1][gram] + mass * p(gram[1:])) / (c + mass) if c else p(gram[1:])

    machine = ngram_scores.Automaton(b, b.counts, n_train, n_words, (4.0, 0.9))
    want = [np.log10(p(tuple(t[max(0, i - 2):i + 1]))) for t in tokens for i in range(len(t))]
    assert machine.walk(b.starts, b.sizes) == pytest.approx(want)


def test_two_hops_give_the_same_scores(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(ngram_scores, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(ngram_scores, "LEAST_KEYS", 0)
    key = lambda r: (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
    one = Counter(map(key, rows_of(ngram_scores.score_texts(awkward, hash_mod("doc_id", 5) == 1))))
    monkeypatch.setattr(ngram_scores, "LEAST_KEYS", 10**9)
    two = Counter(map(key, rows_of(ngram_scores.score_texts(awkward, hash_mod("doc_id", 5) == 1))))
    assert one == two and sum(one.values()) == awkward.count()
    assert ngram_scores.score_texts(empty, hash_mod("doc_id", 5) == 1).count() == 0


def test_rows_sent_to_buckets_follow_the_keys(monkeypatch):
    """Four times as many buckets send no more rows than there are keys, however many buckets stay empty."""
    import pyarrow as pa

    b = one_block(["a b c d e f g h", "a b c"], [False, True])
    batch = pa.RecordBatch.from_pylist([b.row], schema=pa.schema([
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("train_tokens", pa.int64()), ("n", pa.int64()),
        *[(c, pa.binary()) for c in ("sizes", "vocab", "ranks", "tokens")]]))
    keys = sum(len(d) for d in b.distinct)
    for buckets in (4, 16, 40):
        sent = [r for out in ngram_scores._send(buckets, 48)(iter([batch])) for r in out.to_pylist()]
        assert len(sent) <= keys and sum(len(ngram_scores._unpack_keys(r["keys"])) for r in sent) == keys
        assert len({(r["bucket"], r["n"]) for r in sent}) == len(sent)


def test_fingerprints(awkward, empty, source):
    got = rows_of(fingerprints.fingerprint_documents(awkward))
    assert ids_of(got) == ids_of(source)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] != by_id[10]["fingerprint"]
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"] and by_id[4]["n_chars"] == 0
    assert by_id[14]["n_chars"] == len("é ü ñ 漢字 𝒳 end")
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprint_of_one_row(spark):
    one = rows_of(fingerprints.fingerprint_documents(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")))
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest() and one[0]["near_next"] == 1.0


def test_differing_branches_locate_an_edit():
    lines = [f"line {i} has some words of its own {i * 7} and {i * 13}" for i in range(60)]
    changed = list(lines)
    changed[30] = "this line is another one"
    one, two = fingerprints.trees(["\n".join(lines), "\n".join(changed)])
    a, b = one.written(), two.written()
    places = fingerprints.differing(a, b)
    assert 1 <= len(places) <= 2 and fingerprints.differing(a, a) == []
    left, right = fingerprints.descend(one, two)
    assert len(left) == len(right) == len(places) and fingerprints.descend(one, one) == ([], [])
    assert 0.9 < fingerprints.likeness(one, two) < 1
    assert np.array_equal(fingerprints.leaves_of(a), np.sort(np.concatenate([leaf for _, inner in one.sections for _, leaf in inner])))


def test_roots_tell_texts_apart_whose_leaves_collide():
    one, two = fingerprints.trees(["01039105", "15835569"])
    assert fingerprints.leaves_of(one.written()).tolist() == fingerprints.leaves_of(two.written()).tolist()
    assert one.root != two.root and one.written() != two.written()


def test_nodes_and_likeness_by_brute_force():
    """Nodes from the bytes of the paragraphs; the likeness of the descent is the Dice coefficient over all leaves."""
    rng = __import__("random").Random(4)
    say = lambda n: "\n".join(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))) for _ in range(n))
    texts = ["", "a", "\n", "  \n\n x"] + [say(rng.randrange(1, 40)) for _ in range(30)]
    texts += [t[:len(t) // 2] + u[:len(t) // 3] for t, u in zip(texts, texts[1:])]
    made = fingerprints.trees(texts)
    for text, tree in zip(texts, made):
        nodes = [p for _, inner in tree.sections for p, _ in inner]
        assert b"".join(nodes) == b"".join(hashlib.blake2b(b.encode(), digest_size=16).digest() for b in _paragraphs(text, tree))
        assert "".join(_paragraphs(text, tree)) == text
        assert all(s == hashlib.blake2b(b"".join(p for p, _ in inner), digest_size=16).digest() for s, inner in tree.sections)
        assert tree.root == hashlib.blake2b(b"".join(s for s, _ in tree.sections), digest_size=16).digest()
    leaves = [Counter(fingerprints.leaves_of(t.written()).tolist()) for t in made]
    for i in range(0, len(made), 3):
        for j in range(len(made)):
            both = sum(leaves[i].values()) + sum(leaves[j].values())
            want = (2 * sum((leaves[i] & leaves[j]).values()) / both) if leaves[i] and leaves[j] else float(not leaves[i] and not leaves[j])
            assert fingerprints.likeness(made[i], made[j]) == want


def _paragraphs(text, tree):
    """The text cut where a run of white space that holds a line break begins, as often as the tree has paragraphs."""
    cuts = [m.start() for m in re.finditer(r"[\x20\x09-\x0D]+", text) if "\n" in m[0] and m.start() > 0]
    ends = [*cuts, len(text)] if text else []
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def test_secrets(spark, empty, awkward, source):
    assert ids_of(rows_of(secret_scan.find_secrets(awkward))) == ids_of(source)
    assert secret_scan.find_secrets(empty).count() == 0
    texts = ["token=secret=abcdefgh", "secret=token:abcdefgh", "é PASSWORD: 'hunter22' x", "api_key = \"short\"", "AKIA" + "A" * 16 + " AKIA123",
             "0" * 24 + "g" + "f" * 23, "ghp_" + "a1" * 18, None, "𝒳 passwd=aaaaaa passwd=bbbbbb", "-----BEGIN RSA PRIVATE KEY-----"]
    got = {r["doc_id"]: r for r in rows_of(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    base = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in enumerate(texts):
        spans = [(m.start(), 0, "assign", m.end()) for m in base.finditer(text or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if m.end() - m.start() >= 24]
        written = ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[i]["spans"].split(","))
    assert "github:0:40" in got[6]["spans"] and got[9]["spans"] == "private_key:0:31"


def test_a_text_of_many_spans_takes_linear_time(spark):
    """20,000 spans in one text; a list that grows by copying would take minutes."""
    import time

    text = " ".join(f"token=abcdef{i}" for i in range(20_000))
    begin = time.time()
    row = secret_scan.find_secrets(spark.createDataFrame([(1, text), (2, "token=abcdefg")], "doc_id long, text string")).where("doc_id = 1").first()
    assert row["n_assign"] == 20_000 and time.time() - begin < 60
    want = [f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=[a-z0-9]+", text)]
    assert row["spans"].split(",") == want


def test_trigram_queries_hold_for_every_match():
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query(r"abcd") == {frozenset({"abc", "bcd"})}
    assert secret_scan.trigram_query(r"(foo|bar)x*") == {frozenset({"foo"}), frozenset({"bar"})}
    assert secret_scan.trigram_query(r"ab?c") is None
    assert secret_scan.trigram_query(r"(?:xyz1)+[0-9]*end") == {frozenset({"xyz", "yz1", "end"})}


def test_packing(awkward, empty, source):
    pieces = rows_of(packing.pack(awkward, tokenizer_path()))
    assert set(ids_of(pieces)) == set(ids_of(source))
    ends = Counter(p["doc_id"] for p in pieces if p["start"] + p["length"] == p["doc_tokens"])
    assert ends == ids_of(source)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(tokenizer_path())
    texts = ["a  b", "a   b", "  x", "   x y \n z", "a\n b", "", "  ", "<|endoftext|> a  <|endoftext|> b", "x \x1c y", "don't  stop 12  34!? é\t\tq", "a   b", "漢字 𝒳\nnext line"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.encode(texts)) == want


def test_encoder_sends_other_white_space_whole():
    """Texts whose words and separators count up although their white space is not single blanks between words."""
    encoder = packing.Encoder(tokenizer_path())
    texts = ["a\n\xa0\xa0b", "a\tb\tc\n\n\nd", "a\tb\tc\n\n", " a\tb", "a\u2003b  c", "a\x85b \nc", "a b\nc d", "a\x1cb  c", "a\u180eb c\u200bd"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.encode(texts)) == want


def test_hilbert_curve_visits_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1)
    place = packing.hilbert_index(points, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(points[:, np.argsort(place)], axis=1)).sum(axis=0) == 1).all()


def test_cut_stream_needs_no_padding():
    docs = [(i, b"\x01\x00\x00\x00" * n) for i, n in enumerate([5, 0, 17, 3, 64, 1])]
    pieces = list(packing.cut_stream(iter(docs), 16, 0))
    sizes = Counter()
    for _, _, k, _, _, sequence, offset, size in pieces:
        assert offset == sizes[sequence]
        sizes[sequence] += k
    assert sorted(sizes.values()) == [2, 8, *[16] * 5] and list(packing.cut_stream(iter([]), 16, 0)) == []


def test_language_stage_keeps_letters_without_a_language(spark, awkward, source):
    lettered = ids_of(r for r in source if any(c.isalpha() for c in r["text"] or ""))
    for docs in (awkward, awkward.selectExpr("* except (lang)", "cast(null as string) as lang")):
        assert ids_of(rows_of(pipeline.identify_language(spark, docs, ""))) == lettered


def test_quality(spark, awkward, empty, source):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 18)] + [(1, None), (None, 1), (99, 0), (2, 7)], "doc_id long, quality int")
    got = rows_of(quality.score_quality(awkward, labels, hash_mod("doc_id", 5) == 0))
    assert ids_of(got) == ids_of(source) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(empty, labels, hash_mod("doc_id", 5) == 0).count() == 0
    assert {r["score"] for r in rows_of(quality.score_quality(awkward, labels.limit(0), hash_mod("doc_id", 5) == 0))} == {0.5}


def test_main_text(spark):
    pages = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain words, no tags at all, that go on for a while.", "x"), (3, "u", "<p>unclosed <b>bold<p>next &lt;x&gt; one.", "x"),
             (None, "u", "<nav><a href=a>Home</a></nav><main><h1>Head</h1><p>A text  with &amp;\n white space.</p><aside>Related</aside></main><!-- open", "x"),
             (5, "u", "<div class='cookie-notice'>We use cookies.</div><article><header><h1>T</h1></header><p>" + "Long text. " * 20000 + "</p></article>"
              "<section id=comments><article class=comment><p>I do not agree with this, says a reader.</p></article></section><form>Mail <input></form>", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in rows_of(main_text.extract_main_text(df))]
    assert (1, "") in got and (2, "") in got and (3, "unclosed bold\n\nnext <x> one.") in got and (3, pages[2][2]) in got
    assert (None, "Head\n\nA text with & white space.") in got
    assert (5, "T\n\n" + ("Long text. " * 20000).strip()) in got
    assert main_text.extract_main_text(df.limit(0)).count() == 0


def test_main_text_after_unclosed_elements():
    """An element that is left out and has no end tag takes its parent's rest with it, not the page's."""
    first, second = "The first paragraph of the text, of a dozen words or so.", "The second paragraph is a little longer than the first one was."
    both = f"{first}\n\n{second}"
    for tag in "button select object canvas video audio math svg noscript template".split():
        for opened in (f"<div><{tag}>no</div>", f"<div><{tag} a='1'>no<b>no</div>", f"<div><{tag}><div>no</div></div>" if tag not in ("svg", "math") else ""):
            assert main_text.main_text(f"<article><p>{first}</p>{opened}<p>{second}</p></article>") == both, opened
            later = f"<article><p>{first}</p>{opened}<p>{second}</p><div><{tag}>no</{tag}></div></article>"
            assert main_text.main_text(later) == both, later
        assert main_text.main_text(f"<article><p>{first}</p><{tag} x='1'/><p>{second}</p></article>") == both, tag
        assert main_text.main_text(f"<article><p>{first} <{tag}>no<p>{second}</article>") == both, tag
        assert main_text.main_text(f"<article><p>The first <{tag}><b>no</b></{tag}>paragraph, whole.</p></article>") == "The first paragraph, whole.", tag
        if tag not in ("svg", "math"):
            assert main_text.main_text(f"<article><p>{first}<{tag}><div>no</div></{tag}></p><p>{second}</p></article>") == both, tag
    for head in ("<head><title>T</title>", "<title>T</title>", "<head><title>T", "<head><meta a=b><noscript><style>p{}</style></noscript>",
                 "<html><head><noscript><link a=b>", "<head><script>'<p>'</script></head>", "<head><title>T</title><body>"):
        assert main_text.main_text(f"{head}<article><p>{first}</p><p>{second}</p></article>") == both, head
    assert main_text.main_text(f"<head><title>T</title>{first}<p>{second}</p>") == both
    assert main_text.main_text(f"<article><p>{first}</p><svg><foreignObject><div>no</div></foreignObject></svg><p>{second}</p></article>") == both
    assert main_text.main_text(f"<article><p>{first}</p><script>if (a) <p>no</p>") == first


def test_marks_that_only_mention_boilerplate():
    paragraphs = "<p>The first paragraph of the text, of a dozen words or so.</p><p>The second paragraph is a little longer than the first one was.</p>"
    whole = "The first paragraph of the text, of a dozen words or so.\n\nThe second paragraph is a little longer than the first one was."
    for opened in ("div class='content no-sidebar'", "div id='article-with-comments'", "article class='post comments-open'", "article title='The hidden valley'",
                   "div class=hasSidebar", "div class='content-sidebar-wrap'", "div data-note='display: none'", "main id=main class='has-nav post search'",
                   "section aria-label='hidden = yes'", "div data-role=navigation", "div class='without_ads'", "div aria-hidden='false'"):
        assert main_text.main_text(f"<{opened}>{paragraphs}</{opened.split()[0]}>") == whole, opened
    for opened in ("div class=sidebar", "div id='page-footer'", "div class='ad-container'", "div class='comments-area no-avatars'", "div role=navigation", "div hidden",
                   "section class='post-comments'", "div style='color:red; display : none'", "div aria-hidden=true", "div class='widget widget_text'", "div hidden=''",
                   "div class=cookieNotice", "div class='comment-body'"):
        assert main_text.main_text(f"<{opened}>{paragraphs}</{opened.split()[0]}>") == "", opened


def test_minimum_cut_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        costs = rng.normal(0, 2, n).tolist()
        ties = [(int(a), int(b), float(rng.random() * 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def weight(side):
            return (sum(abs(c) for c, s in zip(costs, side) if (c > 0) != s) + sum(w for a, b, w in ties if side[a] != side[b]))

        best = min(weight([bool(k >> i & 1) for i in range(n)]) for k in range(2 ** n))
        assert weight(main_text.minimum_cut(costs, ties)) == pytest.approx(best)


def test_exact_dedup(awkward, empty, source):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for r in source:
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    for got in (rows_of(exact_dedup.exact_dedup(*exact_dedup.split_by_hash(awkward))), rows_of(exact_dedup.exact_dedup(empty, awkward)),
                rows_of(exact_dedup.exact_dedup(awkward, empty))):
        assert ids_of(got) == ids_of(source)
        want = Counter((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
                       for t, ids in groups.items() for i in ids)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert exact_dedup.exact_dedup(empty, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50000])
def test_filters_accept_their_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, 100000, dtype=np.uint64)
    made = exact_dedup.build_filter(keys)
    assert exact_dedup.passes(keys, *made).all() and exact_dedup.passes(others, *made).mean() < 1e-3
    assert n < 1000 or len(made[-1]) < 1.5 * n + 4000


def test_near_dedup(awkward, empty, source):
    got = rows_of(near_dedup.near_duplicates(awkward, size=4))
    assert ids_of(got) == ids_of(source)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {by_id[i]["component_id"] for i in (7, 8)} == {7} and by_id[4]["n_shingles"] == 0 and by_id[4]["component_id"] == 4
    assert by_id[16]["n_shingles"] == by_id[17]["n_shingles"] == 1 and by_id[16]["kept"] and by_id[17]["kept"]
    # the null id counts as the smallest and holds the same text as 1, 2, 10 and 11
    assert {by_id[i]["component_id"] for i in (1, 2, 3, 10, 11)} == {None} and by_id[15]["n_shingles"] == 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_large_near_groups_are_found_whole(spark, monkeypatch):
    """A chain in which only neighbours are similar, and a group larger than a block."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 20)
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[2 * i:2 * i + 60])) for i in range(100)]
    star = [(1000 + i, " ".join([f"s{j}" if j != i else "odd" for j in range(150)])) for i in range(100)]
    got = rows_of(near_dedup.near_duplicates(spark.createDataFrame(chain + star, "doc_id long, text string"), size=4))
    assert Counter(r["component_id"] for r in got) == {0: 100, 1000: 100}


def test_language(awkward, empty, source):
    got = rows_of(language_id.identify(awkward, hash_mod("doc_id", 3) == 1))
    assert ids_of(got) == ids_of(source)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (4, 5, 6, 12)) and by_id[14]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(empty, hash_mod("doc_id", 3) == 1).count() == 0
    assert {r["lang_pred"] for r in rows_of(language_id.identify(awkward.withColumn("lang", awkward["lang"].substr(9, 9)).replace("", None, ["lang"]),
                                                                 hash_mod("doc_id", 3) == 1))} == {"und"}


def test_mixing(awkward, empty, source):
    got = rows_of(mixing.take_plan(awkward))
    assert ids_of(got) == ids_of(source)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    size = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * size) < 5
    again = rows_of(mixing.take_plan(awkward.repartition(7)))
    assert Counter(map(repr, again)) == Counter(map(repr, got))
    assert mixing.take_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    words = sum(len((r["text"] or "").split()) for r in rows_of(mixing.mix(awkward)))
    assert words == sum(r["taken"] for r in got)


def test_stages(spark, awkward, empty):
    for first in (awkward, empty):
        docs = pipeline.stage(first, "test")
        for name, step in pipeline.STAGES:
            out = pipeline.stage(step(spark, docs, ""), "test")
            if name != "packing":
                assert out.columns == first.columns
            if name == "exact dedup":
                seen = Counter((r["doc_id"], r["text"]) for r in rows_of(out))
                assert not seen or (set(seen.values()) == {1} and (1, awkward.where("doc_id = 1").first()["text"]) in seen)
            docs = out
        assert (docs.count() > 0) == (first is awkward)


PROSE = ("<p>The river rises in the hills and runs north for many miles, past old mills and farms.</p>"
         "<p>In spring it floods the meadows, and boats are moored higher up.</p>")
RIVER = ["The river rises in the hills and runs north for many miles, past old mills and farms.", "In spring it floods the meadows, and boats are moored higher up."]


@pytest.mark.parametrize("body, before, after", [
    (f'<article class="login"><h1>How to log in</h1>{PROSE}</article>', ["How to log in"], []),
    (f'<div class="article-alert">{PROSE}</div>', [], []),
    (f'<div id="post-search">{PROSE}</div>', [], []),
    (f"<article>{PROSE}<ul>" + "".join(f'<li><a href="/{i}">Reference number {i}, a title of a work</a></li>' for i in range(10)) + "</ul></article>",
     [], [f"Reference number {i}, a title of a work" for i in range(10)]),
    ('<main><p><a href="/x">The river rises in the hills and runs north for many miles, past old mills and farms.</a></p>'
     '<p><a href="/y">In spring it floods the meadows, and boats are moored higher up.</a></p></main>', [], []),
    (f"<div class=page><h1>Cookies</h1><p>Cookies are small files.</p>{PROSE}</div>", ["Cookies", "Cookies are small files."], [])])
def test_marks_and_links_do_not_empty_an_article(body, before, after):
    page = f'<html><body><nav><a href="/">Home</a> <a href="/a">About</a></nav>{body}<footer>© 2020 All rights reserved</footer></body></html>'
    assert main_text.main_text(page).split("\n\n") == before + RIVER + after


def test_boilerplate_of_the_same_words_goes():
    for body in (f'<div class="post-comments">{PROSE}</div>', '<div class="cookie-banner"><p>We use cookies to improve things.</p></div>',
                 '<div><p>Subscribe to our <a href="/n">newsletter</a></p></div>'):
        assert main_text.main_text(f"<html><body>{body}</body></html>") == ""


def test_the_cut_is_least_smallest_and_near_linear():
    import itertools
    import random
    import time

    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        costs = [round(rng.uniform(-3, 3), 1) for _ in range(n)]
        ties = [(a, b, round(rng.uniform(0.1, 2), 1)) for a in range(n) for b in range(a + 1, n) if rng.random() < rng.choice([0.2, 0.5])]

        def cost(kept):
            return sum(abs(c) for c, k in zip(costs, kept) if (c > 0) != bool(k) and c) + sum(w for a, b, w in ties if kept[a] != kept[b])

        every = [(round(cost(k), 6), sum(k)) for k in itertools.product((0, 1), repeat=n)]
        got = main_text.minimum_cut(costs, ties)
        assert (round(cost(got), 6), sum(got)) == min(every) and got == main_text._flow(costs, ties)
    begin = time.time()
    for block in ("<p>w %d</p>", "<li><a href=x>w %d</a></li>", "<div>t %d.<p>a b c.</p></div>"):
        blocks = main_text.blocks_of("".join(block % i for i in range(100_000)))
        main_text.minimum_cut([b.cost for b in blocks], main_text._ties(blocks))
    assert time.time() - begin < 60


def test_a_kept_snapshot_serves_several_batches(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 7)  # several shards, and several tasks for one shard of a large batch
    say = lambda ids, n: spark.createDataFrame([(i, f"text  {i % n}") for i in ids], "doc_id long, text string")
    path = str(tmp_path / "snapshot")
    exact_dedup.build_snapshot(say(range(40), 20), path)
    for batch, n in ((range(100, 150), 50), (range(1000, 1200), 90), (range(5), 20)):
        got = {r["doc_id"]: r for r in rows_of(exact_dedup.dedup_batch(path, say(batch, n)))}
        assert sorted(got) == list(batch)
        for i in batch:
            same = [j for j in range(40) if j % 20 == i % n] + [j for j in batch if j % n == i % n]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))
            assert got[i]["text_sha256"] == hashlib.sha256(f"text {i % n}".encode()).hexdigest()
    exact_dedup.build_snapshot(say([], 1), str(tmp_path / "none"))
    assert exact_dedup.dedup_batch(str(tmp_path / "none"), say([3, 4], 1)).agg(F.max("group_size")).first()[0] == 2


def test_language_stage_drops_what_scores_below_all_known_rows_and_fills_gaps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    gaps = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang")
    junk = spark.createDataFrame([(10_000, "\u6f22\u5b57\u4eee\u540d\u4ea4", None), (10_001, "0x7f 0x3a 9b 4c 7d " * 8, None), (10_002, "12 34", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in rows_of(pipeline.identify_language(spark, gaps.unionByName(junk), ""))}
    truth = {r["doc_id"]: r["lang"] for r in rows_of(docs)}
    assert set(truth) <= set(got) and 10_002 not in got  # clean documents stay
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.99
    told = language_id.identify(gaps.unionByName(junk), hash_mod("doc_id", 3) == 1).where("doc_id < 10000 AND held_out")
    least = told.join(gaps, "doc_id").where("lang = lang_pred").agg({"score": "min"}).first()[0]
    strict = language_id.of_known_language(gaps.unionByName(junk), hash_mod("doc_id", 3) == 1, share=1.05)
    scores = {r["doc_id"]: r["score"] for r in rows_of(language_id.identify(gaps.unionByName(junk), hash_mod("doc_id", 3) == 1))}
    assert {r["doc_id"] for r in rows_of(strict)} == {i for i, s in scores.items() if s >= 1.05 * least and i != 10_002}


def test_very_long_texts(spark):
    """One text of 300,000 words beside a copy with one word changed and a short one."""
    words = [f"w{i * 7919 % 100_003}" for i in range(300_000)]
    edited = words[:150_000] + ["changed"] + words[150_001:]
    df = spark.createDataFrame([(1, " ".join(words), "en"), (2, " ".join(edited), "en"), (3, "short text", "en"), (4, " ".join(words), "en")], "doc_id long, text string, lang string")
    near = {r["doc_id"]: r for r in rows_of(near_dedup.near_duplicates(df))}
    assert [near[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 1] and near[1]["n_shingles"] > 100_000
    exact = {r["doc_id"]: r["keep_id"] for r in rows_of(exact_dedup.exact_dedup(df.where("doc_id <= 2"), df.where("doc_id > 2")))}
    assert exact == {1: 1, 2: 2, 3: 3, 4: 1}
    marks = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprint_documents(df))}
    assert marks[1]["fingerprint"] == marks[4]["fingerprint"] != marks[2]["fingerprint"] and marks[2]["near_next"] > 0.99
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["score"] for r in rows_of(quality.score_quality(df, labels, hash_mod("doc_id", 5) == 9))}
    assert scored[1] == scored[4] and 0 <= scored[3] <= 1
    pieces = [p for p in rows_of(packing.pack(df, tokenizer_path())) if p["doc_id"] == 1]
    assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"] > 300_000
    spans = {r["doc_id"]: r["spans"] for r in rows_of(secret_scan.find_secrets(df.selectExpr("doc_id", "concat(text, ' token=abcdefgh') AS text")))}
    assert spans[1] == f"assign:{len(' '.join(words)) + 1}:{len(' '.join(words)) + 15}"
