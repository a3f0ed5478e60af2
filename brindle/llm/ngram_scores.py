"""Log-probabilities of texts under a weighted backoff automaton learned from the corpus.

States are the contexts of up to two words that the training texts hold, arcs are n-grams with their
smoothed probability, and a failure arc leads from a context to the one without its first word. The
smoothing is a Dirichlet prior (MacKay and Peto 1995): with p(w) the unigram estimate,
p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), so the failure arc of h weighs m / (c(h) + m) and every
state's probabilities sum to one. The mass m = a c(h)^b grows with the context as the number of its
different continuations does (Heaps' law), so no such number has to be gathered. Counts are exact
over all training texts; nothing is pruned.

No model is held whole anywhere. Texts are cut into blocks of about two million words. A block sends the
distinct n-grams it holds, with its own training counts, to buckets by their hash; a bucket adds them
up and answers each block with a bit per n-gram, and a total where it differs from the block's own count.
Blocks and buckets both grow with the corpus, so where a block would send each bucket few n-grams, the root of the blocks
are merged on the way: a block sends to groups of buckets, a chunk of blocks adds up what it has for a group and asks the
buckets as one, and hands the answers back. Rows then grow with the corpus to the power of 1.5, and stay long.
A block thus has
the part of the automaton that its texts can reach, as arrays of states, arcs and failure links, and walks it from
left to right: the state, the longest known context, is carried from word to word, and a state without an arc for the next word adds its
failure weight and falls back. All texts of a block take a step together; a long one is walked in stretches of STRETCH
words, each from the state of the two words before it.

Defined results: a null text is empty and has the end as its only token; repeated rows are scored and
counted each; a null id keeps its row; empty input gives no rows; other columns are not read. Words
are compared by 63 bits of a hash; longer n-grams by at least 48 bits and by 20 more than it takes to number
the corpus' words, so one in a million is mistaken for another at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.tables import stage, stage_bucketed, workers_import
from brindle.llm.words import buffer, chained, words

BLOCK_TOKENS = 2_000_000
BUCKET_KEYS = 3_000_000
LEAST_KEYS = 100  # n-grams of a row on average, below which the exchange takes two hops
ORDER = 3
STRETCH = 512
_U = np.uint64
_END = _U(0x5EED0FDECAFBAD11)
_BLOCK = "block long, ids array<long>, held array<boolean>, train_tokens long, n long, sizes binary, vocab binary, ranks binary, tokens binary"


# --- packing of sorted keys and counts ----------------------------------------------------------

def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, without the high planes that are all zero."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=_U(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


# --- one block ----------------------------------------------------------------------------------

def _row(block: int, ids: list, held: list, hashes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    vocab, tokens, often = np.unique(hashes, return_inverse=True, return_counts=True)
    # frequent words get small numbers, which pack into fewer bytes
    rank = np.empty(len(vocab), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(vocab))
    trained = ~np.array([bool(h) for h in held], bool)
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())),
        "train_tokens": pa.array([int((sizes[trained] + 1).sum())], pa.int64()), "n": pa.array([int(len(tokens) + len(sizes))], pa.int64()),
        "sizes": pa.array([_pack(sizes)], pa.binary()), "vocab": pa.array([_pack_keys(vocab)], pa.binary()),
        "ranks": pa.array([_pack(rank)], pa.binary()), "tokens": pa.array([_pack(rank[tokens])], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks of word numbers; a block's name is unique among the tasks that commit."""
    block = TaskContext.get().partitionId() << 32
    ids, held, hashes, sizes, held_tokens = [], [], [], [], 0
    for batch in batches:
        h, _, first = words(*buffer(batch.column(2)))
        keys, flags, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        tokens = first + np.arange(len(first))  # words and ends
        while at < len(keys):
            upto = int(np.searchsorted(tokens, tokens[at] + BLOCK_TOKENS - held_tokens, side="left"))
            upto = min(max(upto, at + 1), len(keys))
            ids += keys[at:upto]
            held += flags[at:upto]
            hashes.append(h[first[at]:first[upto]])
            sizes.append(np.diff(first[at:upto + 1]))
            held_tokens += int(tokens[upto] - tokens[at])
            at = upto
            if held_tokens >= BLOCK_TOKENS:
                yield _row(block, ids, held, np.concatenate(hashes), np.concatenate(sizes))
                block, ids, held, hashes, sizes, held_tokens = block + 1, [], [], [], [], 0
    if ids:
        yield _row(block, ids, held, np.concatenate(hashes), np.concatenate(sizes))


class _Block:
    """The n-grams of one block, by order: the distinct keys, their training counts, and, to walk it, which ends at each token."""

    def __init__(self, row: dict, bits: int, walked: bool = False):
        self.row, sizes = row, _unpack(row["sizes"]).astype(np.int64)
        word = np.zeros(len(_unpack(row["ranks"])), np.uint64)
        word[_unpack(row["ranks"]).astype(np.int64)] = _unpack_keys(row["vocab"])
        h = np.insert(word[_unpack(row["tokens"]).astype(np.int64)], np.cumsum(sizes), _END)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.sizes = sizes + 1
        self.place = (np.arange(len(h)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        trained = ~np.array([bool(x) for x in row["held"]], bool)
        flag = np.repeat(trained, self.sizes)
        # order n: one key for each token that ends an n-gram inside its text
        self.distinct, self.counts, self.ends, self.somewhere = [], [], [], []
        for n in range(ORDER):
            at = np.flatnonzero(self.place >= n)
            key = chained(h, n + 1)[at - n] >> _U(64 - key_width(n, bits))
            if walked:
                order = np.argsort(key).astype(np.int32)
                sorted_keys = key[order]
                own = flag[at[order]]
            else:
                every = np.sort(key << _U(1) | flag[at])
                sorted_keys, own = every >> _U(1), (every & _U(1)).astype(bool)
                del every
            del key
            fresh = np.ones(len(at), bool)
            fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
            edge = np.flatnonzero(fresh)
            self.distinct.append(sorted_keys[edge])
            del sorted_keys
            self.counts.append(np.add.reduceat(own, edge, dtype=np.uint32) if len(edge) else edge.astype(np.uint32))
            if walked:
                ends = np.full(len(h), -1, np.int32)
                ends[at[order]] = np.cumsum(fresh, dtype=np.int32) - 1
                self.ends.append(ends)
                self.somewhere.append(at[order[edge]].astype(np.int32))


def key_width(n: int, bits: int) -> int:
    """Bits of a key: words have all but the one that marks training tokens."""
    return 63 if n == 0 else bits


def bucket_of(distinct: np.ndarray, n: int, buckets: int, bits: int) -> np.ndarray:
    """The range of the sorted keys, of 2^buckets, that each key lies in."""
    return (distinct >> _U(key_width(n, bits) - buckets)).astype(np.int64)


def _send(buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch.slice(i, 1).to_pylist()[0], bits)
                for n in range(ORDER):
                    full, begin = np.unique(bucket_of(b.distinct[n], n, buckets, bits), return_index=True)
                    parts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(b.distinct[n])]))
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(full, pa.int64()), "block": pa.array([b.row["block"]] * len(full), pa.int64()),
                        "n": pa.array([n] * len(full), pa.int32()),
                        "keys": pa.array([_pack_keys(b.distinct[n][x:y]) for x, y in parts], pa.binary()),
                        "counts": pa.array([_pack(b.counts[n][x:y]) for x, y in parts], pa.binary())})
    return run


def _total(group: pa.Table) -> pa.Table:
    """Totals of one bucket: to each block those that differ from its own, to block -1 the words seen."""
    seen, blocks, orders, out_bits, out_totals = 0, [], [], [], []
    rows = group.select(["n", "block", "keys", "counts"]).to_pylist()
    for n in range(ORDER):
        some = [r for r in rows if r["n"] == n]
        if not some:
            continue
        keys, counts = [_unpack_keys(r["keys"]) for r in some], [_unpack(r["counts"]) for r in some]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts).astype(np.float64), minlength=len(every)).astype(np.uint64)
        seen += int((totals > 0).sum()) if n == 0 else 0
        begin = 0
        for r, k, c in zip(some, keys, counts):
            t = totals[place[begin:begin + len(k)]]
            begin += len(k)
            more = t > c
            if more.any():
                blocks.append(r["block"])
                orders.append(n)
                out_bits.append(np.packbits(more).tobytes())
                out_totals.append(_pack(t[more]))
    return pa.table({"block": pa.array([-1, *blocks], pa.int64()), "seen": pa.array([seen, *[0] * len(blocks)], pa.int64()),
                     "bucket": pa.array(group["bucket"].to_pylist()[:1] * (1 + len(blocks)), pa.int64()),
                     "n": pa.array([0, *orders], pa.int32()), "bits": pa.array([b"", *out_bits], pa.binary()),
                     "totals": pa.array([b"", *out_totals], pa.binary())})


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of rows of one order, their summed counts, and the place of each row's keys among them."""
    keys = [_unpack_keys(r["keys"]) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([_unpack(r["counts"]) for r in rows]).astype(np.float64), minlength=len(every)).astype(np.uint64)
    return every, counts, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _ask(buckets: int, bits: int):
    """What a chunk of blocks has for a group of buckets, as from one block."""
    def run(rows: pa.Table) -> pa.Table:
        out, chunk = [], rows["chunk"][0].as_py()
        for n in range(ORDER):
            if some := [r for r in rows.to_pylist() if r["n"] == n]:
                every, counts, _ = _added(some)
                full, begin = np.unique(bucket_of(every, n, buckets, bits), return_index=True)
                out += [(int(k), chunk, n, _pack_keys(every[x:y]), _pack(counts[x:y])) for k, x, y in zip(full, begin, [*begin[1:], len(every)])]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(_SENT, zip(*out))})
    return run


def _hand_back(buckets: int, bits: int):
    """The totals of a group of buckets, for each block of a chunk on its own keys."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out, given = [], answers.to_pylist()
        for n in range(ORDER):
            if some := [r for r in rows.to_pylist() if r["n"] == n]:
                every, totals, places = _added(some)
                bucket = bucket_of(every, n, buckets, bits)
                for a in given:
                    if a["n"] == n:
                        begin, end = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
                        totals[begin:end][np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=end - begin).astype(bool)] = _unpack(a["totals"])
                for r, place in zip(some, places):
                    t = totals[place]
                    more = t > _unpack(r["counts"])
                    if more.any():
                        out.append((r["block"], 0, r["bucket"], n, np.packbits(more).tobytes(), _pack(t[more])))
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(_ANSWER, zip(*out) if out else [[]] * len(_ANSWER))})
    return run


_SENT = [("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
_ANSWER = [("block", pa.int64()), ("seen", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("totals", pa.binary())]
_SENT_SQL, _ANSWER_SQL = "bucket long, block long, n int, keys binary, counts binary", "block long, seen long, bucket long, n int, bits binary, totals binary"


def _exchange(blocks: DataFrame, buckets: int, bits: int, many: int, tokens: int) -> tuple[DataFrame, DataFrame, int]:
    """(answers to blocks, words seen per bucket, the number of ranges that answers refer to)."""
    if 2 * tokens >= LEAST_KEYS * ORDER * many * 2 ** buckets:
        sent = blocks.mapInArrow(_send(buckets, bits), _SENT_SQL)
        answers = stage(sent.groupBy("bucket").applyInArrow(_total, _ANSWER_SQL), "scores-totals")
        return answers.where("block >= 0"), answers.where("block = -1"), buckets
    groups, chunks = (buckets + 1) // 2, math.ceil(math.sqrt(many))
    sent = stage(blocks.mapInArrow(_send(groups, bits), _SENT_SQL).withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks))), "scores-sent")
    asked = sent.groupBy("bucket", "chunk").applyInArrow(_ask(buckets, bits), _SENT_SQL)
    totals = stage(asked.groupBy("bucket").applyInArrow(_total, _ANSWER_SQL), "scores-totals")
    back = totals.where("block >= 0").withColumn("group", F.shiftright("bucket", buckets - groups)).withColumnRenamed("block", "chunk")
    answers = (sent.groupBy("bucket", "chunk").cogroup(back.groupBy("group", "chunk")).applyInArrow(_hand_back(buckets, bits), _ANSWER_SQL))
    return answers, totals.where("block = -1"), groups


class Automaton:
    """States, arcs and failure links that the texts of one block can reach.

    State 0 is the empty context, 1 + i that of word i, 1 + words + j that of bigram j. ``totals`` are the corpus' counts of the
    block's distinct n-grams; an n-gram that was never learned from has no state and no arc.
    """

    def __init__(self, b: _Block, totals: list[np.ndarray], n_train: int, n_words: int, prior: tuple[float, float]):
        self.words = len(totals[0])
        # which word, bigram and trigram ends at each token, and one place of each
        ends, (_, two, three) = b.ends, b.somewhere
        self.word = ends[0]
        last, second = self.word[two], ends[1][three]  # of each bigram its last word; of each trigram its last two words
        # the state that a word or bigram leads to is its longest suffix that is known
        self.of_word = np.where(totals[0] > 0, 1 + np.arange(self.words, dtype=np.int32), 0).astype(np.int32)
        self.of_bigram = np.where(totals[1] > 0, 1 + self.words + np.arange(len(last), dtype=np.int32), self.of_word[last]).astype(np.int32)
        seen = np.concatenate([[0.0], totals[0], totals[1]])
        mass = prior[0] * seen ** prior[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fall = np.log10(mass / (seen + mass))  # never read for the empty context or an unknown one
        self.link = np.concatenate([np.zeros(1 + self.words, np.int32), self.of_word[last]])
        self.root = np.log10((totals[0] + 0.5) / (n_train + 0.5 * (n_words + 1)))
        # arcs of words, then of bigrams: p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m)
        known, deep = np.flatnonzero(totals[1] > 0).astype(np.int32), np.flatnonzero(totals[2] > 0).astype(np.int32)
        own, above = 1 + self.word[two[known] - 1], 1 + self.words + ends[1][three[deep] - 1]
        lower = np.zeros(len(last))
        lower[known] = (totals[1][known] + mass[own] * 10.0 ** self.root[last[known]]) / (seen[own] + mass[own])
        weight = np.concatenate([lower[known], (totals[2][deep] + mass[above] * lower[second[deep]]) / (seen[above] + mass[above])])
        del lower, mass, seen
        arcs = np.concatenate([own.astype(np.int64) * self.words + last[known], above.astype(np.int64) * self.words + self.word[three[deep]]])
        del own, above
        order = np.argsort(arcs).astype(np.int32)
        self.arc = arcs[order]
        del arcs
        self.weight = np.log10(weight[order])
        del weight
        self.target = np.concatenate([self.of_bigram[known], self.of_bigram[second[deep]]])[order]
        self.before = np.zeros(len(b.place), np.int32)  # of the two words before a token, for a walk that begins there
        inner = np.flatnonzero(b.place >= 2)
        self.before[inner] = self.of_bigram[ends[1][inner - 1]]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) of reading ``word`` in ``state``."""
        score, after, on = np.zeros(len(state)), self.of_word[word], np.arange(len(state))
        state = state.copy()
        while len(on := on[state[on] > 0]):
            wanted = state[on].astype(np.int64) * self.words + word[on]
            place = np.minimum(np.searchsorted(self.arc, wanted), max(len(self.arc) - 1, 0))
            found = self.arc[place] == wanted if len(self.arc) else np.zeros(len(on), bool)
            hit, miss = on[found], on[~found]
            score[hit] += self.weight[place[found]]
            after[hit] = self.target[place[found]]
            score[miss] += self.fall[state[miss]]
            state[miss] = self.link[state[miss]]
            state[hit] = -1  # arrived
            on = miss
        at_root = state == 0
        score[at_root] += self.root[word[at_root]]
        return after, score

    def walk(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The score of every token of the texts, read from left to right."""
        out = np.zeros(len(self.word))
        parts = -(-sizes // STRETCH)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(starts, parts) + nth * STRETCH
        length = np.minimum(np.repeat(sizes, parts) - nth * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state = np.where(nth[order] > 0, self.before[begin], 0) if len(begin) else begin
        for t in range(int(length.max(initial=0))):
            reading = int(np.searchsorted(-length, -t))  # those longer than t
            at = begin[:reading] + t
            state, out[at] = self.step(state[:reading], self.word[at])
        return out


def _traverse(n_train: int, n_words: int, prior: tuple[float, float], buckets: int, bits: int):
    """Scores of the texts of one block, from its own counts and the totals that were sent back."""

    def sums(b: _Block, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.longdouble), b.starts).astype(np.float64)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            b = _Block(row, bits, walked=True)
            totals = [c.astype(np.int64) for c in b.counts]
            b.counts = []
            for order, bucket, more, t in zip(*(answers[c].to_pylist() for c in ("n", "bucket", "bits", "totals"))):
                edge = np.array([bucket, bucket + 1], np.uint64) << _U(key_width(order, bits) - buckets)
                begin = int(np.searchsorted(b.distinct[order], edge[0]))
                end = int(np.searchsorted(b.distinct[order], edge[1])) if bucket + 1 < 1 << buckets else len(b.distinct[order])
                totals[order][begin:end][np.unpackbits(np.frombuffer(more, np.uint8), count=end - begin).astype(bool)] = _unpack(t)
            b.distinct = []
            machine = Automaton(b, totals, n_train, n_words, prior)
            b.ends, b.somewhere = [], []
            score = machine.walk(b.starts, b.sizes)
            out.append(pa.table({
                "id": pa.array(row["ids"], pa.int64()), "held_out": pa.array([bool(x) for x in row["held"]], pa.bool_()),
                "n_tokens": pa.array(b.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((totals[0][machine.word] > 0).astype(np.int64), b.starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(b.sizes), n_train), pa.int64()),
                "base_score": pa.array(sums(b, machine.root[machine.word])), "score": pa.array(sums(b, score))}))
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in _RESULT})
    return run


_RESULT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text",
                prior: tuple[float, float] = (4.0, 0.9)) -> DataFrame:
    """Score every text; those where ``held_out`` is not true are also learned from. ``prior`` holds a and b."""
    workers_import(docs.sparkSession)
    blocks = stage_bucketed(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("body"))
                            .mapInArrow(_blocks, _BLOCK), "scores-blocks", "block")
    n_train, tokens, many = blocks.agg(F.sum("train_tokens"), F.sum("n"), F.count("*")).first()
    tokens = max(tokens or 0, 1)
    bits = min(63, max(48, math.ceil(math.log2(tokens)) + 20))
    # nearly two distinct n-grams per token and block, so that buckets hold about BUCKET_KEYS each
    buckets = max(4, math.ceil(math.log2(2 * tokens / BUCKET_KEYS)))
    answers, words_seen, ranges = _exchange(blocks, buckets, bits, many or 0, tokens)
    n_words = words_seen.agg(F.sum("seen")).first()[0] or 0
    scored = (blocks.groupBy("block").cogroup(answers.groupBy("block"))
              .applyInArrow(_traverse(n_train or 0, n_words, prior, ranges, bits),
                            "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return scored.withColumnRenamed("id", key)
