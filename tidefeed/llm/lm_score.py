"""Language-model scoring with a weighted backoff automaton.

Bigrams smoothed with a Dirichlet prior over the smoothed unigram,

    P(w | h) = (c(h, w) + M * P(w)) / (c(h) + M),    P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

sum to one for every history.  As an automaton: one state per history word, an arc
for each bigram seen in training with the weight above, and a failure arc to the
root with weight M / (c(h) + M); the root has an arc for every word.  A text is read
once from left to right, carrying the state and adding log weights.

Counts cover all training documents and grow with them, so no task holds them
all.  Documents are dealt into blocks of bounded size.  A block sends the keys and
own counts of its distinct words and bigrams, split by hash into parts; a part adds
up the counts of its keys and answers each block with the totals that differ from
the block's own counts; the block then has the part of the automaton its documents
can visit.  Keys are 64-bit hashes: among n distinct ones about n^2 / 2^65 pairs collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc
from .shingles import WordHashes, mixed

#: Documents with this crc32 remainder are never learnt from.
FOLDS, HELD_OUT = 10, 0
#: Strength of the prior, in occurrences of a history.
PRIOR = 200.0
#: Characters of text per block.
BLOCK_CHARS = 6_000_000
_START, _END = b"\x00 start", b"\x00 end"  # a white space keeps them apart from words
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers of words in the order they are first seen."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Block:
    """Words, bigrams and own training counts of one block of documents, in the order of their keys.

    The order depends on the set of documents only, so it is the same each time the
    block is read.
    """

    def __init__(self, texts: list[str | None], train: np.ndarray):
        hashes = WordHashes()
        local = _Numbers({_START: 0, _END: 1})
        ids: list[int] = []
        sizes = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            ids.append(0)
            ids.extend(map(local.__getitem__, words))
            ids.append(1)
            sizes.append(len(words) + 2)
        seen = np.array(ids, np.int64)
        keys = np.fromiter((hashes[word] for word in local), np.uint64, len(local))
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.bounds = place[seen], np.cumsum([0] + sizes)
        self.word_keys, self.start = keys[order], int(place[0])
        learnt = np.repeat(train.astype(bool), sizes)
        self.word_counts = np.bincount(self.ids[learnt], minlength=len(order))
        follows = np.ones(len(seen), bool)
        follows[self.bounds[:-1]] = False
        at = np.flatnonzero(follows)
        # bigrams as pairs of local places, then in the order of their keys
        pairs, pair_of = np.unique(self.ids[at - 1] * len(order) + self.ids[at], return_inverse=True)
        pair_counts = np.bincount(pair_of[learnt[at]], minlength=len(pairs))
        self.history, self.word = pairs // len(order), pairs % len(order)
        pair_keys = mixed(self.word_keys[self.history] * _STEP + self.word_keys[self.word])
        by_key = np.argsort(pair_keys)
        self.history, self.word = self.history[by_key], self.word[by_key]
        self.pair_keys, self.pair_counts = pair_keys[by_key], pair_counts[by_key]
        # every text's tokens without its start: their places, and the pair each one ends
        place_of = np.empty(len(by_key), np.int64)
        place_of[by_key] = np.arange(len(by_key))
        self.tokens, self.pair_at = self.ids[at], place_of[pair_of]
        self.first_token = self.bounds[:-1] - np.arange(len(sizes))


def _part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the key space begins in sorted keys."""
    width = (1 << 64) // parts
    edges = np.array([p * width for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their gaps, in as few bytes each as the widest gap needs."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    narrow = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + narrow.tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    narrow = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(narrow), 8), np.uint8)
    gaps[:, :width] = narrow
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), gaps.view("<u8").ravel()]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest whole type that holds them all."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w - 1))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_SENT = "kind int, part long, block long, keys binary, counts binary"
_ANSWER = "block long, kind int, part long, changed binary, totals binary, types long, tokens long"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _sender(parts: int):
    def send(docs: pa.Table) -> pa.Table:
        """Keys and own counts of a block: one row per kind (0 words, 1 bigrams) and part."""
        block = Block(docs["text"].to_pylist(), docs["train"].to_numpy())
        rows = []
        for kind, keys, counts in ((0, block.word_keys, block.word_counts), (1, block.pair_keys, block.pair_counts)):
            edges = _part_bounds(keys, parts)
            rows += [(kind, p, docs["block"][0].as_py(), pack_keys(keys[a:b]), pack_counts(counts[a:b]))
                     for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return _table(rows, _SENT)
    return send


def add_up(sent: pa.Table) -> pa.Table:
    """Totals of one part, answered to each block where they differ from its own counts; one row of sums."""
    kind, part = sent["kind"][0].as_py(), sent["part"][0].as_py()
    keys = [unpack_keys(k) for k in sent["keys"].to_pylist()]
    counts = [unpack_counts(c) for c in sent["counts"].to_pylist()]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
    rows, at = [], 0
    for block, own in zip(sent["block"].to_pylist(), counts):
        known = totals[which[at:at + len(own)]]
        at += len(own)
        changed = known != own
        if changed.any() or kind == 0:
            rows.append((block, kind, part, np.packbits(changed).tobytes(), pack_counts(known[changed]), 0, 0))
    if kind == 0:
        start = distinct == np.uint64(WordHashes()[_START])
        rows.append((None, 0, part, b"", b"", int((totals[~start] > 0).sum()), int(totals[~start].sum())))
    return _table(rows, _ANSWER)


class Automaton:
    """States and arcs that one block of documents can visit.

    The state after a word is that word's, so the state before each token of a text
    is known from the token before it, and an arc of a state is the pair of the two.
    """

    def __init__(self, block: Block, word_totals: np.ndarray, pair_totals: np.ndarray, tokens: int, types: int):
        weight = (word_totals + 0.1) / (tokens + 0.1 * (types + 1))
        self.root = np.log10(weight)
        self.known = word_totals > 0
        self.has_arc = pair_totals > 0
        self.arc = np.log10((pair_totals + PRIOR * weight[block.word]) / (word_totals[block.history] + PRIOR))
        self.failure = np.log10(PRIOR / (word_totals + PRIOR))

    def read(self, block: Block) -> np.ndarray:
        """Log weights of all tokens, texts read from left to right: the state's arc, or its failure arc and the root's."""
        state, word = block.history[block.pair_at], block.tokens
        return np.where(self.has_arc[block.pair_at], self.arc[block.pair_at], self.failure[state] + self.root[word])


def _scorer(parts: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Score the documents of one block with the totals its parts answered."""
        if not docs.num_rows:
            return _table([], _SCORED)
        block = Block(docs["text"].to_pylist(), docs["train"].to_numpy())
        totals = [block.word_counts.copy(), block.pair_counts.copy()]
        edges = [_part_bounds(block.word_keys, parts), _part_bounds(block.pair_keys, parts)]
        for row in answers.select(["kind", "part", "changed", "totals"]).to_pylist():
            places = np.flatnonzero(np.unpackbits(np.frombuffer(row["changed"], np.uint8)))
            totals[row["kind"]][edges[row["kind"]][row["part"]] + places] = unpack_counts(row["totals"])
        tokens, types = answers["all_tokens"][0].as_py(), answers["all_types"][0].as_py()
        machine = Automaton(block, *totals, tokens, types)
        sizes = np.diff(np.append(block.first_token, len(block.tokens)))

        def per_text(values: np.ndarray) -> list:
            return np.add.reduceat(values, block.first_token).tolist()

        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pc.invert(docs["train"]), "n_tokens": sizes,
            "n_known": per_text(machine.known[block.tokens].astype(np.int64)),
            "train_tokens": np.full(len(sizes), tokens, np.int64), "base_score": per_text(machine.root[block.tokens]),
            "score": per_text(machine.read(block))})
    return score


def score_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Score every whole text: one row per row of ``docs``.

    Tokens are the A-Z lower-cased words and one end; ``base_score`` is the smoothed
    unigram, ``score`` the automaton's log10 probability, from the documents whose
    crc32(doc_id) mod 10 is not 0.

    A null text is an empty one (one token, the end); repeated rows are scored, and
    learnt from, one by one; a null id counts as crc32 of the empty text, which is
    0, so it is held out; without training documents both scores are those of an
    empty model; an empty table gives an empty result; other columns are ignored.
    """
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = (total["n"] + 64 * total["rows"]) // block_chars + 1
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
        (id_crc("doc_id") % F.lit(FOLDS) != F.lit(HELD_OUT)).alias("train"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    sent = dealt.groupBy("block").applyInArrow(_sender(blocks), _SENT)
    answered = sent.groupBy("kind", "part").applyInArrow(add_up, _ANSWER)
    sums = answered.where("block IS NULL").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"))
    answers = answered.where("block IS NOT NULL").select(
        "block", "kind", "part", "changed", "totals",
        sums.select("types").scalar().alias("all_types"), sums.select("tokens").scalar().alias("all_tokens"))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(blocks), _SCORED)
