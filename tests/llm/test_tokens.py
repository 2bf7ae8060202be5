"""SentencePiece codec against the library, token counts against a plain Viterbi search."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import queries, sentencepiece_codec as C, token_counts as T
from tidefeed.llm.chunks import MARK, marked_chunks

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "a ", MARK, f"{MARK}{MARK}x {MARK} y", "a  b   c ", "\n", "é" * 300, "x" * 700 + " y  ",
         "　 \xa0", "<s> </s> <0x0A>", "\0 a\0", "日本 語", "the " * 50]


@pytest.fixture(scope="module")
def library():
    return C._processor(C.read_model(MODEL))


def test_this_model_may_be_cut(library):
    assert C.markers_separate(C.read_model(MODEL))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=f"ab {MARK}\n.é日", max_size=30), max_size=6))
def test_ids_equal_the_library(texts):
    library = C._processor(C.read_model(MODEL))
    table = C.ChunkTable(library, True)
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in table.encode(texts)] == want


@pytest.mark.parametrize("separate", [True, False])
def test_small_tables_change_nothing(library, separate, monkeypatch):
    monkeypatch.setattr(C, "TABLE_BYTES", 10)
    table = C.ChunkTable(library, separate)
    for _ in range(2):
        for text in TEXTS:
            assert np.frombuffer(table.encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_whole_table_equals_the_library(spark, library):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_bos=True, add_eos=True)
        assert rows[doc["doc_id"]][1:] == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_codec_rows(spark, library):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")], "doc_id long, text string, ids string")
    rows = C.encode_decode(spark, docs, MODEL).select("doc_id", C.unpacked(C.F.col("ids")).alias("ids"), "decoded").collect()
    want = library.encode("a b", add_bos=True, add_eos=True)
    assert sorted((str(r[0]), r[1], r[2]) for r in rows) == sorted(
        [("1", [1, 2], ""), ("None", want, "a b"), ("1", want, "a b"), ("1", want, "a b")])
    assert C.encode_decode(spark, docs.limit(0), MODEL).count() == 0


def viterbi(word, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            ways.append((best[end - 1][0] + n * byte_score, -(best[end - 1][1] + n)))
        top = max(w[0] for w in ways)
        best.append((top, -max(w[1] for w in ways if w[0] == top)))
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc é日", max_size=25), min_size=1, max_size=8))
def test_counts_equal_a_plain_search(texts):
    scores = {p: -math.log(n + 2) for n, p in enumerate([MARK, "a", "b", "ab", MARK + "a", "ba", "abc", "cab", MARK + MARK, "é", "bcab"])}
    trie = T.ScoreTrie(scores, -3.0)
    want = [sum(viterbi(MARK + c.replace(" ", MARK), scores, -3.0) for c in marked_chunks(t)) for t in texts]
    assert [n for _, n in trie.count(texts)] == want == [n for _, n in trie.count(texts)]


def test_long_words_slide():
    scores, byte_score = T.piece_scores(MODEL)
    trie = T.ScoreTrie(scores, byte_score)
    word = "thinghé日" * 60
    assert trie.count([word])[0] == (1, viterbi(MARK + word, scores, byte_score))


def test_whole_table_counts(spark):
    scores, byte_score = T.piece_scores(MODEL)
    seen = {}
    rows = queries.QUERIES["op9_token_counts"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for row in rows[::17]:
        words = [MARK + c.replace(" ", MARK) for c in marked_chunks(docs[row["doc_id"]])]
        for w in set(words) - seen.keys():
            seen[w] = viterbi(w, scores, byte_score)
        assert (row["n_pretokens"], row["n_tokens"]) == (len(words), sum(map(seen.get, words)))


def test_count_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (2, "a a", 5), (2, "a a", 5)], "doc_id long, text string, n_tokens int")
    out = T.count_tokens(spark, docs, MODEL)
    assert sorted((str(r[0]), r[1]) for r in out.collect()) == [("1", 0), ("2", 0), ("2", 2), ("2", 2), ("None", 1)]
    assert T.count_tokens(spark, docs.limit(0), MODEL).count() == 0
