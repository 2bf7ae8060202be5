"""Token counts under a unigram segmentation, by dynamic programming over a shared trie.

A text's pre-tokens are its marked words.  Each task inserts the distinct new ones
of a group of texts in a trie, kept as sorted strings: their order is the trie's
depth-first order, and a stack holds the current branch.  A trie node has the best
score of any segmentation of its prefix into pieces and that segmentation's length,
computed once from the nodes above it, so words that share a prefix share its work.
The count at a word's last node is stored for the word, and a document's count is
the sum over its pre-tokens.  Nothing is shuffled; the store is emptied at a bound,
which changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import MARK, marked_chunks
from .common import sliced

#: Words whose counts a task keeps before it starts anew.
MAX_WORDS = 400_000
#: Texts whose new words are inserted together.
GROUP = 1_000
#: Words longer than this are counted each time instead of being kept.
LONGEST_KEPT = 256


def piece_scores(model_path: str) -> tuple[dict[str, float], float]:
    """Log score of every ordinary piece, and of one fallback byte.

    Files of the merge kind store ranks, not probabilities, so the piece at place
    r among the ordinary pieces gets the Zipf estimate -ln(r + 2); a byte of a
    character without a piece costs as much as the last piece.
    """
    import sentencepiece
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ordinary = [processor.id_to_piece(i) for i in range(processor.get_piece_size())
                if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)
                        or processor.is_unused(i))]
    scores = {piece: -math.log(rank + 2) for rank, piece in enumerate(ordinary)}
    return scores, -math.log(len(ordinary) + 2)


class ScoreTrie:
    """Token counts of words, from best scores shared by their prefixes."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.byte_score = byte_score
        self.longest = max(map(len, scores), default=1)
        # every ending of a piece, so that a look back stops where no piece can begin
        self.endings = {piece[at:]: -math.inf for piece in scores for at in range(len(piece))} | scores
        self.terminal: dict[str, int] = {}

    def _extend(self, word: str, end: int, best: list[float], tokens: list[int]) -> None:
        """Push the node of ``word[:end]``; the lists end with the nodes above it."""
        get, back, top, fewest = self.endings.get, 1, -math.inf, 0
        while back <= len(best):
            score = get(word[end - back:end])
            if score is None:
                break
            total = best[-back] + score
            if total > top:
                top, fewest = total, tokens[-back] + 1
            elif total == top and tokens[-back] + 1 < fewest:
                fewest = tokens[-back] + 1
            back += 1
        if get(word[end - 1], -math.inf) == -math.inf:
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            total = best[-1] + size * self.byte_score
            if total > top:
                top, fewest = total, tokens[-1] + size
        best.append(top)
        tokens.append(fewest)

    def insert(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """Each word and its token count, in the trie's depth-first order."""
        best, tokens, last = [0.0], [0], ""
        for word in sorted(words):
            if len(word) > LONGEST_KEPT:
                yield word, self.slide(word)
                continue
            shared, upto = 0, min(len(word), len(last))
            while shared < upto and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                self._extend(word, end, best, tokens)
            last = word
            yield word, tokens[-1]

    def slide(self, word: str) -> int:
        """Token count of a very long word, remembering only the last prefixes."""
        best, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            self._extend(word, end, best, tokens)
            del best[:-self.longest], tokens[:-self.longest]
        return tokens[-1]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        cut = [marked_chunks(text) for text in texts]
        if len(self.terminal) > MAX_WORDS:
            self.terminal.clear()
        terminal = self.terminal
        new = {MARK + chunk.replace(" ", MARK): chunk for chunk in set().union(*cut) if chunk not in terminal}
        terminal.update((new[word], n) for word, n in self.insert(list(new)))
        counted = [(len(chunks), sum(map(terminal.__getitem__, chunks))) for chunks in cut]
        for chunk in new.values():
            if len(chunk) >= LONGEST_KEPT:
                del terminal[chunk]
        return counted


def counts_column(model_path: str, text: Column) -> Column:
    """Struct ``n_pretokens, n_tokens`` of each text."""
    scores, byte_score = piece_scores(model_path)

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = ScoreTrie(scores, byte_score)
        for batch in batches:
            for texts in sliced(batch, GROUP):
                yield pd.DataFrame(trie.count([t or "" for t in texts]), columns=["n_pretokens", "n_tokens"])

    return counts(text)


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col, n_pretokens, n_tokens`` for every row.

    A null or empty text has no tokens; repeated rows and null ids come out row by
    row; equal scores take the shorter segmentation; an empty table gives an empty
    result; other columns are ignored.
    """
    counted = docs.select(F.col(id_col).alias(id_col), counts_column(model_path, F.col(text_col)).alias("c"))
    return counted.select(id_col, F.col("c.n_pretokens").alias("n_pretokens"), F.col("c.n_tokens").alias("n_tokens"))
