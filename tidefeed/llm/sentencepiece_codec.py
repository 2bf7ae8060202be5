"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of the model crosses a white-space marker, merges never cross one
either, so a text may be cut before every run of markers and each chunk encoded
alone.  Each task keeps a table from distinct chunk to packed ids: a chunk is
segmented once by the library, and a document's ids are the table's entries
joined in the order of its chunks.  Nothing is shuffled.  The table is emptied
when it reaches a byte bound, which costs repeated work but changes no result.
A model whose pieces do cross markers, or whose normalizer changes text, gets
one chunk per text, so results are those of the library in every case.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import MARK, marked_chunks
from .common import sliced

#: Bytes of chunks and ids a task's table may hold before it is emptied.
TABLE_BYTES = 48 << 20
#: Chunks longer than this are encoded each time instead of being kept.
LONGEST_KEPT = 256
_ID = np.dtype("<u4")


def read_model(path: str) -> bytes:
    """The model file's bytes (they travel to the tasks in a broadcast of that one file)."""
    return Path(path).read_bytes()


def markers_separate(model: bytes) -> bool:
    """True if texts may be cut before runs of white-space markers.

    That needs: no piece has a marker after another character, a lone marker is a
    piece, the library puts one marker before a text, keeps every space, and its
    normalizer leaves probe characters alone.
    """
    processor = _processor(model)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces) or processor.is_unknown(processor.piece_to_id(MARK)):
        return False
    probe = " ﬁ  ① Ａ́é a b "
    return processor.decode(processor.encode(probe)) == probe and \
        processor.encode(probe, out_type=str)[0].startswith(MARK)


def _processor(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


class ChunkTable:
    """Distinct chunks of one task and their packed ids."""

    def __init__(self, processor, separate: bool):
        self.processor, self.separate = processor, separate
        self.packed: dict[str, bytes] = {}
        self.held = 0
        self.lone = np.array([processor.piece_to_id(MARK)], _ID).tobytes()
        self.ends = tuple(np.array([i], _ID).tobytes() for i in (processor.bos_id(), processor.eos_id()))

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text, each without its first marker (the library adds that one)."""
        if self.separate:
            return marked_chunks(text)
        return [text] if text else []

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        if not new:
            return {}
        found = dict(zip(new, (np.array(ids, _ID).tobytes() for ids in self.processor.encode(new, num_threads=1))))
        if self.separate and "" in found:
            found[""] = self.lone
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, with begin and end ids."""
        cut = [self.chunks(text) for text in texts]
        distinct = set().union(*cut)
        if self.held > TABLE_BYTES:
            self.packed, self.held = {c: self.packed[c] for c in distinct if c in self.packed}, 0
        found = self._learn([c for c in distinct if c not in self.packed])
        table = self.packed
        table.update(found)
        begin, end = self.ends
        packed = [begin + b"".join(map(table.__getitem__, parts)) + end for parts in cut]
        for chunk, ids in found.items():
            if len(chunk) > LONGEST_KEPT:
                del table[chunk]
            else:
                self.held += 150 + 2 * len(chunk) + len(ids)
        return packed


def codec_column(spark: SparkSession, model_path: str, text: Column) -> Column:
    """Struct ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` of each text."""
    model = read_model(model_path)
    separate = markers_separate(model)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("ids binary, decoded string")
    def codec(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(_processor(shared.value), separate)
        for batch in batches:
            for texts in sliced(batch, 256):
                packed = table.encode(["" if t is None else t for t in texts])
                decoded = [table.processor.decode(np.frombuffer(ids, _ID).tolist()) for ids in packed]
                yield pd.DataFrame({"ids": packed, "decoded": decoded})

    return codec(text)


def encode_decode(spark: SparkSession, docs: DataFrame, model_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: every whole text encoded exactly as the library does, and decoded again.

    A null text is encoded as an empty one (begin and end ids only); repeated rows
    and null ids come out row by row; an empty table gives an empty result; other
    columns are ignored.  ``ids`` is packed: see :func:`unpacked` for an array.
    """
    both = docs.select(F.col(id_col).alias(id_col), codec_column(spark, model_path, F.col(text_col)).alias("codec"))
    return both.select(id_col, F.col("codec.ids").alias("ids"), F.col("codec.decoded").alias("decoded"))


def n_tokens(ids: Column) -> Column:
    """Number of ids in a packed value."""
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    text = F.hex(ids)
    return F.transform(F.sequence(F.lit(0), n_tokens(ids).cast("int") - 1), lambda i: F.conv(F.concat(
        *(F.substring(text, i * 8 + 7 - 2 * b, F.lit(2)) for b in range(4))), 16, 10).cast("int"))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and digests of an encoded table."""
    return encoded.select(id_col, n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
