"""Operator 3, SentencePiece encoding and decoding by a table of distinct
chunks: when no piece has a white space marker after another letter, a text
can be cut before each run of markers; each distinct chunk is segmented once,
and the ids are joined back by position."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import named, row_of

MARK = "▁"
#: Entries of a worker's table; it is emptied when full.  Longer chunks are segmented each time.
TABLE_ENTRIES, ENTRY_CHARS = 400_000, 64


class ChunkTable:
    """Encodes and decodes exactly as the sentencepiece model given."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        # Chunks need markers only at the front of pieces, and a normaliser that only marks spaces.
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.normalize(" a  B\tééﬁ ") == f"{MARK}{MARK}a{MARK}{MARK}B\tééﬁ{MARK}"
        self.mark = [self.model.piece_to_id(MARK)]
        self.table: dict[str, list[int]] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks, each without its first marker (the encoder puts it back)."""
        if MARK in text:  # the normaliser's image of a space
            text = text.replace(MARK, " ")
        if not text:
            return []
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_chunk:
            return self.model.encode(texts, num_threads=1)
        cut = [self.chunks(t) for t in texts]
        need = set(itertools.chain.from_iterable(cut))
        new = [c for c in need if c not in self.table]
        if len(self.table) + len(new) > TABLE_ENTRIES:
            self.table.clear()
            new = list(need)
        fresh = dict(zip(new, self.model.encode(new, num_threads=1)))
        if "" in fresh:  # a marker alone; encoding nothing gives nothing
            fresh[""] = self.mark
        self.table.update((c, ids) for c, ids in fresh.items() if len(c) <= ENTRY_CHARS)
        look = {**{c: ids for c, ids in fresh.items() if len(c) > ENTRY_CHARS}}
        get = self.table.__getitem__ if not look else lambda c: look[c] if c in look else self.table[c]
        return [list(itertools.chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.model.decode(x) for x in ids]


_TABLES: dict[str, ChunkTable] = {}


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, keep: list[str] = ()) -> DataFrame:
    """``id_col``, ``ids`` (array of int, no begin or end ids) and, if wanted,
    ``decoded`` (decode(ids)) of every whole text with the sentencepiece
    ``model`` (its file's bytes), and a struct ``row`` of the columns ``keep``.
    Null and empty texts have no ids and decode to the empty text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a model file: about a MB, whatever the documents
    key = xxhash.xxh3_128_hexdigest(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:
            _TABLES[key] = ChunkTable(held.value)
        table = _TABLES[key]
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                ids = table.encode([t or "" for t in part.column("text").to_pylist()])
                sizes = np.array([len(x) for x in ids], np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                own = [lists] + ([pa.array(table.decode(ids), pa.string())] if decode else [])
                yield pa.RecordBatch.from_arrays([part.column("row"), *own], names=["row", "ids"] + ["decoded"] * decode)

    row = docs.select(F.struct(named(id_col).alias(id_col), *([row_of(keep).alias("row")] if keep else [])).alias("row"), named(text_col).alias("text"))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    out = row.mapInArrow(run, T.StructType([row.schema["row"], *added[: 1 + decode]]))
    return out.select(F.col("row").getField(id_col).alias(id_col), "ids", *["decoded"] * decode, *([F.col("row").getField("row").alias("row")] if keep else []))
