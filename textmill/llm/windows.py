"""Removal of repeated windows of consecutive units (words or lines).

A window is ``width`` consecutive units of one document.  Every window whose
units also start earlier (smaller id, or same document and earlier) is a
repeat; the units that repeats cover are removed.

How it runs: documents are dealt once into batches of consecutive ids.  A
batch hashes all its windows (Rabin-Karp, 64 + 32 bits), keeps one entry for
each distinct window (so a passage in a third of all documents is one entry a
batch) and sends the sorted hashes, cut by hash range into buckets, as delta
coded bytes.  A bucket sorts what it gets; since batches are ordered by id,
an entry with an equal one in an earlier batch is a repeat, and the bucket
answers each batch with one bit for each entry, in the order sent: neither
ids nor positions nor texts travel.  The batch hashes again, reads its bits,
merges covered positions and writes what is left.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import BASE_1, BASE_2, arrow_type, hash128, id_batches, rolling_hashes, row_of, split_words, starts_in_document

#: Work sizes only; results are the same for any.
BATCH_CHARS = 4_000_000
BUCKET_WINDOWS = 2_000_000


def _word_units(texts: pa.Array):
    offsets, words = split_words(texts)
    return offsets, words, None


def _line_units(texts: pa.Array):
    """Units are lines with a word; the third part has all lines of each text."""
    lines = [(t or "").split("\n") for t in texts.to_pylist()]
    real = [[x for x in doc if x.strip(" \t\n\v\f\r")] for doc in lines]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in real])]).astype(np.int64)
    return offsets, pa.array(list(itertools.chain.from_iterable(real)), pa.string()).dictionary_encode(), lines


UNITS = {"word": _word_units, "line": _line_units}


class _Windows:
    """The windows of one batch, always in the same order for the same rows."""

    def __init__(self, texts: pa.Array, unit: str, width: int):
        self.offsets, self.units, self.lines = UNITS[unit](texts)
        self.index = np.asarray(self.units.indices)
        words = self.units.dictionary.to_pylist()
        hashed = hash128(words) if words else np.zeros((0, 2), np.uint64)
        self.words = words
        starts = starts_in_document(self.offsets, width)
        first = rolling_hashes(hashed[self.index, 0], width, BASE_1)[starts] if len(starts) else np.zeros(0, np.uint64)
        check = rolling_hashes(hashed[self.index, 1], width, BASE_2)[starts] if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(first, kind="stable")
        ordered = first[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.starts, self.order, self.new = starts, order, new
        self.hashes = ordered[new]
        self.checks = (check[order[new]] >> np.uint64(32)).astype(np.uint32)

    def cuts(self, buckets: int) -> np.ndarray:
        """Borders, within the sorted hashes, of equal hash ranges."""
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.hashes, edges), [len(self.hashes)]])

    def repeated_starts(self, flags: np.ndarray) -> np.ndarray:
        """Starts of repeats: flagged entries, and all but the first of a batch's equal windows."""
        entry = np.cumsum(self.new) - 1
        return self.starts[self.order[flags[entry] | ~self.new]]


def _pack(hashes: np.ndarray, checks: np.ndarray) -> bytes:
    deltas = np.diff(hashes, prepend=np.uint64(0))
    return deltas.view(np.uint8).reshape(-1, 8).T.tobytes() + checks.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    planes = np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(planes).view(np.uint64).ravel()), np.frombuffer(blob, np.uint32, n, 8 * n)


_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("entries", pa.binary())])
_ANSWER = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _in_order(table: pa.Table) -> pa.Table:
    """Rows by id, then text: shuffles deliver them in any order."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")]) if table.num_rows > 1 else table


def _sender(unit: str, width: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        own = _Windows(table["_text"].combine_chunks(), unit, width)
        cuts, batch = own.cuts(buckets), table["_batch"][0].as_py()
        rows = [(k, batch, _pack(own.hashes[a:b], own.checks[a:b])) for k, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), _SENT.types)], schema=_SENT)

    return send


def _repeats(table: pa.Table) -> pa.Table:
    """One bucket: bits of the entries with an equal one in an earlier batch."""
    table = table.sort_by("batch")
    batches, bucket = table["batch"].to_pylist(), table["bucket"][0].as_py()
    parts = [_unpack(x.as_buffer()) for x in table["entries"].combine_chunks()]
    sizes = np.cumsum([0] + [len(h) for h, _ in parts])
    hashes, checks = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if (checks[order[1:]] != checks[order[:-1]])[same].any():  # different windows with one hash: sort by both
        order = np.lexsort((checks, hashes))
        same = hashes[order[1:]] == hashes[order[:-1]]
    same &= checks[order[1:]] == checks[order[:-1]]
    repeat = np.zeros(len(hashes), bool)
    repeat[order[1:]] = same
    rows = [(b, bucket, np.packbits(own).tobytes()) for b, own in zip(batches, np.split(repeat, sizes[1:-1])) if own.any()]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), _ANSWER.types)], schema=_ANSWER)


def _remover(unit: str, width: int, buckets: int, schema: pa.Schema):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _in_order(table)
        own = _Windows(table["_text"].combine_chunks(), unit, width)
        flags, cuts = np.zeros(len(own.hashes), bool), own.cuts(buckets)
        for k, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
            a, b = cuts[k], cuts[k + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        edges = np.zeros(int(own.offsets[-1]) + width + 1, np.int32)
        starts = own.repeated_starts(flags)
        edges[starts] += 1
        edges[starts + width] -= 1  # one start a position: plain indexing is right
        kept = np.cumsum(edges[: int(own.offsets[-1])]) == 0
        n_kept, texts = [], []
        for i, (a, b) in enumerate(itertools.pairwise(own.offsets.tolist())):
            keep, units = kept[a:b], [own.words[j] for j in own.index[a:b].tolist()]
            n_kept.append(int(keep.sum()))
            if own.lines is None:
                texts.append(" ".join(units if n_kept[-1] == b - a else itertools.compress(units, keep.tolist())))
            elif n_kept[-1] == b - a:
                texts.append("\n".join(own.lines[i]))
            else:
                left = iter(keep.tolist())
                texts.append("\n".join(x for x in own.lines[i] if not x.strip(" \t\n\v\f\r") or next(left)))
        sizes = np.diff(own.offsets)
        new = {"_id": table["_id"], "n_units": sizes, "n_removed": sizes - np.array(n_kept, np.int64), "kept_text": texts}
        return pa.Table.from_arrays([pa.array(new[f.name], f.type) if f.name in new and f.name != "_id" else table[f.name] for f in schema], schema=schema)

    return remove


def remove_repeated_windows(docs: DataFrame, unit: str, width: int, id_col: str = "doc_id", text_col: str = "text",
                            carry: list[str] = (), batch_chars: int = BATCH_CHARS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row per document: ``id_col``, ``n_units``, ``n_removed`` (long) and
    ``kept_text`` (units left, joined by one space or, for lines, with the
    blank lines by newlines), then a struct ``row`` of the columns ``carry``.

    Null texts count as empty.  Rows with one id are ordered by their texts
    and treated as documents of their own; a null id sorts first.  An equal
    (id, text) row is a repeat of the one before it.  An empty table gives an
    empty one.  Two different windows count as equal only if 96 bits of
    hash agree."""
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        raise TypeError(f"{id_col} must be a whole number")
    batch, n_batches, total = id_batches(docs, id_col, text_col, batch_chars)
    buckets = max(1, -(-total // (6 * bucket_windows)) if unit == "word" else -(-total // (60 * bucket_windows)))
    row = row_of(carry) if carry else F.lit(None).cast("boolean")
    dealt = docs.select(batch.alias("_batch"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"), row.alias("_row"))
    sent = dealt.groupBy("_batch").applyInArrow(_sender(unit, width, buckets), "bucket int, batch int, entries binary")
    answers = sent.groupBy("bucket").applyInArrow(_repeats, "batch int, bucket int, bits binary")
    out = T.StructType([T.StructField("_id", T.LongType()), T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept_text", T.StringType()), T.StructField("_row", dealt.schema["_row"].dataType)])
    schema = pa.schema([(f.name, arrow_type(f.dataType)) for f in out])
    done = dealt.groupBy("_batch").cogroup(answers.groupBy("batch")).applyInArrow(_remover(unit, width, buckets, schema), out)
    real_id = F.when(F.col("_id") > -(1 << 63), F.col("_id")).cast(docs.schema[id_col].dataType).alias(id_col)
    return done.select(real_id, "n_units", "n_removed", "kept_text", *([F.col("_row").alias("row")] if carry else []))
