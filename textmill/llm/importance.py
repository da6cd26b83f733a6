"""Operator 11, importance resampling towards a target distribution.

Word unigrams and bigrams hash into a fixed number of buckets.  The log ratio
of target to corpus frequency is each bucket's gain, so a document's weight is
one look-up of its bucket array in the gains' array.  Adding Gumbel noise to
the weights and taking the highest scores draws without replacement in
proportion to the weights.  The k-th score is found by a distributed
quickselect: pivots drawn at random from the rows still in question, exact
counts of the rows under, at and over them in one aggregate, and only the part
that holds the k-th key goes on.  Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import named, row_of, split_words, written
from textmill.operators.windows import group_row_number

#: Buckets of hashed features (the only table that is broadcast, whatever the
#: corpus), words that a document needs to be drawn, and the seed of the noise.
BUCKETS, MIN_WORDS, SEED = 10_000, 20, 7
#: Pivot keys of one quickselect round.
PIVOTS = 32
#: The reflected polynomial of crc32.
POLYNOMIAL = 0xEDB88320
#: Bytes of a second word for which shift tables are kept; a longer word's
#: checksum goes on from the first word's, one occurrence at a time.
SHIFT_BYTES = 64

#: Upper-case ASCII to lower case, all other ASCII but digits and letters to a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def feature_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(offsets, words) of whole texts: runs of ASCII digits, letters (A-Z in
    lower case) and anything beyond ASCII.  Null texts have none."""
    texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    kind = np.int64 if texts.type == pa.large_string() else np.int32
    ends = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind().itemsize) if len(texts) else np.zeros(1, kind)
    own = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data else b""
    # A byte becomes a byte, so the offsets hold for the new letters.
    return split_words(type(texts).from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(own.translate(_LETTERS))))


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte ``b`` at place ``k`` of a checksum becomes when
    ``n`` more bytes follow (checksums are linear over bits)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    tables = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)]
    for _ in range(SHIFT_BYTES):
        tables.append((tables[-1] >> 8) ^ step[tables[-1] & 255])
    return np.stack(tables)


_SHIFT: list[np.ndarray] = []


def pair_checksums(left: np.ndarray, words: list[bytes], own: np.ndarray, sizes: np.ndarray, second: np.ndarray) -> np.ndarray:
    """crc32 of each left text followed by the word ``second``: ``left`` holds
    the checksums of the left texts, ``own`` and ``sizes`` those and the
    lengths of the words."""
    if not _SHIFT:
        _SHIFT.append(_shift_tables())
    n = np.minimum(sizes[second], SHIFT_BYTES)
    out = own[second]
    for k in range(4):
        out = out ^ _SHIFT[0][n, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    for at in np.flatnonzero(sizes[second] > SHIFT_BYTES):
        out[at] = zlib.crc32(words[second[at]], int(left[at]))
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, offsets of its features, buckets of all features):
    runs of one and of two consecutive words, joined by a space, repeats
    counted."""
    offsets, words = feature_words(texts)
    own = [w.encode() for w in words.dictionary.to_pylist()]
    index, total = np.asarray(words.indices, np.int64), int(offsets[-1])
    one = np.fromiter(map(zlib.crc32, own), np.uint32, len(own))
    spaced = np.fromiter((zlib.crc32(b" ", int(c)) for c in one), np.uint32, len(own))
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    sums = np.zeros(2 * total, np.uint32)
    sums[::2] = one[index]
    if total > 1:
        sums[1:-1:2] = pair_checksums(spaced[index[:-1]], own, one, sizes, index[1:])
    real = np.ones(2 * total, bool)
    n = np.diff(offsets)
    real[2 * offsets[1:][n > 0] - 1] = False  # a text's last word starts no pair
    ends = np.concatenate([[0], np.cumsum(np.maximum(2 * n - 1, 0))])
    return n, ends, (sums[real] % np.uint32(buckets)).astype(np.int32)


def with_features(docs: DataFrame, id_col: str, text_col: str, buckets: int, carry: list[str]) -> DataFrame:
    """``id``, ``n_words``, ``buckets`` (array) and, if asked for, ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                n, ends, found = features(part.column("text"), buckets)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
                rest = [part.column("row")] if carry else []
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), lists, *rest], names=["id", "n_words", "buckets", *(["row"] if carry else [])])

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"), *([row_of(carry).alias("row")] if carry else []))
    fields = [rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields + ([rows.schema["row"]] if carry else [])))


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features of all documents in each bucket: counted within each task,
    then summed; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], names=["bucket", "c"])

    out = np.zeros(buckets, np.int64)
    for bucket, c in featured.select("buckets").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c")).collect():
        out[bucket] = c
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed target share over its smoothed corpus share."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def with_weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` (floored mean gain of
    the features, 0 for none) and ``row`` if there."""
    held = featured.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.asarray(lists.offsets, np.int64)
            sums = np.concatenate([[0], np.cumsum(held.value[lists.flatten().to_numpy()])])
            n = np.diff(ends)
            total = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            weight = np.floor_divide(total, np.maximum(n, 1))
            rest = [batch.column("row")] if "row" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n), pa.array(weight), *rest], names=["id", "n_words", "n_features", "weight", *["row"] * len(rest)])

    kept = [f for f in featured.schema.fields if f.name != "buckets"]
    added = [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]
    return featured.mapInArrow(run, T.StructType(kept[:2] + added + kept[2:]))


def gumbel(id_col: str, seed: int) -> Column:
    """Noise of an id in thousandths, from the first 32 bits of a hash; a null
    id hashes like an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _under(keys: list[str], pivot: tuple) -> Column:
    """Whether a row's composite key is less than ``pivot``."""
    out = F.lit(False)
    for k, v in reversed(list(zip(keys, pivot))):
        out = (F.col(k) < F.lit(v)) | ((F.col(k) == F.lit(v)) & out)
    return out


def _at(keys: list[str], pivot: tuple) -> Column:
    out = F.lit(True)
    for k, v in zip(keys, pivot):
        out = out & (F.col(k) == F.lit(v))
    return out


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest composite key (``keys``: long columns without nulls)
    of ``rows``, 1 <= k <= number of rows.  Each round draws pivots from the
    rows left, counts exactly how many lie under and at each, and keeps the
    rows between the two pivots around the k-th; those are written, so a round
    reads a small share of the one before."""
    rows, before, turn = rows.select(*keys), 0, 0
    while True:
        chosen = rows.orderBy(F.xxhash64(*keys, F.lit(turn)), *keys).limit(pivots).collect()
        drawn = sorted({tuple(r) for r in chosen})
        counts = rows.agg(*[f for i, p in enumerate(drawn) for f in (F.count_if(_under(keys, p)).alias(f"u{i}"), F.count_if(_at(keys, p)).alias(f"a{i}"))]).first()
        low, high, passed = None, None, before
        for i, p in enumerate(drawn):
            under = before + counts[f"u{i}"]
            if under < k <= under + counts[f"a{i}"]:
                return p
            if k <= under:
                high = p
                break
            low, passed = p, under + counts[f"a{i}"]
        # The first key is also compared by itself, which the file reader can use.
        if low is not None:
            rows = rows.where(F.col(keys[0]) >= low[0]).where(~_under(keys, low) & ~_at(keys, low))
        if high is not None:
            rows = rows.where(F.col(keys[0]) <= high[0]).where(_under(keys, high))
        rows, before, turn = written(rows, "narrowed"), passed, turn + 1


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` of every
    row of ``docs``, and its columns ``carry`` in a struct ``row``; of the rows
    with at least ``min_words`` words, the floored ``percent`` with the highest
    scores have a rank (1, 2, 3 ...), the others null.

    Null and empty texts have no feature and weight 0.  Equal scores go by the
    smaller id, a null id first; rows with one id and score by fewer features,
    then as they come (each is a document of its own).  An empty target gives
    flat target shares; an empty table gives an empty one."""
    featured = written(with_features(docs, id_col, text_col, buckets, carry or []), "features")
    wanted = target.select(F.lit(0).alias("id"), named(target_text).alias("text"))
    gain = gains(bucket_counts(featured, buckets), bucket_counts(with_features(wanted, "id", "text", buckets, []), buckets))
    scored = with_weights(featured, gain).withColumn("score", F.col("weight") + gumbel("id", seed))
    # Composite keys are whole: highest score first, then ids, and the row's
    # place in the written table, which makes every key one row's own.
    scored = scored.withColumn("k_score", -F.col("score")).withColumn("k_id", F.coalesce(F.col("id"), F.lit(-(1 << 63)))).withColumn("k_row", F.monotonically_increasing_id())
    scored = written(scored, "scores")
    able, keys = scored.where(F.col("n_words") >= min_words), ["k_score", "k_id", "n_features", "k_row"]
    drawn = able.count() * percent // 100
    out = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank", *(["row"] if carry else [])]
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    last = kth_key(able, keys, drawn)
    wins = (F.col("n_words") >= min_words) & (_under(keys, last) | _at(keys, last))
    ranked = group_row_number(scored.where(wins), [], keys, out="rank")
    return ranked.select(*out).unionByName(scored.where(~wins).withColumn("rank", F.lit(None).cast("long")).select(*out))
