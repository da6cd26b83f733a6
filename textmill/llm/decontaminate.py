"""Operator 4, benchmark decontamination: rare n-grams of test items seed
matches in training documents, and Smith-Waterman alignment of words scores
each match, so that edited copies are found with exact ones.

An n-gram is rare if, by the corpus's counts of its words, fewer than
``MAX_CHANCE`` occurrences are expected by chance; the n-gram's own count plays
no part.  The words' counts include the copies, so an item copied into very many
documents has longer seeds, up to the whole item, but keeps some.  Items go in
blocks of bounded size, each broadcast and held against all documents; texts
are scanned in place and never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import WORD, hash128, named, rolling_hashes, row_of, split_words, written

#: Lengths of seeds: the shortest rare n-gram is taken, and no longer one that contains it.
#: Longer ones than these are for items that have none of these.
SEED_WORDS = (2, 3, 4, 5)
MAX_CHANCE = 0.5
#: Items of fewer words are too short to align: their one seed is the whole item,
#: if that is rare, and only all its words in a row match.
ALIGNED_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: A match's alignment score, as a share of the item's own, is at least this.
MIN_SCORE = 0.4
#: or is that of so many matching words, whatever the item's length.
MIN_WORDS = 20
#: Words of a block of items, which bounds what is broadcast.
BLOCK_WORDS = 1_000_000

#: Punctuation that does not count at a word's borders.
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’„¿¡…-–—*_|"


def normal(words: pa.Array) -> pa.Array:
    """Case and punctuation around a word do not count; a word of nothing else stays."""
    low = pc.utf8_lower(words)
    bare = pc.utf8_trim(low, characters=EDGES)
    return pc.if_else(pc.equal(pc.binary_length(bare), 0), low, bare)


@dataclass
class Items:
    """A block of test items, as numbers of its own words."""

    ids: list
    words: dict[str, int]
    texts: list[np.ndarray]
    seeds: dict[int, tuple] = field(default_factory=dict)
    wholes: dict[int, tuple] = field(default_factory=dict)
    min_score: float = MIN_SCORE

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        words: dict[str, int] = {}
        ids, texts = [], []
        for item, text in rows:
            own = [words.setdefault(w, len(words)) for w in normal(pa.array(re.findall(WORD, text or ""), pa.string())).to_pylist()]
            if own:
                ids.append(item)
                texts.append(np.array(own, np.int32))
        return cls(ids, words, texts)

    def units(self) -> np.ndarray:
        return hash128(list(self.words))[:, 0] if self.words else np.zeros(0, np.uint64)

    def choose(self, counts: np.ndarray, total: int) -> None:
        """Seeds, by the corpus's counts of the words and its number of words."""
        p = np.log(np.maximum(counts, 0.5) / max(total, 1))
        units, found, wholes = self.units(), defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
        for k, text in enumerate(self.texts):
            before, taken = np.concatenate([[0], np.cumsum(p[text])]), np.zeros(len(text) + 1, bool)
            if len(text) < ALIGNED_WORDS:
                if np.log(max(total, 1)) + before[-1] < np.log(MAX_CHANCE):
                    wholes[len(text)][int(rolling_hashes(units[text], len(text))[0])].append((k, 0))
                continue
            some = False
            for n in range(SEED_WORDS[0], len(text) + 1):
                if some and n > SEED_WORDS[-1]:
                    break
                rare = np.log(max(total, 1)) + before[n:] - before[:-n] < np.log(MAX_CHANCE)
                covered = rare.copy()
                covered |= taken[: len(rare)] | taken[1 : len(rare) + 1]
                keys = rolling_hashes(units[text], n)
                for q in np.flatnonzero(rare & ~(taken[: len(rare)] | taken[1 : len(rare) + 1])).tolist():
                    found[n][int(keys[q])].append((k, q))
                    some = True
                taken = np.zeros(len(text) + 1, bool)
                taken[: len(covered)] = covered
        self.seeds, self.wholes = ({n: (np.array(sorted(f), np.uint64), dict(f)) for n, f in some.items() if f} for some in (found, wholes))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment, in the passage's
    positions; two rows of the Smith-Waterman table at a time."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        step, row, top = np.arange(len(b)) * -GAP, np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, word in enumerate(a.tolist()):
            h = np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP)
            np.maximum(h, 0, out=h)
            h = np.maximum.accumulate(h + step) - step  # gaps along the passage
            row[1:] = h
            j = int(h.argmax())
            if h[j] > top[0]:
                top = (int(h[j]), i + 1, j + 1)
        return top

    score, i, j = best(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = best(item[:i][::-1], passage[:j][::-1])
    return score, j - back, j


def matches(items: Items, units: np.ndarray, offsets: np.ndarray, text: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, start, end) of the passages of documents given
    as numbers of the items' words (-1: none of them)."""
    known = np.concatenate([[0], np.cumsum(text >= 0)])

    def hits(seeds: dict[int, tuple]) -> Iterator[tuple[int, int, int, int]]:
        """(position, document, item, position in the item) of each seed found."""
        for n, (keys, places) in seeds.items():
            if len(text) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            got = rolling_hashes(units[text], n)[at]
            near = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            hit = keys[near] == got
            at, got = at[hit], got[hit]
            document = np.searchsorted(offsets, at, side="right") - 1
            inside = at + n <= offsets[document + 1]
            for p, key, d in zip(at[inside].tolist(), got[inside].tolist(), document[inside].tolist()):
                for k, q in places[key]:
                    yield p, d, k, q

    out = []
    for p, d, k, _ in hits(items.wholes):
        size = len(items.texts[k])
        if np.array_equal(text[p : p + size], items.texts[k]):
            out.append((d, k, 1.0, p - int(offsets[d]), p + size - int(offsets[d])))
    spans = defaultdict(list)
    for p, d, k, q in hits(items.seeds):
        first, last = int(offsets[d]), int(offsets[d + 1])
        size = len(items.texts[k])
        slack = size // 2 + 2
        spans[d, k].append((max(first, p - q - slack), min(last, p - q + size + slack)))
    for (d, k), own in spans.items():
        own.sort()
        joined = [list(own[0])]
        for a, b in own[1:]:
            if a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            score, start, end = align(items.texts[k], text[a:b])
            share = score / (MATCH * len(items.texts[k]))
            if share >= items.min_score or score >= MATCH * MIN_WORDS:
                out.append((d, k, share, a + start - int(offsets[d]), a + end - int(offsets[d])))
    return out


def _numbers(words: pa.DictionaryArray, items: Items) -> np.ndarray:
    """The items' number of each distinct word, or -1."""
    found = pc.index_in(normal(words.dictionary), value_set=pa.array(list(items.words), pa.string()))
    return np.asarray(pc.fill_null(found, -1), np.int32)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Blocks of items, each of bounded size, one after the other on the driver."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // (6 * BLOCK_WORDS)))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Items.of([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()])


def _prepared(docs: DataFrame, text_col: str, items: Items, min_score: float) -> Items:
    """The block with its seeds, from counts over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        counts = np.zeros(len(own.words) + 1, np.int64)  # the last: words of no item
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                _, words = split_words(batch.column(0).slice(k, 1000))
                if len(words):
                    per = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
                    np.add.at(counts, _numbers(words, own), per)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(counts[some])], names=["word", "c"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(len(items.words) + 1, np.int64)  # at most one row for each word of the block
    for r in rows:
        counts[r["word"]] = r["c"]
    items.choose(counts[:-1], int(counts.sum()))
    items.min_score = min_score
    return items


def _finder(held, keep_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        units = np.append(items.units(), np.uint64(0))
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                offsets, words = split_words(part.column("text"))
                text = _numbers(words, items)[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int32)
                rows = matches(items, units, offsets, text)
                if keep_rows:
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in rows]] = False
                    yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(clean))], names=["row"])
                else:
                    ids = part.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]], names=["id", "k", "score", "start", "end"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(id_col, item_id, score, start, end), one row for each passage of a
    document that aligns with an item: words start:end, and the alignment's
    score as a share of a perfect copy's.

    Items of fewer than ``ALIGNED_WORDS`` words match whole or not at all, with
    score 1; of longer ones a passage scores ``min_score`` or as much as
    ``MIN_WORDS`` matching words.  Null and empty texts match nothing; repeated documents and items each give
    their rows; no items or no documents give an empty table."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    for block in _blocks(items, item_id, item_text):
        ready = _prepared(docs, text_col, block, min_score)
        found = rows.mapInArrow(_finder(spark.sparkContext.broadcast(ready), False), f"id {kind}, k long, score double, start long, end long")
        names = spark.createDataFrame(list(enumerate(ready.ids)), f"k long, item {items.schema[item_id].dataType.simpleString()}")
        one = written(found.join(names, "k").select(F.col("id").alias(id_col), F.col("item").alias(item_id), "score", "start", "end"), "contamination")
        out = one if out is None else out.union(one)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` without a passage that aligns with an item, all
    columns; see ``find_contamination``."""
    out = docs
    for k, block in enumerate(_blocks(items, item_id, item_text)):
        if k:
            out = written(out, "clean")  # a block's documents are the last one's survivors
        ready = _prepared(docs, text_col, block, min_score)
        rows = out.select(row_of(docs.columns).alias("row"), named(text_col).alias("text"))
        out = rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(ready), True), T.StructType([rows.schema["row"]])).select("row.*")
    return out
