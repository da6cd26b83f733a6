"""Joins on keys and the vocabulary helpers built on them.

Join strategy: only fixed literal lists are broadcast by hint (their size
is the list's).  Every data-derived side (vocabularies, weights, feature
tables) is a plain join: AQE turns it into a broadcast at run time only
when the measured side is under ``autoBroadcastJoinThreshold``, and
otherwise keeps a sort-merge join whose skewed partitions (a frequent
token) it splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import arrays as A
from pyspark.sql import types as T

from textmill.operators.windows import compact_ids
from textmill.session import cut_lineage

SCORE_SCHEMA = T.StructType([T.StructField("attributeScores", T.MapType(
    T.StringType(), T.StructType([T.StructField("summaryScore", T.StructType([
        T.StructField("value", T.DoubleType())]))])))])


def translate_lookup(posts: DataFrame, translations: DataFrame, target: str = "en",
                     lang: str = "language", text: str = "text") -> DataFrame:
    """Target-language posts keep their text; others take the translation
    keyed by the text's hash."""
    t = translations.select("text_key", "translation")
    j = posts.withColumn("__k", F.md5(F.col(text))).join(t, F.col("__k") == F.col("text_key"), "left")
    return j.withColumn("translated_text", F.when(F.col(lang) == target, F.col(text))
                        .otherwise(F.col("translation"))).drop("__k", "text_key", "translation")


def token_vectors_from_embeddings(emb: DataFrame, n_pos: int, key: str = "vec_id",
                                  col: str = "embedding") -> DataFrame:
    """(id, pos, vec): a flat vector cut into ``n_pos`` equal positions."""
    width = F.size(col) / n_pos
    return emb.select(F.col(key).alias("id"), A.posexplode(F.sequence(F.lit(0), F.lit(n_pos - 1))).alias("__i", "pos"),
                      col).select("id", "pos", F.slice(col, (F.col("pos") * width + 1).cast("int"),
                                                         width.cast("int")).alias("vec"))


def prefix_long(long: DataFrame, prefix: str) -> DataFrame:
    return long.withColumn("name", F.concat(F.lit(prefix + "_"), F.col("name")))


def join_features(base: DataFrame, long: DataFrame, names: list[str], key: str = "id") -> DataFrame:
    """Base rows + one column per feature name (left join, missing -> null).
    One pivot over the long store (value list given) and a single join,
    instead of one join per feature."""
    wide = long.where(F.col("name").isin(names)).groupBy(key).pivot("name", names).agg(F.first("value"))
    return base.join(wide, key, "left")


def parse_scores(df: DataFrame, col: str, key: str = "id") -> DataFrame:
    """JSON response -> (id, name, value); unparseable or failed responses
    give no rows here (see ``score_status``)."""
    m = F.from_json(F.col(col), SCORE_SCHEMA)["attributeScores"]
    return (df.select(key, F.explode(m).alias("name", "s"))
            .select(key, "name", F.col("s.summaryScore.value").alias("value")))


def score_status(df: DataFrame, col: str) -> DataFrame:
    """status: ok, unparseable (-1 from the service) or failed (null)."""
    return df.withColumn("status", F.when(F.col(col).isNull(), "failed")
                         .when(F.trim(F.col(col)) == "-1", "unparseable").otherwise("ok"))


def score_difference(orig: DataFrame, masked: DataFrame, key: str = "id") -> DataFrame:
    m = masked.select(key, "name", F.col("value").alias("__m"))
    return orig.join(m, [key, "name"], "left").select(key, "name", (F.col("value") - F.col("__m")).alias("value"))


def restrict_to_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def missing_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def build_vocabulary(tok: DataFrame, tokens: str, min_count: int = 10, token: str = "token") -> DataFrame:
    """(token, n, tok_id): tokens with count strictly above ``min_count``,
    consecutive ids in token order (distributed numbering).  Written once:
    as its size is known before the joins, a small one is broadcast and the
    tokens of the documents don't move."""
    counts = tok.select(A.explode(tokens).alias(token)).groupBy(token).agg(F.count("*").alias("n"))
    kept = counts.where(F.col("n") > min_count)
    return cut_lineage(compact_ids(kept, [token], out="tok_id"))


def token_ids(exploded: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Ids of the tokens in the vocabulary.  Give (key, token, n) of
    ``explode_counts`` rather than occurrences: a frequent token then joins
    once per document."""
    return exploded.join(vocab.select(token, "tok_id"), token, "inner")


def sif_weights(exploded: DataFrame, token: str = "token", a: float = 1e-3, n: str | None = None) -> DataFrame:
    """a / (a + count / total) per token; ``n`` names the column of counted rows.
    The counts are read twice, and joined with all tokens later: written once."""
    counts = cut_lineage(exploded.groupBy(token).agg((F.sum(n) if n else F.count("*")).alias("n")))
    total = counts.agg(F.sum("n").alias("__total"))
    return (counts.join(F.broadcast(total), how="inner")
            .select(token, (F.lit(a) / (F.lit(a) + F.col("n") / F.col("__total"))).alias("w")))


def token_weights(exploded: DataFrame, weights: DataFrame, token: str = "token",
                  default: float = 1e-6) -> DataFrame:
    """Weights of the tokens, ``default`` for the others; like ``token_ids``
    best over counted tokens."""
    return (exploded.join(weights.select(token, "w"), token, "left")
            .withColumn("w", F.coalesce(F.col("w"), F.lit(default))))


def row_totals(ids: DataFrame, counts: DataFrame, key: str = "id", n: str = "n",
               out: str = "total") -> DataFrame:
    """Row sums with zero rows kept."""
    s = counts.groupBy(key).agg(F.sum(n).alias(out))
    return ids.join(s, key, "left").select(key, F.coalesce(F.col(out), F.lit(0)).cast("long").alias(out))


#: Words of a vocabulary whose hashes (8 bytes each) are broadcast.
HELD_WORDS = 8_000_000


def _word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _hashes_of(vocab: DataFrame, token: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_word_hashes(batch.column(0).drop_null()).tobytes()], pa.binary())], names=["h"])

    parts = vocab.select(token).mapInArrow(run, "h binary").toLocalIterator()
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["h"], np.uint64) for r in parts]]))


def filter_in_vocab(docs: DataFrame, tokens: str, vocab: DataFrame, max_len: int | None = None,
                    key: str = "id", token: str = "token", out: str = "kept") -> DataFrame:
    """In-vocabulary tokens of each document in order (first ``max_len``).
    Tokens are looked up inside the document's row by 64 bits of hash: those of
    a vocabulary of at most ``HELD_WORDS`` words are broadcast and nothing
    moves; a larger one is joined (``joined_in_vocab``)."""
    vocab = cut_lineage(vocab.select(token))
    if vocab.count() > HELD_WORDS:
        return joined_in_vocab(docs, tokens, vocab, max_len, key, token, out)
    held = docs.sparkSession.sparkContext.broadcast(_hashes_of(vocab, token))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            h = _word_hashes(words.dictionary)
            at = np.searchsorted(known, h).clip(max=max(len(known) - 1, 0))
            good = known[at] == h if len(known) else np.zeros(len(h), bool)
            index = words.indices.fill_null(len(h)).to_numpy(zero_copy_only=False)
            kept = np.append(good, False)[index]  # a null is no word
            row = np.repeat(np.arange(batch.num_rows), size)
            if max_len is not None:
                before = np.concatenate([[0], np.cumsum(kept)])
                first = np.cumsum(size) - size
                kept &= before[1:] - before[np.repeat(first, size)] <= max_len
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))]).astype(np.int32)
            arr = pa.ListArray.from_arrays(pa.array(ends), words.dictionary.take(pa.array(index[kept])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arr], names=[key, out])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens).mapInArrow(run, f"`{key}` {kind}, `{out}` array<string>")


def joined_in_vocab(docs: DataFrame, tokens: str, vocab: DataFrame, max_len: int | None = None,
                    key: str = "id", token: str = "token", out: str = "kept") -> DataFrame:
    """``filter_in_vocab`` with a vocabulary of any size.
    A document sends each distinct token once, with its positions, through
    the semi-join and is re-assembled from what is left (its tokens are
    bounded by the document, already one row)."""
    ex = docs.select(key, A.explode(A.value_positions(tokens)).alias("__e")).select(
        key, F.col("__e.value").alias(token), F.col("__e.at").alias("__at"))
    kept = ex.join(vocab.select(token), token, "left_semi")
    per_doc = kept.groupBy(key).agg(F.collect_list(F.struct("__at", token)).alias("__s"))
    flat = F.flatten(F.transform("__s", lambda s: F.transform(s["__at"], lambda p: F.struct(p.alias("p"), s[token].alias("t")))))
    arr = F.transform(F.array_sort(flat), lambda s: s["t"])
    if max_len is not None:
        arr = F.slice(arr, 1, max_len)
    per_doc = per_doc.select(key, arr.alias(out))
    return (docs.select(key).join(per_doc, key, "left")
            .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>"))))


def context_frame(docs: DataFrame, tokens: str, k: int, key: str = "doc_id") -> DataFrame:
    """(key, pos, context): tokens within +-k positions, computed inside the
    document row (no window over a document, no shuffle)."""
    ex = docs.select(key, tokens, A.posexplode(tokens).alias("pos", "__t"))
    start = F.greatest(F.col("pos") - k, F.lit(0)) + 1
    end = F.least(F.col("pos") + k + 1, F.size(tokens))
    return ex.select(key, "pos", F.slice(tokens, start, end - start + 1).alias("context"))


#: Rows of a table that is broadcast to be looked up, and rows looked up together.
LOOKED_UP, LOOKED_ROWS = 2_000_000, 500_000


def with_looked_up(df: DataFrame, *wanted: tuple[str, DataFrame, str, list[str]]) -> DataFrame:
    """``df`` with, for each (column, table, key, values) wanted, the ``values``
    of the row of ``table`` whose unique ``key`` is the column's; null where there
    is none.  Tables of at most ``LOOKED_UP`` rows (words of a vocabulary) are
    broadcast and ``df`` doesn't move; larger ones are joined."""
    held, added = [], []
    for column, table, key, values in wanted:
        table = cut_lineage(table.select(key, *values))
        if table.count() > LOOKED_UP:
            own = table.withColumnRenamed(key, "__key")
            df = df.join(own, df[column] == own["__key"], "left").drop("__key")
        else:
            held.append((column, df.sparkSession.sparkContext.broadcast([c.combine_chunks() for c in table.toArrow().columns])))
            added += [table.schema[v] for v in values]
    if not held:
        return df
    names = [*df.columns, *[f.name for f in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(some: list) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(some)
            columns = rows.columns
            for column, table in held:
                at = pc.index_in(rows.column(column), value_set=table.value[0])
                columns += [pa.chunked_array([v.take(x) for x in at.chunks], v.type) for v in table.value[1:]]
            yield from pa.table(columns, names=names).to_batches()

        some, n = [], 0
        for batch in batches:
            some, n = [*some, batch], n + batch.num_rows
            if n >= LOOKED_ROWS:
                yield from done(some)
                some, n = [], 0
        if some:
            yield from done(some)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(f.name, f.dataType) for f in added]]))
