"""Dependency-pattern mining.

Input is a token table (doc_id, sent_id, i, form, lemma, head), or for most
steps its sentences (doc_id, sent_id, t: array of the other columns), which
then stay in their rows and need no shuffle.  Patterns
are connected sub-trees of the dependency tree, encoded as the sorted
array of their tokens' codes:

* plain mining: a sentence's tokens come together once, and its connected
  sets are listed inside its row (Arrow batches), counted per sentence;
* growth n-1 -> n (pruned mining): the children of the members of each
  (n-1)-gram are added, distinct; inside the sentence's row, or for a token
  table by a join of the tokens whose head is a member;
* counts: ``groupBy(n, pattern)`` (map-side partial aggregation);
* score: p(pattern) >= alpha x product of the unigram probabilities;
* maximal patterns: every proper sub-multiset of a surviving pattern
  (bit masks over the sorted array) is removed by an anti join;
* ids: consecutive numbers over the sorted final patterns.

Keys of every join are (doc_id, sent_id, position): fine grained, so a hot
word never lands in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.setops import pattern_subsets
from textmill.operators.windows import compact_ids, top_k_per_group
from textmill.session import cut_lineage

SENT = ["doc_id", "sent_id"]
#: Phrases that are broadcast together.
PHRASE_BLOCK = 200_000


# ---------------------------------------------------------------- phrases
def _trie(phrases: list) -> dict:
    """Nested dicts by token; the key None holds the labels that end there."""
    root: dict = {}
    for phrase, label in phrases:
        node = root
        for token in phrase.split():
            node = node.setdefault(token, {})
        node.setdefault(None, []).append(label)
    return root


def _greedy(spans: list) -> list:
    """The longest, then earliest, of the spans (start, length, label) that don't overlap."""
    taken, chosen = set(), []
    for span in sorted(spans, key=lambda x: (-x[1], x[0], x[2] is None, x[2] or "")):
        own = range(span[0], span[0] + span[1])
        if taken.isdisjoint(own):
            taken.update(own)
            chosen.append(span)
    return chosen


def _walker(held, chosen: bool):
    """Adds the phrases in a sentence's tokens to its ``spans``, and keeps those
    that ``_greedy`` takes if ``chosen``; the other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = held.value
        firsts = pa.array(list(root), pa.string())
        for batch in batches:
            at, forms, held_spans = (batch.column(c) for c in ("at", "forms", "spans"))
            ends = np.cumsum(pc.list_value_length(forms).fill_null(0).to_numpy(zero_copy_only=False))
            position, words = at.flatten().to_numpy(zero_copy_only=False), forms.flatten()
            hits = np.flatnonzero(pc.is_in(words, value_set=firsts).to_numpy(zero_copy_only=False))
            found = [[(f["start"], f["len"], f["label"]) for f in x] for x in held_spans.to_pylist()]
            row = np.searchsorted(ends, hits, side="right")
            for k, r, stop, first, form in zip(hits.tolist(), row.tolist(), ends[row].tolist(), position[hits].tolist(), words.take(pa.array(hits)).to_pylist()):
                node, end = root[form], k + 1
                while node is not None:
                    found[r] += [(first, end - k, x) for x in node.get(None, ())]
                    node = node.get(words[end].as_py()) if end < stop and len(node) > (None in node) else None
                    end += 1
            size, start, length, label = [], [], [], []
            for x in found:
                x = _greedy(x) if chosen and len(x) > 1 else x
                size.append(len(x))
                start += [f[0] for f in x]
                length += [f[1] for f in x]
                label += [f[2] for f in x]
            fields = [pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(label, pa.string())]
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "len", "label"]))
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", spans)

    return run


SPANS = "array<struct<start:int,len:int,label:string>>"


def phrase_spans(sents: DataFrame, phrases: DataFrame, chosen: bool = True) -> DataFrame:
    """Sentences (doc_id, sent_id, t: their tokens by position) with the column
    ``spans``: every phrase (lower-cased tokens, whatever their number), or if
    ``chosen`` the longest, then earliest that don't overlap.  A trie of the
    phrases is walked from each token; the phrases are broadcast in blocks of
    at most ``PHRASE_BLOCK``, one after the other.  Nothing else moves."""
    rows = sents.select("*", F.transform("t", lambda x: x["i"].cast("int")).alias("at"), F.transform("t", lambda x: F.lower(x["form"])).alias("forms"),
                        F.array().cast(SPANS).alias("spans"))
    own = phrases.select(F.lower("phrase").alias("phrase"), "label").where(F.trim("phrase") != "").distinct()
    n = max(1, -(-own.count() // PHRASE_BLOCK))
    for k in range(n):
        block = own.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k) if n > 1 else own
        held = sents.sparkSession.sparkContext.broadcast(_trie([tuple(r) for r in block.collect()]))
        rows = rows.mapInArrow(_walker(held, chosen and k == n - 1), rows.schema)
    return rows.drop("at", "forms")


def _grouped(tokens: DataFrame) -> DataFrame:
    if "t" in tokens.columns:
        return tokens
    t = F.array_sort(F.collect_list(F.struct("i", "form")))
    return tokens.groupBy(*SENT).agg(t.alias("t"))


def span_rows(sents: DataFrame) -> DataFrame:
    return sents.select(*SENT, F.explode("spans").alias("s")).select(*SENT, "s.start", "s.len", "s.label")


def phrase_candidates(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every phrase in a sentence: (doc_id, sent_id, start, len, label)."""
    return span_rows(phrase_spans(_grouped(tokens), phrases, chosen=False))


def match_phrases(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Keep the longest, then earliest, non-overlapping phrase spans of each
    sentence: (doc_id, sent_id, start, len, label) of a token table, or the
    sentences (``phrase_spans``) where ``tokens`` holds sentences."""
    found = phrase_spans(_grouped(tokens), phrases)
    return found if "t" in tokens.columns else span_rows(found)


def token_rows(sents: DataFrame) -> DataFrame:
    """Sentences as a token table."""
    return sents.select(*SENT, F.inline("t")) if "t" in sents.columns else sents


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t, spans = batch.column("t"), batch.column("spans")
        nodes, found = t.flatten(), spans.flatten()
        number = lambda x: x.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        rows = lambda x: np.repeat(np.arange(len(x)), pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False))
        row, i, head, none = rows(t), number(nodes.field("i")), number(nodes.field("head")), nodes.field("head").is_null().to_numpy(zero_copy_only=False)
        size, start = number(found.field("len")), number(found.field("start"))
        span = np.repeat(np.arange(len(found)), size)
        wide = 1 + max(int(x.max(initial=0)) for x in (i, head, start + size))
        covered = rows(spans)[span] * wide + start[span] + np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(covered, kind="stable")

        def span_of(position):
            """Number of the span over each token's ``position``, or -1."""
            if not len(order):
                return np.full(len(row), -1)
            key = row * wide + position
            at = order[np.searchsorted(covered[order], key).clip(max=len(order) - 1)]
            return np.where((covered[at] == key) & (position >= 0), span[at], -1)

        own, of_head = span_of(i), span_of(np.where(none, -1, head))
        start = np.append(start, -1)
        head = np.where(of_head >= 0, start[of_head], head)  # a span's inner token stands for its first one
        kept = np.flatnonzero((own < 0) | (start[own] == i))
        where = pa.array(kept)
        fields = {f.name: nodes.field(f.name).take(where) for f in nodes.type}
        fields["head"] = pa.array(head[kept], pa.int64(), mask=none[kept]).cast(nodes.type.field("head").type)
        fields["canon"] = found.field("label").take(pa.array(own[kept], pa.int64(), mask=own[kept] < 0))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))]).astype(np.int32)
        merged = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
        yield pa.RecordBatch.from_arrays([merged if c == "t" else batch.column(c) for c in batch.schema.names if c != "spans"], names=[c for c in batch.schema.names if c != "spans"])


def merge_phrases(tokens: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Merge each chosen span into its first token (canon = label); inner
    tokens are dropped and their children re-attached to the span token.
    Sentences hold their own ``spans`` and are merged in their rows."""
    if spans is None:
        t = tokens.schema["t"].dataType.elementType
        t = T.ArrayType(T.StructType([*t.fields, T.StructField("canon", T.StringType())]))
        return tokens.mapInArrow(_merged, T.StructType([T.StructField("t", t) if f.name == "t" else f for f in tokens.schema if f.name != "spans"]))
    cover = spans.select(*SENT, "start", "len", "label",
                         F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("i"))
    t = tokens.join(cover.select(*SENT, "i", "start", "label"), [*SENT, "i"], "left")
    inner = cover.where(F.col("i") > F.col("start")).select(*SENT, F.col("i").alias("head"),
                                                            F.col("start").alias("__new_head"))
    t = t.where(F.col("start").isNull() | (F.col("i") == F.col("start")))
    t = t.join(inner, [*SENT, "head"], "left").withColumn("head", F.coalesce("__new_head", "head"))
    return t.select(*SENT, "i", "form", "lemma", "head", F.col("label").alias("canon"))


def assign_cluster(tokens: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """code = phrase label, else word cluster, else the literal 'None'.
    Without a cluster table the lemma is the cluster (unclustered mode), and
    sentences stay sentences."""
    if clusters is None and "t" in tokens.columns:
        return tokens.withColumn("t", F.transform("t", lambda x: x.withField("code", F.coalesce(x["canon"], x["lemma"], F.lit("None")))))
    tokens = token_rows(tokens)
    if clusters is None:
        return tokens.withColumn("code", F.coalesce("canon", "lemma", F.lit("None")))
    t = tokens.join(clusters.select(F.col("token").alias("lemma"), F.col("cluster").cast("string")), "lemma", "left")
    return t.withColumn("code", F.coalesce("canon", "cluster", F.lit("None")))


# ---------------------------------------------------------------- n-grams
def eligible(tokens: DataFrame, pos_blacklist: list[str] | None = None, filter_stopwords: bool = False) -> DataFrame:
    """Tokens with a code; a filter that is asked for needs its column
    (``pos``, ``is_stop``), and tokens where that is null stay.  Sentences
    stay sentences if no filter is asked for."""
    if "t" in tokens.columns and not pos_blacklist and not filter_stopwords:
        return tokens.withColumn("t", F.filter("t", lambda x: x["code"].isNotNull())).where(F.size("t") > 0)
    tokens = token_rows(tokens)
    missing = {c for c, asked in (("pos", pos_blacklist), ("is_stop", filter_stopwords)) if asked} - set(tokens.columns)
    if missing:
        raise ValueError(f"tokens have no column {sorted(missing)}")
    t = tokens.where(F.col("code").isNotNull())
    if pos_blacklist:
        t = t.where(F.col("pos").isNull() | ~F.col("pos").isin(pos_blacklist))
    if filter_stopwords:
        t = t.where(~F.coalesce("is_stop", F.lit(False)))
    return t


def unigrams(tok: DataFrame) -> DataFrame:
    """One gram per eligible token: positions [i] and pattern [code].
    Sentences get the column ``grams``, the positions of each of their grams."""
    if "t" in tok.columns:
        return tok.withColumn("grams", F.transform("t", lambda x: F.array(x["i"])))
    return tok.select(*SENT, F.array("i").alias("gram"), F.array("code").alias("pattern"))


def grow_connected_ngrams(grams: DataFrame, tok: DataFrame | None = None) -> DataFrame:
    """(n-1)-grams -> n-grams: add any child of any member (tree edges).
    Sentences that hold their ``grams`` grow them in their rows.  From a token
    table the child's code travels with it, so the pattern (sorted codes) is
    built during growth and never needs a join back to the tokens."""
    if "grams" in grams.columns:
        return grams.mapInArrow(_grown, grams.schema)
    members = grams.select(*SENT, "gram", "pattern", F.explode("gram").alias("head"))
    children = tok.where(F.col("head").isNotNull()).select(*SENT, "head", F.col("i").alias("child"),
                                                           F.col("code").alias("__code"))
    j = members.join(children, [*SENT, "head"]).where(~F.array_contains("gram", F.col("child")))
    grown = j.select(*SENT, F.array_sort(F.concat("gram", F.array("child"))).alias("gram"),
                     F.array_sort(F.concat("pattern", F.array("__code"))).alias("pattern"))
    # the same set of positions can be reached from different (n-1)-grams
    return grown.dropDuplicates([*SENT, "gram"])


def _children(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(children in the order of their heads, where each node's begin)."""
    order = np.argsort(parent, kind="stable")
    order = order[np.searchsorted(parent[order], 0):]
    return order, np.searchsorted(parent[order], np.arange(len(parent) + 1))


def _with_child(sets: np.ndarray, j: int, children: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, child) of each child of the sets' j-th members."""
    order, first = children
    begin = first[sets[:, j]]
    size = first[sets[:, j] + 1] - begin
    row = np.repeat(np.arange(len(sets)), size)
    return row, order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(row))]


def _grown_sets(sets: np.ndarray, children: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sets (rows of node numbers) with a child of a member added, each once."""
    grown = []
    for j in range(sets.shape[1]):
        row, child = _with_child(sets, j, children)
        fresh = np.ones(len(row), bool)
        for k in range(sets.shape[1]):
            fresh &= sets[row, k] != child
        grown.append(np.sort(np.column_stack([sets[row[fresh]], child[fresh]]), axis=1))
    grown = np.concatenate(grown)
    return _distinct(grown, len(children[1]), False)[0] if len(grown) else grown


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        row, position, parent = _tree(batch)
        grams = batch.column("grams")
        per_row, flat = pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False), grams.flatten()
        n = len(flat.flatten()) // max(len(flat), 1)
        low = int(position.min(initial=0))
        wide = int(position.max(initial=0)) - low + 1
        key = row * wide + (position - low)
        order = np.argsort(key, kind="stable")
        of = np.repeat(np.arange(batch.num_rows), per_row)
        member = flat.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False).reshape(-1, max(n, 1))
        sets = order[np.searchsorted(key[order], of[:, None] * wide + (member - low))] if len(flat) else np.zeros((0, max(n, 1)), np.int64)
        sets = _grown_sets(sets, _children(parent))
        sets = sets[np.argsort(row[sets[:, 0]], kind="stable")]
        size = np.bincount(row[sets[:, 0]], minlength=batch.num_rows)
        inner = pa.array(np.sort(position[sets], axis=1).ravel()).cast(grams.type.value_type.value_type)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * np.int32(sets.shape[1])), inner)
        grown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), inner)
        yield batch.set_column(batch.schema.get_field_index("grams"), "grams", grown)


def connected_sets(head: dict, max_n: int) -> Iterator[tuple]:
    """Each connected set of at most ``max_n`` nodes once, given each node's
    head.  A set is listed from its top node: every later member is a child
    of an earlier one, and a branch that is passed over is never taken up."""
    children = defaultdict(list)
    for i, h in head.items():
        if h is not None and h != i and h in head:
            children[h].append(i)

    def grow(top, members, frontier):
        yield members
        if len(members) < max_n:
            for k, c in enumerate(frontier):
                yield from grow(top, (*members, c), frontier[k + 1:] + [x for x in children.get(c, ()) if x != top])

    for top in head:
        ring, up = [top], head[top]  # a ring of heads has a top at each of its nodes
        while up != top and up in head and len(ring) < max_n:
            ring.append(up)
            up = head[up]
        other = up == top and top != min(ring)
        for members in grow(top, (top,), children.get(top, [])):
            if not (other and set(ring) <= set(members)):
                yield members


#: Pattern hashes that a task holds before it passes them on, and their bits.
HELD_HASHES, HASH_BITS = 1_000_000, 32
#: Sentences of a batch that are listed together, so that a task holds few sets.
SENTENCES = 1_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SENTENCES):
            yield batch.slice(k, SENTENCES)


def _forest_sets(parent: np.ndarray, max_n: int) -> Iterator[np.ndarray]:
    """For n = 1..max_n the connected sets of n nodes of a forest without rings
    (rows of node numbers), each once: its top node, then the children of each
    member in the members' order.  So a set grows by the later children of the
    member that its last one hangs on, or by any child of a later member."""
    order, first = _children(parent)
    nodes = np.arange(len(parent))
    groups = [(0, [nodes], first[:-1])]  # (member whose children come next, members, where they go on)
    for n in range(1, max_n + 1):
        yield np.concatenate([np.column_stack(members) for _, members, _ in groups])
        grown = []
        for at, members, begin in groups if n < max_n else ():
            for j in range(at, n):
                start = begin if j == at else first[members[j]]
                size = first[members[j] + 1] - start
                row = np.repeat(np.arange(len(size)), size)
                place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(row))
                grown.append((j, [*[m[row] for m in members], order[place]], place + 1))
        groups = grown


def _parents(position: np.ndarray, head: np.ndarray, has: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of each token's head in the batch, -1 where it has none (its own
    head counts as none); ``row`` is the token's sentence, in order."""
    low = min(int(position.min(initial=0)), int(head[has].min(initial=0)))
    wide = max(int(position.max(initial=0)), int(head[has].max(initial=0))) - low + 1
    key = row * wide + (position - low)
    order = np.argsort(key, kind="stable")
    want = row * wide + (head - low)
    at = np.searchsorted(key[order], want).clip(max=max(len(key) - 1, 0))
    found = order[at] if len(key) else order
    return np.where(has & (key[found] == want) & (found != np.arange(len(key))), found, -1)


def _tree(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, position, number of the head) of the tokens of a batch of sentences."""
    t = batch.column("t")
    nodes, size = t.flatten(), pc.list_value_length(t).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), size)
    position = nodes.field("i").cast(pa.int64()).to_numpy(zero_copy_only=False)
    head = nodes.field("head").cast(pa.int64())
    has = head.is_valid().to_numpy(zero_copy_only=False)
    return row, position, _parents(position, head.fill_null(0).to_numpy(zero_copy_only=False), has, row)


def _codes(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(distinct codes in order, number of each token's code) of a batch of sentences."""
    coded = batch.column("t").flatten().field("code").dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)] if len(rank) else np.zeros(0, np.int64)


def _batch_sets(batch: pa.RecordBatch, max_n: int):
    """(distinct codes in order, [(sentence of each set, codes of its members
    as sorted numbers) for n = 1..max_n]) of a batch of sentences."""
    row, _, parent = _tree(batch)
    codes, code = _codes(batch)
    size = np.bincount(row, minlength=1)
    up = parent.copy()  # after as many steps as there are nodes only those under a ring have a head left
    for _ in range(max(1, int(size.max(initial=1))).bit_length()):
        up = np.where(up >= 0, up[up], -1)
    ringed = np.unique(row[up >= 0])
    free = np.flatnonzero(~np.isin(row, ringed))
    number = np.full(len(row) + 1, -1)
    number[free] = np.arange(len(free))
    sets = [free[x] for x in _forest_sets(number[parent[free]], max_n)]
    for r in ringed.tolist():  # rings of heads, one sentence at a time
        own = np.flatnonzero(row == r)
        extra = list(connected_sets({int(k): int(parent[k]) if parent[k] >= 0 else None for k in own}, max_n))
        for n in range(max_n):
            some = [m for m in extra if len(m) == n + 1]
            if some:
                sets[n] = np.concatenate([sets[n], np.array(some)])
    return codes, [(row[x[:, 0]], np.sort(code[x], axis=1)) for x in sets]


def _hashes(codes: pa.Array) -> np.ndarray:
    return pd.util.hash_array(codes.to_numpy(zero_copy_only=False), categorize=False) if len(codes) else np.zeros(0, np.uint64)


def _long_hash(of_code: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """64 bits of hash of each row of code numbers."""
    h = np.full(len(patterns), patterns.shape[1], np.uint64)
    for k in range(patterns.shape[1]):
        h = (h ^ of_code[patterns[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _pattern_hash(of_code: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """``HASH_BITS`` of them."""
    return (_long_hash(of_code, patterns) >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def _distinct(patterns: np.ndarray, n_codes: int, numbered: bool = True):
    """(one row of each distinct pattern, number of every row's pattern if ``numbered``)."""
    n = patterns.shape[1]
    if n_codes ** n >= 2 ** 63:
        _, first, of = np.unique(patterns, axis=0, return_index=True, return_inverse=True)
        return patterns[first], of.reshape(-1)
    key = np.zeros(len(patterns), np.int64)
    for k in range(n):
        key = key * n_codes + patterns[:, k]
    key, *of = np.unique(key, return_inverse=True) if numbered else (np.unique(key),)
    rows = np.empty((len(key), n), np.int64)  # the key holds its row
    for k in reversed(range(n)):
        key, rows[:, k] = np.divmod(key, n_codes)
    return rows, of[0] if numbered else None


def sentence_rows(tok: DataFrame) -> DataFrame:
    """(doc_id, t): the tokens of each sentence, brought together once if they
    are not together."""
    if "t" in tok.columns:
        return tok.select("doc_id", F.transform("t", lambda x: F.struct(x["i"].alias("i"), x["head"].alias("head"), x["code"].alias("code"))).alias("t"))
    return tok.groupBy(*SENT).agg(F.collect_list(F.struct("i", "head", "code")).alias("t")).select("doc_id", "t")


def _bit_of(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint32(HASH_BITS - (len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0


def sentence_patterns(tok: DataFrame, max_n: int, by_doc: bool = True, only=None, listed=None) -> DataFrame:
    """(doc_id, pattern, cnt): connected n-grams (n = 1..max_n) counted within
    documents; a document's counts of a pattern may come in several rows.
    ``tok`` are tokens, or sentences of ``sentence_rows``; nothing else moves.
    Without ``by_doc`` (pattern, cnt) over whole batches.  ``only``, a broadcast
    table of bits (``frequent_bits``), leaves out n-grams (n > 1) without a bit.
    ``listed`` lists other sets of a batch than all connected ones (``_pruned_sets``)."""
    sents, listed = sentence_rows(tok), listed or (lambda batch: _batch_sets(batch, max_n))
    own = f"doc_id {sents.schema['doc_id'].dataType.simpleString()}, " if by_doc else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, sets = listed(batch)
            of_code = _hashes(codes)
            for n, (row, patterns) in enumerate(sets, 1):
                if only is not None and n > 1:
                    kept = _bit_of(only.value, _pattern_hash(of_code, patterns))
                    row, patterns = row[kept], patterns[kept]
                if not len(row):
                    continue
                patterns, of = _distinct(patterns, len(codes))
                out = []
                if by_doc:
                    docs = batch.column("doc_id").dictionary_encode()
                    doc = docs.indices.fill_null(len(docs.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                    key, cnt = np.unique(of * (len(docs.dictionary) + 1) + doc, return_counts=True)
                    of, doc = np.divmod(key, len(docs.dictionary) + 1)
                    out.append(docs.dictionary.take(pa.array(doc, mask=doc == len(docs.dictionary))))
                else:
                    of, cnt = np.arange(len(patterns)), np.bincount(of)
                flat = codes.take(pa.array(patterns[of].ravel()))
                out += [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), flat), pa.array(cnt.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=[*(["doc_id"] if by_doc else []), "pattern", "cnt"])

    return sents.mapInArrow(run, own + "pattern array<string>, cnt long")


def _ranges(h: np.ndarray, cnt: np.ndarray, n_ranges: int) -> pa.RecordBatch:
    """Hashes with their counts by range: sorted differences, bytes of a place
    together (most are 0, and so compress)."""
    order = np.argsort(h, kind="stable")
    h, first = np.unique(h[order], return_index=True)
    cnt = np.add.reduceat(cnt[order].astype(np.int64), first) if len(h) else cnt
    cut = np.searchsorted(h, np.arange(1, n_ranges).astype(np.uint64) * (2 ** HASH_BITS // n_ranges))
    parts = [(r, x, c) for r, (x, c) in enumerate(zip(np.split(h, cut), np.split(cnt, cut))) if len(x)]
    return pa.RecordBatch.from_arrays([
        pa.array([r for r, _, _ in parts], pa.int32()),
        pa.array([np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for _, x, _ in parts], pa.binary()),
        pa.array([c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for _, _, c in parts], pa.binary())], names=["r", "h", "c"])


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _bits(ranges: DataFrame, least: int, n_ranges: int, n_bits: int):
    """Broadcast table of 2 ** n_bits bits: those of the hashes counted at
    least ``least`` times.  Its size is fixed; a range is one group.  Beside it
    {n: sum} of the numbers of ranges -n."""
    width = 2 ** n_bits // n_ranges

    def group(table: pa.Table) -> pa.Table:
        if table.column("r")[0].as_py() < 0:
            total = sum(np.frombuffer(x, np.int64)[0] for x in table.column("c").to_pylist())
            return pa.table({"r": table.column("r").slice(0, 1), "bits": pa.array([np.int64(total).tobytes()], pa.binary())})
        h = np.concatenate([np.cumsum(_numbers(x), dtype=np.uint32) for x in table.column("h").to_pylist()])
        cnt = np.concatenate([_numbers(x) for x in table.column("c").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, first = np.unique(h[order], return_index=True)
        h = h[np.add.reduceat(cnt[order], first) >= least]
        set_bits = np.zeros(width, np.uint8)
        set_bits[(h >> np.uint32(HASH_BITS - n_bits)) % np.uint32(width)] = 1
        return pa.table({"r": table.column("r").slice(0, 1), "bits": pa.array([np.packbits(set_bits, bitorder="little").tobytes()], pa.binary())})

    bits, totals = np.zeros(2 ** n_bits // 8, np.uint8), {}
    for r in ranges.groupBy("r").applyInArrow(group, "r int, bits binary").toLocalIterator():
        if r["r"] < 0:
            totals[-r["r"]] = int(np.frombuffer(r["bits"], np.int64)[0])
        else:
            bits[r["r"] * width // 8:(r["r"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return ranges.sparkSession.sparkContext.broadcast(bits), totals


def _sizes(n_tokens: int) -> tuple[int, int]:
    """(ranges, bits of the table) for so many tokens: about 16 MB a range, and
    at most 2 ** 28 bits."""
    n_ranges = 2 ** max(3, (n_tokens * 50 // 2 ** 24).bit_length())
    return n_ranges, min(28, max(n_ranges.bit_length() + 6, (n_tokens * 16).bit_length(), 12))


def frequent_bits(sents: DataFrame, max_n: int, min_freq: int, sizes: tuple[int, int], listed=None):
    """Bits of all n-grams (n > 1) that may occur ``min_freq`` times: of those
    whose hash does.  Of an n-gram only its hash moves.  Beside them {n:
    connected n-grams} (as ranges -n)."""
    n_ranges, n_bits = sizes
    listed = listed or (lambda batch: _batch_sets(batch, max_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        total = np.zeros(max_n, np.int64)
        for batch in _slices(batches):
            codes, sets = listed(batch)
            total += [len(row) for row, _ in sets]
            of_code = _hashes(codes)
            for _, patterns in sets[1:]:
                held.append(np.unique(_pattern_hash(of_code, patterns), return_counts=True))
                n_held += len(held[-1][0])
            if n_held >= HELD_HASHES:
                yield _ranges(*map(np.concatenate, zip(*held)), n_ranges)
                held, n_held = [], 0
        if n_held:
            yield _ranges(*map(np.concatenate, zip(*held)), n_ranges)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, -max_n - 1, -1), pa.int32()), pa.array([b""] * max_n, pa.binary()),
                                          pa.array([x.tobytes() for x in total], pa.binary())], names=["r", "h", "c"])

    return _bits(sents.mapInArrow(run, "r int, h binary, c binary"), min_freq, n_ranges, n_bits)


def pattern_bits(patterns: DataFrame, sizes: tuple[int, int]):
    """Bits of the given patterns."""
    n_ranges, n_bits = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("pattern")
            coded = p.flatten().dictionary_encode()
            of_code, flat = _hashes(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
            size = pc.list_value_length(p).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            h = [_pattern_hash(of_code, flat[begin[size == n][:, None] + np.arange(n)]) for n in np.unique(size).tolist()]
            if h:
                h = np.concatenate(h)
                yield _ranges(h, np.ones(len(h), np.int64), n_ranges)

    return _bits(patterns.select("pattern").mapInArrow(run, "r int, h binary, c binary"), 1, n_ranges, n_bits)[0]


def set_totals(sents: DataFrame, max_n: int, listed=None) -> dict[int, int]:
    """{n: connected n-grams}."""
    listed = listed or (lambda batch: _batch_sets(batch, max_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(max_n, np.int64)
        for batch in _slices(batches):
            total += [len(row) for row, _ in listed(batch)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, max_n + 1)), pa.array(total)], names=["n", "cnt"])

    return {r["n"]: r["cnt"] for r in sents.mapInArrow(run, "n long, cnt long").groupBy("n").agg(F.sum("cnt").alias("cnt")).collect()}


def frequent_counts(sents: DataFrame, max_n: int, min_freq: int, sizes: tuple[int, int] | None = None, listed=None) -> DataFrame:
    """``ngram_counts`` of the single codes and of the n-grams that occur
    ``min_freq`` times.  Hashes say which n-grams may; their exact counts follow."""
    only, totals = frequent_bits(sents, max_n, min_freq, sizes or token_sizes(sents), listed) if min_freq > 1 else (None, set_totals(sents, max_n, listed))
    c = sentence_patterns(sents, max_n, by_doc=False, only=only, listed=listed).groupBy("pattern").agg(F.sum("cnt").alias("cnt"))
    c = c.select(F.size("pattern").alias("n"), "pattern", "cnt").where((F.col("n") == 1) | (F.col("cnt") >= min_freq))
    total = F.lit(None).cast("double")
    for n, x in totals.items():
        total = F.when(F.col("n") == n, F.lit(float(x))).otherwise(total)
    return cut_lineage(c.withColumn("p", F.col("cnt") / total))


def token_sizes(sents: DataFrame) -> tuple[int, int]:
    return _sizes(sents.agg(F.sum(F.size("t"))).first()[0] or 0)


def encode(grams: DataFrame, tok: DataFrame | None = None) -> DataFrame:
    """(doc, sentence, gram, pattern): the pattern is carried by the grams."""
    return grams.select(*SENT, "gram", "pattern")


def _occurrences(encoded: DataFrame) -> Column:
    """One a row, or ``cnt`` where rows are counts already."""
    return F.sum("cnt") if "cnt" in encoded.columns else F.count("*")


def ngram_counts(encoded: DataFrame) -> DataFrame:
    """(n, pattern, cnt, p) with p = cnt / total count of length n."""
    c = encoded.groupBy(F.size("pattern").alias("n"), "pattern").agg(_occurrences(encoded).alias("cnt"))
    tot = c.groupBy("n").agg(F.sum("cnt").alias("__tot"))
    return c.join(F.broadcast(tot), "n").withColumn("p", F.col("cnt") / F.col("__tot")).drop("__tot")


def collocation_score(counts: DataFrame, unigram_p: DataFrame, alpha: float) -> DataFrame:
    """keep = length 1, or p(pattern) >= alpha x product of unigram p."""
    ex = counts.select("*", F.explode("pattern").alias("code"))
    one = cut_lineage(unigram_p.select("code", F.col("p").alias("p1")))  # of known size: broadcast while small
    scored = (ex.join(one, "code", "left").groupBy(*counts.columns)
              .agg(F.product(F.coalesce("p1", F.lit(0.0))).alias("pprod")).withColumn("pprod", F.when(F.col("n") > 1, F.col("pprod"))))
    return scored.withColumn("keep", (F.col("n") == 1) | (F.col("p") >= F.lit(alpha) * F.col("pprod")))


def unigram_probabilities(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n") == 1).select(F.element_at("pattern", 1).alias("code"), "p")


def maximal_patterns(patterns: DataFrame) -> DataFrame:
    """Drop every pattern that is a proper sub-multiset of a kept one."""
    subs = pattern_subsets(patterns.select("pattern"), "pattern", out="sub").select(F.col("sub").alias("pattern"))
    return patterns.join(subs.distinct(), "pattern", "left_anti")


def compact_pattern_ids(patterns: DataFrame) -> DataFrame:
    """Consecutive ids over the sorted patterns."""
    return compact_ids(patterns.select("pattern").distinct(), ["pattern"], out="pid")


def doc_pattern_counts(encoded: DataFrame, final_ids: DataFrame) -> DataFrame:
    """Per-document counts of the surviving patterns, with their new ids."""
    return (encoded.join(final_ids, "pattern").groupBy("doc_id", "pid").agg(_occurrences(encoded).alias("n")))


def mine_collocations(tokens: DataFrame, min_n: int, max_n: int, alpha: float, min_freq: int,
                      pos_blacklist: list[str] | None = None, filter_stopwords: bool = False):
    """All connected n-grams for n in {1} + [max(min_n, 2), max_n], counts,
    frequency and score filter, maximal patterns, ids, document counts.
    Returns (final patterns with ids, per-document counts)."""
    sents = cut_lineage(sentence_rows(eligible(tokens, pos_blacklist, filter_stopwords)))
    sizes = token_sizes(sents)
    counts = frequent_counts(sents, max_n, min_freq, sizes)
    frequent = counts.where((F.col("cnt") >= min_freq) & (F.col("n") >= min_n))
    kept = collocation_score(frequent, unigram_probabilities(counts), alpha).where("keep")
    final = cut_lineage(compact_pattern_ids(maximal_patterns(cut_lineage(kept.select("pattern")))))
    enc = sentence_patterns(sents, max_n, only=pattern_bits(final, sizes))
    return final, doc_pattern_counts(enc, final)


def _pattern_rows(p: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(distinct codes, rows of code numbers) of patterns, by their length."""
    coded = p.flatten().dictionary_encode()
    flat, size = coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(p).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        yield coded.dictionary, flat[begin[size == n][:, None] + np.arange(n)]


def _survivors(patterns: DataFrame):
    """Broadcast hashes (64 bits each) of patterns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, rows in _pattern_rows(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([_long_hash(_hashes(codes), rows).tobytes()], pa.binary())], names=["h"])

    parts = patterns.select("pattern").mapInArrow(run, "h binary").toLocalIterator()
    held = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["h"], np.uint64) for r in parts]]))
    return patterns.sparkSession.sparkContext.broadcast(held)


def _pruned_sets(survivors: list, max_n: int, every: bool = False):
    """Lists the sets of ``max_n`` nodes (``every``: of 1..max_n) that grow from
    sets whose patterns are all among the ``survivors`` of their length."""
    def listed(batch: pa.RecordBatch):
        row, _, parent = _tree(batch)
        codes, code = _codes(batch)
        of_code, children = _hashes(codes), _children(parent)
        sets, out = np.arange(len(row))[:, None], []
        for n in range(1, max_n + 1):
            patterns = np.sort(code[sets], axis=1)
            shown = slice(None) if every or n == max_n else slice(0)
            out.append((row[sets[:, 0]][shown], patterns[shown]))
            if n < max_n:
                h, known = _long_hash(of_code, patterns), survivors[n - 1].value
                kept = known[np.searchsorted(known, h).clip(max=len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                sets = _grown_sets(sets[kept], children)
        return codes, out

    return listed


def mine_collocations_pruned(tokens: DataFrame, min_n: int, max_n: int, alpha: float, min_freq: int,
                             pos_blacklist: list[str] | None = None, filter_stopwords: bool = False):
    """Apriori variant: only n-grams grown from frequent and probable
    (n-1)-grams are counted.  Each round grows them again inside the sentences'
    rows (as ``grow_connected_ngrams``), where survivors of the rounds before
    are known by 64 bits of hash, so no occurrence is written or moved."""
    sents = cut_lineage(sentence_rows(eligible(tokens, pos_blacklist, filter_stopwords)))
    sizes = token_sizes(sents)
    unigram_p, held, pool = None, [], None
    for n in range(1, max_n + 1):
        counts = frequent_counts(sents, n, min_freq, sizes, _pruned_sets(held, n))
        if n == 1:
            unigram_p = unigram_probabilities(counts)
        scored = collocation_score(counts.where(F.col("cnt") >= min_freq), unigram_p, alpha)
        ok = cut_lineage(scored.where("keep").select("pattern"))
        if n >= min_n:
            pool = ok if pool is None else pool.unionByName(ok)
        if n < max_n:
            held.append(_survivors(ok))
    final = cut_lineage(compact_pattern_ids(maximal_patterns(pool.distinct())))
    enc = sentence_patterns(sents, max_n, only=pattern_bits(final, sizes), listed=_pruned_sets(held, max_n, every=True))
    return final, doc_pattern_counts(enc, final)


def cluster_lemma_counts(tokens: DataFrame, cluster_col: str = "canon") -> DataFrame:
    return (token_rows(tokens).where(F.col(cluster_col).isNotNull())
            .groupBy(F.col(cluster_col).alias("cluster"), "lemma").agg(F.count("*").alias("n")))


def top3_cluster_names(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k most common lemmas of each cluster as its readable name.  The
    input is aggregated (one row per cluster and lemma)."""
    top = top_k_per_group(counts, ["cluster"], [F.desc("n"), F.col("lemma")], k, out="r")
    return top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "lemma"))).alias("__s")).select(
        "cluster", F.concat_ws(",", F.transform("__s", lambda s: s["lemma"])).alias("name"))


def label_pattern(pattern, labels: list[str]):
    """Tab-joined readable pattern; dictionary labels upper-cased."""
    lab = F.array(*[F.lit(x) for x in labels])
    return F.concat_ws("\t", F.transform(pattern, lambda c: F.when(F.array_contains(lab, c), F.upper(c)).otherwise(c)))
