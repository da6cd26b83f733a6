"""Operator 10, MinHash near-dedup with SetSketch registers.

A document's set is its distinct word shingles.  ``SketchSpec.registers``
registers hold exponentially spaced, truncated minima; equal registers are
about as likely as the sets' Jaccard similarity, so bands of registers find
candidates.  The comparison of two sketches gives the similarity's likelihood,
which rejects hopeless candidates; the rest are verified on the full sets.

Equal sets are one node from the start.  Within a bucket (equal band) pairs
are never expanded: a bucket's members are compared with one of them, and only
buckets that this leaves in different components go on.  By the triangle
inequality of the Jaccard distance, a member far from the first cannot link to
one close to it, so the two go on apart; shingles that only one of the
remaining members has bound its similarity to all others; and what is still
open is compared in blocks of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import BASE_1, hash128, rolling_hashes, split_words, starts_in_document, written
from textmill.llm.components import connected_components


@dataclass(frozen=True)
class SketchSpec:
    """Registers are ``bands`` x ``rows``; ``base``, ``rate`` and ``limit`` are
    SetSketch's b, a and q.  A pair of similarity J is missed with probability
    about (1 - J**rows)**bands: 7e-9 at 0.85."""

    bands: int = 32
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    limit: int = (1 << 16) - 2
    seed: int = 10

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @cached_property
    def salts(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return (r.integers(0, 1 << 32, (self.registers, 1), dtype=np.uint32),
                r.integers(0, 1 << 31, (self.registers, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1))

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Registers, unsigned 16-bit, of a set of 64-bit hashes."""
        xor, odd = self.salts
        low = np.full(self.registers, 0xFFFFFFFF, dtype=np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(x), 4096):
            part = (x[k : k + 4096] ^ xor) * odd
            np.minimum(low, part.min(axis=1), out=low)
        # The smallest of n uniform hashes, as the smallest of exponentials of the given rate.
        waiting = -np.log1p(-(low + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1 - np.log(waiting) / np.log(self.base)), 0, self.limit + 1).astype(np.uint16)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sketch of the union of the sets of two sketches."""
        return np.maximum(a, b)

    def band_keys(self, registers: np.ndarray) -> list[int]:
        return [xxhash.xxh3_64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(registers.reshape(self.bands, self.rows))]

    def log_likelihood(self, larger, equal, smaller, size_a, size_b, similarity) -> np.ndarray:
        """Of a similarity, given how many of a's registers are larger than,
        equal to and smaller than b's, and the sizes of the two sets."""
        u = size_a / (size_a + size_b)
        v = 1 - u
        j = np.minimum(similarity, np.minimum(u / v, v / u))
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)
        more, less = p(u - v * j), p(v - u * j)
        floor = 1e-12
        return larger * np.log(np.maximum(more, floor)) + smaller * np.log(np.maximum(less, floor)) + equal * np.log(np.maximum(1 - more - less, floor))


DEFAULT_SPEC = SketchSpec()
#: A candidate is dropped before verification only if a similarity as high as
#: ``FAR`` is exp(20) times less likely than the best one.
LOG_ODDS = 20.0


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: ``width`` words,
    A-Z lower-cased; the whole sequence where there are fewer words."""
    offsets, words = split_words(pc.ascii_lower(texts))
    own = words.dictionary.to_pylist()
    units = hash128(own)[:, 0][np.asarray(words.indices)] if own else np.zeros(0, np.uint64)
    starts = starts_in_document(offsets, width)
    hashes = rolling_hashes(units, width, BASE_1)[starts] if len(starts) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(starts, offsets)
    for (a, b), (x, y) in zip(itertools.pairwise(offsets.tolist()), itertools.pairwise(cuts.tolist())):
        if 0 < b - a < width:
            yield np.array([xxhash.xxh3_64_intdigest(units[a:b].tobytes(), b - a)], dtype=np.uint64)
        else:
            own = hashes[x:y]
            own.sort()
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


_SKETCHED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("registers", pa.binary())])
_SETS = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _sketcher(width: int, spec: SketchSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, node, keys, registers = [], [], [], []
            for hashes in shingle_sets(batch.column("text"), width):
                n.append(len(hashes))
                own = spec.sketch(hashes) if len(hashes) else None
                node.append(_node(hashes) if len(hashes) else None)
                keys.append(None if own is None else spec.band_keys(own))
                registers.append(None if own is None else own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id")] + [pa.array(x, f.type) for x, f in zip((n, node, keys, registers), list(_SKETCHED)[1:])], schema=_SKETCHED)

    return run


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [(w, h.tobytes()) for w, h in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), width)) if len(h) and _node(h) == w]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SETS)], schema=_SETS)

    return run


def _estimator(spec: SketchSpec, far: float):
    grid = np.arange(0, 1.0001, 0.02)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 4096):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in ("ra", "rb"))  # registers
            counts = [x.sum(axis=1)[:, None] for x in (a > b, a == b, a < b)]
            sizes = [np.asarray(batch.column(k), dtype=float)[:, None] for k in ("na", "nb")]
            best = spec.log_likelihood(*counts, *sizes, grid[None, :])
            least = spec.log_likelihood(*counts, *sizes, np.full((1, 1), far))[:, 0]
            hopeless = (best.max(axis=1) - least > LOG_ODDS) & (grid[best.argmax(axis=1)] < far)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(~hopeless)], names=["a", "b", "hope"])

    return run


_JUDGED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("either", pa.int64())])


def _verifier():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "ha", "hb"))):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")  # merges two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                rows.append((a, b, common, len(both) - common))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_JUDGED)], schema=_JUDGED)

    return run


def _judge(pairs: DataFrame, nodes: DataFrame, spec: SketchSpec, percent: int, far: float) -> DataFrame:
    """(a, b, side) of pairs of nodes, written: side 2 is a link, 1 is nearer
    than ``far``, 0 is not."""
    of = lambda side, *cols: nodes.select(F.col("node").alias(side), *[F.col(c).alias(c[0] + side) for c in cols])
    x = pairs.join(of("a", "n", "registers"), "a").join(of("b", "n", "registers"), "b")
    guessed = written(x.mapInArrow(_estimator(spec, far), "a long, b long, hope boolean"), "guessed")
    y = guessed.where("hope").select("a", "b").join(of("a", "hashes"), "a").join(of("b", "hashes"), "b")
    sure = y.mapInArrow(_verifier(), "a long, b long, common long, either long")
    side = F.when(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("either"), 2).when(F.col("common") >= F.lit(far) * F.col("either"), 1).otherwise(0)
    return written(sure.select("a", "b", side.alias("side")).union(guessed.where("not hope").select("a", "b", F.lit(0).alias("side"))), "judged")


def _hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 100):
        sets = [np.frombuffer(x, np.int64) for x in batch.column("hashes").to_pylist()]
        if sets:
            nodes = np.repeat(np.asarray(batch.column("node")), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets))], names=["node", "hash"])


def _with_private(open_: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The open members with ``n`` and ``private``: how many shingles they
    have, and how many that no other open member has.  Members that can't
    link to any other for their private ones are left out."""
    own = nodes.select("node", "n", "hashes").join(open_.select("node").distinct(), "node", "left_semi")
    counted = own.select("node", "hashes").mapInArrow(_hashes_of, "node long, hash long").groupBy("hash").agg(F.min("node").alias("node"), F.count("*").alias("c"))
    private = counted.where("c = 1").groupBy("node").agg(F.count("*").alias("private"))
    sizes = own.select("node", "n").join(private, "node", "left").select("node", "n", F.coalesce("private", F.lit(0)).alias("private"))
    able = sizes.where(F.lit(100) * (F.col("n") - F.col("private")) >= F.lit(percent) * F.col("n"))
    return open_.join(able, "node")


def _as_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()


def _unsettled(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, written."""
    named = open_.join(labels, "node", "left").select(open_["*"], F.coalesce("component", open_["node"]).alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    return written(named.join(mixed, "bucket", "left_semi"), "members")


#: Rows of a block when the rest is compared.
QUERY_ROWS, INDEX_ROWS = 256, 1024


def _comparer(spec: SketchSpec, percent: int):
    def compare(table: pa.Table) -> pa.Table:
        col = {k: np.asarray(table[k]) for k in ("role", "node", "component", "n", "private")}
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(table.num_rows, spec.bands, spec.rows)
        sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        queries, index = np.flatnonzero(col["role"] == 0), np.flatnonzero(col["role"] == 1)
        of = {k: v[index] for k, v in col.items()}
        band, links = registers[index], []
        for q in queries.tolist():
            n, private = col["n"][q], col["private"][q]
            common = np.minimum(n - private, of["n"] - of["private"])  # private shingles are in one of the two only
            either = np.maximum(n + of["private"], of["n"] + private)
            near = (of["component"] != col["component"][q]) & (100 * common >= percent * either)
            near[near] = (band[near] == registers[q]).all(axis=2).any(axis=1)
            for i in np.flatnonzero(near).tolist():
                both = np.concatenate([sets[q], sets[index[i]]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    links.append(sorted((int(col["node"][q]), int(of["node"][i]))))
        return pa.table({k: pa.array([x[j] for x in links], pa.int64()) for j, k in enumerate("ab")})

    return compare


def _rest(open_: DataFrame, nodes: DataFrame, spec: SketchSpec, percent: int) -> DataFrame:
    """(a, b) links among members that share a band and are still in different
    components.  Members of overlapping buckets form a cluster; those outside
    its largest component are the queries, compared with all of the cluster
    in blocks of bounded size, so that only links come out."""
    first = open_.groupBy("bucket").agg(F.min("node").alias("first"))
    cluster = connected_components(open_.join(first, "bucket").select("first", "node").distinct(), "first", "node").select("node", F.col("component").alias("cluster"))
    member = open_.groupBy("node", "component", "n", "private").agg(F.lit(1).alias("one")).drop("one").join(cluster, "node")
    sized = member.groupBy("cluster", "component").agg(F.count("*").alias("c"))
    sized = sized.groupBy("cluster").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    blocks = sized.select("cluster", "main", F.ceil((F.col("all") - F.col("most")) / QUERY_ROWS).alias("qs"), F.ceil(F.col("all") / INDEX_ROWS).alias("is"))
    row = member.join(blocks, "cluster").join(nodes.select("node", "registers", "hashes"), "node")
    kept = ["cluster", "node", "component", "n", "private", "registers", "hashes"]
    q = row.where("component <> main").withColumn("q", F.pmod(F.xxhash64("node"), "qs")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("is") - 1))).withColumn("role", F.lit(0))
    i = row.withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), "is")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1))).withColumn("role", F.lit(1))
    both = q.select("q", "i", "role", *kept).union(i.select("q", "i", "role", *kept))
    return both.groupBy("cluster", "q", "i").applyInArrow(_comparer(spec, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", spec: SketchSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``
    (the smallest id reachable over links, own id included) and ``kept``
    (whether that is the own id).  Two documents are linked if 100 x
    |intersection| >= ``percent`` x |union| of their shingle sets.

    Empty and null texts have no shingles and no links.  Rows with one id are
    documents of their own.  Null ids are reached over but never name a
    component that has an id.  Equal sets are one node, known by 64 bits of
    hash."""
    distance = 1 - percent / 100
    far = 1 - 2 * distance
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(plain.mapInArrow(_sketcher(width, spec), "id long, n long, node long, keys array<long>, registers binary"), "sketches")
    member = sketches.where("node is not null").select("node", F.explode("keys").alias("bucket"))
    reps = member.groupBy("bucket").agg(F.min("node").alias("rep"), F.max("node").alias("other")).where("rep < other").select("bucket", "rep")
    open_ = written(member.join(reps, "bucket").where("node <> rep").groupBy("bucket", "rep", "node").agg(F.lit(1).alias("one")).drop("one"), "members")
    # Registers and full sets of all nodes that share a bucket; one document's text stands for a node.
    shared = open_.select("node").union(open_.select(F.col("rep").alias("node"))).distinct()
    one = sketches.join(shared, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.min("registers").alias("registers"), F.min("id").alias("id"))
    one = written(one, "nodes")
    texts = plain.join(one.select("node", F.col("id").alias("of")), F.col("id").eqNullSafe(F.col("of"))).select("node", "text")
    sets = texts.mapInArrow(_set_maker(width), "node long, hashes binary").dropDuplicates(["node"])
    nodes = written(one.drop("id").join(sets, "node"), "nodes")
    judged = _judge(_as_pairs(open_, "rep", "node"), nodes, spec, percent, far)
    labels = connected_components(judged.where("side = 2"))
    # Close and far members go on apart; those in between go on with both.
    sided = open_.join(judged, (F.least("rep", "node") == judged["a"]) & (F.greatest("rep", "node") == judged["b"])).select("bucket", "node", "side")
    split = sided.select("node", "side", F.explode(F.when(F.col("side") == 2, F.array(F.lit(0))).when(F.col("side") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("half"), "bucket")
    open_ = split.select(F.xxhash64("bucket", "half").alias("bucket"), "node")
    open_ = _unsettled(open_, labels)
    if not open_.isEmpty():
        open_ = _with_private(open_.drop("component"), nodes, percent)
        open_ = _unsettled(open_, labels)
    if not open_.isEmpty():
        more = written(_rest(open_, nodes, spec, percent), "more")
        if not more.isEmpty():
            labels = connected_components(judged.where("side = 2").select("a", "b").union(more))
    ids = sketches.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    named = ids.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "component").select("node", "component_id")
    whole = sketches.select("id", "n", "node").join(of, "node", "left")
    component = F.coalesce("component_id", "id")
    return whole.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
