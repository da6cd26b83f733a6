"""Helpers shared by the operators of this subpackage: words, hashes, ids of
documents in bounded batches, and files in the cluster's shared folder."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import ensure_checkpoint_dir

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path (not yet made) in the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base:
        base = "file://" + os.path.abspath(base.removeprefix("file:"))
    return f"{base}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back (cuts lineage
    and survives the loss of an executor)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI: file, hdfs, s3 and so on."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def arrow_type(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def named(column: str) -> Column:
    """The column of that very name, whatever its letters."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_of(columns: list[str]) -> Column:
    """These columns in one struct, whatever their names."""
    return F.struct(*[named(c) for c in columns])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(offsets, words) of whole texts: document i has words
    offsets[i]:offsets[i + 1].  Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    ends = ends - ends[0]
    real = np.asarray(pc.binary_length(flat)) > 0  # splitting leaves empty strings at the borders
    before = np.concatenate([[0], np.cumsum(real)])
    words = flat.filter(pa.array(real)) if not real.all() else flat
    return before[ends], words.dictionary_encode()


def hash128(strings: list) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of xxh3_128 of each string."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), dtype=np.uint64).reshape(-1, 2)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i < n (base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(m, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


#: Odd multipliers of the rolling hashes, modulo 2**64.
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def rolling_hashes(units: np.ndarray, width: int, base: int = BASE_1) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each ``width`` consecutive units
    (unsigned 64-bit hashes of words or lines).  By prefix sums, so a window
    costs the same whatever its width."""
    if len(units) < width:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(base, len(units))
    sums = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * power, out=sums[1:])
    return (sums[width:] - sums[:-width]) * inverse[: len(units) - width + 1]


def starts_in_document(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` units fits into its document."""
    n = int(offsets[-1])
    last = np.repeat(offsets[1:], np.diff(offsets)) - width
    return np.flatnonzero(np.arange(n) <= last)


def id_batches(docs: DataFrame, id_col: str, text_col: str, chars: int) -> tuple[Column, int, int]:
    """(batch number, number of batches, total characters): consecutive id
    ranges of about ``chars`` characters, so that all ids of a batch are
    smaller than those of the next.  Rows with one id share a batch; a null
    id counts as the smallest.  The driver holds 8 bytes for each batch."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    total, = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    # Larger batches beyond 4096 of them, up to eight times the size.
    chars = int(min(8 * chars, max(chars, total / 4096)))
    n = max(1, -(-int(total) // chars))
    if n == 1:
        return F.lit(0), 1, int(total)
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    lits = lambda xs: F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in xs) + ")")
    coarse = cuts[63::64]
    block = F.size(F.filter(lits(coarse), lambda x: x < key)) if coarse else F.lit(0)
    within = F.size(F.filter(F.slice(lits(cuts), block * 64 + 1, 64), lambda x: x < key))
    return (block * 64 + within).cast("int"), len(cuts) + 1, int(total)
