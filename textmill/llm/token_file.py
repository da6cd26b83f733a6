"""Operator 2, token-id output: Arrow stream-file format with fixed-size-list
batches, so that equal-length sequences and masks are read without a copy.

A shard holds the tokens of a range of documents, back to back, cut into rows
of ``length`` ids; only its last row is padded, and the mask is 0 there.
Beside it lies an Arrow file with the documents' ids, local starts and
counts.  Ids take 16 bits where the vocabulary allows, else 32.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import file_system, shared_path, split_words, written

#: Ids of one row (one training sequence), rows of one record batch, and
#: characters of one shard (a work size), which grow beyond so many shards.
LENGTH, BATCH_ROWS, SHARD_CHARS, SHARDS = 2048, 256, 8_000_000, 65_536
#: Entries of a worker's table of distinct words; it is emptied when full.
TABLE_ENTRIES = 700_000
#: Words whose letters and marks are those of ASCII and Latin-1, where Unicode
#: normalisation changes nothing and lower case is one letter each.
PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"
#: The pattern by which such a word falls into runs of letters, single digits
#: and runs of other marks (fixed: that of the public tokenizers file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run that is encoded as it stands; apostrophes and < may begin more.
PART = r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+"

# Classes of bytes: space, letter, digit, mark, odd (anything whose word the
# library or the pattern must see as a whole).  0xC3 leads Latin-1's letters.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[33:127] = _MARK
_CLASS[[ord("'"), ord("<")]] = _ODD
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others, in order, for the letters from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def split_parts(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(offsets, parts) of whole texts, byte by byte: runs of letters in lower
    case, single digits and runs of marks, of words of nothing else; words
    with anything else stay whole and as they are."""
    texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(len(ends), np.int64), pa.array([], pa.string()).dictionary_encode()
    kind = _CLASS[raw]
    low = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1  # second bytes of Latin-1's letters, but for the two signs among them
    second = raw[lead]
    kind[lead] = np.where((second == 0x97) | (second == 0xB7), _ODD, _LETTER)
    if len(lead):
        low = low.copy()
        low[lead] += np.where((second < 0x9F) & (second != 0x97), 32, 0).astype(np.uint8)
    space = kind == _SPACE
    first = ~space
    first[1:] &= space[:-1]
    first[ends[:-1][ends[:-1] < len(raw)]] = True  # a text begins a word (or is a space)
    first &= ~space
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(len(ends), np.int64), pa.array([], pa.string()).dictionary_encode()
    cut = first | (kind == _DIGIT)
    cut[1:] |= (kind[1:] != kind[:-1]) & ~space[1:]
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        # Words with an odd byte: no cuts inside, and their own letters.
        whole = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        step = np.zeros(len(raw) + 1, np.int8)
        step[starts[whole]] += 1
        step[np.append(starts, len(raw))[whole + 1]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        cut &= ~inside | first
        low = np.where(inside, raw, low)
    kept = ~space
    at = np.cumsum(kept, dtype=np.int32)  # places without the spaces
    where = np.flatnonzero(cut)
    bounds = np.append(at[where] - 1, at[-1]).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(where), pa.py_buffer(bounds), pa.py_buffer(low[kept]))
    return np.searchsorted(where, ends), parts.dictionary_encode()


class WordEncoder:
    """Encodes whole texts with a tokenizers file, as
    ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    If the file drops white space and splits words by a pattern before byte
    level BPE, each distinct word is encoded once: by the library's BPE model
    from the file's own pattern for plain words, by the whole library for
    all others.  Any other file encodes text by text."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        parts = json.loads(spec)
        norm = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        pre = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = norm == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        if self.by_word:
            self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
            special = "|".join(regex.escape(x["content"]) for x in parts["added_tokens"])
            self.plain = regex.compile(f"(?!.*(?:{special})){PLAIN}" if special else PLAIN)
            self.letters = _byte_letters()
            self.by_part = self.pattern.pattern == SPLIT
            self.part = regex.compile(PART)
            self.words: dict[str, tuple] = {}
            self.parts: dict[str, tuple] = {}

    def _part(self, part: str) -> tuple:
        ids = self.parts.get(part)
        if ids is None:
            # Visible ASCII stands for itself in the byte-level alphabet.
            letters = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            ids = tuple([t.id for t in self.tokenizer.model.tokenize(letters)])
            if len(self.parts) >= TABLE_ENTRIES:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _word(self, word: str) -> tuple:
        if word.isascii() and word.isalpha():  # one run of letters
            ids = self._part(word.lower())
        elif self.plain.fullmatch(word):
            ids = tuple(itertools.chain.from_iterable(map(self._part, self.pattern.findall(word.lower()))))
        else:
            ids = tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= 64:
            if len(self.words) >= TABLE_ENTRIES:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _unit(self, unit: str) -> tuple:
        return self._part(unit) if self.part.fullmatch(unit) else self.words.get(unit) or self._word(unit)

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each document, all ids back to back), ``end`` appended to each."""
        kind = np.uint32 if self.wide else np.uint16
        tail = [] if end is None else [end]
        if not self.by_word:
            ids = [[*e.ids, *tail] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.fromiter(itertools.chain.from_iterable(ids), kind)
        offsets, words = split_parts(texts) if self.by_part else split_words(texts)
        known, new = (self.parts.get, self._unit) if self.by_part else (self.words.get, self._word)
        ids = [known(w) or new(w) for w in words.dictionary.to_pylist()]
        ids.append(tuple(tail))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), kind, int(sizes.sum()))
        # One more "word" ends each document.
        index = np.insert(np.asarray(words.indices, np.int32), offsets[1:], len(ids) - 1)
        ends = offsets + np.arange(len(offsets))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)).take(pa.array(index))
        return np.diff(np.asarray(lists.offsets, np.int64)[ends]), lists.flatten().to_numpy()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(key: str, spec) -> WordEncoder:
    """The worker's encoder of a broadcast tokenizers file, made once."""
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(spec.value)
    return _ENCODERS[key]


class ShardWriter:
    """Writes one shard: ids and mask as fixed-size lists, and its index."""

    def __init__(self, folder: str, name: str, length: int, wide: bool):
        self.fs, self.path = file_system(f"{folder}/{name}")
        self.length, self.kind = length, pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(f"{self.path}.arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.left: list[np.ndarray] = []
        self.n_left = 0
        self.docs: list[tuple[pa.Array, np.ndarray]] = []
        self.tokens = 0

    def _rows(self, ids: np.ndarray, real: int) -> None:
        for k in range(0, len(ids), self.length * BATCH_ROWS):
            part = ids[k : k + self.length * BATCH_ROWS]
            mask = np.arange(k, k + len(part)) < real
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)], schema=self.schema))

    def add(self, ids: pa.Array, counts: np.ndarray, tokens: np.ndarray) -> None:
        self.docs.append((ids, counts))
        self.tokens += len(tokens)
        self.left.append(tokens)
        self.n_left += len(tokens)
        per = self.length * BATCH_ROWS
        if self.n_left >= per:
            own = np.concatenate(self.left)
            whole = len(own) // per * per
            self._rows(own[:whole], whole)
            self.left, self.n_left = [own[whole:]], len(own) - whole

    def close(self) -> int:
        real = self.n_left
        self._rows(np.concatenate([*self.left, np.zeros(-real % self.length, self.kind.to_pandas_dtype())]), real)
        self.writer.close()
        self.out.close()
        counts = np.concatenate([c for _, c in self.docs]) if self.docs else np.zeros(0, np.int64)
        index = pa.table({"doc_id": pa.concat_arrays([i for i, _ in self.docs]) if self.docs else pa.array([], pa.int64()), "start": np.cumsum(counts) - counts, "n_tokens": counts})
        with self.fs.open_output_stream(f"{self.path}.index.arrow") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        return len(counts)


class ShardReader:
    """Random access to a shard: rows and documents are views of the mapped
    file where it is local."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        local = type(fs).__name__ == "LocalFileSystem"
        self.file = pa.ipc.open_file(pa.memory_map(f"{path}.arrow") if local else fs.open_input_file(f"{path}.arrow"))
        with fs.open_input_file(f"{path}.index.arrow") as f:
            self.index = pa.ipc.open_file(f).read_all()
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one row; the ids are a view, the mask is unpacked from its bits."""
        batch, at = self.file.get_batch(row // BATCH_ROWS), row % BATCH_ROWS
        cut = slice(at * self.length, (at + 1) * self.length)
        return batch.column("ids").flatten().to_numpy()[cut], batch.column("mask").flatten().to_numpy(zero_copy_only=False)[cut]

    def mask_bits(self, row: int) -> np.ndarray:
        """The mask of one row as a view of the file: a byte holds eight
        positions, the lowest bit first (``length`` is a multiple of eight)."""
        if self.length % 8:
            raise ValueError("rows of this length do not begin at whole bytes")
        bits, size = self.file.get_batch(row // BATCH_ROWS).column("mask").flatten(), self.length // 8
        at = bits.offset // 8 + row % BATCH_ROWS * size
        return np.frombuffer(bits.buffers()[1], np.uint8)[at : at + size]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, local start, ids) of each document, in order."""
        per, k, own = self.length * BATCH_ROWS, -1, None
        for doc, start, n in zip(*(self.index[c].to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            parts = []
            while n:
                if start // per != k:
                    k = start // per
                    own = self.file.get_batch(k).column("ids").flatten().to_numpy()
                parts.append(own[start % per : start % per + n])
                start, n = start + len(parts[-1]), n - len(parts[-1])
            yield doc, start - sum(map(len, parts)), parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


def write_tokens(docs: DataFrame, spec: str, end: int | None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                 folder: str | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encode whole texts (null: empty) with the tokenizers file ``spec`` (its
    JSON), append ``end`` to each, and write shards in ascending id order to
    ``folder`` (a new one in the shared folder by default).  Returns the
    manifest, one row a shard: ``part``, ``path``, ``n_docs``, ``n_tokens``
    and ``base`` (the ids of all shards before it).

    A null id sorts first; rows with one id go by their texts.  A task that
    is run again writes new files; only those in the manifest count."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    held = spark.sparkContext.broadcast(spec)  # a tokenizer's file: a few MB, whatever the documents
    key = xxhash.xxh3_128_hexdigest(spec)
    total = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    shards = max(1, min(SHARDS, -(-total // shard_chars)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(key, held), TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            writer = writer or ShardWriter(folder, f"part-{part:07d}-{uuid.uuid4().hex}", length, own.wide)
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                writer.add(piece.column(0), *own.encode(piece.column(1), end))
        if writer:
            n = writer.close()
            name = f"{folder}/{writer.path.rsplit('/', 1)[1]}"
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([name]), pa.array([n], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    manifest = written(rows.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard, at most SHARDS
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read shards back: ``doc_id``, ``start`` (ids of all documents before
    it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit, as bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                docs = ShardReader(path).documents()
                while rows := list(itertools.islice(docs, 1000)):
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([base + r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
                                           pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    manifest = written(manifest, "manifest")
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
