"""The training-data operators against brute force on small tables with nulls,
empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import pii, warc
from textmill.llm.common import split_words, written
from textmill.llm.components import connected_components
from textmill.llm.decontaminate import align, decontaminate, find_contamination
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.near_dup import DEFAULT_SPEC, near_duplicates
from textmill.llm.pieces import ChunkTable, encode_pieces
from textmill.llm.queries import tokenizer_file
from textmill.llm.quality_rules import filter_quality, habits, limits, quality_rules, sketches, with_counts
from textmill.llm.ranker import fit, score_quality
from textmill.llm.substring_dedup import dedup_substrings
from textmill.llm.token_file import ShardReader, WordEncoder, read_tokens, write_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, n_units string, row string, kept int"


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def rows(texts, first=0):
    return [(first + k, t, "en" if k % 3 else None, f"s{k % 2}", len(t or ""), k, "x", "y", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 6))) for _ in range(400)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [sentence(r.randrange(30, 120)) for _ in range(12)]
    out = [None, "", " \t\n", "one", "two words", *base, base[0], base[0], base[1]]
    for t in base[2:8]:  # near copies, with one word in fifteen changed
        out.append(" ".join(w if r.random() > 0.03 else "zz" for w in t.split(" ")))
    passage = sentence(40)
    out += [sentence(20) + "\n" + passage + " " + sentence(10), passage, sentence(5) + " " + passage + "\t" + passage]
    lines = [sentence(6) for _ in range(8)]
    out += ["\n".join(lines), "\n".join([sentence(5), *lines[2:6], "", lines[0]]), "\n".join(lines[1:3]), "\n\n".join(lines)]
    return [*out, sentence(20_000)]


def frame(spark, texts, first=0):
    return spark.createDataFrame(rows(texts, first), SCHEMA)


def removed(units, width):
    """Positions of each document's units that repeated windows cover."""
    seen, gone = set(), [set() for _ in units]
    for d, own in enumerate(units):
        for k in range(len(own) - width + 1):
            w = tuple(own[k : k + width])
            if w in seen:
                gone[d].update(range(k, k + width))
            seen.add(w)
    return gone


@pytest.mark.parametrize("batch", [300, 10_000_000])
def test_substring_dedup(spark, texts, batch):
    got = {r["doc_id"]: r for r in dedup_substrings(frame(spark, texts), batch_chars=batch, bucket_windows=500).collect()}
    units = [WORD.findall(t or "") for t in texts]
    for d, gone in enumerate(removed(units, 20)):
        kept = " ".join(w for k, w in enumerate(units[d]) if k not in gone)
        assert (got[d]["n_units"], got[d]["n_removed"], got[d]["kept_text"]) == (len(units[d]), len(gone), kept)


def test_line_dedup(spark, texts):
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, texts), batch_chars=500, bucket_windows=20, carry=["row", "_id"]).collect()}
    lines = [(t or "").split("\n") for t in texts]
    units = [[x for x in own if WORD.search(x)] for own in lines]
    for d, gone in enumerate(removed(units, 3)):
        left, k = [], 0
        for x in lines[d]:
            if WORD.search(x):
                if k not in gone:
                    left.append(x)
                k += 1
            else:
                left.append(x)
        assert (got[d]["n_removed"], got[d]["kept_text"], got[d]["row"]["_id"]) == (len(gone), "\n".join(left), d)


def test_windows_of_repeated_rows_null_ids_and_no_rows(spark):
    t = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in dedup_substrings(df).collect())
    assert got == [(False, 25), (False, 25), (True, 0), (True, 0)]
    assert dedup_substrings(df.limit(0)).collect() == []


def sets(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, width, percent):
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, texts), width, percent).collect()}
    own = sets(texts, width)
    of = list(range(len(own)))
    for a, b in itertools.combinations(range(len(own)), 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
            x, y = sorted((of[a], of[b]))
            of = [x if v == y else v for v in of]
    assert [(got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) for k in range(len(own))] == [(len(s), of[k], of[k] == k) for k, s in enumerate(own)]


def test_near_duplicates_of_a_borderline_family(spark):
    """Copies that link to some others only: every link must be found."""
    r = random.Random(3)
    base = [f"w{r.randrange(10_000)}" for _ in range(150)]
    family = [" ".join(f"v{r.randrange(40)}" if r.random() < p else w for w in base) for p in [0.015] * 60 + [0.035] * 60]
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(frame(spark, family), 3, 85).collect()}
    own, of = sets(family, 3), list(range(len(family)))
    for a, b in itertools.combinations(range(len(own)), 2):
        if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b]):
            x, y = sorted((of[a], of[b]))
            of = [x if v == y else v for v in of]
    assert [got[k] for k in range(len(of))] == of
    assert 1 < len(set(of)) < len(of)


def test_near_duplicates_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(-1, 4, False), (4, 4, True), (4, 4, True), (9, 9, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, 3000, dtype=np.uint64), r.integers(0, 1 << 63, 500, dtype=np.uint64)
    s = DEFAULT_SPEC
    assert (s.merge(s.sketch(a), s.sketch(b)) == s.sketch(np.concatenate([a, b]))).all()
    x, y = s.sketch(np.concatenate([a, b])), s.sketch(a)
    grid = np.arange(0, 1, 0.01)
    best = grid[s.log_likelihood((x > y).sum(), (x == y).sum(), (x < y).sum(), 3500, 3000, grid).argmax()]
    assert abs(best - 3000 / 3500) < 0.15


def test_connected_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_pii_base_spans_and_added_ones(spark):
    r = random.Random(1)
    parts = ["1", "22", "255", "256", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "4111 1111 1111 1111", "192.168.0.1", "x@y.z", "+1 555 123 4567", "٣", "000"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 16)))
        assert [(k, a, b) for a, b, k, _ in pii.scored(t) if k in pii.BASE_KINDS] == base_spans(t)
    assert [(k, s) for _, _, k, s in pii.scored("bank account GB82 WEST 1234 5698 7654 32.") if k == "iban"] == [("iban", 1.0)]
    assert not [k for _, _, k, _ in pii.scored("GB82 WEST 1234 5698 7654 33") if k == "iban"]
    for text, span in (("my account ES91 2100 0418 4502 0005 1332 BIC XYZ", (11, 40)), ("konto de89370400440532013000, bic", (6, 28)), ("ES91 2100 0418 4502 0005 1332 Bank", (0, 29)), ("GB82 west 1234 5698 7654 32 und", (0, 27))):
        assert [(a, b) for a, b, k, _ in pii.scored(text) if k == "iban"] == [span], text
    assert [s for _, _, _, s in pii.scored("Kreditkarte 4111 1111 1111 1111")] == [1.0] and [s for _, _, _, s in pii.scored("4111 1111 1111 1111")] == [0.8]
    assert [k for _, _, k, _ in pii.scored("her ssn: 123-45-6789") if k == "ssn"] and not [k for _, _, k, _ in pii.scored("part 123-45-6789") if k == "ssn"]
    long = "1" * 200_000 + "a" * 200_000
    df = frame(spark, [None, "", "é x@y.z", long, "x@y.z"])
    assert [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(df).orderBy("doc_id").collect()] == [[], [], [("email", 2, 7)], [], [("email", 0, 5)]]
    assert [r["text"] for r in pii.masked(df).orderBy("doc_id").collect()] == [None, "", "é <EMAIL>", long, "<EMAIL>"]


def odd_texts(n):
    r = random.Random(5)
    letters = [*"ab cZ'st re.,;!?  \t\n\x0b\x85\xa0éÉßÀ̈́ŞİσςΣ中文½²ªµ▁​ 😀0", "<|endoftext|>", "<|startoftext|>", "é", "'S", "don't", "  ", "▁▁", "\x00", "\x1c"]
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 25))) for _ in range(n)]


def test_token_file(spark, texts):
    from tokenizers import Tokenizer

    spec = tokenizer_file("word_bpe_49k.json").decode()
    library = Tokenizer.from_str(spec)
    own = WordEncoder(spec)
    for t in odd_texts(1500):
        _, ids = own.encode(pa.array([t]), 1)
        assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]
    manifest = write_tokens(frame(spark, texts), spec, 1, length=64, shard_chars=20_000)
    manifest = written(manifest, "test")
    got = {r["doc_id"]: r for r in read_tokens(spark, manifest).collect()}
    start = 0
    for d, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], zlib.crc32(got[d]["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = ShardReader(manifest.orderBy("part").first()["path"])
    ids, mask = first.sequence(0)
    assert len(ids) == len(mask) == 64 and ids.base is not None
    for row in (0, sum(first.file.get_batch(k).num_rows for k in range(first.file.num_record_batches)) - 1):
        bits = first.mask_bits(row)
        assert bits.base is not None and (np.unpackbits(bits, bitorder="little").astype(bool) == first.sequence(row)[1]).all()
    assert write_tokens(frame(spark, texts).limit(0), spec, 1).collect() == []


def test_pieces(spark, texts):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), ChunkTable(model)
    assert own.by_chunk
    for t in odd_texts(1500):
        assert own.encode([t])[0] == library.encode(t) and own.decode(own.encode([t]))[0] == library.decode(library.encode(t))
    got = {r["doc_id"]: r for r in encode_pieces(frame(spark, texts), model, keep=["row"]).collect()}
    assert all(got[d]["ids"] == library.encode(t or "") and got[d]["decoded"] == library.decode(library.encode(t or "")) for d, t in enumerate(texts))
    assert encode_pieces(frame(spark, texts).limit(0), model).collect() == []


def test_decontamination(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    sentence = lambda n: [r.choice(words) for _ in range(n)]
    items = [sentence(40) for _ in range(10)]
    docs = [" ".join(sentence(200)) for _ in range(60)]
    hit = {}
    for k in range(10):
        copy = list(items[k]) if k % 2 else [w if r.random() > 0.2 else "edited" for w in items[k]]
        docs.append(" ".join(sentence(50) + [w.title() + "," for w in copy] + sentence(50)))
        hit[len(docs) - 1] = k
    docs += [None, "", " ".join(sentence(20_000))]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    df = frame(spark, docs)
    found = find_contamination(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == set(hit.items())
    assert all(x["score"] == 1.0 and (x["start"], x["end"]) == (50, 90) for x in found if x["item_id"] % 2)
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns and {x["doc_id"] for x in clean.collect()} == set(range(len(docs))) - set(hit)
    assert find_contamination(df, bench.limit(0)).collect() == [] and find_contamination(df.limit(0), bench).collect() == []


def test_decontamination_of_short_items(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    sentence = lambda n: [r.choice(words) for _ in range(n)]
    items = [sentence(n) for n in (3, 4, 5, 6, 7)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(8, "the of"), (9, "the"), (10, "")], "item_id long, text string")
    docs, hit = [" ".join(sentence(100) + ["the", "of"] * 20) for _ in range(40)], set()
    for k, item in enumerate(items):
        docs.append(" ".join(sentence(50) + [w.title() + "?" for w in item] + sentence(50)))
        hit.add((len(docs) - 1, k, 1.0, 50, 50 + len(item)))
        docs.append(" ".join(sentence(50) + item[:-1] + ["edited"] + sentence(50)))  # not the whole item
    docs += [" ".join(items[4][3:]), " ".join(items[4][:3])]  # an item across two documents
    df = frame(spark, docs)
    assert {tuple(x) for x in find_contamination(df, bench).collect()} == hit
    assert {x["doc_id"] for x in decontaminate(df, bench).collect()} == set(range(len(docs))) - {h[0] for h in hit}


def test_decontamination_of_excerpts(spark):
    r = random.Random(13)
    words = [f"w{k}" for k in range(3000)]
    sentence = lambda n: [r.choice(words) for _ in range(n)]
    item = sentence(300)
    docs = [" ".join(sentence(50) + item[100 : 100 + n] + sentence(50)) for n in (10, 25, 100)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {x["doc_id"]: (x["start"], x["end"]) for x in find_contamination(frame(spark, docs), bench).collect()}
    assert found == {1: (50, 75), 2: (50, 150)}


def test_decontamination_seeds(spark):
    r = random.Random(14)
    words = [f"w{k}" for k in range(3000)]
    sentence = lambda n: [r.choice(words) for _ in range(n)]
    item, common = sentence(40), [r.choice("abcdefghijklmno") for _ in range(30)]
    docs = [" ".join(r.choice("abcdefghijklmno") for _ in range(8000)) for _ in range(100)]  # no 5 of these words are rare
    docs += [" ".join(sentence(50) + ["edited" if k % 3 == 2 else w for k, w in enumerate(item)] + sentence(50))]
    docs += [" ".join(["x"] * 50 + common + ["x"] * 50)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(common))], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in find_contamination(frame(spark, docs), bench).collect()}
    assert found == {(100, 1), (101, 2)}


def test_alignment_against_the_whole_table():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert align(np.array(a), np.array(b))[0] == h.max()


def test_quality_rules(spark, texts):
    junk = ["x*** y### " * 20, "\n".join(["same line here"] * 9), "a a a a a a b b b b b b " * 2]
    df = frame(spark, [*texts, *junk])
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    for d, t in enumerate([*texts, *junk]):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_symbols"], got[d]["n_dup_lines"], got[d]["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert got[d]["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert not got[len(texts)]["kept"] and not any(r["kept"] and r["base_failed"] for r in got.values())
    kept = filter_quality(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}
    assert quality_rules(df.limit(0)).collect() == [] and filter_quality(df.limit(0)).collect() == []


def test_quantile_sketches_merge(spark, texts):
    counted = with_counts(frame(spark, texts * 3)).select(F.lit("en").alias("lang"), F.col("row.source").alias("source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_same_next", "n_lines", "n_repeat_words")
    parts = sketches(counted, ["lang", "source"])
    a = {r["rule"]: tuple(r)[2:] for r in habits(parts, ["lang"]).collect()}
    b = {r["rule"]: tuple(r)[2:] for r in habits(sketches(counted, ["lang"]), ["lang"]).collect()}
    assert a == b
    exact = sorted(x for r in counted.collect() if (x := r["word_chars"] / max(r["n_words"], 1)))
    n, some, z, _, q75 = a["word_length"]
    assert (n, some, z) == (3 * len(texts), len(exact), len(exact) / n)
    assert np.exp(q75) == pytest.approx(exact[-(-3 * len(exact) // 4) - 1], rel=0.011)


def test_quality_limits_follow_the_habits_of_a_source(spark):
    """One text is kept where all write like that and dropped where none do."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    plain = lambda: " ".join(word(r.choice([4, 5, 6])) for _ in range(60))
    odd = {
        "symbols": lambda: " ".join(word(5) + "#*" * (k % 3 == 0) for k in range(60)),
        "dup_lines": lambda: "\n".join(f"yes\n{word(5)} {word(5)} {word(6)}" for _ in range(30)),
        "same_next": lambda: " ".join(f"{w} {w}" if k % 3 == 0 else w for k, w in enumerate(word(5) for _ in range(60))),
        "word_length": lambda: " ".join(word(r.choice([8, 9, 10])) for _ in range(60)),
    }
    rows = [(plain(), "en", "plain") for _ in range(300)] + [(make(), "en", kind) for kind, make in odd.items() for _ in range(300)]
    probes = [(make(), "en", source) for kind, make in odd.items() for source in ("plain", kind)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows + probes)], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality_rules(df).collect()}
    kept = [got[len(rows) + k]["kept"] for k in range(len(probes))]
    assert not any(got[len(rows) + k]["base_failed"] for k in range(len(probes)))
    assert kept == [False, True] * len(odd)
    assert sum(got[k]["kept"] for k in range(300)) >= 299


def test_quality_limits_of_a_small_group_lean_on_its_language(spark):
    counted = with_counts(frame(spark, ["a b# c"] * 3 + ["a b c"])).select(F.lit("en").alias("lang"), F.col("row.source").alias("source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_same_next", "n_lines", "n_repeat_words")
    own = {x["source"]: x for x in limits(counted).collect()}
    assert len({x["symbols_high"] for x in own.values()}) == 2 and all(x["symbols_high"] is not None for x in own.values())


def test_ranker(spark):
    r = np.random.default_rng(0)
    x, good = r.normal(size=(500, 3)), r.random(500) < 0.8
    x[:, 1] += 5 * good
    w, cut, _ = fit(x, good)
    assert ((x @ w >= cut) == good).mean() > 0.98
    docs = frame(spark, [None, "", *[("plain words here and there " * 9) + str(k) if k % 5 else "bad*** b### c$$$ " * 9 + str(k) for k in range(200)]])
    labels = spark.createDataFrame([(k + 2, int(k % 5 > 0)) for k in range(200)] + [(3, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in score_quality(docs, labels).collect()}
    assert len(got) == 202 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert all(x["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, x in got.items())
    held = [(d, x) for d, x in got.items() if x["held_out"] and d >= 2]
    assert sum(x["predicted"] == int((d - 2) % 5 > 0) for d, x in held) >= 0.98 * len(held)
    assert {x["score"] for x in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_warc_id_of_two_repeated_payloads(spark):
    a, b = "a" * 1500, "b" * 1600
    pages = [(1, "u", a), (1, "u", b), (5, "u", a), (6, "u", b)]
    folder, _ = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = Counter(tuple(r)[:2] + tuple(r)[3:] for r in warc.archived_pages(spark, folder).collect())
    assert got == Counter([(1, 1500, "revisit", 5), (1, 1600, "revisit", 6), (5, 1500, "response", None), (6, 1600, "response", None)])


def test_warc(spark):
    big = "é" * 800
    pages = [(k, f"http://x/{k}\r\nX: y", t) for k, t in enumerate([None, "", "small", "small", big, big, big, "é" * 300_000])] + [(5, "http://x/5", big), (None, None, big)]
    folder, files = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = warc.archived_pages(spark, folder).collect()
    assert len(got) == len(pages)
    want = Counter()
    for k, _, t in pages:
        p = (t or "").encode()
        again = k in (4, 5) and len(p) >= 1000
        want[(k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 6 if again else None)] += 1
    assert Counter(tuple(r) for r in got) == want
    all_ = warc.read_warc(spark, folder)
    pushed = all_.where("warc_type = 'revisit'")
    assert pushed.count() == 3 and "warc_type" not in pushed._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("warc_type#", "")
    assert all_.where("warc_type = 'warcinfo'").count() == files.count()
    assert warc.read_warc(spark, folder, payload=False).where("target_uri like 'http://x/7%'").first()["payload"] is None
    empty, _ = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.archived_pages(spark, empty).collect() == []


def test_warc_reads_plain_gzip_members_and_plain_files(tmp_path, spark):
    import gzip

    records = [warc.page_record(k, "http://x", b"payload %d" % k, None, "2024-01-01T00:00:00Z") for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = warc.read_warc(spark, f"file://{tmp_path}")
    assert sorted(r["payload"] for r in got.collect()) == sorted([b"payload %d" % k for k in range(5)] * 2)
    assert got.where(f"record_id = '{warc.ID_PREFIX}3'").count() == 2


def test_words_are_split_at_ascii_white_space_only():
    texts = [None, "", "  a\x1cb\xa0c \t\x0b\x0c\r\n d  ", "x"]
    offsets, words = split_words(pa.array(texts))
    own = words.to_pylist()
    assert [own[a:b] for a, b in itertools.pairwise(offsets)] == [WORD.findall(t or "") for t in texts]


def test_pipeline_stages(spark, tmp_path, texts):
    item = " ".join(f"q{k}" for k in range(40))
    docs = frame(spark, [*texts, "lead in " + item + " and out of it again"])
    docs = docs.select(*SCHEMA_NAMES, F.lit(1).alias("a-b"), F.lit(2).alias("a b"), F.lit(3).alias("rows"), F.lit(4).alias("id"), F.lit(5).alias("text_"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf, now = str(tmp_path), docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns
        now = written(after, "stage")
    ids = {r["doc_id"] for r in now.collect()}
    assert 5 in ids and not ids & {0, 1, 2, 3, 4, 17, 18, 19, len(texts)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    left = {r["doc_id"]: r["text"] for r in now.collect()}
    assert {d: r["decoded"] for d, r in out.items()} == left
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values())


def test_pipeline_of_odd_tables(spark, tmp_path, texts):
    """Null and repeated ids, no ``n_chars``, and no rows at all."""
    good = [" ".join(random.Random(k).choices(texts[5].split(" "), k=60)) for k in range(6)]
    docs = [(1, good[0]), (1, good[0]), (1, good[1]), (None, good[2]), (None, good[3]), (2, None), (3, good[4]), (4, good[4])]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(1, "nothing like it here at all, not one of these words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted((r["doc_id"] or 0, r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [x for x in out if x[0] != 1] == sorted([(0, good[2]), (0, good[3]), (3, good[4])]) and [x for x in out if x[0] == 1] in ([(1, good[0])], [(1, good[1])])
    none = tmp_path / "none"
    none.mkdir()
    df.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([(1, "item")], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(none)).collect() == []
