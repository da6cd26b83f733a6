"""The registered queries of this subpackage: each applies one operator, with
its production parameters, to a whole table.  ``ORACLES`` has DuckDB SQL where
SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.conversations import digests, repair
from textmill.llm.decontaminate import find_contamination
from textmill.llm.importance import POLYNOMIAL, resample
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.near_dup import near_duplicates
from textmill.llm.pieces import encode_pieces
from textmill.llm.pii import BASE_KINDS, find_pii, joined
from textmill.llm.quality_rules import quality_rules
from textmill.llm.ranker import score_quality
from textmill.llm.substring_dedup import dedup_substrings
from textmill.llm.token_file import read_tokens, write_tokens
from textmill.llm.url_templates import ALPHA, DEPTH, LITERALS, NEUTRAL, REJECT_AT, SUPPORT, WEIGHT, UrlRule, filter_urls
from textmill.llm.warc import archived_pages, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer's file, read on the driver and sent to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(number, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                       F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 1000).cast("int").cast("string")), ",").alias("score_permille"))


@query("op2_token_file")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode(), end=1)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_pieces")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS win FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
s AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1 AS again FROM w WHERE win IS NOT NULL),
c AS (SELECT r.doc_id, r.pos, coalesce(max(CAST(s.again AS INT)) OVER (PARTITION BY r.doc_id ORDER BY r.k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS gone FROM r LEFT JOIN s ON r.doc_id = s.doc_id AND r.k = s.k),
a AS (SELECT l.doc_id, l.pos, l.line, c.gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos)
SELECT doc_id, count(gone) AS n_lines, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE coalesce(gone, 0) = 0), '')) AS kept_sha256
FROM a GROUP BY doc_id
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""


@query("op8_warc", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = write_warc(table(spark, sf_dir, "pages"))
    return archived_pages(spark, folder)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS k FROM d WHERE len(words) >= 20),
s AS (SELECT w.doc_id, w.k, row_number() OVER (PARTITION BY array_to_string(d.words[w.k:w.k + 19], ' ') ORDER BY w.doc_id, w.k) > 1 AS again FROM w JOIN d ON w.doc_id = d.doc_id),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
c AS (SELECT u.doc_id, u.k, u.word, coalesce(max(CAST(s.again AS INT)) OVER (PARTITION BY u.doc_id ORDER BY u.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM u LEFT JOIN s ON u.doc_id = s.doc_id AND u.k = s.k),
g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


@query("op9_substring_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT d.doc_id, count(g.s) AS n FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n p ON c.a = p.doc_id JOIN n q ON c.b = q.doc_id WHERE 100 * c.both >= 85 * (p.n + q.n - c.both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON n.doc_id = m.doc_id
"""


@query("op10_near_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def crc32_sql(text: str) -> str:
    """DuckDB expression: crc32 of a string's bytes, by the byte-wise table."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (POLYNOMIAL if value & 1 else 0)
        steps.append(value)
    pairs = f"list_transform(range(1, 2 * CAST(strlen({text}) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex({text}), i, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {pairs}), lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1])))"


OP11_SQL = rf"""
WITH a AS (SELECT doc_id, true AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
 UNION ALL SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM a),
c AS (SELECT own, doc_id, feature, count(*) AS c FROM f GROUP BY ALL),
b AS (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM c)),
n AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE own), 0) AS s, coalesce(sum(c) FILTER (WHERE NOT own), 0) AS t FROM c JOIN b USING (feature) GROUP BY bucket),
z AS (SELECT CAST(coalesce(sum(c) FILTER (WHERE own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (WHERE NOT own), 0) AS DOUBLE) AS t FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(n.t AS DOUBLE) + 1) * (z.s + 10000) / ((CAST(n.s AS DOUBLE) + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM n, z),
d AS (SELECT doc_id, sum(c) AS n, sum(c * gain) AS total FROM c JOIN b USING (feature) JOIN g USING (bucket) WHERE own GROUP BY doc_id),
x AS (SELECT a.doc_id, len(a.w) AS n_words, CAST(coalesce(d.n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(d.total AS DOUBLE) / d.n), 0) AS BIGINT) AS weight,
 CAST('0x' || substr(sha256('7:' || a.doc_id), 1, 8) AS BIGINT) AS h FROM a LEFT JOIN d ON a.doc_id = d.doc_id WHERE a.own),
y AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM y WHERE n_words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN r.r <= (SELECT 25 * count(*) // 100 FROM r) THEN r.r END AS rank FROM y LEFT JOIN r ON y.doc_id = r.doc_id
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The fixed rules of the query.
URL_RULES = [UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/")]


def _op13_sql() -> str:
    """One step of SQL for each level of the tree."""
    rule = lambda value: "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in sorted(URL_RULES, key=lambda r: -len(r.host + r.path))) + " END"
    alike = lambda x, of: f"(a_{of} = {of} OR {of} = 0 OR abs({x} / {of} - (a_{x} - {x}) / (a_{of} - {of})) <= sqrt(ln(2 / {ALPHA}) / 2) * (1 / sqrt({of}) + 1 / sqrt(a_{of} - {of})))"
    purity = f"(sum(bad) + {WEIGHT}::DOUBLE * max(p)) / (sum(lab) + {WEIGHT}::DOUBLE)"
    steps = [f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, {rule(lambda r: r.host + r.path)} AS rule, {rule(lambda r: r.verdict)} AS said, CASE WHEN path = '' THEN [] ELSE string_split(path, '/')[2:] END AS seg FROM h),
t0 AS (SELECT s.*, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad, '' AS node, n, p, false AS done FROM s
 JOIN (SELECT host, count(*) AS n, (count(*) FILTER (WHERE said = 'block') + {WEIGHT}::DOUBLE * {NEUTRAL}::DOUBLE) / (count(said) + {WEIGHT}::DOUBLE) AS p FROM s GROUP BY host) USING (host))"""]
    for k in range(1, DEPTH + 1):
        steps.append(f"""l{k} AS (SELECT *, CASE WHEN len(seg) < {k} THEN '$' ELSE '=' || seg[{k}] END AS kid FROM t{k - 1} WHERE NOT done),
k{k} AS (SELECT host, node, kid, max(n) AS n, max(p) AS p, count(*)::DOUBLE AS c, count(bad)::DOUBLE AS lab, coalesce(sum(bad), 0)::DOUBLE AS bad,
 count(*) FILTER (WHERE len(seg) > {k})::DOUBLE AS on_, count(*) FILTER (WHERE regexp_matches(coalesce(seg[{k + 1}], ''), '[0-9]'))::DOUBLE AS dig FROM l{k} GROUP BY host, node, kid),
a{k} AS (SELECT *, kid != '$' AND c >= {SUPPORT} AND c * {LITERALS} >= n AS literal FROM k{k}),
b{k} AS (SELECT *, sum(c) OVER w AS a_c, sum(lab) OVER w AS a_lab, sum(bad) OVER w AS a_bad, sum(on_) OVER w AS a_on_, sum(dig) OVER w AS a_dig FROM a{k} WINDOW w AS (PARTITION BY host, node, literal)),
c{k} AS (SELECT *, CASE WHEN kid = '$' THEN kid WHEN NOT literal THEN '*' WHEN a_c > c AND {alike('lab', 'c')} AND {alike('bad', 'lab')} AND {alike('on_', 'c')} AND {alike('dig', 'c')} THEN '~' ELSE kid END AS label FROM b{k}),
d{k} AS (SELECT host, node, label, CAST(sum(c) AS BIGINT) AS n, {purity} AS p FROM c{k} GROUP BY host, node, label),
t{k} AS (SELECT page_id, l.host, path, rule, said, seg, bad, l.node || '/' || d.label AS node, d.n, d.p, l.kid = '$' AS done FROM l{k} l
 JOIN (SELECT host, node, kid, label FROM c{k}) x ON l.host = x.host AND l.node = x.node AND l.kid = x.kid JOIN d{k} d ON x.host = d.host AND x.node = d.node AND x.label = d.label
 UNION ALL SELECT page_id, host, path, rule, said, seg, bad, node, n, p, done FROM t{k - 1} WHERE done)""")
    return ",\n".join(steps) + f"\nSELECT page_id, host, path, rule, host || node AS template, coalesce(said, CASE WHEN p >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict FROM t{DEPTH}"


@query("op13_url_filters", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("purity")


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage to a copy of ``conversations``, by the checksum of id and
    turn: a twentieth of the rows each is dropped, emptied, stripped of its
    full stops, repeated, or given the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("harm")
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), harm).where("harm > 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
x AS (SELECT *, {crc32_sql("key")} % 20 AS harm FROM d),
e AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM (SELECT * FROM x WHERE harm > 0 UNION ALL SELECT * FROM x WHERE harm = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS i FROM e),
f AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS i0, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM r),
ins(s, t, c, a, body) AS (VALUES ('', '', 0, '', CAST([] AS VARCHAR[])), ('', 'u', 5, 'I', ['user:']), ('', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 's', 0, '', []), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']),
 ('u', 'u', 0, '', []), ('u', 'a', 5, 'I', ['assistant:']), ('a', 'a', 0, '', []), ('a', 'u', 5, 'I', ['user:'])),
nxt(s, t, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
ops AS (SELECT conv_id, k, s, t, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS c, 'K' AS a, [role || ':' || text] AS body FROM f JOIN (SELECT s, t FROM nxt UNION ALL SELECT '', 's') ON t = i WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
 UNION ALL SELECT conv_id, k, s, t, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', [nxt.role || ':' || text] FROM f, nxt WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
 UNION ALL SELECT conv_id, k, s, s, 2, 'D', [] FROM f, (VALUES (''), ('s'), ('u'), ('a')) AS z(s)),
steps AS (SELECT o.conv_id, o.k, ins.s, o.t, ins.c + o.c AS c, ins.a || o.a AS a, list_concat(ins.body, o.body) AS body FROM ops o JOIN ins ON ins.t = o.s),
best(conv_id, k, s, c, a, body) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', 0, '', CAST([] AS VARCHAR[]) FROM f
 UNION ALL SELECT conv_id, k, t, m.c, m.a, m.body FROM (SELECT b.conv_id, n.k, n.t, arg_min({{'c': b.c + n.c, 'a': b.a || n.a, 'body': list_concat(b.body, n.body)}}, {{'c': b.c + n.c, 'a': b.a || n.a}}) AS m
  FROM best b JOIN steps n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.k = b.k + 1 AND n.s = b.s GROUP BY b.conv_id, n.k, n.t)),
z AS (SELECT b.conv_id, arg_min({{'c': b.c + ins.c, 'a': b.a || ins.a, 'body': list_concat(b.body, ins.body)}}, {{'c': b.c + ins.c, 'a': b.a || ins.a}}) AS m
 FROM best b JOIN (SELECT conv_id, max(k) AS k FROM f GROUP BY conv_id) n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.k = b.k JOIN ins ON ins.s = b.s WHERE ins.t IN ('', 'a') GROUP BY b.conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
 count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(z.m.c, 0) AS BIGINT) AS cost, coalesce(z.m.a, '') AS audit, sha256(coalesce(array_to_string(z.m.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(turns)))
    every = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
